import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest
from llm_texts import prose
from kinweave.llm import common, decontam, lang_id, lm_score, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


# --- language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = common.remainder(F.col("doc_id"), 4) == 2
    filters = lang_id.fit(docs.where(~out))
    found = lang_id.identify(docs, filters).join(docs.where(out).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 100 and (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()


def test_filters_like_exact_sets(spark):
    """Against sets of n-grams counted in plain Python: no n-gram of a language is missed, and few others are let through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = lang_id.fit(docs, sample=10**9)
    rows = [(r.lang, r.text) for r in docs.collect() if r.text]

    def grams(text):
        text = " " + "".join(c if c.isalpha() or ord(c) > 0xFFFF else " " for c in text.lower()) + " "
        text = re.sub(" +", " ", text)
        return [text[i : i + 4] for i in range(len(text) - 3)]

    has, size = {}, Counter(x for x, _ in rows if x)
    for lang, text in rows:
        if lang:
            has.setdefault(lang, Counter()).update(set(grams(text)))
    exact = {x: {g for g, n in c.items() if n >= max(2, lang_id.LEAST_SHARE * size[x])} for x, c in has.items()}
    assert filters.languages == sorted(exact)
    texts = [t for _, t in rows[::9]] + ["", "x", "one two 33 drei\U00020000"]
    total, held = filters.counts(texts)
    agree = 0
    for t, n, counts in zip(texts, total, held, strict=True):
        mine = grams(t)
        plain = [sum(g in exact[x] for g in mine) for x in filters.languages]
        assert n == len(mine) and all(a <= b <= a + 0.05 * n + 3 for a, b in zip(plain, counts, strict=True))
        agree += filters.languages[max(range(len(plain)), key=plain.__getitem__)] == filters.predict([t])[0][0] or not any(plain)
    assert agree >= 0.99 * len(texts)


def test_a_long_text_is_looked_up_in_parts(monkeypatch, frame):
    filters = lang_id.fit(frame([(i, "the old river runs " * 5, "en") for i in range(9)] + [(20 + i, "der alte fluss " * 5, "de") for i in range(9)]))
    texts = ["the old  river, der alte" * 40, "", "fluss", "old river" * 77]
    whole = filters.counts(texts)
    for size in (1, 7, 100):
        monkeypatch.setattr(lang_id, "CHARS", size)
        assert all((a == b).all() for a, b in zip(whole, filters.counts(texts), strict=True))


def test_a_column_that_is_no_language_is_refused(frame, monkeypatch):
    monkeypatch.setattr(lang_id, "LANGUAGES", 5)
    with pytest.raises(ValueError):
        lang_id.fit(frame([(i, "text", f"x{i}") for i in range(9)]))


def test_language_edge_cases(frame, odd_rows, clashing):
    filters = lang_id.fit(frame([(i, "the old river " * 5, "en") for i in range(9)] + [(20 + i, "der alte fluss " * 5, "de") for i in range(9)] + [(50, None, "fr"), (51, "x", None)]))
    found = {(r.doc_id, r.lang_pred) for r in lang_id.identify(frame([*odd_rows, (30, "123 !?"), (31, "old river"), (32, "alte fluss")]), filters).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (30, "und"), (31, "en"), (32, "de")} <= found
    assert lang_id.identify(frame([]), filters).count() == 0
    none = lang_id.fit(frame([]))
    assert {r.lang_pred for r in lang_id.identify(clashing, none).collect()} == {"und"}
    # no text of another language stays, nor of none; one of known words does, and one too short to tell
    kept = lang_id.keep_known(frame([*odd_rows, (31, "old river"), (32, "alte fluss"), (33, "日"), (34, "123 !?")]), filters)
    assert sorted(r.doc_id for r in kept.collect()) == [31, 32, 33]


# --- language model


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})), "\n"]


def brute_base(rows, train):
    c = Counter(w for _, t in train for w in words(t))
    total = sum(c.values()) + 0.1 * (len(c) + 1)
    return [(len(words(t)), sum(c[w] > 0 for w in words(t)), sum(c.values()), sum(math.log10((c[w] + 0.1) / total) for w in words(t))) for _, t in rows]


@pytest.mark.parametrize("heavy", [lm_score.HEAVY, 20])
def test_base_scores_like_brute_force(frame, odd_rows, monkeypatch, heavy):
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    rng = random.Random(heavy)
    rows = [(d, t) for d, t in odd_rows] + [(100 + i, prose(rng, 60)) for i in range(60)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10 and r[0]]
    found = lm_score.score(frame(rows), frame(train)).collect()
    mine = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    assert mine == sorted((a, b, c, round(d, 5)) for a, b, c, d in brute_base(rows, train))
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_model_beats_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = common.remainder(F.col("doc_id"), 10) == 0
    held = lm_score.score(docs, docs.where(~out)).join(docs.where(out).select("doc_id"), "doc_id").toPandas()
    assert held.score.sum() > held.base_score.sum()


def plain_model(model, counts):
    """log10 P(word | the words before it in its text) of the fitted weights, in plain loops over one word at a time."""
    import numpy as np

    C, S = lm_score.CLASSES, lm_score.SLOTS
    known = {int(np.int64(r.h).view(np.uint64)): r.c for r in counts.collect()}
    place = {int(h): int(p) for h, p in zip(model.heavy, model.place, strict=True) if p >= 0}
    hash_of = cache(lambda w: int(lm_score.tokens_of([w.encode()]).hashes[0]) if w else int(lm_score.END))
    end_of = cache(lambda w: int(lm_score.tokens_of([w.encode()]).ends[0]) % lm_score.ENDS if w else 0)
    vocab = model.vocab
    mass = [[] for _ in range(C + lm_score.ENDS)]
    for w in vocab:
        h = hash_of(w)
        k = place[h] // S if h in place else C + end_of(w)
        mass[k].append(known[h] + 0.1)
    total = [sum(m) + (0.1 / lm_score.ENDS if k >= C else 0) for k, m in enumerate(mass)]

    def softmax(rows, bias, table):
        z = [sum(float(table[r][j]) for r in rows) + float(bias[j]) for j in range(len(bias))]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]

    def distribution(before):
        """Probability of each known word, of the end, and of an unseen word for each class by ends."""
        t = lm_score.tokens_of([" ".join(before).encode()])
        contexts = lm_score.contexts_of(t)[:, -1:]  # the end token's, whatever the next word is
        classes = softmax(lm_score.class_rows(contexts)[:, 0], model.bias[0], model.weights[0])
        out, within = {}, {}
        for w in vocab:
            h = hash_of(w)
            if h in place:
                k, slot = divmod(place[h], S)
                if k not in within:
                    within[k] = softmax(lm_score.slot_rows(contexts, np.array([k]))[:, 0], model.bias[1][k], model.weights[1])
                out[w] = classes[k] * within[k][slot]
            else:
                k = C + end_of(w)
                out[w] = classes[k] * (known[h] + 0.1) / total[k]
        unseen = [classes[C + e] * (0.1 / lm_score.ENDS) / total[C + e] for e in range(lm_score.ENDS)]
        return out, unseen

    return distribution, end_of


def test_score_like_plain_loops(frame, monkeypatch):
    """Probabilities of all words sum to one in any context; a text's score is the sum of its tokens' logarithms."""
    rng = random.Random(8)
    train = [(i, prose(rng, 100) + " " + " ".join(f"w{rng.randrange(3000)}{rng.choice('abcd')}" for _ in range(60))) for i in range(90)] + [(90, ""), (91, None)]
    texts = [(i, " ".join((t or "").split()[95:105])) for i, t in train[:3]] + [(200, "the river never Seen before."), (201, ""), (202, None), (203, prose(rng, 9))]
    models = []
    plain = lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda docs: models.append(plain(docs)) or models[-1])
    found = {r.doc_id: r for r in lm_score.score(frame(texts), frame(train)).collect()}
    model, counts = models[0]
    assert any(w.any() for w in model.weights) and (model.place >= 0).sum() == 4096 < len(model.place)
    model.vocab = sorted({w for _, t in train for w in words(t)[:-1]}) + [""]
    distribution, end_of = plain_model(model, counts)
    for _, text in texts:
        for n in (0, 1, 4):
            out, unseen = distribution(words(text)[:-1][:n])
            assert abs(sum(out.values()) + sum(unseen) - 1) < 1e-4
    for i, text in texts:
        total, before = 0.0, []
        for w in [*words(text)[:-1], ""]:
            out, unseen = distribution(before)
            total += math.log10(out[w] if w in out else unseen[end_of(w)])
            before.append(w)
        assert abs(found[i].score - total) < 1e-3 * max(1, abs(total))


def test_mini_batch_like_plain_loops():
    import numpy as np

    rng = np.random.default_rng(1)
    rows, labels, bias = rng.integers(0, 7, (2, 40)), rng.integers(0, 5, 40), rng.normal(size=5).astype(np.float32)
    rows[1] += 7
    w = rng.normal(size=(14, 5)).astype(np.float32)
    want, squares, uses = w.astype(float), np.zeros(14), np.zeros(14)
    grads = np.zeros((14, 5))
    for i, y in enumerate(labels):
        z = [sum(float(w[r, j]) for r in rows[:, i]) + float(bias[j]) for j in range(5)]
        e = [math.exp(x) for x in z]
        for r in rows[:, i]:
            uses[r] += 1
            for j in range(5):
                grads[r, j] += (j == y) - e[j] / sum(e)
    squares += (grads**2).mean(axis=1)
    want += lm_score.RATE * grads / np.sqrt(squares + 1)[:, None]
    used, held = np.zeros(14, np.float32), np.zeros(14, np.float32)
    lm_score.update(w, bias, used, held, rows, labels)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(held, squares, atol=1e-3) and (used == uses).all()


@pytest.mark.parametrize("fan", [2, 32])
def test_every_training_token_enters_one_gradient(spark, frame, odd_rows, monkeypatch, fan):
    """The uses of weight rows that come back are those of all tokens, each in one round, in any number of levels."""
    import numpy as np

    monkeypatch.setattr(lm_score, "FAN", fan)
    rng = random.Random(4)
    docs = frame([*odd_rows, *((100 + i, prose(rng, rng.randrange(0, 90))) for i in range(80))]).select(F.coalesce("text", F.lit("")).alias("text")).repartition(5)
    used = np.zeros(lm_score.FEATURES[0] * lm_score.BUCKETS[0])
    plain = type(docs).toLocalIterator

    def watch(df, *args, **kwargs):
        for r in plain(df, *args, **kwargs):
            if "used" in df.columns and r["factor"] == 0:
                used[r["block"] * lm_score.BLOCK : (r["block"] + 1) * lm_score.BLOCK] += np.frombuffer(r["used"], np.float32)
            yield r

    monkeypatch.setattr(type(docs), "toLocalIterator", watch)
    lm_score.fit(docs)
    tokens = lm_score.tokens_of([r.text.encode() for r in docs.collect()])
    assert (used == np.bincount(lm_score.class_rows(lm_score.contexts_of(tokens)).ravel(), minlength=len(used))).all()


def test_most_frequent_words_are_broadcast(spark, frame, monkeypatch):
    """As many words as the bound lets in, however rare they are; words of one count are all in or all out."""
    import numpy as np

    rng = random.Random(21)
    df = spark.createDataFrame([(i, int(rng.paretovariate(0.4)) % 10**7 + 1) for i in range(3000)], "h bigint, c bigint")
    found = np.sort([r.c for r in df.collect()])[::-1]
    for bound in (1, 5, 700, 2000, 2999, 3000, 5000):
        monkeypatch.setattr(lm_score, "HEAVY", bound)
        least = lm_score._least(df, int(found.sum()))
        assert (found >= least).sum() <= bound and (least == 1 or (found >= least - 1).sum() > bound)
    monkeypatch.setattr(lm_score, "HEAVY", 6008)
    docs = frame([(i, " ".join(f"w{(i * 300 + j) % 6000} " + "x%d " % (j % 7) * 40 for j in range(300))) for i in range(40)])
    assert len(lm_score.fit(docs.select("text").limit(0))[0].heavy) == 0
    monkeypatch.setattr(lm_score, "_round", lambda docs, model, number: None)
    assert len(lm_score.fit(docs.select("text"))[0].heavy) == 6008  # before: 7, those over 1/6008 of the tokens


def test_softmax_of_unlike_tokens():
    """One token's logits may lie far below another's."""
    import numpy as np

    w = np.array([[0, 1, 2], [300, 290, 280], [-200, -201, -203]], np.float32)
    rows = np.array([[0, 1, 2]])
    for part in (rows, rows[:, :1], rows[:, :0]):
        z = w[part[0]].astype(float)
        want = np.exp(z - z.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(lm_score.probabilities(w, np.zeros(3, np.float32), part), want, atol=1e-6)
        label = np.arange(part.shape[1])
        assert np.allclose(lm_score.log_probabilities(w, np.zeros(3, np.float32), part, label), np.log(want[label, label]), atol=1e-4)


def test_model_without_training_or_documents(frame, clashing):
    (row,) = lm_score.score(frame([(1, "a b")]), frame([])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and abs(row.base_score) < 1e-9
    assert lm_score.score(frame([]), frame([(1, "a")])).count() == 0
    assert lm_score.score(clashing, clashing).count() == 2


# --- quality


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = common.remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels.where(~out))
    found = quality.score_quality(docs, model).join(labels.where(out), "doc_id").toPandas()
    assert ((found.score >= 0.3) == (found.quality == 1)).mean() > 0.9 and found.score.between(0, 1).all()


def test_quality_edge_cases(spark, frame, odd_rows, clashing):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(frame(odd_rows), labels)
    assert {r.score for r in quality.score_quality(frame(odd_rows), model).collect()} == {0.5}
    both = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = quality.fit(frame([(i, "good words here " * 9 if i % 2 else "B@D $$$ " * 9) for i in range(40)]), both)
    found = {r.doc_id: r.score for r in quality.score_quality(frame([*odd_rows, (70, "good words here"), (71, "B@D $$$ B@D")]), model).collect()}
    assert found[70] > 0.5 > found[71] and len(found) == len({r[0] for r in odd_rows}) + 2
    assert quality.score_quality(frame([]), model).count() == 0 and quality.score_quality(clashing, model).count() == 2


# --- decontamination


def test_leaks_and_paraphrases(spark, frame, odd_rows, clashing):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(20)]
    clean = [(i, prose(rng, 300)) for i in range(1000, 1100)]
    exact, near = [], []
    for i, text in items[:15]:
        host = prose(rng, 200).split()
        at = rng.randrange(len(host))
        exact.append((2000 + i, " ".join([*host[:at], text, *host[at:]])))
        changed = [w if rng.random() > 0.15 else prose(rng, 1) for w in text.split()]
        near.append((3000 + i, " ".join([*host[:at], *changed, *host[at:]])))
    docs = frame([*clean, *exact, *near, *odd_rows])
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words")], "item_id bigint, text string")
    groups = decontam.fit(docs, bench)
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, groups).collect()}
    assert {(2000 + i, i) for i in range(15)} <= found
    assert len({(3000 + i, i) for i in range(15)} & found) >= 13
    assert not {d for d, _ in found if d is None or d < 2000}
    left = decontam.drop_leaks(docs, groups)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in found})
    none = decontam.fit(frame([]), bench.where("false"))
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.find_leaks(frame([]), groups).count() == 0
    assert decontam.find_leaks(clashing, groups).count() == 0


def test_recall_with_replaced_words(spark, frame):
    """Items of which 10, 20 and 30 % of the words are replaced, each inside a text of its own; no clean text is named."""
    rng = random.Random(15)
    items = [(i, prose(rng, rng.randrange(25, 70))) for i in range(60)]
    rows = [(i, prose(rng, 250)) for i in range(200)]
    for share in (10, 20, 30):
        for i, text in items:
            words_ = text.split()
            for at in rng.sample(range(len(words_)), len(words_) * share // 100):
                words_[at] = f"other{rng.randrange(10**6)}"
            host = prose(rng, 200).split()
            at = rng.randrange(len(host))
            rows.append((1000 * share + i, " ".join([*host[:at], *words_, *host[at:]])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(rows)
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, decontam.fit(docs, bench)).collect()}
    for share in (10, 20, 30):
        assert len({(1000 * share + i, i) for i, _ in items} & found) >= 0.9 * len(items), share
    assert not [d for d, _ in found if d < 1000] and len([1 for d, i in found if d % 1000 != i]) == 0


def test_short_items_and_groups(spark, frame, odd_rows, monkeypatch):
    """Items of one or two different words are found word for word; signs and case don't matter; groups come one at a time."""
    monkeypatch.setattr(decontam, "BLOCK", 2)
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    rng = random.Random(16)
    long = [(i, prose(rng, 30)) for i in range(9)]
    bench = spark.createDataFrame([*long, (20, "Zebra!"), (21, "yes yes \u00d6l"), (22, "..."), (23, "")], "item_id bigint, text string")
    rows = [*odd_rows, (100, "A \u201czebra\u201d, \u2014seen."), (101, "zebras"), (102, "Yes, yes: \u00f6l"), (103, "yes \u00f6l yes"), (104, prose(rng, 40) + " \u2018" + long[7][1].upper() + "\u2019 " + prose(rng, 40))]
    docs = frame(rows)
    groups = decontam.fit(docs, bench)
    found = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, groups).collect())
    assert found == [(100, 20), (102, 21), (104, 7)] and len(list(groups)) == 3
    assert decontam.drop_leaks(docs, groups).count() == len(rows) - 3


def test_term_weights_cover_all_documents(spark, frame, odd_rows, monkeypatch):
    """Weights and terms are those of plain counts over all passages, however small the sample is."""
    import numpy as np

    monkeypatch.setattr(decontam, "SAMPLE", 20)
    rng = random.Random(12)
    rows = [*odd_rows, *((100 + i, prose(rng, rng.randrange(10, 200))) for i in range(150))]
    bench = spark.createDataFrame([(i, prose(rng, 30)) for i in range(10)], "item_id bigint, text string")
    ((block,),) = decontam.fit(frame(rows), bench)
    total, has = 0, Counter()
    for _, t in rows:
        h, _ = decontam.hashed_words([(t or "").encode()])
        for at in range(0, len(h), decontam.STRIDE):
            total += 1
            has.update(set(h[at : at + decontam.WINDOW].tolist()))
    want = np.array([math.log((1 + total) / (1 + has[t])) + 0.1 for t in block.terms.tolist()])
    assert np.allclose(block.idf, want, atol=1e-4)


def test_latent_space_covers_all_documents(spark, frame, odd_rows, monkeypatch):
    """The space holds nearly as much of all passages as the best one of its rank does, however small the sample is."""
    import numpy as np

    for name, value in (("SAMPLE", 2), ("RANK", 12), ("OVER", 2), ("ROWS", 7), ("RANGE", 16), ("FAN", 2), ("COMMON", 1.0)):
        monkeypatch.setattr(decontam, name, value, raising=False)
    rng = random.Random(18)
    items = [(i, prose(rng, 25)) for i in range(40)]
    # passages mix the words of a few items, some mixtures more often than others
    rows = [*odd_rows, *((100 + i, " ".join(rng.sample(" ".join(items[(7 * k + j) % 40][1] for j in range(4)).split(), 90))) for i in range(200) for k in [int(rng.random() ** 2 * 12)])]
    ((block,),) = decontam.fit(frame(rows).repartition(9), spark.createDataFrame(items, "item_id bigint, text string"))
    at = {t: n for n, t in enumerate(block.terms.tolist())}
    texts = [decontam.hashed_words([(t or "").encode()])[0].tolist() for _, t in rows]
    windows = [{at[w] for w in h[i : i + decontam.WINDOW] if w in at} for h in texts for i in range(0, len(h), decontam.STRIDE)]
    total, windows = len(windows), [w for w in windows if len(w) >= decontam.LEAST_TERMS]
    matrix = np.zeros((len(windows) + len(items), len(at)))
    for n, w in enumerate(windows):
        matrix[n, list(w)] = block.idf[list(w)]
    for n, (_, text) in enumerate(items, len(windows)):
        own = [at[w] for w in decontam.hashed_words([text.encode()])[0].tolist()]
        matrix[n, own] = block.idf[own] * np.sqrt(4 * total / len(items))
    space = np.linalg.qr(block.base / block.idf[:, None])[0]
    best = (np.linalg.svd(matrix, compute_uv=False)[: space.shape[1]] ** 2).sum()
    assert ((matrix @ space) ** 2).sum() > 0.9 * best


@pytest.mark.parametrize("sample", [2, 10**6])
def test_latent_space_hardly_depends_on_the_sample(spark, frame, odd_rows, monkeypatch, sample):
    """Two rows or all of them as the start: the space holds as much of all passages as the best one of its rank does."""
    import numpy as np

    for name, value in (("SAMPLE", sample), ("RANK", 12), ("OVER", 0), ("COMMON", 1.0)):
        monkeypatch.setattr(decontam, name, value)
    rng = random.Random(19)
    items = [(i, prose(rng, 25)) for i in range(40)]
    rows = [*odd_rows, *((100 + i, " ".join(rng.sample(" ".join(items[(7 * k + j) % 40][1] for j in range(4)).split(), 90))) for i in range(200) for k in [int(rng.random() ** 2 * 12)])]
    ((block,),) = decontam.fit(frame(rows).repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    hashes = [decontam.hashed_words([(t or "").encode()])[0] for _, t in rows]
    windows = [w for h in hashes for i in range(0, len(h), decontam.STRIDE) if len(w := np.flatnonzero(np.isin(block.terms, h[i : i + decontam.WINDOW]))) >= decontam.LEAST_TERMS]
    total = sum(-(-len(h) // decontam.STRIDE) for h in hashes)
    own = [np.flatnonzero(np.isin(block.terms, decontam.hashed_words([text.encode()])[0])) for _, text in items]
    matrix = np.zeros((len(windows) + len(own), len(block.terms)))
    for n, w in enumerate([*windows, *own]):
        matrix[n, w] = block.idf[w] * (1 if n < len(windows) else np.sqrt(4 * total / len(items)))
    space = np.linalg.qr(block.base / block.idf[:, None])[0]
    best = (np.linalg.svd(matrix, compute_uv=False)[:12] ** 2).sum()
    share = ((matrix @ space) ** 2).sum() / best
    assert share > 0.975, share


def test_index_recall_against_brute_force(spark):
    """Every (document, item) pair with the item's words in order is found."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, decontam.fit(docs, bench)).collect()}
    plain = lambda s: " ".join(re.sub(r"[^\w]+", " ", s or "").lower().split())
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for p in [plain(r.text)] for i, t in items.items() if t in p}
    assert len(want & found) >= 0.9 * len(want) and len(found - want) <= 2


def test_common_subsequence():
    import numpy as np

    rng = random.Random(0)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert decontam.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == best[-1][-1]


# --- training and partitions


def test_learning_hardly_depends_on_partitions(spark):
    """Held-out log10 a token with the training rows in 1, 4 and 32 partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = common.remainder(F.col("doc_id"), 10) == 0
    found = {}
    for n in (1, 4, 32):
        r = lm_score.score(docs.where(out), docs.where(~out).repartition(n)).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        found[n] = r[0] - r[1]
    assert min(found.values()) > 0.15 and max(found.values()) - min(found.values()) < 0.05, found


def test_rounds_carry_the_shortlist_only(spark, frame, monkeypatch):
    """All frequent words are broadcast once, to score; what travels in each round is bounded by the shortlist."""
    sizes = []
    monkeypatch.setattr(lm_score, "_round", lambda docs, model, number: sizes.append((len(model.heavy), len(model.counts), int((model.place >= 0).sum()))))
    docs = frame([(i, " ".join(f"w{(i * 300 + j) % 6000} x{j % 7}" for j in range(300))) for i in range(40)])
    model, _ = lm_score.fit(docs.select("text"))
    most = lm_score.CLASSES * lm_score.SLOTS
    assert sizes == [(most, most, most)] * lm_score.ROUNDS and len(model.heavy) == len(model.counts) == 6008


# --- samples are bounded by rows


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i, lambda i: None if i % 2 else i])
def test_samples_never_exceed_their_bounds(spark, frame, monkeypatch, ids):
    """Null ids, one id for all rows, unlike ids: as many rows as the bound, and repeated rows are one."""
    rows = [(ids(i), f"text number {i} of many words", "en" if i % 3 else "de") for i in range(400)]
    df = frame(rows + rows[:150])
    key = df.select("doc_id", "text")
    assert 20 <= common.drawn(key, 40).count() <= 40 and common.drawn(key, 10**6).count() == 400
    per = {r[0]: r[1] for r in common.drawn(df.select("lang", "text", "doc_id"), 30, "lang").groupBy("lang").count().collect()}
    assert set(per) == {"en", "de"} and all(15 <= n <= 30 for n in per.values())
    same = frame([(i % 2, "the same text") for i in range(300)])
    assert common.drawn(same.select("doc_id", "text"), 10).count() <= 2
    monkeypatch.setattr(decontam, "SAMPLE", 25)
    bench = spark.createDataFrame([(1, "some words of an item that is long enough to be found in a text")], "item_id bigint, text string")
    assert 10 <= decontam.fit(df, bench).sample.count() <= 25
    labels = spark.createDataFrame([(r[0], n % 2) for n, r in enumerate(rows)], "doc_id bigint, quality int")
    assert common.labelled_sample(df, labels, "doc_id", "text", "quality", 35).count() <= 35


def test_registered_queries_hold_rows_out(spark):
    """What the thin queries add to the operators: columns, types, splits by crc32, and one row a document."""
    from kinweave.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = {
        "op5_language_id": (4, 2, ["doc_id", "held_out", "lang_pred", "score"]), "op8_quality": (5, 0, ["doc_id", "held_out", "score", "predicted"]),
        "op6_lm_score": (10, 0, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    }
    for name, (mod, rest, columns) in expected.items():
        df = queries.QUERIES[name](spark, SF)
        rows = df.collect()
        assert df.columns[: len(columns)] == columns and sorted(r.doc_id for r in rows) == sorted(docs), name
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows), name

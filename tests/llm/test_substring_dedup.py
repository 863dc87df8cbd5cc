import random
import re

import pytest
from llm_texts import prose
from kinweave.llm import substring_dedup as sd


def plain_runs(text, sentences=3, words=20):
    """Pieces of a text of short sentences (no sentence is cut), and spans (begin, end, words) of its shortest runs, in plain Python."""
    pieces = [p.split() for line in text.split("\n") for p in re.split(r"(?<=[.!?])\s+", line) if p.split()]
    assert all(len(p) <= sd.LONG for p in pieces)
    spans = set()
    enough = lambda a, b: b - a >= sentences or b - a >= 2 and sum(map(len, pieces[a:b])) >= words
    for i in range(len(pieces)):
        ends = [b for b in range(i + 1, len(pieces) + 1) if enough(i, b)]
        begins = [a for a in range(i, -1, -1) if enough(a, i + 1)]
        spans |= {(i, ends[0])} if ends else set()
        spans |= {(begins[0], i + 1)} if begins else set()
    return pieces, sorted((a, b, tuple(w for p in pieces[a:b] for w in p)) for a, b in spans)


def brute(rows):
    """Numbers of the pieces removed of each row, in the order of ids."""
    seen, out = {}, []
    for n, (doc, text, *_) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        pieces, runs = plain_runs(text or "")
        gone = set()
        for a, b, w in runs:
            if w in seen and seen[w] != (n, a):
                gone |= set(range(a, b))
            seen.setdefault(w, (n, a))
        out.append((doc, len(pieces), sorted(gone)))
    return sorted(out, key=repr)


def found_in(frame, rows, **kwargs):
    got = sd.remove_repeats(frame(rows), **kwargs).collect()
    return sorted(((r.doc_id, r.n_sentences, [i for x in r.removed for i in range(x.begin, x.end)]) for r in got), key=repr)


def short_prose(rng, n):
    """Texts over a few sentences of one to twenty words, so that runs of all lengths repeat in and between them."""
    pool = [" ".join(f"w{k}" for _ in range(k % 7 * 3 + 1)) + ".!?"[k % 3] for k in range(9)]
    return "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("bits", [sd.BITS, 64])
def test_like_plain_python(frame, bits):
    """With a filter that is full as well."""
    rng = random.Random(bits)
    rows = [(i, short_prose(rng, rng.randrange(0, 14))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "A few. Short ones. Here."), (104, "Before it. A few. Short  ones.\nHere. After it."), (105, "A few. Short ones. Other.")]
    want = brute(rows)
    assert found_in(frame, rows, bits=bits) == want and sum(len(g) for *_, g in want) > 100
    by = {d: g for d, _, g in want}
    assert by[104] == [1, 2, 3] and by[105] == []


def test_rows_that_share_an_id_are_told_apart(frame):
    text = "One of them here. Another one there. The third comes last."
    for ids in ([7, 7, 7], [None, None, None], [None, 5, 5]):
        found = [r.n_removed for r in sd.remove_repeats(frame([(i, text) for i in ids]).repartition(3)).collect()]
        assert sorted(found) == [0, 3, 3]


def test_planted_passages_go_and_the_first_stays(frame):
    rng = random.Random(2)
    passage = prose(rng, 70)
    clean = [(i, prose(rng, 300)) for i in range(40)]
    planted = []
    for i in range(40, 60):
        words = prose(rng, 200)
        cut = words.index(". ") + 2
        planted.append((i, words[:cut] + passage + " " + words[cut:]))
    found = {r.doc_id: r for r in sd.remove_repeats(frame(clean + planted)).collect()}
    assert all(found[i].n_removed == 0 and found[i].text == t for i, t in clean)
    assert passage in found[40].text
    for i, t in planted[1:]:
        assert passage not in found[i].text and found[i].text == t.replace(passage + " ", "")


def test_repeats_inside_a_text(frame):
    block = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. "
    (row,) = sd.remove_repeats(frame([(1, block * 3 + "The end.")])).collect()
    assert row.n_sentences == 7 and row.text.startswith(block) and row.text.endswith("The end.") and row.n_removed == 4


def test_sentences_and_runs_do_not_depend_on_the_block():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 200)).encode() for _ in range(50)] + [b"", b"\n\n", " é… à. ".encode(), b"word " * 500]
    whole = list(sd.runs_of(texts))
    for t, (places, hashes, spans) in zip(texts, whole, strict=True):
        ((p, h, s),) = list(sd.runs_of([t]))
        assert (p == places).all() and h == hashes and (s == spans).all()


def test_odd_rows(frame, odd_rows, clashing):
    found = sd.remove_repeats(frame(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    same = [r for r in found if r.doc_id == 5]
    assert len(same) == 2 and all(r.text == "Same row." for r in same)
    assert {r.text for r in found if r.doc_id in (1, 2)} == {""}
    assert sd.remove_repeats(frame([])).count() == 0 and sd.remove_repeats(clashing).count() == 2


def grams(text, n=51):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_repeats_in_unpunctuated_text_like_ngram_brute_force(frame):
    rng = random.Random(51)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [plain(51 + i % 10) for i in range(60)]
    rows = [(i, " ".join([plain(rng.randrange(30, 90)), passages[i % 60], plain(rng.randrange(30, 90))])) for i in range(120)]
    rows += [(200 + i, plain(150)) for i in range(20)]
    rows += [(300 + i, passages[i]) for i in range(60)]  # with no text around them
    seen, late = set(), set()
    for i, t in rows:
        if grams(t) & seen:
            late.add(i)
        seen |= grams(t)
    found = {r.doc_id: r.text for r in sd.remove_repeats(frame(rows)).collect()}
    assert {i for i, t in rows if found[i] != t} == late == {*range(60, 120), *range(300, 360)}
    for i, t in rows:
        if i in late:  # all but CUT words at either end
            assert len(t.split()) - len(found[i].split()) >= 51 - 2 * 8


def test_stops_before_closing_signs_and_of_other_scripts():
    text = 'He said "go." Then (she left.) \u00bbEnde.\u00ab \u0939\u0948\u0964 \u0647\u06d4 \u6587\u3002\u300d v1.2 and 3.5) \u2026 "\u201d.'
    ((places, _, _),) = sd.runs_of([text.encode()])
    ends = [text.encode()[b - 12 if b > 12 else 0 : b].decode("utf-8", "ignore").split()[-1] for _, b in places]
    assert ends == ['"go."', "left.)", "\u00bbEnde.\u00ab", "\u0939\u0948\u0964", "\u0647\u06d4", "\u6587\u3002\u300d", "\u2026", '"\u201d.']

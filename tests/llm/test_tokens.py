import hashlib
import random
import re

import public_tokenizers
import pytest
from kinweave.llm import bpe, token_count
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "th", "'s", "'ll", " ", "\n", "<|endoftext|>", "<|EndOfText|>", "é", "e\u0301", "ß", "İ", "Σ", "ς", "中", "文", "🙂", "1", "23", "!!", "...", "\xa0", "\x1c", "\u3000", "don't", "''s", "\u0301", "A", "K"]


@pytest.fixture(scope="module")
def tok():
    return bpe.load(PATH)


def odd(n, seed=3, size=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(size))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, "", "'" * 500 + "s"]


def test_units_encode_like_the_library(tok):
    encoder = bpe.Encoder(PATH)
    for text in odd(1500):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == ids
        assert encoder.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_joined_pieces_encode_like_the_whole(tok):
    for text in odd(400, seed=9, size=120):
        want = tok.encode(text, add_special_tokens=False).ids
        for limit in (9, 50):
            pieces = [bpe.encode_piece(tok, p) for p in bpe.halves(text, limit)]
            if len(pieces) < 300:
                assert bpe.concatenate(tok, pieces).ids.tolist() == want


def test_pieces_of_any_script_are_halved(tok):
    rng = random.Random(4)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40_000))
    texts = [han, "a " * 9000 + han, han + "\u0301" * 20, "\u0301" * 500, "".join(rng.choice("\u1112\u1161\u11ab\u0915\u093f\u0e01\u0e34") for _ in range(5000))]
    for text in texts:
        limit = 300 if len(text) < 6000 else 1 << 12
        parts = bpe.halves(text, limit)
        assert "".join(parts) == text and all(0 < len(p) <= limit for p in parts)
        assert bpe.concatenate(tok, [bpe.encode_piece(tok, p) for p in parts]).ids.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_caches_are_bounded_by_bytes(monkeypatch, tok):
    monkeypatch.setattr(bpe, "HOT", 5000)
    monkeypatch.setattr(bpe, "RECENT", 5000)
    encoder = bpe.Encoder(PATH)
    for text in odd(300, seed=6) + ["x" * 100 + str(i) for i in range(50)]:
        assert encoder.ids(text) == tok.encode(text, add_special_tokens=False).ids
        assert max(encoder.sizes) <= 5000 + 2000 and all(len(u) <= bpe.KEPT for c in (encoder.hot, encoder.recent, encoder.words) for u in c)


def test_longest_prefix_within_a_limit_like_the_library(tok):
    counter = token_count.PrefixCounter(PATH)
    rng = random.Random(7)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    special = ("<|endoftext|>", "<|startoftext|>")
    for text in [t for t in odd(150, seed=8, size=40)[:150] if t] + [han, "don't we'll " * 9, "x" * 200, "internationalization " * 8, "a<|endoftext|>b" * 6]:
        counts = [len(tok.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        inside = {m.start() + d for x in special for m in re.finditer(re.escape(x), text) for d in range(1, len(x))}
        for limit in (0, 1, 5, 40):
            fair = [n for n in range(len(text) + 1) if counts[n] <= limit and n not in inside and (n in (0, len(text)) or bpe.begins(text[n]) or bpe.SPLIT.match(text[n - 1]))]
            assert counter.cut(text, limit) == max(fair), (text, limit)
        table = counter.counted(text)
        assert [counter.at(text, n, table) for n in range(len(text) + 1)] == counts


def test_stored_prefix_counts_answer_budgets(frame, odd_rows, tok):
    table = token_count.prefix_table(frame(odd_rows), PATH)
    found = table.select("doc_id", token_count.tokens_upto(F.lit(9)).alias("n"), token_count.longest_within(F.lit(3)).alias("cut"), F.element_at(F.concat(F.array(F.lit(0)), "tokens"), -1).alias("all")).collect()
    texts = {d: t or "" for d, t in odd_rows}
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for r in found:
        text = texts[r.doc_id]
        ends = [m.end() for m in re.finditer(r"\S+", text)]
        assert r["all"] == count(text)
        assert r.n == count(text[: max([e for e in ends if e <= 9], default=0)])
        assert r.cut == max([e for e in ends[:40] if count(text[:e]) <= 3], default=0)


def test_prefix_table_counts_like_the_library(tok):
    counter = token_count.PrefixCounter(PATH)
    for text in odd(1500, seed=5):
        assert sum(counter.counts(text)) == len(tok.encode(text, add_special_tokens=False).ids)
    for word in ("internationalization", "thntthedblest", "aaaaaaabbbbbbb", "x" * 60):
        assert counter.prefixes(word) == [len(tok.encode(word[:n], add_special_tokens=False).ids) for n in range(len(word) + 1)]
    text = "one two  three <|endoftext|> four's\n"
    for n in range(len(text)):
        assert counter.at(text, n) == len(tok.encode(text[:n], add_special_tokens=False).ids)


def test_operator_on_odd_rows(spark, frame, odd_rows, tok):
    rows = [*odd_rows, (20, "mixed Words, and " * 60), (21, "x" * 3000 + " <|endoftext|> " + "y" * 2500)]
    found = bpe.encode_decode(frame(rows), PATH, ("ids", "ids_sha256", "decoded", "decoded_sha256"), piece=1000).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_decode_column(spark, frame):
    df = bpe.encode_decode(frame([(1, "Hello there"), (2, None)]), PATH, ("ids",))
    assert {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()} == {1: "hello</w> there</w>", 2: ""}


def test_counts_on_odd_rows(spark, frame, odd_rows, tok):
    found = token_count.count_tokens(frame(odd_rows), PATH, limit=100).collect()
    texts = {r[0]: r[1] or "" for r in odd_rows}
    assert len(found) == len(odd_rows)
    for r in found:
        text = texts[r.doc_id]
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
        assert len(tok.encode(text[: r.cut_chars], add_special_tokens=False).ids) <= 100


def test_empty_and_clashing(frame, clashing):
    assert token_count.count_tokens(frame([]), PATH).count() == 0
    assert bpe.encode_decode(frame([]), PATH).count() == 0
    assert token_count.count_tokens(clashing, PATH).count() == 2
    assert bpe.encode_decode(clashing, PATH, ("ids_sha256",)).count() == 2

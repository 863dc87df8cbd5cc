"""BPE encoding and decoding with a public vocabulary, by tree concatenation.

White space always splits a text for the tokenizers that are supported here, so ordinary text is encoded unit by unit
through a bounded cache.  A text over ``PIECE`` characters is halved again and again; its pieces are rows of their own,
which tasks encode in parallel, wherever the cuts fall.  The encodings of a text's pieces are then joined pairwise, as a
tree: around each join a growing window is encoded again, until a token of the left side and one of the right side agree
exactly (same id, same characters, not touching the window's own ends); what lies between them is replaced.  A BPE
encoding is determined by its pairs of neighbours, so agreement at both ends makes the joined encoding exact.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Characters of the longest piece of text that one row encodes.
PIECE = 1 << 15
#: Characters on either side of a join that the first window takes.
WINDOW = 48
#: The least window that holds any special token whole, with a token beside it.
LEAST = 32
#: Bytes of units that a task's cache keeps for good, and of units that it keeps for a while; longest unit that it keeps.
HOT, RECENT, KEPT = 48 << 20, 48 << 20, 64
#: White space that splits text in the vocabulary's own pattern (\s of the tokenizers library).
SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The vocabulary's own pattern for words (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CONTROL = re.compile("[\x1c-\x1f]")


def load(path: str):
    """The tokenizer without truncation and padding; one thread, as Spark runs the tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def units(text: str) -> list[str]:
    """The parts of a text between white space, lower-cased already where that can't change what is found."""
    if text.isascii() or _is_latin(text):
        if "<|" not in text:
            text = text.lower()
        if not _CONTROL.search(text):
            return text.split()
    return [u for u in SPLIT.split(text) if u]


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


_SYMBOLS = byte_symbols()


def as_symbols(word: str) -> str:
    return word.encode().decode("latin-1").translate(_SYMBOLS)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Encodes units through two bounded caches; each task has its own.

    A unit's entry holds its ids, their digits and their tokens, so that a text's columns are plain concatenations.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.hot: dict[str, tuple] = {}
        self.recent: dict[str, tuple] = {}
        self.words: dict[str, list[int]] = {}
        self.sizes = [0, 0, 0]  # bytes held by each

    def _entry(self, unit: str) -> tuple:
        if "<|" in unit or not (unit.isascii() and unit.islower() or unit.islower() and _is_latin(unit)):
            ids = self.tok.encode(unit, add_special_tokens=False).ids
        else:
            ids = []
            for w in WORDS.findall(unit):
                if (got := self.words.get(w)) is None:
                    got = [t.id for t in self.model.tokenize(as_symbols(w))]
                    if len(w) < min(len(unit), KEPT):
                        self.sizes[2] += 200 + 9 * len(got)
                        if self.sizes[2] > RECENT:
                            self.words.clear()
                            self.sizes[2] = 200 + 9 * len(got)
                        self.words[w] = got
                ids += got
        return tuple(ids), " ".join(map(str, ids)), self.decode(ids)

    def _entries(self, text: str) -> list[tuple]:
        hot, recent, out = self.hot, self.recent, []
        for u in units(text):
            e = hot.get(u) or recent.get(u)
            if e is None:
                e = self._entry(u)
                if len(u) <= KEPT:
                    size = 350 + 9 * len(e[0]) + len(e[1]) + 2 * len(e[2])
                    if self.sizes[0] + size <= HOT:
                        hot[u] = e
                        self.sizes[0] += size
                    else:
                        if self.sizes[1] + size > RECENT:
                            recent.clear()
                            self.sizes[1] = 0
                        recent[u] = e
                        self.sizes[1] += size
            if e[0]:
                out.append(e)
        return out

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(e[0] for e in self._entries(text)))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: tokens are joined by spaces, special ones included."""
        return " ".join(map(self.names.__getitem__, ids))

    def columns(self, texts: list[str], want: tuple[str, ...]) -> dict:
        """The columns that ``want`` names, and n_tokens."""
        out: dict = {c: [] for c in ("n_tokens", *want)}
        for text in texts:
            entries = self._entries(text)
            row = {"digits": " ".join([e[1] for e in entries]), "decoded": " ".join([e[2] for e in entries])}
            self._add(out, row["digits"], row["decoded"], (lambda x=entries: list(chain.from_iterable(e[0] for e in x))))
        return out

    def columns_of_ids(self, ids: list[int], want: tuple[str, ...]) -> dict:
        out: dict = {c: [] for c in ("n_tokens", *want)}
        self._add(out, " ".join(map(str, ids)), self.decode(ids), lambda: ids)
        return out

    def _add(self, out: dict, digits: str, decoded: str, ids) -> None:
        out["n_tokens"].append(digits.count(" ") + 1 if digits else 0)
        if "ids" in out:
            out["ids"].append(ids())
        if "ids_sha256" in out:
            out["ids_sha256"].append(hashlib.sha256(digits.encode()).hexdigest())
        if "decoded" in out:
            out["decoded"].append(decoded)
        if "decoded_sha256" in out:
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())


# --- long texts


@cache
def _joined() -> frozenset[str]:
    """Characters that canonical composition may join to the one before: second parts of pairs, and Hangul vowels and tails."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c))
        if parts and "<" not in parts and " " in parts:
            found.add(chr(int(parts.split()[1], 16)))
    return frozenset(found)


def begins(c: str) -> bool:
    """True if normalisation never joins a character to what stands before it, or moves it there."""
    return c < "\u0300" or (not unicodedata.combining(c) and c not in _joined())


def halves(text: str, limit: int = PIECE) -> list[str]:
    """Halve a text until no piece is over ``limit``.

    A cut is moved to the nearest character, before or after the middle, that ``begins``; where there is none, as in a
    text of combining marks only, it falls in the middle all the same, and the join takes care of it.
    """
    if len(text) <= limit:
        return [text]
    cut = middle = len(text) // 2
    for d in range(middle):
        if begins(text[middle + d]):
            cut = middle + d
            break
        if middle - d > 0 and begins(text[middle - d]):
            cut = middle - d
            break
    return [*halves(text[:cut], limit), *halves(text[cut:], limit)]


class Piece:
    """A text with its encoding: ids and the characters from where to where each token stands, as arrays."""

    def __init__(self, text: str, ids, starts, ends):
        self.text = text
        self.ids, self.starts, self.ends = (np.asarray(x, dtype=np.int32) for x in (ids, starts, ends))


    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """What lies between a token and the one before, and its length: small numbers, which shuffles compress well."""
        return self.starts - np.concatenate([np.zeros(1, np.int32), self.ends[:-1]])[: len(self.ends)], self.ends - self.starts

    @staticmethod
    def of_steps(text: str, ids, gaps, lengths) -> Piece:
        gaps, lengths = (np.asarray(x, dtype=np.int32) for x in (gaps, lengths))
        ends = np.cumsum(gaps + lengths, dtype=np.int32)
        return Piece(text, ids, ends - lengths, ends)


def encode_piece(tok, text: str) -> Piece:
    e = tok.encode(text, add_special_tokens=False)
    spans = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
    return Piece(text, e.ids, spans[:, 0], spans[:, 1])


def _apart(p: Piece) -> np.ndarray:
    """For each token, True if it begins where the one before it has ended, or later."""
    return np.concatenate([[True], p.ends[:-1] <= p.starts[1:]]) if len(p.ids) else np.zeros(0, bool)


def join(tok, a: Piece, b: Piece, width: int = WINDOW) -> Piece:
    """The exact encoding of both texts together.

    The window begins with a token of the left side and ends with one of the right side, each apart from its
    neighbours.  It is encoded again, and grows, until its first token is the left side's and some token of it that is
    apart from its neighbours, before its last, is the right side's.
    """
    n, width = len(a.text), max(width, LEAST)
    free_a, free_b = _apart(a), np.append(_apart(b)[1:], True)
    while True:
        k = begin = 0
        if width < n:
            some = np.flatnonzero(free_a & (a.starts <= n - width))
            k = int(some[-1]) if len(some) else 0
            begin = int(a.starts[k]) if k else 0
        stop = len(b.text)
        if width < stop:
            some = np.flatnonzero(free_b & (b.ends >= width))
            stop = int(b.ends[some[0]]) if len(some) else stop
        w = encode_piece(tok, a.text[begin:] + b.text[:stop])
        starts, ends = w.starts + begin, w.ends + begin
        left = 0 if begin == 0 else None
        if left is None and len(w.ids) and w.ids[0] == a.ids[k] and starts[0] == a.starts[k] and ends[0] == a.ends[k] and ends[0] < n:
            left = 1
        right = None
        if stop == len(b.text):
            right = (len(w.ids), len(b.ids))
        elif len(w.ids) and len(b.ids):
            free = _apart(w)
            at = np.flatnonzero(free[:-1] & free[1:] & (starts[:-1] >= n))
            j = np.minimum(np.searchsorted(b.starts, starts[at] - n), len(b.ids) - 1)
            same = (b.starts[j] + n == starts[at]) & (b.ends[j] + n == ends[at]) & (b.ids[j] == w.ids[at]) & (b.ends[j] <= stop) & (j + 1 < len(b.ids))
            if same.any():
                last = np.flatnonzero(same)[-1]
                right = (int(at[last]) + 1, int(j[last]) + 1)
        if left is not None and right is not None and left <= right[0]:
            head = k + left if begin else 0
            parts = lambda x, y, z: np.concatenate([x[:head], y[left : right[0]], z[right[1] :]])  # noqa: B023, E731
            return Piece(a.text + b.text, parts(a.ids, w.ids, b.ids), parts(a.starts, starts, b.starts + n), parts(a.ends, ends, b.ends + n))
        width *= 2


def concatenate(tok, pieces: list[Piece]) -> Piece:
    """Join neighbours, level by level."""
    while len(pieces) > 1:
        pieces = [join(tok, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


_KINDS = {"ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, want: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and what ``want`` names of ids, decoded and their SHA-256 digests.

    Encodes whole texts without added special tokens, truncation or padding; the strings of special tokens in a text
    become those tokens.  Decoding keeps special tokens.  A null text counts as empty and has no tokens; rows that
    repeat are encoded each; columns other than the two named are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, n_tokens bigint" + "".join(f", {c} {_KINDS[c]}" for c in want)

    def short(batch, encoder):
        return {"doc_id": batch.column(0)} | encoder.columns(batch.column(1).to_pylist(), want)

    done = map_arrow(rows.where(F.length("text") <= piece), short, schema, lambda: Encoder(path))

    def cut(batch):
        tags, ids, numbers, texts = [], [], [], []
        for tag, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for i, part in enumerate(halves(text, piece)):
                tags.append(tag), ids.append(doc), numbers.append(i), texts.append(part)
        return {"tag": tags, "doc_id": ids, "number": numbers, "text": texts}

    def each(batches):
        tok = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 8):  # few at a time: a token's ids and places are Python objects for a while
                part = batch.slice(i, 8)
                places = []
                for text in part.column(3).to_pylist():
                    places.append(encode_piece(tok, text))
                gaps, lengths = zip(*(p.steps() for p in places), strict=True)
                lists = [pa.array(x, pa.list_(pa.int32())) for x in ([p.ids for p in places], gaps, lengths)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "ids", "gaps", "lengths"])

    long = rows.where(F.length("text") > piece).select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text")
    pieces = map_arrow(long, cut, f"tag bigint, doc_id {kind}, number int, text string").repartition("tag", "number")
    encoded = pieces.mapInArrow(each, f"tag bigint, doc_id {kind}, number int, text string, ids array<int>, gaps array<int>, lengths array<int>")
    held: dict = {}

    def merge(group):
        if path not in held:
            held[path] = Encoder(path)
        encoder = held[path]
        group = group.sort_values("number")
        parts = [Piece.of_steps(*x) for x in zip(group["text"], group["ids"], group["gaps"], group["lengths"], strict=True)]
        whole = concatenate(encoder.tok, parts)
        table = pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].tolist()} | encoder.columns_of_ids(whole.ids.tolist(), want))
        return table[["doc_id", "n_tokens", *want]]

    joined = encoded.groupBy("tag").applyInPandas(merge, schema)
    return done.unionByName(joined)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text that each row's ids stand for; null ids give null."""
    names = "decoded"

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            texts = [None if i is None else encoder.decode(i) for i in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield batch.append_column(names, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", {names} string")

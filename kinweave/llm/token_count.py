"""Token counts by prefix dynamic programming.

A BPE encoding of a prefix ends in the one token that is a suffix of the prefix and fits the last token of what is left
of it, where two tokens fit if BPE encodes their joined symbols as just these two.  So a table over prefixes that holds
the last token and the count gives the exact count of every prefix from shorter ones, without encoding anything again.
The table is shared by words with a common beginning.  Words end in an end-of-word symbol: the last token of a whole
word is looked up among the tokens that carry it, against the table of its prefixes.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import KEPT, SPLIT, WORDS, _is_latin, as_symbols, begins, load, units
from .common import map_arrow

END = "</w>"
#: Entries a task keeps of prefixes, pairs and words; tables are emptied when they are full.
PREFIXES, PAIRS, WORDS_KEPT = 300_000, 400_000, 250_000
#: Longest word whose prefixes are shared through the table.
SHARED = 40


@dataclass
class Counted:
    """A text's prefix table: where its units begin and end, and the exact count of each prefix that ends with a unit."""

    starts: list[int]
    ends: list[int]
    tokens: list[int]

    def before(self, n: int) -> tuple[int, int]:
        """Units that end at or before place ``n``, and their tokens."""
        k = bisect_right(self.ends, n)
        return k, self.tokens[k - 1] if k else 0


class PrefixCounter:
    """Exact token counts of words, texts and their prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tok = load(path)
        self.special = sorted((str(t.content) for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.plain = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END)}
        self.name = {i: t for t, i in vocab.items()}
        self.longest = max(map(len, self.final))
        self.longest = max(self.longest, *map(len, self.plain))
        self.order = (*range(6, 0, -1), *range(7, self.longest + 1))
        self.alone: dict[int, bool] = {}
        self.fit: dict[int, bool] = {}
        self.prefix: dict[str, tuple[int, int]] = {}
        self.known: dict[str, int] = {}

    # tokens

    def _symbols(self, token: int) -> list[int]:
        name = self.name[token]
        if name.endswith(END):
            name = name[: -len(END)]
            return [self.plain[c] for c in name[:-1]] + [self.final[name[-1]]]
        return [self.plain[c] for c in name]

    def _merged(self, symbols: list[int]) -> list[int]:
        """Plain BPE of a few symbols."""
        while len(symbols) > 1:
            best = min(((self.merges.get(p, (1 << 30, -1)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))), key=lambda x: (x[0][0], x[1]))
            (rank, new), i = best
            if rank == 1 << 30:
                break
            symbols = [*symbols[:i], new, *symbols[i + 2 :]]
        return symbols

    def _alone(self, token: int) -> bool:
        if (got := self.alone.get(token)) is None:
            got = self.alone[token] = self._merged(self._symbols(token)) == [token]
        return got

    def fits(self, a: int, b: int) -> bool:
        if (got := self.fit.get(a << 20 | b)) is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            got = self.fit[a << 20 | b] = self._merged(self._symbols(a) + self._symbols(b)) == [a, b]
        return got

    # words (already as byte symbols)

    def _state(self, prefix: str) -> tuple[int, int]:
        """Last token and count of an unfinished word, from the states of shorter prefixes that it needs."""
        if (got := self.prefix.get(prefix)) is None:
            got = self.prefix[prefix] = self._step(prefix, self.plain)
        return got

    def _step(self, word: str, table: dict[str, int]) -> tuple[int, int]:
        """As _state, with the last token from ``table``."""
        size, fit = len(word), self.fit
        # only one token fits, so the order is free: common lengths first
        for n in self.order:
            if n > size or (token := table.get(word[size - n :])) is None:
                continue
            if n == size:
                if self._alone(token):
                    return token, 1
                continue
            last, count = self._state(word[: size - n])
            if (ok := fit.get(last << 20 | token)) is None:
                ok = self.fits(last, token)
            if ok:
                return token, count + 1
        raise ValueError("a vocabulary without some byte")

    def _table(self, word: str, table: dict[str, int], stops: range, last: list[int], count: list[int]) -> list[tuple[int, int]]:
        """The state of each word[:stop], from those of shorter prefixes in ``last`` and ``count``, which grow along."""
        found = []
        for stop in stops:
            for n in range(min(stop, self.longest), 0, -1):
                token = table.get(word[stop - n : stop])
                if token is not None and (self._alone(token) if n == stop else self.fits(last[stop - n], token)):
                    found.append((token, count[stop - n] + 1))
                    break
            if table is self.plain:
                last.append(found[-1][0])
                count.append(found[-1][1])
        return found

    def word(self, word: str) -> int:
        """The count of a whole word, from its prefixes."""
        if len(word) <= SHARED:
            if len(self.prefix) > PREFIXES:
                self.prefix.clear()
            return self._step(word, self.final)[1]
        last, count = [-1], [0]
        self._table(word, self.plain, range(1, len(word)), last, count)
        return self._table(word, self.final, range(len(word), len(word) + 1), last, count)[0][1]

    def prefixes(self, word: str) -> list[int]:
        """The count of every prefix of a word as a text of its own, the empty one first."""
        last, count = [-1], [0]
        self._table(word, self.plain, range(1, len(word)), last, count)
        return [0, *(n for _, n in self._table(word, self.final, range(1, len(word) + 1), last, count))]

    # texts

    def unit(self, unit: str) -> int:
        """The count of a part of a text without white space."""
        if (got := self.known.get(unit)) is not None:
            return got
        if "<|" in unit and self.cut_at:
            parts = self.cut_at.split(unit)
            got = len(parts) // 2 + sum(self._plain(p) for p in parts[::2] if p)
        else:
            got = self._plain(unit)
        self._keep(unit, got)
        return got

    def _keep(self, part: str, count: int) -> None:
        if len(part) <= KEPT:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[part] = count

    def _normal(self, text: str) -> str:
        return text.lower() if text.isascii() or _is_latin(text) else self.tok.normalizer.normalize_str(text)

    def _plain(self, unit: str) -> int:
        unit = self._normal(unit)
        return sum(self._word(w, len(w) < len(unit)) for w in WORDS.findall(unit))

    def _word(self, w: str, keep: bool) -> int:
        if (n := self.known.get(w)) is None:
            n = self.word(w if w.isascii() and w.isalpha() else as_symbols(w))
            if keep:
                self._keep(w, n)
        return n

    def counts(self, text: str) -> list[int]:
        """The count of each unit of a text."""
        known = self.known
        return [known[u] if u in known else self.unit(u) for u in units(text)]

    def counted(self, text: str) -> Counted:
        """The prefix table of a text."""
        starts, ends, at = [], [], 0
        for gap in SPLIT.finditer(text):
            if gap.start() > at:
                starts.append(at), ends.append(gap.start())
            at = gap.end()
        if at < len(text):
            starts.append(at), ends.append(len(text))
        return Counted(starts, ends, list(accumulate(self.unit(text[a:b]) for a, b in zip(starts, ends, strict=True))))

    def at(self, text: str, n: int, table: Counted | None = None) -> int:
        """The exact count of the prefix of ``n`` characters: looked up for whole units, and of the unit that it cuts."""
        table = table or self.counted(text)
        k, tokens = table.before(n)
        return tokens + (self.unit(text[table.starts[k] : n]) if k < len(table.starts) and table.starts[k] < n else 0)

    def cut(self, text: str, limit: int, table: Counted | None = None) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens that parts no special token and no marks from their base."""
        table = table or self.counted(text)
        k = bisect_right(table.tokens, limit)
        if k == len(table.tokens):
            return len(text)
        at, left = table.starts[k], limit - (table.tokens[k - 1] if k else 0)
        unit = text[at : table.ends[k]]
        for i, part in enumerate(self.cut_special(unit)):
            n = i % 2 or (self._plain(part) if part else 0)
            if n > left:
                return at + (0 if i % 2 else self._cut_plain(part, left))
            at, left = at + len(part), left - n
        raise AssertionError("a unit that fits after all")

    def cut_special(self, unit: str) -> list[str]:
        """Text and special tokens in turn."""
        return self.cut_at.split(unit) if self.cut_at and "<|" in unit else [unit]

    def _cut_plain(self, part: str, left: int) -> int:
        """Characters of the longest prefix of a part, which has more tokens, with at most ``left``: from the prefixes of one word."""
        places = [k for k in range(1, len(part)) if begins(part[k])] + [len(part)]
        chunks = [self._normal(part[a:b]) for a, b in zip([0, *places], places, strict=False)]
        stops = list(accumulate(map(len, chunks)))  # of each place, in the normalised part
        whole, best, total = "".join(chunks), 0, 0
        for m in WORDS.finditer(whole):
            w = m.group()
            n = self._word(w, False)
            if total + n <= left:
                total += n
                continue
            if len(w) > 1 and w[0] == "'" and w[1].isalpha():  # its beginnings are words of their own
                counts = [sum(self._word(x, False) for x in WORDS.findall(w[:c])) for c in range(len(w) + 1)]
            else:
                every, at = self.prefixes(as_symbols(w)), [0, *accumulate(len(c.encode()) for c in w)]
                counts = [every[b] for b in at]
            for k, stop in zip(places, stops, strict=True):
                if stop <= m.start() or stop <= m.end() and total + counts[stop - m.start()] <= left:
                    best = k
            return best
        return len(part)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, cut_chars.

    Counts are those of the tokenizers library without added special tokens, truncation or padding; strings of special
    tokens in a text count as one token.  ``cut_chars`` is the length of the longest prefix with at most ``limit`` tokens
    that parts no special token and no combining marks from their base.  A null text counts as empty: 0 bytes and tokens.  Rows that
    repeat are counted each; columns other than the two named are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))

    def run(batch, counter):
        totals, cuts = [], []
        for t in batch.column(1).to_pylist():
            total = sum(counter.counts(t))
            totals.append(total)
            cuts.append(len(t) if total <= limit else counter.cut(t, limit))
        return {"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(totals, pa.int64()), "over_limit": [n > limit for n in totals], "cut_chars": pa.array(cuts, pa.int64())}

    return map_arrow(rows, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint", lambda: PrefixCounter(path))


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ends and tokens, the exact count of every prefix that ends with a unit.

    Units are the parts of a text between white space.  Written once, the table answers questions about budgets with
    ``tokens_upto`` and ``longest_within``, and nothing is encoded again.  Null and empty texts have empty arrays.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batch, counter):
        tables = [counter.counted(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "ends": [t.ends for t in tables], "tokens": [t.tokens for t in tables]}

    return map_arrow(rows, run, f"doc_id {kind}, ends array<int>, tokens array<int>", lambda: PrefixCounter(path))


def tokens_upto(n: Column, ends: Column | str = "ends", tokens: Column | str = "tokens") -> Column:
    """Tokens of the whole units among the first ``n`` characters, from a prefix table."""
    fits = F.size(F.filter(ends, lambda e: e <= n))
    return F.when(fits > 0, F.element_at(tokens, fits)).otherwise(0)


def longest_within(limit: Column, ends: Column | str = "ends", tokens: Column | str = "tokens") -> Column:
    """Characters of the longest prefix of whole units with at most ``limit`` tokens, from a prefix table."""
    fits = F.size(F.filter(tokens, lambda t: t <= limit))
    return F.when(fits > 0, F.element_at(ends, fits)).otherwise(0)

"""Exact token counts at every prefix of a text, by dynamic programming.

A sequence of BPE tokens is the encoding of its text just if every two
neighbours are the encoding of theirs.  So the encoding of a prefix is fixed by
its last token: of the tokens that end there, the one that may follow the last
token of the prefix before it.  One pass from left to right stores, for every
prefix, its last token and its count, which is the count before that token plus one.
With word-end tokens a prefix has two entries: as an inner part of a word, and
as a word that ends here (the text truncated at this place).

A text's counts are a running sum over its words plus the counts within a word;
words repeat, so a worker keeps them in a bounded dictionary.  `Prefixes` then
answers "how many tokens has text[:i]" and "how much of the text fits into b
tokens" without encoding again.

Edge cases: null counts as empty (0 tokens); a special token's string within a
text counts one, as the library's default has it; texts of any length are read
whole; rows are independent, so repeated rows and other columns don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import table


class PrefixCounter:
    """Counts of one tokenizers-JSON BPE file with word ends, NFC and lower case."""

    def __init__(self, path: str, max_entries: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.end = model["end_of_word_suffix"]
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.word = regex.compile(split["pattern"]["Regex"])
        of_byte = {b: c for c, b in byte_alphabet().items()}
        self.to_symbols = {b: of_byte[b] for b in range(256)}
        #: pair of symbols -> (rank, merged)
        self.merges = {(a, b): (r, a + b) for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        self.tokens = set(model["vocab"]) - set(self.added)
        self.longest = max(map(len, self.tokens))
        #: letters -> nodes; 0: the inner token that ends at a node, 1: the token that ends a word there
        self.trie: dict = {}
        for t in self.tokens:
            node = self.trie
            for letter in t.removesuffix(self.end):
                node = node.setdefault(letter, {})
            node[1 if t.endswith(self.end) else 0] = t
        self.follow: dict[str, dict[str, bool]] = {}  # token -> token -> may it follow; "": may it stand first
        self.n_follow = 0
        self.words: dict[str, int] = {}
        self.max_entries = max_entries

    def _merge(self, symbols: list[str]) -> list[str]:
        """Encoding by repeated merges of the leftmost pair of least rank."""
        while len(symbols) > 1:
            ranked = [self.merges.get(p, (1 << 60,))[0] for p in zip(symbols, symbols[1:])]
            least = min(ranked)
            if least == 1 << 60:
                break
            out, i = [], 0
            while i < len(symbols):
                if i < len(ranked) and ranked[i] == least:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _letters(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _follows(self, a: str, b: str) -> bool:
        """True if a, b is the encoding of their letters (a empty: b alone)."""
        if self.n_follow > 400_000:
            self.follow.clear()
            self.n_follow = 0
        self.n_follow += 1
        known = self._merge(self._letters(a) + self._letters(b) if a else self._letters(b)) == ([a, b] if a else [b])
        self.follow.setdefault(a, {})[b] = known
        return known

    def word_table(self, symbols: str) -> tuple[list[str], list[int], int]:
        """For each prefix of a word's byte symbols its last inner token and count, and the count of the whole word."""
        n = len(symbols)
        last: list = [None] * (n + 1)
        last[0], inner, whole = "", [0] * (n + 1), 0
        for j in range(n):
            a, count, node, i = last[j], inner[j] + 1, self.trie, j
            known = self.follow.get(a, {})
            while i < n:
                node = node.get(symbols[i])
                if node is None:
                    break
                i += 1
                if last[i] is None and 0 in node:
                    t = node[0]
                    may = known.get(t)
                    if self._follows(a, t) if may is None else may:
                        last[i], inner[i] = t, count
                if i == n and not whole and 1 in node:
                    t = node[1]
                    may = known.get(t)
                    if self._follows(a, t) if may is None else may:
                        whole = count
        return last, inner, whole

    def word_counts(self, symbols: str) -> list[int]:
        """counts[i]: tokens of the word's first i byte symbols, taken as a word that ends there."""
        last, inner, whole = self.word_table(symbols)
        out = [0] * len(symbols) + [whole]
        for i in range(1, len(symbols)):
            for j in range(max(0, i - self.longest), i):
                t = symbols[j:i] + self.end
                if t in self.tokens and self._follow(last[j], t):
                    out[i] = inner[j] + 1
                    break
        return out

    def _follow(self, a: str, b: str) -> bool:
        known = self.follow.get(a, {}).get(b)
        return self._follows(a, b) if known is None else known

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable():  # these bytes stand for themselves
            return word
        of = self.to_symbols
        return "".join([of[b] for b in word.encode()])

    def _count(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.word_table(self.symbols(word))[2]
            if len(self.words) < self.max_entries:
                self.words[word] = found
        return found

    def normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # sigma is lowered alike everywhere

    def parts(self, text: str | None) -> Iterator[str]:
        """Stretches without a special token's string, each but the last followed by one."""
        text = text or ""
        if self.special is None or not any(a in text for a in self.added):
            return iter([text])
        return iter(self.special.split(text))

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return self.counted(text)[0]

    def counted(self, text: str | None) -> tuple[int, int]:
        """(tokens, characters of the normalised form) of the whole text."""
        total, size, known = -1, 0, self.words.get
        for part in self.parts(text):
            total += 1
            part = self.normalised(part)
            size += len(part)
            for w in self.word.findall(part):
                total += known(w) or self._count(w)
        if total:  # the special strings between the parts stay as they are
            size += sum(map(len, self.special.findall(text))) if self.special is not None and any(a in text for a in self.added) else 0
        return total, size

    def prefixes(self, text: str | None) -> Prefixes:
        """The stored counts of a text, by the characters of its normalised form (special strings stay as they are)."""
        return Prefixes(self, text)


class Prefixes:
    """Counts at every prefix of one text, whose normalised form is `text`."""

    def __init__(self, counter: PrefixCounter, text: str | None):
        self.counter = counter
        parts = [counter.normalised(p) for p in counter.parts(text)]
        marks = counter.special.findall(text) if len(parts) > 1 else []
        self.start, self.end, tokens = [], [], []  # of words, and of special strings as words of one token
        self.marks: set[int] = set()  # which of them are special
        self.text, at = "", 0
        pieces = []
        for k, part in enumerate(parts):
            for m in counter.word.finditer(part):
                self.start.append(at + m.start())
                self.end.append(at + m.end())
                tokens.append(counter._count(m[0]))
            pieces.append(part)
            at += len(part)
            if k < len(marks):
                self.marks.add(len(self.start))
                self.start.append(at)
                self.end.append(at + len(marks[k]))
                tokens.append(1)
                pieces.append(marks[k])
                at += len(marks[k])
        self.text = "".join(pieces)
        self.before = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)]).tolist()
        self.within: dict[str, list[int]] = {}

    def count_at(self, i: int) -> int:
        """Tokens of text[:i]."""
        k = bisect_right(self.end, i)
        total = self.before[k]
        if k < len(self.start) and self.start[k] < i:
            if k in self.marks:
                return self._cut_mark(k, i)
            word, cut = self.text[self.start[k] : self.end[k]], self.text[self.start[k] : i]
            if "'" in cut:  # a contraction cut short is other words than its beginning
                return total + sum(map(self.counter._count, self.counter.word.findall(cut)))
            if word not in self.within:
                self.within[word] = self.counter.word_counts(self.counter.symbols(word))
            total += self.within[word][len(cut.encode())]
        return total

    def _cut_mark(self, k: int, i: int) -> int:
        """A special string cut short is plain text, and may go on a word before it; words end at white space."""
        first = k
        while first and self.end[first - 1] == self.start[first] and first - 1 not in self.marks:
            first -= 1
        plain = self.text[self.start[first] : i]
        return self.before[first] + sum(map(self.counter._count, self.counter.word.findall(self.counter.normalised(plain))))

    def counts(self) -> list[int]:
        """Tokens of text[:i] for every i from 0 to its length."""
        return [self.count_at(i) for i in range(len(self.text) + 1)]

    def fits(self, budget: int) -> int:
        """Characters of the longest prefix with at most budget tokens.

        Whole words come first, from their running sum; only the word that no longer fits is looked into.
        """
        k = bisect_right(self.before, budget) - 1
        if k == len(self.end):
            return len(self.text)
        i = self.end[k]
        while i > self.start[k] and self.count_at(i) > budget:
            i -= 1
        return i


_LOADED: dict[str, PrefixCounter] = {}


def loaded(path: str) -> PrefixCounter:
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, fits, over_limit) of every row.  No shuffle; lengths are taken in the JVM.

    fits: characters of the normalised text in its longest prefix of at most limit tokens, where it
    may be truncated; the prefix table of a text tells, without encoding it again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for b in batches:
            n, fits = [], []
            for t in b.column(1):
                text = t.as_py()
                tokens, size = counter.counted(text)
                n.append(tokens)
                fits.append(size if tokens <= limit else counter.prefixes(text).fits(limit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fits, pa.int64())], [id_col, "n_bytes", "n_tokens", "fits"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, fits long").withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, path: str, budgets: tuple[int, ...] = (512, 1024, 2048), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts array<int>, fits array<int>): counts at every prefix of the normalised text, and the characters that fit each budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for b in batches:
            for i, t in enumerate(b.column(1)):  # a row at a time: counts are as long as the text
                p = counter.prefixes(t.as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([p.counts()], pa.list_(pa.int32())), pa.array([[p.fits(x) for x in budgets]], pa.list_(pa.int32()))], [id_col, "counts", "fits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, counts array<int>, fits array<int>")


def op3_prefix_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the 49k word vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

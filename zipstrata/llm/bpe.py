"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged, so where
it stands is a certain cut: the fragments on either side are encoded on their
own and their ids concatenated.  The constructor derives the table of forced pairs from
every token.  Cuts are taken on two levels.

First the *text* is cut before white space that follows another character.  For a byte-level
vocabulary the pairs (x, white space) with x not white space are forced, which the
constructor checks.  (The one exception it admits is byte A0 before a space,
which no-break spaces bring into a few tokens.)  The pre-tokenising pattern has a boundary
there as well, whatever stands on either side, so cutting the text changes neither step, in the
exception too.

Then each fragment is split into pre-tokens, and these are cut at every forced pair of
their bytes: within numbers, punctuation and the letters of most scripts, so what is left are short pieces that
recur; they are merged by the vocabulary's ranks.  Runs of Latin letters, which have few forced pairs,
are merged whole if they weren't seen before, in one library call for many, strung together with white space,
which is again a forced boundary.

Fragments follow a Zipf law, so each worker keeps a bounded dictionary from
fragment to its ids (as little-endian uint32 bytes): encoding a text is one
``findall``, one dictionary lookup per fragment and one ``join``.  Pre-tokens and pieces have others.

Edge cases: null text encodes as the empty text (no ids); empty text has no ids;
strings of added (special) tokens inside a text become their id, as the
library's default does; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Code points with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
#: Fixed value: the pre-tokenising pattern of the byte-level vocabulary family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte in byte-level vocabulary files."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class ForcedBoundaryBPE:
    """encode() and decode() of one byte-level vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str, max_entries: int = 60_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.added.values()]))
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = token.encode() if token in self.added else bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.forced = self._forced_pairs([b for b in self.token_bytes if b])
        self._check_cuts()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        by_rank = {self.token_bytes[i]: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.merger = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=by_rank, special_tokens={}) if self._ranks_are_ids(spec, by_rank, alphabet) else None
        self.rank = by_rank
        self.pre_token = regex.compile(PRE_TOKEN)
        self.words: dict[str, bytes] = {}  # of pre-tokens
        self.alphabet = alphabet
        self.forced_at = self.forced.tobytes()  # by the pair as one number
        self.heads: dict[str, bytes] = {}  # of fragments with no space, or an odd one, before them
        self.pieces: dict[bytes, bytes] = {}
        # Between a space after and a character before that are both not white space, a text is cut by str.split;
        # texts with other white space beside a space take the pattern.
        self.odd_space = re.compile(f" (?:[{WHITE_SPACE}]|$|(?<=[{WHITE_SPACE}] )|(?<=^ ))")  # begins with a letter, which is sought faster than a class
        self.cut = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.token_length = np.array([len(b) for b in self.token_bytes])
        self.fragments: dict[str, bytes] = {}  # of " " + fragment
        self.max_entries = max_entries

    @staticmethod
    def _forced_pairs(tokens: list[bytes]) -> np.ndarray:
        """forced[a, b]: no token has byte a directly before byte b."""
        inside = np.zeros((256, 256), bool)
        for t in tokens:
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                inside[a[:-1], a[1:]] = True
        return ~inside

    def _check_cuts(self) -> None:
        """Cuts stand before white space that follows another character; no token may span such a place."""
        white = [*range(9, 14), 32]
        other = [b for b in range(256) if b not in white and b != 0xA0]
        if not self.forced[np.ix_(other, white)].all():
            raise ValueError(f"{self.path}: a token holds white space after another byte; these cuts aren't certain")

    @staticmethod
    def _ranks_are_ids(spec: dict, by_rank: dict[bytes, int], alphabet: dict[str, int]) -> bool:
        """True if merges are listed in the order of the ids they make, so ids serve as merge ranks."""
        last = -1
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            i = by_rank.get(bytes(alphabet[c] for c in a + b), -1)
            if i <= last:
                return False
            last = i
        return True

    def pre_tokens(self, fragment: str) -> list[bytes]:
        """The pattern's matches, in UTF-8.  Letters of other scripts, whose tables may differ between libraries, are told by the file's own."""
        if fragment.isascii() or max(fragment) < "\u0250":
            return [t.encode() for t in self.pre_token.findall(fragment)]
        of = self.alphabet
        return [bytes([of[c] for c in t]) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(fragment)]

    def cut_forced(self, pre_token: bytes) -> list[bytes]:
        """A pre-token's pieces between its forced pairs."""
        forced, out, at = self.forced_at, [], 0
        for i in range(1, len(pre_token)):
            if forced[pre_token[i - 1] << 8 | pre_token[i]]:
                out.append(pre_token[at:i])
                at = i
        out.append(pre_token[at:])
        return out

    def _merged(self, piece: bytes) -> bytes:
        """Ids of a piece, by merging the neighbours of least rank until none are left."""
        found = self.pieces.get(piece)
        if found is None:
            rank, parts = self.rank, [piece[i : i + 1] for i in range(len(piece))]
            if piece in rank and len(piece) <= 2:
                parts = [piece]
            while len(parts) > 1:
                ranked = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
                least = min(ranked)
                if least == 1 << 60:
                    break
                i = ranked.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = b"".join([rank[x].to_bytes(4, "little") for x in parts])
            if len(self.pieces) >= self.max_entries:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def _new(self, fragments: list[str]) -> list[bytes]:
        """Ids of fragments that aren't in a dictionary; all begin with a space, or there is one only."""
        if self.merger is None:
            return [np.array(self.library.encode(f, add_special_tokens=False).ids, "<u4").tobytes() for f in fragments]
        joined = "".join(fragments)
        if not joined.isascii() and max(joined) >= "\u0250":
            own = [f.isascii() or max(f) < "\u0250" for f in fragments]
            latin = iter(self._new([f for f, x in zip(fragments, own) if x]) if any(own) else ())
            return [next(latin) if x else b"".join([self._merged(p) for t in self.pre_tokens(f) for p in self.cut_forced(t)]) for f, x in zip(fragments, own)]
        out: dict[str, bytes] = {}
        self._strung([f for f in fragments if f.isalpha() or f[0] == " " and f[1:].isalpha()], out)
        rest = [f for f in fragments if f not in out]
        if rest:
            out.update(zip(rest, self._of_pre_tokens(rest)))
        return [out[f] for f in fragments]

    def _of_pre_tokens(self, fragments: list[str]) -> list[bytes]:
        """Ids of Latin fragments by their pre-tokens, which recur more than fragments do."""
        tokens = self.pre_token.findall("".join(fragments))
        found = list(map(self.words.get, tokens))
        if None in found:
            missing = list({t for t, x in zip(tokens, found) if x is None})
            new: dict[str, bytes] = {}
            self._strung([t for t in missing if t.isalpha() or t[0] == " " and t[1:].isalpha()], new)
            for t in missing:
                if t not in new:
                    new[t] = b"".join(map(self._merged, self.cut_forced(t.encode())))
            found = [new[t] if x is None else x for t, x in zip(tokens, found)]
            if len(self.words) + len(new) > self.max_entries:
                self.words.clear()
            self.words |= new
        if len(fragments) == 1:
            return [b"".join(found)]
        ends = (np.searchsorted(np.cumsum(list(map(len, tokens))), np.cumsum(list(map(len, fragments)))) + 1).tolist()
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]

    def _strung(self, runs: list[str], out: dict[str, bytes]) -> None:
        """Ids of runs of letters, by one call; the lengths of the tokens' bytes tell where each one's ids end."""
        if not runs:
            return
        joined = "".join([w if w[0] == " " else "\n" + w for w in runs])
        ids = np.array(self.merger.encode_ordinary(joined), "<u4")
        lengths = [len(w) + (w[0] != " ") if w.isascii() else len(w.encode()) + (w[0] != " ") for w in runs]
        ends = (np.searchsorted(np.cumsum(self.token_length[ids]), np.cumsum(lengths)) * 4 + 4).tolist()
        raw = ids.tobytes()
        for w, a, b in zip(runs, [0, *ends], ends):
            out[w] = raw[a:b] if w[0] == " " else raw[a + 4 : b]

    def _alone(self, fragment: str) -> bytes:
        """Ids of a fragment by itself."""
        found = self.heads.get(fragment)
        if found is None:
            (found,) = self._new([fragment]) if fragment else (b"",)
            if len(self.heads) >= self.max_entries:
                self.heads.clear()
            self.heads[fragment] = found
        return found

    def _spaced(self, fragments: list[str]) -> dict[str, bytes]:
        """Ids of " " + fragment for each."""
        joined = " ".join(fragments)
        if self.merger is None or not joined.isascii() and max(joined) >= "\u0250":
            return dict(zip(fragments, self._new([" " + f for f in fragments])))
        out: dict[str, bytes] = {}
        runs = [f for f in fragments if f.isalpha()]
        if runs:
            strung = " " + " ".join(runs)
            ids = np.array(self.merger.encode_ordinary(strung), "<u4")
            lengths = [len(f) + 1 for f in runs] if strung.isascii() else [len(f) + 1 if f.isascii() else len(f.encode()) + 1 for f in runs]
            ends = (np.searchsorted(np.cumsum(self.token_length[ids]), np.cumsum(lengths)) * 4 + 4).tolist()
            raw = ids.tobytes()
            out.update(zip(runs, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        rest = [f for f in fragments if f not in out]
        if rest:
            out.update(zip(rest, self._of_pre_tokens([" " + f for f in rest])))
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian uint32 bytes, about a million characters at a time."""
        todo, size = [], 0
        for t in texts:
            todo.append(t or "")
            size += len(todo[-1])
            if size > 1_000_000:
                yield from self._encode_some(todo)
                todo, size = [], 0
        yield from self._encode_some(todo)

    def _encode_some(self, texts: list[str]) -> Iterator[bytes]:
        pieces: list[str] = []  # fragments of all texts
        spans = []  # of each text: (its part before pieces[a:b] already encoded, a, b) in turn
        for t in texts:
            own = []
            for part in [t] if self.special is None or not any(s in t for s in self.added) else self.special.split(t):
                if part in self.added:
                    own.append((np.uint32(self.added[part]).tobytes(), 0, 0))
                elif self.odd_space.search(part) is None:
                    first, *rest = part.split(" ")
                    pieces += rest
                    own.append((self._alone(first), len(pieces) - len(rest), len(pieces)))
                else:
                    for f in self.cut.findall(part):
                        if f[0] == " " and len(f) > 1 and f[1] not in _WHITE and f[-1] not in _WHITE:
                            pieces.append(f[1:])
                            own.append((b"", len(pieces) - 1, len(pieces)))
                        else:
                            own.append((self._alone(f), 0, 0))
            spans.append(own)
        found = list(map(self.fragments.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self._spaced(list({pieces[i] for i in missing}))
            for i in missing:
                found[i] = new[pieces[i]]
            if len(self.fragments) + len(new) <= self.max_entries:
                self.fragments |= new
            elif 2 * len(missing) > len(pieces):  # other words than before: begin anew
                self.fragments.clear()
        for own in spans:
            yield b"".join([head + b"".join(found[a:b]) for head, a, b in own])

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes."""
        return next(self._encode_some([text or ""]))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null text has an empty array.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for x in bpe.encode_many(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids array<int>); special tokens are kept.  A null array gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass and return digests of both, for audits.

    ids_sha256 is over the decimal ids joined by commas; decoded_sha256 over the
    decoded text in UTF-8.  Null and empty texts have 0 tokens and the digest of
    nothing.  Rows stay where they are: no shuffle, memory of one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for raw in bpe.encode_many(b.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                of_ids.append(sha(",".join(map(str, ids)).encode()).hexdigest())
                of_text.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_forced_boundary_bpe(spark, sf_dir: str) -> DataFrame:
    """Round-trip digests of all documents with the 50k byte-level vocabulary."""
    import public_tokenizers

    from .common import table

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

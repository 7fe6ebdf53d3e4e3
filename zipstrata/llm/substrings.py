"""Removal of repeated passages: Rabin-Karp hashes of every window of `width` words.

Each task turns its texts into word hashes and rolls a polynomial hash over all
windows, whole chunks at a time in NumPy.  Equal windows must meet: a window is
sent to the bucket of its least hash of `gram` consecutive words, which equal windows share and
neighbouring windows mostly share too, so a run of some seven windows travels as
one entry with the 64 bits of each window's own hash.  Buckets are counted in Spark's
groupBy; of equal windows all but the first by (id, start) are marked, marked
windows merge into maximal intervals, and the intervals go back to the texts.

Skew: windows repeated within a chunk are marked on the spot and only the first
is sent, so a passage that everybody holds is sent once a chunk.  Grams that
bring together too many *different* windows (a common line within many contexts)
are found by a counting pass over all texts; their windows go by their own hash
instead.  hot_grams() says what bounds that table and the windows of a gram that isn't in it.

Two different windows are taken for equal only if all 64 bits of their hashes agree: of n windows,
about n * n / 2**65 pairs (0.02 at 10**9 words, 30 at 3 * 10**10).

Edge cases: null, empty and short texts have no window and lose nothing; texts of
any length are read whole; a document is told by its id and, where rows share one, by the hash of its
text: rows with one id and different texts stand in the order of that hash, and rows alike in
both are one document (each loses the same); a null id stands before all others;
an empty table gives an empty result; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, table, unused

_U = np.uint64
_BYTE, _WORD = _U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NULL_ID = np.iinfo(np.int64).min
_CHUNK = 1_500_000  # bytes of text handled at once; a longer text is a chunk of its own
_COUNTED = 1 << 23  # windows that a task counts before it hands its counts on
_BUCKET = 4 << 20  # bytes of text whose windows meet in one bucket, on average


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that order and buckets don't follow the polynomial."""
    h = (h ^ h >> _U(31)) * _U(0x7FB5D329728EA185)
    h = (h ^ h >> _U(27)) * _U(0x81DADEF4BC2DD44D)
    return h ^ h >> _U(33)


class _Powers:
    """base**i and base**-i modulo 2**64, kept for all chunks of a worker."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = int(base), np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.base, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers: dict[int, _Powers] = {}


def rolling(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Rabin-Karp: sum of values[start + j] * base**j for each span, from one prefix sum modulo 2**64."""
    up, down = _powers.setdefault(int(base), _Powers(base)).get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return (prefix[end] - prefix[start]) * down[start]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of UTF-8 bytes; words are split at ASCII white space."""
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def _sliding_least(h: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` consecutive values."""
    reach = 1
    while 2 * reach <= size:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Chunk:
    """Documents of about _CHUNK bytes, by (id, tie); number: of each text that of its document."""

    def __init__(self, ids: list[int], ties: list[int], texts: list[bytes]):
        i, t = np.array(ids, np.int64), np.array(ties, np.int64)
        order = np.lexsort((t, i))
        i, t = i[order], t[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
        self.ids, self.ties, self.number, self.texts = i[new], t[new], np.cumsum(new) - 1, [texts[k] for k in order]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of rows (id, tie, text)."""
    ids, ties, texts, size = [], [], [], 0
    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            t = (t.as_py() or "").encode()
            ids.append(i)
            ties.append(h)
            texts.append(t)
            size += len(t)
            if size > _CHUNK:
                yield Chunk(ids, ties, texts)
                ids, ties, texts, size = [], [], [], 0
    if ids:
        yield Chunk(ids, ties, texts)


def windows(number: np.ndarray, texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every window in the order of the texts: its text's number, start in its text, own hash, least gram's hash."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    begin, end = word_spans(raw)
    if len(begin) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    word = _mix(rolling(raw.astype(_U) + _U(1), begin, end, _BYTE) + (end - begin).astype(_U))
    lengths = np.array([len(t) for t in texts])
    text_at = np.cumsum(lengths + 1) - lengths - 1
    doc = np.searchsorted(text_at, begin, "right") - 1
    first_word = np.searchsorted(begin, text_at)
    at = np.arange(len(word))
    starts = at[: len(word) - width + 1]
    own = _mix(rolling(word, starts, starts + width, _WORD))
    starts_of_grams = at[: len(word) - gram + 1]
    least = _sliding_least(_mix(rolling(word, starts_of_grams, starts_of_grams + gram, _WORD)), width - gram + 1)
    whole = np.flatnonzero(doc[starts] == doc[starts + width - 1])
    return number[doc[whole]], whole - first_word[doc[whole]], own[whole], least[whole]


def _later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where the same key stands earlier; rows come in the order of (doc, start)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
    later = np.zeros(len(key), bool)
    later[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return later


def _intervals(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive starts as (doc, first, last)."""
    if not len(doc):
        return doc, start, start
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], start[tail]


def _runs(doc, start, least):
    """Where runs of consecutive windows of one text with the same least gram begin, and their sizes."""
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])]))
    return head, np.diff(np.append(head, len(doc)))


def document_key(id_col: str, text_col: str) -> tuple:
    """Columns that tell documents apart: the id (the least long for null) and a hash of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), F.xxhash64(text_col)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, tie = document_key(id_col, text_col)
    return docs.select(i.alias("id"), tie.alias("tie"), F.col(text_col).alias("text"))


def extent(rows: DataFrame) -> tuple[int, int]:
    """(bytes of text, partitions) of rows; one look at the texts' lengths."""
    lengths = rows.select(F.octet_length("text").alias("n"), F.spark_partition_id().alias("part"))
    size, last = lengths.agg(F.sum("n"), F.max("part")).first()
    return int(size or 0), int(last or 0) + 1


def hot_grams(rows: DataFrame, width: int, gram: int, hot_windows: int, size: int, partitions: int, most: int = 1_000_000) -> np.ndarray:
    """Grams that are the least of over `hot` different windows, where hot is hot_windows or the windows' number / most, the larger.

    rows: (id, tie, text), of `size` bytes in so many partitions.  A task counts its grams
    and hands on those with over hot / (2 * tasks) windows.  What it keeps back adds up to hot / 2 at most, so
    a gram with over hot / 2 windows handed on is taken to be hot: none with over hot windows is
    missed, however thinly it is spread, and the table has at most 2 * most entries of 8 bytes.
    """
    words = size // 2 + 1
    hot = max(hot_windows, words // most)
    least_count = hot // (2 * (partitions + words // _COUNTED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, n = (np.concatenate(x) for x in zip(*held))
            g, at = np.unique(g, return_inverse=True)
            return g, np.bincount(at, n).astype(np.int64)

        def often() -> pa.RecordBatch:
            g, n = merged()
            k = n > least_count
            return pa.RecordBatch.from_arrays([pa.array(g[k].view(np.int64)), pa.array(n[k])], ["gram", "n"])

        for c in _chunks(batches):
            _, _, own, least = windows(c.number, c.texts, width, gram)
            _, one = np.unique(own, return_index=True)
            held.append(np.unique(least[one], return_counts=True))
            seen += len(one)
            if len(held) > 16:
                held = [merged()]
            if seen > _COUNTED:
                yield often()
                held, seen = [], 0
        if held:
            yield often()

    counted = rows.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > hot // 2).select("gram").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(_U))


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places that go there) of the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))[: len(b)]
    for a, z in zip(head.tolist(), [*head[1:].tolist(), len(b)]):
        yield int(b[a]), order[a:z]


def repeated_spans(docs: DataFrame, width: int = 20, gram: int = 8, hot_windows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, first, last): starts first..last of windows whose words also stand earlier, as intervals."""
    rows = _rows(docs, id_col, text_col)
    size, partitions = extent(rows)
    hot = hot_grams(rows, width, gram, hot_windows, size, partitions)
    buckets = max(4 * shuffle_width(docs), size // _BUCKET)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, c in enumerate(_chunks(batches)):
            doc, start, own, least = windows(c.number, c.texts, width, gram)
            if not len(doc):
                continue
            out, blobs = [], []
            later = _later(own, doc, start)
            x = np.flatnonzero(later)
            if len(x):
                out.append((turn * 7919 + int(x[0])) % buckets)
                d, a, z = _intervals(doc[x], start[x])
                blobs.append(b"\1" + c.ids[d].tobytes() + c.ties[d].tobytes() + a.tobytes() + z.tobytes())
            x = np.flatnonzero(~later)
            doc, start, own, least = doc[x], start[x], own[x], least[x]
            if len(hot):
                own_way = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
                least = np.where(own_way, own, least)
            head, n_windows = _runs(doc, start, least)
            for k, some in dealt((least[head] % _U(buckets)).astype(np.int64)):
                h, n = head[some], n_windows[some]
                inside = np.repeat(h - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append(k)
                blobs.append(b"\0" + np.int64(len(h)).tobytes() + c.ids[doc[h]].tobytes() + c.ties[doc[h]].tobytes() + start[h].astype(np.int32).tobytes() + n.astype(np.int32).tobytes() + own[inside].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "runs"])

    def judge(group: pa.Table) -> pa.Table:
        done, sent = [np.zeros((4, 0), np.int64)], []
        for blob in group.column("runs"):
            raw = blob.as_py()
            if raw[0] == 1:
                done.append(np.frombuffer(raw, np.int64, offset=1).reshape(4, -1))
            else:
                m = int.from_bytes(raw[1:9], "little")
                ids, small = np.frombuffer(raw, np.int64, 2 * m, 9).reshape(2, m), np.frombuffer(raw, np.int32, 2 * m, 9 + 16 * m).reshape(2, m)
                sent.append((ids, small, np.frombuffer(raw, _U, offset=9 + 24 * m)))
        if sent:
            ids, ties = np.concatenate([s[0] for s in sent], axis=1)
            start, n = np.concatenate([s[1] for s in sent], axis=1).astype(np.int64)
            own = np.concatenate([s[2] for s in sent])
            begin = np.cumsum(n) - n
            order = np.lexsort((start, ties, ids))
            n, start, ids, ties = n[order], start[order], ids[order], ties[order]
            number = np.cumsum(np.concatenate([[False], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])]))
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = own[np.repeat(begin[order], n) + inside]
            run, start = np.repeat(np.arange(len(n)), n), np.repeat(start, n) + inside
            later = np.flatnonzero(_later(own, number[run], start))
            d, a, z = _intervals(number[run[later]], start[later])
            first_run = np.searchsorted(number, d)
            done.append(np.stack([ids[first_run], ties[first_run], a, z]))
        return pa.table(dict(zip(["id", "tie", "first", "last"], np.concatenate(done, axis=1))))

    sent = rows.mapInArrow(send, "bucket int, runs binary")
    return sent.groupBy("bucket").applyInArrow(judge, "id long, tie long, first long, last long")


def covered(spans: list | None, n: int, width: int) -> np.ndarray:
    """Mask of n words that lie in a window starting within one of the spans."""
    step = np.zeros(n + 1, np.int64)
    for s in spans or ():
        step[min(s["first"], n)] += 1
        step[min(s["last"] + width, n)] -= 1
    return np.cumsum(step[:-1]) > 0


def _with_spans(docs: DataFrame, width: int, id_col: str, text_col: str, **more) -> DataFrame:
    """docs and, last, the intervals of each row (array of first, last; null if none); one shuffle of the texts, a hot id can be split."""
    i, tie, out = (unused(docs, c) for c in ("id_key", "tie", "spans"))
    spans = repeated_spans(docs, width, id_col=id_col, text_col=text_col, **more).groupBy("id", "tie").agg(F.collect_list(F.struct("first", "last")).alias(out))
    left = docs.withColumns(dict(zip((i, tie), document_key(id_col, text_col))))
    return left.join(spans.withColumnsRenamed({"id": i, "tie": tie}), [i, tie], "left").drop(i, tie)


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs, all columns, with repeated words cut from the text.

    Texts that lose nothing stay as they are, null included; of the others the
    kept words are joined by one space (perhaps none: the empty text).
    """
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, s in enumerate(b.column(b.num_columns - 1)):
                if s.is_valid:
                    words = texts[i].encode().split()
                    gone = covered(s.as_py(), len(words), width)
                    texts[i] = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()
            columns = [pa.array(texts, pa.string()) if c == at else b.column(c) for c in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _with_spans(docs, width, id_col, text_col, **more).mapInArrow(run, schema)


def removal_digests(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, sha = [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                words = (t.as_py() or "").encode().split()
                n.append(len(words))
                if s.is_valid:
                    gone = covered(s.as_py(), len(words), width).tolist()
                    removed.append(sum(gone))
                    words = [w for w, g in zip(words, gone) if not g]
                else:
                    removed.append(0)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _with_spans(docs.select(id_col, text_col), width, id_col, text_col, **more).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a 20-word window seen earlier are removed."""
    return removal_digests(table(spark, sf_dir, "documents"))

"""Groups of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come in two ways, and whole sets decide.  SimHash fingerprints of
the same shingles that meet at an anchor (see simhash) join crowds of near copies without pairs.  Sets of similarity 0.8 differ in some 10 of 64 bits,
though, and covering so many would copy each fingerprint to thousands of anchors, so
the rest comes from an exact way: two such sets share a shingle among the
first n - ceil(0.8 n) + 1 of either, in any order that all documents use.  Here shingles of over
`common` documents come last and hashes decide the rest.  Each document is sent to the buckets of its
first shingles as (shingle, key, size); documents with equal sets have one key.
All pairs of a shingle's documents that sizes allow are counted, and pairs with too few common first shingles
for a similarity of 0.8 dropped: beyond the first shingles of one, they share at
most the rest of that one.  The others are compared on their whole sets.

A shingle with over `crowd` documents makes no pairs.  Documents that such shingles join are put in the order of
their sizes and dealt into blocks; two blocks whose sizes allow it meet in one task, which counts the
common shingles of all their sets by a product of matrices and answers with links only.

Edge cases: texts under the shingle width are one shingle; null and empty texts are
one empty set, a group of its own; a row is told by its id and the hash of its text; of each group
keep_one() leaves the row with the least (id, hash), null ids last, and one of rows alike
in both; an empty table gives an empty result; names of other columns can't clash;
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import cut_lineage, shuffle_width, unused
from .substrings import _BUCKET, _CHUNK, _chunks, _rows, dealt, document_key, extent, windows

_U = np.uint64
_BLOCK = 256  # documents of a crowd's block
_BROADCAST = 1_000_000  # keys sent to all workers at most; beyond, they are joined by a shuffle


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, shingle hash) of all distinct shingles in that order, and the 64-bit key of each text's set."""
    from xxhash import xxh64_intdigest

    texts = [t.lower() for t in texts]
    doc, _, own, _ = windows(np.arange(len(texts)), texts, width, width)
    short = [(i, w) for i, w in ((i, texts[i].split()) for i in np.setdiff1d(np.arange(len(texts)), doc)) if w]
    doc = np.concatenate([doc, np.array([i for i, _ in short], np.int64)])
    own = np.concatenate([own, np.array([xxh64_intdigest(b" ".join(w), 42) for _, w in short], _U)])
    order = np.lexsort((own, doc))
    doc, own = doc[order], own[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
    doc, own = doc[new], own[new]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    keys = np.array([xxh64_intdigest(own[a:b].tobytes()) for a, b in zip(ends, ends[1:])], _U)
    return doc, own, keys


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (..., text) of about _CHUNK bytes of text."""
    sizes = np.array([len(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], np.int64)
    part = np.cumsum(sizes) // _CHUNK
    ends = [*np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    for a, b in zip([0, *ends], ends):
        yield batch.slice(a, b - a)


def _names(own: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle as its bucket and 32 more bits of its hash, so that only those bits need to travel.

    Two shingles that share a name only add to what is counted, as whole sets decide.
    """
    return (own % _U(buckets) << _U(32) | own >> _U(32)).view(np.int64)


def _dealt(names: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, 32 bits of names, then the columns, one behind the other) for each bucket that isn't empty."""
    full, blobs = [], []
    for k, o in dealt(names >> 32):
        full.append(k)
        blobs.append(b"".join([(names[o] & 0xFFFFFFFF).astype(np.uint32).tobytes(), *(c[o].tobytes() for c in columns)]))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "members"])


def _gathered(group: pa.Table, *kinds: type) -> list[np.ndarray]:
    """Names of a bucket's shingles, and the columns that _dealt() sent with them."""
    parts = []
    every = (np.uint32, *kinds)
    wide = sum(np.dtype(k).itemsize for k in every)
    for blob in group.column("members"):
        raw, at = blob.as_py(), 0
        m = len(raw) // wide
        parts.append([])
        for k in every:
            parts[-1].append(np.frombuffer(raw, k, m, at))
            at += m * np.dtype(k).itemsize
    out = [np.concatenate(x) for x in zip(*parts)]
    out[0] = out[0].astype(np.int64) | group.column("bucket")[0].as_py() << 32
    return out


def _common(rows: DataFrame, width: int, hot: int, buckets: int) -> np.ndarray:
    """Names of shingles of over hot documents, sorted; all are counted."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            yield _dealt(_names(shingle_sets(c.texts, width)[1], buckets))

    def count(group: pa.Table) -> pa.Table:
        g, n = np.unique(_gathered(group)[0], return_counts=True)
        return pa.table({"gram": g[n > hot]})

    found = rows.mapInArrow(send, "bucket int, members binary").groupBy("bucket").applyInArrow(count, "gram long").collect()
    return np.sort(np.array([r[0] for r in found], np.int64))


def _first(doc: np.ndarray, names: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a chunk's shingles are among the first ones of their text (those in late come last), and the size of each one's set."""
    last = late[np.minimum(np.searchsorted(late, names), len(late) - 1)] == names if len(late) else np.zeros(len(names), bool)
    order = np.lexsort((names, last, doc))
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[: len(doc)]
    n = np.diff(np.append(begin, len(doc)))
    place = np.arange(len(doc)) - np.repeat(begin, n)
    size = np.repeat(n, n)
    pick = place < size - (4 * size + 4) // 5 + 1
    return order[pick], size[pick]


def _pairs(g: np.ndarray, key: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (u, v, common, beyond, sizes) of a bucket's pairs, and the members of shingles with over most documents.

    Rows come by (g, size, key).  A pair can be similar only if
    9 * (all its common + beyond) >= 4 * sizes.
    """
    n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g)))
    big = np.repeat(n > most, n)
    at, lag, found = np.flatnonzero(~big), 1, [np.zeros((4, 0), np.int64)]
    while len(at):
        at = at[at + lag < len(g)]
        at = at[g[at] == g[at + lag]]
        at = at[5 * size[at] >= 4 * size[at + lag]]  # sizes rise, so no later one fits either
        a, b = key[at], key[at + lag]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b), (4 * size[at + lag] + 4) // 5 - 1, size[at] + size[at + lag]]))
        lag += 1
    u, v, beyond, sizes = np.concatenate(found, axis=1)
    order = np.lexsort((v, u))
    u, v, beyond, sizes = u[order], v[order], beyond[order], sizes[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))[: len(u)]
    return np.stack([u[first], v[first], np.diff(np.append(first, len(u))), beyond[first], sizes[first]]), np.flatnonzero(big)


def _common_counts(doc: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """counts[a, b]: shingles that the sets a and b share, for n sets given as (doc, shingle) pairs."""
    g, at, often = np.unique(shingles, return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1  # what one set has alone is nothing in common
    keep = often[at] > 1
    doc, at = doc[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    counts, wide = np.zeros((n, n), np.float32), 4096
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        a, z = np.searchsorted(at, [low, low + wide])
        m = np.zeros((n, wide), np.float32)
        m[doc[a:z], at[a:z] - low] = 1
        counts += m @ m.T
    return counts


def _meet_in_blocks(group: pa.Table) -> pa.Table:
    """(u, v) links between the members of two blocks, or within one, that have different roots: of each group each member with one."""
    key, root = group.column("key").to_numpy(), group.column("root").to_numpy()
    sets = group.column("shingles").combine_chunks()
    size = np.diff(sets.offsets.to_numpy())
    counts = _common_counts(np.repeat(np.arange(len(key)), size), sets.values.to_numpy(), len(key))
    a, b = np.nonzero(np.triu((9 * counts >= 4 * (size[:, None] + size[None, :])) & (root[:, None] != root[None, :]), 1))
    label = simhash.labels(len(key), a, b)
    member = np.flatnonzero(label != np.arange(len(key)))
    a, b = key[member], key[label[member]]
    return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)})


def _fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """(id, tie, key, fp) of every row of (id, tie, text): its set's key and its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _parts(batch)):
            texts = [t.as_py() or "" for t in b.column(2)]
            keys = shingle_sets([t.encode() for t in texts], width)[2]
            fp = np.array([simhash.fingerprint(t, width) for t in texts], _U)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64))], ["id", "tie", "key", "fp"])

    return cut_lineage(rows.mapInArrow(run, "id long, tie long, key long, fp long"))


def _simhash_pairs(printed: DataFrame, most: int) -> DataFrame:
    """(u, v): keys whose fingerprints are alike or linked at an anchor; of the keys of one fingerprint each with the least."""
    keys = cut_lineage(printed.select("key", "fp").distinct())
    least = keys.groupBy("fp").agg(F.min("key").alias("least"))
    alike = keys.join(least, "fp").filter("key <> least").select("key", F.col("least").alias("other"))
    met = simhash.links(least.select("fp"), most)
    ends = met.join(least.select(F.col("fp").alias("u"), F.col("least").alias("key")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("other")), "v")
    return alike.unionByName(ends.select("key", "other")).select(F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v"))


def similar_groups(docs: DataFrame, width: int = 5, common: int = 50, crowd: int = 200, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, root) of every row: groups linked by a similarity of 0.8 or more have one root; id and tie as document_key() has them.

    common: documents of a shingle that comes last; crowd: documents of a shingle beyond which not all
    its pairs are counted at once; most: differing bits of fingerprints that are candidates.
    """
    rows = _rows(docs, id_col, text_col)
    size, _ = extent(rows)
    buckets = max(4 * shuffle_width(docs), size // _BUCKET)
    printed = _fingerprints(rows, width)
    late = _common(rows, width, common, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            doc, own, keys = shingle_sets(c.texts, width)
            one = np.zeros(len(c.texts), bool)
            one[np.unique(keys, return_index=True)[1]] = True
            doc, names = doc[one[doc]], _names(own[one[doc]], buckets)
            x, n = _first(doc, names, late)
            yield _dealt(names[x], keys[doc[x]].view(np.int64), n.astype(np.int32))

    def meet(group: pa.Table) -> pa.Table:
        g, key, n = _gathered(group, np.int64, np.int32)
        n = n.astype(np.int64)
        order = np.lexsort((key, n, g))
        g, key, n = g[order], key[order], n[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        g, key, n = g[new], key[new], n[new]
        found, big = _pairs(g, key, n, crowd)
        none = np.zeros(len(big), np.int64)
        both = np.concatenate([np.concatenate([found, np.zeros((1, found.shape[1]), np.int64)]), np.stack([g[big], key[big], none, none, none, n[big]])], axis=1)
        return pa.table(dict(zip(["u", "v", "common", "beyond", "sizes", "size"], both)))

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            doc, own, keys = shingle_sets(c.texts, width)
            ends = np.searchsorted(doc, np.arange(len(c.texts) + 1))
            one = np.sort(np.unique(keys, return_index=True)[1])
            for k in one.tolist():
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 1].view(np.int64)), pa.array([own[ends[k] : ends[k + 1]].view(np.int64)], pa.list_(pa.int64()))], ["key", "shingles"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(key, shingles) of the keys in wanted."""
        wanted = cut_lineage(wanted.distinct())
        if wanted.count() <= _BROADCAST:
            wanted = F.broadcast(wanted)
        sets = rows.mapInArrow(set_of, "key long, shingles array<long>").join(wanted, "key", "left_semi")
        return cut_lineage(sets.groupBy("key").agg(F.first("shingles").alias("shingles")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets are similar enough."""
        pairs = cut_lineage(pairs.select("u", "v").distinct())
        sets = sets_of(pairs.select(F.col("u").alias("key")).union(pairs.select("v")))
        both = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return cut_lineage(both.filter(9 * shared >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))

    def crowded(big: DataFrame, roots: DataFrame) -> DataFrame:
        """Links of the members (u: shingle, v: key, size) of crowds that aren't in one group yet."""
        least = big.groupBy("u").agg(F.min("v").alias("least"))
        joined = simhash.components(big.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct())
        members = big.select(F.col("v").alias("key"), "size").distinct()
        members = members.join(joined.select(F.col("u").alias("key"), F.col("v").alias("crowd")), "key", "left").withColumn("crowd", F.coalesce("crowd", "key"))
        members = members.join(roots.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))
        place = Window.partitionBy("crowd").orderBy("size", "key")
        members = cut_lineage(members.withColumn("block", F.floor((F.row_number().over(place) - 1) / _BLOCK)))
        blocks = members.groupBy("crowd", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
        left, right = blocks.select("crowd", F.col("block").alias("one"), "high"), blocks.select("crowd", F.col("block").alias("other"), "low")
        meetings = left.join(right, "crowd").filter((F.col("one") <= F.col("other")) & (5 * F.col("high") >= 4 * F.col("low"))).select("crowd", "one", "other")
        seats = meetings.select("crowd", "one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))
        sets = sets_of(members.select("key"))
        sent = seats.join(members, ["crowd", "block"]).join(sets, "key").select("crowd", "one", "other", "key", "root", "shingles")
        return cut_lineage(sent.groupBy("crowd", "one", "other").applyInArrow(_meet_in_blocks, "u long, v long").distinct())

    met = cut_lineage(rows.mapInArrow(send, "bucket int, members binary").groupBy("bucket").applyInArrow(meet, "u long, v long, common long, beyond long, sizes long, size long"))
    counted = met.filter("size = 0").groupBy("u", "v").agg(F.sum("common").alias("common"), F.max("beyond").alias("beyond"), F.max("sizes").alias("sizes"))
    likely = counted.filter("9 * (common + beyond) >= 4 * sizes").select("u", "v")
    roots = simhash.components(verified(_simhash_pairs(printed, most).unionByName(likely)))
    big = met.filter("size > 0")
    if not big.isEmpty():
        roots = simhash.components(roots.union(crowded(big.select("u", "v", "size"), roots)))
    return printed.join(roots.withColumnRenamed("u", "key"), "key", "left").select("id", "tie", F.coalesce("v", "key").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs, all columns, with one row of each group of similar documents: the one with the least (id, hash of the text), null ids last.

    Rows are joined back by both, so nothing but that row stays; of rows alike in both any one does.
    """
    i, tie = unused(docs, "id_key"), unused(docs, "tie")
    grouped = cut_lineage(similar_groups(docs, id_col=id_col, text_col=text_col, **more))
    null_id = F.lit(int(np.iinfo(np.int64).min))
    best = grouped.groupBy("root").agg(F.min(F.struct((F.col("id") == null_id).alias("none"), "id", "tie")).alias("best"))
    kept = cut_lineage(best.select(F.col("best.id").alias(i), F.col("best.tie").alias(tie)))
    out = docs.withColumns(dict(zip((i, tie), document_key(id_col, text_col)))).join(kept, [i, tie], "left_semi")
    repeated = grouped.groupBy("id", "tie").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([i, tie])
    return out.select(*docs.columns)

"""SimHash near-duplicate groups by anchor-point covering.

Anchors are the words of a product of perfect codes on disjoint blocks of the
64 bits (by default two binary Golay codes [23, 12] with covering radius 3).
Each fingerprint x has a home anchor h(x), within the radius R of x in every
block.  If y differs from x in at most t bits, of which t_i in block i, then y is
within R + t_i of h(x) in block i.  So a fingerprint is copied to every anchor
from which it is at most t bits farther than the radius, summed over the blocks, and
every pair within t bits meets at the home of one of its two members.  There the whole 64
bits are compared.

Exact copies have one fingerprint, so they are folded before anything is copied.
At an anchor with many members no pairs are made: two words are within two bits
just if their balls of radius one meet, so sorting the balls' members finds the
links in n log n.  An anchor answers with a link from each linked member to one of
its group (n at most, not n * n).  Components then come from alternating large-star and
small-star steps on these links.

Skew: an anchor with over `hot_members` copies (boilerplate clusters) is not
held by one task.  Fingerprints that would meet there meet at the members of their own balls of
radius one instead: 65 keys each, and a key has 65 holders at most.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; texts under the shingle width are one shingle; rows with a null id are
grouped but never name a group (null if nobody else can); repeated rows and ids are
rows of their own; an empty table gives an empty result; very long texts are
hashed whole, in slices; names of other columns can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_width, table, unused
from .substrings import dealt, document_key

#: Name -> length, generator polynomial, covering radius of a perfect cyclic code.
CODES = {"golay23": (23, 0b101011100011, 3), "hamming15": (15, 0b10011, 1), "hamming7": (7, 0b1011, 1)}


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over the XXH64 of all word shingles, repeats included; unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    ones, n = np.zeros(64, np.int64), 0
    while some := list(itertools.islice(shingles, 1 << 16)):
        h = np.array([xxh64_intdigest(b" ".join(s), seed) for s in some], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(some)
        if isinstance(shingles, list):
            break
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


@lru_cache
def _code(name: str, most: int):
    """(length, radius, message bits, syndrome tables, for each excess up to most: start and words of the patterns of each syndrome)."""
    n, poly, radius = CODES[name]
    check = poly.bit_length() - 1
    rest = np.zeros(n, np.int64)  # of x^i by the polynomial
    r = 1
    for i in range(n):
        rest[i] = r
        r <<= 1
        if r >> check:
            r ^= poly
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 12, np.int64)
    for i in range(min(12, n)):
        low[1 << i : 2 << i] = low[: 1 << i] ^ rest[i]
    for i in range(12, n):
        high[1 << (i - 12) : 2 << (i - 12)] = high[: 1 << (i - 12)] ^ rest[i]
    by_excess = []
    for excess in range(most + 1):
        sizes = range(radius + 1) if excess == 0 else [radius + excess]
        words = np.array([sum(1 << i for i in c) for k in sizes for c in itertools.combinations(range(n), k)], np.int64)
        s = low[words & 4095] ^ high[words >> 12]
        order = np.argsort(s, kind="stable")
        by_excess.append((np.searchsorted(s[order], np.arange((1 << check) + 1)), words[order]))
    return n, check, low, high, by_excess


def anchors(fps: np.ndarray, most: int, blocks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all copies of the fingerprints (uint64)."""
    row, anchor, spent = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    shift = used = 0
    for name in blocks:
        n, check, low, high, by_excess = _code(name, most)
        word = ((fps >> np.uint64(used)) & np.uint64((1 << n) - 1)).astype(np.int64)
        syndrome = low[word & 4095] ^ high[word >> 12]
        grown = []
        for excess, (start, patterns) in enumerate(by_excess):
            may = np.flatnonzero(spent + excess <= most)
            s = syndrome[row[may]]
            count = start[s + 1] - start[s]
            i = np.repeat(may, count)
            at = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[s], count)
            message = (word[row[i]] ^ patterns[at]) >> check  # a code word is told by its upper bits
            grown.append((row[i], anchor[i] | message << shift, spent[i] + excess))
        row, anchor, spent = (np.concatenate(x) for x in zip(*grown))
        shift, used = shift + n - check, used + n
    return row, anchor, spent == 0


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for edges a-b of nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, label):
            return label
        label = new


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def _near_at(key: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of holders of the same key within most bits; a key has a bounded number of holders."""
    order = np.argsort(key, kind="stable")
    at, lag, found = np.arange(len(key)), 1, [np.zeros((2, 0), np.int64)]
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[order[at]] == key[order[at + lag]]]
        near = at[np.bitwise_count(fps[order[at]] ^ fps[order[at + lag]]) <= most]
        found.append(order[np.stack([near, near + lag])])
        if most == 2:  # all holders of a ball member are within two bits, so neighbours are links enough
            break
        lag += 1
    return tuple(np.concatenate(found, axis=1))


def _many(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of fps within most bits (two at most) of each other into their groups; no pairs but within balls are made."""
    found = []
    slices = 1 + len(fps) // 20_000
    for part in range(slices):  # by the ball members' hash, so that a slice has all holders of a member
        keys, who = [], []
        for f in _FLIPS:
            k = fps ^ f
            mine = np.flatnonzero((k * _SPREAD >> np.uint64(40)) % np.uint64(slices) == part)
            keys.append(k[mine])
            who.append(mine)
        k, w = np.concatenate(keys), np.concatenate(who)
        x, y = _near_at(k, fps[w], most)
        found.append((w[x], w[y]))
    return tuple(np.concatenate(x) for x in zip(*found))


def links_at_anchors(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, one of its group) between members of the same anchor within most bits."""
    order = np.argsort(anchor, kind="stable")
    anchor, fps, home = anchor[order], fps[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(first, len(anchor)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    keep = np.repeat((size > 1) & (size <= 64), size)
    at = np.flatnonzero(keep)
    lag = 1
    while len(at):
        at = at[at + lag < len(anchor)]
        at = at[anchor[at] == anchor[at + lag]]
        near = at[(np.bitwise_count(fps[at] ^ fps[at + lag]) <= most) & (home[at] | home[at + lag])]
        a.append(near)
        b.append(near + lag)
        lag += 1
    for i in np.flatnonzero(size > 64):
        x, y = _many(fps[first[i] : first[i] + size[i]], most)
        a.append(x + first[i])
        b.append(y + first[i])
    return _stars(fps, np.concatenate(a), np.concatenate(b))


def _stars(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least of its group) for links a-b, which are places in fps."""
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    nodes, ids = np.unique(np.concatenate([fps[a], fps[b]]), return_inverse=True)
    label = labels(len(nodes), ids[: len(a)], ids[len(a) :])
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def hot_anchors(distinct: DataFrame, most: int, blocks: tuple[str, ...], hot_members: int, n: int, partitions: int, most_hot: int = 1_000_000) -> np.ndarray:
    """Anchors with over `hot` copies of fingerprints, where hot is hot_members or the copies' number / most_hot, the larger.

    A task hands on anchors with over hot / (2 * tasks) copies; what is kept back adds up to hot / 2 at
    most, so none with over hot copies is missed and the table has at most 2 * most_hot entries.
    """
    a_word = len(anchors(np.zeros(1, np.uint64), most, blocks)[0])
    hot = max(hot_members, n * a_word // most_hot)
    tasks = partitions + n // 20_000 // 50
    least_count = hot // (2 * tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            a, c = np.unique(np.concatenate(held), return_counts=True)
            k = c > least_count
            return pa.RecordBatch.from_arrays([pa.array(a[k]), pa.array(c[k])], ["anchor", "n"])

        for b in batches:
            whole = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(whole), 20_000):
                held.append(anchors(whole[i : i + 20_000], most, blocks)[1])
                if sum(map(len, held)) > 50 * 20_000 * a_word // 8:
                    yield often()
                    held = []
        if held:
            yield often()

    counted = distinct.select("fp").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in counted.filter(F.col("n") > hot // 2).select("anchor").collect()], np.int64))


def links(distinct: DataFrame, most: int = 2, blocks: tuple[str, ...] = ("golay23", "golay23"), hot_members: int = 500_000) -> DataFrame:
    """(u, v) star links between distinct fingerprints (column fp) within most bits, two at most."""
    if not 0 <= most <= 2:
        raise ValueError("at most two differing bits")
    n, last = distinct.select(F.spark_partition_id().alias("part")).agg(F.count("*"), F.max("part")).first()
    # an anchor can't hold more copies than there are fingerprints
    hot = hot_anchors(distinct, most, blocks, hot_members, n, last + 1) if n > hot_members else np.zeros(0, np.int64)
    buckets = max(4 * shuffle_width(distinct), n // 4000)

    def rows(kind: bytes, key: np.ndarray, home: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for k, o in dealt((key.astype(np.uint64) * _SPREAD >> np.uint64(33)).astype(np.int64) % buckets):
            yield k, kind + key[o].tobytes() + fps[o].tobytes() + home[o].tobytes()

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(whole), 20_000):
                fps = whole[i : i + 20_000]
                row, anchor, home = anchors(fps, most, blocks)
                out = []
                if len(hot):
                    crowded = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    alone = fps[np.unique(row[crowded])]
                    row, anchor, home = row[~crowded], anchor[~crowded], home[~crowded]
                    balls = (alone[:, None] ^ _FLIPS).ravel()
                    out += rows(b"\1", balls, np.zeros(len(balls), bool), np.repeat(alone, len(_FLIPS)))
                out += rows(b"\0", anchor, home, fps[row])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "members"])

    def compare(group: pa.Table) -> pa.Table:
        met = {0: [], 1: []}
        for blob in group.column("members"):
            raw = blob.as_py()
            m = (len(raw) - 1) // 17
            met[raw[0]].append((np.frombuffer(raw, np.uint64, m, 1), np.frombuffer(raw, np.uint64, m, 1 + 8 * m), np.frombuffer(raw, bool, m, 1 + 16 * m)))
        u, v = [], []
        for kind, parts in met.items():
            if parts:
                key, fps, home = (np.concatenate(x) for x in zip(*parts))
                x, y = _stars(fps, *_near_at(key, fps, most)) if kind else links_at_anchors(key, fps, home, most)
                u.append(x)
                v.append(y)
        return pa.table({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    copies = distinct.select("fp").mapInArrow(copy, "bucket int, members binary")
    return copies.groupBy("bucket").applyInArrow(compare, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node but a component's smallest, with that smallest.

    links: (u, v) longs, undirected.  Every step is an aggregation and a join on
    the node, both of which Spark spreads or splits when a node is hot; the links are written to the
    checkpoint folder after each round.
    """
    mark = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))]

    def written(links: DataFrame, n: int | None) -> DataFrame:
        """links in the checkpoint folder; of about n links no more files than they are worth."""
        return cut_lineage(links if n is None else links.coalesce(n // 100_000 + 1))

    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None)
    was, seen = None, tuple(now.agg(*mark).first())
    now = now.coalesce(seen[0] // 100_000 + 1)
    while seen != was and seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(now, seen[0])
        was, seen = seen, tuple(now.agg(*mark).first())
    return now


def named_groups(rows: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """rows (id, ..., node) with component_id, the least id of the rows whose nodes have one root.

    roots: (u, v), nodes that have another root than themselves.  Nodes are joined, not rows: rows of
    one node (exact copies) are counted as one, and a node with very many rows is split by a salt.
    """
    distinct = rows.groupBy("node").agg(F.min(id_col).alias("least"))
    rooted = distinct.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "least", F.coalesce("v", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(named, "root").select("node", "root", "component_id")
    salts = 16
    salted = by_node.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.col("tie"), F.lit(salts)).cast("int")).join(salted, ["node", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2, blocks: tuple[str, ...] = ("golay23", "golay23"), id_col: str = "doc_id", text_col: str = "text", hot_members: int = 500_000) -> DataFrame:
    """(id, fingerprint hex, component_id) of every row.

    width: words a shingle; most: differing bits that still link (two at most).  blocks: codes
    whose product gives the anchors; two Golay codes make 2**24 anchors and about 61
    copies of a distinct fingerprint; for over about 10**8 distinct ones add
    "hamming15" (2**35 anchors, about 150 copies).
    """
    if sum(CODES[b][0] for b in blocks) > 64:
        raise ValueError("the blocks have more than 64 bits")
    # a row's own number deals out rows of one fingerprint
    rows = cut_lineage(fingerprints(docs, width, id_col, text_col).withColumnRenamed("fp", "node").withColumn("tie", F.monotonically_increasing_id()))
    roots = components(links(rows.select(F.col("node").alias("fp")).distinct(), most, blocks, hot_members))
    return named_groups(rows, roots, id_col).select(id_col, F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of all documents: three-word shingles, two bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))

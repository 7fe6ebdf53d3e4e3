"""Harmonic packing of token sequences.

Pieces are put into reciprocal-capacity classes: class k takes pieces longer
than capacity/(k+1) and no longer than capacity/k, and a sequence of class k
holds exactly k of them, so a piece's sequence follows from its number within its
class alone.  Workers number their pieces independently; one small table of
counts by (worker, class) turns these numbers into seats, and no worker waits for
or looks into another's sequences.

Documents may be cut.  Whole capacities come off first; from the rest a piece is
cut at capacity/(k+1) wherever leaving it whole in class k would waste more than
1/64 of its seat.  So every full sequence is padded by 1/64 at most, and only the last
sequence of each class (64 or so in all, whatever the input) is partly filled;
those are laid together first-fit.  The table of cuts has capacity entries.

Edge cases: null and empty texts are one closing id; very long texts become many
whole sequences; repeated rows and repeated or null ids are packed as rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import loaded
from .common import cut_lineage, table

WASTE = 64


def cuts(capacity: int) -> list[list[tuple[int, int]]]:
    """For each rest below capacity: its pieces as (length, class) in order."""
    out: list[list[tuple[int, int]]] = [[]]
    for rest in range(1, capacity):
        k = capacity // rest
        seat = capacity // k
        if (seat - rest) * WASTE <= seat:
            out.append([(rest, k)])
        else:
            whole = capacity // (k + 1)
            out.append([(whole, capacity // whole), *out[rest - whole]])
    return out


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Every document's pieces with class and the number within worker and class."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")), T.StructField("class", T.IntegerType()), T.StructField("worker", T.IntegerType()), T.StructField("number", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, rests, worker = loaded(path), cuts(capacity), TaskContext.get().partitionId()
        taken = [0] * (capacity + 1)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            rows, start, length, crc, total, classes, number, ids = [], [], [], [], [], [], [], []
            for i, raw in enumerate(bpe.encode_many(b.column(1).to_pylist())):
                raw += end
                n, at = len(raw) // 4, 0
                for size, k in [*[(capacity, 1)] * (n // capacity), *rests[n % capacity]]:
                    piece = raw[4 * at : 4 * (at + size)]
                    rows.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    classes.append(k)
                    number.append(taken[k])
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
                    taken[k] += 1
                    at += size
            columns = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(classes, pa.int32()), pa.array([worker] * len(rows), pa.int32()), pa.array(number, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def _lay_together(rests: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """rests: (class, tokens) of partly filled sequences; class -> (class whose sequence takes it, tokens before it)."""
    open_: list[list[int]] = []
    out = {}
    for k, tokens in sorted(rests, key=lambda x: (-x[1], x[0])):
        for bin_ in open_:
            if bin_[1] + tokens <= capacity:
                out[k] = (bin_[0], bin_[1])
                bin_[1] += tokens
                break
        else:
            open_.append([k, tokens])
            out[k] = (k, 0)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class (and ids).

    path: vocabulary file; end_id closes every document.  The texts are read and
    encoded once; pieces (a few dozen bytes each) go to the shared checkpoint
    folder, and one shuffle of them by sequence gives the offsets.
    """
    pieces = cut_lineage(_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids))
    counts = pieces.groupBy("worker", "class").agg(F.count("*").alias("own"))
    before = counts.select("worker", "class", (F.sum("own").over(Window.partitionBy("class").orderBy("worker")) - F.col("own")).alias("before"))
    seated = pieces.join(before, ["worker", "class"]).withColumn("seat", F.col("number") + F.col("before")).withColumn("bin", F.floor(F.col("seat") / F.col("class")))
    seated = seated.withColumn("sequence_id", F.col("bin") * capacity + F.col("class") - 1)
    by_sequence = Window.partitionBy("sequence_id").orderBy("seat")  # class rows at most
    placed = seated.withColumn("offset", F.coalesce(F.sum("length").over(by_sequence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    # At most one row a class: the sequences that aren't full.
    totals = counts.groupBy("class").agg(F.sum("own").alias("all"))
    last = totals.filter(F.col("all") % F.col("class") != 0).select("class", (F.floor(F.col("all") / F.col("class")) * capacity + F.col("class") - 1).alias("sequence_id"))
    fill = seated.join(F.broadcast(last), ["class", "sequence_id"]).groupBy("class", "sequence_id").agg(F.sum("length").alias("tokens")).collect()
    ids = {r["class"]: r["sequence_id"] for r in fill}
    moves = _lay_together([(r["class"], r["tokens"]) for r in fill], capacity)
    moved = {ids[k]: (ids[to], base) for k, (to, base) in moves.items() if to != k}
    if moved:
        # Keys must be long: sequence_id is cast to the keys' type, and a class has ids over an int's from 2^31 / capacity sequences on.
        entry = F.create_map(*(x for k, (to, base) in moved.items() for x in (F.lit(k).cast("long"), F.struct(F.lit(to).cast("long").alias("to"), F.lit(base).cast("long").alias("base")))))[F.col("sequence_id")]
        placed = placed.withColumn("move", entry).withColumn("sequence_id", F.coalesce("move.to", "sequence_id")).withColumn("offset", F.col("offset") + F.coalesce("move.base", F.lit(0)))
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.col("offset").cast("long"), "class", *["ids"] * with_ids)


def sequences(packed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) from pack(..., with_ids=True); ids padded to capacity unless their number is a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")).withColumn("n_tokens", F.size("ids"))
    whole = F.expr("n_tokens & (n_tokens - 1)") == 0
    return joined.withColumn("ids", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.col("n_tokens")))))


def op1_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

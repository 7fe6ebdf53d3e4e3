"""Byte ranges: what is uncompressed, what lies between, where it lies afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _by_offset():
    return Window.partitionBy("pair_id").orderBy("offset")


def ranges(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, offset, length, usize, params), each once, though a base may serve several entries."""
    parts = []
    for side in ("old", "new"):
        params = F.col("new.params") if side == "new" else F.lit(None).cast("struct<level:int,strategy:int,nowrap:boolean>")
        parts.append(pairs.filter(f"unc_{side}").select("pair_id", F.lit(side).alias("side"), F.col(f"{side}.data_off").alias("offset"), F.col(f"{side}.csize").alias("length"), F.col(f"{side}.usize").alias("usize"), params.alias("params")))
    return parts[0].dropDuplicates(["pair_id", "offset", "length"]).unionByName(parts[1])


def gaps(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """(pair_id, offset, length) of the bytes between spans (pair_id, offset, length) and behind them up to lengths (pair_id, length)."""
    end = F.col("offset") + F.col("length")
    before = F.coalesce(F.lag(end).over(_by_offset()), F.lit(0))
    between = spans.select("pair_id", before.alias("from"), F.col("offset").alias("to"))
    ends = spans.groupBy("pair_id").agg(F.max(end).alias("from"))
    tails = lengths.select("pair_id", F.col("length").alias("to")).join(ends, "pair_id", "left").select("pair_id", F.coalesce("from", F.lit(0)).alias("from"), "to")
    return between.unionByName(tails).filter("to > from").select("pair_id", F.col("from").alias("offset"), (F.col("to") - F.col("from")).alias("length"))


def inverse(spans: DataFrame) -> DataFrame:
    """spans (pair_id, offset, length, usize, ...) where they lie in the delta-friendly blob: all before have grown."""
    grown = F.sum(F.col("usize") - F.col("length")).over(_by_offset().rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("offset", F.col("offset") + F.coalesce(grown, F.lit(0))).withColumn("length", F.col("usize"))


def blob_sizes(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """(pair_id, blob_size) of the delta-friendly blobs."""
    grown = spans.groupBy("pair_id").agg(F.sum(F.col("usize") - F.col("length")).alias("grown"))
    return lengths.join(grown, "pair_id", "left").select("pair_id", (F.col("length") + F.coalesce("grown", F.lit(0))).alias("blob_size"))


def overlaps(spans: DataFrame) -> DataFrame:
    """spans that begin before the one ahead of them ends."""
    before = F.lag(F.col("offset") + F.col("length")).over(_by_offset())
    return spans.withColumn("previous_end", before).filter("offset < previous_end")


def checked(spans: DataFrame) -> DataFrame:
    """spans; a negative number or an overlap fails the job."""
    before = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(_by_offset()), F.lit(0))
    bad = (F.col("offset") < before) | (F.col("length") < 0)
    return spans.withColumn("offset", F.when(bad, F.raise_error(F.lit("ranges are negative or overlap")).cast("long")).otherwise(F.col("offset")))


def next_bounds(catalog: DataFrame, directories: DataFrame) -> DataFrame:
    """catalog with bound: where the next entry begins, or the directory (pair_id, dir_off) behind the last."""
    w = Window.partitionBy("pair_id").orderBy("local_off")
    joined = catalog.join(directories.select("pair_id", "dir_off"), "pair_id")
    return joined.withColumn("bound", F.coalesce(F.lead("local_off").over(w), F.col("dir_off"))).drop("dir_off")


def as_arrays(spans: DataFrame, *columns: str) -> DataFrame:
    """(pair_id, ops): a pair's spans by offset as an array of structs."""
    return spans.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", *columns))).alias("ops"))

"""Budgets on what is uncompressed: walks that skip what no longer fits and go on.

A walk is sequential within a pair of archives.  It runs over the pair's sorted
sizes in one task; an archive has 65,534 entries at most, so a pair's list is
bounded.  Only sizes and paths go into the list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import kernel


def _walk(items, budget) -> list[bytes]:
    """Paths of the items (size, path, cost) that no longer fit when their turn comes."""
    over = []
    for x in items:
        if x["cost"] <= budget:
            budget -= x["cost"]
        else:
            over.append(bytes(x["path"]))
    return over


def _budget(pairs: DataFrame, budget: Column, costs: Column, size: Column, charged: Column) -> DataFrame:
    """Rows of charged entries that don't fit become NEITHER / RESOURCE_CONSTRAINED.

    The walk goes by falling size, then falling path.
    """
    item = F.struct(size.cast("long").alias("size"), F.col("new.path").cast("binary").alias("path"), costs.cast("long").alias("cost"))
    lists = pairs.filter(charged).groupBy("pair_id").agg(F.first(budget.cast("long")).alias("budget"), F.sort_array(F.collect_list(item), asc=False).alias("items"))
    walked = lists.select("pair_id", kernel(_walk, "array<binary>")("items", "budget").alias("over"))
    over = walked.select("pair_id", F.explode("over").alias("__path"), F.lit(True).alias("__over"))
    joined = pairs.withColumn("__path", F.col("new.path").cast("binary")).join(over, ["pair_id", "__path"], "left")
    hit = F.col("__over").isNotNull() & charged
    out = joined.withColumns({"recommendation": F.when(hit, "UNCOMPRESS_NEITHER").otherwise(F.col("recommendation")), "reason": F.when(hit, "RESOURCE_CONSTRAINED").otherwise(F.col("reason"))})
    return out.withColumns({c: F.col(c) & ~hit for c in ("unc_old", "unc_new")}).select(*pairs.columns)


def total_recompression(limit: int) -> Callable[[DataFrame], DataFrame]:
    """At most limit bytes of new entries are uncompressed, and so recompressed when the patch is applied."""
    if limit < 0:
        raise ValueError("the limit is negative")
    return lambda pairs: _budget(pairs, F.lit(limit), F.col("new.usize"), F.col("new.usize"), F.col("unc_new"))


def old_blob_size(limit: int, archives: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The delta-friendly old blob has at most limit bytes; archives: (pair_id, length) of the old ones.

    A base that serves two new entries is charged for each.
    """
    if limit < 0:
        raise ValueError("the limit is negative")

    def rewrite(pairs: DataFrame) -> DataFrame:
        with_length = pairs.join(archives.select("pair_id", F.col("length").alias("__length")), "pair_id")
        out = _budget(with_length, F.lit(limit) - F.col("__length"), F.col("old.usize") - F.col("old.csize"), F.col("old.usize"), F.col("unc_old"))
        return out.drop("__length")

    return rewrite

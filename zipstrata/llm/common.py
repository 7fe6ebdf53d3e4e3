"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut_lineage
from ..sources.tables import table

__all__ = ["bounded_sample", "cut_lineage", "shuffle_width", "table", "training_texts", "unused"]


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle partitions, the one knob by which operators size their buckets."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows with the least hash of their id (all, if there are fewer).

    For training samples only.  A threshold on the hash, from a count, first leaves
    about twice n rows in all, so no task or partition hands on n rows of its own.
    """
    total, ranges = rows.count(), 1 << 30
    h = F.pmod(F.xxhash64(id_col), F.lit(ranges))
    if total > 4 * n:
        few = rows.filter(h < int(2 * n / total * ranges) + 1)
        rows = few if few.count() >= n else rows
    return rows.orderBy(h, id_col).limit(n)


def training_texts(rows: DataFrame, chosen: DataFrame, id_col: str, text_col: str, max_rows: int, max_bytes: int) -> list[tuple]:
    """(id, text, other column of chosen) of a training sample, collected to the driver.

    chosen: the ids, at most max_rows, and one other column.  Where an id has several rows or the texts more than
    max_bytes, texts are taken in the order of a hash while they fit; lengths come first, so
    no more than that is ever sent.
    """
    (label,) = [c for c in chosen.columns if c != id_col]
    every = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    few = F.broadcast(chosen.select(F.col(id_col).alias("id"), F.col(label).alias("label")))
    lengths = every.join(few, "id").select("place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).distinct().orderBy("place").limit(2 * max_rows).collect()
    taken, size = [], 0
    for r in lengths:
        if len(taken) < max_rows and size + r["n"] <= max_bytes:
            taken.append((r["place"],))
            size += r["n"]
    if not taken:
        return []
    wanted = F.broadcast(rows.sparkSession.createDataFrame(taken, "place long"))
    found = every.join(wanted, "place", "left_semi").join(few, "id").dropDuplicates(["place"]).collect()
    return [(r["id"], r["text"], r["label"]) for r in sorted(found, key=lambda r: r["place"])]

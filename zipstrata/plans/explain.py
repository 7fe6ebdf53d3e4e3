"""What each entry costs in a patch, and reports of it.

explained rows: (pair_id, path, is_new, reason, size_in_patch).
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut_lineage
from ..functions.bindiff import write_delta
from ..functions.codec import deflate, inflate
from ..functions.kernels import kernel
from ..sources.zipfiles import catalog, stored_entries
from .matching import new_only, plan_pairs

CATEGORIES = ("new", "changed", "unchanged_or_free", "resource_constrained")


def category() -> Column:
    return (
        F.when(F.col("is_new"), "new")
        .when(F.col("reason") == "RESOURCE_CONSTRAINED", "resource_constrained")
        .when(F.col("size_in_patch") > 0, "changed")
        .otherwise("unchanged_or_free")
    )


def is_free() -> Column:
    """Pairs that cost nothing: the same stored bytes, or the same content."""
    return (F.col("reason") == "COMPRESSED_BYTES_IDENTICAL") | ((F.col("old.crc32") == F.col("new.crc32")) & (F.col("old.usize") == F.col("new.usize")))


def totals(explained: DataFrame) -> DataFrame:
    """(pair_id, category, entries, size): a row a category that occurs."""
    return explained.groupBy("pair_id", category().alias("category")).agg(F.count("*").alias("entries"), F.sum("size_in_patch").alias("size"))


def summary(explained: DataFrame) -> DataFrame:
    """A row a pair: entries and estimated size of each category, and the total size."""
    c = category()
    cells = [f(F.when(c == k, x)).alias(f"{name}_{k}") for k in CATEGORIES for f, x, name in ((F.count, F.lit(1), "n"), (lambda v: F.coalesce(F.sum(v), F.lit(0)), F.col("size_in_patch"), "size"))]
    return explained.groupBy("pair_id").agg(*cells, F.sum("size_in_patch").alias("size_total"))


def _new_cost(stored) -> int:
    return len(deflate(bytes(stored)))


def _changed_cost(old, new, unc_old, unc_new):
    old, new = bytes(old), bytes(new)
    try:
        old, new = inflate(old) if unc_old else old, inflate(new) if unc_new else new
    except zlib.error as e:
        raise ValueError(f"an entry to be uncompressed isn't a deflate stream: {e}") from e
    return len(deflate(write_delta(old, new)))


def explain_patch(old: DataFrame, new: DataFrame, old_bytes: DataFrame, new_bytes: DataFrame, *modifiers) -> DataFrame:
    """explained rows of catalogues, with stored bytes by (pair_id, local_off, stored).

    Sizes are approximate: a new entry's stored bytes deflated, a changed entry's
    delta deflated.  Renamed entries appear as new and as what they are compared with.  Free
    pairs are set apart before any bytes are joined, as a Python function under CASE
    would run for them too.  Plans are made once and written, as both kinds of pairs are read from them.
    """
    stored = {s: b.select("pair_id", F.col("local_off").alias(f"{s}_off"), F.col("stored").alias(f"{s}_stored")) for s, b in (("old", old_bytes), ("new", new_bytes))}
    fresh = new_only(old, new.select("pair_id", "path", "local_off")).withColumnRenamed("local_off", "new_off").join(stored["new"], ["pair_id", "new_off"])
    fresh = fresh.select("pair_id", "path", F.lit(True).alias("is_new"), F.lit(None).cast("string").alias("reason"), kernel(_new_cost, "long")("new_stored").alias("size_in_patch"))
    plan = plan_pairs(old, new, *modifiers)
    pairs = cut_lineage(plan.select("pair_id", F.col("new.path").alias("path"), F.lit(False).alias("is_new"), "reason", "unc_old", "unc_new", F.col("old.local_off").alias("old_off"), F.col("new.local_off").alias("new_off"), is_free().alias("free")))
    free = pairs.filter("free").select("pair_id", "path", "is_new", "reason", F.lit(0).cast("long").alias("size_in_patch"))
    paid = pairs.filter("not free").join(stored["old"], ["pair_id", "old_off"]).join(stored["new"], ["pair_id", "new_off"])
    paid = paid.select("pair_id", "path", "is_new", "reason", kernel(_changed_cost, "long")("old_stored", "new_stored", "unc_old", "unc_new").alias("size_in_patch"))
    return fresh.unionByName(free).unionByName(paid)


def explain_archives(old: DataFrame, new: DataFrame, *modifiers) -> DataFrame:
    """explained rows of archives (pair_id, content)."""
    c, d = cut_lineage(catalog(old)), cut_lineage(catalog(new, with_params=True))
    return explain_patch(c, d, stored_entries(old), stored_entries(new), *modifiers)


def path_order(path: str) -> Column:
    """What paths are listed by: their UTF-16 code units."""
    return F.encode(F.col(path).cast("string"), "UTF-16BE")


def in_path_order(explained: DataFrame) -> DataFrame:
    """explained with position: its place in the pair's list by path, changed entries before new ones."""
    return explained.withColumn("position", F.row_number().over(Window.partitionBy("pair_id").orderBy(path_order("path"), "is_new")))


def _lists(explained: DataFrame) -> DataFrame:
    """A row a pair: each category's entries by path (an archive has a bounded number), and the sums."""
    fields = ("path", "is_new", "reason", "size_in_patch")
    row = F.struct(path_order("path").alias("order"), *fields)
    c = category()
    return explained.groupBy("pair_id").agg(
        *(F.transform(F.array_sort(F.collect_list(F.when(c == k, row))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(k) for k in CATEGORIES),
        *(F.coalesce(F.sum(F.when(c == k, F.col("size_in_patch"))), F.lit(0)).alias(f"size_{k}") for k in CATEGORIES),
    )


def json_report(explained: DataFrame) -> DataFrame:
    """(pair_id, report) as JSON; paths must be text."""
    lists = _lists(explained)
    return lists.select("pair_id", F.to_json(F.struct(*lists.columns[1:]), {"ignoreNullFields": "false"}).alias("report"))


def _text(x) -> str:
    return bytes(x).decode("utf-8", "replace") if isinstance(x, (bytes, bytearray)) else x


def legacy_json_report(explained: DataFrame) -> DataFrame:
    """(pair_id, report) in the older notation: bare keys, single quotes, undefined.  The wording is a fixed value."""

    def write(new, changed, free, constrained, n, c, r):
        def entries(name, rows):
            lines = []
            for x in rows:
                reason = "undefined" if x["is_new"] else f"'{x['reason']}'"
                lines.append(f"    {{ path: '{_text(x['path'])}', isNew: {str(x['is_new']).lower()}, reasonIncluded: {reason}, compressedSizeInPatch: {x['size_in_patch']} }}")
            return f"  {name}: [\n" + ",\n".join(lines) + ("\n" if lines else "") + "  ]"

        sizes = f"  estimatedNewSize: {n},\n  estimatedChangedSize: {c},\n  estimatedResourceConstrainedSize: {r},\n"
        lists = (("explainedAsNew", new), ("explainedAsChanged", changed), ("explainedAsUnchangedOrFree", free), ("explainedAsResourceConstrained", constrained))
        return "{\n" + sizes + ",\n".join(entries(*x) for x in lists) + "\n}"

    return _lists(explained).select("pair_id", kernel(write, "string")(*CATEGORIES, "size_new", "size_changed", "size_resource_constrained").alias("report"))


def text_report(explained: DataFrame) -> DataFrame:
    """(pair_id, report): a line an entry (constrained ones are only counted), then counts and sums.  The wording is a fixed value."""

    def write(new, changed, free, constrained, n, c, r):
        lines = [f"New file '{_text(x['path'])}', approximate size of data in patch: {x['size_in_patch']} bytes" for x in new]
        lines += [f"Changed file '{_text(x['path'])}', approximate size of data in patch: {x['size_in_patch']} bytes" for x in changed]
        lines += [f"Unchanged or zero-delta-cost file '{_text(x['path'])}'" for x in free]
        lines += [
            "----------",
            f"Num unchanged files: {len(free)}",
            f"Num changed files:   {len(changed)} (estimated patch size {c:,} bytes)",
            f"Num new files:       {len(new)} (estimated patch size {n:,} bytes)",
            f"Num files changed but forced to stay compressed by the total recompression limit: {len(constrained)} (estimated patch size {r:,} bytes)",
            f"Estimated total patch size: {n + c + r:,} bytes",
        ]
        return "\n".join(lines)

    return _lists(explained).select("pair_id", kernel(write, "string")(*CATEGORIES, "size_new", "size_changed", "size_resource_constrained").alias("report"))

"""Which base an entry of the new archive is compared with, and what must be uncompressed for that.

Catalogues are DataFrames with pair_id, path, method, crc32, csize, usize,
local_off, digest (of the stored bytes) and, on the new side, params.  Columns
that a catalogue has besides go along.  Sides are structs `old` and `new` from the
first join on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut_lineage

#: What is uncompressed for each recommendation: (old, new).
UNCOMPRESS = {"UNCOMPRESS_OLD": (True, False), "UNCOMPRESS_NEW": (False, True), "UNCOMPRESS_BOTH": (True, True), "UNCOMPRESS_NEITHER": (False, False)}


def last_of_path(catalog: DataFrame) -> DataFrame:
    """Of entries with the same path in an archive the last one in file order."""
    w = Window.partitionBy("pair_id", "path").orderBy(F.col("local_off").desc())
    return catalog.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def paired_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, path, old, new): every path of either archive once, with the last entry of each side in file order or null.

    Both catalogues meet in one exchange by (pair_id, path).
    """
    kinds = {side: F.struct(*c.columns).alias(side) for side, c in (("old", old), ("new", new))}
    empty = {side: F.lit(None).cast(c.select(kinds[side]).schema[side].dataType).alias(side) for side, c in (("old", old), ("new", new))}
    rows = old.select("pair_id", "path", kinds["old"], empty["new"]).unionByName(new.select("pair_id", "path", empty["old"], kinds["new"]))
    return rows.groupBy("pair_id", "path").agg(*(F.max_by(side, F.col(f"{side}.local_off")).alias(side) for side in ("old", "new")))


def _by_role(sides: DataFrame, as_base: Column, as_new: Column) -> DataFrame:
    """Rows of paired_sides() as one row for each side that is there; a window by checksum can then look at both."""
    roles = F.array_compact(F.array(F.when(F.col("old").isNotNull(), as_base), F.when(F.col("new").isNotNull(), as_new)))
    return sides.select("pair_id", F.explode(roles).alias("role")).select("pair_id", "role.*")


def first_of_crc(missed: DataFrame, old: DataFrame) -> DataFrame:
    """The usual finder: for each new entry the first old one in file order with its checksum.

    missed: (pair_id, path, new), old: (pair_id, path, old).  A finder returns
    (pair_id, new, old, matched_by) with at most one row for each of missed.
    """
    first = old.groupBy("pair_id", F.col("old.crc32").alias("crc32")).agg(F.min_by("old", F.col("old.local_off")).alias("old"))
    return missed.withColumn("crc32", F.col("new.crc32")).join(first, ["pair_id", "crc32"]).select("pair_id", "new", "old", F.lit("crc32").alias("matched_by"))


def match_entries(old: DataFrame, new: DataFrame, finder=first_of_crc) -> DataFrame:
    """(pair_id, new, old, matched_by): each new entry that has a base.

    A base has the same path, or else is what the finder finds.  With the usual finder each catalogue is
    read once and rows are exchanged twice, by (pair_id, path) and by (pair_id, checksum).  For
    another finder the sides are written, as three branches read them.
    """
    sides = paired_sides(old, new)
    if finder is first_of_crc:
        kind = sides.schema
        none = {side: F.lit(None).cast(kind[side].dataType) for side in ("old", "new")}
        roles = _by_role(
            sides,
            F.struct(F.col("old.crc32").alias("crc32"), F.col("old").alias("candidate"), none["new"].alias("new"), none["old"].alias("own")),
            F.struct(F.col("new.crc32").alias("crc32"), none["old"].alias("candidate"), F.col("new").alias("new"), F.col("old").alias("own")),
        )
        first = F.min_by("candidate", F.col("candidate.local_off")).over(Window.partitionBy("pair_id", "crc32"))
        based = roles.withColumn("first", first).filter("new is not null and (own is not null or first is not null)")
        return based.select("pair_id", "new", F.coalesce("own", "first").alias("old"), F.when(F.col("own").isNotNull(), "path").otherwise("crc32").alias("matched_by"))
    sides = cut_lineage(sides)
    by_path = sides.filter("old is not null and new is not null").select("pair_id", "new", "old", F.lit("path").alias("matched_by"))
    missed = sides.filter("old is null").select("pair_id", "path", "new")
    return by_path.unionByName(finder(missed, sides.filter("old is not null").select("pair_id", "path", "old")))


def similar_by_crc(new: DataFrame, old: DataFrame) -> DataFrame:
    """(pair_id, base, side, path, rank): entries by checksum, where both archives have it.

    What is similar to a new entry, best first, are the old rows with its base (the
    first old path of the checksum) by rank.  Classes and members are listed rather
    than pairs, which grow with the square of a class.
    """
    role = {side: F.struct(F.lit(side).alias("side"), F.col(f"{side}.crc32").alias("crc32"), F.col("path"), F.col(f"{side}.local_off").alias("local_off")) for side in ("old", "new")}
    rows = _by_role(paired_sides(old, new), role["old"], role["new"])
    same = Window.partitionBy("pair_id", "crc32")
    is_old = F.col("side") == "old"
    rows = rows.withColumns({
        "rank": F.row_number().over(Window.partitionBy("pair_id", "crc32", "side").orderBy("local_off")),
        "base": F.min_by(F.when(is_old, F.col("path")), F.when(is_old, F.col("local_off"))).over(same),
        "n_sides": F.max(is_old.cast("int")).over(same) + F.max((~is_old).cast("int")).over(same),
    })
    return rows.filter("n_sides = 2").select("pair_id", "base", "side", "path", "rank")


def new_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries whose path the old archive doesn't have."""
    return paired_sides(old.select("pair_id", "path", "local_off"), new).filter("old is null").select("new.*")


def is_deflate(side: str) -> Column:
    return (F.col(f"{side}.method") == 8) & (F.col(f"{side}.csize") != F.col(f"{side}.usize"))


def _usable_params() -> Column:
    """Settings found, and of the unwrapped kind that the transform can undo."""
    return F.col("new.params").isNotNull() & F.col("new.params.nowrap")


def classify(pairs: DataFrame) -> DataFrame:
    """pairs with recommendation and reason; the first rule that holds decides."""
    method = {s: F.col(f"{s}.method") for s in ("old", "new")}
    odd = [(method[s] != 0) & ~is_deflate(s) for s in ("old", "new")]
    changed = (F.col("old.csize") != F.col("new.csize")) | (F.col("old.digest") != F.col("new.digest"))
    rules = [
        (is_deflate("new") & ~_usable_params(), "NEITHER", "DEFLATE_UNSUITABLE"),
        (odd[0] | odd[1], "NEITHER", "UNSUITABLE"),
        ((method["old"] == 0) & (method["new"] == 0), "NEITHER", "BOTH_ENTRIES_UNCOMPRESSED"),
        (method["old"] == 0, "NEW", "UNCOMPRESSED_CHANGED_TO_COMPRESSED"),
        (method["new"] == 0, "OLD", "COMPRESSED_CHANGED_TO_UNCOMPRESSED"),
        (changed, "BOTH", "COMPRESSED_BYTES_CHANGED"),
    ]
    chosen = F
    for condition, what, why in rules:
        chosen = chosen.when(condition, F.struct(F.lit(f"UNCOMPRESS_{what}").alias("recommendation"), F.lit(why).alias("reason")))
    chosen = chosen.otherwise(F.struct(F.lit("UNCOMPRESS_NEITHER").alias("recommendation"), F.lit("COMPRESSED_BYTES_IDENTICAL").alias("reason")))
    return pairs.withColumn("__r", chosen).withColumns({"recommendation": F.col("__r.recommendation"), "reason": F.col("__r.reason")}).drop("__r").transform(with_flags)


def with_flags(pairs: DataFrame) -> DataFrame:
    """unc_old and unc_new from the recommendation."""
    return pairs.withColumns({f"unc_{side}": F.col("recommendation").isin([r for r, flags in UNCOMPRESS.items() if flags[i]]) for i, side in enumerate(("old", "new"))})


def plan_pairs(old: DataFrame, new: DataFrame, *modifiers, finder=first_of_crc) -> DataFrame:
    """Matched, classified and, by each modifier in turn, rewritten pairs.

    A modifier reads the pairs more than once, so they are written before each.
    """
    pairs = classify(match_entries(old, new, finder))
    for m in modifiers:
        pairs = m(cut_lineage(pairs))
    return pairs

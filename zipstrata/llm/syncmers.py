"""Document fingerprints from closed syncmers, in built-in expressions only.

Letters are words.  A k-mer of words is a closed syncmer if, of its inner s-mers,
the one with the least hash stands first or last.  Whether a k-mer is chosen
depends on its own words alone, so a passage keeps its chosen k-mers wherever it stands
and whatever surrounds it.  The fingerprint is the sorted set of the `size` least
31-bit hashes of the chosen k-mers, in hex; two fingerprints' likeness is the share that both
hold of the `size` least hashes of either, which estimates the Jaccard similarity of the
sets of syncmers.

anchors() gives the chosen k-mers with their positions instead, for matching passages place by place.

The next document (by falling id) is found without a global sort: rows are put
into blocks of neighbours, at most 65,536 of them, cut at quantiles of a sample, so neither
distant nor clustered nor missing ids make a large block.  Blocks are ordered within, and each block's first
row is also sent to the block before; the cuts and the table of first rows (one a block) are
all that is broadcast.  Texts are shuffled once.  (Only rows alike in id and text can't be parted.)

Edge cases: null counts as the empty text; texts without a syncmer (fewer than k
words, mostly) are fingerprinted by the hash of their whole text; rows with the
same id, or none, follow each other by a hash of the text; a null id comes last; the last
document's next is the first, a sole document's itself; texts of any length are read
whole; only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

K, S = 5, 2  # words of a k-mer and of its inner s-mers; the expressions below are written for these


def _hashes(text: str) -> Column:
    return F.transform(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""), lambda w: F.xxhash64(w))


def _inner(h: str) -> Column:
    """Hashes of the s-mers, from those of the words."""
    return F.expr(f"transform(slice({h}, 1, greatest(size({h}) - 1, 0)), (x, i) -> xxhash64(x, {h}[i + 1]))")


def _chosen(h: str, s: str, found: str) -> Column:
    """`found` (an expression of i and {hash}) of the k-mers whose least s-mer is the first or last."""
    value = f"cast(shiftrightunsigned(xxhash64(x, {s}[i + 2], {h}[i + 4]), 33) as int)"
    return F.expr(f"""array_compact(transform(slice({s}, 1, greatest(size({s}) - 3, 0)), (x, i) ->
        if(least(x, {s}[i + 3]) <= least({s}[i + 1], {s}[i + 2]), {found.replace('{hash}', value)}, null)))""")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, anchors array<struct<at,hash>>): the chosen k-mers of every row by the place of their first word."""
    d = docs.select(F.col(id_col), _hashes(F.coalesce(text_col, F.lit(""))).alias("words"))
    d = d.withColumn("inner", _inner("words"))
    return d.select(id_col, _chosen("words", "inner", "named_struct('at', i, 'hash', {hash})").alias("anchors"))


def with_sketch(df: DataFrame, text: str, out: str, size: int = 64) -> DataFrame:
    """df with the column out: array<int>, the sketch of the string column text (not null)."""
    h, s, t = f"__h_{out}", f"__s_{out}", f"__t_{out}"
    d = df.withColumn(h, _hashes(text)).withColumn(s, _inner(h))
    d = d.withColumn(t, _chosen(h, s, "{hash}"))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(text), 33).cast("int"))
    d = d.withColumn(out, F.when(F.size(t) == 0, whole).otherwise(F.slice(F.sort_array(F.array_distinct(t)), 1, size)))
    return d.drop(h, s, t)


def fingerprint(sketch: str) -> Column:
    """A sketch as hex digits, eight a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str, size: int = 64) -> Column:
    """0 to 1; 1 for equal sketches."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(a, b), least)) / F.size(least)


def _cuts(keyed: DataFrame, blocks: int, sample_a_block: int = 4) -> Column:
    """Array of keys that part the rows into blocks of about the same size: every so-manieth of a sample drawn by a hash."""
    n = keyed.count()
    share = min(1.0, sample_a_block * blocks / max(n, 1))
    drawn = keyed.filter(F.pmod(F.xxhash64("k.*"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1) if share < 1 else keyed
    found = sorted(tuple(r) for r in drawn.select("k.*").limit(2 * sample_a_block * blocks + 100).collect())
    cuts = found[:: max(1, len(found) // blocks)][1:]
    rows = ",".join(f'{{"none":{str(a).lower()},"id":{b},"tie":{c}}}' for a, b, c in cuts)
    return F.from_json(F.lit(f"[{rows}]"), "array<struct<none:boolean,id:bigint,tie:bigint>>")


def _block_of(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts are not above the key, by halving."""
    halves = F.array(*(F.lit(1 << k) for k in range(16, -1, -1)))
    return F.aggregate(halves, F.lit(0), lambda place, n: F.when(F.get(cuts, place + n - 1) <= key, place + n).otherwise(place))


def with_next(df: DataFrame, id_col: str, tie: Column, columns: list[str], rows_a_block: int = 256, most_blocks: int = 65_536) -> DataFrame:
    """df with next_<column>: the columns of the row after it by falling id (nulls last, then by tie); after the last row comes the first."""
    # rising keys are falling ids
    key = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(0)).alias("id"), tie.cast("long").alias("tie"))
    keyed = df.withColumn("k", key)
    blocks = max(1, min(most_blocks, df.count() // rows_a_block))
    block = _block_of(_cuts(keyed.select("k"), blocks), F.col("k"))
    heads = keyed.select(block.alias("b"), "k").groupBy("b").agg(F.min("k").alias("head"))
    every = Window.partitionBy(F.lit(0))  # of a row a block
    heads = heads.select("head", F.coalesce(F.lag("b").over(every.orderBy("b")), F.max("b").over(every)).alias("to"))
    placed = keyed.join(F.broadcast(heads), F.col("k") == F.col("head"), "left")  # at most most_blocks + 1 rows
    places = F.array(F.struct(block.alias("b"), F.lit(False).alias("copy")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("b"), F.lit(True).alias("copy"))))
    placed = placed.withColumn("place", F.explode(F.array_compact(places)))
    order = Window.partitionBy("place.b").orderBy("place.copy", "k")
    d = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return d.filter("not place.copy").select(*df.columns, *(f"next_{c}" for c in columns))


def edited_fingerprints(docs: DataFrame, size: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the first code points of the next document in place of
    its own last half.
    """
    d = with_sketch(docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text")), "text", "sketch", size)
    d = with_next(d, id_col, F.xxhash64("text"), ["text", "sketch"])
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")).drop("text", "next_text")
    d = with_sketch(d, "edited", "edited_sketch", size)
    return d.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch", size).alias("near_edited"), likeness("sketch", "next_sketch", size).alias("near_next"))


def op5_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))

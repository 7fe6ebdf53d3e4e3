"""The archive engine's queries over the driver's tables, and the same in SQL.

Versions are those of sources.versions; SQL stands for checksums with md5.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import proofs
from .functions import bindiff, codec, text
from .functions.kernels import kernel
from .operators import engine
from .plans import explain, layout, limits, matching
from .sources import versions as v
from .sources.zipfiles import catalog

TRL, BLOB = 200_000, 1_100_000  # limits of the budget queries


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = v.documents(spark, sf_dir)
    return docs, v.entries(docs, "old"), v.entries(docs, "new")


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", F.col("old.path").alias("old_path"), F.col("new.path").alias("new_path"), "matched_by", "recommendation", "reason", "unc_old", "unc_new")


def plan_reasons(spark, sf_dir):
    """Base, recommendation and reason of every new entry that has a base."""
    _, old, new = _both(spark, sf_dir)
    return _shown(matching.plan_pairs(old, new))


def reason_counts(spark, sf_dir):
    """Pairs by reason."""
    return plan_reasons(spark, sf_dir).groupBy("recommendation", "reason").agg(F.count("*").alias("pairs"))


def catalog_dedupe(spark, sf_dir):
    """Of entries with one path the last in file order."""
    rows = v.documents(spark, sf_dir).select(F.expr("concat('a', doc_id div 1000)").alias("pair_id"), F.expr("concat(lang, '/', n_chars % 20)").alias("path"), F.col("doc_id").alias("local_off"))
    return matching.last_of_path(rows)


def rename_matches(spark, sf_dir):
    """New entries matched by checksum alone."""
    _, old, new = _both(spark, sf_dir)
    return matching.match_entries(old, new).filter("matched_by = 'crc32'").select("pair_id", F.col("new.path").alias("new_path"), F.col("old.path").alias("old_path"))


def similar_entries(spark, sf_dir):
    """Old and new entries with a common checksum, ranked."""
    _, old, new = _both(spark, sf_dir)
    return matching.similar_by_crc(new, old)


def new_only_entries(spark, sf_dir):
    """New entries whose path is new."""
    _, old, new = _both(spark, sf_dir)
    return matching.new_only(old, new).select("pair_id", "path", "usize")


def recompression_limit(spark, sf_dir):
    """The plan under a limit on recompressed bytes."""
    _, old, new = _both(spark, sf_dir)
    return _shown(matching.plan_pairs(old, new, limits.total_recompression(TRL)))


def old_blob_limit(spark, sf_dir):
    """The plan under a limit on the delta-friendly old blob."""
    docs, old, new = _both(spark, sf_dir)
    return _shown(matching.plan_pairs(old, new, limits.old_blob_size(BLOB, v.archive_lengths(docs))))


def limit_chain(spark, sf_dir):
    """Both limits, one after the other."""
    docs, old, new = _both(spark, sf_dir)
    return _shown(matching.plan_pairs(old, new, limits.total_recompression(TRL), limits.old_blob_size(BLOB, v.archive_lengths(docs))))


def distinct_ranges(spark, sf_dir):
    """Old ranges to uncompress, once each."""
    docs, old, new = _both(spark, sf_dir)
    places = v.spans(docs).select("pair_id", "path", F.col("offset").alias("data_off"))
    pairs = matching.plan_pairs(old.join(places, ["pair_id", "path"]), new.withColumn("data_off", F.lit(0).cast("long")))
    return layout.ranges(pairs).filter("side = 'old'").select("pair_id", "offset", "length")


def _deflated(docs: DataFrame) -> DataFrame:
    return v.spans(docs).filter("is_deflate").select("pair_id", "offset", "length", "usize")


def gap_ranges(spark, sf_dir):
    """Bytes copied between and behind the ranges."""
    docs = v.documents(spark, sf_dir)
    return layout.gaps(_deflated(docs), v.archive_lengths(docs))


def inverse_ranges(spark, sf_dir):
    """Where ranges lie once uncompressed."""
    return layout.inverse(_deflated(v.documents(spark, sf_dir))).select("pair_id", "offset", "length")


def blob_sizes(spark, sf_dir):
    """Sizes of the delta-friendly blobs."""
    docs = v.documents(spark, sf_dir)
    return layout.blob_sizes(_deflated(docs), v.archive_lengths(docs))


def range_overlap_check(spark, sf_dir):
    """Ranges that begin before the one ahead of them ends."""
    stretched = v.spans(v.documents(spark, sf_dir)).select("pair_id", "offset", F.expr("length + local_off % 3 * 50").alias("length"))
    return layout.overlaps(stretched).select("pair_id", "offset", "length", "previous_end")


def next_entry_bound(spark, sf_dir):
    """Where each entry must end."""
    docs = v.documents(spark, sf_dir)
    e = v.spans(docs).select("pair_id", "path", F.col("offset").alias("local_off"))
    return layout.next_bounds(e, v.archive_lengths(docs).withColumnRenamed("length", "dir_off"))


def _explained(spark, sf_dir) -> DataFrame:
    """Explanations with the content's bytes for the size of a patch's part."""
    _, old, new = _both(spark, sf_dir)
    fresh = matching.new_only(old, new).select("pair_id", "path", F.lit(True).alias("is_new"), F.lit(None).cast("string").alias("reason"), F.col("usize").alias("size_in_patch"))
    pairs = matching.plan_pairs(old, new, limits.total_recompression(TRL))
    rest = pairs.select("pair_id", F.col("new.path").alias("path"), F.lit(False).alias("is_new"), "reason", F.when(explain.is_free(), 0).otherwise(F.col("new.usize")).cast("long").alias("size_in_patch"))
    return fresh.unionByName(rest)


def explain_category_totals(spark, sf_dir):
    """Entries and bytes by category."""
    return explain.totals(_explained(spark, sf_dir))


def explain_summary(spark, sf_dir):
    """Counts, sizes and the total of each pair."""
    return explain.summary(_explained(spark, sf_dir)).select("pair_id", "n_new", "n_changed", "n_unchanged_or_free", "n_resource_constrained", "size_new", "size_changed", "size_resource_constrained", "size_total")


def explain_sorted(spark, sf_dir):
    """Explanations with category, by path."""
    return _explained(spark, sf_dir).withColumn("category", explain.category()).orderBy("pair_id", "path", "is_new")


def explain_text_report(spark, sf_dir):
    """The plain-text report of each pair."""
    return explain.text_report(_explained(spark, sf_dir))


def explain_json_report(spark, sf_dir):
    """The JSON reports of each pair, proper and in the older notation."""
    e = _explained(spark, sf_dir)
    return explain.json_report(e).join(explain.legacy_json_report(e).withColumnRenamed("report", "legacy"), "pair_id")


def explain_sizes(spark, sf_dir):
    """Explanations of real zip archives, with the sizes of deflated deltas."""
    found = explain.explain_archives(*v.both_archives(v.documents(spark, sf_dir)), limits.total_recompression(TRL))  # made once: catalogues and stored bytes are read from them
    return found.select("pair_id", F.col("path").cast("string").alias("path"), "is_new", "reason", "size_in_patch")


def params_text(spark, sf_dir):
    """All settings as text and read again."""
    p = text.all_params(spark).withColumn("p", F.struct("level", "strategy", "nowrap")).withColumn("params", text.format_params("p"))
    return p.withColumn("again", text.parse_params("params")).select("level", "strategy", "nowrap", "params", (F.col("again") == F.col("p")).alias("same"))


def sha256_content(spark, sf_dir):
    """SHA-256 of every document."""
    return v.documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))


def byte_ranges(spark, sf_dir):
    """The second ten bytes of every document."""
    d = v.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("b"))
    return d.select("doc_id", F.hex(F.substring("b", 11, 10)).alias("part"), F.octet_length("b").cast("long").alias("n_bytes"))


def zip_catalog(spark, sf_dir):
    """Entries of real zip archives in file order."""
    c = catalog(v.archives(v.documents(spark, sf_dir), "old"))
    return c.select("pair_id", "path_text", "method", "usize")


def deflate_roundtrip(spark, sf_dir):
    """Documents deflated and inflated."""
    d = v.documents(spark, sf_dir).select("doc_id", codec.deflate_column(F.col("text").cast("binary"), 6).alias("deflated"))
    return d.select("doc_id", F.md5(codec.inflate_column("deflated")).alias("content_md5"))


def divine_params(spark, sf_dir):
    """Settings found for documents deflated at level 6; the bytes are made again with them."""

    def again(plain):  # one worker a task; the bytes stay there
        raw = None if plain is None else codec.deflate(plain, 6)
        p = None if raw is None else codec.divine(raw)
        return p is not None, None if p is None else codec.deflate(plain, *p) == raw

    d = v.documents(spark, sf_dir).select("doc_id", kernel(again, "struct<found:boolean,same:boolean>")(F.col("text").cast("binary")).alias("x"))
    return d.select("doc_id", "x.found", "x.same")


def delta_friendly_blob(spark, sf_dir):
    """A stored and a deflated copy of each document behind each other; the second uncompressed in place."""
    plain = F.col("text").cast("binary")
    d = v.documents(spark, sf_dir).select("doc_id", plain.alias("plain"), codec.deflate_column(plain, 6).alias("deflated"))
    ops = F.array(F.struct(F.octet_length("plain").cast("long").alias("offset"), F.octet_length("deflated").cast("long").alias("length")))
    return d.select("doc_id", F.md5(codec.delta_friendly_column(F.concat("plain", "deflated"), ops)).alias("blob_md5"))


def _old_new(spark, sf_dir) -> DataFrame:
    return v.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("old"), F.expr("cast(concat('v2 ', text, ' v2') as binary)").alias("new"))


def bsdiff_roundtrip(spark, sf_dir):
    """Deltas of changed documents, applied."""
    again = kernel(lambda a, b: None if a is None or b is None else hashlib.md5(bindiff.apply_delta(a, bindiff.write_delta(a, b))).hexdigest(), "string")  # one worker a task; the bytes stay there
    return _old_new(spark, sf_dir).select("doc_id", again("old", "new").alias("new_md5"))


def bsdiff_entries(spark, sf_dir):
    """Bytes that the entries of each delta make, added up from its control numbers."""
    entries = kernel(lambda a, b: None if a is None or b is None else [e[:3] for e in bindiff.read_delta(bindiff.write_delta(a, b))], bindiff.ENTRIES)  # one worker a task; the delta stays there
    d = _old_new(spark, sf_dir).withColumn("e", entries("old", "new"))
    return d.select("doc_id", F.expr("aggregate(e, 0L, (a, x) -> a + x.diff + x.extra)").alias("made"))


def gdiff_apply(spark, sf_dir):
    """A copy of the whole base between two pieces of inline data."""
    base = F.col("text").cast("binary")
    patch = F.concat(F.lit(bytearray(bindiff.GDIFF_MAGIC + b"\x03abc\xfe\0\0\0\0")), F.unhex(F.lpad(F.hex(F.octet_length("text")), 8, "0")), F.lit(bytearray(b"\x02yz\0")))
    return v.documents(spark, sf_dir).select("doc_id", F.md5(bindiff.apply_gdiff_column(base, patch)).alias("out_md5"))


def patch_roundtrip(spark, sf_dir):
    """Patches between real zip archives, applied: the new archives byte for byte."""
    docs = v.documents(spark, sf_dir)
    old, new = v.both_archives(docs)  # made for this query, and read by each step
    made = engine.apply(old, engine.generate(old, new)).withColumnRenamed("content", "made")
    n = v.contents(docs, "new", 50).groupBy("pair_id").agg(F.count("*").alias("n_entries"))
    return made.join(new, "pair_id").join(n, "pair_id").select("pair_id", (F.col("made") == F.col("content")).alias("identical"), "n_entries")


def zlib_fingerprints(spark, sf_dir):
    """Deflate fingerprints as the executors make them."""
    return codec.fingerprints(spark).select("level", "strategy", "nowrap", "sha256")


QUERIES = {f.__name__: f for f in (
    plan_reasons, reason_counts, catalog_dedupe, rename_matches, similar_entries, new_only_entries, recompression_limit, old_blob_limit, limit_chain,
    distinct_ranges, gap_ranges, inverse_ranges, blob_sizes, range_overlap_check, next_entry_bound, explain_category_totals, explain_summary,
    explain_sorted, explain_text_report, explain_json_report, explain_sizes, params_text, sha256_content, byte_ranges, zip_catalog, deflate_roundtrip, divine_params,
    delta_friendly_blob, bsdiff_roundtrip, bsdiff_entries, gdiff_apply, patch_roundtrip, zlib_fingerprints,
)} | proofs.QUERIES

# ---------------------------------------------------------------- the same in SQL

_ENTRIES = """
old0 AS (SELECT 'a' || (doc_id // 1000) AS pair_id, doc_id, 'doc/' || doc_id AS path, coalesce(text, '') AS content, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 6 END AS level FROM documents),
new0 AS (SELECT 'a' || (doc_id // 1000) AS pair_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE 'doc/' END || doc_id AS path,
  coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' v2' ELSE '' END AS content, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 6 END AS level FROM documents),
both0 AS (SELECT 'old' AS side, * FROM old0 UNION ALL SELECT 'new', * FROM new0),
both1 AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 12 WHEN level = 0 THEN 0 ELSE 8 END AS method, CAST(strlen(content) AS BIGINT) AS usize, md5(content) AS crc FROM both0),
both2 AS (SELECT *, CASE WHEN method = 0 THEN usize ELSE usize - usize // 2 END AS csize, md5(content || '#' || method) AS digest, doc_id % 11 <> 0 AND level > 0 AS known FROM both1),
o AS (SELECT * FROM both2 WHERE side = 'old'), n AS (SELECT * FROM both2 WHERE side = 'new'),
m AS (
  SELECT n.*, o.path AS o_path, o.method AS o_method, o.usize AS o_usize, o.csize AS o_csize, o.digest AS o_digest, o.crc AS o_crc, 'path' AS matched_by FROM n JOIN o USING (pair_id, path)
  UNION ALL
  SELECT n.*, f.path, f.method, f.usize, f.csize, f.digest, f.crc, 'crc32' FROM n JOIN (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pair_id, crc ORDER BY doc_id) = 1) f
    ON n.pair_id = f.pair_id AND n.crc = f.crc WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pair_id = n.pair_id AND o.path = n.path)),
r AS (SELECT *, CASE WHEN method = 8 AND csize <> usize AND NOT known THEN 'DEFLATE_UNSUITABLE'
  WHEN (o_method <> 0 AND NOT (o_method = 8 AND o_csize <> o_usize)) OR (method <> 0 AND NOT (method = 8 AND csize <> usize)) THEN 'UNSUITABLE'
  WHEN o_method = 0 AND method = 0 THEN 'BOTH_ENTRIES_UNCOMPRESSED' WHEN o_method = 0 THEN 'UNCOMPRESSED_CHANGED_TO_COMPRESSED'
  WHEN method = 0 THEN 'COMPRESSED_CHANGED_TO_UNCOMPRESSED' WHEN o_csize <> csize OR o_digest <> digest THEN 'COMPRESSED_BYTES_CHANGED' ELSE 'COMPRESSED_BYTES_IDENTICAL' END AS reason FROM m),
p AS (SELECT *, CASE reason WHEN 'UNCOMPRESSED_CHANGED_TO_COMPRESSED' THEN 'UNCOMPRESS_NEW' WHEN 'COMPRESSED_CHANGED_TO_UNCOMPRESSED' THEN 'UNCOMPRESS_OLD'
  WHEN 'COMPRESSED_BYTES_CHANGED' THEN 'UNCOMPRESS_BOTH' ELSE 'UNCOMPRESS_NEITHER' END AS recommendation,
  reason IN ('COMPRESSED_CHANGED_TO_UNCOMPRESSED', 'COMPRESSED_BYTES_CHANGED') AS unc_old, reason IN ('UNCOMPRESSED_CHANGED_TO_COMPRESSED', 'COMPRESSED_BYTES_CHANGED') AS unc_new FROM r)"""
_PLACES = """
s AS (SELECT pair_id, path, doc_id, csize AS length, usize, method = 8 AND csize <> usize AS is_deflate,
  CAST(sum(csize + 40) OVER (PARTITION BY pair_id ORDER BY doc_id) - csize AS BIGINT) AS "offset" FROM o),
len AS (SELECT pair_id, CAST(sum(csize + 40) + 100 AS BIGINT) AS length FROM o GROUP BY pair_id)"""
_SHOWN = "SELECT pair_id, o_path AS old_path, path AS new_path, matched_by, recommendation, reason, unc_old, unc_new FROM"


def _walk(k: int, source: str, flag: str, size: str, cost: str, budget: str) -> str:
    """CTEs of a budget walk over `source`; the result is p<k>."""
    return f"""
w{k} AS (SELECT pair_id, path, {cost} AS cost, {budget} AS budget, row_number() OVER (PARTITION BY pair_id ORDER BY {size} DESC, path DESC) AS rn FROM {source} WHERE {flag}),
t{k} AS (SELECT pair_id, path, rn, cost <= budget AS kept, CASE WHEN cost <= budget THEN budget - cost ELSE budget END AS rest FROM w{k} WHERE rn = 1
  UNION ALL SELECT w.pair_id, w.path, w.rn, w.cost <= t.rest, CASE WHEN w.cost <= t.rest THEN t.rest - w.cost ELSE t.rest END FROM t{k} t JOIN w{k} w ON w.pair_id = t.pair_id AND w.rn = t.rn + 1),
p{k} AS (SELECT x.* EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'UNCOMPRESS_NEITHER' ELSE recommendation END AS recommendation, CASE WHEN hit THEN 'RESOURCE_CONSTRAINED' ELSE reason END AS reason,
  unc_old AND NOT hit AS unc_old, unc_new AND NOT hit AS unc_new)
  FROM (SELECT q.*, coalesce(NOT t.kept, FALSE) AS hit FROM {source} q LEFT JOIN t{k} t ON t.pair_id = q.pair_id AND t.path = q.path) x)"""


_TRL = _walk(1, "p", "unc_new", "usize", "usize", str(TRL))


def _blob(k: int, source: str) -> str:
    return _walk(k, source, "unc_old", "o_usize", "o_usize - o_csize", f"{BLOB} - (SELECT length FROM len WHERE len.pair_id = {source}.pair_id)")


_EXPLAINED = """
e AS (SELECT pair_id, path, TRUE AS is_new, CAST(NULL AS VARCHAR) AS reason, usize AS size_in_patch FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pair_id = n.pair_id AND o.path = n.path)
  UNION ALL SELECT pair_id, path, FALSE, reason, CASE WHEN reason = 'COMPRESSED_BYTES_IDENTICAL' OR (o_crc = crc AND o_usize = usize) THEN 0 ELSE usize END FROM p1),
c AS (SELECT *, CASE WHEN is_new THEN 'new' WHEN reason = 'RESOURCE_CONSTRAINED' THEN 'resource_constrained' WHEN size_in_patch > 0 THEN 'changed' ELSE 'unchanged_or_free' END AS category FROM e)"""
_SPANS = f"WITH {_ENTRIES}, {_PLACES}, d AS (SELECT * FROM s WHERE is_deflate)"

ORACLES = {
    "plan_reasons": f"WITH {_ENTRIES} {_SHOWN} p",
    "reason_counts": f"WITH {_ENTRIES} SELECT recommendation, reason, count(*) AS pairs FROM p GROUP BY ALL",
    "catalog_dedupe": "SELECT pair_id, path, max(doc_id) AS local_off FROM (SELECT 'a' || (doc_id // 1000) AS pair_id, lang || '/' || (n_chars % 20) AS path, doc_id FROM documents) GROUP BY pair_id, path",
    "rename_matches": f"WITH {_ENTRIES} SELECT pair_id, path AS new_path, o_path AS old_path FROM m WHERE matched_by = 'crc32'",
    "similar_entries": f"""WITH {_ENTRIES}, k AS (SELECT pair_id, side, crc, path, CAST(row_number() OVER (PARTITION BY side, pair_id, crc ORDER BY doc_id) AS INTEGER) AS rank FROM both2)
        SELECT k.pair_id, b.path AS base, k.side, k.path, k.rank FROM k JOIN k b ON b.pair_id = k.pair_id AND b.crc = k.crc AND b.side = 'old' AND b.rank = 1
        WHERE EXISTS (SELECT 1 FROM n WHERE n.pair_id = k.pair_id AND n.crc = k.crc)""",
    "new_only_entries": f"WITH {_ENTRIES} SELECT pair_id, path, usize FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pair_id = n.pair_id AND o.path = n.path)",
    "recompression_limit": f"WITH RECURSIVE {_ENTRIES}, {_TRL} {_SHOWN} p1",
    "old_blob_limit": f"WITH RECURSIVE {_ENTRIES}, {_PLACES}, {_blob(2, 'p')} {_SHOWN} p2",
    "limit_chain": f"WITH RECURSIVE {_ENTRIES}, {_PLACES}, {_TRL}, {_blob(2, 'p1')} {_SHOWN} p2",
    "distinct_ranges": f"WITH {_ENTRIES}, {_PLACES} SELECT DISTINCT s.pair_id, s.\"offset\", s.length FROM p JOIN s ON s.pair_id = p.pair_id AND s.path = p.o_path WHERE unc_old",
    "gap_ranges": f"""{_SPANS}, g AS (SELECT pair_id, coalesce(lag("offset" + length) OVER (PARTITION BY pair_id ORDER BY "offset"), 0) AS a, "offset" AS z FROM d
        UNION ALL SELECT len.pair_id, coalesce(max(d."offset" + d.length), 0), len.length FROM len LEFT JOIN d ON d.pair_id = len.pair_id GROUP BY len.pair_id, len.length)
        SELECT pair_id, a AS "offset", z - a AS length FROM g WHERE z > a""",
    "inverse_ranges": f'{_SPANS} SELECT pair_id, CAST("offset" + coalesce(sum(usize - length) OVER (PARTITION BY pair_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", usize AS length FROM d',
    "blob_sizes": f"{_SPANS} SELECT len.pair_id, CAST(len.length + coalesce(sum(d.usize - d.length), 0) AS BIGINT) AS blob_size FROM len LEFT JOIN d ON d.pair_id = len.pair_id GROUP BY len.pair_id, len.length",
    "range_overlap_check": f"""WITH {_ENTRIES}, {_PLACES}, x AS (SELECT pair_id, "offset", length + doc_id % 3 * 50 AS length FROM s),
        y AS (SELECT *, lag("offset" + length) OVER (PARTITION BY pair_id ORDER BY "offset") AS previous_end FROM x) SELECT * FROM y WHERE "offset" < previous_end""",
    "next_entry_bound": f'WITH {_ENTRIES}, {_PLACES} SELECT s.pair_id, path, "offset" AS local_off, coalesce(lead("offset") OVER (PARTITION BY s.pair_id ORDER BY "offset"), len.length) AS bound FROM s JOIN len USING (pair_id)',
    "explain_category_totals": f"WITH RECURSIVE {_ENTRIES}, {_TRL}, {_EXPLAINED} SELECT pair_id, category, count(*) AS entries, CAST(sum(size_in_patch) AS BIGINT) AS size FROM c GROUP BY pair_id, category",
    "explain_summary": f"WITH RECURSIVE {_ENTRIES}, {_TRL}, {_EXPLAINED} SELECT pair_id, " + ", ".join(f"count(*) FILTER (category = '{k}') AS n_{k}" for k in explain.CATEGORIES) + ", "
    + ", ".join(f"CAST(coalesce(sum(size_in_patch) FILTER (category = '{k}'), 0) AS BIGINT) AS size_{k}" for k in ("new", "changed", "resource_constrained")) + ", CAST(sum(size_in_patch) AS BIGINT) AS size_total FROM c GROUP BY pair_id",
    "explain_sorted": f"WITH RECURSIVE {_ENTRIES}, {_TRL}, {_EXPLAINED} SELECT pair_id, path, is_new, reason, size_in_patch, category FROM c ORDER BY pair_id, path, is_new",
    "params_text": """SELECT CAST(l AS INTEGER) AS level, CAST(s AS INTEGER) AS strategy, w AS nowrap, 'level=' || l || ',strategy=' || s || ',nowrap=' || CASE WHEN w THEN 'true' ELSE 'false' END AS params, TRUE AS same
        FROM range(1, 10) a(l), range(0, 3) b(s), (VALUES (TRUE), (FALSE)) c(w)""",
    "sha256_content": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "byte_ranges": "SELECT doc_id, hex(encode(text))[21:40] AS part, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
    "zip_catalog": "SELECT 'a' || (doc_id // 50) AS pair_id, 'doc/' || doc_id AS path_text, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 8 END AS method, CAST(strlen(text) AS BIGINT) AS usize FROM documents",
    "deflate_roundtrip": "SELECT doc_id, md5(text) AS content_md5 FROM documents",
    "divine_params": "SELECT doc_id, TRUE AS found, TRUE AS same FROM documents",
    "delta_friendly_blob": "SELECT doc_id, md5(text || text) AS blob_md5 FROM documents",
    "bsdiff_roundtrip": "SELECT doc_id, md5('v2 ' || text || ' v2') AS new_md5 FROM documents",
    "bsdiff_entries": "SELECT doc_id, CAST(strlen(text) + 6 AS BIGINT) AS made FROM documents",
    "gdiff_apply": "SELECT doc_id, md5('abc' || text || 'yz') AS out_md5 FROM documents",
    "patch_roundtrip": "SELECT 'a' || (doc_id // 50) AS pair_id, TRUE AS identical, count(*) AS n_entries FROM documents GROUP BY ALL",
    "zlib_fingerprints": "SELECT * FROM (VALUES " + ", ".join(f"({level}, {strategy}, {nowrap}, '{sha}')" for level, strategy, nowrap, sha in codec.baseline()) + ") t(level, strategy, nowrap, sha256)",
} | proofs.oracles(f"{_ENTRIES}, {_TRL}, {_EXPLAINED}")

"""More queries of the archive engine, each with SQL that tells a wrong operator from a right one.

Real zip archives are those of sources.versions: 50 documents each; the new ones list their entries in
reverse, some moved, some with other content, some stored instead of deflated or the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut_lineage
from .functions import bindiff, codec, text
from .functions.kernels import kernel
from .operators import engine
from .plans import explain
from .sources import versions as v
from .sources.patchfiles import read_patch_column, try_read_patch_column
from .sources.zipfiles import catalog

LONGEST = 64  # letters up to which longest_match tells a match's length
BLANKS = " " * 200


def _archive(docs: DataFrame, side: str) -> DataFrame:
    """Archives of one version; blanks behind each content make its deflated bytes fewer than its own, whatever it is."""
    return v.zipped(v.contents(docs, side, 50).withColumn("content", F.concat("content", F.lit(BLANKS))), side == "new")


def _archives(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return v.both_archives(v.documents(spark, sf_dir), 50, BLANKS)


def longest_match(spark, sf_dir):
    """How many of each document's first letters, up to 64, the next document holds anywhere."""
    d = v.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")

    def letters(old, new):
        _, n = bindiff.Matcher(old.encode(), new.encode()).longest(0, 1)
        return min(LONGEST, len(new.encode()[: int(n[0])].decode(errors="ignore")))

    return pairs.select("doc_id", kernel(letters, "int")("old", "text").alias("letters"))


def delta_literals(spark, sf_dir):
    """Whether a delta of a text with something put before and behind it has next to nothing but that as new bytes; null for short texts."""
    d = v.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.col("text").cast("binary").alias("old"), F.concat(F.lit("version 2: "), "text", F.lit(" (2)")).cast("binary").alias("new"))
    entries = kernel(lambda a, b: [e[:3] for e in bindiff.read_delta(bindiff.write_delta(a, b))], bindiff.ENTRIES)  # one worker a task; the delta stays there
    e = d.withColumn("e", entries("old", "new"))
    literal = F.expr("aggregate(e, 0L, (a, x) -> a + x.extra)")
    return e.select("doc_id", F.when(F.octet_length("old") >= 64, literal <= 32).alias("few_literals"), F.expr("aggregate(e, 0L, (a, x) -> a + x.diff + x.extra)").alias("made"))


def budget_matches(spark, sf_dir):
    """Matches of each text with itself: none pays by its length, one does once the budget of looked-at letters is spent."""
    d = v.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("t"))
    count = lambda budget: kernel(lambda t: 0 if t is None else len(list(bindiff.matches(t, t, budget=budget))), "int")
    return d.select("doc_id", count(bindiff.MATCH_BUDGET)("t").alias("by_length"), count(1)("t").alias("by_budget"))


def signed_numbers(spark, sf_dir):
    """Numbers around zero in the delta's notation, and read again."""
    d = v.documents(spark, sf_dir).select("doc_id", (F.col("doc_id") - 300).alias("n"))
    packed = kernel(bindiff.pack_long, "binary")("n")
    return d.withColumn("raw", packed).select("doc_id", F.hex("raw").alias("raw"), (kernel(lambda r: bindiff.unpack_long(bytes(r)), "long")("raw") == F.col("n")).alias("same"))


def zip_directory(spark, sf_dir):
    """Offsets, sizes and checksums of archives whose entries are all stored."""
    rows = v.contents(v.documents(spark, sf_dir), "old", 50).withColumn("level", F.lit(0))
    c = catalog(v.zipped(rows, newest_first=False))
    plain = rows.select("pair_id", F.col("path").alias("path_text"), F.crc32(F.col("content").cast("binary")).alias("content_crc32"))
    return c.join(plain, ["pair_id", "path_text"]).select("pair_id", "path_text", "csize", "local_off", "data_off", (F.col("crc32") == F.col("content_crc32")).alias("crc_ok"))


def zip_params(spark, sf_dir):
    """Deflate settings found for the entries of real archives."""
    c = catalog(_archive(v.documents(spark, sf_dir), "new"), with_params=True)
    return c.select("pair_id", "path_text", text.format_params("params").alias("params"))


def archive_plan(spark, sf_dir):
    """Base, recommendation and reason of the entries of real archives."""
    p = engine.patch_plan(*_archives(spark, sf_dir))
    return p.select("pair_id", F.col("old.path_text").alias("old_path"), F.col("new.path_text").alias("new_path"), "matched_by", "recommendation", "reason")


def patch_ranges(spark, sf_dir):
    """What patches of real archives list: ranges of both sides, settings, sizes."""
    old, new = _archives(spark, sf_dir)
    p = cut_lineage(engine.generate(old, new)).withColumn("plan", read_patch_column("patch"))  # written first: two branches read patches, and so would a column chained to them
    grown = catalog(old).select("pair_id", F.col("data_off").alias("offset"), (F.col("usize") - F.col("csize")).alias("grown"))
    grown = p.select("pair_id", F.explode("plan.old_ops").alias("op")).select("pair_id", "op.offset").join(grown, ["pair_id", "offset"]).groupBy("pair_id").agg(F.sum("grown").alias("grown"))
    sized = p.join(old, "pair_id").join(grown, "pair_id", "left")
    return sized.select(
        "pair_id",
        F.size("plan.old_ops").alias("n_old"),
        F.size("plan.new_ops").alias("n_new"),
        F.size(F.filter("plan.new_ops", lambda x: (x["level"] == 6) & (x["strategy"] == 0) & x["nowrap"])).alias("n_level_6"),
        (F.col("plan.df_old_size") == F.octet_length("content") + F.coalesce("grown", F.lit(0))).alias("old_size_ok"),
        (F.octet_length("patch") == F.col("plan.delta_at") + F.col("plan.delta_len")).alias("delta_is_last"),
    )


def explain_costs(spark, sf_dir):
    """Which entries of real archives are new, and which cost nothing in a patch."""
    found = explain.explain_archives(*_archives(spark, sf_dir))
    return found.select("pair_id", F.col("path").cast("string").alias("path"), "is_new", "reason", (F.col("size_in_patch") == 0).alias("free"))


def path_positions(spark, sf_dir):
    """Explanations' places in the list of their pair by path."""
    from .queries import _explained

    return explain.in_path_order(_explained(spark, sf_dir)).select("pair_id", "path", "is_new", "position")


def deflate_settings(spark, sf_dir):
    """Each of the 54 settings, found again from what it deflates, and junk, for which nothing is found."""
    every = text.all_params(spark).withColumn("junk", F.explode(F.array(F.lit(False), F.lit(True))))
    made = kernel(lambda level, strategy, nowrap, junk: (b"junk" if junk else b"") + codec.deflate(codec.corpus(), level, strategy, nowrap), "binary")("level", "strategy", "nowrap", "junk")
    again = kernel(lambda p: None if p is None else codec.deflate(codec.corpus(), *p), "binary")
    d = every.withColumn("raw", made).withColumn("p", codec.divine_column("raw"))
    return d.select("level", "strategy", "nowrap", "junk", F.col("p.nowrap").alias("found_nowrap"), (again("p") == F.col("raw")).alias("same"))


def fingerprint_changes(spark, sf_dir):
    """Settings that no longer deflate as expected, where level 9 is expected to do so otherwise."""
    known = [(level, strategy, nowrap, "0" * 64 if level == 9 else sha) for level, strategy, nowrap, sha in codec.baseline()]
    return codec.incompatible(spark, known).select("level", "strategy", "nowrap")


def _number(n: Column | int, digits: int) -> Column:
    """Hex digits of a number, big end first; negative ones in two's complement."""
    return F.right(F.lpad(F.hex(F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")), 16, "0"), F.lit(digits))


#: Kinds of damage to a patch, by doc_id % 13, and what reading it says.
DAMAGE = (
    None, "bad identifier", "bad size of the delta-friendly old blob", "bad number of ranges", "bad order of ranges", "bad level", "bad strategy", "bad wrapping", "bad window",
    "bad number of deltas", "bad kind of delta", "bad delta region", "the patch is cut off",
)


def bad_patches(spark, sf_dir):
    """Patches of made-up plans, sound ones and ones with each kind of damage, read."""
    d = v.documents(spark, sf_dir).select("doc_id", F.pmod("doc_id", F.lit(len(DAMAGE))).alias("kind"))
    put = lambda kind, bad, good: F.when(F.col("kind") == kind, F.lit(bad).cast("long")).otherwise(good.cast("long") if isinstance(good, Column) else F.lit(good).cast("long"))
    size = put(2, -1, F.col("doc_id") + 100)
    raw = F.concat(
        F.when(F.col("kind") == 1, F.lit(b"GFbFv1_1".hex())).otherwise(F.lit(b"GFbFv1_0".hex())), _number(0, 8), _number(size, 16),
        _number(put(3, -1, 2), 8), _number(1, 16), _number(5, 16), _number(put(4, 3, 9), 16), _number(2, 16),
        _number(1, 8), _number(2, 16), _number(7, 16), _number(put(8, 1, 0), 2), _number(put(5, 0, 6), 2), _number(put(6, 3, 0), 2), _number(put(7, 2, 1), 2),
        _number(put(9, 2, 1), 8), _number(put(10, 1, 0), 2), _number(0, 16), _number(size, 16), _number(0, 16), _number(90, 16), _number(put(11, -1, 3), 16), F.lit(b"abc".hex()),
    )
    patch = F.unhex(F.when(F.col("kind") == 12, F.substring(raw, 1, 80)).otherwise(raw))
    read = d.withColumn("r", try_read_patch_column(patch))
    return read.select("doc_id", F.col("r.error").alias("error"), F.col("r.plan.df_old_size").alias("df_old_size"), F.size("r.plan.old_ops").alias("n_old"), F.col("r.plan.new_ops")[0]["level"].alias("level"))


def gdiff_forms(spark, sf_dir):
    """All forms of data and copies in one patch of each document: what they make, in hex."""
    base = F.coalesce("text", F.lit("")).cast("binary")
    d = v.documents(spark, sf_dir).select("doc_id", base.alias("base")).withColumn("n", F.octet_length("base"))
    parts = [F.lit(bindiff.GDIFF_MAGIC.hex()), F.lit("03" + b"abc".hex()), F.lit("f7012c" + "78" * 300), F.lit("f800000005" + "79" * 5)]
    for k, (op, forms) in enumerate(bindiff.GDIFF_COPIES.items()):
        digits = {"B": 2, "H": 4, "i": 8, "q": 16}
        at = F.least(F.lit(k), F.col("n"))
        parts += [F.lit(f"{op:02x}"), _number(at, digits[forms[0]]), _number(F.least(F.lit(5), F.col("n") - at), digits[forms[1]])]
    return d.select("doc_id", F.hex(bindiff.apply_gdiff_column("base", F.unhex(F.concat(*parts, F.lit("00"))))).alias("made"))


QUERIES = {f.__name__: f for f in (
    longest_match, delta_literals, budget_matches, signed_numbers, zip_directory, zip_params, archive_plan, patch_ranges, explain_costs, path_positions, deflate_settings, fingerprint_changes, bad_patches, gdiff_forms,
)}

# ---------------------------------------------------------------- the same in SQL

_ZIPS = """
zo AS (SELECT 'a' || (doc_id // 50) AS pair_id, doc_id, 'doc/' || doc_id AS path, coalesce(text, '') AS content, doc_id % 4 <> 0 AS deflated FROM documents),
zn AS (SELECT 'a' || (doc_id // 50) AS pair_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE 'doc/' END || doc_id AS path, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' v2' ELSE '' END AS content, doc_id % 6 <> 0 AS deflated FROM documents),
zm AS (SELECT n.pair_id, n.path, n.content, n.deflated, o.path AS o_path, o.content AS o_content, o.deflated AS o_deflated, 'path' AS matched_by FROM zn n JOIN zo o USING (pair_id, path)
  UNION ALL SELECT n.pair_id, n.path, n.content, n.deflated, f.path, f.content, f.deflated, 'crc32' FROM zn n
    JOIN (SELECT * FROM zo QUALIFY row_number() OVER (PARTITION BY pair_id, md5(content) ORDER BY doc_id) = 1) f ON f.pair_id = n.pair_id AND md5(f.content) = md5(n.content)
    WHERE NOT EXISTS (SELECT 1 FROM zo o WHERE o.pair_id = n.pair_id AND o.path = n.path)),
zr AS (SELECT *, CASE WHEN NOT o_deflated AND NOT deflated THEN 'BOTH_ENTRIES_UNCOMPRESSED' WHEN NOT o_deflated THEN 'UNCOMPRESSED_CHANGED_TO_COMPRESSED' WHEN NOT deflated THEN 'COMPRESSED_CHANGED_TO_UNCOMPRESSED'
  WHEN content <> o_content THEN 'COMPRESSED_BYTES_CHANGED' ELSE 'COMPRESSED_BYTES_IDENTICAL' END AS reason FROM zm),
zp AS (SELECT *, CASE reason WHEN 'UNCOMPRESSED_CHANGED_TO_COMPRESSED' THEN 'UNCOMPRESS_NEW' WHEN 'COMPRESSED_CHANGED_TO_UNCOMPRESSED' THEN 'UNCOMPRESS_OLD'
  WHEN 'COMPRESSED_BYTES_CHANGED' THEN 'UNCOMPRESS_BOTH' ELSE 'UNCOMPRESS_NEITHER' END AS recommendation FROM zr)"""
_GDIFF_COPIES = " || ".join(f"hex(b)[2 * least({k}, n) + 1 : 2 * least({k}, n) + 2 * least(5, n - least({k}, n))]" for k in range(len(bindiff.GDIFF_COPIES)))


def oracles(explained: str) -> dict[str, str]:
    """SQL by query; explained: the CTEs up to c, the explanations with category."""
    return {
        "longest_match": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT a.doc_id, a.text AS t, b.text AS o FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
            k AS (SELECT doc_id, max(CAST(k AS INTEGER)) AS letters FROM p, range(1, {LONGEST + 1}) r(k) WHERE k <= length(t) AND contains(o, substr(t, 1, CAST(k AS INTEGER))) GROUP BY doc_id)
            SELECT p.doc_id, coalesce(k.letters, 0) AS letters FROM p LEFT JOIN k USING (doc_id)""",
        "delta_literals": "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) >= 64 THEN TRUE END AS few_literals, CAST(strlen(coalesce(text, '')) + 15 AS BIGINT) AS made FROM documents",
        "budget_matches": "SELECT doc_id, 0 AS by_length, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END AS by_budget FROM documents",
        "signed_numbers": """SELECT doc_id, printf('%02X%02X%02X%02X000000', abs(n) & 255, (abs(n) >> 8) & 255, (abs(n) >> 16) & 255, (abs(n) >> 24) & 255) || CASE WHEN n < 0 THEN '80' ELSE '00' END AS raw, TRUE AS same
            FROM (SELECT doc_id, CAST(doc_id - 300 AS BIGINT) AS n FROM documents)""",
        "zip_directory": """WITH e AS (SELECT 'a' || (doc_id // 50) AS pair_id, 'doc/' || doc_id AS path_text, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS csize FROM documents),
            o AS (SELECT *, CAST(sum(30 + strlen(path_text) + csize) OVER (PARTITION BY pair_id ORDER BY doc_id) - (30 + strlen(path_text) + csize) AS BIGINT) AS local_off FROM e)
            SELECT pair_id, path_text, csize, local_off, local_off + 30 + strlen(path_text) AS data_off, TRUE AS crc_ok FROM o""",
        "zip_params": f"WITH {_ZIPS} SELECT pair_id, path AS path_text, CASE WHEN deflated THEN 'level=6,strategy=0,nowrap=true' END AS params FROM zn",
        "archive_plan": f"WITH {_ZIPS} SELECT pair_id, o_path AS old_path, path AS new_path, matched_by, recommendation, reason FROM zp",
        "patch_ranges": f"""WITH {_ZIPS} SELECT p.pair_id, CAST(coalesce(n_old, 0) AS INTEGER) AS n_old, CAST(coalesce(n_new, 0) AS INTEGER) AS n_new, CAST(coalesce(n_new, 0) AS INTEGER) AS n_level_6, TRUE AS old_size_ok, TRUE AS delta_is_last
            FROM (SELECT DISTINCT pair_id FROM zo) p LEFT JOIN (SELECT pair_id, count(DISTINCT o_path) FILTER (recommendation IN ('UNCOMPRESS_OLD', 'UNCOMPRESS_BOTH')) AS n_old,
              count(*) FILTER (recommendation IN ('UNCOMPRESS_NEW', 'UNCOMPRESS_BOTH')) AS n_new FROM zp GROUP BY pair_id) USING (pair_id)""",
        "explain_costs": f"""WITH {_ZIPS} SELECT pair_id, path, FALSE AS is_new, reason, reason = 'COMPRESSED_BYTES_IDENTICAL' OR content = o_content AS free FROM zp
            UNION ALL SELECT pair_id, path, TRUE, NULL, FALSE FROM zn n WHERE NOT EXISTS (SELECT 1 FROM zo o WHERE o.pair_id = n.pair_id AND o.path = n.path)""",
        "path_positions": f"WITH RECURSIVE {explained} SELECT pair_id, path, is_new, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY path, is_new) AS INTEGER) AS position FROM c",
        "deflate_settings": """SELECT CAST(l AS INTEGER) AS level, CAST(s AS INTEGER) AS strategy, w AS nowrap, j AS junk, CASE WHEN NOT j THEN w END AS found_nowrap, CASE WHEN NOT j THEN TRUE END AS same
            FROM range(1, 10) a(l), range(0, 3) b(s), (VALUES (TRUE), (FALSE)) c(w), (VALUES (TRUE), (FALSE)) d(j)""",
        "fingerprint_changes": "SELECT 9 AS level, s AS strategy, w AS nowrap FROM (VALUES (0), (1)) a(s), (VALUES (TRUE), (FALSE)) b(w)",
        "bad_patches": f"""SELECT doc_id, CASE doc_id % {len(DAMAGE)} {' '.join(f"WHEN {k} THEN '{what}'" for k, what in enumerate(DAMAGE) if what)} END AS error,
            CASE WHEN doc_id % {len(DAMAGE)} = 0 THEN CAST(doc_id + 100 AS BIGINT) END AS df_old_size, CASE WHEN doc_id % {len(DAMAGE)} = 0 THEN 2 END AS n_old, CASE WHEN doc_id % {len(DAMAGE)} = 0 THEN 6 END AS level FROM documents""",
        "gdiff_forms": f"SELECT doc_id, '616263' || repeat('78', 300) || repeat('79', 5) || {_GDIFF_COPIES} AS made FROM (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents)",
        "explain_text_report": f"""WITH RECURSIVE {explained}, l AS (SELECT pair_id,
            string_agg('New file ''' || path || ''', approximate size of data in patch: ' || size_in_patch || ' bytes', chr(10) ORDER BY path) FILTER (category = 'new') AS a,
            string_agg('Changed file ''' || path || ''', approximate size of data in patch: ' || size_in_patch || ' bytes', chr(10) ORDER BY path) FILTER (category = 'changed') AS b,
            string_agg('Unchanged or zero-delta-cost file ''' || path || '''', chr(10) ORDER BY path) FILTER (category = 'unchanged_or_free') AS u,
            count(*) FILTER (category = 'new') AS n_a, count(*) FILTER (category = 'changed') AS n_b, count(*) FILTER (category = 'unchanged_or_free') AS n_u, count(*) FILTER (category = 'resource_constrained') AS n_r,
            CAST(coalesce(sum(size_in_patch) FILTER (category = 'new'), 0) AS BIGINT) AS s_a, CAST(coalesce(sum(size_in_patch) FILTER (category = 'changed'), 0) AS BIGINT) AS s_b, CAST(coalesce(sum(size_in_patch) FILTER (category = 'resource_constrained'), 0) AS BIGINT) AS s_r FROM c GROUP BY pair_id)
            SELECT pair_id, concat_ws(chr(10), a, b, u, '----------', 'Num unchanged files: ' || n_u, 'Num changed files:   ' || n_b || ' (estimated patch size ' || format('{{:,}}', s_b) || ' bytes)',
              'Num new files:       ' || n_a || ' (estimated patch size ' || format('{{:,}}', s_a) || ' bytes)',
              'Num files changed but forced to stay compressed by the total recompression limit: ' || n_r || ' (estimated patch size ' || format('{{:,}}', s_r) || ' bytes)',
              'Estimated total patch size: ' || format('{{:,}}', s_a + s_b + s_r) || ' bytes') AS report FROM l""",
        "explain_json_report": f"""WITH RECURSIVE {explained}, l AS (SELECT pair_id, {', '.join(f"coalesce(list({{'path': path, 'is_new': is_new, 'reason': reason, 'size_in_patch': CAST(size_in_patch AS BIGINT)}} ORDER BY path) FILTER (category = '{k}'), []) AS {k}" for k in explain.CATEGORIES)},
              {', '.join(f"CAST(coalesce(sum(size_in_patch) FILTER (category = '{k}'), 0) AS BIGINT) AS size_{k}" for k in explain.CATEGORIES)},
              {', '.join(f"coalesce(string_agg('    {{ path: ''' || path || ''', isNew: ' || is_new || ', reasonIncluded: ' || CASE WHEN is_new THEN 'undefined' ELSE '''' || reason || '''' END || ', compressedSizeInPatch: ' || size_in_patch || ' }}', ',' || chr(10) ORDER BY path) FILTER (category = '{k}') || chr(10), '') AS t_{k}" for k in explain.CATEGORIES)}
              FROM c GROUP BY pair_id)
            SELECT pair_id, CAST(to_json({{{', '.join(f"'{k}': {k}" for k in [*explain.CATEGORIES, *(f'size_{k}' for k in explain.CATEGORIES)])}}}) AS VARCHAR) AS report,
              '{{' || chr(10) || '  estimatedNewSize: ' || size_new || ',' || chr(10) || '  estimatedChangedSize: ' || size_changed || ',' || chr(10) || '  estimatedResourceConstrainedSize: ' || size_resource_constrained || ',' || chr(10)
              || {" || ',' || chr(10) || ".join(f"'  {name}: [' || chr(10) || t_{k} || '  ]'" for name, k in (('explainedAsNew', 'new'), ('explainedAsChanged', 'changed'), ('explainedAsUnchangedOrFree', 'unchanged_or_free'), ('explainedAsResourceConstrained', 'resource_constrained')))}
              || chr(10) || '}}' AS legacy FROM l""",
    }

"""Plans, limits, layout, patches, explanations and streams on DataFrames."""

import os

import pytest
from pyspark.sql import functions as F

from zipstrata import cli
from zipstrata import queries as q
from zipstrata.functions import text
from zipstrata.operators import engine
from zipstrata.plans import explain, layout, limits, matching
from zipstrata.sources import patchfiles, zipfiles
from zipstrata.sources.versions import zip_bytes
from zipstrata.streaming import watch

FILL = "".join(f"line {i} of the text that fills an entry up\n" for i in range(60))
#: name in old and new, level in old and new, whether the content changes, reason
SCENARIO = [
    ("/entry1", "/entry1", 6, 6, False, "COMPRESSED_BYTES_IDENTICAL"),
    ("/entry2", "/entry2", 6, 1, False, "COMPRESSED_BYTES_CHANGED"),
    ("/entry3", "/entry3", 6, 6, True, "COMPRESSED_BYTES_CHANGED"),
    ("/entry4", "/entry4", 0, 6, False, "UNCOMPRESSED_CHANGED_TO_COMPRESSED"),
    ("/entry5", "/entry5", 6, 0, False, "COMPRESSED_CHANGED_TO_UNCOMPRESSED"),
    ("/entry6", "/entry6", 0, 0, False, "BOTH_ENTRIES_UNCOMPRESSED"),
    ("/entry7", "/entry7", 0, 0, True, "BOTH_ENTRIES_UNCOMPRESSED"),
    ("/entry8", "/entry8", 0, 6, True, "UNCOMPRESSED_CHANGED_TO_COMPRESSED"),
    ("/entry9", "/entry9", 6, 0, True, "COMPRESSED_CHANGED_TO_UNCOMPRESSED"),
    ("/entry10A", "/entry10B", 6, 6, False, "COMPRESSED_BYTES_IDENTICAL"),
    ("/entry11A", "/entry11B", 0, 0, False, "BOTH_ENTRIES_UNCOMPRESSED"),
    ("/entry12A", "/entry12B", 6, 6, True, None),
    ("/entry13A", "/entry13B", 0, 0, True, None),
]


def scenario() -> tuple[bytes, bytes]:
    old = [(o, f"{o} first {FILL}".encode(), level) for o, _, level, _, _, _ in SCENARIO]
    new = [(n, f"{o} {'second' if changed else 'first'} {FILL}".encode(), level) for o, n, _, level, changed, _ in SCENARIO]
    return zip_bytes(old), zip_bytes(new[::-1])


def frame(spark, *contents):
    return spark.createDataFrame([(f"p{i}", bytearray(c)) for i, c in enumerate(contents)], "pair_id string, content binary")


@pytest.fixture(scope="module")
def pair(spark):
    old, new = scenario()
    return frame(spark, old), frame(spark, new)


def test_scenario_plan(pair):
    rows = {bytes(r["new"]["path"]).decode(): (r["reason"], r["matched_by"]) for r in engine.patch_plan(*pair).collect()}
    assert rows == {n: (reason, "path" if o == n else "crc32") for o, n, _, _, _, reason in SCENARIO if reason}


def test_scenario_round_trip(spark, pair):
    old, new = scenario()
    for modifiers in ([], [limits.total_recompression(5000)], [limits.total_recompression(0)], [limits.old_blob_size(len(old) + 4000, pair[0].select("pair_id", F.octet_length("content").alias("length")))]):
        patches = engine.generate(*pair, *modifiers)
        assert bytes(engine.apply(pair[0], patches).first()["content"]) == new
    plan = patches.select(patchfiles.read_patch_column("patch").alias("p")).first()["p"]
    assert plan["df_old_size"] <= len(old) + 4000
    again = engine.generate(frame(spark, old, new), frame(spark, new, old))
    assert {r["pair_id"]: bytes(r["content"]) for r in engine.apply(frame(spark, old, new), again).collect()} == {"p0": new, "p1": old}


def test_limits(spark):
    sizes = {"/a": 100, "/b": 200, "/c": 300, "/d": 400}
    pairs = spark.createDataFrame([("p", p, n, n // 2) for p, n in sizes.items()], "pair_id string, path string, usize long, csize long")
    side = F.struct("path", "usize", "csize")
    pairs = pairs.select("pair_id", side.alias("new"), side.alias("old"), F.lit("UNCOMPRESS_BOTH").alias("recommendation"), F.lit("COMPRESSED_BYTES_CHANGED").alias("reason")).transform(matching.with_flags)
    lengths = spark.createDataFrame([("p", 1000)], "pair_id string, length long")

    def kept(out):
        return {r["new"]["path"] for r in out.collect() if r["unc_new"] and r["unc_old"] and r["reason"] != "RESOURCE_CONSTRAINED"}

    for limit, want in [(0, ""), (99, ""), (100, "/a"), (101, "/a"), (399, "/c"), (400, "/d"), (401, "/d"), (600, "/d/b"), (2**60, "/a/b/c/d")]:
        assert kept(limits.total_recompression(limit)(pairs)) == {f"/{x}" for x in want.split("/")[1:]}, limit
    for limit, want in [(0, ""), (1000, ""), (1049, ""), (1050, "/a"), (1200, "/d"), (1300, "/d/b"), (2**60, "/a/b/c/d")]:
        assert kept(limits.old_blob_size(limit, lengths)(pairs)) == {f"/{x}" for x in want.split("/")[1:]}, limit
    with pytest.raises(ValueError):
        limits.total_recompression(-1)
    with pytest.raises(ValueError):
        limits.old_blob_size(-1, lengths)
    free = pairs.withColumn("recommendation", F.lit("UNCOMPRESS_NEITHER")).transform(matching.with_flags)
    assert {r["reason"] for r in limits.total_recompression(0)(free).collect()} == {"COMPRESSED_BYTES_CHANGED"}


def test_unsuitable_entries(spark, pair):
    data = zip_bytes([("/x", FILL.encode(), 6)])
    e = zipfiles.entries(data)[0]
    broken = data[: e.data_off] + b"junk" + data[e.data_off + 4 :]
    odd = data.replace(b"PK\x01\x02", b"pk\x01\x02")
    at = odd.index(b"pk\x01\x02")
    odd = data[: at + 10] + b"\7\0" + data[at + 12 :]
    for new, reason in ((broken, "DEFLATE_UNSUITABLE"), (odd, "UNSUITABLE")):
        r = engine.patch_plan(frame(spark, data), frame(spark, new)).first()
        assert (r["recommendation"], r["reason"]) == ("UNCOMPRESS_NEITHER", reason)
        assert bytes(engine.apply(frame(spark, data), engine.generate(frame(spark, data), frame(spark, new))).first()["content"]) == new


def test_a_base_is_listed_once(spark):
    body = FILL.encode()
    old, new = zip_bytes([("/a", body, 6)]), zip_bytes([("/a", body, 9), ("/copy", body, 1)])
    spans = layout.ranges(engine.patch_plan(frame(spark, old), frame(spark, new)))
    assert spans.filter("side = 'old'").count() == 1
    assert bytes(engine.apply(frame(spark, old), engine.generate(frame(spark, old), frame(spark, new))).first()["content"]) == new


def test_layout_against_the_kernel(spark, pair):
    from zipstrata.functions.codec import uncompress_ranges

    old, _ = scenario()
    spans = layout.ranges(engine.patch_plan(*pair)).filter("side = 'old'")
    rows = sorted((r["offset"], r["length"]) for r in spans.collect())
    blob, places = uncompress_ranges(old, rows)
    assert sorted((r["offset"], r["length"]) for r in layout.inverse(spans).collect()) == places
    lengths = spark.createDataFrame([("p0", len(old)), ("none", 7)], "pair_id string, length long")
    assert {r["pair_id"]: r["blob_size"] for r in layout.blob_sizes(spans, lengths).collect()} == {"p0": len(blob), "none": 7}
    gaps = layout.gaps(spans, lengths)
    assert gaps.filter("pair_id = 'p0'").agg(F.sum("length")).first()[0] == len(old) - sum(n for _, n in rows)
    assert layout.overlaps(spans).isEmpty() and layout.checked(spans).count() == len(rows)
    with pytest.raises(Exception, match="overlap"):
        layout.checked(spans.unionByName(spans.withColumn("offset", F.col("offset") + 1))).collect()


def test_explanations(spark, pair):
    found = explain.explain_archives(*pair).cache()
    rows = {(bytes(r["path"]).decode(), r["is_new"]): r for r in found.collect()}
    assert {p for p, is_new in rows if is_new} == {n for o, n, *_ in SCENARIO if o != n}
    assert rows["/entry1", False]["size_in_patch"] == 0
    assert rows["/entry2", False]["size_in_patch"] == 0 and rows["/entry2", False]["reason"] == "COMPRESSED_BYTES_CHANGED"
    assert 0 < rows["/entry3", False]["size_in_patch"] < 100 < rows["/entry13B", True]["size_in_patch"]
    t = {r["category"]: (r["entries"], r["size"]) for r in explain.totals(found).collect()}
    assert sum(n for n, _ in t.values()) == len(rows)
    s = explain.summary(found).first()
    assert s["size_total"] == sum(x for _, x in t.values()) and s["n_new"] == t["new"][0]
    limited = {r["category"] for r in explain.totals(explain.explain_archives(*pair, limits.total_recompression(0))).collect()}
    assert "resource_constrained" in limited
    report = explain.text_report(found).first()["report"]
    assert report.splitlines()[0].startswith("New file '/entry10B', approximate size of data in patch: ")
    assert f"Estimated total patch size: {s['size_total']:,} bytes" in report
    legacy = explain.legacy_json_report(found).first()["report"]
    assert "reasonIncluded: undefined" in legacy and "reasonIncluded: 'COMPRESSED_BYTES_CHANGED'" in legacy


def test_bad_archives_and_patches(spark):
    good = zip_bytes([("a", b"x", 0)])
    archives = frame(spark, good, b"no archive", b"")
    assert zipfiles.catalog(archives, strict=False).count() == 1
    assert {r["pair_id"] for r in zipfiles.unreadable(archives).collect()} == {"p1", "p2"}
    with pytest.raises(Exception, match="no end of directory"):
        zipfiles.catalog(archives).collect()
    rows = archives.select(patchfiles.try_read_patch_column("content").alias("r")).collect()
    assert all(r["r"]["plan"] is None and r["r"]["error"] for r in rows)
    assert zipfiles.catalog(archives.limit(0)).count() == 0


def test_names_and_settings_as_text(spark):
    d = spark.createDataFrame([(bytearray(b"\x84"), False), (bytearray("ä".encode()), True), (None, True)], "p binary, u boolean")
    assert [r[0] for r in d.select(text.path_text("p", "u")).collect()] == ["ä", "ä", None]
    bad = spark.createDataFrame([("level=0,strategy=0,nowrap=true",), ("level=6,strategy=0,nowrap=true",), ("x",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in bad.select(text.parse_params("t")).collect()] == [None, (6, 0, True), None, None]


def test_command_line(spark, tmp_path, capsys):
    old, new = scenario()
    (tmp_path / "old.zip").write_bytes(old)
    (tmp_path / "new.zip").write_bytes(new)
    names = ["--old", str(tmp_path / "old.zip"), "--patch", str(tmp_path / "patch")]
    assert cli.main(["generate", *names, "--new", str(tmp_path / "new.zip"), "--trl", "20000"], spark) == 0
    assert cli.main(["apply", *names, "--new", str(tmp_path / "made.zip")], spark) == 0
    assert (tmp_path / "made.zip").read_bytes() == new
    assert cli.main(["explain", "--old", names[1], "--new", str(tmp_path / "new.zip")], spark) == 0
    assert "Num new files:" in capsys.readouterr().out
    for bad in (["apply", *names, "--new", "x", "--trl", "1"], ["generate", "--old", "a", "--new", "b"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_stream_and_files(spark, tmp_path):
    old, new = scenario()
    folder = tmp_path / "in"
    made = engine.write_files(frame(spark, old, new).withColumn("pair_id", F.concat("pair_id", F.lit(".zip"))), str(folder), "content")
    assert {r["length"] for r in made.collect()} == {len(old), len(new)}
    assert sorted(os.listdir(folder)) == ["p0.zip", "p1.zip"]
    assert zipfiles.read_archives(spark, str(folder), "*.zip").count() == 2
    run = watch.watch_catalog(spark, str(folder)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("seen").count() == 2 * len(SCENARIO)


def test_small_tables_are_spread(spark, tmp_path):
    from zipstrata.sources.tables import spread, table

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 8
    one = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert spread(one, most_bytes=10).rdd.getNumPartitions() == one.rdd.getNumPartitions()


def test_another_finder(spark):
    """Entries without a base by path may get it from any finder."""
    old = frame(spark, zip_bytes([("/a", FILL.encode(), 6), ("/b", b"other", 0)]))
    new = frame(spark, zip_bytes([("/c", b"something else", 0)]))

    def largest(missed, olds):
        best = olds.groupBy("pair_id").agg(F.max_by("old", F.col("old.usize")).alias("old"))
        return missed.join(best, "pair_id").select("pair_id", "new", "old", F.lit("largest").alias("matched_by"))

    c, d = zipfiles.catalog(old), zipfiles.catalog(new)
    assert matching.plan_pairs(c, d).isEmpty()
    r = matching.plan_pairs(c, d, finder=largest).first()
    assert (r["matched_by"], bytes(r["old"]["path"])) == ("largest", b"/a")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(q.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(repr, want.fetchall()))
    got = q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows


def test_plan_of_matching(spark, tmp_path):
    """One scan a side; one exchange by path, one by checksum."""
    rows = [("p", f"/f{i}", 8, i % 7, 10, 20, i, f"d{i}", None) for i in range(50)]
    kind = "pair_id string, path string, method int, crc32 long, csize long, usize long, local_off long, digest string, params struct<level:int,strategy:int,nowrap:boolean>"
    for side in ("old", "new"):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{side}")
    pairs = matching.plan_pairs(*(spark.read.parquet(f"{tmp_path}/{side}") for side in ("old", "new")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "path" in exchanges[1] and "crc32" in exchanges[0] and "Join" not in plan
    assert pairs.count() == 50


def test_budget_walk_of_a_full_archive():
    import time

    n = 65_534
    items = [{"size": n - i, "path": b"/%06d" % i, "cost": n - i} for i in range(n)]
    began = time.process_time()
    over = limits._walk(items, n // 2)
    assert time.process_time() - began < 1
    assert over[0] == b"/000000" and len(over) == n - 1


def test_paths_are_listed_by_utf16_units(spark):
    """A character beyond the basic plane comes before U+FF5E, as its surrogates do."""
    paths = ["b", "\U0001f600", "～", "a", "퟿"]
    rows = spark.createDataFrame([("p", p, True, None, 1) for p in paths], "pair_id string, path string, is_new boolean, reason string, size_in_patch long")
    want = sorted(paths, key=lambda p: p.encode("utf-16-be"))
    assert want != sorted(paths)
    assert [r["path"] for r in explain.in_path_order(rows).orderBy("position").collect()] == want
    report = explain.text_report(rows).first()["report"].splitlines()
    assert [line.split("'")[1] for line in report[:5]] == want

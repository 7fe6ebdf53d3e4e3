"""Archives made for the queries: both versions at once, as zipfile writes them."""

import random

from zipstrata.sources import versions as v


def test_both_versions_are_as_zipfile_writes_them():
    rng = random.Random(4)
    rows = []
    for k in range(40):
        content = bytes(rng.choice(b"abc \n") for _ in range(rng.choice([0, 1, 30, 3000])))
        changed = content + b" v2" if k % 5 == 0 else None
        rows.append((f"doc/{k}", f"{'moved' if k % 7 == 0 else 'döc'}/{k}", content, changed, 0 if k % 4 == 0 else 6, 0 if k % 6 == 0 else 6))
    old, new = v.both_zips(rows)
    assert old == v.zip_bytes([(r[0], r[2], r[4]) for r in rows])
    assert new == v.zip_bytes([(r[1], r[2] if r[3] is None else r[3], r[5]) for r in reversed(rows)])
    assert v.both_zips([]) == (v.zip_bytes([]),) * 2


def test_what_both_versions_deflate_is_deflated_once(monkeypatch):
    """F3, F8, F9: each version read, dealt and deflated all documents by itself."""
    calls, deflate = [], v.deflate
    monkeypatch.setattr(v, "deflate", lambda *a: (calls.append(a), deflate(*a))[1])
    v.both_zips([("a", "a", b"x" * 90, None, 6, 6), ("b", "b", b"y" * 90, b"y v2", 6, 6), ("c", "c", b"z" * 90, None, 0, 6)])
    assert len(calls) == 4


def test_both_archives_are_archives(spark):
    docs = v.documents(spark, "/root/testdata/sf0.001").filter("doc_id < 130").union(spark.sql("SELECT 131L AS doc_id, null AS text, 'en' AS lang, 'x' AS source, 0 AS n_chars"))
    for side, made in zip(("old", "new"), v.both_archives(docs)):
        want = {r["pair_id"]: r["content"] for r in v.archives(docs, side).collect()}
        assert {r["pair_id"]: r["content"] for r in made.collect()} == want and len(want) == 3


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_costs_read_a_plan_that_is_written(spark):
    """both kinds of pairs matched and classified all entries by themselves."""
    from zipstrata import proofs

    assert "Window" not in plan_of(proofs.explain_costs(spark, "/root/testdata/sf0.001"))


def test_sizes_read_archives_that_are_written(spark):
    """catalogues and stored bytes each made the archives again, from the documents."""
    from zipstrata import queries

    assert "FileScan" not in plan_of(queries.explain_sizes(spark, "/root/testdata/sf0.001"))

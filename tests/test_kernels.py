"""Python kernels as columns: values, nulls, structs, and what a worker holds."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from zipstrata import proofs, queries
from zipstrata.functions import kernels
from zipstrata.functions.kernels import kernel


def test_values_nulls_and_structs(spark):
    rows = [(1, b"ab", [Row(x=1, y="p"), None]), (None, None, None), (3, b"", [])]
    d = spark.createDataFrame(rows, "n long, b binary, s array<struct<x:int,y:string>>").coalesce(1)
    seen = kernel(lambda n, b, s: (n, b, None if s is None else [None if e is None else (*e, e["x"]) for e in s]), "struct<n:long,b:binary,s:array<struct<x:int,y:string,again:int>>>")
    found = d.select(seen("n", "b", "s").alias("r")).select("r.*").collect()
    assert [(r.n, None if r.b is None else bytes(r.b), r.s) for r in found] == [(1, b"ab", [Row(x=1, y="p", again=1), None]), (None, None, None), (3, b"", [])]
    assert d.filter("n > 5").select(seen("n", "b", "s")).collect() == []


@pytest.mark.parametrize("cells,most", [((1000, 10), kernels.ROWS), ((40, 1 << 18), 8)])
def test_few_rows_of_a_batch_are_python_objects(spark, cells, most):
    """all rows of a batch, and all results, were Python objects at the same time."""
    rows, size = cells
    made = []

    def alive(b):  # counts what of its batch has been made Python objects and is held
        import gc

        return sum(1 for x in gc.get_objects() if type(x) is list and len(x) > 1 and all(type(v) is bytes and len(v) == size for v in x[:2]) and len(x) > most)

    d = spark.range(rows, numPartitions=1).select(F.expr(f"cast(repeat('x', {size}) as binary)").alias("b"))
    made = d.select(kernel(alive, "int")("b").alias("n")).agg(F.max("n")).first()[0]
    assert made == 0


@pytest.mark.parametrize("query", [queries.divine_params, queries.bsdiff_roundtrip, queries.bsdiff_entries, proofs.delta_literals, proofs.budget_matches])
def test_a_task_has_one_worker(spark, query):
    """each chained column had a worker of its own, with its own batch."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1

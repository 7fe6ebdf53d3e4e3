"""Python kernels as columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows, and bytes of their columns, that are Python objects at one time.
ROWS, BYTES = 256, 1 << 20


def _converter(kind: pa.DataType):
    """What makes rows of the structs in a value; None if there are none."""
    if pa.types.is_struct(kind):
        inner = [(f.name, _converter(f.type)) for f in kind]
        return lambda x: None if x is None else Row(**{name: convert(x[name]) if convert else x[name] for name, convert in inner})
    if pa.types.is_list(kind) and (convert := _converter(kind.value_type)):
        return lambda x: None if x is None else [convert(v) for v in x]
    return None


def _values(column: pa.Array) -> list:
    convert = _converter(column.type)
    return [convert(x) for x in column.to_pylist()] if convert else column.to_pylist()


def kernel(f, kind: str):
    """Column function of a Python function on single values; binary ones are bytes, structs rows.

    Values travel in Arrow batches, of some ten thousand rows.  Only a few rows of one are
    made Python objects at a time, and results go back to Arrow as soon as they are there, so a
    worker holds little more than the batch and its results.
    """
    made = pa_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        rows = max(1, min(ROWS, BYTES * n // max(1, sum(c.nbytes for c in columns))))
        parts = [pa.array(list(map(f, *(_values(c.slice(at, rows)) for c in columns))), made) for at in range(0, n, rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    run.__name__ = f.__name__  # what plans show
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


def pa_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(DataType.fromDDL(kind))

"""Session-level helpers: tables written to the shared folder, text functions, size-checked joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..storage import saved, shared  # noqa: F401
from . import vec

#: A side is broadcast only when its rows, measured first, are known to stay below this.
BROADCAST_BYTES = 16 << 20


def width(c: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((width(c.getField(f.name), f.dataType) for f in kind), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            each = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + width(x, kind.elementType))
        else:
            each = 8 * F.size(c).cast("long")
        return F.coalesce(each, F.lit(0).cast("long")) + 24
    return F.lit(8).cast("long")


def measured(df: DataFrame) -> int:
    """Bytes of the rows of a saved table, in memory, about: its values are measured, whatever their length."""
    return df.select(sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(24).cast("long")).alias("n")).agg(F.sum("n")).first()[0] or 0


def joined(left: DataFrame, right: DataFrame, on, how: str, limit: int | None = None) -> DataFrame:
    """left JOIN right; right, a saved table, is broadcast if its measured size allows, else both
    sides are shuffled. The rows are the same either way."""
    return left.join(F.broadcast(right) if measured(right) <= (BROADCAST_BYTES if limit is None else limit) else right, on, how)


def text_udf(f, returns: str):
    """A column function of a text column: f takes an Arrow string array of about a megabyte and gives
    an array of the same length. Runs on Arrow batches, which the session bounds by bytes; nothing is converted row by row."""

    def whole(v: pa.Array) -> pa.Array:
        out = [f(v.slice(i, j - i)) for i, j in vec.spans(v)]
        if not out:
            out = [f(v)]
        got = pa.concat_arrays(out) if len(out) > 1 else out[0]
        del out
        vec.trim()
        return got

    whole.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(returns)(whole)


def lists(values: pa.Array, counts) -> pa.Array:
    """A list array of consecutive runs of values."""
    import numpy as np

    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values)


def hidden(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def docs_only(docs: DataFrame, *cols: str) -> DataFrame:
    """Just these columns, whatever else the table carries."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(c: str = "doc_id") -> Column:
    return F.col(c).cast("long")

"""Exact dedup by content-defined chunk recipes.

Each text is cut where a hash rolling over `WIDTH` bytes hits a mask, so equal stretches are cut alike
wherever they stand; the ordered list of (chunk hash, length) is the document's recipe. A recipe that no
other document has cannot belong to a copy, so bytes move only for documents whose recipe repeats, and of
each chunk they share only one copy leaves a task. Texts are cut once, in one pass over their bytes. Every chunk hash is verified byte by byte
(smallest = largest content of that hash); a hash that stands for several contents is replaced by the
content itself. Documents are then equal exactly when their ordered lists of verified identifiers are.

Edge cases: empty texts are copies of each other; a null text is a copy of nothing; rows with a null
doc_id take part and count, the group being named by its smallest non-null doc_id; of rows that tie in
doc_id and text one stays, the others are duplicates; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import docs_only, joined, lists, saved, text_udf

WIDTH = 48
#: A cut on average every 2**MASK_BITS bytes; a stretch without any is cut every LONGEST bytes.
MASK_BITS = 11
LONGEST = 1 << 16


def cuts(data: np.ndarray, off: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Ends of all chunks, ascending; the end of each non-empty text is one."""
    found = []
    for a in range(0, max(0, len(data) - WIDTH + 1), block):
        h = vec.kgrams(vec._BYTE[data[a : a + block + WIDTH - 1]], WIDTH, vec._P)
        found.append(np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + a + WIDTH)
    ends = np.concatenate([*found, off[1:]]).astype(np.int64)
    if len(ends) > len(off) - 1:  # a window that reaches over a text's start says nothing
        hit = ends[: len(ends) - len(off) + 1]
        begin = off[np.searchsorted(off, hit, "left") - 1]
        ends = np.concatenate([hit[hit - WIDTH >= begin], off[1:]])
    ends = np.unique(ends)
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    more = (ends - starts - 1) // LONGEST
    if more.any():
        at = np.repeat(np.arange(len(ends)), more)
        k = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate([ends, starts[at] + k * LONGEST]))
    return ends


def _recipe(v: pa.Array) -> pa.Array:
    data, off = vec.buffers(v)
    ends = cuts(data, off)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    h = vec.word_hashes(data, starts, ends).view(np.int64)
    n = np.diff(np.searchsorted(ends, off, "right"))
    return pa.StructArray.from_arrays([lists(pa.array(h), n), lists(pa.array((ends - starts).astype(np.int32)), n)], ["h", "n"])


def cut():
    """Column function: the bytes of a text's chunks, by the lengths of its recipe."""

    def f(t: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for i, j in vec.spans(t):
            data, _ = vec.buffers(t.slice(i, j - i))
            lens = n.slice(i, j - i)
            flat = np.asarray(lens.flatten(), np.int64)
            out.append(lists(vec.texts(data, flat, pa.large_binary()).cast(pa.binary()), np.asarray(pa.compute.list_value_length(lens).fill_null(0))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.binary()))

    f.__annotations__ = {"t": pa.Array, "n": pa.Array, "return": pa.Array}
    return F.arrow_udf("array<binary>")(f)


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text, r (chunk hashes and lengths, null for a null text), key (a hash of r)."""
    r = text_udf(_recipe, "struct<h: array<bigint>, n: array<int>>")
    return docs_only(docs, "doc_id", "text").withColumn("r", F.when(F.col("text").isNotNull(), r(F.col("text")))).withColumn("key", F.when(F.col("r").isNotNull(), F.xxhash64("r.h", "r.n")))


def exact_duplicates(docs: DataFrame, recipe_of=recipes) -> DataFrame:
    """doc_id, group_id (the smallest doc_id with this text), copies, duplicate for every row."""
    lists_ = saved(recipe_of(docs).select("doc_id", "r", "key"), "recipes")
    again = saved(lists_.where("key is not null").groupBy("key").count().where("count > 1").select("key"), "recipe-keys")
    moved = joined(recipe_of(docs), again, "key", "left_semi")
    chunks = moved.select(F.explode(F.arrays_zip(F.col("r.h").alias("h"), F.col("r.n").alias("n"), cut()("text", "r.n").alias("b"))).alias("c")).select("c.*")
    clash = saved(chunks.groupBy("h", "n").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("h", "n"), "clashes")
    if clash.isEmpty():
        ids = lists_.withColumn("exact", F.lit(None).cast("array<binary>"))
    else:  # these chunks are their own identifiers
        found = saved(lists_.where("key is not null").select("key", F.explode(F.arrays_zip(F.col("r.h").alias("h"), F.col("r.n").alias("n"))).alias("c")).select("key", "c.*").distinct(), "clash-recipes")
        bad = saved(joined(found, clash, ["h", "n"], "inner").groupBy("key").agg(F.collect_set(F.struct("h", "n")).alias("bad")), "clash-keys")
        full = joined(recipe_of(docs), bad, "key", "left").withColumn("b", cut()("text", "r.n"))
        spelled = F.expr("transform(b, (x, i) -> case when array_contains(bad, named_struct('h', r.h[i], 'n', r.n[i])) then x end)")
        ids = full.select("doc_id", "r", "key", F.when(F.col("bad").isNotNull(), spelled).alias("exact"))
    same = Window.partitionBy("key", "r", "exact", F.when(F.col("key").isNull(), F.col("doc_id")))
    return ids.select(
        "doc_id",
        F.min("doc_id").over(same).alias("group_id"),
        F.when(F.col("key").isNull(), F.lit(1).cast("long")).otherwise(F.count(F.lit(1)).over(same)).alias("copies"),
        ((F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())) > 1) & F.col("key").isNotNull()).alias("duplicate"),
    )


ORACLE = """
SELECT doc_id, min(doc_id) OVER w AS group_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER w END AS copies,
       text IS NOT NULL AND row_number() OVER (w ORDER BY doc_id NULLS LAST) > 1 AS duplicate
FROM documents
WINDOW w AS (PARTITION BY text, CASE WHEN text IS NULL THEN doc_id END)
"""

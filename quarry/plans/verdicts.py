"""Satisfiability questions as a column: distinct query texts are answered once, stored ones not at all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from . import cache

SOLVER = "quarry-sat-1"
BUDGET, RETRY = 2000, 10
VERDICT = "key string, verdict string, model string"


def answered(query: str, budget: int) -> tuple[str, str | None]:
    """(verdict, model as text). A query that can't be read is unknown: nothing in the input may stop a run."""
    try:
        verdict, model = terms.check(terms.parse_query(query), budget)
    except (ValueError, RecursionError):
        return terms.UNKNOWN, None
    return verdict, ", ".join(f"{k} = {v}" for k, v in model.items()) or None


def _solve(budget: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [answered(q, budget) for q in b.column("query").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["key", "verdict", "model"])

    return run


def discharged(queries: DataFrame, store: cache.Store | None = None, budget: int = BUDGET, layer: str = "verdicts") -> DataFrame:
    """queries (query, ...) with verdict and model. Each distinct text is solved once; where a store is given, only those that it lacks,
    and what was solved is added to it."""
    keyed = queries.withColumn("key", cache.query_key(F.col("query"), SOLVER, budget))
    asked = keyed.select("key", "query").where("query is not null").dropDuplicates(["key"])
    if store is None:
        found = asked.repartition("key").mapInArrow(_solve(budget), VERDICT)
    else:
        _, missing = store.split(asked, layer)
        store.add(missing.repartition("key").mapInArrow(_solve(budget), VERDICT), layer)
        found = store.rows(layer).dropDuplicates(["key"])
    return keyed.join(found, "key", "left").withColumn("verdict", F.coalesce("verdict", F.lit(terms.UNKNOWN))).drop("key")


def with_retry(queries: DataFrame, store: cache.Store | None = None, budget: int = BUDGET, factor: int = RETRY) -> DataFrame:
    """A second pass, with more effort, over what the first left unknown."""
    from ..storage import saved

    first = saved(discharged(queries, store, budget), "verdicts")
    again = discharged(first.where("verdict = 'unknown'").drop("verdict", "model"), store, budget * factor)
    return first.where("verdict <> 'unknown'").unionByName(again)


def products(sites: DataFrame) -> DataFrame:
    """a, b, verdict: is there an 8-bit x below 16 + 8a with x * a = b? For all pairs of line number and quantity."""
    x = "(= (bvmul x (_ bv%s 8)) (_ bv%s 8))"
    pairs = sites.select(F.col("l_linenumber").alias("a"), F.col("quantity").alias("b")).distinct()
    limit = F.pmod(F.lit(16) + F.col("a") * 8, F.lit(256)).cast("string")
    query = F.concat(F.lit("(declare-const x (_ BitVec 8))\n"), F.format_string("(assert " + x + ")\n", F.col("a").cast("string"), F.col("b").cast("string")), F.format_string("(assert (bvult x (_ bv%s 8)))\n(check-sat)\n", limit))
    return discharged(pairs.withColumn("query", query)).select("a", "b", "verdict")


def sums(parts: DataFrame) -> DataFrame:
    """k, verdict: is there a 16-bit x below 1000 with x + size = k? A question for each part, so there are ever more of them."""
    bv = lambda c: F.concat(F.lit("(_ bv"), F.pmod(F.col(c), F.lit(1 << 16)).cast("string"), F.lit(" 16)"))
    query = F.concat(F.lit("(declare-const x (_ BitVec 16))\n(assert (= (bvadd x "), bv("size"), F.lit(") "), bv("k"), F.lit("))\n(assert (bvult x (_ bv1000 16)))\n(check-sat)\n"))
    return discharged(parts.withColumn("query", query)).select("k", "verdict")

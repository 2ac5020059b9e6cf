"""Clauses of function summaries, and facts carried along a function's instructions.

A clause's term is text with its tokens set apart by blanks; a parameter reads p<i>, a result r<i>. Substitution works
on tokens, all at once, so what is put in is never itself replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound(term: Column, args: Column, results: Column | None = None) -> Column:
    """term with arguments in place of parameters (and results of r<i>); null where one is missing."""

    def token(t: Column) -> Column:
        i = F.substring(t, F.lit(2), F.length(t)).try_cast("int") + 1
        out = F.when(t.rlike("^p[0-9]+$"), F.try_element_at(args, i))
        if results is not None:
            out = out.when(t.rlike("^r[0-9]+$"), F.try_element_at(results, i))
        return out.otherwise(t)

    tokens = F.transform(F.split(term, " "), token)
    return F.when(~F.exists(tokens, lambda t: t.isNull()), F.array_join(tokens, " "))


def instantiated(clauses: DataFrame, sites: DataFrame, results: bool = False) -> DataFrame:
    """Callees' clauses at call sites, as (caller, callee, site, tag, term); a clause with a missing argument raises nothing.
    clauses: (func, tag, term); sites: (caller, callee, site, args[, results])."""
    c = clauses.select(F.col("func").alias("callee"), "tag", F.col("term").alias("formal"))
    both = sites.join(c, "callee")
    term = bound(F.col("formal"), F.col("args"), F.col("results") if results else None)
    return both.select("caller", "callee", "site", "tag", term.alias("term")).where("term is not null")


def deduplicated(clauses: DataFrame) -> DataFrame:
    """One row per (func, side, tag, term), the earliest ord staying."""
    return clauses.groupBy("func", "side", "tag", "term").agg(F.min("ord").alias("ord"))


def merged(inferred: DataFrame, annotated: DataFrame) -> DataFrame:
    """inferred, and of annotated what isn't there with the same formula, whatever its tag. provenance says which."""
    new = annotated.join(inferred.select("func", "side", "term").distinct(), ["func", "side", "term"], "left_anti")
    cols = ["func", "side", "tag", "term", "ord"]
    return inferred.select(*cols, F.lit("Inferred").alias("provenance")).unionByName(new.select(*cols, F.lit("Annotated").alias("provenance")))


def forwarded(instrs: DataFrame, func: str, order: list[str], stores: Column, load_key: Column) -> DataFrame:
    """Loads of the same address between two stores see one value: adds epoch (stores so far) and, for a load (load_key is not
    null), first_<c> for each c of order: the place of the first load of its address in its epoch. One sort serves both windows' partitions by func."""
    so_far = Window.partitionBy(func).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = instrs.withColumn("epoch", F.count(F.when(stores, 1)).over(so_far)).withColumn("addr", load_key)
    same = Window.partitionBy(func, "epoch", "addr").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct(*order)).over(same)
    return df.where("addr is not null").withColumn("f", first).select(*df.columns, *[F.col(f"f.{c}").alias(f"first_{c}") for c in order])

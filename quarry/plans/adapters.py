"""Views that read the star-schema tables as program facts, over all their rows.

An order is a function; a customer's orders, in order of date, call the next one, and an urgent one also the one before (so
there are recursive groups); a line item is an instruction with sites to check; a user's events are channel operations in
six-hour buckets; a conversation is a control-flow graph of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bounds

#: An earlier version of the program knew the orders before this day, and the findings of line items shipped before it.
BASE_DAY = "2000-01-01"
#: Module whose findings are in scope.
MODULE = "shop/f"
ENTRY_LOC = "struct<root_kind: string, root_id: string, path: array<int>>"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def func_name() -> str:
    """SQL for the function name of an order."""
    return "CASE WHEN o_orderpriority = '2-HIGH' THEN concat('(*shop/', lower(o_orderstatus), '.Order).Get', cast(o_orderkey AS string)) ELSE concat('shop/', lower(o_orderstatus), '.Get', cast(o_orderkey AS string)) END"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee (order keys), those of a customer together."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.lead("o_orderkey").over(w).alias("n"), F.lag("o_orderkey").over(w).alias("p"))
    callees = F.expr("filter(array(n, if(o_orderpriority = '1-URGENT', p, null)), x -> x is not null)")
    return o.select(F.col("o_orderkey").alias("caller"), F.explode(callees).alias("callee"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee (order keys), distinct."""
    return calls(spark, d).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, those of a customer together."""
    return calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def order_nodes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("node"))


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(now, base), each (func, hash); the base has no orders from BASE_DAY on, and pending ones were open then."""
    o = t(spark, d, "orders")
    h = lambda status: F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), status, "o_orderpriority"), 256).alias("hash")
    now = o.select(F.col("o_orderkey").alias("func"), h(F.col("o_orderstatus")))
    was = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "3-MEDIUM"), "O").otherwise(F.col("o_orderstatus"))
    return now, o.where(F.col("o_orderdate") < F.lit(BASE_DAY).cast("timestamp_ntz")).select(F.col("o_orderkey").alias("func"), h(was))


def order_funcs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", F.expr(func_name()).alias("func"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the numbers that the checks look at."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return t(spark, d, "lineitem").join(part, "l_partkey").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_brand", "p_size", "l_shipdate",
        "cast(round(l_discount * 100) as int) as divisor", "cast(round(l_tax * 100) as int) as tax", "cast(floor(l_extendedprice) as bigint) as price", "cast(l_quantity as int) as quantity",
    )


def findings(spark: SparkSession, d: str, old: str | None = None) -> DataFrame:
    """One row per violated check of a line item: all checks in a single pass. old: the name of a further column, whether the earlier version had it."""
    s = sites(spark, d).join(order_funcs(spark, d).withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    rule = lambda bad, checker, tag, text, severity: F.when(bad, F.struct(F.lit(checker).alias("checker"), F.lit(tag).alias("tag"), F.lit(text).alias("text"), F.lit(severity).alias("severity")))
    rules = F.array(
        rule(bounds.div_zero(F.col("divisor")), "bounds", "div-zero", "division by zero in ", "error"),
        rule(bounds.convert_violation(F.col("price"), 64, True, 16, True), "bounds", "overflow", "integer overflow in ", "error"),
        rule(bounds.index_violation(F.col("l_linenumber"), F.col("p_size")), "bounds", "bounds", "index/slice out of bounds in ", "error"),
        rule(F.col("tax") == 0, "nil", "nil-deref", "nil dereference in ", "warning"),
    )
    x = s.select("func", F.col("p_brand").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("int").alias("col"), (F.col("l_shipdate") < F.lit(BASE_DAY).cast("timestamp_ntz")).alias("was"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return x.select("r.checker", "r.tag", "func", "file", "line", "col", F.concat("r.text", "func").alias("message"), "r.severity", *([F.col("was").alias(old)] if old else []))


def ignores(spark: SparkSession, d: str) -> DataFrame:
    """func, checker: low-priority orders carry an ignore for `nil`."""
    return t(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.expr(func_name()).alias("func"), F.lit("nil").alias("checker"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """func (user), loc (bucket), op, root_kind, event_id, ts: channel operations. Purchases of the system's accounts (an even value in cents) are at an unknown place."""
    op = F.expr("CASE event_type WHEN 'view' THEN 'Recv' WHEN 'click' THEN 'Send' WHEN 'purchase' THEN 'Close' WHEN 'signup' THEN 'Make' WHEN 'error' THEN 'Select' END")
    loc = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 21600)
    return t(spark, d, "events").select(F.col("user_id").alias("func"), loc.cast("long").alias("loc"), op.alias("op"), F.lit("Global").alias("root_kind"), "event_id", "ts").where("op is not null")


def line_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects of orders: what a line item's flag says, at a place that its line number and supplier name, as often as lines say so."""
    line = t(spark, d, "lineitem")
    return line.selectExpr(
        "cast(l_orderkey as string) as func", "'chan' as domain",
        "CASE l_linenumber % 4 WHEN 0 THEN 'Param' WHEN 1 THEN 'Global' WHEN 2 THEN 'FreeVar' ELSE 'Alloc' END as root_kind",
        "CASE l_linenumber % 4 WHEN 0 THEN cast(l_suppkey % 2 as string) WHEN 1 THEN cast(l_suppkey % 10 as string) WHEN 2 THEN '0' ELSE cast(l_linenumber as string) END as root_id",
        "CASE WHEN l_linenumber % 4 = 0 THEN array(cast(l_suppkey % 3 as int)) ELSE cast(array() as array<int>) END as path",
        "CASE l_returnflag WHEN 'R' THEN 'Recv' WHEN 'A' THEN 'Send' ELSE 'Close' END as op",
    )


def order_effects(spark: SparkSession, d: str) -> DataFrame:
    return line_effects(spark, d).distinct()


def order_sites(spark: SparkSession, d: str) -> DataFrame:
    """Call sites between orders. The first argument is the caller's own first parameter, one field deeper where the status is F; the second a global; a
    captured variable is bound to the caller's second parameter, unless the order is urgent."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("caller"), "o_orderstatus", "o_orderpriority", "o_custkey")
    e = call_edges(spark, d).join(o, "caller")
    loc = lambda k, i, p: f"cast(named_struct('root_kind', {k}, 'root_id', {i}, 'path', {p}) as {ENTRY_LOC})"
    deep = "if(o_orderstatus = 'F', array(7), cast(array() as array<int>))"
    none = "cast(array() as array<int>)"
    return e.selectExpr(
        "cast(caller as string) as caller", "cast(callee as string) as callee",
        f"array({loc(chr(39) + 'Param' + chr(39), chr(39) + '0' + chr(39), deep)}, {loc(chr(39) + 'Global' + chr(39), 'cast(o_custkey % 5 as string)', none)}) as args",
        f"if(o_orderpriority = '1-URGENT', cast(array() as array<{ENTRY_LOC}>), array({loc(chr(39) + 'Param' + chr(39), chr(39) + '1' + chr(39), none)})) as bindings",
    )


def brands_required(spark: SparkSession, d: str) -> DataFrame:
    """iface (nation), m: each nation's interface has two brands."""
    n = t(spark, d, "nation")
    return n.selectExpr("n_nationkey as iface", "explode(array(concat('Brand#', cast(1 + n_nationkey as string)), concat('Brand#', cast(1 + (n_nationkey + 7) % 25 as string)))) as m")


def brands_provided(spark: SparkSession, d: str) -> DataFrame:
    """impl (order), m (brand it ships)."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("m"))
    return t(spark, d, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("impl"), "m").distinct()


def cfg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of conversations: a turn leads to the next; a user's also to the one after that; an assistant's also back two."""
    b = t(spark, d, "conversations").groupBy(F.col("conv_id").alias("func"), F.col("turn").alias("b")).agg(F.min("role").alias("role"))
    w = Window.partitionBy("func").orderBy("b")
    x = b.select("func", "b", "role", F.lead("b").over(w).alias("n1"), F.lead("b", 2).over(w).alias("n2"), F.lag("b", 2).over(w).alias("p2"))
    to = F.filter(F.array(F.col("n1"), F.when(F.col("role") == "user", F.col("n2")), F.when(F.col("role") == "assistant", F.col("p2"))), lambda v: v.isNotNull())
    return b.select("func", "b"), x.select("func", F.col("b").alias("src"), F.posexplode(to).alias("succ_pos", "dst"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))


def clause_rows(spark: SparkSession, d: str) -> DataFrame:
    """Inferred clauses of orders: a line's quantity bounds a parameter, as often as a line says so."""
    return t(spark, d, "lineitem").selectExpr("l_orderkey as func", "'requires' as side", "lower(l_returnflag) as tag", "concat('( bvult p', cast(l_linenumber % 3 as string), ' ', cast(cast(l_quantity as int) % 8 as string), ' )') as term", "l_linenumber as ord")


def annotated_rows(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").selectExpr("o_orderkey as func", "'requires' as side", "'contract' as tag", "concat('( bvult p', cast(o_custkey % 3 as string), ' ', cast(o_orderkey % 8 as string), ' )') as term", "0 as ord")


def call_args(spark: SparkSession, d: str) -> DataFrame:
    """Call sites with argument terms; a low-priority caller has no term for its second argument, and no site has a third."""
    o = t(spark, d, "orders").selectExpr("o_orderkey as caller", "array(concat('v', cast(o_custkey as string)), if(o_orderpriority = '5-LOW', null, concat('p', cast(o_orderkey % 2 as string)))) as args")
    return call_edges(spark, d).join(o, "caller").select("caller", "callee", F.col("callee").alias("site"), "args")

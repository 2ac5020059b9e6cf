"""Queries over the program of programs.py, and over instructions made of line items, with the same said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotations, render
from ..operators import bodies, cfg, checkers, effects, graph, lowering, report
from ..sources import types
from ..storage import saved
from . import adapters as a
from . import cache, programs, verdicts

# -- lowering

KINDS = [*lowering.DIRECT, *lowering.EFFECTS, *lowering.DROPPED, "Unheard"]
TOKENS = ["+", "-", "*", "/", "%", "<-", "!", "==", "<", "&^", "??"]
CALLEES = ["(*sync.Mutex).Lock", "(*sync.RWMutex).RUnlock", "close", "shop.F"]


def wire(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(instructions as decoded, values): a line item is an instruction of its order; which, say its part, supplier and quantity."""
    pick = lambda xs, c: f"element_at(array({', '.join(repr(x) for x in xs)}), cast({c} % {len(xs)} as int) + 1)"
    line = a.t(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey as string) as func", "0 as b", "cast(l_linenumber as int) as i", f"{pick(KINDS, 'l_partkey')} as kind", "cast(l_suppkey % 4 as int) as register", "1 as type_id",
        "transform(sequence(1, 1 + cast(l_quantity as int) % 4), x -> x * 10) as operands", "'f.go' as file", "cast(l_linenumber as int) as line", "1 as col", "cast(null as string) as detail",
        f"{pick(TOKENS, 'cast(l_quantity as int)')} as token", "cast(l_suppkey % 3 as int) as field", f"{pick([*CALLEES], 'l_suppkey')} as target", "cast(l_quantity as int) % 3 as way", "7 as iface", "'M' as method", "9 as sig",
        "if(l_suppkey % 5 = 0, null, l_suppkey % 5 = 1) as blocking", "if(l_suppkey % 7 = 0, null, l_suppkey % 7 = 1) as comma_ok", "l_suppkey % 2 = 0 as heap", "cast(l_suppkey % 6 as int) as idx",
    )
    kind = F.when(F.col("way") == 0, F.lit(None)).when(F.col("target") == "close", "Builtin").otherwise("Static")
    w = line.withColumn("callee_kind", kind).withColumn("callee", F.when(F.col("way") == 0, F.lit(None)).otherwise(F.col("target"))).drop("way", "target")
    value = a.t(spark, d, "orders").where("o_orderkey % 3 > 0").selectExpr("cast(o_orderkey as string) as func", "10 as vid", "'Function' as kind", "concat('shop.C', o_orderkey) as ref_name")
    return w, value


def lowered_ops(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return lowering.lowered(*wire(spark, d)).select("func", "i", "op", "dst", "a0", "a1", "a2", "a3", flat("operands"), "field", "sub", "callee_kind", "callee", "blocking", "comma_ok")


def lowered_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each instruction of the program's functions."""
    f = programs.facts(spark, d)
    return lowering.lines(f["instr"], f["select_arm"]).select("func", "b", "i", "line")


# -- structure


def program_edges(f: dict[str, DataFrame]) -> DataFrame:
    """Static calls, and calls of functions through closures: caller, callee."""
    return f["instr"].where("callee_kind = 'Static' and op in ('Call', 'Go', 'Defer')").select(F.col("func").alias("caller"), "callee").distinct()


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    f = programs.facts(spark, d)
    none = f["instr"].where("false").select(F.col("func").alias("caller"), "callee")
    return graph.call_graph(program_edges(f), none, none)


def address_taken(spark: SparkSession, d: str) -> DataFrame:
    f = programs.facts(spark, d)
    return graph.address_taken(f["instr"], f["value"], f["func"].select("func", F.col("name").alias("skey")))


def topological_order(spark: SparkSession, d: str) -> DataFrame:
    return cfg.ordered(cfg.analysed(*a.cfg(spark, d), only=("topo",)))


def own_effects(spark: SparkSession, d: str) -> DataFrame:
    e = bodies.own_effects(programs.bodied(spark, d))
    return e.select("func", "domain", "root_kind", "root_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "op")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """The effects of the groups with channels and locks, as text."""
    f = programs.facts(spark, d, (7, 9))
    return effects.text(bodies.summaries(saved(bodies.bodies(f), "program"), f["func"], program_edges(f))).join(f["func"].select("func"), "func")


def prepass(spark: SparkSession, d: str) -> DataFrame:
    f = programs.facts(spark, d)
    return effects.value_clean(effects.dirty(f["instr"], f["value"]), f["func"].select("func", "has_body"))


# -- checkers


def compiled(spark: SparkSession, d: str) -> DataFrame:
    return saved(annotations.compiled_rows(programs.annotations(spark, d)), "annotations")


def annotated(c: DataFrame) -> DataFrame:
    return c.where("side in ('requires', 'ensures')").select("func", "side", "tag", "term", "shown")


def program_findings(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the nil, bounds and contract checkers find."""
    df = programs.bodied(spark, d)
    return checkers.findings(df, annotated=annotated(compiled(spark, d))).select("checker", "tag", "func", "message", "file", "line", "severity", F.array_join(F.transform("trace", lambda x: x.cast("string")), ">").alias("trace"))


def inferred_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Preconditions and postconditions that the checkers infer."""
    return checkers.analysed(programs.bodied(spark, d))[1].select("func", "side", "tag", "term")


def nil_ensures(spark: SparkSession, d: str) -> DataFrame:
    """What results promise, and the dereferences that rely on it in vain."""
    rows, clauses = checkers.analysed(programs.bodied(spark, d, (5,)), rules=("nil",))
    return clauses.select("func", F.col("term").alias("what")).unionByName(rows.where("kind = 'finding'").select("func", F.col("message").alias("what")))


def contract_findings(spark: SparkSession, d: str) -> DataFrame:
    return checkers.findings(programs.bodied(spark, d, (6,)), annotated=annotated(compiled(spark, d)), rules=("contract",)).select("checker", "tag", "func", "message", "severity")


def annotation_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Annotations as clauses, ignores and errors."""
    return compiled(spark, d).select("func", "side", "term", "shown", "checker", "message")


def leak_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Blocking operations of spawned functions: whether their channel escapes, and its capacity."""
    return bodies.leak_candidates(programs.bodied(spark, d, (7, 8))).select("spawner", "callee", "kind", "op_block", "op_instr", "escapes", "capacity", "cap")


def leak_findings(spark: SparkSession, d: str) -> DataFrame:
    """Goroutines that block for ever, confirmed by a query over both functions."""
    f = programs.facts(spark, d, (7, 8))
    df = saved(bodies.bodies(f), "program")
    summary = bodies.summaries(df, f["func"], program_edges(f))
    _, clauses = checkers.analysed(df, rules=("nil",))
    return checkers.leak_findings(df, bodies.leaks(df, summary), clauses).select("checker", "tag", "func", "message", "line")


def query_keys(spark: SparkSession, d: str) -> DataFrame:
    p = a.t(spark, d, "part")
    return p.select("p_partkey", cache.query_key(F.concat(F.lit("é "), "p_name"), "quarry", 2000).alias("key"))


def package_keys(spark: SparkSession, d: str) -> DataFrame:
    """Nations are packages that depend on their region's; a file each."""
    n, r = a.t(spark, d, "nation"), a.t(spark, d, "region")
    name = lambda c: F.concat(F.lit(f"{c}/"), F.col(f"{c[0]}_name"))
    packages = n.select(name("nation").alias("pkg")).unionByName(r.select(name("region").alias("pkg")))
    files = packages.select("pkg", F.lit("a.go").alias("path"), F.sha2("pkg", 256).alias("sha256"))
    deps = n.join(r, n.n_regionkey == r.r_regionkey).select(name("nation").alias("pkg"), name("region").alias("dep"))
    return cache.package_keys(packages, files, deps, "tool-1")


def program_dump(spark: SparkSession, d: str) -> DataFrame:
    f = programs.facts(spark, d)
    return lowering.dumped(f["func"], f["param"], f["value"], f["cfg_edge"], f["block"], f["instr"], f["select_arm"])


def package_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of packages, one for each part: a list that points to itself, a function over it, an array as long as the size, and a pointer to nothing."""
    t = "struct<type_id: int, repr: string, kind: string, elem: int, key: int, array_len: bigint, chan_dir: string, fields: array<struct<name: string, type: int, embedded: boolean>>, params: array<int>, results: array<int>, variadic: boolean, name: string>"
    row = lambda i, repr_, kind, elem="null", n="null", fields="null", params="null", results="null", name="null": f"named_struct('type_id', {i}, 'repr', {repr_}, 'kind', '{kind}', 'elem', {elem}, 'key', null, 'array_len', {n}, 'chan_dir', null, 'fields', {fields}, 'params', {params}, 'results', {results}, 'variadic', false, 'name', {name})"
    node = "concat('shop.T', size % 5)"
    rows = [
        row(1, "'int'", "Basic", name="'int'"), row(2, node, "Named", 3, name=node), row(3, f"concat('struct of ', {node})", "Struct", fields="array(named_struct('name', 'next', 'type', 4, 'embedded', true), named_struct('name', 'n', 'type', 1, 'embedded', false))"),
        row(4, f"concat('*', {node})", "Pointer", 2), row(5, f"concat('func of ', {node})", "Signature", params="array(4, 1)", results="array(2)"), row(6, "concat('[', size, ']int')", "Array", 1, "size"), row(7, "'*none'", "Pointer", 99),
    ]
    cast = ", ".join(f"cast({x} as {t})" for x in rows)
    part = programs.spread(a.t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return part.selectExpr("concat('p', p_partkey) as import_path", "p_size as size").select("import_path", F.explode(F.expr(f"array({cast})")).alias("r")).select("import_path", "r.*")


def global_types(spark: SparkSession, d: str) -> DataFrame:
    x = types.imported(package_types(spark, d))
    return x.select("repr", "kind", "elem", "array_len", F.array_join("params", ",").alias("params"), F.array_join(F.transform("fields", lambda f: f["type"]), ",").alias("fields"))


def smt_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the bounds checker asks of the groups with constants, solved from its text."""
    df = programs.bodied(spark, d, (0, 3))
    _, clauses = checkers.analysed(df, rules=("bounds",))
    return verdicts.discharged(checkers.questions(df, clauses)).select("func", "tag", "verdict")


def json_findings(spark: SparkSession, d: str) -> DataFrame:
    return render.json_rows(report.fingerprinted(a.findings(spark, d)))


def sarif_findings(spark: SparkSession, d: str) -> DataFrame:
    f = report.fingerprinted(a.findings(spark, d))
    return render.sarif_rows(f.withColumn("status", F.when(F.col("severity") == "warning", "ignored").otherwise("kept")))


def text_findings(spark: SparkSession, d: str) -> DataFrame:
    """Header lines of a report."""
    return a.findings(spark, d).select(render.header().alias("line"))


def triage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of other tools' reports read into their fields; documents' first lines are none."""
    lines = a.findings(spark, d).select(F.concat("file", F.lit(":"), "line", F.lit(":"), "col", F.lit(": "), "severity", F.lit(": "), "message", F.lit(" ["), "checker", F.lit("/"), "tag", F.lit("]")).alias("value"))
    return report.triage_lines(lines.unionByName(a.t(spark, d, "documents").select(F.split("text", "\n")[0].alias("value"))))


def named_functions(spark: SparkSession, d: str) -> DataFrame:
    return report.named(a.order_funcs(spark, d), "Get1").select("func")


QUERIES = {
    "program_dump": program_dump,
    "global_types": global_types,
    "structural_keys": lambda s, d: types.structural_keys(package_types(s, d)),
    "smt_verdicts": smt_verdicts,
    "solver_sums": lambda s, d: verdicts.sums(a.t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))),
    "json_findings": json_findings,
    "sarif_findings": sarif_findings,
    "text_findings": text_findings,
    "triage_lines": triage_lines,
    "named_functions": named_functions,
    "lowered_ops": lowered_ops,
    "lowered_text": lowered_text,
    "program_call_graph": call_graph,
    "address_taken": address_taken,
    "topological_order": topological_order,
    "own_effects": own_effects,
    "program_summaries": summaries,
    "prepass_rule": prepass,
    "program_findings": program_findings,
    "inferred_clauses": inferred_clauses,
    "nil_ensures": nil_ensures,
    "contract_findings": contract_findings,
    "annotation_clauses": annotation_clauses,
    "leak_bodies": leak_bodies,
    "leak_findings": leak_findings,
    "query_keys": query_keys,
    "package_keys": package_keys,
}

_P = "p AS (SELECT p_partkey AS k, p_size AS size, p_partkey % 10 AS g FROM part)"
_LEN = "strlen({0}) || ':' || {0}"


def _found(rows: list[tuple]) -> str:
    """checker, tag, role, message (k and size in braces), condition, line, severity, trace."""
    text = lambda m: "'" + m.replace("'", "''").replace("{k}", "' || k || '").replace("{size}", "' || size || '") + "'"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS checker, '{t}' AS tag, 'shop/{r}' || k AS func, {text(m)} AS message, {'NULL' if line is None else repr('shop.go')} AS file, CAST({'NULL' if line is None else line} AS INT) AS line, '{s}' AS severity, {'NULL' if trace is None else repr(trace)} AS trace FROM p WHERE {w}"
        for c, t, r, m, w, line, s, trace in rows
    )


_OUT = "index/slice out of bounds in shop/"
_CONTRACTS = [
    ("contract", "contract", "CallLimited", "call to shop/Limited{k} violates annotated requires `x < {size}`", "g = 6 AND (size + k) % 50 >= size", 0, "error", "0"),
    ("unverified-annotation", "unverified-annotation", "Positive", "annotated ensures `ret >= 0` not proven against the body; callers still assume it", "g = 6 AND size < 25", None, "warning", None),
]
_FINDINGS = [
    ("bounds", "bounds", "Index", _OUT + "Index{k}", "g = 0 AND size >= 16", 0, "error", "0"),
    ("bounds", "div-zero", "Divide", "division by zero in shop/Divide{k}", "g = 0 AND size % 5 = 0", 0, "error", "0"),
    ("bounds", "overflow", "Narrow", "integer overflow in shop/Narrow{k}", "g = 0 AND size * 7 > 127", 0, "error", "0"),
    ("nil", "nil-deref", "PassNil", "call to shop/PassOn{k} violates its nil-deref requirement", "g = 1", 0, "error", "0"),
    ("nil", "nil-deref", "UseInverted", "call to shop/Inverted{k} violates its nil-deref requirement", "g = 2", 0, "error", "0"),
    ("bounds", "bounds", "Made", _OUT + "Made{k}", "g = 3 AND size % 9 >= size % 7", 1, "error", "0"),
    ("bounds", "bounds", "Sliced", _OUT + "Sliced{k}", "g = 3 AND size % 9 < size % 7", 1, "error", "0"),
    ("bounds", "div-zero", "CallBy", "call to shop/By{k} violates its div-zero requirement", "g = 4 AND size % 4 = 0", 0, "error", "0"),
    ("nil", "nil-deref", "Hasty", "possibly-nil result of shop/Find{k} dereferenced in shop/Hasty{k}", "g = 5", 3, "error", "0"),
    *_CONTRACTS,
]
_STATIC = [
    (1, "PassOn", "Deref"), (1, "PassNil", "PassOn"), (1, "PassNew", "PassOn"), (1, "GoNil", "Deref"), (2, "UseGuarded", "Guarded"), (2, "UseInverted", "Inverted"), (4, "CallBy", "By"), (4, "Dead", "By"),
    (5, "UseNew", "New"), (5, "Hasty", "Find"), (5, "Careful", "Find"), (5, "UseAny", "Any"), (6, "CallLimited", "Limited"), (6, "UsePositive", "Positive"), (7, "Spawn", "Sender"), (7, "Drain", "Sender"), (7, "Give", "Sender"),
    (8, "WaitOn", "Waiter"), (8, "WaitOff", "Waiter"), (8, "Choose", "Chooser"), (9, "UseLock", "Lock"), (9, "Capture", "Closure"),
]
_OWN = [  # group, function, domain, root, id, path, operation
    (1, "PassNil", None, None, None, None, None), (1, "GoNil", "spawn", "Unknown", "", "", "Bounded"), (7, "Sender", "chan", "Param", "0", "", "Send"), (7, "Spawn", "chan", "Alloc", "1", "", "Make"),
    (7, "Spawn", "spawn", "Unknown", "", "", "Bounded"), (7, "Drain", "chan", "Alloc", "1", "", "Make"), (7, "Drain", "spawn", "Unknown", "", "", "Bounded"), (7, "Drain", "chan", "Alloc", "1", "", "Recv"),
    (7, "Give", "chan", "Alloc", "1", "", "Make"), (7, "Give", "spawn", "Unknown", "", "", "Bounded"), (7, "Give", "chan", "Param", "0", "", "Send"), (8, "Waiter", "chan", "Param", "0", "", "Recv"),
    (8, "WaitOn", "chan", "Alloc", "1", "", "Make"), (8, "WaitOn", "spawn", "Unknown", "", "", "Bounded"), (8, "WaitOff", "chan", "Alloc", "1", "", "Make"), (8, "WaitOff", "spawn", "Unknown", "", "", "Bounded"),
    (8, "Chooser", "chan", "Param", "0", "", "Select"), (8, "Chooser", "chan", "Param", "1", "", "Select"), (8, "Choose", "chan", "Alloc", "1", "", "Make"), (8, "Choose", "chan", "Alloc", "2", "", "Make"),
    (8, "Choose", "spawn", "Unknown", "", "", "Bounded"), (9, "Lock", "lock", "Param", "0", "' || size % 3 || '", "Lock"), (9, "Lock", "lock", "Param", "0", "' || size % 3 || '", "DeferredUnlock"),
    (9, "Closure", "chan", "FreeVar", "0", "", "Close"), (9, "Capture", "chan", "Alloc", "4", "", "Make"), (9, "Capture", "spawn", "Unknown", "", "", "Bounded"), (9, "Loop", "chan", "Param", "0", "", "Close"), (9, "Loop", "spawn", "Unknown", "", "", "Unbounded"),
]
_LINES = {  # effects with those of callees
    (7, "Sender"): "None chan:{p0:[Send]} locks:{}", (7, "Spawn"): "Bounded chan:{alloc:1:[Make,Send]} locks:{}", (7, "Drain"): "Bounded chan:{alloc:1:[Make,Send,Recv]} locks:{}", (7, "Give"): "Bounded chan:{p0:[Send] alloc:1:[Make,Send]} locks:{}",
    (9, "Lock"): "None chan:{} locks:{p0.f{f}:[Lock,DeferredUnlock]}", (9, "UseLock"): "None chan:{} locks:{g:shop.mu.f{f}:[Lock,DeferredUnlock]}", (9, "Closure"): "None chan:{fv:0:[Close]} locks:{}",
    (9, "Capture"): "Bounded chan:{alloc:3:[Close] alloc:4:[Make]} locks:{}", (9, "Loop"): "Unbounded chan:{p0:[Close]} locks:{}",
}
_FUNCS = [(i, r["name"], [x for x in g.t["wire"] if x["func"] == r["func"]]) for i, g in enumerate(programs.groups()) for r in g.t["func"]]
_CLEAN = {"PassOn", "PassNil", "PassNew", "GoNil", "UseGuarded", "UseInverted", "CallBy", "Dead", "New", "Find", "Any", "Limited", "CallLimited", "Positive", "Sender", "Spawn", "Drain", "Give", "Waiter", "WaitOn", "WaitOff", "Chooser", "Choose", "UseLock", "Capture", "Loop"}
_LEAK = "goroutine shop/{c}' || k || ' may block forever: {what}"
_SEND = "send on a spawner-created channel with no receive, close, or select in the spawning environment"
_RECV = "receive on a spawner-created channel with no send, close, or select"
_SELECT = "blocking select whose channels have no counterpart operations"
_KEY = "sha256({0})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


_LOWERED = f"""WITH k AS (SELECT unnest([{', '.join(f"'{k}'" for k in KINDS)}]) AS kind, unnest(range({len(KINDS)})) AS n),
w AS (SELECT CAST(l_orderkey AS VARCHAR) AS func, l_orderkey, CAST(l_linenumber AS INT) AS i, k.kind, l_suppkey % 4 AS reg, 1 + CAST(l_quantity AS INT) % 4 AS n, CAST(l_quantity AS INT) AS q, l_suppkey AS s,
      [{', '.join(f"'{t}'" for t in TOKENS)}][CAST(l_quantity AS INT) % {len(TOKENS)} + 1] AS tok, [{', '.join(f"'{c}'" for c in CALLEES)}][l_suppkey % {len(CALLEES)} + 1] AS target, CAST(l_quantity AS INT) % 3 > 0 AS known
      FROM lineitem JOIN k ON k.n = l_partkey % {len(KINDS)} WHERE k.kind NOT IN ('DebugRef', 'RunDefers')),
o AS (SELECT *, CASE
   WHEN kind IN ('Range', 'Next', 'Unheard') THEN 'Havoc'
   WHEN kind IN ('Call', 'Go', 'Defer') THEN CASE WHEN NOT known THEN 'Havoc' WHEN kind = 'Call' AND target = 'close' THEN 'CloseChan' WHEN kind = 'Call' AND target LIKE '(*sync%' THEN 'Lock' ELSE kind END
   WHEN kind IN ('Store', 'MapUpdate') THEN 'Store' WHEN kind = 'If' THEN 'Branch' WHEN kind IN ('Return', 'Jump', 'Panic', 'Send') THEN kind
   WHEN reg = 0 THEN 'Havoc'
   WHEN kind = 'BinOp' THEN CASE WHEN tok IN ('<-', '!', '??') THEN 'Havoc' ELSE 'BinOp' END
   WHEN kind = 'UnOp' THEN CASE tok WHEN '*' THEN 'Load' WHEN '<-' THEN 'Recv' WHEN '-' THEN 'UnOp' WHEN '!' THEN 'UnOp' ELSE 'Havoc' END
   WHEN kind = 'MakeClosure' THEN CASE WHEN l_orderkey % 3 > 0 THEN 'MakeClosure' ELSE 'Havoc' END
   WHEN kind = 'Select' THEN CASE WHEN s % 5 = 0 THEN 'Havoc' ELSE 'Select' END
   WHEN kind = 'TypeAssert' THEN CASE WHEN s % 7 = 0 THEN 'Havoc' ELSE 'TypeAssert' END
   WHEN kind LIKE 'Make%' AND kind <> 'MakeInterface' THEN 'Make' WHEN kind = 'ChangeType' THEN 'Assign'
   WHEN kind IN ('Convert', 'ChangeInterface', 'SliceToArrayPointer', 'MultiConvert') THEN 'Convert' ELSE kind END AS op FROM w)
SELECT func, i, op, CASE WHEN reg > 0 AND op NOT IN ('Store', 'Return', 'Jump', 'Branch', 'Panic', 'Send', 'Go', 'Defer', 'Lock', 'CloseChan') THEN CAST(reg AS INT) END AS dst,
  CAST(CASE WHEN op IN ('Store', 'IndexAddr', 'Index', 'Lookup', 'BinOp', 'Send', 'Load', 'Recv', 'UnOp', 'FieldAddr', 'Field', 'Slice', 'Convert', 'Assign', 'Extract', 'MakeInterface', 'Branch', 'Panic', 'TypeAssert') THEN 10
       WHEN op IN ('Lock', 'CloseChan') THEN CASE WHEN n > 1 THEN 20 ELSE 0 END END AS INT) AS a0,
  CAST(CASE WHEN kind = 'MapUpdate' THEN CASE WHEN n > 2 THEN 30 ELSE 0 END WHEN op IN ('Store', 'IndexAddr', 'Index', 'Lookup', 'BinOp', 'Send') THEN CASE WHEN n > 1 THEN 20 ELSE 0 END WHEN op = 'Slice' AND n > 1 THEN 20 END AS INT) AS a1,
  CAST(CASE WHEN op = 'Slice' AND n > 2 THEN 30 END AS INT) AS a2, CAST(CASE WHEN op = 'Slice' AND n > 3 THEN 40 END AS INT) AS a3,
  array_to_string([x * 10 FOR x IN range(CASE WHEN (kind IN ('Call', 'Go', 'Defer') AND known) OR kind = 'MakeClosure' THEN 2 ELSE 1 END,
      CASE kind WHEN 'MakeChan' THEN 2 WHEN 'MakeSlice' THEN least(n + 1, 3) ELSE n + 1 END)], ',') AS operands,
  CAST(CASE WHEN op IN ('FieldAddr', 'Field') THEN s % 3 WHEN op = 'Extract' THEN s % 6 WHEN op = 'Alloc' THEN CAST(s % 2 = 0 AS INT) END AS INT) AS field,
  CASE WHEN op = 'BinOp' THEN CASE tok WHEN '+' THEN 'Add' WHEN '-' THEN 'Sub' WHEN '*' THEN 'Mul' WHEN '/' THEN 'Div' WHEN '%' THEN 'Rem' WHEN '==' THEN 'Eq' WHEN '<' THEN 'Lt' ELSE 'AndNot' END
       WHEN op = 'UnOp' THEN CASE tok WHEN '-' THEN 'Neg' ELSE 'Not' END WHEN op = 'Make' THEN substr(kind, 5) WHEN op = 'Lock' THEN CASE WHEN target LIKE '%RUnlock' THEN 'RUnlock' ELSE 'Lock' END END AS sub,
  CASE WHEN op IN ('Call', 'Go', 'Defer') THEN CASE target WHEN 'close' THEN 'Builtin' ELSE 'Static' END END AS callee_kind,
  CASE WHEN op IN ('Call', 'Go', 'Defer') THEN target WHEN op = 'MakeClosure' THEN 'shop.C' || l_orderkey END AS callee,
  CASE WHEN op = 'Select' THEN s % 5 = 1 END AS blocking, CASE WHEN op IN ('Recv', 'Lookup', 'TypeAssert') THEN coalesce(s % 7 = 1, FALSE) AND s % 7 <> 0 END AS comma_ok
FROM o"""


def _text(x: dict) -> str:
    """An instruction of a template as text, in SQL."""
    o, kind = x["operands"], x["kind"]
    v = lambda i: f"v{o[i]}"
    vs = lambda xs: " ".join(f"v{i}" for i in xs)
    callee = x.get("callee") or ""
    who = "' || 'shop/" + callee.split("'")[1].removeprefix("shop/") + "' || k || '" if isinstance(callee, programs.Sql) else callee
    called = f"call-builtin {who}({vs(o[1:])})" if x.get("callee_kind") == "Builtin" else f"call {who}({vs(o[1:])})"
    token = {"/": "Div", "%": "Rem", "==": "Eq", "!=": "Neq"}
    body = {
        "Index": lambda: f"index {v(0)} {v(1)}", "BinOp": lambda: f"binop {token[x['token']]} {v(0)} {v(1)}", "Convert": lambda: f"convert {v(0)}", "Return": lambda: f"return {vs(o)}",
        "UnOp": lambda: f"load {v(0)}" if x["token"] == "*" else f"recv {v(0)} ok=false", "Alloc": lambda: "alloc heap=true", "If": lambda: f"branch {v(0)}", "Jump": lambda: "jump",
        "Slice": lambda: f"slice {v(0)} [{v(1)}:{v(2)}:]", "IndexAddr": lambda: f"index-addr {v(0)} {v(1)}", "MakeSlice": lambda: f"make Slice {vs(o[:2])}", "MakeChan": lambda: f"make Chan {v(0)}",
        "Extract": lambda: f"extract {v(0)} #{x['idx']}", "MakeInterface": lambda: f"make-interface {v(0)}", "Send": lambda: f"send {v(0)} <- {v(1)}", "Store": lambda: f"store {v(0)} <- {v(1)}",
        "FieldAddr": lambda: f"field-addr {v(0)} #' || size % 3 || '", "MakeClosure": lambda: f"make-closure ' || 'shop/Closure' || k || ' [{vs(o[1:])}]", "Select": lambda: "select blocking=true [recv v1, send v2 <- v3]",
        "Call": lambda: f"lock {v(1)}" if callee == "(*sync.Mutex).Lock" else f"close {v(1)}" if callee == "close" else called, "Go": lambda: f"go {called}", "Defer": lambda: f"defer {called}",
    }[kind]()
    return f"v{x['register']} = {body}" if x["register"] else body


def _per_func(rows: list[tuple]) -> str:
    """SELECTs over p, one for each (group, columns in SQL)."""
    return " UNION ALL ".join(f"SELECT {cols} FROM p WHERE g = {g}" for g, cols in rows)


def _asserted(term: str, *consts: str) -> str:
    """The canonical text of one assertion; term: SQL for it."""
    return "|| chr(10) || ".join([*[f"'(declare-const {c})' " for c in consts], f"'(assert ' || {term} || ')' ", "'(check-sat)' "]) + "|| chr(10)"


_NOT_P0, _NOT_R0, _EITHER = _asserted("'(not p0.nil)'", "p0.nil Bool"), _asserted("'(not r0.nil)'", "r0.nil Bool"), _asserted("'(or (not r1.nil) (not r0.nil))'", "r0.nil Bool", "r1.nil Bool")
_CLAUSES = [
    (1, "Deref", "requires", "nil-deref", _NOT_P0), (1, "PassOn", "requires", "nil-deref", _NOT_P0), (2, "Inverted", "requires", "nil-deref", _NOT_P0),
    (4, "By", "requires", "div-zero", _asserted("'(not (= p1 (_ bv0 8)))'", "p1 (_ BitVec 8)")), (5, "New", "ensures", "nil-deref", _NOT_R0), (5, "Find", "ensures", "nil-deref", _EITHER),
]

def _dumped(g: programs.Group, row: dict) -> str:
    """The text of a template's function, in SQL."""
    own = lambda t: [r for r in g.t[t] if r["func"] == row["func"]]
    out = f"func shop/{row['name']}' || k || ' ({', '.join(f'v{r["vid"]}' for r in own('param'))})\n"
    for v in sorted(own("value"), key=lambda r: r["vid"]):
        if v["kind"] == "Const":
            x = v.get("const_int")
            what = "const Nil" if v["const_kind"] == "Nil" else f"const Bool({str(v['const_bool']).lower()})" if v["const_kind"] == "Bool" else f"const Int(' || ({x}) || ')"
        elif v["kind"] in ("Global", "Function"):
            what = f"{'global' if v['kind'] == 'Global' else 'func'} " + (v["ref_name"].split("'")[1] + "' || k || '" if isinstance(v["ref_name"], programs.Sql) else v["ref_name"])
        else:
            continue
        out += f"  aux v{v['vid']} = {what}\n"
    for b in own("block"):
        out += f"  b{b['b']} -> [{', '.join(str(e['dst']) for e in own('cfg_edge') if e['src'] == b['b'])}]\n" + "".join(f"    {_text(x)}\n" for x in own("wire") if x["b"] == b["b"])
    return "'" + out.replace("\n", "' || chr(10) || '") + "'"


_NODE = "'shop.T' || size % 5"
_JSON = """'{"fingerprint":"' || fingerprint || '","checker":"' || checker || '","tag":"' || tag || '","severity":"' || severity || '","func":"' || func || '","pos":{"file":"' || file || '","line":' || line || ',"col":' || col || '},"message":"' || message || '"}'"""
_SARIF = """'{"ruleId":"' || tag || '","level":"' || severity || '","message":{"text":"' || message || '"},"partialFingerprints":{"quarry/v1":"' || fingerprint || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || line || ',"startColumn":' || col || '}}}]'
    || CASE WHEN severity = 'warning' THEN ',"suppressions":[{"kind":"inSource"}]' ELSE '' END || '}'"""


def report_oracles(findings: str, prints, funcs: str) -> dict[str, str]:
    """SQL of the queries on reports, from the catalogue's parts."""
    return {
        "json_findings": f"WITH {findings} SELECT {_JSON} AS line FROM {prints('findings')}",
        "sarif_findings": f"WITH {findings} SELECT {_SARIF} AS line FROM {prints('findings')}",
        "text_findings": f"WITH {findings} SELECT file || ':' || line || ':' || col || ': ' || CASE severity WHEN 'warning' THEN 'warning: ' ELSE '' END || tag || ': ' || message || ' [' || func || ']' AS line FROM findings",
        "triage_lines": f"WITH {findings} SELECT file, line, col, severity, message, checker, tag, TRUE AS ok FROM findings UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN text IS NOT NULL THEN FALSE END FROM documents",
        "named_functions": f"WITH {funcs} SELECT func FROM funcs WHERE contains(func, 'Get1')",
    }


ORACLES = {
    "program_dump": f"WITH {_P} " + _per_func([(i, f"'shop/{r['name']}' || k AS func, {_dumped(g, r)} AS text") for i, g in enumerate(programs.groups()) for r in g.t["func"]]),
    "global_types": f"""WITH {_P} SELECT DISTINCT {_NODE} AS repr, 'Named' AS kind, 'struct of ' || {_NODE} AS elem, NULL::BIGINT AS array_len, NULL AS params, NULL AS fields FROM p
        UNION SELECT 'struct of ' || {_NODE}, 'Struct', NULL, NULL, NULL, '*' || {_NODE} || ',int' FROM p UNION SELECT '*' || {_NODE}, 'Pointer', {_NODE}, NULL, NULL, NULL FROM p
        UNION SELECT 'func of ' || {_NODE}, 'Signature', NULL, NULL, '*' || {_NODE} || ',int', NULL FROM p UNION SELECT '[' || size || ']int', 'Array', 'int', size, NULL, NULL FROM p
        UNION SELECT 'int', 'Basic', NULL, NULL, NULL, NULL FROM p UNION SELECT '*none', 'Pointer', '?', NULL, NULL, NULL FROM p""",
    "structural_keys": f"""WITH {_P}, n AS (SELECT 'p' || k AS import_path, size, {_NODE} || '=struct{{+next:*(~),n:int}}' AS node FROM p)
        SELECT import_path, 1::INT AS type_id, 'int' AS skey FROM n UNION ALL SELECT import_path, 2, node FROM n UNION ALL SELECT import_path, 3, 'struct{{+next:*(~),n:int}}' FROM n UNION ALL SELECT import_path, 4, '*(~)' FROM n
        UNION ALL SELECT import_path, 5, 'func(*(~),int)(' || node || ')' FROM n UNION ALL SELECT import_path, 6, '[' || size || '](int)' FROM n UNION ALL SELECT import_path, 7, '*(?)' FROM n""",
    "smt_verdicts": f"""WITH {_P}, q(g, role, tag) AS (VALUES (0, 'Index', 'bounds'), (0, 'Divide', 'div-zero'), (0, 'Divide', 'overflow'), (0, 'Narrow', 'overflow'), (3, 'Made', 'bounds'), (3, 'Sliced', 'bounds'))
        SELECT 'shop/' || role || k AS func, tag, CASE WHEN CASE role WHEN 'Index' THEN size >= 16 WHEN 'Divide' THEN tag = 'div-zero' AND size % 5 = 0 WHEN 'Narrow' THEN size * 7 > 127 WHEN 'Made' THEN size % 9 >= size % 7 ELSE size % 9 < size % 7 END THEN 'sat' ELSE 'unsat' END AS verdict FROM p JOIN q USING (g)""",
    "solver_sums": "SELECT p_partkey AS k, CASE WHEN (p_partkey % 65536 - p_size + 65536) % 65536 < 1000 THEN 'sat' ELSE 'unsat' END AS verdict FROM part",
    "lowered_ops": _LOWERED,
    "lowered_text": f"WITH {_P} " + _per_func([(g, f"'shop/{role}' || k AS func, {x['b']} AS b, {x['i']} AS i, '{_text(x)}' AS line") for g, role, xs in _FUNCS for x in xs]),
    "program_call_graph": f"WITH {_P}, s(g, a, b) AS (VALUES {_values(_STATIC)}) SELECT 'shop/' || a || k AS caller, 'shop/' || b || k AS callee FROM p JOIN s USING (g) UNION ALL SELECT 'shop/Lock' || k, '(*sync.Mutex).Unlock' FROM p WHERE g = 9",
    "address_taken": f"WITH {_P} SELECT 'Closure' AS skey, 'shop/Closure' || k AS func FROM p WHERE g = 9",
    "topological_order": "SELECT func, b, row_number() OVER (PARTITION BY func ORDER BY b) - 1 AS place FROM (SELECT DISTINCT conv_id AS func, turn AS b FROM conversations)",
    "own_effects": f"WITH {_P} " + _per_func([(g, f"'shop/{f}' || k AS func, '{d}' AS domain, '{r}' AS root_kind, '{i}' AS root_id, '{path}' AS path, '{op}' AS op") for g, f, d, r, i, path, op in _OWN if d]),
    "program_summaries": f"WITH {_P} " + _per_func([(g, f"'shop/{f}' || k AS func, 'shop/{f}' || k || ' effects={{spawns:{line.replace('{f}', chr(39) + ' || size % 3 || ' + chr(39))}}}' AS line") for (g, f), line in _LINES.items()]),
    "prepass_rule": f"WITH {_P}, f(g, role, clean) AS (VALUES {_values([(g, r, int(r in _CLEAN)) for g, r, _ in _FUNCS])}) SELECT 'shop/' || role || k AS func, clean = 1 AS value_clean FROM p JOIN f USING (g)",
    "program_findings": f"WITH {_P} {_found(_FINDINGS)}",
    "contract_findings": f"WITH {_P} SELECT checker, tag, func, message, severity FROM ({_found(_CONTRACTS)})",
    "inferred_clauses": f"WITH {_P} " + _per_func([(g, f"'shop/{f}' || k AS func, '{side}' AS side, '{tag}' AS tag, {term} AS term") for g, f, side, tag, term in _CLAUSES]),
    "nil_ensures": f"WITH {_P} " + _per_func([(5, f"'shop/New' || k AS func, {_NOT_R0} AS what"), (5, f"'shop/Find' || k, {_EITHER}"), (5, "'shop/Hasty' || k, 'possibly-nil result of shop/Find' || k || ' dereferenced in shop/Hasty' || k")]),
    "annotation_clauses": f"""WITH {_P}, x AS (SELECT * FROM p WHERE g = 6)
        SELECT 'shop/Limited' || k AS func, 'requires' AS side, {_asserted("'(bvslt p0 (_ bv' || size || ' 64))'", "p0 (_ BitVec 64)")} AS term, 'x < ' || size AS shown, NULL AS checker, NULL AS message FROM x
        UNION ALL SELECT 'shop/Positive' || k, 'ensures', {_asserted("'(bvsle (_ bv0 64) r0)'", "r0 (_ BitVec 64)")}, 'ret >= 0', NULL, NULL FROM x
        UNION ALL SELECT 'shop/Positive' || k, CASE WHEN size % 2 = 0 THEN 'bad' ELSE 'ignore' END, NULL, NULL, CASE WHEN size % 2 = 1 THEN 'bounds' END, CASE WHEN size % 2 = 0 THEN 'invalid annotation: unknown name y' END FROM x""",
    "leak_bodies": f"""WITH {_P}, c(g, spawner, callee, kind, op_block, op_instr, escapes, of) AS (VALUES {_values([*[(7, s, 'Sender', 'Send', 0, i, int(s == 'Give'), 4) for s in ('Spawn', 'Drain', 'Give') for i in (0, 1)], (8, 'WaitOn', 'Waiter', 'Recv', 1, 0, 0, 1), (8, 'WaitOff', 'Waiter', 'Recv', 1, 0, 0, 1), (8, 'Choose', 'Chooser', 'Select', 0, 0, 0, 2)])})
        SELECT 'shop/' || spawner || k AS spawner, 'shop/' || callee || k AS callee, kind, op_block, op_instr, escapes = 1 AS escapes,
        CASE WHEN kind = 'Select' AND size % 2 = 1 THEN 'Silent' WHEN kind = 'Send' AND size % of > 0 THEN 'Buffered' ELSE 'Unbuffered' END AS capacity, CASE WHEN kind = 'Send' AND size % of > 0 THEN CAST(size % of AS BIGINT) END AS cap FROM p JOIN c USING (g)""",
    "leak_findings": f"""WITH {_P}, n AS (SELECT unnest([0, 1]) AS i) SELECT 'goroutine-leak' AS checker, 'chan-send-leak' AS tag, 'shop/Spawn' || k AS func, '{_LEAK.format(c='Sender', what=_SEND)}' AS message, 1 AS line FROM p, n WHERE g = 7 AND i >= size % 4
        UNION ALL SELECT 'goroutine-leak', 'chan-recv-leak', 'shop/' || r || k, '{_LEAK.format(c='Waiter', what=_RECV)}', 1 FROM p, (SELECT unnest(['WaitOn', 'WaitOff']) AS r) WHERE g = 8
        UNION ALL SELECT 'goroutine-leak', 'chan-select-leak', 'shop/Choose' || k, '{_LEAK.format(c='Chooser', what=_SELECT)}', 2 FROM p WHERE g = 8 AND size % 2 = 0""",
    "query_keys": "SELECT p_partkey, sha256('6:quarry' || '4:2000' || strlen('é ' || p_name) || ':' || 'é ' || p_name) AS key FROM part",
    "package_keys": """WITH pk AS (SELECT 'nation/' || n_name AS pkg, 'region/' || r_name AS dep FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'region/' || r_name, NULL FROM region),
        h AS (SELECT pkg, dep, sha256('6:tool-1' || strlen(pkg) || ':' || pkg || '69:a.go=' || sha256(pkg)) AS own FROM pk),
        r AS (SELECT pkg, sha256('16:quarry-package-1' || '64:' || own || '0:') AS key FROM h WHERE dep IS NULL)
        SELECT pkg, key FROM r UNION ALL SELECT h.pkg, sha256('16:quarry-package-1' || '64:' || h.own || '64:' || r.key) FROM h JOIN r ON r.pkg = h.dep""",
}

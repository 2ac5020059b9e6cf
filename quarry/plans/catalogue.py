"""The queries: each is a library operator applied to an adapter view, over whole tables.

`ORACLES` has for most of them an independent formulation in SQL; queries without one are held against brute
force by the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotations, render
from ..operators import bounds, cfg, clauses, effects, graph, report
from ..storage import saved
from . import adapters as a
from . import cache, program_queries, verdicts

Query = Callable[[SparkSession, str], DataFrame]

REPORT = ["fingerprint", "checker", "tag", "func", "file", "line", "col", "message", "severity"]


def affected(spark: SparkSession, d: str) -> DataFrame:
    """func names of orders changed since the base, and of all that call them."""
    now, base = a.versions(spark, d)
    keys = graph.callers_closure(a.calls(spark, d), report.changed_functions(now, base), now)
    return keys.select(F.col("func").alias("o_orderkey")).join(a.order_funcs(spark, d), "o_orderkey").select("func")


def scoped(spark: SparkSession, d: str) -> DataFrame:
    return report.scope_findings(a.findings(spark, d), a.MODULE)


def versioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(findings in scope, fingerprints of those that the earlier version had): the tables are scanned and joined once for both."""
    f = saved(report.scope_findings(a.findings(spark, d, "old"), a.MODULE), "findings")
    return f.drop("old"), report.fingerprinted(f.where("old").drop("old")).select("fingerprint")


def check_report(spark: SparkSession, d: str) -> DataFrame:
    """All report operators in their order: scope, earlier version, fingerprints, ignores, baseline, denial."""
    now, base = versioned(spark, d)
    f = report.diff_scope(now, affected(spark, d), a.order_funcs(spark, d))
    return report.flagged_report(f, a.ignores(spark, d), base, deny=True).select(*REPORT, "status")


def deny_exit_summary(spark: SparkSession, d: str) -> DataFrame:
    now, base = versioned(spark, d)
    return report.summary(report.flagged_report(now, a.ignores(spark, d), base, deny=True))


def split(spark: SparkSession, d: str, part: int) -> DataFrame:
    now, base = versioned(spark, d)
    return report.split_baseline(report.fingerprinted(now), base)[part].select(*REPORT)


def ignore_split(spark: SparkSession, d: str) -> DataFrame:
    return report.flag_ignored(report.fingerprinted(scoped(spark, d)), a.ignores(spark, d)).select("fingerprint", "func", "checker", "ignored")


def diff_scoped_report(spark: SparkSession, d: str) -> DataFrame:
    return report.diff_scope(a.findings(spark, d), affected(spark, d), a.order_funcs(spark, d))


def condensation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.condensation(a.order_nodes(spark, d), a.edges(spark, d))


def scc(spark: SparkSession, d: str) -> DataFrame:
    c, e = saved(condensation(spark, d)[0], "scc"), a.edges(spark, d)
    return c.join(graph.scc_sizes(c, e), "scc").select("node", "scc", "size", "recursive")


def wave_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.wave_depth(*condensation(spark, d))


def shape(spark: SparkSession, d: str, *only: str) -> DataFrame:
    return cfg.analysed(*a.cfg(spark, d), only=only)


def effect_rows(spark: SparkSession, d: str) -> DataFrame:
    return a.events(spark, d).select("func", "loc", "op", "root_kind")


def leak_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = effect_rows(spark, d).distinct()
    return effects.without_counterpart(e.where("op in ('Send', 'Recv')").select("func", "loc", F.col("op").alias("kind")), e).select("func", "loc", "kind")


def select_arm_leaks(spark: SparkSession, d: str) -> DataFrame:
    """A user's select in a bucket has a send arm there and a receive arm in the next bucket."""
    e = effect_rows(spark, d).distinct()
    s = e.where("op = 'Select'").select("func", F.col("loc").alias("select_loc"))
    arms = s.select("func", "select_loc", F.explode(F.expr("array(named_struct('loc', select_loc, 'kind', 'Send'), named_struct('loc', select_loc + 1, 'kind', 'Recv'))")).alias("x")).select("func", "select_loc", "x.loc", "x.kind")
    return effects.blocked_selects(arms, e, ["func", "select_loc"])


def buffer_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Sends of a bucket beyond the room that its signups make."""
    e = a.events(spark, d)
    caps = e.where("op = 'Make'").groupBy("func", "loc").agg(F.count(F.lit(1)).alias("cap"))
    return effects.over_capacity(e.where("op = 'Send'"), caps, ["func", "loc"], ["ts", "event_id"]).select("event_id", "ordinal", "cap")


def prepass_clean(spark: SparkSession, d: str) -> DataFrame:
    """Orders none of whose lines divides by a small discount, or converts a price that needs more bits; an order without lines has no body."""
    s = a.sites(spark, d).select(F.col("l_orderkey").alias("func"), (bounds.div_zero(F.col("divisor")) | bounds.convert_violation(F.col("price"), 64, True, 16, True)).alias("dirty"))
    bodies = s.select("func").distinct().withColumn("has", F.lit(True))
    funcs = a.order_nodes(spark, d).select(F.col("node").alias("func")).join(bodies, "func", "left").select("func", F.coalesce("has", F.lit(False)).alias("has_body"))
    return effects.value_clean(s, funcs)


def slice_violations(spark: SparkSession, d: str) -> DataFrame:
    """items[line - 2 : quantity % 9 : size % 11 if even] of a list of quantity % 7 items with room for size % 10."""
    s = a.sites(spark, d).selectExpr("*", "l_linenumber - 2 as low", "if(quantity % 9 = 0, null, quantity % 9) as high", "if(p_size % 2 = 0, p_size % 11, null) as top", "quantity % 7 as len", "p_size % 10 as cap")
    bad = bounds.slice_violation(*[F.col(c) for c in ("low", "high", "top", "len", "cap")])
    return s.where(bad).select("l_orderkey", "l_linenumber", "low", "high", "top", "len", "cap")


CASES = [(64, True, 16, True), (64, True, 8, False), (64, True, 64, False), (16, False, 8, False), (16, False, 16, True)]


def narrowing_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Which conversions of price - 30000 (of price % 65536 where the source is unsigned) overflow, for all sign pairs."""
    s = a.sites(spark, d)
    value = {True: F.col("price") - 30000, False: F.col("price") % 65536}
    flags = [bounds.convert_violation(value[c[1]], *c).alias(f"c{i}") for i, c in enumerate(CASES)]
    return s.select("l_orderkey", "l_linenumber", "price", *flags)


def div_overflow(spark: SparkSession, d: str) -> DataFrame:
    """(quantity - 178) / (line - 2) at 8 bits; quantity 50 gives the least value."""
    s = a.sites(spark, d).selectExpr("*", "quantity - 178 as lhs", "l_linenumber - 2 as rhs")
    return s.where(bounds.div_overflow(F.col("lhs"), F.col("rhs"), 8)).select("l_orderkey", "l_linenumber", "lhs", "rhs")


def load_forwarding(spark: SparkSession, d: str) -> DataFrame:
    x = clauses.forwarded(a.turns(spark, d), "conv_id", ["turn", "role", "size"], F.col("role") == "system", F.when(F.col("role") != "system", F.col("role")))
    return x.select("conv_id", "turn", "role", "size", "epoch", "first_turn")


def clause_dedup(spark: SparkSession, d: str) -> DataFrame:
    return clauses.merged(clauses.deduplicated(a.clause_rows(spark, d)), clauses.deduplicated(a.annotated_rows(spark, d)))


def requires_instantiation(spark: SparkSession, d: str) -> DataFrame:
    return clauses.instantiated(clauses.deduplicated(a.clause_rows(spark, d)), a.call_args(spark, d)).select("caller", "callee", "tag", "term")


def effects_join(spark: SparkSession, d: str) -> DataFrame:
    e = effect_rows(spark, d).select("func", F.lit("chan").alias("domain"), "root_kind", F.col("loc").cast("string").alias("root_id"), F.expr("cast(array() as array<int>)").alias("path"), "op")
    return effects.join(e, effects.top(e.where("op = 'Select'").select("func").distinct())).select("func", "domain", "root_kind", "root_id", "op")


def _flat(e: DataFrame) -> DataFrame:
    return e.select("func", "domain", "root_kind", "root_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "op")


def effects_rebase(spark: SparkSession, d: str) -> DataFrame:
    return _flat(effects.rebased(a.line_effects(spark, d), a.order_sites(spark, d)))


def effects_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return _flat(effects.fixpoint(a.line_effects(spark, d), a.order_sites(spark, d), a.calls(spark, d)))


def dynamic_targets(spark: SparkSession, d: str) -> DataFrame:
    """Brands call through values of their parts' types."""
    p = a.t(spark, d, "part")
    return graph.dynamic_targets(p.select(F.col("p_brand").alias("caller"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("skey")), p.select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("skey"), F.col("p_partkey").alias("func")))


def triage_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of all lines of all documents, by language."""
    lines = a.t(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return report.triage_classes(lines, F.col("lang"), F.col("line"))


def annotation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as an annotation; total on any input."""
    lines = a.t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "pragma"))
    return lines.select("doc_id", "line", annotations.parsed("pragma").alias("p")).select("doc_id", "line", "p.kind", "p.expr", "p.error")


def scc_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    now, _ = a.versions(spark, d)
    return cache.scc_keys(*condensation(spark, d), now.withColumnRenamed("func", "node"))


QUERIES: dict[str, Query] = {
    "check_report": check_report,
    "scope_findings": scoped,
    "changed_functions": lambda s, d: report.changed_functions(*a.versions(s, d)),
    "callers_closure": lambda s, d: graph.callers_closure(a.calls(s, d), report.changed_functions(*a.versions(s, d)), a.versions(s, d)[0]),
    "diff_scoped_report": diff_scoped_report,
    "fingerprints": lambda s, d: report.fingerprinted(a.findings(s, d)).select(*REPORT, "ordinal"),
    "ignore_split": ignore_split,
    "baseline_kept": lambda s, d: split(s, d, 0),
    "baseline_suppressed": lambda s, d: split(s, d, 1),
    "deny_exit_summary": deny_exit_summary,
    "triage_classes": triage_classes,
    "sanitize_text": lambda s, d: a.t(s, d, "pages").select("page_id", render.sanitized(F.col("html")).alias("html")),
    "call_graph_resolve": lambda s, d: graph.implementers(a.brands_required(s, d), a.brands_provided(s, d)),
    "dynamic_targets": dynamic_targets,
    "scc": scc,
    "scc_edges": lambda s, d: condensation(s, d)[1].select("src", "dst"),
    "wave_depth": wave_depth,
    "callgraph_dump": lambda s, d: graph.dump(a.edges(s, d)),
    "cyclic_blocks": lambda s, d: shape(s, d, "cyclic").select("func", "b", "cyclic", "reachable"),
    "dominators": lambda s, d: cfg.dominance(shape(s, d, "dominators")),
    "ancestors": lambda s, d: cfg.ancestry(shape(s, d, "ancestors")),
    "paths": lambda s, d: graph.closure(a.cfg(s, d)[1], "func"),
    "effects_join": effects_join,
    "effects_rebase": effects_rebase,
    "effects_fixpoint": effects_fixpoint,
    "leak_candidates": leak_candidates,
    "select_arm_leaks": select_arm_leaks,
    "buffer_ordinal": buffer_ordinal,
    "prepass_clean": prepass_clean,
    "index_violations": lambda s, d: a.sites(s, d).where(bounds.index_violation(F.col("l_linenumber") - 2, F.col("p_size"))).select("l_orderkey", "l_linenumber", "p_size"),
    "slice_violations": slice_violations,
    "div_zero": lambda s, d: a.sites(s, d).where(bounds.div_zero(F.col("divisor"))).select("l_orderkey", "l_linenumber", "l_partkey"),
    "div_overflow": div_overflow,
    "narrowing_overflow": narrowing_overflow,
    "load_forwarding": load_forwarding,
    "requires_instantiation": requires_instantiation,
    "clause_dedup": clause_dedup,
    "scc_cache_keys": scc_cache_keys,
    "annotation_parse": annotation_parse,
    "solver_verdicts": lambda s, d: verdicts.products(a.sites(s, d)),
}

# -- the same in SQL

_EDGES = """
po AS (SELECT o_orderkey, o_orderpriority, lead(o_orderkey) OVER w AS n, lag(o_orderkey) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT o_orderkey AS src, n AS dst FROM po WHERE n IS NOT NULL UNION SELECT o_orderkey, p FROM po WHERE p IS NOT NULL AND o_orderpriority = '1-URGENT')"""
_CHANGED = f"""
nowv AS (SELECT o_orderkey AS func, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS hash FROM orders),
basev AS (SELECT o_orderkey AS func, sha256(o_orderkey || '|' || CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'O' ELSE o_orderstatus END || '|' || o_orderpriority) AS hash
          FROM orders WHERE o_orderdate < TIMESTAMP '{a.BASE_DAY}'),
changed AS (SELECT n.func FROM nowv n WHERE NOT EXISTS (SELECT 1 FROM basev b WHERE b.func = n.func AND b.hash = n.hash)),
callers(func) AS (SELECT func FROM changed UNION SELECT e.src FROM callers c JOIN edges e ON e.dst = c.func)"""
_FUNCS = """
funcs AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '2-HIGH' THEN '(*shop/' || lower(o_orderstatus) || '.Order).Get' || o_orderkey
          ELSE 'shop/' || lower(o_orderstatus) || '.Get' || o_orderkey END AS func FROM orders)"""
_SITES = """
site AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand, p_size, l_shipdate, CAST(round(l_discount * 100) AS INT) AS divisor, CAST(round(l_tax * 100) AS INT) AS tax,
         CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(l_quantity AS INT) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_FINDINGS = f"""{_FUNCS},{_SITES},
raw AS (SELECT s.*, f.func FROM site s JOIN funcs f ON f.o_orderkey = s.l_orderkey),
every AS (
  SELECT 'bounds' AS checker, 'div-zero' AS tag, 'division by zero in ' || func AS message, 'error' AS severity, * FROM raw WHERE divisor = 0
  UNION ALL SELECT 'bounds', 'overflow', 'integer overflow in ' || func, 'error', * FROM raw WHERE price NOT BETWEEN -32768 AND 32767
  UNION ALL SELECT 'bounds', 'bounds', 'index/slice out of bounds in ' || func, 'error', * FROM raw WHERE l_linenumber < 0 OR l_linenumber >= p_size
  UNION ALL SELECT 'nil', 'nil-deref', 'nil dereference in ' || func, 'warning', * FROM raw WHERE tax = 0),
findings AS (SELECT checker, tag, func, p_brand AS file, l_linenumber AS line, CAST(l_suppkey AS INT) AS col, message, severity, l_shipdate FROM every)"""
_IN_SCOPE = f"(regexp_replace(func, '^\\(?\\*?', '') LIKE '{a.MODULE}.%' OR regexp_replace(func, '^\\(?\\*?', '') LIKE '{a.MODULE}/%')"


def _prints(source: str) -> str:
    return f"""(SELECT *, 'v1:' || substr(sha256('quarry-finding-1|' || strlen(checker) || ':' || checker || strlen(func) || ':' || func || strlen(tag) || ':' || tag || strlen(message) || ':' || message || '#' || ordinal), 1, 32) AS fingerprint
      FROM (SELECT *, row_number() OVER (PARTITION BY checker, func, tag, message ORDER BY file NULLS FIRST, line NULLS FIRST, col NULLS FIRST) - 1 AS ordinal FROM {source}))"""


_COLS = ", ".join(REPORT)
_REPORTED = f"""{_FINDINGS},
inscope AS (SELECT checker, tag, func, file, line, col, message, severity FROM findings WHERE {_IN_SCOPE}),
old AS (SELECT checker, tag, func, file, line, col, message, severity FROM findings WHERE {_IN_SCOPE} AND l_shipdate < TIMESTAMP '{a.BASE_DAY}'),
base AS (SELECT DISTINCT fingerprint FROM {_prints("old")}),
printed AS {_prints("inscope")}"""
_KNOWN = "EXISTS (SELECT 1 FROM base b WHERE b.fingerprint = p.fingerprint)"
_IGNORED = "EXISTS (SELECT 1 FROM funcs f WHERE f.func = p.func AND f.o_orderpriority = '5-LOW' AND p.checker = 'nil')"

_CFG = """
blocks AS (SELECT conv_id AS func, turn AS b, min(role) AS role FROM conversations GROUP BY ALL),
bx AS (SELECT *, lead(b) OVER w AS n1, lead(b, 2) OVER w AS n2, lag(b, 2) OVER w AS p2 FROM blocks WINDOW w AS (PARTITION BY func ORDER BY b)),
fwd AS (SELECT func, b AS src, n1 AS dst FROM bx WHERE n1 IS NOT NULL UNION SELECT func, b, n2 FROM bx WHERE n2 IS NOT NULL AND role = 'user'),
cfg AS (SELECT * FROM fwd UNION SELECT func, b, p2 FROM bx WHERE p2 IS NOT NULL AND role = 'assistant'),
path(func, src, dst) AS (SELECT * FROM cfg UNION SELECT p.func, p.src, e.dst FROM path p JOIN cfg e ON e.func = p.func AND e.src = p.dst)"""
_SCC = f"""{_EDGES},
reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst),
comp AS (SELECT o_orderkey AS node, least(o_orderkey, coalesce((SELECT min(x.dst) FROM reach x JOIN reach y ON y.src = x.dst AND y.dst = x.src WHERE x.src = o_orderkey), o_orderkey)) AS scc FROM orders),
dag AS (SELECT DISTINCT s.scc AS src, t.scc AS dst FROM edges e JOIN comp s ON s.node = e.src JOIN comp t ON t.node = e.dst WHERE s.scc <> t.scc)"""
_EVENTS = """
ev AS (SELECT user_id AS func, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS loc, CASE event_type WHEN 'view' THEN 'Recv' WHEN 'click' THEN 'Send' WHEN 'purchase' THEN 'Close' WHEN 'signup' THEN 'Make' WHEN 'error' THEN 'Select' END AS op, event_id, ts
       FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error'))"""
_ORDER_EFFECTS = f"""{_EDGES},
own AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS func, 'chan' AS domain,
        CASE l_linenumber % 4 WHEN 0 THEN 'Param' WHEN 1 THEN 'Global' WHEN 2 THEN 'FreeVar' ELSE 'Alloc' END AS root_kind,
        CASE l_linenumber % 4 WHEN 0 THEN CAST(l_suppkey % 2 AS VARCHAR) WHEN 1 THEN CAST(l_suppkey % 10 AS VARCHAR) WHEN 2 THEN '0' ELSE CAST(l_linenumber AS VARCHAR) END AS root_id,
        CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_suppkey % 3 AS VARCHAR) ELSE '' END AS path,
        CASE l_returnflag WHEN 'R' THEN 'Recv' WHEN 'A' THEN 'Send' ELSE 'Close' END AS op FROM lineitem),
site AS (SELECT CAST(src AS VARCHAR) AS caller, CAST(dst AS VARCHAR) AS callee, o_orderstatus AS st, o_orderpriority AS pr, o_custkey % 5 AS g FROM edges JOIN orders ON o_orderkey = src)"""


def _rebase(source: str) -> str:
    """A root's new kind, id and path (text, fields joined by dots)."""
    deep = "CASE WHEN s.st = 'F' THEN CASE WHEN e.path = '' THEN '7' ELSE '7.' || e.path END ELSE e.path END"
    return f"""SELECT s.caller AS func, e.domain, r.kind AS root_kind, CASE WHEN r.kind = 'Unknown' THEN '' ELSE r.id END AS root_id, CASE WHEN r.kind = 'Unknown' THEN '' ELSE r.path END AS path, e.op
    FROM {source} e JOIN site s ON s.callee = e.func, LATERAL (SELECT
      CASE WHEN e.root_kind = 'Global' THEN 'Global'
           WHEN e.root_kind = 'Param' AND e.root_id = '0' THEN CASE WHEN len(string_split({deep}, '.')) > 2 THEN 'Unknown' ELSE 'Param' END
           WHEN e.root_kind = 'Param' AND e.root_id = '1' THEN CASE WHEN len(string_split(e.path, '.')) > 2 THEN 'Unknown' ELSE 'Global' END
           WHEN e.root_kind = 'FreeVar' AND s.pr <> '1-URGENT' THEN CASE WHEN len(string_split(e.path, '.')) > 2 THEN 'Unknown' ELSE 'Param' END
           ELSE 'Unknown' END AS kind,
      CASE WHEN e.root_kind = 'Global' THEN e.root_id WHEN e.root_kind = 'Param' AND e.root_id = '0' THEN '0' WHEN e.root_kind = 'Param' THEN CAST(s.g AS VARCHAR) ELSE '1' END AS id,
      CASE WHEN e.root_kind = 'Param' AND e.root_id = '0' THEN {deep} ELSE e.path END AS path) r"""


_TERM = "'( bvult p' || {p} || ' ' || {n} || ' )'"
_INFERRED = f"inferred AS (SELECT l_orderkey AS func, 'requires' AS side, lower(l_returnflag) AS tag, {_TERM.format(p='(l_linenumber % 3)', n='(CAST(l_quantity AS INT) % 8)')} AS term, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL)"
_ABLE = "CASE kind WHEN 'Send' THEN ['Recv', 'Select', 'Close'] ELSE ['Send', 'Select', 'Close'] END"

ORACLES: dict[str, str] = {
    "scope_findings": f"WITH {_FINDINGS} SELECT checker, tag, func, file, line, col, message, severity FROM findings WHERE {_IN_SCOPE}",
    "changed_functions": f"WITH RECURSIVE {_EDGES},{_CHANGED} SELECT func FROM changed",
    "callers_closure": f"WITH RECURSIVE {_EDGES},{_CHANGED} SELECT func FROM callers",
    "diff_scoped_report": f"WITH RECURSIVE {_EDGES},{_CHANGED},{_FINDINGS} SELECT checker, tag, func, file, line, col, message, severity FROM findings WHERE func IN (SELECT f.func FROM funcs f JOIN callers c ON c.func = f.o_orderkey)",
    "fingerprints": f"WITH {_FINDINGS} SELECT {_COLS}, ordinal FROM {_prints('findings')}",
    "ignore_split": f"WITH {_REPORTED} SELECT fingerprint, func, checker, {_IGNORED} AS ignored FROM printed p",
    "baseline_kept": f"WITH {_REPORTED} SELECT {_COLS} FROM printed p WHERE NOT {_KNOWN}",
    "baseline_suppressed": f"WITH {_REPORTED} SELECT {_COLS} FROM printed p WHERE {_KNOWN}",
    "deny_exit_summary": f"""WITH {_REPORTED}, s AS (SELECT CASE WHEN {_IGNORED} THEN 'i' WHEN {_KNOWN} THEN 'b' ELSE 'k' END AS s FROM printed p)
        SELECT count(*) FILTER (s = 'k') AS total, count(*) FILTER (s = 'i') AS suppressed_pragma, count(*) FILTER (s = 'b') AS suppressed_by_baseline, count(*) FILTER (s = 'k') AS errors,
               CAST(count(*) FILTER (s = 'k') > 0 AS BIGINT) AS exit_code, FALSE AS diff_base_scoped FROM s""",
    "check_report": f"""WITH RECURSIVE {_EDGES},{_CHANGED},{_FINDINGS},
        inscope AS (SELECT checker, tag, func, file, line, col, message, severity FROM findings WHERE {_IN_SCOPE} AND func IN (SELECT f.func FROM funcs f JOIN callers c ON c.func = f.o_orderkey)),
        old AS (SELECT checker, tag, func, file, line, col, message, severity FROM findings WHERE {_IN_SCOPE} AND l_shipdate < TIMESTAMP '{a.BASE_DAY}'),
        base AS (SELECT DISTINCT fingerprint FROM {_prints("old")}),
        printed AS {_prints("inscope")},
        judged AS (SELECT *, CASE WHEN {_IGNORED} THEN 'ignored' WHEN {_KNOWN} THEN 'baseline' ELSE 'kept' END AS status FROM printed p)
        SELECT {_COLS.replace("severity", "CASE WHEN status = 'kept' THEN 'error' ELSE severity END AS severity")}, status FROM judged""",
    "triage_classes": r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
        n AS (SELECT lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"|`[^`]*`', chr(2), 'g'), '[a-zA-Z_][0-9a-zA-Z_]*', 'I', 'g'), '[0-9]+', 'N', 'g'), chr(2), 'S', 'g'), '[ \t]+', ' ', 'g') AS s FROM l)
        SELECT lang || '|' || regexp_replace(regexp_replace(s, '^ ', ''), ' $', '') AS class, count(*) AS n FROM n GROUP BY 1""",
    "sanitize_text": r"SELECT page_id, regexp_replace(replace(html, chr(9), ' '), '[\x00-\x1f\x7f]', '', 'g') AS html FROM pages",
    "call_graph_resolve": """WITH req AS (SELECT n_nationkey AS iface, unnest(['Brand#' || (1 + n_nationkey), 'Brand#' || (1 + (n_nationkey + 7) % 25)]) AS m FROM nation),
        have AS (SELECT DISTINCT l_orderkey AS impl, p_brand AS m FROM lineitem JOIN part ON p_partkey = l_partkey)
        SELECT r.iface, h.impl FROM (SELECT DISTINCT iface, m FROM req) r JOIN have h ON h.m = r.m JOIN (SELECT iface, count(DISTINCT m) AS need FROM req GROUP BY 1) q ON q.iface = r.iface GROUP BY r.iface, h.impl, q.need HAVING count(*) = q.need""",
    "dynamic_targets": "SELECT DISTINCT a.p_brand AS caller, b.p_partkey AS callee FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size",
    "scc": f"WITH RECURSIVE {_SCC} SELECT node, scc, count(*) OVER (PARTITION BY scc) AS size, (count(*) OVER (PARTITION BY scc)) > 1 AS recursive FROM comp",
    "scc_edges": f"WITH RECURSIVE {_SCC} SELECT src, dst FROM dag",
    "wave_depth": f"WITH RECURSIVE {_SCC}, dep(scc, depth) AS (SELECT DISTINCT scc, 0::BIGINT FROM comp UNION SELECT g.src, p.depth + 1 FROM dep p JOIN dag g ON g.dst = p.scc) SELECT scc, max(depth) AS depth FROM dep GROUP BY 1",
    "callgraph_dump": f"WITH {_EDGES} SELECT src || ' -> ' || string_agg(CAST(dst AS VARCHAR), ', ' ORDER BY CAST(dst AS VARCHAR)) AS line FROM edges GROUP BY src",
    "cyclic_blocks": f"WITH RECURSIVE {_CFG} SELECT func, b, EXISTS (SELECT 1 FROM path p WHERE p.func = k.func AND p.src = b AND p.dst = b) AS cyclic, TRUE AS reachable FROM blocks k",
    "paths": f"WITH RECURSIVE {_CFG} SELECT func, src, dst FROM path",
    "ancestors": f"WITH RECURSIVE {_CFG}, up(func, a, b) AS (SELECT func, src, dst FROM fwd UNION SELECT u.func, u.a, e.dst FROM up u JOIN fwd e ON e.func = u.func AND e.src = u.b) SELECT func, a, b FROM up",
    "dominators": f"""WITH RECURSIVE {_CFG}, entry AS (SELECT func, min(b) AS e FROM blocks GROUP BY 1),
        free(func, gone, b) AS (SELECT k.func, k.b, e.e FROM blocks k JOIN entry e USING (func) WHERE k.b <> e.e UNION SELECT f.func, f.gone, w.dst FROM free f JOIN fwd w ON w.func = f.func AND w.src = f.b WHERE w.dst <> f.gone)
        SELECT g.func, g.b AS a, k.b FROM blocks g JOIN blocks k ON k.func = g.func AND k.b <> g.b
        WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.func = g.func AND f.gone = g.b AND f.b = k.b)""",
    "effects_join": f"""WITH {_EVENTS} SELECT DISTINCT func, 'chan' AS domain, 'Global' AS root_kind, CAST(loc AS VARCHAR) AS root_id, op FROM ev
        UNION SELECT func, x[1], 'Unknown', '', x[2] FROM (SELECT DISTINCT func FROM ev WHERE op = 'Select'), (SELECT unnest([['chan', 'Make'], ['chan', 'Send'], ['chan', 'Recv'], ['chan', 'Close'], ['chan', 'Select'], ['lock', 'Lock'],
        ['lock', 'Unlock'], ['lock', 'RLock'], ['lock', 'RUnlock'], ['lock', 'DeferredUnlock'], ['lock', 'DeferredRUnlock'], ['spawn', 'Unbounded']]) AS x)""",
    "effects_rebase": f"WITH {_ORDER_EFFECTS} SELECT DISTINCT * FROM ({_rebase('own')})",
    "effects_fixpoint": f"WITH RECURSIVE {_ORDER_EFFECTS}, fix AS (SELECT * FROM own UNION {_rebase('fix')}) SELECT * FROM fix",
    "leak_candidates": f"""WITH {_EVENTS}, c AS (SELECT DISTINCT func, loc, op AS kind FROM ev WHERE op IN ('Send', 'Recv'))
        SELECT func, loc, kind FROM c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.func = c.func AND ev.loc = c.loc AND list_contains({_ABLE}, ev.op))""",
    "select_arm_leaks": f"""WITH {_EVENTS}, s AS (SELECT DISTINCT func, loc FROM ev WHERE op = 'Select')
        SELECT func, loc AS select_loc FROM s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.func = s.func AND ev.loc = s.loc AND ev.op IN ('Recv', 'Close'))
        AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.func = s.func AND ev.loc = s.loc + 1 AND ev.op IN ('Send', 'Close'))""",
    "buffer_ordinal": f"""WITH {_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY func, loc ORDER BY ts, event_id) - 1 AS ordinal FROM ev WHERE op = 'Send')
        SELECT event_id, ordinal, cap FROM n JOIN (SELECT func, loc, count(*) AS cap FROM ev WHERE op = 'Make' GROUP BY ALL) USING (func, loc) WHERE ordinal >= cap""",
    "prepass_clean": f"WITH {_SITES} SELECT o_orderkey AS func, coalesce((SELECT NOT bool_or(divisor = 0 OR price > 32767 OR price < -32768) FROM site WHERE l_orderkey = o_orderkey), FALSE) AS value_clean FROM orders",
    "index_violations": f"WITH {_SITES} SELECT l_orderkey, l_linenumber, p_size FROM site WHERE NOT (l_linenumber - 2 BETWEEN 0 AND p_size - 1)",
    "slice_violations": f"""WITH {_SITES}, v AS (SELECT l_orderkey, l_linenumber, l_linenumber - 2 AS low, nullif(quantity % 9, 0) AS high, CASE WHEN p_size % 2 = 0 THEN p_size % 11 END AS top, quantity % 7 AS len, p_size % 10 AS cap FROM site)
        SELECT * FROM v WHERE NOT (0 <= low AND low <= coalesce(high, len) AND coalesce(high, len) <= cap AND coalesce(top <= cap, TRUE))""",
    "div_zero": f"WITH {_SITES} SELECT l_orderkey, l_linenumber, l_partkey FROM site WHERE divisor = 0",
    "div_overflow": f"WITH {_SITES} SELECT l_orderkey, l_linenumber, quantity - 178 AS lhs, l_linenumber - 2 AS rhs FROM site WHERE quantity = 50 AND l_linenumber = 1",
    "narrowing_overflow": f"""WITH {_SITES} SELECT l_orderkey, l_linenumber, price, price - 30000 NOT BETWEEN -32768 AND 32767 AS c0, price - 30000 NOT BETWEEN 0 AND 255 AS c1, price - 30000 < 0 AS c2,
        price % 65536 > 255 AS c3, price % 65536 > 32767 AS c4 FROM site""",
    "load_forwarding": """WITH x AS (SELECT conv_id, turn, role, length(text) AS size, count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id ORDER BY turn, role, length(text) ROWS UNBOUNDED PRECEDING) AS epoch FROM conversations)
        SELECT conv_id, turn, role, size, epoch, min(turn) OVER (PARTITION BY conv_id, epoch, role) AS first_turn FROM x WHERE role <> 'system'""",
    "requires_instantiation": f"""WITH {_EDGES}, {_INFERRED},
        site AS (SELECT src, dst, ['v' || o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN 'p' || (o_orderkey % 2) END] AS args FROM edges JOIN orders ON o_orderkey = src),
        x AS (SELECT src, dst, tag, string_split(term, ' ') AS w, args, 1 + CAST(substr(string_split(term, ' ')[3], 2) AS INT) AS i FROM site JOIN inferred ON func = dst)
        SELECT src AS caller, dst AS callee, tag, w[1] || ' ' || w[2] || ' ' || args[i] || ' ' || w[4] || ' ' || w[5] AS term FROM x WHERE args[i] IS NOT NULL""",
    "clause_dedup": f"""WITH {_INFERRED}, annotated AS (SELECT o_orderkey AS func, 'requires' AS side, 'contract' AS tag, {_TERM.format(p='(o_custkey % 3)', n='(o_orderkey % 8)')} AS term, 0 AS ord FROM orders)
        SELECT *, 'Inferred' AS provenance FROM inferred UNION ALL SELECT *, 'Annotated' FROM annotated x WHERE NOT EXISTS (SELECT 1 FROM inferred i WHERE i.func = x.func AND i.side = x.side AND i.term = x.term)""",
    "solver_verdicts": """WITH q AS (SELECT DISTINCT l_linenumber AS a, CAST(l_quantity AS INT) AS b FROM lineitem JOIN part ON p_partkey = l_partkey),
        hit AS (SELECT a, b, bool_or((x * a) % 256 = b AND x < 16 + a * 8) AS s FROM q, range(256) r(x) GROUP BY ALL) SELECT a, b, CASE WHEN s THEN 'sat' ELSE 'unsat' END AS verdict FROM hit""",
}

QUERIES |= program_queries.QUERIES
ORACLES |= program_queries.ORACLES | program_queries.report_oracles(_FINDINGS, _prints, _FUNCS)

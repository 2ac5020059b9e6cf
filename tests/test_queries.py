import pytest
from pyspark.sql import functions as F

from quarry.operators import bounds, cfg, clauses, effects, graph, report
from quarry.plans import adapters, cache, catalogue

from .conftest import SMALL, rows, sql_rows

#: Queries with SQL on their own side, checked here on the smallest tables.
WITH_SQL = sorted(catalogue.ORACLES)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, name):
    assert rows(catalogue.QUERIES[name](spark, SMALL)) == sql_rows(catalogue.ORACLES[name], SMALL)


def test_every_query_is_checked():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"scc_cache_keys", "annotation_parse"}


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (9, 10), (20, 21)]


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    return spark.createDataFrame([(n,) for n in (*range(1, 12), 20, 21)], "node long"), edges


def test_scc_ways_agree(spark, small_graph):
    nodes, edges = small_graph
    a, b = graph.scc(nodes, edges), graph.scc(nodes, edges, limit=0)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {n: n for n in (6, 7, 8, 9, 10, 11, 20, 21)}
    assert {r.node: r.scc for r in a.collect()} == {r.node: r.scc for r in b.collect()} == want
    dag = graph.scc_edges(a, edges)
    d = rows(graph.wave_depth(a, dag))
    assert d == rows(graph.wave_depth(a, dag, limit=0))
    assert {(7, 3), (1, 1), (4, 0), (10, 0), (20, 1)} <= {(x[1], x[0]) for x in d}
    assert {(r.scc, r.size, r.recursive) for r in graph.scc_sizes(a, edges).collect()} >= {(1, 3, True), (6, 1, True), (7, 1, False)}


def test_reach_ways_agree(spark, small_graph):
    _, edges = small_graph
    seeds = spark.createDataFrame([(4,), (10,), (None,)], "func long")
    calls = edges.toDF("caller", "callee")
    for limit in (0, 1, 100):
        assert rows(graph.callers_closure(calls, seeds, limit=limit)) == sorted(((n,) for n in (1, 2, 3, 4, 5, 7, 8, 9, 10)), key=repr)
    assert rows(graph.callers_closure(calls, seeds, seeds.where("func = 4"), limit=0)) == [(n,) for n in (1, 2, 3, 4, 5)]


def test_resolution(spark):
    methods = spark.createDataFrame([(1, "Close", "f()", "a.Close"), (1, "Read", "f()", "a.Read"), (2, "Close", "f()", "b.Close"), (3, "Close", "g()", "c.Close"), (9, "Close", "f()", None)], "type_id int, name string, skey string, func string")
    required = spark.createDataFrame([(7, "Close", "f()"), (7, "Read", "f()"), (8, "Close", "f()")], "iface int, name string, skey string")
    calls = spark.createDataFrame([("m", 7, "Close", "f()"), ("n", 8, "Close", "f()"), ("o", None, "Close", "g()")], "caller string, iface int, name string, skey string")
    assert rows(graph.resolve_invokes(calls, methods, required), "caller", "callee") == [("m", "a.Close"), ("n", "a.Close"), ("n", "b.Close"), ("o", "c.Close")]


def test_ordinals_do_not_depend_on_partitions(spark):
    f = adapters.findings(spark, SMALL)
    a = rows(report.fingerprinted(f.repartition(7)).select("fingerprint", "line"))
    assert a == rows(report.fingerprinted(f.coalesce(1)).select("fingerprint", "line"))


def test_report_filters(spark):
    from quarry.schema import rows as make

    f = make(spark, "finding", [{"checker": c, "tag": t, "func": n, "file": "f", "line": k, "col": 1, "message": "m", "severity": "warning"} for c, t, n, k in (("nil", "nil-deref", "(*m/a.T).F", 1), ("nil", "nil-deref", "(*m/a.T).F", 2), ("x", "bad-annotation", "-", None), ("nil", "nil-deref", "m/ab.F", 3))])
    scoped = report.scope_findings(f, "m/a")
    assert rows(scoped, "func", "line") == [("(*m/a.T).F", 1), ("(*m/a.T).F", 2), ("-", None)]
    known, hit = spark.createDataFrame([("(*m/a.T).F",), ("m/ab.F",)], "func string"), spark.createDataFrame([("m/ab.F",)], "func string")
    assert rows(report.diff_scope(f, hit, known), "func") == [("-",), ("m/ab.F",)]
    prints = report.fingerprinted(scoped)
    base = prints.where("line = 1").select("fingerprint")
    kept, gone = report.split_baseline(prints, base)
    assert rows(gone, "line") == [(1,)] and kept.count() == 2
    flagged = report.flagged_report(scoped, spark.createDataFrame([("-", "x")], "func string, checker string"), base, deny=True)
    assert rows(flagged, "line", "status", "severity") == [(1, "baseline", "warning"), (2, "kept", "error"), (None, "ignored", "warning")]
    total = report.summary(flagged).first()
    assert (total.total, total.suppressed_pragma, total.suppressed_by_baseline, total.exit_code) == (1, 1, 1, 1)
    assert [r.line for r in report.ordered(f).collect()] == [1, 2, 3, None]


def test_normal_form(spark):
    df = spark.createDataFrame([('  x1 := "a b" +  12 ',), ("`raw` != nil[3]",), (None,)], "s string")
    assert [r[0] for r in df.select(report.normal_form(F.col("s"))).collect()] == ["I := S + N", "S != I[N]", None]


@pytest.mark.parametrize("case", [(8, True, 4, True), (8, True, 4, False), (8, True, 8, False), (8, False, 4, False), (8, False, 8, True), (8, False, 4, True), (4, True, 8, True)])
def test_conversions_exhaustively(spark, case):
    ws, ss, wd, sd = case
    lo, hi = (-(1 << (ws - 1)), 1 << (ws - 1)) if ss else (0, 1 << ws)
    dl, dh = (-(1 << (wd - 1)), 1 << (wd - 1)) if sd else (0, 1 << wd)
    got = {r.id: r.v for r in spark.range(lo, hi).select("id", bounds.convert_violation(F.col("id"), ws, ss, wd, sd).alias("v")).collect()}
    assert got == {x: not dl <= x < dh for x in range(lo, hi)}


def test_division(spark):
    df = spark.createDataFrame([(-128, -1), (-128, 1), (-127, -1), (5, 0), (None, 0)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(bounds.div_overflow(a, b, 8), bounds.div_zero(b), bounds.div_overflow(a, b, 8, "Rem")).collect()] == [(True, False, False), (False, False, False), (False, False, False), (False, True, False), (None, True, False)] or df.select(bounds.div_overflow(a, b, 8)).first()[0]
    names = spark.createDataFrame([("int64", "int32"), ("int32", "int64"), ("int64", "uint64"), ("string", "int"), ("float32", "float64")], "s string, t string")
    assert [r[0] for r in names.select(bounds.dirty_convert(F.col("s"), F.col("t"))).collect()] == [True, False, True, True, False]


def test_cfg_by_hand():
    g = cfg.Graph(7, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (4, 5), (6, 6), (5, 99)])
    dag, seen = g.cut()
    assert dag[4] == [5] and seen == [True] * 6 + [False]
    assert g.cyclic() == [False, False, False, True, True, False, True]
    idom = cfg.immediate_dominators(dag)
    assert idom == [0, 0, 0, 0, 3, 4, None]
    assert cfg.strictly_dominates(idom, 0, 5) and not cfg.strictly_dominates(idom, 1, 3) and not cfg.strictly_dominates(idom, 0, 6)
    assert cfg.strict_ancestors(dag)[3] == {0, 1, 2} and cfg.violating_path(dag, {2: True, 3: True}) == [0, 2, 3]
    assert cfg.topological(dag)[0] == 0 and cfg.immediate_dominators([]) == [] and cfg.Graph(0, []).cut() == ([], [])


def test_effects_laws(spark):
    e = adapters.order_effects(spark, SMALL)
    x, y = e.where("op = 'Send'"), e.where("op <> 'Close'")
    assert rows(effects.join(x, y)) == rows(effects.join(y, x)) and rows(effects.join(e, e)) == rows(e)
    s = adapters.order_sites(spark, SMALL)
    fix = effects.fixpoint(x, s)
    assert set(rows(fix)) <= set(rows(effects.fixpoint(effects.join(x, y), s)))


def test_unknown_counterparts_count(spark):
    c = spark.createDataFrame([("f", "a", "Send"), ("g", "a", "Send"), ("h", "a", "Recv")], "func string, loc string, kind string")
    e = spark.createDataFrame([("f", "?", "Recv", "Unknown"), ("g", "b", "Recv", "Alloc"), ("h", "a", "Recv", "Alloc")], "func string, loc string, op string, root_kind string")
    assert rows(effects.without_counterpart(c, e), "func") == [("g",), ("h",)]
    arms = c.withColumn("s", F.lit(1))
    own = spark.createDataFrame([("f", "a", "Select", "Alloc"), ("g", "?", "Select", "Unknown"), ("h", "a", "Send", "Alloc")], "func string, loc string, op string, root_kind string")
    assert rows(effects.blocked_selects(arms, own, ["func"])) == [("f",)]


def test_substitution_is_simultaneous(spark):
    df = spark.createDataFrame([("( f p0 p1 r0 )", ["p1", "p0"], ["x"]), ("( f p2 )", ["a"], ["x"]), ("true", [], [])], "t string, a array<string>, r array<string>")
    assert [r[0] for r in df.select(clauses.bound(F.col("t"), F.col("a"), F.col("r"))).collect()] == ["( f p1 p0 x )", None, "true"]


def test_scc_keys_change_upwards_only(spark, small_graph):
    import hashlib

    nodes, edges = small_graph
    c = graph.scc(nodes, edges)
    dag = graph.scc_edges(c, edges)
    h = {r.node: f"h{r.node}" for r in nodes.collect()}
    frame = lambda d: spark.createDataFrame(list(d.items()), "node long, hash string")
    a = {r.scc: r.key for r in cache.scc_keys(c, dag, frame(h)).collect()}
    b = {r.scc: r.key for r in cache.scc_keys(c, dag, frame(h | {5: "new"})).collect()}
    assert {n for n in a if a[n] != b[n]} == {4, 1}
    f = lambda *x: hashlib.sha256("".join(f"{len(s)}:{s}" for s in x).encode()).hexdigest()
    assert a[4] == f(cache.SALT, "h4,h5", "") and a[1] == f(cache.SALT, "h1,h2,h3", a[4])


def test_store(spark, tmp_path):
    s = cache.Store(spark, f"file://{tmp_path}", "key string, verdict string")
    want = spark.createDataFrame([("a",), ("b",)], "key string")
    hit, miss = s.split(want, "q")
    assert hit.count() == 0 and miss.count() == 2
    s.add(spark.createDataFrame([("a", "sat")], "key string, verdict string"), "q")
    hit, miss = s.split(want, "q")
    assert rows(hit) == [("a", "sat")] and rows(miss) == [("b",)]
    stats = {r.layer: (r.entries, r.bytes > 0) for r in s.stats(["q", "none"]).collect()}
    assert stats == {"q": (1, True), "none": (0, False)}


def test_package_keys(spark):
    p = spark.createDataFrame([("a",), ("b",)], "pkg string")
    f = spark.createDataFrame([("a", "x.go", "1"), ("b", "y.go", "2")], "pkg string, path string, sha256 string")
    d = spark.createDataFrame([("a", "b")], "pkg string, dep string")
    k = {r.pkg: r.key for r in cache.package_keys(p, f, d, "t").collect()}
    k2 = {r.pkg: r.key for r in cache.package_keys(p, f.withColumn("sha256", F.when(F.col("pkg") == "a", "9").otherwise(F.col("sha256"))), d, "t").collect()}
    assert k["b"] == k2["b"] and k["a"] != k2["a"]
    with pytest.raises(ValueError):
        cache.package_keys(p, f, spark.createDataFrame([("a", "zz")], "pkg string, dep string"), "t")
    with pytest.raises(ValueError):
        cache.package_keys(p, f, spark.createDataFrame([("a", "b"), ("b", "a")], "pkg string, dep string"), "t")


def test_effects_of_parts_are_those_of_rounds(spark):
    """A part is worked off where it lies, or by rounds of joins: the same rows, on recursion, missing arguments, deep paths and odd roots."""
    import random

    r = random.Random(5)
    own, sites = [], []
    for _ in range(90):
        kind = r.choice(["Param", "FreeVar", "Global", "Alloc", "Unknown"])
        own.append((r.choice([f"f{r.randrange(25)}"]), r.choice(["chan", "lock"]), kind, "" if kind == "Unknown" else str(r.randrange(3)), [r.randrange(2) for _ in range(r.randrange(3))] if kind != "Unknown" else [], r.choice(["Send", "Recv"])))
    loc = lambda: None if r.random() < 0.1 else (r.choice(["Param", "FreeVar", "Global", "Alloc", "Unknown"]), str(r.randrange(3)), [7] * r.randrange(3))
    for _ in range(40):
        a = r.randrange(25)
        sites.append((f"f{a}", f"f{min(24, max(0, a + r.randrange(-2, 3)))}", [loc() for _ in range(r.randrange(3))], None if r.random() < 0.2 else [loc() for _ in range(r.randrange(3))]))
    x = spark.createDataFrame(own + own[:5], effects.EFFECT)
    s = spark.createDataFrame(sites, f"caller string, callee string, args array<{effects.LOC}>, bindings array<{effects.LOC}>")
    near, far = rows(effects.fixpoint(x, s)), rows(effects.fixpoint(x, s, limit=0))
    assert near == far and len(near) == len(set(near)) > len(rows(x.distinct()))


def test_effects_take_no_rounds(spark, monkeypatch):
    """A chain of calls of any length is one pass: rounds of joins, each of them against all that was found, grow with it."""
    monkeypatch.setattr(effects, "rebased", None)
    x = spark.createDataFrame([("f0", "chan", "Param", "0", [], "Send")], effects.EFFECT)
    s = spark.createDataFrame([(f"f{k + 1}", f"f{k}", [("Param", "0", [])], []) for k in range(300)], f"caller string, callee string, args array<{effects.LOC}>, bindings array<{effects.LOC}>")
    assert effects.fixpoint(x, s).count() == 301


def test_parts_of_edges_that_lie_apart(spark, monkeypatch):
    """Places that each hold a few edges, links between them contracted in one task or by stars: the same parts. Where edges lie in the order of their parts no stars are needed."""
    import random

    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60) if k % 10 != 9] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    whole, stars = rows(graph.weak(df)), rows(graph.weak(df, near=2))
    assert whole == stars and {p for n, p in whole if n < 60} == set(range(0, 60, 10))
    monkeypatch.setattr(graph, "_starred", None)
    chain = spark.range(4000).selectExpr("id - id % 20 as c", "id").selectExpr("id as src", "least(id + 1, c + 19) as dst").coalesce(1)
    assert graph.weak(chain, near=500).select("part").distinct().count() == 200
    names = spark.createDataFrame([("é", "z"), ("z", "a"), ("x", "y")], "src string, dst string")
    assert set(rows(graph.weak(names))) == {("a", "a"), ("z", "a"), ("é", "a"), ("x", "x"), ("y", "x")}


def plan_of(spark, df_of):
    """The plan where nothing is broadcast by an estimate."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df_of()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_few_methods_are_not_joined_on_alone(spark, monkeypatch):
    """A method that very many types have is never the key of a shuffle of them, as long as what is required is small; where it isn't, the same rows."""
    required = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "z"), (4, None), (4, "a"), (5, "c"), (5, "b"), (5, "a")], "iface int, m string")
    provided = spark.createDataFrame([(i, m) for i in range(40) for m in "abc" if (i + ord(m)) % 3 or i % 5 == 0], "impl int, m string")
    have = {i: {m for m in "abc" if (i + ord(m)) % 3 or i % 5 == 0} for i in range(40)}
    want = sorted((f, i) for f, ms in ((1, "ab"), (2, "b"), (5, "abc")) for i in have if set(ms) <= have[i])
    of = lambda: graph.implementers(required, provided)
    assert sorted(rows(of(), "iface", "impl")) == want
    plan = plan_of(spark, of)
    assert "BroadcastHashJoin [m#" in plan and "SortMergeJoin [m#" not in plan
    monkeypatch.setattr("quarry.storage.LIGHT", -1)
    assert sorted(rows(of(), "iface", "impl")) == want


def test_tables_of_packages_that_give_nothing_are_not_made(spark):
    """Where packages describe the same types, only those that a type is taken from are grouped: what is taken is held against the table, not the other way round."""
    from quarry.plans import program_queries
    from quarry.sources import types

    plan = plan_of(spark, lambda: types.imported(program_queries.package_types(spark, SMALL)))
    assert plan.count("BroadcastHashJoin [import_path") == 3 and plan.count("SortMergeJoin") == 1
    part = spark.range(50_000).withColumnRenamed("id", "k")
    assert program_queries.programs.spread(part.coalesce(1), "k").rdd.getNumPartitions() == 3

"""Stored components are replayed; what changed, and what calls it, is analysed again."""

from pyspark.sql import functions as F

from quarry.operators import bodies, checkers
from quarry.plans import cache, programs
from quarry.schema import rows as make
from quarry.sources.types import imported, structural_keys

from .conftest import SMALL, rows
from .test_checkers import PTR, types
from .test_programs import I, Program, static


def test_replay(spark, tmp_path, monkeypatch):
    df = programs.bodied(spark, SMALL, (1, 5))
    plain = rows(checkers.findings(df))
    assert plain
    store = cache.Store(spark, f"file://{tmp_path}/store", checkers.STORED)
    seen = []
    analysed = checkers.analysed

    def counted(df, **kw):
        seen.append(df.count() - (kw["known"][0].count() if kw.get("known") else 0))
        return analysed(df, **kw)

    monkeypatch.setattr(checkers, "analysed", counted)
    hashes = df.select("func", F.sha2(F.to_json("body"), 256).alias("hash"))
    assert rows(checkers.replayed(df, hashes, store)) == plain  # nothing stored
    assert rows(checkers.replayed(df, hashes, store)) == plain  # everything stored
    changed = hashes.withColumn("hash", F.when(F.col("func") == "shop/Deref1", "new").otherwise(F.col("hash")))
    assert rows(checkers.replayed(df, changed, store)) == plain
    assert seen == [df.count(), 0, 5]  # Deref, PassOn, PassNil, PassNew and GoNil


def test_component_keys_do_not_depend_on_the_way(spark):
    comp = spark.createDataFrame([(i, i) for i in range(8)], "node long, scc long")
    dag = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 2), (5, 6)], "src long, dst long")
    hashes = spark.createDataFrame([(i, f"h{i}") for i in range(7)], "node long, hash string")
    a, b = rows(cache.scc_keys(comp, dag, hashes)), rows(cache.scc_keys(comp, dag, hashes, limit=0))
    assert a == b and len(a) == 8
    other = rows(cache.scc_keys(comp, dag, hashes.withColumn("hash", F.when(F.col("node") == 2, "x").otherwise(F.col("hash")))))
    assert {x[1] for x in set(a) - set(other)} == {0, 1, 2, 3}


def test_widening(spark):
    p = Program()
    ret = I("Return")
    for name, callees in (("Deref", ()), ("Ping", ("Pong", "Deref")), ("Pong", ("Ping",)), ("Other", ("Deref",))):
        p.func(name, params=[1], blocks=[[*([I("UnOp", 2, 1, token="*")] if not callees else []), *[static(c, "Call", 0, 1) for c in callees], ret]])
    for name, callee in (("Loop", "Pong"), ("Once", "Other")):
        p.func(name, aux=[(5, "Const", 0)], blocks=[[static(callee, "Call", 0, 5), ret]])
    for r in p.t["value"]:
        r["type_id"] = PTR
        if r["kind"] == "Const":
            r |= {"const_kind": "Nil", "const_int": None}
    f = p.facts(spark)
    f["value"] = f["value"].join(checkers.sorts(types(spark)).drop("import_path"), "type_id", "left")
    df = bodies.bodies(f)
    found = lambda **kw: {r.func for r in checkers.findings(df, **kw).collect()}
    assert found() == {"Loop", "Once"}
    assert found(rounds=1) == {"Once", "Ping"}  # the component wasn't done: it demands nothing of its callers, and so answers itself for what it passes on
    got, clauses = checkers.analysed(df, rounds=1)
    assert rows(checkers.diagnostics(got, clauses)) == [("Ping", "widened"), ("Pong", "widened")]


def test_functions_without_a_formula_are_told(spark, monkeypatch):
    body = programs.bodied(spark, SMALL, (5,)).where("func like 'shop/New%'").first().asDict(True)["body"]

    def allocations(e):
        for i in e.instrs:
            if i["op"] == "Alloc":
                yield i, "heap", "alloc", e.guard(i["b"]), [], []

    got = list(checkers.checked("f", body, {}, [], 100, ("nil", allocations)))
    assert [r[1:5] for r in got if r[1] == "finding"] == [("finding", "heap", "alloc", "alloc in f")]
    monkeypatch.setattr(checkers, "MOST_ASSERTS", 0)
    own = [{"side": "ensures", "tag": "contract", "term": "", "annotated": True, "shown": "ret != nil", "t": ("true",)}]
    got = list(checkers.checked("f", body, {}, own, 100))
    assert [r[1] for r in got] == ["unencoded", "finding"] and got[1][2] == "unverified-annotation"


def test_types_of_a_package(spark):
    kinds = [(1, "Named", "T", 2), (2, "Map", "", 1), (3, "Chan", "", 9), (4, "Tuple", "", 0), (5, "Interface", "", 0)]
    rows_ = [{"type_id": i, "repr": f"r{i}", "kind": k, "name": n, "elem": e, "key": 5, "params": [1, 5] if k == "Tuple" else None} for i, k, n, e in kinds]
    t = make(spark, "type", rows_).withColumn("import_path", F.lit("m"))
    got = {r.type_id: r.skey for r in structural_keys(t).collect()}
    assert got == {1: "T=map(interface,~)", 2: "map(interface,~)", 3: "chan:(?)", 4: "(T=map(interface,~),interface)", 5: "interface"}
    twice = t.unionByName(t.withColumn("import_path", F.lit("a")).withColumn("type_id", F.col("type_id") + 0))
    assert imported(twice).count() == 5 and {r.repr: r.elem for r in imported(twice).collect()}["r3"] == "?"

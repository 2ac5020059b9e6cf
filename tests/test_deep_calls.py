"""Preconditions travel up call chains of any length."""

from pyspark.sql import functions as F

from quarry.operators import bodies, checkers

from .test_checkers import INT, PTR, types
from .test_programs import I, Program, static

DEPTH = 11


def test_deep_chain(spark):
    p, kinds = Program(), {}

    def func(name, ty, **kw):
        kinds.update({(name, v): t for v, t in ty.items()})
        p.func(name, **kw)
        for b in kw["blocks"]:
            for _, r, _, _ in b:
                if r:
                    p.t["value"].append({"func": name, "vid": r, "kind": "Instr"})

    ret = I("Return")
    func("F0", {1: PTR, 2: INT}, params=[1], blocks=[[I("UnOp", 2, 1, token="*"), ret]])
    for k in range(1, DEPTH):
        func(f"F{k}", {1: PTR}, params=[1], blocks=[[static(f"F{k - 1}", "Call", 0, 1), ret]])
    func("Ping", {1: PTR}, params=[1], blocks=[[static("Pong", "Call", 0, 1), static(f"F{DEPTH - 1}", "Call", 0, 1), ret]])
    func("Pong", {1: PTR}, params=[1], blocks=[[static("Ping", "Call", 0, 1), ret]])
    for name, callee in (("Deep", f"F{DEPTH - 1}"), ("Loop", "Pong")):
        func(name, {5: PTR}, aux=[(5, "Const", 0)], blocks=[[static(callee, "Call", 0, 5), ret]])
    for r in p.t["value"]:
        r["type_id"] = kinds.get((r["func"], r["vid"]))
        if r["type_id"] == PTR and r["kind"] == "Const":
            r |= {"const_kind": "Nil", "const_int": None}
    f = p.facts(spark)
    f["value"] = f["value"].join(checkers.sorts(types(spark)).drop("import_path"), "type_id", "left")
    got = {(r.func, r.tag) for r in checkers.findings(bodies.bodies(f)).select(F.col("func"), F.col("tag")).collect()}
    assert got == {("Deep", "nil-deref"), ("Loop", "nil-deref")}

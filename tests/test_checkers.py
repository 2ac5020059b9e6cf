"""The checkers over small functions, written as decoded instructions with the types of their values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import bodies, checkers
from quarry.schema import rows as make

from .test_programs import I, Program, static

TYPES = [(1, "Basic", "int", 0, 0), (2, "Basic", "bool", 0, 0), (3, "Pointer", "", 1, 0), (4, "Slice", "", 1, 0), (5, "Array", "", 1, 4), (6, "Basic", "int8", 0, 0), (7, "Named", "m.N", 1, 0), (8, "Pointer", "", 5, 0), (9, "Named", "m.Loop", 9, 0), (10, "Basic", "uint8", 0, 0)]
INT, BOOL, PTR, SEQ, ARR, I8 = 1, 2, 3, 4, 5, 6


def types(spark):
    return make(spark, "type", [{"type_id": i, "kind": k, "name": n, "elem": e, "array_len": a} for i, k, n, e, a in TYPES]).withColumn("import_path", F.lit("m"))


def test_sorts(spark):
    got = {r.type_id: r.sort for r in checkers.sorts(types(spark)).collect()}
    assert got == {1: "s64", 2: "bool", 3: "ptr", 4: "seq", 5: "array:4", 6: "s8", 7: "s64", 8: "ptr:4", 9: None, 10: "u8"}


@pytest.fixture(scope="module")
def found(spark):
    p, kinds = Program(), {}

    def func(name, ty, **kw):
        kinds.update({(name, v): t for v, t in ty.items()})
        p.func(name, **kw)
        for b in kw["blocks"]:
            for _, r, _, _ in b:
                if r:
                    p.t["value"].append({"func": name, "vid": r, "kind": "Instr"})

    zero, nine, ret = (90, "Const", 0), (91, "Const", 9), I("Return")
    func("DerefParam", {1: PTR, 2: INT}, params=[1], blocks=[[I("UnOp", 2, 1, token="*"), ret]])
    func("PassNil", {5: PTR}, aux=[(5, "Const", 0)], blocks=[[static("DerefParam", "Call", 0, 5), ret]])
    func("PassOn", {1: PTR}, params=[1], blocks=[[static("DerefParam", "Call", 0, 1), ret]])
    func("PassNilDeep", {5: PTR}, aux=[(5, "Const", 0)], blocks=[[static("PassOn", "Call", 0, 5), ret]])
    func("PassAlloc", {1: PTR}, blocks=[[I("Alloc", 1), static("DerefParam", "Call", 0, 1), ret]])
    func("Guarded", {1: PTR, 5: PTR, 2: BOOL, 3: INT}, params=[1], aux=[(5, "Const", 0)], blocks=[[I("BinOp", 2, 1, 5, token="!="), I("If", 0, 2)], [I("UnOp", 3, 1, token="*"), ret], [ret]], edges=[(0, 1), (0, 2)])
    func("WrongGuard", {1: PTR, 5: PTR, 2: BOOL, 3: INT}, params=[1], aux=[(5, "Const", 0)], blocks=[[I("BinOp", 2, 1, 5, token="=="), I("If", 0, 2)], [I("UnOp", 3, 1, token="*"), ret], [ret]], edges=[(0, 1), (0, 2)])
    func("CallWrong", {1: PTR}, blocks=[[I("Alloc", 1), static("WrongGuard", "Call", 0, 1), ret]])
    func("IndexOut", {91: INT, 1: ARR, 2: INT}, params=[1], aux=[nine], blocks=[[I("Index", 2, 1, 91), ret]])
    func("DivZero", {90: INT, 1: INT, 2: INT}, params=[1], aux=[zero], blocks=[[I("BinOp", 2, 1, 90, token="/"), ret]])
    func("DivNine", {91: INT, 1: INT, 2: INT}, params=[1], aux=[nine], blocks=[[I("BinOp", 2, 1, 91, token="/"), ret]])
    func("MadeSlice", {91: INT, 92: INT, 1: SEQ, 2: PTR, 3: PTR}, aux=[nine, (92, "Const", 8)], blocks=[[I("MakeSlice", 1, 91, 91), I("IndexAddr", 2, 1, 92), I("IndexAddr", 3, 1, 91), ret]])
    func("Unknown", {1: INT, 2: INT, 3: ARR, 4: INT}, params=[3], blocks=[[static("elsewhere", "Call", 1), I("Index", 4, 3, 1), ret]])
    func("Narrow", {93: INT, 2: I8}, aux=[(93, "Const", 200)], blocks=[[I("Convert", 2, 93), ret]])
    func("Fits", {93: INT, 2: I8}, aux=[(93, "Const", 100)], blocks=[[I("Convert", 2, 93), ret]])
    func("Dead", {94: BOOL, 90: INT, 91: INT, 2: INT}, aux=[(94, "Const", False), zero, nine], blocks=[[I("If", 0, 94)], [I("BinOp", 2, 91, 90, token="%"), ret], [ret]], edges=[(0, 1), (0, 2)])
    for r in p.t["value"]:
        r["type_id"] = kinds.get((r["func"], r["vid"]))
        if r["type_id"] == PTR and r["kind"] == "Const":
            r |= {"const_kind": "Nil", "const_int": None}
    f = p.facts(spark)
    sort = checkers.sorts(types(spark)).drop("import_path")
    f["value"] = f["value"].join(sort, "type_id", "left")
    rows = checkers.findings(bodies.bodies(f)).collect()
    return {(r.func, r.tag): r for r in rows}


def test_findings(found):
    want = {("DerefParam", "nil-deref"), ("PassNil", "nil-deref"), ("PassNilDeep", "nil-deref"), ("IndexOut", "bounds"), ("DivZero", "div-zero"), ("MadeSlice", "bounds"), ("Narrow", "overflow")}
    # a function's own precondition keeps it from being reported for what its callers must see to
    assert set(found) == want - {("DerefParam", "nil-deref")}


def test_messages(found):
    assert found["PassNil", "nil-deref"].message == "call to DerefParam violates its nil-deref requirement"
    assert found["DivZero", "div-zero"].message == "division by zero in DivZero" and found["MadeSlice", "bounds"].line == 2


def test_functions_alike_are_asked_about_once(spark, monkeypatch):
    """Functions that differ in names and positions only: one is encoded, and each gets its own names and positions; one with other numbers, or a name that means something, is another."""
    asked = []
    monkeypatch.setattr(bodies, "_answers", {})
    kind = StructType.fromDDL("instr array<struct<op: string, callee: string, file: string, line: int, col: int>>")

    def ask(func, x):
        asked.append(func)
        i = x["instr"][0]
        yield func, f"call to {i['callee']} in {func}", i["file"], i["line"], i["col"]

    text = lambda callee, line, col="3": '{"instr":[{"op":"Call","callee":"%s","file":"a\\"b.go","line":%d,"col":%s}]}' % (callee, line, col)
    got = [bodies.answers(("q",), f, [t], [kind], ask, 2)[0] for f, t in (("m/é1", text("m/g1", 7)), ("m/é2", text("m/g2", 9)), ("m/g3", text("m/g3", 9)), ("m/f", text("flag.NewFlagSet", 1)), ("m/f", text("close", 1)))]
    assert got[:2] == [("m/é1", "call to m/g1 in m/é1", 'a"b.go', 7, 3), ("m/é2", "call to m/g2 in m/é2", 'a"b.go', 9, 3)]
    assert got[2][1] == "call to m/g3 in m/g3" and got[3][1:] == ("call to flag.NewFlagSet in m/f", 'a"b.go', 1, 3) and got[4][1] == "call to close in m/f"
    assert len(asked) == 4
    assert bodies.answers(None, "m/f", [text("m/g1", 7)], [kind], ask, 2) == [("m/f", "call to m/g1 in m/f", 'a"b.go', 7, 3)] and asked[-1] == "m/f"

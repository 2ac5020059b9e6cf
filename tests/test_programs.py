"""Whole programs, transcribed by hand as decoded instructions: lowering, text dumps, effects and leaks."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import bodies, effects, graph, lowering
from quarry.schema import rows as make
from quarry.sources import facts

from .conftest import rows


class Program:
    """Builds fact rows function by function; values are numbered by hand."""

    def __init__(self):
        self.t = {n: [] for n in ("func", "param", "freevar", "value", "block", "cfg_edge", "wire", "select_arm")}

    def func(self, name, params=(), free=(), aux=(), blocks=(), edges=()):
        self.t["func"].append({"func": name, "has_body": bool(blocks), "import_path": "p"})
        for k, vs in (("param", params), ("freevar", free)):
            for i, v in enumerate(vs):
                self.t[k].append({"func": name, "idx": i, "vid": v})
                self.t["value"].append({"func": name, "vid": v, "kind": {"param": "Param", "freevar": "FreeVar"}[k]})
        for vid, kind, x in aux:
            self.t["value"].append({"func": name, "vid": vid, "kind": kind, **({"const_kind": type(x).__name__.capitalize(), "const_int" if type(x) is int else "const_bool": x} if kind == "Const" else {"ref_name": x})})
        for b, instrs in enumerate(blocks):
            self.t["block"].append({"func": name, "b": b})
            for i, (kind, register, operands, more) in enumerate(instrs):
                arms = more.pop("arms", None) if more else None
                self.t["wire"].append({"func": name, "b": b, "i": i, "kind": kind, "register": register, "operands": list(operands), "file": "f.go", "line": 10 * b + i, "col": 1, **(more or {})})
                for a, (d, ch, send) in enumerate(arms or ()):
                    self.t["select_arm"].append({"func": name, "b": b, "i": i, "arm": a, "dir": d, "chan": ch, "send": send})
        pos = {}
        for s, d in edges:
            pos[s] = pos.get(s, -1) + 1
            self.t["cfg_edge"].append({"func": name, "src": s, "dst": d, "succ_pos": pos[s]})
        return self

    def facts(self, spark):
        out = {n: make(spark, n, r) for n, r in self.t.items()}
        return out | {"instr": lowering.lowered(out["wire"], out["value"])}


def I(kind, register=0, *operands, **more):  # noqa: E743, N802
    return kind, register, operands, more


def static(name, kind="Call", register=0, *args, **more):
    return I(kind, register, 0, *args, callee_kind="Static", callee=name, **more)


def builtin(name, kind="Call", *args):
    return I(kind, 0, 0, *args, callee_kind="Builtin", callee=name)


RET = I("Return")


def conc():
    p, top = Program(), "example.com/conc."
    p.func("(*F).Close", [1], blocks=[[I("FieldAddr", 2, 1, field=0), static("(*sync.Mutex).Lock", "Call", 0, 2), I("FieldAddr", 3, 1, field=0), static("(*sync.Mutex).Unlock", "Defer", 0, 3), RET]])
    p.func("(*T).Rename")
    p.func("CloseAll", [1], blocks=[[I("Call", 2, 1, callee_kind="Invoke", method="Close", iface=5, sig=6), RET]])
    p.func("DeferClose", [1], blocks=[[builtin("close", "Defer", 1), RET]])
    p.func("GoClose", [1], blocks=[[builtin("close", "Go", 1), RET]])
    p.func("Fan", [1, 2], aux=[(7, "Function", "Fan$1"), (8, "Const", 1)], blocks=[[
        I("Alloc", 3, heap=True), I("MakeChan", 4, 8), I("Store", 0, 3, 4), I("MakeClosure", 5, 7, 3), static("Fan$1", "Go"), I("UnOp", 6, 3, token="*"),
        I("Select", 9, blocking=True, arms=[("recv", 1, None), ("send", 2, 8), ("recv", 6, None)]), RET]])
    p.func("Fan$1", free=[1], blocks=[[I("UnOp", 2, 1, token="*"), builtin("close", "Call", 2), RET]])
    p.func("RenameAll", [1], blocks=[[I("Call", 2, 1, callee_kind="Invoke", method="Rename", iface=5, sig=6), RET]])
    return p, top


def test_summaries(spark):
    p, _ = conc()
    f = p.facts(spark)
    edges = spark.createDataFrame([("CloseAll", "(*F).Close"), ("RenameAll", "(*T).Rename"), ("Fan", "Fan$1")], "caller string, callee string")
    s = bodies.summaries(bodies.bodies(f), f["func"], edges)
    line = lambda name, spawns="None", chan="", locks="": f"{name} effects={{spawns:{spawns} chan:{{{chan}}} locks:{{{locks}}}}}"
    anything = ("Unbounded", f"?:[{','.join(effects.CHAN_OPS)}]", f"?:[{','.join(effects.LOCK_OPS)}]")
    want = {"(*F).Close": ("None", "", "p0.f0:[Lock,DeferredUnlock]"), "(*T).Rename": anything, "CloseAll": ("None", "", "?:[Lock,DeferredUnlock]"), "RenameAll": anything}
    want |= {"DeferClose": ("None", "p0:[Close]"), "GoClose": ("Bounded", "p0:[Close]"), "Fan$1": ("None", "fv:0:[Close]")}
    want |= {"Fan": ("Bounded", " ".join(["p0:[Select]", "p1:[Select]", "alloc:3:[Close,Select]", "alloc:4:[Make]"]))}
    got = {r.func: r.line for r in effects.text(s).collect()}
    want |= {n: anything for n in got if n.startswith("(*sync")}
    assert got == {n: line(n, *x) for n, x in want.items()}


def test_lowering(spark):
    p = Program().func("Spawn", [1], aux=[(4, "Function", "Spawn$1")], blocks=[[I("Alloc", 2, heap=True), I("Store", 0, 2, 1), I("MakeClosure", 3, 4, 2), static("Spawn$1", "Go"), I("DebugRef"), RET]])
    p.func("Spawn$1", free=[1], aux=[(3, "Const", 1)], blocks=[[I("UnOp", 2, 1, token="*"), I("Send", 0, 2, 3), RET]])
    p.func("init", aux=[(2, "Global", "guard"), (3, "Const", True)], blocks=[[I("UnOp", 1, 2, token="*"), I("If", 0, 1)], [I("Store", 0, 2, 3), I("Jump")], [RET]], edges=[(0, 2), (0, 1), (1, 2)])
    p.func("odd", [1, 2], blocks=[[I("BinOp", 3, 1, 2, token="+"), I("BinOp", 0, 1, 2, token="+"), I("BinOp", 4, 1, 2, token="?"), I("Weird", 5), I("Range", 6, 1), I("Slice", 7, 1, 0, 2), I("MapUpdate", 0, 1, 2, 3), I("Call", 8, 1, 2), static("(*sync.RWMutex).RLock", "Call", 0, 1), builtin("close", "Call", 1), I("Phi", 9, 1, 2)]])
    p.func("ext")
    f = p.facts(spark)
    got = {r.func: r.text for r in lowering.dumped(*[f[n] for n in ("func", "param", "value", "cfg_edge", "block", "instr", "select_arm")]).collect()}
    assert got["Spawn"] == "func Spawn (v1)\n  aux v4 = func Spawn$1\n  b0 -> []\n    v2 = alloc heap=true\n    store v2 <- v1\n    v3 = make-closure Spawn$1 [v2]\n    go call Spawn$1()\n    return \n"
    assert got["Spawn$1"] == "func Spawn$1 ()\n  aux v3 = const Int(1)\n  b0 -> []\n    v2 = load v1\n    send v2 <- v3\n    return \n"
    assert got["init"] == "func init ()\n  aux v2 = global guard\n  aux v3 = const Bool(true)\n  b0 -> [2, 1]\n    v1 = load v2\n    branch v1\n  b1 -> [2]\n    store v2 <- v3\n    jump\n  b2 -> []\n    return \n"
    assert got["odd"].split("b0 -> []\n")[1].split("\n    ") == ["    v3 = binop Add v1 v2", "havoc", "v4 = havoc", "v5 = havoc", "v6 = havoc", "v7 = slice v1 [:v2:]", "store v1 <- v3", "v8 = havoc", "rlock v1", "close v1", "v9 = phi v1 v2\n"]
    assert got["ext"] == "func ext <external>\n"
    assert rows(lowering.diagnostics(f["wire"], f["instr"]), "kind") == [("BinOp",), ("BinOp",), ("Call",), ("Weird",)]


ZERO, ONE = (90, "Const", 0), (91, "Const", 1)


def spawner(p, name, body, after=(), cap=90, loop=False, closure_blocks=None):
    """name makes a channel in a cell, spawns name$1 over it, then does `after`."""
    p.func(name, aux=[ZERO, ONE, (92, "Function", f"{name}$1")], blocks=[[I("Alloc", 1, heap=True), I("MakeChan", 2, cap), I("Store", 0, 1, 2), I("MakeClosure", 3, 92, 1), static(f"{name}$1", "Go"), *after, RET]])
    p.func(f"{name}$1", free=[1], aux=[ONE], blocks=closure_blocks or [[I("UnOp", 2, 1, token="*"), *body, RET]], edges=[(0, 0)] if loop else [])


SEND, RECV = I("Send", 0, 2, 91), I("UnOp", 5, 2, token="<-")
LOAD = I("UnOp", 7, 1, token="*")


@pytest.fixture(scope="module")
def leaky(spark):
    p = Program()
    spawner(p, "LeakSend", [SEND])
    spawner(p, "LeakRecv", [RECV])
    spawner(p, "LeakLoop", [SEND], loop=True)
    spawner(p, "LeakBuffered", [SEND, SEND], cap=91)
    spawner(p, "Paired", [SEND], [LOAD, I("UnOp", 8, 7, token="<-")])
    spawner(p, "Closed", [RECV], [LOAD, builtin("close", "Call", 7)])
    spawner(p, "EscapeReturn", [SEND], [LOAD, I("Return", 0, 7)])
    spawner(p, "EscapeCall", [SEND], [LOAD, static("elsewhere", "Call", 0, 7)])
    spawner(p, "LoopBuffered", [SEND], cap=91, loop=True)
    spawner(p, "SelectDefault", [I("Select", 6, blocking=False, arms=[("send", 2, 91)])])
    spawner(p, "LeakSelect", [I("Select", 6, blocking=True, arms=[("send", 2, 91)])])
    spawner(p, "LeakHelper", [static("helper", "Call", 0, 2)])
    spawner(p, "LeakDeferHelper", [static("helper", "Defer", 0, 2)])
    spawner(p, "HelperPaired", [static("helper", "Call", 0, 2)], [LOAD, I("UnOp", 8, 7, token="<-")])
    spawner(p, "HelperBuffered", [static("helper", "Call", 0, 2)], cap=91)
    spawner(p, "HelperTwice", [static("helper2", "Call", 0, 2)])
    p.func("helper", [1], aux=[ONE], blocks=[[I("Send", 0, 1, 91), RET]])
    p.func("helper2", [1], blocks=[[static("helper", "Call", 0, 1), RET]])
    p.func("Param", [1], blocks=[[static("sender", "Go", 0, 1), RET]])
    p.func("sender", [1], aux=[ONE], blocks=[[I("Send", 0, 1, 91), RET]])
    p.func("LeakParam", aux=[ZERO], blocks=[[I("MakeChan", 1, 90), static("sender", "Go", 0, 1), RET]])
    p.func("Global", aux=[(5, "Global", "ch")], blocks=[[I("UnOp", 1, 5, token="*"), static("sender", "Go", 0, 1), RET]])
    p.func("elsewhere", [1], blocks=[[RET]])
    f = p.facts(spark)
    df = bodies.bodies(f)
    edges = f["instr"].where("callee_kind = 'Static'").select(F.col("func").alias("caller"), "callee").distinct()
    return df, bodies.summaries(df, f["func"], edges)


def test_leaks(leaky):
    df, summary = leaky
    got = bodies.leaks(df, summary)
    assert {r.spawner for r in got.collect()} == {"LeakSend", "LeakRecv", "LeakLoop", "LeakBuffered", "LeakSelect", "LeakHelper", "LeakDeferHelper", "LeakParam"}
    text = {r.spawner: r.m for r in got.withColumn("m", bodies.leak_message()).collect()}
    assert text["LeakHelper"] == "goroutine LeakHelper$1 may block forever: send in helper helper on a spawner-created " + "channel with no receive, close, or select in the spawning environment"
    assert text["LeakSelect"] == "goroutine LeakSelect$1 may block forever: blocking select whose channels have no counterpart operations"
    assert {(r.capacity, r.cap) for r in got.where("spawner = 'LeakBuffered'").collect()} == {("Buffered", 1)}


def test_call_graph_of_addresses(spark):
    p, _ = conc()
    f = p.facts(spark)
    keys = spark.createDataFrame([("Fan$1", "f()")], "func string, skey string")
    taken = graph.address_taken(f["instr"], f["value"], keys)
    assert rows(taken) == [("Fan$1", "f()")]
    assert rows(graph.dynamic_targets(spark.createDataFrame([("m", "f()")], "caller string, skey string"), taken)) == [("Fan$1", "m")]


# artifacts


def field(n, v):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(v, int):
        return varint(n << 3) + varint(v)
    v = v.encode() if isinstance(v, str) else v
    return varint(n << 3 | 2) + varint(len(v)) + v


def test_artifacts(spark, tmp_path):
    pos = field(1, 1) + field(2, 5) + field(3, 2)
    instr = field(1, "BinOp") + field(2, 3) + field(4, b"\x01\x02") + field(5, pos) + field(7, field(1, "+"))
    aux = field(1, 2) + field(2, "Const") + field(5, field(2, 2**64 - 5))
    func = field(1, "p.F") + field(4, field(1, 1) + field(2, "x")) + field(5, aux) + field(6, field(2, instr)) + field(8, "err")
    pkg = field(1, "4") + field(4, "p") + field(5, field(1, "a.go")) + field(6, field(1, 1) + field(3, 1) + field(12, "int")) + field(7, func) + field(9, field(1, "p.F") + field(2, "//x")) + field(99, 1)
    for name, b in (("a.bin", pkg), ("b.bin", pkg[:-9]), ("c.bin", field(1, "3")), ("d.bin", b"\xff" * 20), ("e.txt", pkg)):
        (tmp_path / name).write_bytes(b)
    a = facts.Artifacts(spark, f"file://{tmp_path}", "*.bin")
    w = a.table("wire").collect()
    assert [(r.func, r.kind, r.register, r.operands, r.token, r.file, r.line) for r in w] == [("p.F", "BinOp", 3, [1, 2], "+", "a.go", 5)]
    assert a.table("value").where("kind = 'Const'").first().const_int == -5 and a.table("func").first().result_names == ["err"]
    assert a.table("type").first().kind == "Basic" and a.table("pragma").count() == 1
    assert sorted(r.path[-5:] for r in a.diagnostics().collect()) == ["b.bin", "c.bin", "d.bin"]


@pytest.mark.parametrize("b", [b"", b"\x00", b"\x0a\xff", b"\x3a" * 50, bytes(range(256))])
def test_decoder_is_total(b):
    try:
        facts.decode(b)
    except facts.BadArtifact:
        pass


def test_manifest_and_names(spark, tmp_path):
    (tmp_path / "m").write_text("pkg a\ndep b\nfile x.go\npkg b\n")
    p, d, f = facts.manifest(spark, f"file://{tmp_path}/m")
    assert rows(p) == [("a",), ("b",)] and rows(d) == [("b", "a")] and rows(f) == [("x.go", "a")]
    (tmp_path / "n").write_text("pkg a\nwhat\n")
    with pytest.raises(ValueError):
        facts.manifest(spark, f"file://{tmp_path}/n")
    funcs = spark.createDataFrame([("f", "a", False), ("f", "b", True), ("f", "c", False), ("g[int]", "a", True), ("g[string]", "a", True)], "func string, import_path string, has_body boolean")
    assert [r.import_path for r in facts.chosen(funcs).where("func = 'f'").collect()] == ["b"]
    on, off = facts.attached(make(spark, "pragma", [{"decl_id": x} for x in ("f", "g", "h")]), funcs)
    assert rows(on, "func") == [("f",), ("g[int]",), ("g[string]",)] and rows(off, "decl_id") == [("h",)]

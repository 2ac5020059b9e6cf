"""A program of many small functions, one group of them for each part: what the checkers, effects and leaks are asked about.

Which group a part gives goes by its key, the numbers in it by its size, so the program grows with the table and it can be said in SQL
what must be found. A group is a template of decoded instructions; a fact table is the parts joined with the templates' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bodies, lowering
from ..schema import schema
from ..storage import saved
from . import adapters as a


#: Parts of which a task makes the functions.
PARTS = 20_000


class Sql(str):
    """An expression over k (the part's key) and size."""


def named(role: str) -> Sql:
    return Sql(f"concat('shop/{role}', cast(k as string))")


class Group:
    """Rows of the fact tables of one group; values are numbered by hand. Each value has its sort."""

    def __init__(self) -> None:
        self.t: dict[str, list[dict]] = {n: [] for n in ("func", "param", "freevar", "value", "block", "cfg_edge", "wire", "select_arm")}

    def func(self, role: str, params=(), free=(), aux=(), regs=(), blocks=(), edges=()) -> Group:
        name = named(role)
        self.t["func"].append({"func": name, "import_path": "shop", "name": role, "has_body": bool(blocks)})
        for kind, what, vs in (("param", "Param", params), ("freevar", "FreeVar", free)):
            for i, (v, sort) in enumerate(vs):
                self.t[kind].append({"func": name, "idx": i, "vid": v})
                self.t["value"].append({"func": name, "vid": v, "kind": what, "sort": sort})
        for v, kind, x, sort in aux:
            row = {"func": name, "vid": v, "kind": kind, "sort": sort}
            if kind == "Const":
                row |= {"const_kind": "Nil"} if x is None else {"const_kind": "Bool", "const_bool": x} if isinstance(x, bool) else {"const_kind": "Int", "const_int": x}
            else:
                row["ref_name"] = x
            self.t["value"].append(row)
        for v, sort in dict(regs).items():
            self.t["value"].append({"func": name, "vid": v, "kind": "Instr", "sort": sort})
        for b, instrs in enumerate(blocks):
            self.t["block"].append({"func": name, "b": b})
            for i, (kind, register, operands, more) in enumerate(instrs):
                arms = more.pop("arms", ())
                self.t["wire"].append({"func": name, "b": b, "i": i, "kind": kind, "register": register, "operands": list(operands), "file": "shop.go", "line": 10 * b + i, **more})
                for x, (d, ch, send) in enumerate(arms):
                    self.t["select_arm"].append({"func": name, "b": b, "i": i, "arm": x, "dir": d, "chan": ch, "send": send})
        place: dict[int, int] = {}
        for s, d in edges:
            place[s] = place.get(s, -1) + 1
            self.t["cfg_edge"].append({"func": name, "src": s, "dst": d, "succ_pos": place[s]})
        return self


def ins(kind: str, register: int = 0, *operands: int, **more) -> tuple:
    return kind, register, operands, more


def call(role: str, register: int = 0, *args: int, kind: str = "Call") -> tuple:
    return ins(kind, register, 0, *args, callee_kind="Static", callee=named(role))


def builtin(name: str, *args: int, kind: str = "Call") -> tuple:
    return ins(kind, 0, 0, *args, callee_kind="Builtin", callee=name)


def load(register: int, address: int) -> tuple:
    return ins("UnOp", register, address, token="*")


SIZE, RET = Sql("size"), ins("Return")
NOTHING = (90, "Const", None, "ptr")


def groups() -> list[Group]:
    out = [Group() for _ in range(10)]
    g = out[0]  # an index, a division and a conversion by numbers that the size gives
    g.func("Index", [(1, "array:16")], aux=[(91, "Const", SIZE, "s64")], regs={2: "s64"}, blocks=[[ins("Index", 2, 1, 91), RET]])
    g.func("Divide", [(1, "s8")], aux=[(91, "Const", Sql("size % 5"), "s8")], regs={2: "s8"}, blocks=[[ins("BinOp", 2, 1, 91, token="/"), RET]])
    g.func("Narrow", aux=[(91, "Const", Sql("size * 7"), "s64")], regs={2: "s8"}, blocks=[[ins("Convert", 2, 91), RET]])
    g = out[1]  # a pointer that the callee goes through, by way of one in between
    g.func("Deref", [(1, "ptr")], regs={2: "s64"}, blocks=[[load(2, 1), RET]])
    g.func("PassOn", [(1, "ptr")], blocks=[[call("Deref", 0, 1), RET]])
    g.func("PassNil", aux=[NOTHING], blocks=[[call("PassOn", 0, 90), RET]])
    g.func("PassNew", regs={1: "ptr"}, blocks=[[ins("Alloc", 1, heap=True), call("PassOn", 0, 1), RET]])
    g.func("GoNil", aux=[NOTHING], blocks=[[call("Deref", 0, 90, kind="Go"), RET]])
    g = out[2]  # guards, the right way round and the wrong one
    for role, token in (("Guarded", "!="), ("Inverted", "==")):
        g.func(role, [(1, "ptr")], aux=[NOTHING], regs={2: "bool", 3: "s64"}, blocks=[[ins("BinOp", 2, 1, 90, token=token), ins("If", 0, 2)], [load(3, 1), RET], [RET]], edges=[(0, 1), (0, 2)])
        g.func(f"Use{role}", aux=[NOTHING], blocks=[[call(role, 0, 90), RET]])
    g = out[3]  # a slice that is made, sliced and indexed
    g.func("Made", aux=[(91, "Const", Sql("size % 7"), "s64"), (92, "Const", Sql("size % 9"), "s64")], regs={1: "seq", 2: "ptr"}, blocks=[[ins("MakeSlice", 1, 91, 91), ins("IndexAddr", 2, 1, 92), RET]])
    g.func("Sliced", aux=[(91, "Const", Sql("size % 7"), "s64"), (92, "Const", Sql("size % 9"), "s64"), (93, "Const", 8, "s64")], regs={1: "seq", 2: "seq"}, blocks=[[ins("MakeSlice", 1, 93, 93), ins("Slice", 2, 1, 91, 92, 0), RET]])
    g = out[4]  # a divisor that the caller gives; in a dead branch it does no harm
    g.func("By", [(1, "s8"), (2, "s8")], regs={3: "s8"}, blocks=[[ins("BinOp", 3, 1, 2, token="%"), RET]])
    g.func("CallBy", aux=[(91, "Const", Sql("size % 4"), "s8"), (92, "Const", 9, "s8")], blocks=[[call("By", 0, 92, 91), RET]])
    g.func("Dead", aux=[(91, "Const", 0, "s8"), (92, "Const", 9, "s8"), (93, "Const", False, "bool")], blocks=[[ins("If", 0, 93)], [call("By", 0, 92, 91), RET], [RET]], edges=[(0, 1), (0, 2)])
    g = out[5]  # what results promise
    g.func("New", regs={1: "ptr"}, blocks=[[ins("Alloc", 1, heap=True), ins("Return", 0, 1)]])
    g.func("UseNew", regs={1: "ptr", 2: "s64"}, blocks=[[call("New", 1), load(2, 1), RET]])
    g.func("Find", [(1, "bool"), (6, "ptr")], aux=[NOTHING, (94, "Const", None, "ptrerror")], regs={2: "ptr", 3: "ptrerror"}, blocks=[[ins("If", 0, 1)], [ins("Alloc", 2, heap=True), ins("Return", 0, 2, 94)], [ins("MakeInterface", 3, 6), ins("Return", 0, 90, 3)]], edges=[(0, 1), (0, 2)])
    tuple_ = {2: None, 3: "ptr", 4: "ptrerror", 5: "s64", 6: "bool"}
    taken = [call("Find", 2, 1, 7), ins("Extract", 3, 2, idx=0), ins("Extract", 4, 2, idx=1)]
    g.func("Hasty", [(1, "bool"), (7, "ptr")], regs=tuple_, blocks=[[*taken, load(5, 3), RET]])
    g.func("Careful", [(1, "bool"), (7, "ptr")], aux=[(94, "Const", None, "ptrerror")], regs=tuple_, blocks=[[*[(k, r, o, dict(m)) for k, r, o, m in taken], ins("BinOp", 6, 4, 94, token="=="), ins("If", 0, 6)], [load(5, 3), RET], [RET]], edges=[(0, 1), (0, 2)])
    g.func("Any", [(1, "ptr")], blocks=[[ins("Return", 0, 1)]])
    g.func("UseAny", [(1, "ptr")], regs={2: "ptr", 3: "s64"}, blocks=[[call("Any", 2, 1), load(3, 2), RET]])
    g = out[6]  # what annotations demand and promise
    g.func("Limited", [(1, "s64")], blocks=[[RET]])
    g.func("CallLimited", aux=[(91, "Const", Sql("(size + k) % 50"), "s64")], blocks=[[call("Limited", 0, 91), RET]])
    g.func("Positive", aux=[(91, "Const", Sql("size - 25"), "s64")], blocks=[[ins("Return", 0, 91)]])
    g.func("UsePositive", [(2, "array:64")], regs={1: "s64", 3: "s64"}, blocks=[[call("Positive", 1), ins("Index", 3, 2, 1), RET]])
    g = out[7]  # a goroutine that sends, as often as its channel has room or more often
    send = lambda n: [ins("Send", 0, 1, 2) for _ in range(n)]
    worker = {"params": [(1, None)], "aux": [(2, "Const", 1, "s64")]}
    g.func("Sender", blocks=[[*send(2), RET]], **worker)
    g.func("Spawn", aux=[(91, "Const", Sql("size % 4"), "s64")], regs={1: None}, blocks=[[ins("MakeChan", 1, 91), call("Sender", 0, 1, kind="Go"), RET]])
    g.func("Drain", aux=[(91, "Const", Sql("size % 4"), "s64")], regs={1: None, 2: "s64"}, blocks=[[ins("MakeChan", 1, 91), call("Sender", 0, 1, kind="Go"), ins("UnOp", 2, 1, token="<-"), RET]])
    g.func("Give", [(3, None)], aux=[(91, "Const", Sql("size % 4"), "s64")], regs={1: None}, blocks=[[ins("MakeChan", 1, 91), call("Sender", 0, 1, kind="Go"), ins("Send", 0, 3, 1), RET]])
    g = out[8]  # one that waits, only where a flag that its spawner gives is set; and a select
    g.func("Waiter", [(1, None), (2, "bool")], regs={3: "s64"}, blocks=[[ins("If", 0, 2)], [ins("UnOp", 3, 1, token="<-"), RET], [RET]], edges=[(0, 1), (0, 2)])
    for role, flag in (("WaitOn", True), ("WaitOff", False)):
        g.func(role, aux=[(91, "Const", 0, "s64"), (92, "Const", flag, "bool")], regs={1: None}, blocks=[[ins("MakeChan", 1, 91), call("Waiter", 0, 1, 92, kind="Go"), RET]])
    g.func("Chooser", [(1, None), (2, None)], aux=[(3, "Const", 1, "s64")], blocks=[[ins("Select", 4, blocking=True, arms=[("recv", 1, None), ("send", 2, 3)]), RET]], regs={4: None})
    g.func("Choose", aux=[(91, "Const", Sql("size % 2"), "s64"), (92, "Const", 0, "s64")], regs={1: None, 2: None}, blocks=[[ins("MakeChan", 1, 91), ins("MakeChan", 2, 92), call("Chooser", 0, 1, 2, kind="Go"), RET]])
    g = out[9]  # places: fields, cells, captured variables, locks, and spawns in a loop
    g.func("Lock", [(1, None)], regs={2: None, 3: None}, blocks=[[ins("FieldAddr", 2, 1, field=Sql("cast(size % 3 as int)")), ins("Call", 0, 0, 2, callee_kind="Static", callee="(*sync.Mutex).Lock"), ins("FieldAddr", 3, 1, field=Sql("cast(size % 3 as int)")), ins("Defer", 0, 0, 3, callee_kind="Static", callee="(*sync.Mutex).Unlock"), RET]])
    g.func("UseLock", aux=[(5, "Global", "shop.mu", "ptr")], blocks=[[call("Lock", 0, 5), RET]])
    g.func("Closure", free=[(1, "ptr")], regs={2: None}, blocks=[[load(2, 1), builtin("close", 2), RET]])
    g.func("Capture", aux=[(7, "Function", named("Closure"), None), (8, "Const", 1, "s64")], regs={3: "ptr", 4: None, 5: None}, blocks=[[ins("Alloc", 3, heap=True), ins("MakeChan", 4, 8), ins("Store", 0, 3, 4), ins("MakeClosure", 5, 7, 3), call("Closure", kind="Go"), RET]])
    g.func("Loop", [(1, None)], blocks=[[ins("Jump")], [builtin("close", 1, kind="Go"), ins("Jump")]], edges=[(0, 1), (1, 1)])
    return out


def _template(name: str, all_: list[Group], only: tuple[int, ...]) -> tuple[list[tuple], str, list[str]]:
    """(rows, their schema, numbers that go by the part): names without the part's key, the one number of a row that isn't fixed as `code`."""
    fields = [(f.name, f.dataType.simpleString()) for f in schema(name).fields] + ([("sort", "string")] if name == "value" else [])
    rows, codes = [], {"0"}
    for g in only:
        for r in all_[g].t[name]:
            row, code = [g], None
            for c, kind in fields:
                x = r.get(c)
                if isinstance(x, Sql) and kind == "string":
                    x = x.split("'")[1]
                elif isinstance(x, Sql):
                    x, code = None, f"{c}={x}"
                    codes.add(code)
                row.append(x)
            rows.append((*row, code))
    return rows, "g int, " + ", ".join(f"{c} {k}" for c, k in fields) + ", code string", sorted(codes - {"0"})


def spread(part: DataFrame, key: str) -> DataFrame:
    """Parts over tasks: a row becomes dozens, and the few tasks that read so small a table would make them all."""
    tasks = 1 + part.count() // PARTS
    return part.repartition(tasks, key) if tasks > 1 else part


def facts(spark: SparkSession, d: str, only: tuple[int, ...] = tuple(range(10))) -> dict[str, DataFrame]:
    """The fact tables of the program, or of some of its groups: each is the parts with the template's rows, some hundred at most."""
    all_ = groups()
    part = spread(a.t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), (F.col("p_partkey") % len(all_)).cast("int").alias("g")), "k").where(F.col("g").isin(*only))
    out = {}
    for name in all_[0].t:
        rows, ddl, codes = _template(name, all_, only)
        both = part.join(F.broadcast(spark.createDataFrame(rows, ddl)), "g")
        cols = []
        for c in [x.split()[0] for x in ddl.split(", ")[1:-1]]:
            col = F.col(c)
            if c in ("func", "callee", "ref_name"):
                col = F.when(col.startswith("shop/"), F.concat(col, F.col("k").cast("string"))).otherwise(col)
            for code in codes:
                if code.startswith(f"{c}="):
                    col = F.when(F.col("code") == code, F.expr(f"cast({code[len(c) + 1 :]} as {dict(both.dtypes)[c]})")).otherwise(col)
            cols.append(col.alias(c))
        if name == "wire":
            cols = [(F.col("k") % 80).cast("int").alias("col") if x == "col" else c for x, c in zip([x.split()[0] for x in ddl.split(", ")[1:-1]], cols)]
        out[name] = both.select(*cols)
    return out | {"instr": lowering.lowered(out["wire"], out["value"])}


def bodied(spark: SparkSession, d: str, only: tuple[int, ...] = tuple(range(10))) -> DataFrame:
    return saved(bodies.bodies(facts(spark, d, only)), "program")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """func, pragma, params, results (name and sort each) of the annotated functions."""
    part = a.t(spark, d, "part").where("p_partkey % 10 = 6")
    rows = "array(named_struct('func', concat('shop/Limited', k), 'pragma', concat('requires x < ', size), 'params', array(named_struct('name', 'x', 'sort', 's64')), 'results', cast(array() as array<struct<name: string, sort: string>>)), named_struct('func', concat('shop/Positive', k), 'pragma', 'ensures ret >= 0', 'params', cast(array() as array<struct<name: string, sort: string>>), 'results', array(named_struct('name', '', 'sort', 's64'))), named_struct('func', concat('shop/Positive', k), 'pragma', if(size % 2 = 0, 'ensures y > 0', 'ignore bounds'), 'params', cast(array() as array<struct<name: string, sort: string>>), 'results', array(named_struct('name', '', 'sort', 's64'))))"
    return part.selectExpr("p_partkey as k", "p_size as size").select(F.explode(F.expr(rows)).alias("r")).select("r.*")

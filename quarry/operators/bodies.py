"""Function bodies as one nested row each, and what has to walk a body's instructions.

`bodies` brings everything of a function together in a single aggregation per fact table; what follows runs on Arrow batches of whole
functions, all independent of one another. Leaks need a spawner together with what it spawns and what that calls: these
are joined to it, two levels at most.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType

from ..storage import saved
from . import effects
from .cfg import Graph
from .lowering import LOCKS

HOPS, BRIDGES, CANONICAL = 32, 64, 64
UNKNOWN = ("Unknown", "", ())
OWN = "func string, domain string, root_kind string, root_id string, path array<int>, op string"
SITES = "caller string, callee string, args array<struct<root_kind: string, root_id: string, path: array<int>>>, bindings array<struct<root_kind: string, root_id: string, path: array<int>>>"
CANDIDATES = "spawner string, callee string, helper string, kind string, op_block int, op_instr int, go_block int, call_block int, alloc int, loc_path array<int>, arms array<struct<kind: string, root_kind: string, root_id: string, path: array<int>>>, escapes boolean, capacity string, cap long, file string, line int, col int"


def bodies(facts: dict[str, DataFrame]) -> DataFrame:
    """func, body (struct of arrays); facts: param, freevar, value (with sort for the checkers), block, cfg_edge, instr, select_arm."""
    out = facts["block"].groupBy("func").agg((F.max("b") + 1).alias("n"))
    for name, cols in (("param", ["idx", "vid"]), ("freevar", ["idx", "vid"]), ("value", ["vid", "kind", "ref_name", "const_kind", "const_int", "const_bool", *(["sort"] if "sort" in facts["value"].columns else [])]), ("cfg_edge", ["src", "succ_pos", "dst", "pred_pos"]), ("instr", ["b", "i", "op", "dst", "a0", "a1", "a2", "a3", "operands", "field", "sub", "callee_kind", "callee", "blocking", "file", "line", "col"]), ("select_arm", ["b", "i", "arm", "dir", "chan", "send"])):
        out = out.join(facts[name].groupBy("func").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name)), "func", "left")
    return out.select("func", F.struct("n", "param", "freevar", "value", "cfg_edge", "instr", "select_arm").alias("body"))


class Body:
    def __init__(self, x: dict) -> None:
        self.params = [p["vid"] for p in x["param"] or []]
        self.free = [p["vid"] for p in x["freevar"] or []]
        self.values = {v["vid"]: v for v in x["value"] or []}
        self.instrs = x["instr"] or []
        self.arms: dict[tuple, list[dict]] = {}
        for a in x["select_arm"] or []:
            self.arms.setdefault((a["b"], a["i"]), []).append(a)
        self.graph = Graph(x["n"] or 0, [(e["src"], e["dst"]) for e in x["cfg_edge"] or []])
        self.defs = {i["dst"]: i for i in self.instrs if i["dst"]}
        self.stores: dict[int, list[int]] = {}
        for i in self.instrs:
            if i["op"] == "Store":
                self.stores.setdefault(i["a0"], []).append(i["a1"])
        self.bindings: dict[str, list[int] | None] = {}
        for i in self.instrs:
            if i["op"] == "MakeClosure":  # bound twice: which of them is called can't be told
                self.bindings[i["callee"]] = None if i["callee"] in self.bindings else i["operands"]

    def loc(self, v: int | None) -> tuple:
        """The access path that v stands for. A cell and what is loaded from it are one place."""
        path: list[int] = []
        for _ in range(HOPS + 1):
            if len(path) > effects.MAX_DEPTH or not v:
                return UNKNOWN
            kind = self.values.get(v, {}).get("kind")
            if kind == "Param":
                return ("Param", str(self.params.index(v)), tuple(path)) if v in self.params else UNKNOWN
            if kind == "FreeVar":
                return ("FreeVar", str(self.free.index(v)), tuple(path)) if v in self.free else UNKNOWN
            if kind == "Global":
                return ("Global", self.values[v]["ref_name"], tuple(path))
            d = self.defs.get(v)
            if d is None:
                return UNKNOWN
            if d["op"] == "FieldAddr":
                path.insert(0, d["field"])
                v = d["a0"]
            elif d["op"] in ("Alloc", "Make"):
                return ("Alloc", str(d["dst"]), tuple(path))
            elif d["op"] in ("Load", "Assign"):
                v = d["a0"]
            else:
                return UNKNOWN
        return UNKNOWN

    def arg(self, args: list[int], i: int) -> tuple:
        return self.loc(args[i]) if 0 <= i < len(args) else UNKNOWN

    def captured(self, callee: str, i: int) -> tuple:
        return self.arg(self.bindings.get(callee) or [], i)

    def canonical(self, v: int) -> int:
        for _ in range(CANONICAL):
            d = self.defs.get(v)
            if d is None or d["op"] != "Assign":
                break
            v = d["a0"]
        return v

    # -- effects

    def own(self) -> Iterator[tuple]:
        """(domain, location, op) of the body itself."""
        cyclic = None
        for i in self.instrs:
            op = i["op"]
            if op == "Make" and i["sub"] == "Chan":
                yield "chan", self.loc(i["dst"]), "Make"
            elif op in ("Send", "Recv"):
                yield "chan", self.loc(i["a0"]), op
            elif op == "CloseChan":
                yield "chan", self.loc(i["a0"]), "Close"
            elif op == "Select":
                for a in self.arms.get((i["b"], i["i"]), []):
                    yield "chan", self.loc(a["chan"]), "Select"
            elif op == "Lock":
                yield "lock", self.loc(i["a0"]), i["sub"]
            elif op in ("Go", "Defer"):
                if op == "Go":
                    cyclic = self.graph.cyclic() if cyclic is None else cyclic
                    yield "spawn", UNKNOWN, "Unbounded" if cyclic[i["b"]] else "Bounded"
                if i["callee_kind"] == "Builtin" and i["callee"] == "close":
                    yield "chan", self.arg(i["operands"], 0), "Close"
                elif i["callee_kind"] == "Static" and i["callee"] in LOCKS:
                    kind = LOCKS[i["callee"]]
                    yield "lock", self.arg(i["operands"], 0), f"Deferred{kind}" if op == "Defer" and "Unlock" in kind else kind

    def sites(self) -> Iterator[tuple]:
        """(callee, argument locations, binding locations or None) of static calls; a lock method's effect is its own, so
        its site passes nothing on (None)."""
        for i in self.instrs:
            if i["op"] in ("Call", "Go", "Defer") and i["callee_kind"] == "Static":
                if i["callee"] in LOCKS:
                    yield i["callee"], None, None
                else:
                    bound = self.bindings.get(i["callee"]) or []
                    yield i["callee"], [self.loc(a) for a in i["operands"]], [self.loc(a) for a in bound]

    # -- leaks

    def escapes(self, channel: int) -> bool:
        """Whether the channel, an alias or a closure over it is put to a use that others may see."""
        chans, closures = {channel}, set()
        while True:
            before = len(chans) + len(closures)
            for i in self.instrs:
                op, dst = i["op"], i["dst"]
                if op in ("Load", "Assign", "Convert", "Phi"):
                    used = i["operands"] if op == "Phi" else [i["a0"]]
                    for s in (chans, closures):
                        if s.intersection(used):
                            s.add(dst)
                elif op == "Store" and i["a0"] in chans:
                    chans.add(i["a1"])
                elif op == "MakeClosure" and (chans | closures).intersection(i["operands"]):
                    closures.add(dst)
            if len(chans) + len(closures) == before:
                break
        held = chans | closures
        return any(self._lets_out(i, held) for i in self.instrs)

    def _lets_out(self, i: dict, held: set[int]) -> bool:
        op = i["op"]
        if op in ("Load", "Assign", "Convert", "Phi", "MakeClosure", "Recv", "CloseChan", "Alloc", "Jump", "Havoc"):
            return False
        if op == "Store":
            return i["a0"] not in held and i["a1"] in held
        if op == "Send":
            return i["a1"] in held
        if op == "Select":
            return any(a["send"] in held for a in self.arms.get((i["b"], i["i"]), []))
        if op in ("Call", "Go", "Defer"):
            if i["callee_kind"] == "Dynamic" and i["a0"] in held:
                return True
            harmless = i["callee_kind"] == "Builtin" and i["callee"] in (("close", "len", "cap") if op == "Call" else ("close",))
            return not harmless and not (op != "Call" and i["callee_kind"] == "Static") and bool(held.intersection(i["operands"]))
        reads = {i[a] for a in ("a0", "a1", "a2", "a3")}
        return bool(held & (reads | set(i["operands"] if op in ("Return", "Make") else ())))

    def capacity(self, v: int) -> int | None:
        """The constant capacity of the channel made at v, or kept in the cell v."""
        for _ in range(BRIDGES):
            d = self.defs.get(v)
            if d is None:
                return None
            if d["op"] == "Make" and d["sub"] == "Chan":
                c = self.values.get(self.canonical(d["operands"][0])) if d["operands"] else None
                return c["const_int"] if c and c["const_kind"] == "Int" and c["const_int"] >= 0 else None
            stored = self.stores.get(v, []) if d["op"] == "Alloc" else []
            if len(stored) != 1 or self.canonical(stored[0]) == v:
                return None
            v = self.canonical(stored[0])
        return None

    def through_cell(self, loc: tuple) -> tuple:
        """A location in a cell of this body that is stored to once: where what it holds comes from, if from outside."""
        v = int(loc[1])
        stored = self.stores.get(v, [])
        if self.defs.get(v, {}).get("op") != "Alloc" or len(stored) != 1:
            return UNKNOWN
        kind, i, path = self.loc(self.canonical(stored[0]))
        return _capped(kind, i, path + loc[2]) if kind in ("Param", "FreeVar") else UNKNOWN

    def mapped(self, loc: tuple, callee: str, args: list[int], hop: bool = False) -> tuple:
        """A location of the callee, as this body sees it at a call."""
        if loc[0] not in ("Param", "FreeVar"):
            return UNKNOWN
        base = self.arg(args, int(loc[1])) if loc[0] == "Param" else self.captured(callee, int(loc[1]))
        if hop and base[0] == "Alloc":
            base = self.through_cell(base)
        return UNKNOWN if base[0] == "Unknown" else _capped(base[0], base[1], base[2] + loc[2])

    def blocking(self, seen: Callable[[tuple], tuple]) -> Iterator[tuple]:
        """(instruction, kind, [(arm kind, location)]) of operations on channels that the spawner allocated; seen maps locations."""
        for i in self.instrs:
            if i["op"] in ("Send", "Recv"):
                at = seen(self.loc(i["a0"]))
                if at[0] == "Alloc":
                    yield i, i["op"], [(i["op"], at)]
            elif i["op"] == "Select" and i["blocking"]:
                arms = [("Send" if a["dir"] == "send" else "Recv", seen(self.loc(a["chan"]))) for a in self.arms.get((i["b"], i["i"]), [])]
                if arms and all(at[0] == "Alloc" for _, at in arms):
                    yield i, "Select", arms


def _capped(kind: str, i: str, path: tuple) -> tuple:
    return UNKNOWN if len(path) > effects.MAX_DEPTH else (kind, i, path)


def candidates(func: str, f: Body, known: dict[str, Body]) -> Iterator[tuple]:
    """Rows of CANDIDATES: operations of spawned functions, and of what these call directly, that may block for ever."""
    for go in f.instrs:
        if go["op"] != "Go" or go["callee_kind"] != "Static" or go["callee"] not in known:
            continue
        c, args = go["callee"], go["operands"]
        g = known[c]
        out = [(None, g, None, x) for x in g.blocking(lambda at: f.mapped(at, c, args))]
        for hop in g.instrs:
            h = hop["callee"]
            if hop["op"] in ("Call", "Defer") and hop["callee_kind"] == "Static" and h != c and h in known:
                out += [(h, known[h], hop["b"], x) for x in known[h].blocking(lambda at: f.mapped(g.mapped(at, h, hop["operands"], True), c, args))]
        for helper, host, through, (i, kind, arms) in out:
            v = int(arms[0][1][1])
            caps = [f.capacity(int(at[1])) for _, at in arms]
            if kind == "Select":
                cap = "Unbuffered" if all(n == 0 for n in caps) else "Silent"
            elif caps[0] is None or (kind == "Send" and caps[0] > 0 and (helper is not None or host.graph.cyclic()[i["b"]])):
                cap = "Silent"
            else:
                cap = "Buffered" if kind == "Send" and caps[0] > 0 else "Unbuffered"
            let_out = any(f.escapes(int(at[1])) for _, at in arms)
            places = [{"kind": k, "root_kind": at[0], "root_id": at[1], "path": list(at[2])} for k, at in arms]
            yield func, c, helper, kind, i["b"], i["i"], go["b"], through, v, list(arms[0][1][2]), places, let_out, cap, caps[0] if cap == "Buffered" else None, go["file"], go["line"], go["col"]


# -- bodies alike

#: Calls of these never give nil.
NEVER_NIL = {"flag.NewFlagSet"}
#: What has a meaning of its own among names of functions; the names without '.' and '/' (of builtins) besides.
FIXED = {*LOCKS, *NEVER_NIL}
#: Characters of the texts that are held with their answers.
HELD = 32 << 20
_NAME = re.compile(r'"(callee|ref_name|func)":"((?:[^"\\]|\\.)*)"')
_AT = re.compile(r',"file":"((?:[^"\\]|\\.)*)","line":(-?[0-9]+),"col":(-?[0-9]+)')
_MARK = re.compile("\ue000([0-9]+)\ue001")
_answers: dict[tuple, list[tuple]] = {}
_held = 0


class At(int):
    """The number of an instruction's position, in place of its line."""


def texted(df: DataFrame) -> DataFrame:
    """func, body, the latter as text (JSON)."""
    return df.select("func", F.to_json("body").alias("body")) if isinstance(df.schema["body"].dataType, StructType) else df.select("func", "body")


def filled(x, kind: DataType):
    """A value read from text, with the fields that are null there."""
    if x is None:
        return None
    if isinstance(kind, StructType):
        out = {f.name: filled(x.get(f.name), f.dataType) for f in kind}
        if "at" in x:
            out["line"] = At(x["at"])
        return out
    return [filled(v, kind.elementType) for v in x] if isinstance(kind, ArrayType) else x


def alike(func: str, texts: list[str | None]) -> tuple[str, list[str], list[tuple]] | None:
    """(what the texts share with those of all functions that differ from it in names and positions only, its names, its positions)."""
    text = "\x1f".join(["null" if t is None else t for t in texts])
    if "\ue000" in text:
        return None
    number: dict[str, int] = {json.dumps(func, ensure_ascii=False)[1:-1]: 0}
    places: list[tuple] = []

    def name(m: re.Match) -> str:
        raw = m[2]
        if raw in FIXED or "." not in raw and "/" not in raw:
            return m[0]
        return f'"{m[1]}":"\ue000{number.setdefault(raw, len(number))}\ue001"'

    def at(m: re.Match) -> str:
        places.append(m.groups())
        return f',"at":{len(places) - 1}'

    return _AT.sub(at, _NAME.sub(name, text)), list(number), places


def answers(what: tuple | None, func: str, texts: list[str | None], kinds: list[DataType], ask: Callable[..., Iterator[tuple]], place: int | None = None) -> list[tuple]:
    """The rows of ask(func, *values), values being the texts read. Functions whose texts are alike are asked about once in a worker: names and positions (file, line and
    column, from the field `place` of a row on) are put in for others. what: which question this is, None for one that goes by names."""
    global _held
    same = alike(func, texts) if what is not None and func is not None else None
    if same is None:
        return list(ask(func, *[None if t is None else filled(json.loads(t), k) for t, k in zip(texts, kinds)]))
    key, names, places = same
    rows = _answers.get((what, key))
    if rows is None:
        rows = list(ask("\ue0000\ue001", *[filled(json.loads(t), k) for t, k in zip(key.split("\x1f"), kinds)]))
        if _held > HELD:
            _answers.clear()
            _held = 0
        _answers[what, key] = rows
        _held += len(key)
    if not rows:
        return rows
    real = [func, *[json.loads(f'"{n}"') for n in names[1:]]]
    put = lambda m: real[int(m[1])]
    out = []
    for r in rows:
        new = [_named(v, put) for v in r]
        if place is not None and type(new[place + 1]) is At:
            file, line, col = places[new[place + 1]]
            new[place : place + 3] = json.loads(f'"{file}"'), int(line), int(col)
        out.append(tuple(new))
    return out


def _named(v, put: Callable[[re.Match], str]):
    if isinstance(v, str):
        return _MARK.sub(put, v) if "\ue000" in v else v
    if isinstance(v, list):
        return [_named(x, put) for x in v]
    return {k: _named(x, put) for k, x in v.items()} if isinstance(v, dict) else v


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _each(ddl: str, f: Callable[[str, Body], Iterator[tuple]], kind: DataType):
    schema, what = _schema(ddl), (ddl,)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [r for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in answers(what, n, [x], [kind], lambda n, x: f(n, Body(x)))]
            yield columns(schema, got)

    return run


def columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _place(loc: tuple) -> dict:
    return {"root_kind": loc[0], "root_id": loc[1], "path": list(loc[2])}


def own_effects(df: DataFrame) -> DataFrame:
    """Effect rows of the bodies themselves."""
    own = _each(OWN, lambda n, b: ((n, d, at[0], at[1], list(at[2]), op) for d, at, op in b.own()), df.schema["body"].dataType)
    return texted(df).mapInArrow(own, OWN).distinct()


def call_sites(df: DataFrame) -> DataFrame:
    """Static call sites; args is null where nothing is to be passed on."""
    sites = _each(SITES, lambda n, b: ((n, c, None if a is None else list(map(_place, a)), None if a is None else list(map(_place, k))) for c, a, k in b.sites()), df.schema["body"].dataType)
    return texted(df).mapInArrow(sites, SITES)


def summaries(df: DataFrame, funcs: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Effects of every function: own ones, those of static callees through their arguments, and those of what only the
    call graph knows, at unknown places. A function without a body may do anything."""
    sites = saved(call_sites(df), "call-sites")
    more = effects.unplaced(call_edges, sites)
    names = funcs.select("func").unionByName(call_edges.select(F.col("callee").alias("func"))).unionByName(sites.select(F.col("callee").alias("func"))).distinct()
    none = names.join(df.select("func"), "func", "left_anti")
    own = effects.join(own_effects(df), effects.top(none))
    return saved(effects.fixpoint(own, sites.where("args is not null").unionByName(more)), "summaries")


def leak_candidates(df: DataFrame) -> DataFrame:
    """Candidates of all spawners, before effects are asked for counterparts."""
    go = df.select("func", F.explode("body.instr").alias("x")).where("x.callee_kind = 'Static' and x.op in ('Go', 'Call', 'Defer')").select("func", "x.op", F.col("x.callee").alias("callee")).distinct()
    spawned = go.where("op = 'Go'").select("func", "callee")
    called = spawned.join(go.where("op <> 'Go'").select(F.col("func").alias("callee"), F.col("callee").alias("h")), "callee").select("func", F.col("h").alias("callee"))
    needed = spawned.unionByName(called).distinct().join(df.select(F.col("func").alias("callee"), F.col("body").alias("other")), "callee")
    per = needed.groupBy("func").agg(F.to_json(F.sort_array(F.collect_list(F.struct("callee", "other")))).alias("others"))
    schema, body = _schema(CANDIDATES), df.schema["body"].dataType
    kinds = [body, ArrayType(StructType().add("callee", "string").add("other", body))]

    def ask(func: str, x: dict, others: list[dict]) -> Iterator[tuple]:
        return candidates(func, Body(x), {o["callee"]: Body(o["other"]) for o in others})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield columns(schema, [r for func, *texts in zip(*[b.column(i).to_pylist() for i in range(3)]) for r in answers((CANDIDATES,), func, texts, kinds, ask, schema.names.index("file"))])

    return texted(df).join(per, "func").mapInArrow(run, CANDIDATES)


def leaks(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Candidates that don't escape, have no counterpart in their spawner's effects and no capacity that can't be judged."""
    key = ["spawner", "callee", "helper", "op_block", "op_instr", "go_block", "call_block"]
    c = saved(leak_candidates(df).where("not escapes and capacity <> 'Silent'").withColumn("id", F.xxhash64(*key)), "leak-candidates")
    loc = F.struct("root_kind", "root_id", "path").alias("loc")
    env = summary.where("domain = 'chan'").select("func", loc, "op", "root_kind")
    arms = c.select(F.col("spawner").alias("func"), "id", F.col("kind").alias("ckind"), F.explode("arms").alias("a")).select("func", "id", "ckind", "a.kind", F.struct("a.root_kind", "a.root_id", "a.path").alias("loc"))
    one = effects.without_counterpart(arms.where("ckind <> 'Select'"), env).select("id")
    many = effects.blocked_selects(arms.where("ckind = 'Select'"), env, ["id"])
    return c.join(one.unionByName(many).distinct(), "id", "left_semi").drop("id")


def leak_message(kind: str = "kind", callee: str = "callee", helper: str = "helper") -> F.Column:
    """The text of a leak finding; it names no position."""
    inside = F.coalesce(F.concat(F.lit(" in helper "), helper), F.lit(""))
    place, close = " on a spawner-created channel with no ", ", close, or select"
    what = F.when(F.col(kind) == "Send", F.concat(F.lit("send"), inside, F.lit(f"{place}receive{close} in the spawning environment")))
    what = what.when(F.col(kind) == "Recv", F.concat(F.lit("receive"), inside, F.lit(f"{place}send{close}")))
    return F.concat(F.lit("goroutine "), callee, F.lit(" may block forever: "), what.otherwise(F.concat(F.lit("blocking select"), inside, F.lit(" whose channels have no counterpart operations"))))

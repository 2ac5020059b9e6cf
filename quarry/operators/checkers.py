"""Functions as formulas, and the nil and bounds checkers that rest on them.

A function is encoded over its acyclic control flow: a guard per block, an equation per instruction. A checker asks whether a violation
is satisfiable together with the guard of its block; only a confirmed `sat` reports, with the way that the model takes and its values of parameters. A
violation over parameters alone becomes a precondition of the function, which is then asked of its callers. What is proven of a pointer result at every return (it is
never nil, or not where the error result is nil) becomes a postcondition, which callers assume. Annotated clauses stand beside the inferred ones: preconditions are
asked of callers, postconditions assumed by them and checked against the body. Callees come before callers, recursive components go round by round: a round
re-encodes only the callers of functions whose clauses are new.

Values: integers are bit vectors of their type's width, a pointer is (nil, address), a sequence (length, capacity). What can't be modelled
has no term, and a violation that would need one is never raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions import terms as T
from ..storage import saved
from .bodies import NEVER_NIL, Body, answers, columns, texted
from .bounds import NUMERIC
from .cfg import immediate_dominators, strictly_dominates, topological

MOST_ASSERTS, DEPTH = 50_000, 16
MIRROR = {"Lt": ("lt", False), "Leq": ("le", False), "Gt": ("lt", True), "Geq": ("le", True)}
ARITH = {"Add": "bvadd", "Sub": "bvsub", "Mul": "bvmul", "And": "bvand", "Or": "bvor", "Xor": "bvxor", "Shl": "bvshl"}
TEXT = {"bounds": "index/slice out of bounds in ", "div-zero": "division by zero in ", "overflow": "integer overflow in ", "nil-deref": "nil dereference in "}
RESULT = "func string, kind string, checker string, tag string, message string, term string, file string, line int, col int, trace array<int>, model array<struct<name: string, value: string>>"
FINDING = ["checker", "tag", "func", "message", "file", "line", "col", "severity", "trace", "model"]
ALL_RULES = ("nil", "bounds", "contract")
CONTRACT, UNVERIFIED = "contract", "unverified-annotation"
MOST_RESULTS = 64


def sorts(types: DataFrame, part: str = "import_path") -> DataFrame:
    """(part, type_id, sort): s<bits>, u<bits>, bool, ptr, ptrerror (the interface `error`), seq, array:<n> (also of a pointer to one), or null. Names are
    followed, cycles end."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by = {t["type_id"]: t for t in ts}

                def under(i, by=by):
                    for _ in range(len(by) + 1):
                        t = by.get(i)
                        if t is None or t["kind"] != "Named":
                            return t
                        i = t["elem"]
                    return None

                out = []
                for i in by:
                    t = under(i)
                    e = under(t["elem"]) if t and t["kind"] == "Pointer" else None
                    if t is None:
                        s = None
                    elif t["kind"] == "Basic":
                        family, bits = NUMERIC.get(t["name"], (None, 0))
                        s = {"signed": f"s{bits}", "unsigned": f"u{bits}", "float": f"f{bits}"}.get(family) or {"bool": "bool", "string": "seq"}.get(t["name"])
                    elif t["kind"] == "Array":
                        s = f"array:{t['array_len']}"
                    elif e is not None and e["kind"] == "Array":
                        s = f"ptr:{e['array_len']}"
                    else:
                        s = {"Pointer": "ptr", "Interface": "ptrerror" if by[i]["kind"] == "Named" and by[i]["name"] == "error" else "ptr", "Slice": "seq"}.get(t["kind"])
                    out.append((p, i, s))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], k_) for k, k_ in enumerate((pa.string(), pa.int32(), pa.string()))], [part, "type_id", "sort"])

    one = types.groupBy(part).agg(F.collect_list(F.struct("type_id", "kind", "name", "elem", "array_len")).alias("ts"))
    return one.mapInArrow(run, f"{part} string, type_id int, sort string")


class Encoded(Body):
    """asserts: what holds in the function; guard(b): whether block b is reached. ensures: callees' postconditions (tag, term)."""

    def __init__(self, x: dict, ensures: dict[str, list[tuple]] | None = None) -> None:
        super().__init__(x)
        self.asserts: list[tuple] = []
        self.dag, self.seen = self.graph.cut()
        self.idom = immediate_dominators(self.dag)
        self.branch = {i["b"]: i["a0"] for i in self.instrs if i["op"] == "Branch"}
        self.preds: dict[int, list[int]] = {}  # in the order of phi operands
        for e in sorted(x["cfg_edge"] or [], key=lambda e: (e["dst"], e["pred_pos"] if e["pred_pos"] is not None else 0, e["src"])):
            self.preds.setdefault(e["dst"], []).append(e["src"])
        for v in list(self.values):
            self._declared(v)
        for b in range(self.graph.n):
            g = T.var(f"g{b}", "Bool")
            self.asserts.append(g if b == 0 else T.eq(g, T.disj(*[self.edge(a, b) for a in range(self.graph.n) for s in set(self.dag[a]) if s == b])) if self.seen[b] else T.negation(g))
        for i in self.instrs:
            self._defined(i)
        self._forwarded()
        for i in self.instrs:
            if i["op"] == "Call" and i["callee_kind"] == "Static":
                for _, t in (ensures or {}).get(i["callee"], []):
                    t = self.bound(t, i["operands"], self.results(i["dst"]))
                    if t is not None:
                        self._add(T.disj(T.negation(self.guard(i["b"])), t))
        self.sites = self.derefs()
        if len(self.asserts) > MOST_ASSERTS:
            raise OverflowError

    def name(self, v: int) -> str:
        return f"p{self.params.index(v)}" if v in self.params else f"v{v}"

    def sort(self, v) -> str | None:
        return (self.values.get(v) or {}).get("sort")

    def num(self, v) -> tuple | None:
        s = self.sort(v)
        return T.var(self.name(v), int(s[1:])) if s and s[0] in "su" and s[1:].isdigit() else None

    def signed(self, v) -> bool:
        return (self.sort(v) or "u").startswith("s")

    def boolean(self, v) -> tuple | None:
        return T.var(self.name(v), "Bool") if self.sort(v) == "bool" else None

    def nil(self, v) -> tuple | None:
        return T.var(f"{self.name(v)}.nil", "Bool") if (self.sort(v) or "").startswith("ptr") else None

    def addr(self, v) -> tuple:
        return T.var(f"{self.name(v)}.addr", 64)

    def length(self, v, what: str = "len") -> tuple | None:
        s = self.sort(v) or ""
        if ":" in s:
            return T.lit(64, int(s.split(":")[1]))
        return T.var(f"{self.name(v)}.{what}", 64) if s == "seq" else None

    def guard(self, b: int) -> tuple:
        return T.var(f"g{b}", "Bool")

    def edge(self, a: int, b: int) -> tuple:
        """The way from a to b; which branch it is goes by the successors as they were."""
        c = self.boolean(self.branch.get(a)) if a in self.branch else None
        ways = [k for k, s in enumerate(self.graph.succs[a]) if s == b]
        if c is None or len(self.graph.succs[a]) != 2 or len(ways) != 1:
            return self.guard(a)
        return T.conj(self.guard(a), c if ways[0] == 0 else T.negation(c))

    def equal(self, a: int, b: int) -> tuple | None:
        if self.num(a) and self.num(b):
            return T.eq(self.num(a), self.num(b)) if self.sort(a)[1:] == self.sort(b)[1:] else None
        if self.boolean(a) and self.boolean(b):
            return T.eq(self.boolean(a), self.boolean(b))
        if self.nil(a) and self.nil(b):
            return T.conj(T.eq(self.nil(a), self.nil(b)), T.disj(self.nil(a), T.eq(self.addr(a), self.addr(b))))
        if self.sort(a) == self.sort(b) == "seq":
            return T.conj(T.eq(self.length(a), self.length(b)), T.eq(self.length(a, "cap"), self.length(b, "cap")))
        return None

    def _add(self, t: tuple | None) -> None:
        if t is not None:
            self.asserts.append(t)

    def _declared(self, v: int) -> None:
        x = self.values[v]
        if self.sort(v) == "seq" and self.defs.get(v, {}).get("op") != "Slice":
            self._add(T.binary("bvule", self.length(v), self.length(v, "cap")))
        if x["kind"] == "Const":
            if x["const_kind"] == "Int" and self.num(v):
                self._add(T.eq(self.num(v), T.lit(int(self.sort(v)[1:]), x["const_int"])))
            elif x["const_kind"] == "Bool" and self.boolean(v):
                self._add(self.boolean(v) if x["const_bool"] else T.negation(self.boolean(v)))
            elif x["const_kind"] == "Nil":
                self._add(self.nil(v))

    def _defined(self, i: dict) -> None:
        op, d, a, b = i["op"], i["dst"], i["a0"], i["a1"]
        if op == "Assign":
            self._add(self.equal(d, a))
        elif (op in ("Alloc", "FieldAddr", "IndexAddr", "MakeInterface") or op == "Call" and i["callee_kind"] == "Static" and i["callee"] in NEVER_NIL) and self.nil(d):
            self._add(T.negation(self.nil(d)))
        elif op == "BinOp":
            self._binop(i["sub"], d, a, b)
        elif op == "UnOp":
            if i["sub"] == "Not" and self.boolean(d) and self.boolean(a):
                self._add(T.eq(self.boolean(d), T.negation(self.boolean(a))))
            elif self.num(d) and self.num(a) and self.sort(d) == self.sort(a):
                w = int(self.sort(a)[1:])
                self._add(T.eq(self.num(d), T.binary("bvsub", T.lit(w, 0 if i["sub"] == "Neg" else -1), self.num(a))))
        elif op == "Convert" and self.num(d) and self.num(a):
            ws, wd = int(self.sort(a)[1:]), int(self.sort(d)[1:])
            if ws == wd:
                self._add(T.eq(self.num(d), self.num(a)))
            elif ws < wd:  # wider: the source's range
                if self.signed(a):
                    self._add(T.conj(T.binary("bvsle", T.lit(wd, -(1 << (ws - 1))), self.num(d)), T.binary("bvsle", self.num(d), T.lit(wd, (1 << (ws - 1)) - 1))))
                else:
                    self._add(T.binary("bvule", self.num(d), T.lit(wd, (1 << ws) - 1)))
        elif op == "Phi":
            ways = [(p, v) for p, v in zip(self.preds.get(i["b"], []), i["operands"]) if p < self.graph.n and i["b"] in self.dag[p]]
            before: list[tuple] = []
            for k, (p, v) in enumerate(ways):  # the first way that is taken decides, the last one otherwise
                here = [] if k == len(ways) - 1 else [T.negation(self.edge(p, i["b"]))]
                same = self.equal(d, v)
                if same is not None:
                    self._add(T.disj(*before, *here, same))
                before.append(self.edge(p, i["b"]))
        elif op == "Make" and i["sub"] == "Slice" and self.sort(d) == "seq":
            for what, v in zip(("len", "cap"), i["operands"]):
                if self.num(v) and self.sort(v)[1:] == "64":
                    self._add(T.eq(self.length(d, what), self.num(v)))
        elif op == "Slice" and self.sort(d) == "seq":
            low, high, top = self.slice_terms(i)
            cap = top if i["a3"] else self.length(a, "cap")
            if low is not None and high is not None and cap is not None:
                self._add(T.eq(self.length(d), T.binary("bvsub", high, low)))
                self._add(T.eq(self.length(d, "cap"), T.binary("bvsub", cap, low)))
        elif op == "Call" and i["callee_kind"] == "Builtin" and i["callee"] in ("len", "cap") and i["operands"] and self.num(d):
            n = self.length(i["operands"][0], i["callee"])
            if n is not None and self.sort(d)[1:] == "64":
                self._add(T.eq(self.num(d), n))

    def slice_terms(self, i: dict) -> tuple:
        part = lambda v: self.num(v) if self.sort(v) in ("s64", "u64") else None
        return T.lit(64, 0) if not i["a1"] else part(i["a1"]), self.length(i["a0"]) if not i["a2"] else part(i["a2"]), part(i["a3"]) if i["a3"] else None

    def _binop(self, kind: str, d: int, a: int, b: int) -> None:
        if kind in ("Eq", "Neq") and self.boolean(d):
            t = self.equal(a, b)
            if t is not None:
                self._add(T.eq(self.boolean(d), t if kind == "Eq" else T.negation(t)))
            return
        x, y = self.num(a), self.num(b)
        if x is None or y is None or T.sort_of(x) != T.sort_of(y):
            return
        s = self.signed(a)
        if kind in MIRROR and self.boolean(d):
            op, swap = MIRROR[kind]
            self._add(T.eq(self.boolean(d), T.binary(("bvs" if s else "bvu") + op, *((y, x) if swap else (x, y)))))
        elif self.num(d) and T.sort_of(self.num(d)) == T.sort_of(x):
            if kind == "AndNot":
                t = T.binary("bvand", x, T.binary("bvxor", y, T.lit(T.sort_of(y), -1)))
            else:
                op = ARITH.get(kind) or {"Div": "bvsdiv" if s else "bvudiv", "Rem": "bvsrem" if s else "bvurem", "Shr": "bvashr" if s else "bvlshr"}.get(kind)
                if op is None:
                    return
                t = T.binary(op, x, y)
            self._add(T.eq(self.num(d), t))

    def _forwarded(self) -> None:
        """Loads of one address between two stores are equal; an instruction of unknown effect ends this, a call doesn't."""
        place = {b: k for k, b in enumerate(topological(self.dag))}
        first: dict = {}
        for i in sorted((i for i in self.instrs if i["b"] in place), key=lambda i: (place[i["b"]], i["i"])):
            if i["op"] == "Store" or i["op"] == "Havoc" and not i["dst"]:
                first = {}
            elif i["op"] == "Load":
                key = self.address(i["a0"])
                if key in first:
                    self._add(self.equal(i["dst"], first[key]))
                first.setdefault(key, i["dst"])

    def address(self, v: int, depth: int = 64) -> tuple:
        """A key that equal addresses share: copies are followed, fields and elements name their base and what they pick."""
        v = self.canonical(v)
        d = self.defs.get(v)
        if d is None or not depth or d["op"] not in ("FieldAddr", "IndexAddr"):
            return (v,)
        return d["op"], d["field"] if d["op"] == "FieldAddr" else self.canonical(d["a1"]), self.address(d["a0"], depth - 1)

    def results(self, dst: int | None) -> list[int | None]:
        """The values that hold a call's results: its own, or those that are extracted from it."""
        if not dst:
            return []
        if self.sort(dst):
            return [dst]
        out: list[int | None] = []
        for i in self.instrs:
            if i["op"] == "Extract" and i["a0"] == dst and i["field"] <= MOST_RESULTS:
                out += [None] * (i["field"] + 1 - len(out))
                out[i["field"]] = out[i["field"]] or i["dst"]
        return out

    def origin(self, v: int) -> tuple[str, int] | None:
        """(callee, number) where v is a result of a static call."""
        v, k = self.canonical(v), 0
        d = self.defs.get(v)
        if d and d["op"] == "Extract":
            k, d = d["field"], self.defs.get(self.canonical(d["a0"]))
        return (d["callee"], k) if d and d["op"] == "Call" and d["callee_kind"] == "Static" else None

    def way(self, model: dict, block: int) -> list[int]:
        """Blocks from the entry to `block` that the model's guards take: the shortest way."""
        before = {0: None}
        todo = [0]
        for b in todo:
            for s in self.dag[b]:
                if s not in before and model.get(f"g{s}", True):
                    before[s] = b
                    todo.append(s)
        out, b = [], block if block in before else None
        while b is not None:
            out.append(b)
            b = before[b]
        return out[::-1]

    # -- violations

    def ground(self, v: int, depth: int = DEPTH) -> bool:
        """Whether v is a parameter, a constant, or made from such by make and slicing."""
        if (self.values.get(v) or {}).get("kind") in ("Param", "Const"):
            return True
        d = self.defs.get(v)
        if d is None or not depth:
            return False
        flat = lambda x: not x or (self.values.get(x) or {}).get("kind") in ("Param", "Const")
        if d["op"] == "Make" and d["sub"] == "Slice":
            return all(map(flat, d["operands"]))
        if d["op"] == "Slice":
            return (":" in (self.sort(d["a0"]) or "") or self.ground(d["a0"], depth - 1)) and all(flat(d[c]) for c in ("a1", "a2", "a3"))
        return False

    def derefs(self) -> list[tuple]:
        """(instruction, subject) of everything that goes through a pointer."""
        return [(i, v) for i in self.instrs if i["op"] in ("Load", "Store", "FieldAddr", "Field") and self.nil(v := self.canonical(i["a0"]))]

    def known(self, b: int, k: int) -> list[tuple]:
        """What went through before place k of block b, on every way there, wasn't nil."""
        return [T.disj(T.negation(self.guard(x["b"])), T.negation(self.nil(u))) for x, u in self.sites if (x["b"] == b and x["i"] < k) or strictly_dominates(self.idom, x["b"], b)]

    def violations(self) -> Iterator[tuple]:
        """(instruction, checker, tag, violation, values it is made of, assumptions)."""
        for i in self.instrs:
            op, a, b = i["op"], i["a0"], i["a1"]
            if op in ("Load", "Store", "FieldAddr", "Field") and self.nil(self.canonical(a)):
                v = self.canonical(a)
                yield i, "nil", "nil-deref", self.nil(v), [v], self.known(i["b"], i["i"])
            if op in ("Index", "IndexAddr"):
                n = self.length(a)
                if n is not None and self.sort(b) in ("s64", "u64"):
                    yield i, "bounds", "bounds", T.disj(T.binary("bvslt", self.num(b), T.lit(64, 0)), T.binary("bvsle", n, self.num(b))), [a, b], []
            elif op == "Slice":
                low, high, top = self.slice_terms(i)
                cap = self.length(a, "cap")
                if None not in (low, high, cap) and (top is not None or not i["a3"]):
                    bad = [T.binary("bvslt", low, T.lit(64, 0)), T.binary("bvslt", high, low), T.binary("bvslt", cap, high)]
                    yield i, "bounds", "bounds", T.disj(*bad, *([T.binary("bvslt", cap, top)] if top else [])), [a, *[i[c] for c in ("a1", "a2", "a3") if i[c]]], []
            elif op == "BinOp" and i["sub"] in ("Div", "Rem") and self.num(a) and self.num(b) and T.sort_of(self.num(a)) == T.sort_of(self.num(b)):
                w = T.sort_of(self.num(a))
                yield i, "bounds", "div-zero", T.eq(self.num(b), T.lit(w, 0)), [b], []
                if i["sub"] == "Div" and self.signed(a):
                    yield i, "bounds", "overflow", T.conj(T.eq(self.num(a), T.lit(w, 1 << (w - 1))), T.eq(self.num(b), T.lit(w, -1))), [a, b], []
            elif op == "Convert" and self.num(a) and self.num(i["dst"]):
                bad = self.lossy(self.num(a), self.signed(a), int(self.sort(i["dst"])[1:]), self.signed(i["dst"]))
                if bad is not None:
                    yield i, "bounds", "overflow", bad, [a], []

    @staticmethod
    def lossy(x: tuple, ss: bool, wd: int, sd: bool) -> tuple | None:
        ws = T.sort_of(x)
        if not (wd < ws or (wd == ws and sd != ss)):
            return None
        most = (1 << (wd - 1)) - 1 if sd else (1 << wd) - 1
        if not ss:
            return T.binary("bvult", T.lit(ws, most), x)
        low = T.binary("bvslt", x, T.lit(ws, -(1 << (wd - 1)) if sd else 0))
        return low if wd == ws else T.disj(low, T.binary("bvslt", T.lit(ws, most), x))

    def bound(self, term: tuple, args: list[int], results: list[int | None] = ()) -> tuple | None:
        """A callee's clause over this function's values; None where an argument or result has no term of its sort."""
        to = {}
        for n, s in T.free_vars(term).items():
            k, _, part = n[1:].partition(".")
            own = args if n[0] == "p" else results
            v = own[int(k)] if int(k) < len(own) else None
            t = None if v is None else self.nil(v) if part == "nil" else self.length(v, part) if part in ("len", "cap") else self.boolean(v) if s == "Bool" else self.num(v)
            if t is None or T.sort_of(t) != s:
                return None
            to[n] = t
        return T.substitute(term, to)


def over_params(t: tuple) -> bool:
    names = T.free_vars(t)
    return bool(names) and all(n[0] == "p" for n in names)


def postconditions(e: Encoded, unsat) -> Iterator[tuple]:
    """Terms over r<i> that hold at every return: r<i> is never nil; or else, not where the error result r<e> is. A return that names no literal nil as its
    error is taken to name an error."""
    returns = [i for i in e.instrs if i["op"] == "Return"]
    if not returns or len({len(i["operands"]) for i in returns}) > 1:
        return
    literal = lambda v: (e.values.get(e.canonical(v)) or {}).get("const_kind") == "Nil"
    solid = lambda i, k: e.nil(i["operands"][k]) is not None and unsat(i["b"], e.nil(i["operands"][k]))
    n = len(returns[0]["operands"])
    sorts = [[e.sort(i["operands"][k]) or "" for i in returns] for k in range(n)]
    errors = [k for k in range(n) if any(s == "ptrerror" for s in sorts[k])]
    for k in range(n):
        if not any(s.startswith("ptr") for s in sorts[k]):
            continue
        if all(solid(i, k) for i in returns):
            yield T.negation(T.var(f"r{k}.nil", "Bool"))
            continue
        for x in errors:
            if x != k and all(not literal(i["operands"][x]) or solid(i, k) for i in returns):
                yield T.disj(T.negation(T.var(f"r{x}.nil", "Bool")), T.negation(T.var(f"r{k}.nil", "Bool")))


def checked(func: str, x: dict, clauses: dict[str, list[dict]], own: list[dict], budget: int, rules: tuple = ALL_RULES) -> Iterator[tuple]:
    """RESULT rows of one function: its preconditions (kind requires), postconditions (ensures) and findings, or one row (unencoded) where it has no
    formula. clauses: callees' clauses (side, tag, term, annotated, shown); own: its own. rules: the checkers that are asked, by name; a checker of one's own is a
    function that gives the violations of an Encoded, as Encoded.violations does."""
    post = {c: [(r["tag"], r["t"]) for r in rs if r["side"] == "ensures"] for c, rs in clauses.items()}
    try:
        e = Encoded(x, post)
    except (OverflowError, RecursionError, T.SortError) as why:
        yield func, "unencoded", None, None, type(why).__name__, None, None, None, None, None, None
        for c in own:
            if c["annotated"] and c["side"] == "ensures":
                yield func, "finding", UNVERIFIED, UNVERIFIED, unproven(c), None, None, None, None, None, None
        return

    def ask(b: int, *more: tuple) -> tuple[str, dict]:
        return T.check([*e.asserts, e.guard(b), *more], budget)

    def found(i: dict, checker: str, tag: str, message: str, *more: tuple) -> Iterator[tuple]:
        verdict, model = ask(i["b"], *more)
        if verdict == T.SAT:
            values = [{"name": k, "value": str(v).lower() if isinstance(v, bool) else str(v)} for k, v in sorted(model.items()) if k[0] == "p"]
            yield func, "finding", checker, tag, message, None, i["file"], i["line"], i["col"], e.way(model, i["b"]), values

    def required(i: dict, checker: str, tag: str, good: tuple, *more: tuple) -> Iterator[tuple]:
        bad = T.negation(good)
        if over_params(bad) and T.text(bad) not in held and ask(i["b"], *more, bad)[0] == T.SAT:
            held.add(T.text(bad))
            yield func, "requires", checker, tag, None, T.canonical([good]), None, None, None, None, None

    inferred = [c["t"] for c in own if c["side"] == "requires"]
    held: set[str] = set()
    own_rules = [r for r in rules if callable(r)]
    for i, checker, tag, bad, values, known in chain((v for v in e.violations() if v[1] in rules), *[r(e) for r in own_rules]):
        yield from required(i, checker, tag, T.negation(bad), *known)
        message = TEXT.get(tag, f"{tag} in ") + func
        ok = e.ground(values[0]) if checker == "nil" else all(map(e.ground, values))
        if not ok and checker == "nil" and (at := e.origin(i["a0"])):  # a result that its callee's postcondition speaks of
            ok = any(f"r{at[1]}.nil" in T.free_vars(c["t"]) for c in clauses.get(at[0], []) if c["side"] == "ensures" and c["tag"] == "nil-deref" and not c["annotated"])
            message = f"possibly-nil result of {at[0]} dereferenced in {func}"
        if ok:
            yield from found(i, checker, tag, message, *inferred, *known, bad)
    for i in e.instrs:
        if i["op"] != "Call" or i["callee_kind"] != "Static":
            continue
        theirs = [c for c in clauses.get(i["callee"], []) if c["side"] == "requires"]
        known = e.known(i["b"], i["i"])
        stated = {T.text(c["t"]) for c in theirs if not c["annotated"]}
        for c in theirs:
            want = e.bound(c["t"], i["operands"])
            if want is None:
                continue
            if not c["annotated"]:
                checker = {"nil-deref": "nil", "bounds": "bounds", "div-zero": "bounds", "overflow": "bounds"}.get(c["tag"], c["tag"])
                if checker in rules or (own_rules and checker == c["tag"]):
                    yield from required(i, checker, c["tag"], want, *known)
                    yield from found(i, checker, c["tag"], f"call to {i['callee']} violates its {c['tag']} requirement", *inferred, *known, T.negation(want))
            elif "contract" in rules and T.text(c["t"]) not in stated:
                yield from found(i, CONTRACT, CONTRACT, f"call to {i['callee']} violates annotated requires `{c['shown']}`", *inferred, T.negation(want))
    if "nil" in rules:
        for t in postconditions(e, lambda b, bad: ask(b, bad)[0] == T.UNSAT):
            yield func, "ensures", "nil", "nil-deref", None, T.canonical([t]), None, None, None, None, None
    if "contract" in rules:
        returns = [i for i in e.instrs if i["op"] == "Return"]
        for c in own:
            if c["annotated"] and c["side"] == "ensures":
                wants = [e.bound(c["t"], e.params, i["operands"]) for i in returns]
                if not wants or None in wants or any(ask(i["b"], *inferred, T.negation(w))[0] != T.UNSAT for i, w in zip(returns, wants)):
                    yield func, "finding", UNVERIFIED, UNVERIFIED, unproven(c), None, None, None, None, None, None


def unproven(c: dict) -> str:
    return f"annotated ensures `{c['shown']}` not proven against the body; callers still assume it"


CLAUSE = "side string, tag string, term string, annotated boolean, shown string"
CLAUSES = ["side", "tag", "term", "annotated", "shown"]


def static_calls(df: DataFrame) -> DataFrame:
    return df.select("func", F.explode("body.instr").alias("x")).where("x.callee_kind = 'Static'").select("func", F.col("x.callee").alias("callee")).distinct()


def informed(df: DataFrame, calls: DataFrame, clauses: DataFrame) -> DataFrame:
    """func, body, callees (their clauses), own (its own), the last three as text."""
    known = clauses.where("side <> 'widened'")
    below = calls.join(known.withColumnRenamed("func", "callee"), "callee").groupBy("func").agg(F.sort_array(F.collect_list(F.struct(F.col("callee").alias("func"), *CLAUSES))).alias("callees"))
    mine = known.groupBy("func").agg(F.sort_array(F.collect_list(F.struct(*CLAUSES))).alias("own"))
    every = texted(df).join(below, "func", "left").join(mine, "func", "left")
    return every.select("func", "body", F.to_json("callees").alias("callees"), F.to_json("own").alias("own"))


def _kinds(body: DataType) -> list[DataType]:
    """Types of the texts of `informed`; body: of the bodies that they are of."""
    return [body, StructType.fromDDL(f"x array<struct<func: string, {CLAUSE}>>")[0].dataType, StructType.fromDDL(f"x array<struct<{CLAUSE}>>")[0].dataType]


def _read(callees: list[dict] | None, own: list[dict] | None) -> tuple[dict[str, list[dict]], list[dict]]:
    """(callees' clauses, its own) of a row of `informed`, with their terms."""
    read = lambda c: c | {"t": T.parse_query(c["term"])[0]}
    by: dict[str, list] = {}
    for c in callees or []:
        by.setdefault(c["func"], []).append(read(c))
    return by, [read(c) for c in own or []]


def _rows(budget: int, schema: pa.Schema, rules: tuple, kinds: list[DataType]):
    what = None if any(map(callable, rules)) else ("checked", budget, rules)

    def ask(func: str, body: dict, callees: list[dict] | None, own: list[dict] | None) -> Iterator[tuple]:
        return checked(func, body, *_read(callees, own), budget, rules)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for func, *texts in zip(*[b.column(i).to_pylist() for i in range(4)]):
                out += answers(what, func, texts, kinds, ask, 6)
            yield columns(schema, out)

    return run


def analysed(df: DataFrame, budget: int = 2000, rounds: int = 8, annotated: DataFrame | None = None, rules: tuple = ALL_RULES, known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(RESULT rows of kinds finding and unencoded, clauses). df: (func, body) of bodies.bodies, values with their sort; annotated: (func, side, tag, term, shown).
    clauses: (func, side, tag, term, annotated, shown), the annotated among them, and a row of side `widened` for each member of a component given up on.

    Clauses travel up the whole call graph, callees before callers; only within a recursive component, where they may grow for ever, are there `rounds` rounds:
    one that still changes then is widened: it keeps no inferred clause. known: (func, their inferred clauses) of functions that needn't be analysed again; of these
    no rows are given."""
    from . import graph
    from .bodies import _schema

    run = _rows(budget, _schema(RESULT), rules, _kinds(df.schema["body"].dataType))
    names = ["func", *CLAUSES]
    calls = saved(static_calls(df), "calls")
    body = saved(texted(df), "bodies")
    clause = body.sparkSession.createDataFrame([], f"func string, {CLAUSE}")
    if annotated is not None:
        clause = saved(clause.unionByName(annotated.select("func", "side", "tag", "term", F.lit(True).alias("annotated"), "shown").distinct()), "annotated")

    if known is not None:
        clause = saved(clause.unionByName(known[1].select("func", *CLAUSES)), "known-clauses")

    def asked(these: DataFrame, clauses: DataFrame) -> DataFrame:
        return informed(these, calls, clauses)

    def inferred(these: DataFrame, clauses: DataFrame) -> DataFrame:
        got = asked(these, clauses).mapInArrow(run, RESULT).where("kind in ('requires', 'ensures')")
        return saved(got.select("func", F.col("kind").alias("side"), "tag", "term", F.lit(False).alias("annotated"), F.lit(None).cast("string").alias("shown")).distinct(), "clauses")

    edges = calls.select(F.col("func").alias("src"), F.col("callee").alias("dst"))
    comp, dag = graph.condensation(body.select(F.col("func").alias("node")), edges)
    comp = saved(comp, "components")
    depth = graph.wave_depth(comp, dag)
    level = saved(comp.join(depth, "scc").join(graph.scc_sizes(comp, edges), "scc").select(F.col("node").alias("func"), "scc", "depth", "recursive").join(body.select("func"), "func", "left_semi"), "levels")
    if known is not None:
        body = saved(body.join(known[0].select("func"), "func", "left_anti"), "bodies")
        level = level.join(body.select("func"), "func", "left_semi")
    body = saved(body.join(level.select("func", "depth"), "func"), "levelled-bodies")
    waves = level.groupBy("depth").agg(F.bool_or("recursive")).orderBy("depth").collect()
    for wave, (d, recursive) in enumerate(waves):
        here = level.where(F.col("depth") == d)
        these = body.where(F.col("depth") == d)
        before = clause
        for k in range(rounds + 1 if recursive else 1):
            got = inferred(these, clause)
            new = saved(got.join(clause, ["func", "side", "tag", "term", "annotated"], "left_anti"), "new-clauses") if recursive else got
            if not recursive:
                clause = clause.unionByName(new.select(*names))
                break
            if new.isEmpty():
                break
            if k == rounds:  # widen what still changes
                stuck = saved(level.join(new.select("func").distinct(), "func", "left_semi").where("recursive").select("scc").distinct().join(level, "scc").select("func"), "widened")
                kept = clause.join(stuck, "func", "left_anti").unionByName(before.join(stuck, "func", "left_semi"))
                clause = saved(kept.unionByName(stuck.selectExpr("func", "'widened' as side", "'' as tag", "'true' as term", "false as annotated", "cast(null as string) as shown")), "clauses")
                break
            clause = clause.unionByName(new.select(*names))
            again = calls.join(new.select(F.col("func").alias("callee")).distinct(), "callee").select("func").distinct()
            these = body.join(again.join(here.where("recursive"), "func", "left_semi"), "func", "left_semi")
        if wave % 8 == 7:  # else the plan grows with the depth
            clause = saved(clause, "clauses")
    return asked(body, clause).mapInArrow(run, RESULT).where("kind in ('finding', 'unencoded')"), clause


STORED = "key string, func string, kind string, row string"


def replayed(df: DataFrame, hashes: DataFrame, store, layer: str = "scc", **kw) -> DataFrame:
    """findings(df), where what a store has for a component with the same key - its members' bodies and those of all that they call are unchanged - is
    taken from there, and what it lacks is added. hashes: (func, hash) of bodies and their own annotations."""
    from ..plans import cache
    from . import graph

    calls = saved(static_calls(df), "calls")
    edges = calls.select(F.col("func").alias("src"), F.col("callee").alias("dst"))
    comp, dag = graph.condensation(df.select(F.col("func").alias("node")), edges)
    comp = saved(comp, "components")
    own = hashes.select(F.col("func").alias("node"), cache.key(F.col("func"), F.col("hash")).alias("hash"))  # equal bodies are entries of their own
    keys = cache.scc_keys(comp, dag, own)
    member = saved(comp.join(keys, "scc").select(F.col("node").alias("func"), "key").join(df.select("func"), "func", "left_semi"), "scc-members")
    have = store.rows(layer)
    listed = have.where("kind = 'member'").select("key", "func").distinct()
    whole = listed.groupBy("key").agg(F.sort_array(F.collect_set("func")).alias("a")).join(member.groupBy("key").agg(F.sort_array(F.collect_set("func")).alias("b")), "key").where("a = b").select("key")
    hit = saved(member.join(whole, "key", "left_semi"), "scc-hits")
    old = saved(have.join(hit.select("key").distinct(), "key", "left_semi").distinct(), "scc-stored")
    clause = old.where("kind = 'clause'").select("func", F.from_json("row", CLAUSE).alias("r")).select("func", "r.*")
    rows, clauses = analysed(df, known=(hit, clause), **kw)
    rows, clauses = saved(rows, "findings"), saved(clauses.where("not annotated").join(hit.select("func"), "func", "left_anti"), "clauses")
    fresh = member.join(hit.select("func"), "func", "left_anti")
    packed = lambda t, kind: t.join(fresh, "func").select("key", "func", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in t.columns if c != "func"])).alias("row"))
    new = fresh.select("key", "func", F.lit("member").alias("kind"), F.lit("").alias("row")).unionByName(packed(clauses, "clause")).unionByName(packed(rows, "finding"))
    store.add(new, layer)
    again = old.where("kind = 'finding'").select("func", F.from_json("row", RESULT.replace("func string, ", "")).alias("r")).select("func", "r.*")
    every = rows.unionByName(again.select(*rows.columns))
    return every.where("kind = 'finding'").withColumn("severity", severity()).select(*FINDING)


def questions(df: DataFrame, clauses: DataFrame) -> DataFrame:
    """func, checker, tag, line, query: what the nil and bounds checkers ask about bodies, as solver text, whatever the answer. clauses: of analysed."""
    from .bodies import _schema

    ddl = "file string, line int, col int, func string, checker string, tag string, query string"
    schema, kinds = _schema(ddl), _kinds(df.schema["body"].dataType)

    def ask(func: str, body: dict, callees: list[dict] | None, own: list[dict] | None) -> Iterator[tuple]:
        by, own = _read(callees, own)
        try:
            e = Encoded(body, {f: [(r["tag"], r["t"]) for r in rs if r["side"] == "ensures"] for f, rs in by.items()})
        except (OverflowError, RecursionError, T.SortError):
            return
        pre = [c["t"] for c in own if c["side"] == "requires"]
        for i, checker, tag, bad, values, known in e.violations():
            if all(map(e.ground, values)):
                yield None, i["line"], None, func, checker, tag, T.canonical([*e.asserts, e.guard(i["b"]), *pre, *known, bad])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for func, *texts in zip(*[b.column(i).to_pylist() for i in range(4)]):
                out += answers(("questions",), func, texts, kinds, ask, 0)
            yield columns(schema, out)

    return informed(df, static_calls(df), clauses).mapInArrow(run, ddl).select("func", "checker", "tag", "line", "query")


def severity(tag: str = "tag") -> F.Column:
    return F.when(F.col(tag) == UNVERIFIED, "warning").otherwise("error").alias("severity")


def findings(df: DataFrame, budget: int = 2000, rounds: int = 8, **kw) -> DataFrame:
    """FINDING columns of all confirmed violations; see analysed."""
    return analysed(df, budget, rounds, **kw)[0].where("kind = 'finding'").withColumn("severity", severity()).select(*FINDING)


def diagnostics(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """func, what: functions that have no formula (about which nothing is said), and members of components that were widened."""
    return rows.where("kind = 'unencoded'").select("func", F.concat(F.lit("not encoded: "), "message").alias("what")).unionByName(clauses.where("side = 'widened'").select("func", F.lit("widened").alias("what")))


# -- leaks, confirmed

LEAK_TAG = {"Send": "chan-send-leak", "Recv": "chan-recv-leak", "Select": "chan-select-leak"}


def full(e: Encoded, block: int, at: int, cap: int) -> tuple:
    """Before instruction `at` of a block, `cap` sends at least have gone to the same place: what its block and those on the way sent."""
    loc = next(e.loc(i["a0"]) for i in e.instrs if (i["b"], i["i"]) == (block, at))
    sends = lambda b, till=None: sum(i["op"] == "Send" and i["b"] == b and (till is None or i["i"] < till) and e.loc(i["a0"]) == loc for i in e.instrs)
    up, todo = {block}, [block]
    while todo:
        b = todo.pop()
        for p in range(e.graph.n):
            if b in e.dag[p] and p not in up:
                up.add(p)
                todo.append(p)
    pending = T.lit(32, sends(block, at))
    for b in sorted(up - {block}):
        if n := sends(b):
            pending = T.binary("bvadd", pending, T.ite(e.guard(b), T.lit(32, n), T.lit(32, 0)))
    return T.negation(T.binary("bvult", pending, T.lit(32, cap)))


def blocks_for_ever(c: dict, budget: int) -> bool:
    """Whether a candidate's spawner can reach its go while what is spawned can reach the operation (through the helper's call), a buffer being full by then.
    Each function is a frame with names of its own, under its own preconditions."""
    asserts: list[tuple] = []
    last = "callee" if c["helper"] is None else "helper"
    for frame, prefix, block in (("spawner", "", c["go_block"]), ("callee", "s_", c["op_block"] if last == "callee" else c["call_block"]), ("helper", "t_", c["op_block"])):
        x = c[f"{frame}_body"]
        if x is None:
            continue
        body, callees, own = x
        by, own = _read(callees, own)
        e = Encoded(body, {f: [(r["tag"], r["t"]) for r in rs if r["side"] == "ensures"] for f, rs in by.items()})
        more = [r["t"] for r in own if r["side"] == "requires"]
        if frame == last and c["cap"] is not None:
            more.append(full(e, block, c["op_instr"], c["cap"]))
        asserts += [T.prefixed(t, prefix) if prefix else t for t in (*e.asserts, e.guard(block), *more)]
    return T.check(asserts, budget)[0] == T.SAT


def leak_findings(df: DataFrame, candidates: DataFrame, clauses: DataFrame, budget: int = 2000) -> DataFrame:
    """FINDING rows of the candidates (bodies.leaks) that a query over their two or three functions confirms. clauses: of analysed."""
    from .bodies import _schema, leak_message

    types, frames = _kinds(df.schema["body"].dataType), ("spawner", "callee", "helper")
    rows = informed(df, static_calls(df), clauses).select("func", F.struct("body", "callees", "own").alias("x"))
    c = candidates.withColumn("message", leak_message())
    for frame in frames:
        c = c.join(rows.select(F.col("func").alias(frame), F.col("x").alias(f"{frame}_body")), frame, "left" if frame == "helper" else "inner")
    ddl = "func string, kind string, message string, file string, line int, col int, trace array<int>"
    schema = _schema(ddl)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for x in b.to_pylist():
                at = {k: x[k] for k in ("go_block", "op_block", "call_block", "op_instr", "cap")} | {"helper": x["helper"] and ""}

                def ask(_: str, *read, at: dict = at) -> Iterator[tuple]:
                    try:
                        yield (blocks_for_ever(at | {f"{f}_body": read[3 * k : 3 * k + 3] if read[3 * k] else None for k, f in enumerate(frames)}, budget),)
                    except (OverflowError, RecursionError, T.SortError):  # what can't be encoded is never reported
                        yield (False,)

                texts = [(x[f"{f}_body"] or {}).get(k) for f in frames for k in ("body", "callees", "own")]
                if not answers(("leak", budget, *at.values()), x["spawner"], texts, types * 3, ask)[0][0]:
                    continue
                out.append({"func": x["spawner"], "kind": x["kind"], "message": x["message"], "file": x["file"], "line": x["line"], "col": x["col"], "trace": [x["go_block"]]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = F.create_map(*[F.lit(v) for kv in LEAK_TAG.items() for v in kv])
    none = F.expr("cast(array() as array<struct<name: string, value: string>>)").alias("model")
    return c.mapInArrow(run, ddl).select(F.lit("goroutine-leak").alias("checker"), kinds[F.col("kind")].alias("tag"), "func", "message", "file", "line", "col", F.lit("error").alias("severity"), "trace", none)

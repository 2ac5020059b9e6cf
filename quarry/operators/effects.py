"""Effects: which channel and lock operations a function performs, and where.

Effects are kept in long form, one row per (function, domain, location, operation); joining two sets is a distinct union, so
Spark's partial aggregation does most of it before any shuffle. A location is an access path: a root (Param, FreeVar, Global,
Alloc, Unknown) and at most MAX_DEPTH fields; what would be longer becomes Unknown. Unknown has an empty root_id, never null,
so locations can be joined on.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

MAX_DEPTH = 2
COLUMNS = ["func", "domain", "root_kind", "root_id", "path", "op"]
EFFECT = "func string, domain string, root_kind string, root_id string, path array<int>, op string"
_ARROW = pa.schema([("func", pa.string()), ("domain", pa.string()), ("root_kind", pa.string()), ("root_id", pa.string()), ("path", pa.list_(pa.int32())), ("op", pa.string())])
#: Pairs of a function and an effect that a part may come to and still be worked off in a task, and rows that it gives at a time.
PAIRS, OUT = 10_000_000, 1 << 15
LOC = "struct<root_kind: string, root_id: string, path: array<int>>"
CHAN_OPS = ("Make", "Send", "Recv", "Close", "Select")
LOCK_OPS = ("Lock", "Unlock", "RLock", "RUnlock", "DeferredUnlock", "DeferredRUnlock")
SPAWNS = ("None", "Bounded", "Unbounded")

#: What can set free a goroutine blocked in the key.
UNBLOCK = {"Send": ("Recv", "Select", "Close"), "Recv": ("Send", "Select", "Close")}
#: For an arm of a select, whose own entry among the effects must not count as its counterpart.
UNBLOCK_ARM = {"Send": ("Recv", "Close"), "Recv": ("Send", "Close")}


def unknown() -> Column:
    return F.expr(f"cast(named_struct('root_kind', 'Unknown', 'root_id', '', 'path', array()) as {LOC})")


def capped(root_kind: Column, root_id: Column, path: Column) -> Column:
    loc = F.struct(root_kind.alias("root_kind"), root_id.alias("root_id"), path.alias("path"))
    return F.when(F.coalesce((root_kind == "Unknown") | (F.size(path) > MAX_DEPTH), F.lit(True)), unknown()).otherwise(loc)


def top(funcs: DataFrame) -> DataFrame:
    """The effects of functions (func) about which nothing is known: everything, somewhere."""
    every = [("chan", o) for o in CHAN_OPS] + [("lock", o) for o in LOCK_OPS] + [("spawn", "Unbounded")]
    ops = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(o).alias("op")) for d, o in every]))
    return funcs.select("func", ops.alias("x")).select("func", "x.domain", F.lit("Unknown").alias("root_kind"), F.lit("").alias("root_id"), F.expr("cast(array() as array<int>)").alias("path"), "x.op")


def join(*parts: DataFrame) -> DataFrame:
    """Union of effects; of spawns the greatest counts (see `spawns`)."""
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out.distinct()


def spawns(effects: DataFrame) -> DataFrame:
    """func, spawns: None < Bounded < Unbounded."""
    rank = F.when((F.col("domain") == "spawn") & (F.col("op") == "Unbounded"), 2).when(F.col("domain") == "spawn", 1).otherwise(0)
    return effects.groupBy("func").agg(F.max(rank).alias("r")).select("func", F.element_at(F.array(*map(F.lit, SPAWNS)), F.col("r") + 1).alias("spawns"))


def rebased(effects: DataFrame, sites: DataFrame) -> DataFrame:
    """Callees' effects as their callers see them. sites: (caller, callee, args, bindings), both arrays of locations in the
    caller; a parameter or captured variable without one is Unknown, as is what the callee allocates."""
    e, s = effects.alias("e"), sites.alias("s")
    at = F.expr("try_element_at(if(e.root_kind = 'Param', s.args, s.bindings), cast(e.root_id as int) + 1)")
    moved = e.where("root_kind in ('Param', 'FreeVar')").join(s, F.expr("e.func = s.callee")).select("s.caller", "e.domain", "e.op", at.alias("a"), F.col("e.path").alias("p"))
    loc = capped(F.col("a.root_kind"), F.col("a.root_id"), F.concat("a.path", "p"))
    first = moved.select(F.col("caller").alias("func"), "domain", "op", loc.alias("l"))
    fixed = e.where("root_kind not in ('Param', 'FreeVar')").join(s.select("caller", "callee").distinct().alias("s"), F.expr("e.func = s.callee"))
    kept = F.when(F.col("root_kind") == "Global", F.struct("root_kind", "root_id", "path")).otherwise(unknown())
    second = fixed.select(F.col("s.caller").alias("func"), "domain", "op", kept.alias("l"))
    return first.unionByName(second).select("func", "domain", "l.root_kind", "l.root_id", "l.path", "op").distinct()


def unplaced(call_edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites for callees that the call graph adds beyond the static sites: nothing is known about their arguments. A callee
    with a static site is left out, or its effects would come in twice, the second time all Unknown."""
    none = F.expr(f"cast(array() as array<{LOC}>)")
    return call_edges.select("caller", "callee").distinct().join(sites.select("caller", "callee").distinct(), ["caller", "callee"], "left_anti").select("caller", "callee", none.alias("args"), none.alias("bindings"))


def fixpoint(own: DataFrame, sites: DataFrame, calls: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The least effects that hold own and the rebased effects of all callees. Paths are capped, so it ends on any call graph, recursive ones too; nothing has to be
    widened. Weakly connected parts of the call graph are worked off where they lie; one that may hold more than `limit` pairs of function and effect goes by rounds of
    joins. calls: the (caller, callee) of the sites, where they are to be had in the order of their parts. A site without a caller or callee is none."""
    from . import graph

    s = sites.select("caller", "callee", "args", "bindings").where("caller is not null and callee is not null")
    at = graph.ends(graph.parted((s if calls is None else calls).select(F.col("caller").cast("string").alias("src"), F.col("callee").cast("string").alias("dst")))).distinct()
    o = own.select(*COLUMNS).where("func is not null").join(at.withColumnRenamed("node", "func"), "func", "left")
    o = o.select(F.coalesce("part", "func").alias("part"), "func", F.lit(None).cast("string").alias("callee"), F.to_json(F.struct(*COLUMNS[1:])).alias("x"))
    c = s.join(at.withColumnRenamed("node", "caller"), "caller", "left").select(F.coalesce("part", "caller").alias("part"), F.col("caller").alias("func"), "callee", F.to_json(F.struct("args", "bindings")).alias("x"))
    rows = saved(o.unionByName(c), "effect-parts")
    pairs = F.sum(F.when(F.col("callee").isNull(), 1).otherwise(0)) * F.sum(F.when(F.col("callee").isNull(), 0).otherwise(1))
    big = saved(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), pairs.alias("pairs")).where((F.col("pairs") > (PAIRS if limit is None else limit)) | (F.col("n") > graph.FUSED)).select("part"), "big-parts")
    nameless = own.select(*COLUMNS).where("func is null").distinct()
    if big.isEmpty():
        return graph.whole_parts(rows, _closed, EFFECT).unionByName(nameless)
    near, far = rows.join(big, "part", "left_anti"), rows.join(big, "part", "left_semi")
    e = far.where("callee is null").select("func", F.from_json("x", EFFECT.split(", ", 1)[1]).alias("r")).select("func", "r.*")
    t = far.where("callee is not null").select(F.col("func").alias("caller"), "callee", F.from_json("x", f"args array<{LOC}>, bindings array<{LOC}>").alias("r")).select("caller", "callee", "r.*")
    return graph.whole_parts(near, _closed, EFFECT).unionByName(_by_rounds(e, t)).unionByName(nameless)


def _by_rounds(own: DataFrame, sites: DataFrame) -> DataFrame:
    """fixpoint by joins, semi-naive: a round rebases only what is new."""
    s = saved(sites, "sites")
    delta = saved(own.select(*COLUMNS).distinct(), "effects")
    seen = delta
    while not delta.isEmpty():
        delta = saved(rebased(delta, s).join(seen, COLUMNS, "left_anti").select(*COLUMNS), "effects")
        seen = seen.unionByName(delta)
    return seen


class _Moved(dict):
    """Number of an effect as a caller sees it, by its number in the callee, at call sites of one kind; what is asked for first is worked out, as `rebased` does."""

    def __init__(self, keys: list[tuple], number: dict[tuple, int], site: dict) -> None:
        self.keys_, self.number, self.site = keys, number, site

    def __missing__(self, k: int) -> int | None:
        domain, kind, i, path, op = self.keys_[k]
        loc = ("Unknown", "", ())
        if kind is None:
            self[k] = None
            return None
        if kind in ("Param", "FreeVar"):
            args, n = self.site.get("args" if kind == "Param" else "bindings") or [], int(i)
            a = (args[n] if 0 <= n < len(args) else None) or {}
            base = a.get("path")
            if a.get("root_kind") not in (None, "Unknown") and base is not None and path is not None and len(base) + len(path) <= MAX_DEPTH:
                loc = (a["root_kind"], a.get("root_id"), (*base, *path))
        elif kind == "Global":
            loc = (kind, i, path)
        new = (domain, *loc, op)
        at = self[k] = self.number.setdefault(new, len(self.keys_))
        if at == len(self.keys_):
            self.keys_.append(new)
        return at


def _closed(bs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EFFECT rows of whole parts (part, func, callee, x): functions' effects as they are, and their call sites. Effects are numbered, each function's new ones go on to its
    callers, callees before callers as far as there is such an order."""
    t = pa.Table.from_batches(bs).combine_chunks()
    func, callee, x = (t.column(c).combine_chunks() for c in ("func", "callee", "x"))
    names = pa.concat_arrays([func, callee]).dictionary_encode()
    ids, text = names.indices.fill_null(-1).to_pylist(), x.dictionary_encode()
    read = [json.loads(v) for v in text.dictionary.to_pylist()]
    keys: list[tuple] = []
    number: dict[tuple, int] = {}
    effect: dict[int, int] = {}
    moved: dict[int, _Moved] = {}
    held: list[set] = [set() for _ in range(len(names.dictionary))]
    callers: dict[int, list] = defaultdict(list)
    calls: dict[int, list] = defaultdict(list)
    for f, c, r in zip(ids, ids[len(func) :], text.indices.to_pylist()):
        if c < 0:
            if r not in effect:
                e = read[r]
                path = e.get("path")
                key = (e.get("domain"), e.get("root_kind"), e.get("root_id"), None if path is None else tuple(path), e.get("op"))
                effect[r] = number.setdefault(key, len(keys))
                if effect[r] == len(keys):
                    keys.append(key)
            held[f].add(effect[r])
        else:
            if r not in moved:
                moved[r] = _Moved(keys, number, read[r])
            callers[c].append((f, moved[r]))
            calls[f].append(c)
    place, seen = [0] * len(held), set()
    n = 0
    for start in list(calls):
        todo = [(start, False)]
        while todo:
            f, after = todo.pop()
            if after:
                place[f], n = n, n + 1
            elif f not in seen:
                seen.add(f)
                todo.append((f, True))
                todo += [(c, False) for c in calls.get(f, ()) if c not in seen]
    at = {place[f]: f for f in seen}
    new = {f: set(held[f]) for f in seen if held[f]}
    waiting = [place[f] for f in new]
    heapify(waiting)
    while waiting:
        f = at[heappop(waiting)]
        delta = new.pop(f)
        for c, m in callers.get(f, ()):
            more = {m[k] for k in delta}
            more.discard(None)
            more -= held[c]
            if more:
                held[c] |= more
                if c in new:
                    new[c] |= more
                else:
                    new[c] = more
                    heappush(waiting, place[c])
    cols = [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(list(_ARROW)[1:])] if keys else []
    fs: list[int] = []
    ks: list[int] = []
    for f, h in enumerate(held):
        fs += [f] * len(h)
        ks += h
        if len(fs) >= OUT or f == len(held) - 1 and fs:
            i, k = pa.array(fs, pa.int32()), pa.array(ks, pa.int32())
            for j in range(0, len(fs), OUT):
                yield pa.RecordBatch.from_arrays([names.dictionary.take(i[j : j + OUT]), *[c.take(k[j : j + OUT]) for c in cols]], schema=_ARROW)
            fs, ks = [], []


# -- blocked for ever


def _able(spark, at: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(o, k) for k, ops in at.items() for o in ops], "op string, kind string")


def without_counterpart(candidates: DataFrame, effects: DataFrame, at_loc: dict | None = None, at_unknown: dict | None = None, key: str = "loc") -> DataFrame:
    """Candidates (func, loc, kind, ...) that no effect of the same function can unblock: neither one at the same location nor
    one at an unknown one (its root_kind is Unknown), which may be the same. effects: (func, loc, op, root_kind). Two anti joins on equal keys; the
    small operation tables are constants."""
    spark = candidates.sparkSession
    here = effects.join(F.broadcast(_able(spark, at_loc or UNBLOCK)), "op").select("func", key, "kind").distinct()
    anywhere = effects.where("root_kind = 'Unknown'").join(F.broadcast(_able(spark, at_unknown or UNBLOCK)), "op").select("func", "kind").distinct()
    return candidates.join(here, ["func", key, "kind"], "left_anti").join(anywhere, ["func", "kind"], "left_anti")


def arms_without_counterpart(arms: DataFrame, effects: DataFrame, key: str = "loc") -> DataFrame:
    """Like without_counterpart for arms of selects: at its own location another select doesn't count, at an unknown one it does."""
    return without_counterpart(arms, effects, UNBLOCK_ARM, UNBLOCK, key)


def blocked_selects(arms: DataFrame, effects: DataFrame, select: list[str], key: str = "loc") -> DataFrame:
    """Selects (the columns `select`) none of whose arms has a counterpart."""
    open_ = arms_without_counterpart(arms, effects, key).select(*select, F.lit(1).alias("open"))
    total = arms.groupBy(*select).agg(F.count(F.lit(1)).alias("arms"))
    return open_.groupBy(*select).agg(F.count(F.lit(1)).alias("blocked")).join(total, select).where("blocked = arms").select(*select)


def over_capacity(sends: DataFrame, caps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sends (numbered from 0 in each channel) that find the buffer full; caps has (keys, cap), a channel of unknown capacity is left alone."""
    n = Window.partitionBy(*keys).orderBy(*order)
    return sends.withColumn("ordinal", (F.row_number().over(n) - 1).cast("long")).join(caps, keys).where("ordinal >= cap")


def value_clean(dirty: DataFrame, funcs: DataFrame) -> DataFrame:
    """func, value_clean: no instruction of it is dirty, and it has a body. dirty: (func, dirty); funcs: (func, has_body)."""
    per = dirty.groupBy("func").agg(F.bool_or("dirty").alias("any_dirty"))
    return funcs.join(per, "func", "left").select("func", (F.col("has_body") & ~F.coalesce("any_dirty", F.lit(False))).alias("value_clean"))


def dirty(instr: DataFrame, value: DataFrame) -> DataFrame:
    """func, dirty, an instruction each: whether it may fail by a value. Memory other than the function's own allocations, elements, division, and
    conversions that change the kind of number or narrow it. value: (func, vid, sort)."""
    made = instr.where("op = 'Alloc'").select("func", F.col("dst").alias("a0"), F.lit(True).alias("local"))
    sort = lambda v, name: value.select("func", F.col("vid").alias(v), F.col("sort").alias(name))
    x = instr.select("func", "op", "sub", "a0", "dst").join(made, ["func", "a0"], "left").join(sort("a0", "from"), ["func", "a0"], "left").join(sort("dst", "to"), ["func", "dst"], "left")
    number = "^[suf][0-9]+$"
    bits = lambda c: F.substring(c, 2, 9).try_cast("int")
    keeps = F.col("from").rlike(number) & F.col("to").rlike(number) & (F.substring("from", 1, 1) == F.substring("to", 1, 1)) & (bits("from") <= bits("to"))
    rule = F.when(F.col("op").isin("Load", "Store", "FieldAddr"), F.col("local").isNull()).when(F.col("op").isin("IndexAddr", "Index", "Lookup", "Slice"), True)
    rule = rule.when(F.col("op") == "BinOp", F.col("sub").isin("Div", "Rem")).when(F.col("op") == "Convert", ~F.coalesce(keeps, F.lit(False)))
    return x.select("func", F.coalesce(rule, F.lit(False)).alias("dirty"))


def text(effects: DataFrame) -> DataFrame:
    """line: one per function, in the fixed form of a summary: spawns, then locations with their operations in declared order."""
    prefix = F.when(F.col("root_kind") == "Param", F.concat(F.lit("p"), "root_id")).when(F.col("root_kind") == "Global", F.concat(F.lit("g:"), "root_id"))
    prefix = prefix.when(F.col("root_kind") == "Alloc", F.concat(F.lit("alloc:"), "root_id")).when(F.col("root_kind") == "FreeVar", F.concat(F.lit("fv:"), "root_id")).otherwise("?")
    loc = F.concat(prefix, F.array_join(F.transform("path", lambda f: F.concat(F.lit(".f"), f.cast("string"))), ""))
    kind = F.create_map(*[F.lit(x) for k, v in (("Param", 0), ("Global", 1), ("Alloc", 2), ("FreeVar", 3), ("Unknown", 4)) for x in (k, v)])
    number = F.when(F.col("root_kind").isin("Param", "Alloc", "FreeVar"), F.col("root_id").cast("int")).otherwise(0)
    names = F.array(*map(F.lit, CHAN_OPS + LOCK_OPS))
    per = effects.where("domain <> 'spawn'").groupBy("func", "domain", kind[F.col("root_kind")].alias("k"), number.alias("n"), "root_id", "path", loc.alias("loc"))
    per = per.agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.array_position(names, F.col("op")))), lambda i: F.element_at(names, i.cast("int"))), ",").alias("ops"))
    both = per.groupBy("func").agg(*[F.sort_array(F.collect_list(F.when(F.col("domain") == d, F.struct("k", "n", "root_id", "path", F.concat("loc", F.lit(":["), "ops", F.lit("]")).alias("t"))))).alias(d) for d in ("chan", "lock")])
    flat = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["t"]), " "), F.lit(""))
    every = effects.select("func").distinct().join(spawns(effects), "func").join(both, "func", "left")
    return every.select("func", F.concat("func", F.lit(" effects={spawns:"), "spawns", F.lit(" chan:{"), flat("chan"), F.lit("} locks:{"), flat("lock"), F.lit("}}")).alias("line"))

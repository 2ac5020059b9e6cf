"""Graph operators over edge tables.

Reachability, components and depths never leave the executors. A graph falls into weakly connected parts: edges that lie together are contracted where they
lie, and what is left to be linked then by alternating stars, in a number of rounds that is logarithmic in its size. Parts are independent of each other, so one with `FUSED` edges at most is
worked off where it lies, many of them in a task, by the linear algorithm; for a greater one the same rows come
from loops of joins: each round joins only the rows that are new (the
frontier) and what a round produced is written to the shared folder, so lineage stays short and a lost
executor costs at most one round. Tests hold one against the other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import light, saved

#: Edges of a weakly connected part that a task holds: about 200 MB of Python objects.
FUSED = 500_000
#: Edges of small parts that a task works off at once.
STEP = 100_000


def call_graph(static: DataFrame, invoke: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of the three kinds of call."""
    pick = lambda df: df.select("caller", "callee")
    return pick(static).unionByName(pick(invoke)).unionByName(pick(dynamic)).distinct()


def address_taken(instr: DataFrame, value: DataFrame, keys: DataFrame) -> DataFrame:
    """skey, func of every function whose address some instruction takes: named as an operand, or bound by a closure.
    keys has (func, skey)."""
    refs = value.where("kind = 'Function'").select("func", "vid", F.col("ref_name").alias("target"))
    used = instr.where("op <> 'Call' or callee_kind <> 'Static'").select("func", F.explode("operands").alias("vid")).join(refs, ["func", "vid"]).select("target")
    closures = instr.where("op = 'MakeClosure'").select(F.col("callee").alias("target"))
    targets = used.unionByName(closures).where("target is not null").distinct()
    return targets.join(keys.select(F.col("func").alias("target"), "skey"), "target").select("skey", F.col("target").alias("func")).distinct()


def dynamic_targets(calls: DataFrame, taken: DataFrame) -> DataFrame:
    """caller, callee: a call through a value reaches every function of that structural signature whose address is taken.
    calls: (caller, skey)."""
    return calls.select("caller", "skey").distinct().join(taken.select("skey", F.col("func").alias("callee")).distinct(), "skey").select("caller", "callee")


def implementers(required: DataFrame, provided: DataFrame) -> DataFrame:
    """iface, impl: relational division. required has (iface, m), provided (impl, m), m being a method's name and signature.
    Candidates of an interface are the types that have its rarest method, so one that nearly every type has is never joined on alone; then the rest is
    counted. An interface without methods is not in the result: everything implements it."""
    req, have = light(required.select("iface", "m").distinct(), "required"), provided.select("impl", "m").distinct()
    often = have.join(req.select("m").distinct(), "m", "left_semi").groupBy("m").agg(F.count(F.lit(1)).alias("often"))
    rarest = light(req.join(often, "m", "left").groupBy("iface").agg(F.min_by("m", F.struct(F.coalesce("often", F.lit(0)), "m")).alias("m"), F.count(F.lit(1)).alias("need")), "rarest")
    some = have.join(rarest, "m").select("iface", "impl", "need")
    rest = light(req.join(rarest.select("iface", F.col("m").alias("rarest")), "iface").where("m <> rarest").select("iface", "m"), "required")
    found = some.where("need > 1").join(rest, "iface").join(have, ["impl", "m"]).groupBy("iface", "impl", "need").agg(F.count(F.lit(1)).alias("have"))
    return found.where("have = need - 1").select("iface", "impl").unionByName(some.where("need = 1").select("iface", "impl"))


def resolve_invokes(calls: DataFrame, methods: DataFrame, required: DataFrame) -> DataFrame:
    """caller, callee of calls through interfaces. calls: (caller, iface, name, skey), iface null for an anonymous one;
    methods: (type_id, name, skey, func), func null where abstract; required: (iface, name, skey). A candidate shares name and
    signature with the call; a named interface wants its whole method set from the candidate's type besides."""
    body = methods.where("func is not null")
    loose = calls.where("iface is null").join(body, ["name", "skey"]).select("caller", F.col("func").alias("callee"))
    m = F.struct("name", "skey")
    pairs = implementers(required.select("iface", m.alias("m")), methods.select(F.col("type_id").alias("impl"), m.alias("m")))
    strict = calls.where("iface is not null").join(body, ["name", "skey"]).join(pairs.withColumnRenamed("impl", "type_id"), ["iface", "type_id"]).select("caller", F.col("func").alias("callee"))
    return loose.unionByName(strict).distinct()


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of the nodes 0 to n - 1 each one's component's smallest node, by edges (u, v): roots are hung on smaller neighbours, then ways are shortened."""
    p = np.arange(n)
    while True:
        a, b = p[u], p[v]
        open_ = a != b
        if not open_.any():
            return p
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """src, dst, part: with each edge the smallest node of what the edges that lie beside it connect, `most` or somewhat more of them at a time. Rows stay where
    they are."""
    kind = dict(edges.dtypes)["src"]

    def solved(bs: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(bs).combine_chunks()
        src, dst = (t.column(i).combine_chunks() for i in (0, 1))
        coded = pa.concat_arrays([src, dst]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids = rank[coded.indices.to_numpy()]
        u, v = ids[: len(src)], ids[len(src) :]
        part = coded.dictionary.take(order.take(pa.array(roots(u, v, len(rank))[u])))
        return pa.RecordBatch.from_arrays([src, dst, part], ["src", "dst", "part"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= most:
                yield solved(held)
                held, n = [], 0
        if n:
            yield solved(held)

    return edges.select("src", "dst").where("src is not null and dst is not null").mapInArrow(run, f"src {kind}, dst {kind}, part {kind}")


def ends(parted: DataFrame) -> DataFrame:
    """node, part of both ends of edges (src, dst, part)."""
    return parted.select(F.explode(F.array("src", "dst")).alias("node"), "part")


def parted(edges: DataFrame, near: int | None = None) -> DataFrame:
    """src, dst, part (the smallest node of their weakly connected part) of edges (src, dst). What lies together is contracted first, without a shuffle, so only nodes that
    lie in several places are left to be linked: a few where edges come in the order of their parts, nearly all at worst. Links are contracted in one task if there
    are no more than it holds, by alternating stars otherwise."""
    near = FUSED if near is None else near
    e = saved(contracted(edges, near), "near-parts")
    several = ends(e).groupBy("node").agg(F.min("part").alias("v"), F.max("part").alias("m")).where("v <> m").select("node", "v")
    links = saved(ends(e).join(saved(several, "in-several"), "node").where("part <> v").select(F.col("part").alias("u"), "v").distinct(), "links")
    n = links.count()
    if not n:
        return e
    if n <= near:
        one = contracted(links.select(F.col("u").alias("src"), F.col("v").alias("dst")).repartition(1), near + 1)
        top = ends(one).distinct()
    else:
        top = _starred(links)
    return saved(e.join(saved(top, "part-roots").select(F.col("node").alias("part"), F.col("part").alias("root")), "part", "left").select("src", "dst", F.coalesce("root", "part").alias("part")), "parts")


def weak(edges: DataFrame, near: int | None = None) -> DataFrame:
    """node, part (its part's smallest node) for every node of an edge (src, dst)."""
    return ends(parted(edges, near)).distinct()


def _starred(links: DataFrame) -> DataFrame:
    """node, part for every node of links (u, v), u <> v. Alternating stars: each node's greater neighbours go to its smallest one,
    then each node to the smallest of all; the rounds are logarithmic, and equal sums of two rounds end them."""
    e = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        e = saved(large.join(least, "u").select(to.alias("x")).select("x.*").where("u <> v").distinct(), "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    tops = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(tops.select(F.col("v").alias("node"), F.col("v").alias("part")))


def divided(edges: DataFrame, fused: int) -> tuple[DataFrame, DataFrame, bool]:
    """Of edges (src, dst, part) those of the parts with `fused` edges at most, those of the others, and whether there are such."""
    big = saved(edges.groupBy("part").count().where(F.col("count") > fused).select("part"), "big-parts")
    if big.isEmpty():
        return edges, edges.where("false"), False
    return edges.join(big, "part", "left_anti"), edges.join(big, "part", "left_semi"), True


def fused(rows: DataFrame, solve: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """solve over the rows (part, ...) of some whole parts at a time, where they lie."""
    from .bodies import _schema

    out = _schema(schema)

    def solved(bs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(solve([r for b in bs for r in zip(*[b.column(i).to_pylist() for i in range(1, b.num_columns)])]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], f.type) for k, f in enumerate(out)], schema=out)

    return whole_parts(rows, solved, schema)


def whole_parts(rows: DataFrame, solved: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """solved over the batches of some whole parts (the first column) at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= STEP:
                last = b.column(0)[-1].as_py()
                cut = next((i + 1 for i in range(b.num_rows - 1, -1, -1) if b.column(0)[i].as_py() != last), 0)
                if cut or held[0].column(0)[0].as_py() != last and len(held) > 1 and held[-2].column(0)[-1].as_py() != last:
                    yield from solved([*held[:-1], b.slice(0, cut)] if cut else held[:-1])
                    held, n = [b.slice(cut)], b.num_rows - cut
        if n:
            yield from solved(held)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def reached(rows: list[tuple]) -> Iterator[tuple]:
    """Nodes reached; rows: edges (src, dst), and seeds as (seed, null)."""
    out, todo = defaultdict(list), []
    for a, b in rows:
        if b is None:
            todo.append(a)
        else:
            out[a].append(b)
    seen = set(todo)
    while todo:
        for b in out[todo.pop()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return ((n,) for n in seen)


def reach(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None, limit: int | None = None) -> DataFrame:
    """node: everything reachable from seeds (node), seeds included."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    s = seeds.select("node").where("node is not null").distinct()
    if max_rounds is not None:
        return _rounds(e.distinct(), saved(s, "seeds"), max_rounds)
    e = parted(e)
    small, big, any_big = divided(e, FUSED if limit is None else limit)
    kind = dict(s.dtypes)["node"]
    every = ends(e).withColumn("seed", F.lit(False)).unionByName(s.select("node", F.lit(None).cast(kind).alias("part"), F.lit(True).alias("seed")))
    own = saved(every.groupBy("node").agg(F.min("part").alias("part"), F.max("seed").alias("seed")).where("seed").select("node", "part"), "seeds")
    starts = own.where("part is not null").select("part", F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))
    if any_big:
        at = saved(big.select("part").distinct(), "big-parts")
        far = _rounds(big.select("src", "dst"), own.join(at, "part", "left_semi").select("node"))
        starts = starts.join(at, "part", "left_anti")
    near = fused(small.select("part", "src", "dst").unionByName(starts), reached, f"node {kind}")
    near = near.unionByName(own.where("part is null").select("node"))
    return near.unionByName(far) if any_big else near


def _rounds(e: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """reach by joins; what was seen is written anew every few rounds, so the plan stays short."""
    e = saved(e.select(F.col("src").alias("node"), F.col("dst").alias("to")), "reach-edges")
    frontier = seen = saved(seeds, "frontier")
    rounds = 0
    while not frontier.isEmpty() and (most is None or rounds < most):
        step = frontier.join(e, "node").select(F.col("to").alias("node")).distinct()
        frontier = saved(step.join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        rounds += 1
        if rounds % 4 == 0:
            seen = saved(seen, "seen")
    return seen


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def callers_closure(call_edges: DataFrame, seeds: DataFrame, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """func: seeds and all that call them, directly or not. Seeds that `known` (func) lacks are dropped."""
    s = seeds.select(F.col("func").alias("node"))
    if known is not None:
        s = s.join(known.select(F.col("func").alias("node")).distinct(), "node", "left_semi")
    return reach(call_edges, s, "callee", "caller", limit=limit).withColumnRenamed("node", "func")


def closure(edges: DataFrame, part: str | None = None) -> DataFrame:
    """(part,) src, dst for every path of one edge or more. Semi-naive: each round extends only what the round before found."""
    keys = [part] if part else []
    e = edges.select(*keys, "src", "dst").distinct()
    frontier = seen = saved(e, "paths")
    rounds = 0
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("dst", "mid").join(e.withColumnRenamed("src", "mid"), [*keys, "mid"]).select(*keys, "src", "dst").distinct()
        frontier = saved(step.join(seen, [*keys, "src", "dst"], "left_anti"), "paths")
        seen = seen.unionByName(frontier)
        rounds += 1
        if rounds % 4 == 0:
            seen = saved(seen, "paths")
    return seen


# -- strongly connected components


def tarjan(nodes, edges) -> dict:
    """node -> smallest node of its component; iterative."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    comp: dict = {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    comp.update(dict.fromkeys(members, least))
    return comp


def condensation(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, scc (its component's smallest node), part (its weakly connected part's)) of every node, and (src, dst, part) between different components, distinct."""
    e = parted(edges)
    kind = dict(e.dtypes)["src"]
    small, big, any_big = divided(e, FUSED if limit is None else limit)
    out = fused(small.select("part", "src", "dst", F.col("part").alias("own")), _condensed, f"node {kind}, scc {kind}, dst {kind}, part {kind}")
    if any_big:
        at = saved(ends(big).distinct(), "big-nodes")
        own = saved(scc_distributed(at.select("node"), saved(big.select("src", "dst").distinct(), "big-edges")).join(at, "node"), "big-scc")
        far = scc_edges(own, big.select("src", "dst")).join(own.select(F.col("node").alias("src"), "part"), "src")
        out = out.unionByName(own.withColumn("dst", F.lit(None).cast(kind))).unionByName(far.select(F.lit(None).cast(kind).alias("node"), F.col("src").alias("scc"), "dst", "part"))
    out = saved(out, "condensed")
    every = nodes.select("node").where("node is not null").distinct().join(out.where("dst is null").select("node", "scc", "part"), "node", "full")
    return every.select("node", F.coalesce("scc", "node").alias("scc"), F.coalesce("part", "node").alias("part")), out.where("dst is not null").select(F.col("scc").alias("src"), "dst", "part")


def _condensed(rows: list[tuple]) -> Iterator[tuple]:
    """(node, scc, null, part) of nodes, (null, scc, scc called, part) of calls; rows: (src, dst, part)."""
    part = {n: p for a, b, p in rows for n in (a, b)}
    comp = tarjan(sorted(part), [r[:2] for r in rows])
    for n, c in comp.items():
        yield n, c, None, part[n]
    for a, b in {(comp[r[0]], comp[r[1]]) for r in rows}:
        if a != b:
            yield None, a, b, part[a]


def condensed(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, scc, part of every node; see condensation."""
    return condensation(nodes, edges, limit)[0]


def scc(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, scc (its component's smallest node)."""
    return condensed(nodes, edges, limit).select("node", "scc")


def scc_distributed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Colouring: nodes without a way in or out are components of their own and go; then every node takes the smallest
    colour that reaches it, and of each colour what reaches its root backwards within the colour is a component."""
    done: list[DataFrame] = []
    left, e = nodes, edges.where("src <> dst")
    while not left.isEmpty():
        while True:  # trim
            core = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            core = saved(core, "core")
            alone = saved(left.join(core, "node", "left_anti"), "alone")
            if alone.isEmpty():
                break
            done.append(alone.select("node", F.col("node").alias("scc")))
            left = saved(left.join(core, "node", "left_semi"), "left")
            e = saved(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-edges")
        if left.isEmpty():
            break
        colour = saved(left.select("node", F.col("node").alias("c")), "colour")
        while True:
            pushed = e.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c").unionByName(colour)
            new = saved(pushed.groupBy("node").agg(F.min("c").alias("c")), "colour")
            if new.join(colour, ["node", "c"], "left_anti").isEmpty():
                break
            colour = new
        own = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        own = saved(own, "own-colour")
        roots = colour.where("node = c").select("node")
        back = saved(_rounds(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots).join(colour, "node").select("node", F.col("c").alias("scc")), "scc-found")
        done.append(back)
        left = saved(left.join(back, "node", "left_anti"), "left")
        e = saved(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-edges")
    return _union(done) if done else nodes.select("node", F.col("node").alias("scc"))


def scc_edges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst between different components, distinct."""
    a = components.select(F.col("node").alias("src"), F.col("scc").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def scc_sizes(components: DataFrame, edges: DataFrame) -> DataFrame:
    """scc, size, recursive (more than one member, or a member that calls itself)."""
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("self", F.lit(True))
    return components.join(loops, "node", "left").groupBy("scc").agg(F.count(F.lit(1)).alias("size"), ((F.count(F.lit(1)) > 1) | F.coalesce(F.bool_or("self"), F.lit(False))).alias("recursive"))


def wave_depth(components: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """scc, depth: 0 where nothing is called, else one more than the deepest component called. `edges` run from
    caller to callee between components (scc_edges). Those that come with their part (condensation) aren't parted again."""
    nodes = components.select("scc").distinct()
    e = edges if "part" in edges.columns else parted(edges)
    small, big, any_big = divided(e, FUSED if limit is None else limit)
    kind = dict(nodes.dtypes)["scc"]
    depth = fused(small.select("part", "src", "dst"), depths, f"scc {kind}, depth long")
    if any_big:
        depth = depth.unionByName(_peeled(saved(big.select("src", "dst"), "dag-edges")))
    return nodes.join(depth, "scc", "left").select("scc", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def _peeled(e: DataFrame) -> DataFrame:
    """A component's depth is the round in which its last callee goes."""
    left = e.select(F.col("src").alias("scc")).unionByName(e.select(F.col("dst").alias("scc"))).distinct()
    round_, parts = 0, []
    while not left.isEmpty():
        busy = e.select(F.col("src").alias("scc")).distinct()
        leaves = saved(left.join(busy, "scc", "left_anti").withColumn("depth", F.lit(round_).cast("long")), "wave")
        parts.append(leaves)
        left = saved(left.join(busy, "scc", "left_semi"), "dag-left")
        e = saved(e.join(leaves.select(F.col("scc").alias("dst")), "dst", "left_anti").select("src", "dst"), "dag-edges")
        round_ += 1
        if len(parts) == 16:
            parts = [saved(_union(parts), "waves")]
    return _union(parts)


def depths(edges: list[tuple]) -> Iterable[tuple]:
    calls, callers = defaultdict(set), defaultdict(set)
    for a, b in edges:
        calls[a].add(b)
        callers[b].add(a)
    every = set(calls) | set(callers)
    open_ = {n: len(calls[n]) for n in every}
    depth = dict.fromkeys(every, 0)
    ready = [n for n in every if open_[n] == 0]
    while ready:
        n = ready.pop()
        for c in callers[n]:
            depth[c] = max(depth[c], depth[n] + 1)
            open_[c] -= 1
            if open_[c] == 0:
                ready.append(c)
    return depth.items()


def dump(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """line: one per caller, its callees in order."""
    return edges.select(F.col(src).cast("string").alias("s"), F.col(dst).cast("string").alias("d")).distinct().groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("d")), ", ").alias("ds")).select(F.concat("s", F.lit(" -> "), "ds").alias("line"))

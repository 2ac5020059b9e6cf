"""Control-flow graphs: one small graph per function, many functions.

The order of a depth-first search is part of these operators' meaning, so they run function by function in Arrow
batches; all functions are independent, and a function's edges meet in one task through a single aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "{key}, b long, reachable boolean, cyclic boolean, idom long, topo int, dominators array<long>, ancestors array<long>"


class Graph:
    """blocks 0..n-1; succs in order. Edges to blocks that don't exist are dropped."""

    def __init__(self, n: int, edges: list[tuple[int, int]]) -> None:
        self.n = n
        self.succs: list[list[int]] = [[] for _ in range(n)]
        for a, b in edges:
            if 0 <= a < n and 0 <= b < n:
                self.succs[a].append(b)

    def cut(self) -> tuple[list[list[int]], list[bool]]:
        """(successors without edges to a block on the search's stack, what the entry reaches)."""
        dag: list[list[int]] = [[] for _ in range(self.n)]
        seen, on = [False] * self.n, [False] * self.n
        if not self.n:
            return dag, seen
        stack = [(0, iter(self.succs[0]))]
        seen[0] = on[0] = True
        while stack:
            a, it = stack[-1]
            b = next(it, None)
            if b is None:
                on[a] = False
                stack.pop()
            elif not on[b]:
                dag[a].append(b)
                if not seen[b]:
                    seen[b] = on[b] = True
                    stack.append((b, iter(self.succs[b])))
        return dag, seen

    def cyclic(self) -> list[bool]:
        """Blocks that reach themselves."""
        out = []
        for s in range(self.n):
            seen: set[int] = set()
            todo = list(self.succs[s])
            while todo and s not in seen:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += self.succs[b]
            out.append(s in seen)
        return out


def topological(dag: list[list[int]], entry: int = 0) -> list[int]:
    """Reverse postorder of what entry reaches."""
    if not dag:
        return []
    order, seen = [], {entry}
    stack = [(entry, iter(dag[entry]))]
    while stack:
        a, it = stack[-1]
        b = next(it, None)
        if b is None:
            order.append(a)
            stack.pop()
        elif b not in seen:
            seen.add(b)
            stack.append((b, iter(dag[b])))
    return order[::-1]


def immediate_dominators(dag: list[list[int]]) -> list[int | None]:
    """idom of each block; the entry's is itself, an unreachable block has none. One pass in topological order is enough on a DAG."""
    order = topological(dag)
    at = {b: i for i, b in enumerate(order)}
    preds: dict[int, list[int]] = {b: [] for b in order}
    for a in order:
        for b in dag[a]:
            preds[b].append(a)
    idom: list[int | None] = [None] * len(dag)
    for b in order:
        if b == 0:
            idom[0] = 0
            continue
        best = preds[b][0]
        for p in preds[b][1:]:
            while best != p:
                if at[best] > at[p]:
                    best = idom[best]
                else:
                    p = idom[p]
        idom[b] = best
    return idom


def strictly_dominates(idom: list[int | None], a: int, b: int) -> bool:
    """Whether a lies above b on b's chain of dominators. False for blocks without one."""
    if a == b or not (0 <= a < len(idom) and 0 <= b < len(idom)) or idom[b] is None:
        return False
    steps = 0
    while b != idom[b] and steps <= len(idom):
        b, steps = idom[b], steps + 1
        if b == a:
            return True
    return False


def chain(idom: list[int | None], b: int) -> list[int]:
    """All dominators of b, itself first."""
    if idom[b] is None:
        return []
    out = [b]
    while idom[out[-1]] != out[-1]:
        out.append(idom[out[-1]])
    return out


def strict_ancestors(dag: list[list[int]]) -> list[set[int]]:
    """For each block the other blocks that reach it."""
    preds: list[list[int]] = [[] for _ in dag]
    for a, bs in enumerate(dag):
        for b in bs:
            preds[b].append(a)
    out = []
    for s in range(len(dag)):
        seen: set[int] = set()
        todo = list(preds[s])
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += preds[a]
        out.append(seen - {s})
    return out


def violating_path(dag: list[list[int]], guards: dict[int, bool], entry: int = 0) -> list[int]:
    """From entry, always the first successor whose guard holds."""
    out, at = [entry], entry
    while (at := next((b for b in dag[at] if guards.get(b)), None)) is not None:
        out.append(at)
    return out


def analysed(blocks: DataFrame, edges: DataFrame, key: str = "func", only: tuple[str, ...] = ("cyclic", "idom", "topo", "dominators", "ancestors")) -> DataFrame:
    """Per (key, b): reachable, cyclic, idom, topo (place in topological order), dominators (b's chain) and ancestors
    after back edges are cut. blocks: (key, b), the least b being the entry; edges: (key, src, dst, succ_pos). Columns that `only` leaves out are null and cost nothing."""
    kind = dict(blocks.dtypes)[key]
    es = edges.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col("src").cast("long").alias("src"), F.col("succ_pos").cast("long").alias("pos"), F.col("dst").cast("long").alias("dst")))).alias("es"))
    one = blocks.groupBy(key).agg(F.sort_array(F.collect_set(F.col("b").cast("long"))).alias("bs")).join(es, key, "left").select(key, "bs", "es")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[] for _ in range(8)]
            for k, bs, es_ in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                at = {b: i for i, b in enumerate(bs)}
                g = Graph(len(bs), [(at.get(e["src"], -1), at.get(e["dst"], -1)) for e in es_ or []])
                dag, seen = g.cut()
                cyclic = g.cyclic() if "cyclic" in only else [None] * len(bs)
                idom = immediate_dominators(dag) if {"idom", "dominators"} & set(only) else [None] * len(bs)
                anc = strict_ancestors(dag) if "ancestors" in only else None
                place = {b: i for i, b in enumerate(topological(dag))} if "topo" in only else {}
                for i, b in enumerate(bs):
                    doms = sorted(bs[x] for x in chain(idom, i)) if "dominators" in only else None
                    row = (k, b, seen[i], cyclic[i], None if idom[i] is None else bs[idom[i]], place.get(i), doms, anc and sorted(bs[x] for x in anc[i]))
                    for c, v in zip(cols, row):
                        c.append(v)
            ints = pa.list_(pa.int64())
            types = (batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), ints, ints)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [key, "b", "reachable", "cyclic", "idom", "topo", "dominators", "ancestors"])

    return one.mapInArrow(run, SHAPE.format(key=f"{key} {kind}"))


def dominance(shape: DataFrame, key: str = "func") -> DataFrame:
    """(key, a, b): a strictly dominates b."""
    return shape.select(key, F.explode("dominators").alias("a"), "b").where("a <> b")


def ancestry(shape: DataFrame, key: str = "func") -> DataFrame:
    """(key, a, b): a reaches b in the acyclic graph."""
    return shape.select(key, F.explode("ancestors").alias("a"), "b")


def ordered(shape: DataFrame, key: str = "func") -> DataFrame:
    """(key, b, place): reachable blocks in topological order."""
    return shape.where("topo is not null").select(key, "b", F.col("topo").cast("long").alias("place"))

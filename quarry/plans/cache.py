"""Content-keyed results: what was computed for the same input is not computed again.

A store is a Parquet folder per layer, partitioned by the first digit of the key. Anything that can't be read counts as
absent; new rows are written beside the old ones in one atomic job.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

SALT = "quarry-scc-1"


def field(c: Column) -> Column:
    """A field with its length before it, so that joined fields can't be mistaken for others."""
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def key(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def query_key(text: Column, solver: str, limit: int) -> Column:
    """Of a solver query: its canonical text, the solver and the effort it was allowed."""
    return key(F.lit(solver), F.lit(str(limit)), text)


def scc_keys(components: DataFrame, dag: DataFrame, hashes: DataFrame, salt: str = SALT, limit: int | None = None) -> DataFrame:
    """scc, key: hash of the members' hashes and of the keys of all components called, so a change reaches exactly its component and
    those above. components (node, scc[, part]), dag (src calls dst), hashes (node, hash). Components of a small part are keyed where they lie; those of a part
    with more than `limit` calls bottom up, a round per level."""
    from ..operators import graph

    whole = "part" in components.columns and "part" in dag.columns
    e = dag if whole else graph.parted(dag)
    hs = F.sort_array(F.collect_list(F.coalesce("hash", F.lit("-")))).alias("hs")
    own = components.join(hashes, "node", "left").groupBy("scc").agg(hs, *([F.min("part").alias("part")] if whole else []))
    if not whole:
        own = own.join(graph.ends(e).distinct().withColumnRenamed("node", "scc"), "scc", "left")
    small, big, any_big = graph.divided(e, graph.FUSED if limit is None else limit)
    if any_big:
        own = saved(own, "scc-own")
    flat = own.select(F.coalesce("part", "scc").alias("part"), "scc", F.array_join("hs", ",").alias("hs"))
    kind = dict(own.dtypes)["scc"]
    rows = small.select("part", F.col("src").alias("scc"), F.col("dst"), F.lit(None).cast("string").alias("hs"))
    if any_big:
        at = saved(big.select("part").distinct(), "big-parts")
        left = own.join(at, "part", "left_semi").select("scc", "hs")
        far = _keys_by_rounds(saved(left, "scc-own"), saved(big.select("src", "dst").distinct(), "scc-dag"), salt)
        flat = flat.join(at, "part", "left_anti")
    rows = rows.unionByName(flat.select("part", "scc", F.lit(None).cast(kind).alias("dst"), "hs"))
    near = graph.fused(rows, lambda rs: _keyed(rs, salt), f"scc {kind}, key string")
    return near.unionByName(far) if any_big else near


def _keyed(rows: list[tuple], salt: str) -> list[tuple]:
    """(scc, key) of whole parts; rows: (scc, callee, null) and (scc, null, hashes). What is circular has no key."""
    calls, hashes = {}, {}
    for s, dst, hs in rows:
        if dst is None:
            hashes[s] = hs
        else:
            calls.setdefault(s, set()).add(dst)
    done: dict = {}
    text = lambda s: f"{len(s.encode())}:{s}"
    todo = [(s, False) for s in hashes]
    entered: set = set()
    while todo:
        s, after = todo.pop()
        if after:
            ks = [done.get(c) for c in calls.get(s, ())]
            if None not in ks:
                done[s] = hashlib.sha256("".join(map(text, (salt, hashes[s], ",".join(sorted(ks))))).encode()).hexdigest()
        elif s not in entered:
            entered.add(s)
            todo.append((s, True))
            todo += [(c, False) for c in calls.get(s, ()) if c not in entered]
    return list(done.items())


def _keys_by_rounds(own: DataFrame, e: DataFrame, salt: str) -> DataFrame:
    need = e.groupBy("src").agg(F.count(F.lit(1)).alias("need"))
    left = saved(own.join(need.withColumnRenamed("src", "scc"), "scc", "left").select("scc", "hs", F.coalesce("need", F.lit(0)).alias("need")), "scc-left")
    made = lambda hs, ks: key(F.lit(salt), F.array_join(hs, ","), F.array_join(ks, ","))
    new = out = saved(left.where("need = 0").select("scc", made(F.col("hs"), F.expr("cast(array() as array<string>)")).alias("key")), "scc-keys")
    got, left, rounds = None, left.where("need > 0"), 0
    while not new.isEmpty():
        fresh = e.join(new.withColumnRenamed("scc", "dst"), "dst").select(F.col("src").alias("scc"), "key")
        got = saved(fresh if got is None else got.join(new.select("scc"), "scc", "left_anti").unionByName(fresh), "scc-got")
        ready = got.groupBy("scc").agg(F.sort_array(F.collect_list("key")).alias("ks")).join(left, "scc").where("size(ks) = need")
        new = saved(ready.select("scc", made(F.col("hs"), F.col("ks")).alias("key")), "scc-keys")
        out, rounds = out.unionByName(new), rounds + 1
        if rounds % 8 == 0:
            out = saved(out, "scc-keys")
    return out


def package_keys(packages: DataFrame, files: DataFrame, deps: DataFrame, tool: str) -> DataFrame:
    """pkg, key of packages, by their files' hashes and their dependencies' keys. Raises ValueError for a dependency that is
    missing or circular. packages (pkg), files (pkg, path, sha256), deps (pkg, dep)."""
    known = packages.select("pkg").distinct()
    if not deps.select(F.col("dep").alias("pkg")).join(known, "pkg", "left_anti").isEmpty():
        raise ValueError("a dependency is missing")
    per = files.groupBy("pkg").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "path", "sha256"))), ";").alias("hash"))
    hashes = known.join(per, "pkg", "left").select(F.col("pkg").alias("node"), key(F.lit(tool), F.col("pkg"), F.coalesce("hash", F.lit(""))).alias("hash"))
    nodes = known.select(F.col("pkg").alias("node"), F.col("pkg").alias("scc"))
    out = scc_keys(nodes, deps.select(F.col("pkg").alias("src"), F.col("dep").alias("dst")).distinct(), hashes, "quarry-package-1")
    out = saved(out, "package-keys")
    if out.count() < known.count():
        raise ValueError("dependencies are circular")
    return out.select(F.col("scc").alias("pkg"), "key")


class Store:
    """Rows by key, under folder/layer."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def rows(self, layer: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, shard string").option("ignoreCorruptFiles", "true").parquet(f"{self.folder}/{layer}").drop("shard")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def split(self, wanted: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
        """(wanted rows with what is stored for their key, wanted rows that nothing is stored for)."""
        have = self.rows(layer).dropDuplicates(["key"])
        return wanted.join(have, "key"), wanted.join(have.select("key"), "key", "left_anti")

    def add(self, rows: DataFrame, layer: str) -> None:
        rows.withColumn("shard", F.substring("key", 1, 1)).write.mode("append").partitionBy("shard").parquet(f"{self.folder}/{layer}")

    def stats(self, layers: list[str]) -> DataFrame:
        """layer, entries, bytes."""
        out = None
        for layer in layers:
            try:
                size = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{layer}").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
            except AnalysisException:
                size = self.spark.createDataFrame([(0,)], "bytes long")
            one = self.rows(layer).agg(F.count(F.lit(1)).alias("entries")).crossJoin(size).select(F.lit(layer).alias("layer"), "entries", "bytes")
            out = one if out is None else out.unionByName(one)
        return out


def enabled(writes_queries: bool, checkers: int) -> bool:
    """Results are reused only where something is computed and nobody wants to see the queries themselves."""
    return not writes_queries and checkers > 0

"""SimHash near-dedup by anchor-point covering.

A document's fingerprint has 256 bits: the majority, over its distinct normalised words, of the bits of
each word's hash. Two documents are near copies when at most `max_bits` bits differ.

Search. Blocks of the fingerprint's bits are searched each by itself. A block has a first part, by which fingerprints are brought together, and
second parts, by which those that share an anchor of the first are looked up. The anchors of a part are the codewords of a perfect code; a fingerprint
has its home, the anchor whose cell it lies in, and is replicated to anchors within covering radius plus threshold. Per pair of anchors, homes are
compared with replicas over all 256 bits, exactly.

`DESIGN` is used for every input, whatever its size. Its code is the trivial one (every point is an anchor, radius and threshold 0): the bits in some order are cut into 23 parts
of 11, each of them the first part of a block whose second parts are the eleven that follow it, in a circle, so each two of the 23 are an anchor of 22 bits just once.
That is done for three orders of the bits: 69 rows a fingerprint, 759 lookups that shuffle nothing. `SHORT` and `LONG` have Hamming codes (Hamming(15,11) x
Hamming(7,4), and Hamming(15,11) twice) with a threshold of 1 bit in either part. They need 121 and 512 rows a fingerprint, and the anchors of `SHORT`, 2**15 a block, grow
crowded with the input.

What is certain and what is not: fingerprints that differ in fewer than 22 bits leave two of 23 disjoint parts alike, so they always meet. An exact
covering of 256 bits with radius `max_bits` would need astronomically many anchors; pairs between 22 and `max_bits` bits apart meet with a high
probability only (tests hold it above 0.99 at the limit itself, where it is least). Which pairs meet depends on the two fingerprints alone.

An anchor's points are streamed in the order of anchors, so a task holds those of one anchor and some more. Where many homes share a key,
they are not paired with each other: each is compared with a pivot first, linked to it alone, and only what isn't near the pivot is compared with the
pivot's members. The links, fewer than all pairs, join the same documents. Equal fingerprints are one point, so thousands of copies cost one.

Groups are connected components (alternating large and small stars); one document of each group,
the one with the smallest doc_id, stays.

Edge cases: a null text belongs to no group and stays; texts without any word are near copies only when equal
(all empty texts are one group); a row with a null doc_id is never dropped and has no group; of rows that
repeat doc_id and text one stays; an empty table gives no rows; extra columns pass.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import docs_only, hidden, joined, saved, text_udf

BITS = 256
MAX_BITS = 42
#: Homes of a key up to which all pairs are compared.
HOT = 64
#: Rows of an anchor's stream worked off at once.
STEP = 100_000
_LONGS = ["f0", "f1", "f2", "f3"]
#: The eight bits of a byte as the eight bytes of a word, which is how they are counted.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, 4) of uint64."""
    s, e, first = vec.words(data, off, True)
    h = vec.word_hashes(data, s, e)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    n = np.bincount(doc, minlength=len(off) - 1)
    out = np.zeros((len(off) - 1, BITS // 64), np.uint64)
    has = np.flatnonzero(n)
    at = np.concatenate([[0], np.cumsum(n)])
    step = 1 << 14
    for a in range(0, len(has), 256):  # some documents at a time, long ones in pieces: memory stays flat
        rows = has[a : a + 256]
        lo, hi = at[rows[0]], at[rows[-1] + 1]
        ones = np.zeros((len(rows), BITS), np.int32)
        for x in range(lo, hi, step):
            y = min(hi, x + step)
            spread = _LANES[np.stack([vec.mix(h[x:y] ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(BITS // 64)], 1).view(np.uint8)]
            begin = np.clip(at[rows], x, y) - x
            end = np.clip(at[rows + 1], x, y) - x
            hit = np.flatnonzero(end > begin)
            runs = -(-(end[hit] - begin[hit]) // 255)  # so many words at most are counted in a byte
            own = np.cumsum(runs) - runs
            first = np.repeat(begin[hit], runs) + 255 * (np.arange(runs.sum()) - np.repeat(own, runs))
            counts = np.add.reduceat(spread, first, axis=0).view(np.uint8)
            ones[hit] += np.add.reduceat(counts, own, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > n[rows][:, None], axis=1).view(np.uint64)
    none = np.flatnonzero(n == 0)
    if len(none):  # no words: the text itself decides
        own = vec.word_hashes(data, off[none], off[none + 1])
        for k in range(BITS // 64):
            out[none, k] = vec.mix(own ^ np.uint64((k + 9) * 0x9E3779B97F4A7C15 % 2**64))
    return out


def _udf(v: pa.Array) -> pa.Array:
    f = fingerprints(*vec.buffers(vec.lower(v))).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(f[:, k]) for k in range(4)], _LONGS)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, th, f0..f3, node (a 64-bit name of the fingerprint), for rows that have a text."""
    f = text_udf(_udf, "struct<f0: bigint, f1: bigint, f2: bigint, f3: bigint>")
    df = docs_only(docs, "doc_id", "text").where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), f("text").alias("f"))
    return df.select("doc_id", "th", "f.*").withColumn("node", F.xxhash64(*_LONGS))


def _near(n: int, r: int) -> np.ndarray:
    """For each n-bit point the home codeword and those at distance 2 of the perfect Hamming code."""
    x = np.arange(1 << n)
    syn = np.zeros(1 << n, np.int64)
    for i in range(n):
        syn ^= np.where(x >> i & 1, i + 1, 0)
    home = np.where(syn > 0, x ^ (1 << np.maximum(syn - 1, 0)), x)
    out = np.full((1 << n, (n + 1) // 2), -1, np.int64)
    out[:, 0] = home
    filled = np.ones(1 << n, np.int64)
    for i in range(n):
        for j in range(i + 1, n):
            hit = np.flatnonzero((syn > 0) & (syn == ((i + 1) ^ (j + 1))))
            out[hit, filled[hit]] = x[hit] ^ (1 << i) ^ (1 << j)
            filled[hit] += 1
    return out


@functools.cache
def near(n: int) -> np.ndarray:
    """Anchors that each n-bit point reaches, its home first: of the Hamming code, or where n bits have none of the trivial one."""
    return _near(n, n.bit_length()) if not trivial(n) else np.arange(1 << n)[:, None]


def trivial(n: int) -> bool:
    return (n & (n + 1)) != 0


@dataclass(frozen=True)
class Design:
    """parts: bits of a block's first and second parts; count: blocks; seconds: second parts of each block."""

    parts: tuple[int, int]
    count: int
    seconds: int = 1

    @functools.cached_property
    def blocks(self) -> list[np.ndarray]:
        """The bits of each block, the first part before the second ones."""
        w, out, rng = self.parts[0] if self.seconds > 1 else sum(self.parts), [], np.random.default_rng(256)
        order = np.arange(BITS)
        while len(out) < self.count:
            cut = [order[k : k + w] for k in range(0, BITS - w + 1, w)]
            out += cut if self.seconds == 1 else [np.concatenate([cut[(k + i) % len(cut)] for i in range(self.seconds + 1)]) for k in range(len(cut))]
            order = rng.permutation(BITS)
        return out[: self.count]

    @property
    def exact(self) -> bool:
        return all(map(trivial, self.parts))

    def points(self, f: np.ndarray, block: int, seconds: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The first part of a block of each fingerprint, and (fingerprints, seconds) of the second ones, in pieces so that memory stays flat."""
        at, (m, n) = self.blocks[block], self.parts
        p, q = np.empty(len(f), np.int64), np.empty((len(f), self.seconds if seconds else 0), np.int16)
        for c in range(0, len(f), 20_000):
            words = np.ascontiguousarray(f[c : c + 20_000].T)
            p[c : c + 20_000] = packed(words, at[:m])
            for t in range(q.shape[1]):
                q[c : c + 20_000, t] = packed(words, at[m + t * n : m + (t + 1) * n])
        return p, q


def packed(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for the bits `at` (counted as numpy unpacks them) of fingerprints, four rows of words; the first one is the lowest."""
    out = np.zeros(words.shape[1], np.uint64)
    for j, i in enumerate(at.tolist()):
        x = words[i >> 6] >> np.uint64((i & 56) + 7 - (i & 7))
        x &= np.uint64(1)
        x <<= np.uint64(j)
        out |= x
    return out


SHORT, LONG = Design((15, 7), 16), Design((15, 15), 64)
#: The one in use, for all inputs.
DESIGN = Design((11, 11), 69, 11)


def replicas(how: Design):
    """A row per (block, anchor of the first part) that a fingerprint reaches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = near(how.parts[0])
        for batch in it:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                f = np.stack([np.asarray(b.column(c)).view(np.uint64) for c in _LONGS], 1)
                node = np.asarray(b.column("node"))
                for k in range(how.count):
                    p, _ = how.points(f, k, False)
                    row, col = np.nonzero(first[p] >= 0)
                    key = (k << 15) | first[p][row, col]
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(node[row]), *[pa.array(f[row, c].view(np.int64)) for c in range(4)]], ["anchor", "node", *_LONGS])

    return run


def apart(f: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs x[i], y[i] those that differ in at most `most` bits, and in how many."""
    d = np.zeros(len(x), np.int64)
    for k in range(4):
        d += np.bitwise_count(f[x, k] ^ f[y, k])
        if k:
            ok = d <= most
            x, y, d = x[ok], y[ok], d[ok]
    return x, y, d


def linked(f: np.ndarray, homes: np.ndarray, others: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between homes and others (homes among them) that connect what all near pairs between them would."""
    alive, few = homes, 1
    while len(alive):
        if few > 1:  # the last pivots had hardly a member: some at once, all their pairs
            p = alive[:few]
            for c in range(0, len(others), step := max(1, STEP // len(p))):
                part = others[c : c + step]
                yield (got := apart(f, np.repeat(p, len(part)), np.tile(part, len(p)), most))
                few = few if len(got[1]) <= 4 * len(p) else 1
            alive, others = alive[len(p) :], np.setdiff1d(others, p)
            few = min(2 * few, 64) if few > 1 else 1
            continue
        p = np.full(1, alive[0])
        member = apart(f, np.repeat(p, len(alive)), alive, most)[1]
        yield (got := apart(f, np.repeat(p, len(others)), others, most))
        rest = np.setdiff1d(others, got[1])
        for m in np.setdiff1d(member, p):  # what isn't near the pivot may be near a member; one link will do
            if not len(rest):
                break
            for c in range(0, len(rest), STEP):
                got = apart(f, np.full(len(rest[c : c + STEP]), m), rest[c : c + STEP], most)
                if len(got[1]):
                    yield got
                    rest = np.concatenate([rest[:c], np.setdiff1d(rest[c : c + STEP], got[1]), rest[c + STEP :]]) if len(rest) > STEP else np.setdiff1d(rest, got[1])
        alive, others = np.setdiff1d(alive, member), np.setdiff1d(others, member)  # what is near a member has its link
        few = 2 if len(member) <= 4 else 1


def compared(how: Design, f: np.ndarray, node: np.ndarray, anchor: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, bits) of near rows, homes with replicas, of whole anchors."""
    n2 = how.parts[1]
    first, second = near(how.parts[0]), near(n2)
    p, q = np.zeros(len(node), np.int64), np.zeros((len(node), how.seconds), np.int16)
    for k in np.unique(anchor >> 15):
        at = np.flatnonzero(anchor >> 15 == k)
        p[at], q[at] = how.points(f[at], int(k))
    at_home = first[p, 0] == anchor & 0x7FFF
    for t in range(how.seconds):
        for x, y, d in _met(f, node, anchor, at_home, q[:, t], second, n2, most):
            if how.exact and t and len(x):  # found before, by an earlier second part
                new = ~(q[x, :t] == q[y, :t]).any(1)
                x, y, d = x[new], y[new], d[new]
            yield x, y, d


def _met(f: np.ndarray, node: np.ndarray, anchor: np.ndarray, at_home: np.ndarray, q: np.ndarray, second: np.ndarray, n2: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same by one second part."""
    full = (anchor << n2) | second[q, 0]
    x = np.flatnonzero(at_home)
    x = x[np.argsort(full[x], kind="stable")]
    xkey = full[x]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(xkey)), bool), xkey[1:] != xkey[:-1]]))
    if not len(start):
        return
    size, keys = np.diff(np.append(start, len(xkey))), xkey[start]
    away = np.flatnonzero(~at_home)
    ys, ykeys = [away], [full[away]]
    for c in range(1, second.shape[1]):
        more = np.flatnonzero(at_home & (second[q, c] >= 0))
        ys.append(more)
        ykeys.append((anchor[more] << n2) | second[q[more], c])
    y, ykey = np.concatenate(ys), np.concatenate(ykeys)
    run = np.minimum(np.searchsorted(keys, ykey), len(keys) - 1)
    has = keys[run] == ykey
    y, run = y[has], run[has]
    own = np.repeat(np.arange(len(start)), size)
    for g in np.flatnonzero(size > HOT):
        homes = x[start[g] : start[g] + size[g]]
        yield from linked(f, homes, np.unique(np.concatenate([homes, y[run == g]])) if len(y) else np.sort(homes), most)
    # homes with those of their key that stand before them, then with replicas
    m = np.concatenate([np.where(size[own] <= HOT, np.arange(len(x)) - start[own], 0), np.where(size[run] <= HOT, size[run], 0)])
    y, lo = np.concatenate([x, y]), np.concatenate([start[own], start[run]])
    some = np.flatnonzero(m)
    y, lo, m = y[some], lo[some], m[some]
    end = np.cumsum(m)
    a = 0
    while a < len(m):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + (1 << 18), "right")))
        n = m[a:b]
        yi = np.repeat(y[a:b], n)
        xi = x[np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        other = node[xi] != node[yi]
        yield apart(f, xi[other], yi[other], most)
        a = b


def earlier(how: Design, f: np.ndarray, x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
    """True where a block before `block` brings x and y together too, so that they are compared there."""
    same = ~np.unpackbits((f[x] ^ f[y]).view(np.uint8), axis=1).astype(bool)
    done, (m, n) = np.zeros(len(x), bool), how.parts
    for k in range(int(block.max(initial=0))):
        at = how.blocks[k]
        todo = np.flatnonzero(~done & (block > k))
        todo = todo[same[np.ix_(todo, at[:m])].all(1)]
        done[todo] = same[np.ix_(todo, at[m:])].reshape(len(todo), how.seconds, n).all(2).any(1)
    return done


def met(how: Design, most: int):
    """Compares what one task received, sorted by anchor, some whole anchors at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def worked(t: pa.Table) -> Iterator[pa.RecordBatch]:
            f = np.stack([t.column(c).to_numpy().view(np.uint64) for c in _LONGS], 1)
            node, anchor = t.column("node").to_numpy(), t.column("anchor").to_numpy().astype(np.int64)
            pairs, rows = [], 0

            def out():
                z = np.unique(np.concatenate(pairs), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(z[:, 0]), pa.array(z[:, 1]), pa.array(z[:, 2].astype(np.int32))], ["a", "b", "bits"])

            for x, y, d in compared(how, f, node, anchor, most):
                if how.exact and len(x):
                    new = ~earlier(how, f, x, y, anchor[x] >> 15)
                    x, y, d = x[new], y[new], d[new]
                if len(x):
                    a, b = node[x], node[y]
                    pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b), d], 1)[a != b])
                    rows += len(x)
                    if rows > STEP:
                        yield out()
                        pairs, rows = [], 0
            if pairs:
                yield out()

        held, rows = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            anchors = b.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1], "left"))  # the last anchor may go on, and may have begun before
            if rows >= STEP and (cut or (len(held) > 1 and held[-2].column("anchor")[-1].as_py() != anchors[-1])):
                yield from worked(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held, rows = [b.slice(cut)], b.num_rows - cut
                vec.trim()
        if rows:
            yield from worked(pa.Table.from_batches(held))
        vec.trim()

    return run


def near_pairs(points: DataFrame, max_bits: int = MAX_BITS, how: Design = DESIGN) -> DataFrame:
    """a, b, bits for near distinct points (node, f0..f3), a < b: all pairs that meet, but of many that share a key only links that connect them."""
    spread = points.select("node", *_LONGS).mapInArrow(replicas(how), "anchor int, node long, f0 long, f1 long, f2 long, f3 long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(met(how, max_bits), "a long, b long, bits int").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for every node in an edge (a, b)."""
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = saved(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, th, group_id, n, for documents in groups of two rows at least."""
    prints = saved(fingerprinted(docs), "fingerprints")
    points = saved(prints.groupBy(*_LONGS).agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("n")), "points")
    roots = components(near_pairs(points, max_bits))
    node = prints.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    groups = node.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return node.join(groups, "root").select("doc_id", "th", "group_id", "n")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, group_id, group_size, duplicate for every row of a group of two at least."""
    g = near_groups(docs, max_bits)
    one = Window.partitionBy("group_id").orderBy("doc_id", "th")
    return g.select("doc_id", "group_id", F.col("n").alias("group_size"), (F.row_number().over(one) > 1).alias("duplicate"))


def without_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one document of each group."""
    g = saved(near_groups(docs, max_bits), "near")
    rank = Window.partitionBy("group_id").orderBy("doc_id", "th")
    ranked = g.withColumn("k", F.row_number().over(rank))
    drop = saved(ranked.groupBy("doc_id", "th").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("c")).where("k > 1 or c > 1"), "near-drop")
    th, k = hidden(docs, "th"), hidden(docs, "k")
    keyed = docs.withColumn(th, F.xxhash64("text"))
    out = joined(keyed, drop.select("doc_id", F.col("th").alias(th)), ["doc_id", th], "left_anti").drop(th)
    twice = drop.where("k = 1").select("doc_id", F.col("th").alias(th))  # the one that stays stands there more than once
    if not twice.isEmpty():
        one = joined(keyed, saved(twice, "near-twice"), ["doc_id", th], "left_semi").withColumn(k, F.row_number().over(Window.partitionBy("doc_id", th).orderBy(F.lit(1))))
        out = out.unionByName(one.where(F.col(k) == 1).drop(th, k))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

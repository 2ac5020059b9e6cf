"""Candidate windows for passages of `LENGTH` words or more that stand in two documents at least.

Words are runs of non-white-space bytes. Each run of LENGTH words (an L-gram) is assigned to its minimizer, the
smallest hash among its LENGTH - K + 1 K-grams; neighbouring L-grams with the same minimizer make one *window*.
Equal L-grams have equal minimizers, so an L-gram that is repeated lies in windows whose minimizer occurs in two
documents. Only those windows move; all others are provably free of repeats. Each L-gram of the corpus
lies in exactly one window, hence windows of different minimizers never need to be compared.

Windows of the same words are collapsed before they move on (`distinct`), so a passage that stands in thousands of
documents costs one window and thousands of small occurrence rows. Words are the same when their names, 64-bit hashes, are, and a second
hash independent of the first agrees: a name for which it doesn't is divided by it. Within a shard words are compared byte by byte.

Texts of one doc_id are kept apart by a hash; doc_id alone says whether two documents differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import docs_only, lists, saved

LENGTH, K = 50, 10
#: A longer run of L-grams with one minimizer (periodic text) is split, so windows stay short.
MOST = LENGTH
#: Words of windows that make up a shard, about.
SHARD_WORDS = 400_000


def windows_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K, word_hash=vec.word_hashes):
    """minimizer, document, first word (in its document), words, name and check (two hashes of the words), from byte, to byte
    (in its document) of every window."""
    s, e, first = vec.words(data, off)
    h = word_hash(data, s, e)
    m = vec.sliding_min(vec.kgrams(h, k), length - k + 1)
    at = np.flatnonzero(vec.inside(first, len(h), length))
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z, z, z, z
    doc = np.searchsorted(first, at, "right") - 1
    mm = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (mm[1:] != mm[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    start = np.flatnonzero(place % MOST == 0)
    n = np.diff(np.append(start, len(at))) + length - 1
    a = at[start]
    names = []
    for own, q in ((h, vec._Q), (vec.word_hashes(data, s, e, second=True), vec._P)):
        c = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * vec.powers(q, len(own)), out=c[1:])
        names.append(vec.mix((c[a + n] - c[a]) * vec.powers(vec.inverse(q), len(own))[a] + n.astype(np.uint64)).view(np.int64))
    d = doc[start]
    return mm[start], d, a - first[d], n, *names, s[a] - off[d], e[a + n - 1] - off[d]


def _rows(length: int, k: int, word_hash):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(it, "text"):
            data, off = vec.buffers(b.column("text"))
            m, d, at, n, name, check, _, _ = windows_of(data, off, length, k, word_hash)
            ids, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(ids[d]), pa.array(th[d]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name), pa.array(check)], ["minimizer", "doc_id", "th", "at", "n", "name", "check"])

    return run


def _contents(length: int, k: int, word_hash):
    """The words of the windows listed in `wanted` (name, at, last_doc) of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(it, "text"):
            data, off = vec.buffers(b.column("text"))
            m, d, at, n, _, _, lo, hi = windows_of(data, off, length, k, word_hash)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            wanted = b.column("wanted")
            sets = wanted.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(wanted.offsets)))
            names, places, last = (np.asarray(sets.field(c)) for c in ("name", "at", "last_doc"))
            asked = (row << 32) | places  # a text asks for a place once at most
            order = np.argsort(asked)
            asked = asked[order]
            own = (d.astype(np.int64) << 32) | at
            i = np.searchsorted(asked, own)
            i[i == len(asked)] = 0
            keep = asked[i] == own if len(asked) else np.zeros(len(own), bool)
            name = names[order][i] if len(asked) else np.zeros(len(own), np.int64)
            texts = [bytes(data[x:y]) for x, y in zip((lo + off[d])[keep].tolist(), (hi + off[d])[keep].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.view(np.int64)[keep]), pa.array(name[keep]), pa.array(n[keep].astype(np.int32)), pa.array(texts, pa.binary()), pa.array(ids[d][keep]), pa.array(at[keep].astype(np.int32)), pa.array(last[order][i[keep]] if len(asked) else np.zeros(0, np.int64))],
                ["minimizer", "name", "n", "words", "first_doc", "first_at", "last_doc"],
            )

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = K, word_hash=vec.word_hashes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, windows, involved): doc_id, th (a hash that tells texts of one doc_id apart), at, n, name, minimizer of all windows whose
    minimizer stands in two documents; minimizer, name, n, words, first_doc, first_at (where it stands first), last_doc of the distinct ones, once
    for each row that repeats doc_id and text; and the texts (doc_id, th, text) that have such windows, no others having repeats. All texts are
    shuffled once, to meet the list of their windows; from there on only the texts involved move."""
    whole = docs_only(docs, "doc_id", "text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    every = saved(whole.mapInArrow(_rows(length, k, word_hash), "minimizer long, doc_id long, th long, at int, n int, name long, check long"), "windows")
    often = every.groupBy("minimizer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("minimizer")
    seen = saved(every.join(often, "minimizer").distinct(), "repeated-windows")
    clash = saved(seen.groupBy("name").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("name"), "window-clashes")
    if not clash.isEmpty():
        seen = seen.join(clash.withColumn("bad", F.lit(True)), "name", "left").withColumn("name", F.when(F.col("bad"), F.xxhash64("name", "check")).otherwise(F.col("name"))).drop("bad")
    seen = seen.drop("check")
    by_name = seen.groupBy("name").agg(F.min(F.struct("doc_id", "th", "at")).alias("first"), F.max("doc_id").alias("last_doc"))
    asked = F.struct("name", F.col("first.at").alias("at"), "last_doc")
    wanted = by_name.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(F.collect_list(asked).alias("wanted"))
    none = F.expr("cast(array() as array<struct<name: bigint, at: int, last_doc: bigint>>)")
    lists_ = saved(seen.select("doc_id", "th").distinct().join(wanted, ["doc_id", "th"], "left").select("doc_id", "th", F.coalesce("wanted", none).alias("wanted")), "wanted")
    involved = saved(whole.join(lists_, ["doc_id", "th"]), "involved")
    content = involved.where("size(wanted) > 0").mapInArrow(_contents(length, k, word_hash), "minimizer long, name long, n int, words binary, first_doc long, first_at int, last_doc long")
    return seen, saved(content, "distinct-windows"), involved.select("doc_id", "th", "text")


def once(t: pa.Table) -> pa.Table:
    """Of windows that have one name, one: the first in corpus order."""
    t = t.sort_by([("name", "ascending"), ("first_doc", "ascending"), ("first_at", "ascending")]).combine_chunks()
    name = np.asarray(t.column("name"))
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    return t if new.all() else t.filter(pa.array(new)).combine_chunks()


def sharded(windows: DataFrame, words: int = SHARD_WORDS) -> DataFrame:
    """windows with their shard, so that a shard has about `words` words; one minimizer is never divided."""
    total = windows.agg(F.sum("n")).first()[0] or 0
    return windows.withColumn("shard", F.pmod(F.xxhash64("minimizer"), F.lit(max(1, -(-total // words)))).cast("int"))


RANGES = "array<struct<lo: int, hi: int>>"
MARKS = f"name long, first_doc long, shared {RANGES}, later {RANGES}"


def ranges(owner: np.ndarray, at: np.ndarray, owners: int, length: int) -> pa.Array:
    """For each owner the union of the ranges at..at+length, as a list of lo, hi."""
    return joined_ranges(owner, at, at + length, owners)


def joined_ranges(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, owners: int) -> pa.Array:
    order = np.lexsort((hi, lo, owner))
    o, lo, hi = owner[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    if len(o):
        shift = o * (1 << 32)  # running maximum within an owner
        top = np.maximum.accumulate(hi + shift) - shift
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (lo[1:] > top[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(o)) - 1
        o, lo, hi = o[begin], lo[begin], top[end]
    n = np.bincount(o, minlength=owners) if len(o) else np.zeros(owners, np.int64)
    return lists(pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["lo", "hi"]), n)


def placed(occurrences: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, th, repeated, removed: the ranges of words of each text that stand in another document too,
    and of these the ones that stand in a document with a smaller doc_id. marks: per window name the ranges within the window
    that are shared by two documents, and those that a document before its first one has."""
    rows = occurrences.select("doc_id", "th", "at", "name").join(marks, "name")
    rows = rows.select("doc_id", "th", "at", "shared", F.when(F.col("doc_id") == F.col("first_doc"), F.col("later")).otherwise(F.col("shared")).alias("later"))
    rows = rows.where("size(shared) > 0").select(
        "doc_id",
        "th",
        F.expr("transform(shared, r -> named_struct('lo', r.lo + at, 'hi', r.hi + at))").alias("a"),
        F.expr("transform(later, r -> named_struct('lo', r.lo + at, 'hi', r.hi + at))").alias("b"),
    )
    per = rows.groupBy("doc_id", "th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("a")))).alias("a"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("b")))).alias("b"))
    return per.select("doc_id", "th", F.expr(FOLD.format(rs="a")).alias("repeated"), F.expr(FOLD.format(rs="b")).alias("removed"))


#: Unites sorted ranges where they touch or overlap.
FOLD = """aggregate({rs}, cast(array() as array<struct<lo: int, hi: int>>), (acc, r) ->
    if(size(acc) > 0 and element_at(acc, -1).hi >= r.lo,
       concat(slice(acc, 1, size(acc) - 1), array(named_struct('lo', element_at(acc, -1).lo, 'hi', greatest(element_at(acc, -1).hi, r.hi)))),
       concat(acc, array(r))))"""


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, repeated, removed and the text without the removed ranges of words, for the texts in spans. docs: the ones involved."""

    def f(t: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        out = []
        for i, j in vec.spans(t):
            data, off = vec.buffers(t.slice(i, j - i))
            s, e, first = vec.words(data, off)
            los, his = lo.slice(i, j - i), hi.slice(i, j - i)
            base = np.repeat(first[:-1], np.asarray(pa.compute.list_value_length(los)))
            a, b = np.asarray(los.flatten()) + base, np.asarray(his.flatten()) + base
            left, loff = vec.cut(data, off, s[a], e[b - 1])
            out.append(vec.texts(left, np.diff(loff)).cast(pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    f.__annotations__ = {"t": pa.Array, "lo": pa.Array, "hi": pa.Array, "return": pa.Array}
    both = docs.join(saved(spans, "spans"), ["doc_id", "th"])
    return both.select("doc_id", "repeated", "removed", F.arrow_udf("string")(f)("text", "removed.lo", "removed.hi").alias("text"))

"""Substring dedup with suffix automata of reference shards.

The reference is cut into shards of bounded size; each shard's suffix automaton is built once, and what is to be cleaned is
streamed through it for matching statistics: at every word the length of the longest string ending there that the shard has. Maximal
spans of `LENGTH` words or more are removed.

`against_reference` takes a separate reference. Its automata are broadcast, one shard of about `SHARD_WORDS` words after
the other, a job each whose finds are written, and whole documents are streamed; a document meets every shard, which suits references that are
small beside the corpus.

`substring_dedup` cleans a corpus against itself: a span goes where a document with a smaller doc_id has it. Here the
reference grows with the corpus, and broadcasting it would not hold. The windows of repeats.py, which provably hold all
repeats, are collected in shards by minimizer; equal passages are always in the same shard, so an automaton goes
only to the task that streams its shard, window by window in corpus order, each matched before it is added; a second pass in the
opposite order finds what stands in later documents.

Edge cases: null texts and null doc_ids take no part; texts shorter than LENGTH words match nothing; rows that repeat a doc_id are one
document; an empty reference or table removes nothing; a document may lose all its text; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .automaton import SuffixAutomaton
from .common import docs_only, saved, text_udf
from .repeats import FOLD, K, LENGTH, MARKS, RANGES, joined_ranges, once, placed, repeated_windows, sharded, without_spans

SHARD_WORDS = 150_000


def maximal(automaton: SuffixAutomaton, words: list, length: int):
    """(first, end, state) of the maximal matches of `length` at least."""
    held = None
    for i, (v, n) in enumerate(automaton.statistics(words)):
        if held and n <= held[1]:
            yield held[0] + 1 - held[1], held[0] + 1, held[2]
        held = (i, n, v) if n >= length else None
    if held:
        yield held[0] + 1 - held[1], held[0] + 1, held[2]


def earlier_matches(doc: np.ndarray, order: np.ndarray, ids: np.ndarray, first: np.ndarray, length: int):
    """(window, first, end) of the maximal spans of each window that a document before its own, in this order, has."""
    automaton = SuffixAutomaton()
    pending: list[list] = []
    before = None
    for w in order.tolist():
        if doc[w] != before:  # a new document: the ones before it are reference now
            for seq in pending:
                automaton.add(seq)
            pending, before = [], doc[w]
        seq = ids[first[w] : first[w + 1]].tolist()
        pending.append(seq)
        for a, b, _ in maximal(automaton, seq, length):
            yield w, a, b


def marks_of(length: int):
    def run(t: pa.Table) -> pa.Table:
        t = once(t).sort_by([("first_doc", "ascending"), ("first_at", "ascending"), ("name", "ascending")]).combine_chunks()
        data, off = vec.buffers(t.column("words"))
        s, e, first = vec.words(data, off)
        ids = vec.symbols(data, s, e)
        doc, last = t.column("first_doc").to_numpy(), t.column("last_doc").to_numpy()
        n = len(doc)
        later = list(earlier_matches(doc, np.arange(n), ids, first, length))
        # what documents after it have is shared as well; of a window that further documents have, all of it
        shared = later + list(earlier_matches(doc, np.arange(n)[::-1], ids, first, length))
        shared += [(w, 0, first[w + 1] - first[w]) for w in np.flatnonzero(last != doc).tolist()]
        both = np.array(shared, np.int64).reshape(-1, 3)
        late = np.array(later, np.int64).reshape(-1, 3)
        return pa.table({"name": t.column("name"), "first_doc": t.column("first_doc"), "shared": joined_ranges(both[:, 0], both[:, 1], both[:, 2], n), "later": joined_ranges(late[:, 0], late[:, 1], late[:, 2], n)})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, repeated, removed (ranges of words), for each text of a doc_id."""
    return _spans(docs, length, k)[0].drop("th")


def _spans(docs: DataFrame, length: int, k: int, **kw) -> tuple[DataFrame, DataFrame]:
    seen, windows, involved = repeated_windows(docs, length, k, **kw)
    marks = sharded(windows, SHARD_WORDS).groupBy("shard").applyInArrow(marks_of(length), MARKS)
    return placed(seen, marks), involved


def substring_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, **kw) -> DataFrame:
    """doc_id, repeated, removed and the remaining text, for every document with a repeated passage."""
    spans, involved = _spans(docs, length, k, **kw)
    return without_spans(involved, spans)


_built: dict[str, SuffixAutomaton] = {}


def built(name: str, broadcast) -> SuffixAutomaton:
    """The automaton of a shard; a worker builds it once and holds one at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = SuffixAutomaton()
        for text in broadcast.value:
            _built[name].add(text.split())
    return _built[name]


def _matcher(broadcast, length: int):
    name = uuid.uuid4().hex

    def f(v: pa.Array) -> pa.Array:
        automaton = built(name, broadcast)
        out = [[{"lo": a, "hi": b} for a, b, _ in maximal(automaton, (text or "").split(), length)] for text in v.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))

    return text_udf(f, RANGES)


def against_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, removed for each distinct row (doc_id, text) that has a passage of the reference (a table with text)."""
    spark = docs.sparkSession
    texts = saved(reference.where("text is not null").select("text", F.size(F.split("text", r"\s+")).alias("n")).where(F.col("n") >= length).distinct(), "reference")
    total = texts.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // SHARD_WORDS))
    df = docs_only(docs, "doc_id", "text").where("text is not null")
    found = None
    for p in range(parts):
        rows = [r[0] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).select("text").collect()]
        if rows:
            own = df.select("doc_id", F.md5("text").alias("th"), _matcher(spark.sparkContext.broadcast(rows), length)("text").alias("rs")).where("size(rs) > 0")
            own = saved(own.dropDuplicates(["doc_id", "th"]), "matches")
            found = own if found is None else found.unionByName(own)
    if found is None:
        return df.where("false").selectExpr("doc_id", f"cast(array() as {RANGES}) as removed")
    per = found.groupBy("doc_id", "th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("rs")))).alias("rs"))
    return per.select("doc_id", F.expr(FOLD.format(rs="rs")).alias("removed"))

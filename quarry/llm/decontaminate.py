"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are lower-cased runs of letters and digits, so case, punctuation and spacing don't matter. Training words are
streamed through the automaton, which tells at each word how long the longest string is that ends there
and stands in some item. A stretch of `MIN_WORDS` or more that a text shares with an item is removed from the text

* if it is `MAX_WORDS` long or longer, or
* if the text's stretches cover at least `COVERAGE` of that item.

Of an item with fewer than MIN_WORDS words the whole counts, which covers it; below `SHORT` words an item can't be told from ordinary
speech and matches nothing.

The long ones are the automaton's maximal matches. For the others an index from n-grams to all their places credits every item
that has the words, not just the first one.

A match of MIN_WORDS words contains an n-gram of MIN_WORDS of some item; their hashes are tested first over the
whole column at once, and only the stretches around hits walk the automaton: the result is the same as for
walking every word. The items are broadcast in parts of at most `PART_BYTES` of text, which bounds what a worker holds. A benchmark of
several parts takes one pass over the documents for each, whose finds are written; every part searches the original text, what they
find is merged and cut once, so the result doesn't depend on the parts.

Edge cases: null and empty texts pass; items that are null or have fewer than SHORT words match nothing;
a stretch in several items is named after the first; an empty benchmark changes nothing; a document that is all
benchmark stays with what is left, maybe an empty text; extra columns pass and n_chars is kept true.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .automaton import SuffixAutomaton
from .common import docs_only, hidden, joined, saved, text_udf

MIN_WORDS, MAX_WORDS, COVERAGE, SHORT = 8, 13, 0.5, 4
#: Text of the items in one automaton, about 150 MB in a worker.
PART_BYTES = 1 << 20
SPANS = "array<struct<s: int, e: int, words: int, item: bigint>>"
NONE = f"cast(array() as {SPANS})"
#: Spans of several parts: those inside a longer one go, and of equal ones all but the first item's.
MERGED = "array_distinct(array_sort(filter({xs}, a -> not exists({xs}, b -> b.s <= a.s and b.e >= a.e and (b.s < a.s or b.e > a.e or b.item < a.item)))))"


def word_bytes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]


class Items:
    """The automaton of some items and the places of their n-grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        data, off = vec.buffers(vec.lower(pa.array([t for _, t in items], pa.string())))
        s, e, first = vec.words(data, off, True)
        h = vec.word_hashes(data, s, e)
        g = vec.kgrams(h, MIN_WORDS)
        place = np.flatnonzero(vec.inside(first, len(h), MIN_WORDS))
        place = place[np.argsort(g[place], kind="stable")]
        self.grams, begin = np.unique(g[place], return_index=True)
        self.place, self.at = place, np.append(begin, len(place))  # places of gram k: place[at[k]:at[k + 1]]
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.words = word_bytes(data, s, e)
        self.ids = [item for item, _ in items]
        self.n = np.diff(first)
        self.row = np.repeat(np.arange(len(items)), self.n)  # of each word
        self.automaton = SuffixAutomaton()
        self.of = []
        whole: dict[int, list] = {}
        for k, item in enumerate(self.ids):
            n = int(self.n[k])
            if n >= MIN_WORDS:
                self.automaton.add(self.words[first[k] : first[k + 1]])
                self.of += [item] * n
            elif n >= SHORT:
                whole.setdefault(n, []).append((int(vec.kgrams(h[first[k] : first[k + 1]], n)[0]), item, self.words[first[k] : first[k + 1]]))
        #: words of short items -> sorted hashes, and for each the items (id, words) that have it
        self.short = {}
        for n, rows in whole.items():
            by: dict[int, list] = {}
            for g, item, ws in rows:
                by.setdefault(g, []).append((item, ws))
            self.short[n] = np.array(sorted(by), np.uint64), by

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in grams, place) of all places of the n-grams with these numbers."""
        n = self.at[grams + 1] - self.at[grams]
        skip = np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(grams)), n), self.place[np.repeat(self.at[grams], n) + np.arange(len(skip)) - skip]

    def covered(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the items of which these n-grams cover COVERAGE at least."""
        _, place = self.places(np.unique(grams))
        place = np.unique(place)
        till = np.append(place[1:], np.iinfo(np.int64).max)
        new = np.minimum(till - place, MIN_WORDS)  # words not counted by the next place; an n-gram stays in its item
        row, which = np.unique(self.row[place], return_inverse=True)
        same = np.append(self.row[place[1:]] == self.row[place[:-1]], False)
        n = np.bincount(which, np.where(same, new, MIN_WORDS), len(row))
        return row[n >= COVERAGE * self.n[row]]

    def stretches(self, at: np.ndarray, grams: np.ndarray, rows: np.ndarray, ws: list[bytes], base: int) -> list[tuple[int, int, int]]:
        """(first word, end, item) of what a text has in common with the items `rows`. at, grams: its n-grams; ws: its words from `base` on."""
        wanted = np.zeros(len(self.ids), bool)
        wanted[rows] = True
        out = []
        number, place = self.places(grams)
        use = wanted[self.row[place]]
        x, p = at[number[use]], place[use]
        order = np.lexsort((x, p - x, self.row[p]))
        x, p = x[order], p[order]
        new = np.ones(len(x), bool)
        new[1:] = (np.diff(x) != 1) | (np.diff(p) != 1) | (np.diff(self.row[p]) != 0)
        begin = np.flatnonzero(new)
        for i, j in zip(begin.tolist(), np.append(begin[1:], len(x)).tolist()):
            a, b, q, held = int(x[i]), int(x[j - 1]) + MIN_WORDS, int(p[i]), 0
            for k in range(b - a + 1):  # equal hashes aren't enough
                if k == b - a or ws[a - base + k] != self.words[q + k]:
                    if k - held >= MIN_WORDS:
                        out.append((a + held, a + k, self.ids[self.row[q]]))
                    held = k + 1
        return out

    def long(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, end, first item) of the maximal matches of MAX_WORDS at least."""
        out = []
        held = None
        for i, (v, n) in enumerate(self.automaton.statistics(ws)):
            if held and n <= held[1]:
                out.append(held)
            held = (i, n, v) if n >= MAX_WORDS else None
        if held:
            out.append(held)
        return [(i + 1 - n, i + 1, self.of[self.automaton.end[v]]) for i, n, v in out]

    def found(self, v: pa.Array) -> pa.Array:
        plain, plain_off = vec.buffers(v)
        data, off = vec.buffers(vec.lower(v))
        s, e, first = vec.words(data, off, True)
        ps, pe, pfirst = vec.words(plain, plain_off, True)
        if len(s) != len(ps) or (first != pfirst).any():  # lower-casing made or unmade a word: use ASCII case only
            data, off, s, e, first = plain, plain_off, ps, pe, pfirst
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        h = vec.word_hashes(data, s, e)
        g = vec.kgrams(h, MIN_WORDS)
        hit = np.flatnonzero(vec.inside(first, len(h), MIN_WORDS) & self.bloom[(g >> np.uint64(42)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
        hit = hit[np.isin(g[hit], self.grams)]
        gram = np.searchsorted(self.grams, g[hit])
        every: dict[int, list] = {}  # matches of each text
        for n, (known, by) in self.short.items():
            gs = vec.kgrams(h, n)
            at = np.flatnonzero(vec.inside(first, len(h), n) & np.isin(gs, known)) if len(gs) else np.zeros(0, np.int64)
            for x in at.tolist():
                ws = word_bytes(data, s[x : x + n], e[x : x + n])
                every.setdefault(int(np.searchsorted(first, x, "right")) - 1, []).extend((x, x + n, item) for item, own in by[int(gs[x])] if own == ws)
        doc = np.searchsorted(first, hit, "right") - 1
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        for i, j in zip(begin.tolist(), np.append(begin[1:], len(doc)).tolist()):
            at, grams = hit[i:j], gram[i:j]
            base = int(at[0])
            ws = word_bytes(data, s[base : at[-1] + MIN_WORDS], e[base : at[-1] + MIN_WORDS])
            breaks = np.flatnonzero(np.diff(at) > MIN_WORDS)  # stretches of overlapping n-grams
            matches = every.setdefault(int(doc[i]), [])
            for a, b in zip(at[np.concatenate([[0], breaks + 1])].tolist(), (at[np.concatenate([breaks, [len(at) - 1]])] + MIN_WORDS).tolist()):
                if b - a >= MAX_WORDS:
                    matches += [(a + x, a + y, item) for x, y, item in self.long(ws[a - base : b - base])]
            rows = self.covered(grams)
            if len(rows):
                matches += self.stretches(at, grams, rows, ws, base)
        spans = [None] * len(v)
        for d, matches in every.items():
            bad, top = [], 0
            for x, y, item in sorted(matches, key=lambda m: (m[0], -m[1], m[2])):
                if y > top:  # else inside one before
                    bad.append((x, y, item))
                    top = y
            if bad:
                lo = plain_off[d]
                spans[d] = [{"s": int(ps[x] - lo), "e": int(pe[y - 1] - lo), "words": y - x, "item": int(item)} for x, y, item in bad]
        return pa.array(spans, FOUND)


FOUND = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("words", pa.int32()), ("item", pa.int64())]))
_built: dict[str, Items] = {}


def built(name: str, broadcast) -> Items:
    """The automaton of a part; a worker builds it once and holds one at a time. Of the module, so that tasks share it: what is inside a
    column function is unpickled anew for each."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(broadcast.value)
    return _built[name]


def finder(broadcast, cut: bool):
    """Column function: what goes from a text, null for a text that is left alone; cut: with the text that is left."""
    name = uuid.uuid4().hex

    def f(v: pa.Array) -> pa.Array:
        spans = built(name, broadcast).found(v)
        if not cut:
            return spans
        hit = np.asarray(spans.is_valid())
        left = np.full(len(v), None, object)
        left[hit] = without(v.filter(pa.array(hit)), spans.filter(pa.array(hit))).to_pylist()
        return pa.StructArray.from_arrays([spans, pa.array(left, pa.string())], ["spans", "left"])

    return text_udf(f, f"struct<spans: {SPANS}, left: string>" if cut else SPANS)


def without(t: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the byte ranges of spans."""
    data, off = vec.buffers(t)
    n = np.asarray(pa.compute.list_value_length(spans))
    base, flat = np.repeat(off[:-1], n), spans.flatten()
    left, loff = vec.cut(data, off, np.asarray(flat.field("s")) + base, np.asarray(flat.field("e")) + base)
    return vec.texts(left, np.diff(loff)).cast(pa.string())


def broadcasts(benchmark: DataFrame) -> list:
    """The items in parts of PART_BYTES, about."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    if parts > 1:
        items = saved(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    out = []
    for k in range(parts):
        rows = (items.where(F.col("part") == k) if parts > 1 else items).orderBy("item_id", "text").select("item_id", "text").collect()
        if rows:
            out.append(items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows]))
    return out


def searched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column, and its name: spans and the text that is left; null for texts that are left alone. All parts search the text as it is."""
    names, x = [F.col(f"`{c}`") for c in docs.columns], hidden(docs, "found")
    parts = broadcasts(benchmark)
    if not parts:
        return docs.select(*names, F.expr(f"cast(null as struct<spans: {SPANS}, left: string>)").alias(x)), x
    if len(parts) == 1:
        return docs.select(*names, finder(parts[0], True)("text").alias(x)), x
    key = hidden(docs, "key")
    texts = docs_only(docs, "text").where("text is not null")
    hits = None
    for part in parts:  # a job for each: its automaton is the only one in memory
        own = saved(texts.select("text", finder(part, False)("text").alias("spans")).where("spans is not null").select(F.md5("text").alias("key"), "spans").dropDuplicates(["key"]), "part")
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")).select(F.col("key").alias(key), F.expr(MERGED.format(xs="spans")).alias(x))
    df = joined(docs.withColumn(key, F.md5("text")), saved(hits, "hits"), key, "left")
    return df.select(*names, F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("spans"), cutter()("text", F.coalesce(F.col(x), F.expr(NONE))).alias("left"))).alias(x)), x


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the benchmark's passages taken out of text."""
    df, x = searched(docs, benchmark)
    left = F.col(f"`{x}`.left")
    new = {"text": F.coalesce(left, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left.isNotNull(), F.char_length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items, spans (byte ranges, words, item) and the text that is left, for each document with a
    passage of the benchmark."""
    df, x = searched(docs_only(docs, "doc_id", "text"), benchmark)
    df = df.where(f"{x}.spans is not null").select("doc_id", f"{x}.*")
    return df.select("doc_id", F.array_sort(F.array_distinct("spans.item")).alias("items"), "spans", F.col("left").alias("text"))


def cutter():
    """Column function: text without the byte ranges of spans."""

    def f(t: pa.Array, spans: pa.Array) -> pa.Array:
        return without(t, spans)

    f.__annotations__ = {"t": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf("string")(f)

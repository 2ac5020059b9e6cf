"""Suffix-array dedup, built column by column for many documents at once.

The collection's Burrows-Wheeler transform, suffix order and common prefixes are built as in Bauer, Cox and
Rosone's method (and its extension to common prefixes): there is one round per symbol position, counted from the right end;
in each round every document still running gives one symbol, its new suffix's place is found from the place of its
previous suffix (symbols smaller, then equal symbols further up), and the columns are rewritten in
sequential passes: the old file is read front to back once to find the places and once more to write the new one with the new rows in
them, `BLOCK` rows at a time; the common prefixes of new rows with their neighbours are set on the way. Memory holds a block, four bytes for each row (how far
it moves) and a few numbers for each document, never the columns. The files live in the folder all executors share and are
removed as soon as the next round's is written.

"Documents" of a construction are the windows of repeats.py (at most 2 * LENGTH words, so a bounded number of
rounds whatever the length of a text), collected into shards by minimizer. Suffixes whose common prefix is LENGTH words or
longer, then compared word by word, form the repeats; each is traced back to all its occurrences.

Result: for every document with a passage of LENGTH words or more that another document has, the ranges of words
that are repeated, and those to be removed because a document with a smaller doc_id has them.

Edge cases: null texts and null doc_ids take no part; texts shorter than LENGTH words have no passage; rows
that repeat a doc_id are one document, so repeats among them don't count; a document may lose all its text; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from . import vec
from .common import shared
from .repeats import K, LENGTH, MARKS, once, placed, ranges, repeated_windows, sharded, without_spans

#: Columns of the external file: parent key, window, suffix length, common prefix, preceding symbol.
COLUMNS = (("key", np.uint64), ("win", np.int32), ("len", np.int32), ("lcp", np.int32), ("bwt", np.int32))
#: Rows read or written at a time.
BLOCK = 1 << 16


class ExternalRows:
    """The rows of a round in one file, block after block, a block column after column; read and written from front to back."""

    def __init__(self, folder: str) -> None:
        self.fs, base = pa.fs.FileSystem.from_uri(folder)
        self.base = f"{base}/bwt-{uuid.uuid4().hex}"
        self.fs.create_dir(self.base)
        self.round, self.sizes = -1, []

    @property
    def rows(self) -> int:
        return sum(self.sizes)

    def write(self, blocks: Iterator[dict[str, np.ndarray]]) -> None:
        sizes: list[int] = []

        def put(f, b: dict[str, np.ndarray], i: int, j: int) -> None:
            for name, kind in COLUMNS:
                f.write(np.ascontiguousarray(b[name][i:j], kind))
            sizes.append(j - i)

        with self.fs.open_output_stream(f"{self.base}/{self.round + 1}") as f:
            held = None  # what doesn't fill a block yet
            for b in blocks:
                b = b if held is None else {name: np.concatenate([held[name], b[name]]) for name, _ in COLUMNS}
                n = len(b["key"])
                for i in range(0, n - n % BLOCK, BLOCK):
                    put(f, b, i, i + BLOCK)
                held = {name: b[name][n - n % BLOCK :] for name, _ in COLUMNS} if n % BLOCK else None
            if held is not None:
                put(f, held, 0, len(held["key"]))
        if self.round >= 0:
            self.fs.delete_file(f"{self.base}/{self.round}")
        self.round, self.sizes = self.round + 1, sizes

    def blocks(self) -> Iterator[dict[str, np.ndarray]]:
        width = sum(np.dtype(kind).itemsize for _, kind in COLUMNS)
        with self.fs.open_input_stream(f"{self.base}/{self.round}") as f:
            for n in self.sizes:
                raw, at, out = f.read(n * width), 0, {}
                for name, kind in COLUMNS:
                    out[name] = np.frombuffer(raw, kind, n, at)
                    at += n * np.dtype(kind).itemsize
                yield out

    def close(self) -> None:
        self.fs.delete_dir(self.base)


def common_prefix(code: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the symbols at a and at b, `most` at most: bisection over hashes
    of prefixes (code: running hash of all symbols)."""
    inv = vec.powers(vec.inverse(vec._Q), len(code))
    lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    for _ in range(int(hi.max(initial=0)).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (code[a + mid] - code[a]) * inv[a] == (code[b + mid] - code[b]) * inv[b]
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def construct(symbols: np.ndarray, n: np.ndarray, folder: str) -> Iterator[dict[str, np.ndarray]]:
    """symbols: those of all documents, joined, from 1 up; n: their lengths. Gives the rows in suffix order, block by block:
    win and len name the suffix, lcp its common prefix with the row before, bwt the symbol before it (0: none)."""
    m = len(n)
    base = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    code = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(vec.mix(symbols.astype(np.uint64)) * vec.powers(vec._Q, len(symbols)), out=code[1:])
    low = np.uint64(0xFFFFFFFF)

    def empty() -> Iterator[dict[str, np.ndarray]]:  # round 0: the empty suffix of each document, in the order of the documents
        if m:
            d = np.arange(m)
            yield {"key": d, "win": d, "len": np.zeros(m), "lcp": np.zeros(m), "bwt": symbols[base + n - 1]}

    def inserted(new: dict[str, np.ndarray], at: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """The old rows with new[i] before row at[i]; at is ascending."""
        moved = np.cumsum(np.bincount(at, minlength=files.rows + 1)).astype(np.uint32)  # by how many places each row moves
        done = before = 0
        last = {c: np.zeros(1, k) for c, k in COLUMNS}
        was_new = False
        for old in files.blocks():
            end = int(np.searchsorted(at, before + len(old["key"]), "left")) if before + len(old["key"]) < files.rows else len(at)
            put = at[done:end] - before + np.arange(end - done)
            size = len(old["key"]) + end - done
            is_new = np.zeros(size, bool)
            is_new[put] = True
            keep = np.flatnonzero(~is_new)
            b = {}
            for c, kind in COLUMNS:
                b[c] = np.empty(size, kind)
                b[c][put], b[c][keep] = new[c][done:end], old[c]
            b["key"] += np.where(b["key"] > low, moved[(b["key"] & low).astype(np.int64)], 0).astype(np.uint64)
            touched = np.flatnonzero(is_new | np.append(was_new, is_new[:-1]))
            if before + done == 0:
                touched = touched[touched > 0]
            wx, wy = (np.where(touched > 0, b["win"][touched - 1], last["win"]), b["win"][touched])
            lx, ly = (np.where(touched > 0, b["len"][touched - 1], last["len"]).astype(np.int64), b["len"][touched].astype(np.int64))
            b["lcp"][touched] = common_prefix(code, base[wx] + n[wx] - lx, base[wy] + n[wy] - ly, np.minimum(lx, ly))
            before, done, last, was_new = before + len(old["key"]), end, {c: b[c][-1:] for c in b}, bool(is_new[-1])
            yield b

    files = ExternalRows(folder)
    try:
        files.write(empty())
        place = np.arange(m)  # of each document's latest suffix
        for r in range(1, int(n.max(initial=0)) + 1):
            live = np.flatnonzero(n >= r)
            start = base[live] + n[live] - r
            key = (symbols[start].astype(np.uint64) << np.uint64(32)) | place[live].astype(np.uint64)
            order = np.argsort(key)
            live, start, key = live[order], start[order], key[order]
            at = np.zeros(len(key), np.int64)
            for b in files.blocks():  # keys are ascending: a key's place is the number of smaller ones
                at += np.searchsorted(b["key"], key)
            bwt = np.where(n[live] > r, symbols[np.maximum(start - 1, 0)], 0)
            files.write(inserted({"key": key, "win": live, "len": np.full(len(key), r), "lcp": np.zeros(len(key)), "bwt": bwt}, at))
            place = place + np.searchsorted(at, place, "right")
            place[live] = at + np.arange(len(at))
        yield from files.blocks()
    finally:
        files.close()


def agreed(symbols: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """group, ascending, divided where neighbours' first `length` symbols are not the same: equal hashes aren't enough."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    for k in range(length):
        x = symbols[start + k]
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new) - 1


def marks_of(folder: str, length: int):
    """Marks of one shard's windows."""

    def run(t: pa.Table) -> pa.Table:
        t = once(t)
        data, off = vec.buffers(t.column("words"))
        s, e, first = vec.words(data, off)
        symbols = vec.symbols(data, s, e) + 1
        n = np.diff(first)
        doc, last = t.column("first_doc").to_numpy(), t.column("last_doc").to_numpy()
        groups, count, rest = [], 0, []
        for rows in construct(symbols, n, folder):
            group = np.cumsum(rows["lcp"] < length) + count
            count = int(group[-1])
            use = rows["len"] >= length
            groups.append(group[use])
            rest.append(np.stack([rows["win"][use].astype(np.int64), (n[rows["win"]] - rows["len"])[use]], 1))
        group = np.concatenate([np.zeros(0, np.int64), *groups])
        win, at = np.concatenate([np.zeros((0, 2), np.int64), *rest]).T
        group = agreed(symbols, first[win] + at, group, length)
        if len(group):
            group = group - group.min()
            lo, hi = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(lo, group, doc[win])
            np.maximum.at(hi, group, last[win])
            both = (lo != hi)[group]
            later = both & (lo[group] < doc[win])
        else:
            both = later = np.zeros(0, bool)
        return pa.table(
            {
                "name": t.column("name"),
                "first_doc": t.column("first_doc"),
                "shared": ranges(win[both], at[both], len(n), length),
                "later": ranges(win[later], at[later], len(n), length),
            }
        )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, repeated, removed (ranges of words), for each text of a doc_id."""
    return _spans(docs, length, k)[0].drop("th")


def _spans(docs: DataFrame, length: int, k: int, **kw) -> tuple[DataFrame, DataFrame]:
    seen, windows, involved = repeated_windows(docs, length, k, **kw)
    folder = shared(docs.sparkSession)
    marks = sharded(windows).groupBy("shard").applyInArrow(marks_of(folder, length), MARKS)
    return placed(seen, marks), involved


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, **kw) -> DataFrame:
    """doc_id, repeated, removed and the remaining text, for every document with a repeated passage."""
    spans, involved = _spans(docs, length, k, **kw)
    return without_spans(involved, spans)

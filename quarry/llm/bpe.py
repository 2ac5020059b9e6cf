"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until the parts have `LEAF` characters at most, the parts are encoded by the library, and neighbours are joined up
the tree. At a join only a boundary window is encoded again: it doubles on each side of the seam until it holds a
point where the tokenizer's splitter must cut whatever stands further out - a character that is no white space
followed by white space: no word of the splitter holds both, and the splitter, which reads from left to right
without memory, goes on from there alike. The tokens outside are then provably those of the whole text, so the window is encoded only
once it has grown that far. Where no such point exists the window is the whole of that side. Joining is associative, so any tree gives the
same tokens. Decoding concatenates bytes up the tree.

The vocabulary is read from `vocabulary` (a .tiktoken file of ranks), which every executor must be able to open.

Edge cases: null text gives null tokens and null text; an empty text gives no tokens; texts without white space
and very long texts take larger windows; strings of special tokens are ordinary text; repeated rows are each
encoded; a null token, or an id that the vocabulary doesn't have, decodes to U+FFFD; an empty table gives no rows; other columns are ignored or pass.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, lists, text_udf

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
UNKNOWN = "\ufffd".encode()
_LAST = re.compile(r".*\S(?=[ \t\r\n])", re.S)
_FIRST = re.compile(r"\S(?=[ \t\r\n])")
_loaded: dict[str, "Bpe"] = {}


class Bpe:
    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("quarry", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.lengths = [len(x) for x in self.bytes]

    def leaf(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def _tail(self, text: str, lo: int, hi: int) -> int:
        """The last point in (lo, hi) where the splitter must cut, else lo."""
        w = 64
        while True:
            a = max(lo, hi - w)
            if m := _LAST.match(text, a, hi):
                return m.end()
            if a == lo:
                return lo
            w *= 2

    def _head(self, text: str, lo: int, hi: int) -> int:
        """The first such point in (lo, hi), else hi."""
        w = 64
        while True:
            b = min(hi, lo + w)
            if m := _FIRST.search(text, lo, b + 1 if b < hi else hi):
                return m.end()
            if b == hi:
                return hi
            w *= 2

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """Both are (from, to, tokens), next to each other in text."""
        lo, seam, a = left
        _, hi, b = right
        p, q = self._tail(text, lo, seam), self._head(text, seam, hi)
        drop, i = len(text[p:seam].encode("utf-8", "surrogatepass")), len(a)
        while drop > 0:
            i -= 1
            drop -= self.lengths[a[i]]
        skip, j = len(text[seam:q].encode("utf-8", "surrogatepass")), 0
        while skip > 0:
            skip -= self.lengths[b[j]]
            j += 1
        if drop or skip:  # not reached: forced cuts are always between tokens
            return lo, hi, self.leaf(text[lo:hi])
        return lo, hi, a[:i] + self.leaf(text[p:q]) + b[j:]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self.leaf(text)

        def tree(lo: int, hi: int) -> tuple:
            if hi - lo <= leaf:
                return lo, hi, self.leaf(text[lo:hi])
            mid = (lo + hi) // 2
            return self.join(text, tree(lo, mid), tree(mid, hi))

        return tree(0, len(text))[2]

    def decode(self, tokens, leaf: int = LEAF) -> bytes:
        if len(tokens) <= leaf:
            n = len(self.bytes)
            return b"".join([self.bytes[t] or UNKNOWN if t is not None and 0 <= t < n else UNKNOWN for t in tokens])
        mid = len(tokens) // 2
        return self.decode(tokens[:mid], leaf) + self.decode(tokens[mid:], leaf)


def bpe(vocabulary: str = VOCABULARY) -> Bpe:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Bpe(vocabulary)
    return _loaded[vocabulary]


def encoder(vocabulary: str = VOCABULARY):
    """Column function: text to array<int>."""

    def f(v: pa.Array) -> pa.Array:
        own = bpe(vocabulary)
        out = [None if t is None else np.array(own.encode(t), np.int32) for t in v.to_pylist()]
        n = [0 if t is None else len(t) for t in out]
        values = np.concatenate([t for t in out if t is not None] or [np.zeros(0, np.int32)])
        off = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=off[1:])
        return pa.ListArray.from_arrays(pa.array(off), pa.array(values), mask=pa.array([t is None for t in out], pa.bool_()))

    return text_udf(f, "array<int>")


def round_trip(vocabulary: str = VOCABULARY):
    """Column function: text to its tokens and the text decoded from them."""

    def f(v: pa.Array) -> pa.Array:
        own = bpe(vocabulary)
        tokens, texts, none = [], [], []
        for t in v.to_pylist():
            ids = own.encode(t) if t is not None else []
            tokens.append(np.array(ids, np.int32))
            texts.append(own.decode(ids) if t is not None else None)
            none.append(t is None)
        ids = lists(pa.array(np.concatenate([*tokens, np.zeros(0, np.int32)])), [len(t) for t in tokens])
        return pa.StructArray.from_arrays([ids, pa.array(texts, pa.binary()).cast(pa.string())], ["tokens", "decoded"], mask=pa.array(none, pa.bool_()))

    return text_udf(f, "struct<tokens: array<int>, decoded: string>")


def decoder(vocabulary: str = VOCABULARY):
    """Column function: array<int> to text; bytes that aren't UTF-8 become U+FFFD."""

    def f(v: pa.Array) -> pa.Array:
        own = bpe(vocabulary)
        return pa.array([None if t is None else own.decode(t).decode("utf-8", "replace") for t in v.to_pylist()], pa.string())

    f.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf("string")(f)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, n_tokens and the text decoded from the tokens."""
    x = hidden(docs, "x")
    df = docs.select(F.col("doc_id"), round_trip(vocabulary)("text").alias(x))
    return df.select("doc_id", F.col(f"{x}.tokens").alias("tokens"), F.when(F.col(f"{x}.tokens").isNotNull(), F.size(f"{x}.tokens")).alias("n_tokens"), F.col(f"{x}.decoded").alias("decoded"))

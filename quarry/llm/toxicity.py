"""Toxicity: non-negative positive-unlabelled learning.

A linear numpy classifier over hashed word and word-beginning features is trained from documents
confirmed to be toxic plus *unlabelled* text; labels of clean documents are never used. The risk is
the class-prior-corrected one with the non-negativity constraint (du Plessis 2014; Kiryo 2017):

    R(g) = prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

and where the second part of a mini-batch falls below zero its gradient is followed upwards. The
prior is the share of toxic rows among all rows of `labels` unless it is given.

Features are chosen by their document frequencies, counted over all confirmed and over all documents: the `keep` for which the former most
exceeds the latter, by a two-sample z of 3 at least, of those that `least` confirmed documents have. Only the weights of the chosen
ones are fitted on a bounded sample (`n_pos` confirmed documents and `n_unl` of all documents, those
with the smallest hash of doc_id), which is what bounds the driver's part; scoring covers all text of
all documents. A document is toxic when its score exceeds the model's threshold: the score that a share
`prior` of all documents exceeds, held between log-odds of -1 and 0. It comes from a histogram of all scores.

Edge cases: a null or empty text has no features, scores the bias and is never toxic; rows with a null
doc_id are scored like others; labels with null toxic or doc_id are ignored; an empty `labels` or no
toxic row gives a model that rejects nothing; repeated rows are each scored; extra columns pass. doc_id is an integer in both tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import docs_only, hidden, joined, lists, saved, text_udf

BITS = 18
DIM = 1 << BITS
#: Lengths in bytes of the word beginnings that are features besides whole words.
PREFIXES = (5, 7)


def _raw(data: np.ndarray, off: np.ndarray):
    """(document, feature) arrays of every word and of every long word's beginnings."""
    s, e, first = vec.words(data, off, True)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    for k, n in enumerate((None, *PREFIXES)):
        long = slice(None) if n is None else e - s > n
        h = vec.word_hashes(data, s[long], e[long] if n is None else s[long] + n)
        yield doc[long], (vec.mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each distinct feature of each text, both ascending; only: a mask of the
    features that matter."""
    x = np.unique(np.concatenate([((d << BITS) | f)[slice(None) if only is None else only[f]] for d, f in _raw(data, off)]))
    return x >> BITS, x & (DIM - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    prior: float
    #: Steps in which the negative part of the risk fell below zero and was climbed back.
    climbed: int = 0

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        d, f = features(data, off, self.weights != 0)
        return self.bias + np.bincount(d, self.weights[f], len(off) - 1)


def select(start: np.ndarray, feat: np.ndarray, is_pos: np.ndarray, keep: int, least: int) -> np.ndarray:
    """Features whose document frequency among confirmed rows most exceeds that among unlabelled
    ones (two-sample z), of those in `least` confirmed rows at least."""
    row_pos = np.repeat(is_pos, np.diff(start))
    return chosen_of(is_pos.sum(), (~is_pos).sum(), np.bincount(feat[row_pos], minlength=DIM), np.bincount(feat[~row_pos], minlength=DIM), keep, least)


def chosen_of(n1: int, n0: int, c1: np.ndarray, c0: np.ndarray, keep: int, least: int) -> np.ndarray:
    """The same from counts: confirmed and other documents, and those of either that have each feature."""
    n1, n0 = max(1, n1), max(1, n0)
    pool = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = (c1 / n1 - c0 / n0) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0))
    z[(c1 < least) | (z < 3)] = 0
    best = np.argsort(-z, kind="stable")[:keep]
    return best[z[best] > 0]


def _margin(w, b, rows, start, feat):
    """Margins of the rows, their features and the row of each."""
    n = (start[rows + 1] - start[rows]).astype(np.int64)
    base = np.repeat(start[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    f = feat[base + np.arange(n.sum())]
    of = np.repeat(np.arange(len(rows)), n)
    return b + np.bincount(of, w[f], len(rows)), f, of


#: Steps of the threshold between log-odds of -1 and 0.
CELLS = 4096


def train(start: np.ndarray, feat: np.ndarray, is_pos: np.ndarray, prior: float, keep: int = 1024, least: int = 5, epochs: int = 120, batch: int = 512, rate: float = 0.05, l2: float = 1e-4, seed: int = 7, chosen: np.ndarray | None = None) -> Model:
    """start, feat: features of row i are feat[start[i]:start[i+1]]; is_pos: confirmed rows, the
    others are unlabelled; chosen: the features to use, else select() says. Adagrad on mini-batches that hold both kinds in proportion."""
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(is_pos), np.flatnonzero(~is_pos)
    if chosen is None:
        chosen = select(start, feat, is_pos, keep, least)
    weights, climbed = np.zeros(DIM, np.float32), 0
    if not len(chosen) or not len(pos) or not len(unl):
        return Model(weights, -1.0, np.inf, prior)
    to = np.full(DIM, -1, np.int64)
    to[chosen] = np.arange(len(chosen))
    new = to[feat]
    lens = np.bincount(np.repeat(np.arange(len(start) - 1), np.diff(start))[new >= 0], minlength=len(start) - 1)
    feat, start = new[new >= 0], np.concatenate([[0], np.cumsum(lens)])
    w, g2, b, b2 = np.zeros(len(chosen)), np.full(len(chosen), 1e-8), -1.0, 1e-8
    sig = lambda z: 0.5 * (1 + np.tanh(0.5 * z))
    parts = max(1, -(-(len(pos) + len(unl)) // batch))
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(pos), parts), np.array_split(rng.permutation(unl), parts)):
            if not len(p) or not len(u):
                continue
            mp, fp, op = _margin(w, b, p, start, feat)
            mu, fu, ou = _margin(w, b, u, start, feat)
            negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
            sp, su = sig(mp), sig(mu)
            if negative >= 0:
                dp, du = prior * (sp - 1) / len(p) - prior * sp / len(p), su / len(u)
            else:  # the negative part over-fits: climb back, as the estimator demands
                dp, du = prior * sp / len(p), -su / len(u)
                climbed += 1
            grad = np.bincount(fp, dp[op], len(w)) + np.bincount(fu, du[ou], len(w)) + l2 * w
            g2 += grad * grad
            w -= rate * grad / np.sqrt(g2)
            gb = dp.sum() + du.sum()
            b2 += gb * gb
            b -= rate * gb / np.sqrt(b2)
    weights[chosen] = w
    at = float(np.quantile(_margin(w, b, unl, start, feat)[0], 1 - prior))
    return Model(weights, float(b), min(0.0, max(-1.0, at)), prior, climbed)


def counted(docs: DataFrame, toxic: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Confirmed documents, all documents, and how many of either have each feature: two numbers for each of DIM features, whatever the corpus."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, DIM + 1), np.int64)
        for b in vec.pieces(it, "text"):
            d, f = features(*vec.buffers(vec.lower(b.column("text"))))
            pos = np.asarray(b.column("pos"))
            total[1] += np.bincount(f, minlength=DIM + 1)
            total[0] += np.bincount(f[pos[d]], minlength=DIM + 1)
            total[:, DIM] += pos.sum(), len(pos)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["f", "pos", "n"])

    rows = joined(docs_only(docs, "doc_id", "text").where("text is not null"), toxic, "doc_id", "left").select(F.col("pos").isNotNull().alias("pos"), "text")
    t = rows.mapInArrow(run, "f int, pos long, n long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, DIM + 1), np.int64)
    out[:, np.asarray(t.column("f"))] = np.asarray(t.column("pos")), np.asarray(t.column("n"))
    return int(out[0, DIM]), int(out[1, DIM]), out[0, :DIM], out[1, :DIM]


def gathered(docs: DataFrame, toxic: DataFrame, n_pos: int, n_unl: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen features of the bounded training sample: (start, features, is confirmed)."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id")).where("doc_id is not null")
    first = lambda df, salt, n: df.distinct().orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n)
    sample = [(r[0], True) for r in first(toxic.select("doc_id"), "confirmed", n_pos).collect()] + [(r[0], False) for r in first(ids, "unlabelled", n_unl).collect()]
    if not sample or not len(chosen):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def f(v: pa.Array) -> pa.Array:
        only = np.zeros(DIM, bool)
        only[chosen] = True
        d, own = features(*vec.buffers(vec.lower(v)), only)
        return lists(pa.array(own.astype(np.int32)), np.bincount(d, minlength=len(v)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(spark.createDataFrame(sample, "doc_id long, pos boolean")), "doc_id").select("doc_id", "pos", text_udf(f, "array<int>")("text").alias("f")).toArrow()
    t = rows.sort_by([("pos", "descending"), ("doc_id", "ascending")])
    own = t.column("f").combine_chunks()
    n = np.asarray(pa.compute.list_value_length(own), np.int64) if len(t) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(n)]), np.asarray(own.flatten(), np.int64), np.asarray(t.column("pos"), bool)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, n_pos: int = 2500, n_unl: int = 5000, keep: int = 1024, least: int = 5) -> Model:
    """prior: the share of toxic documents; by default that of the rows of `labels`.
    n_pos, n_unl: bounds of the sample that the weights are fitted on."""
    if prior is None:
        prior = labels.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic").isNotNull(), 0.0))).first()[0] or 0.0
    toxic = saved(labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("pos", F.lit(True)), "confirmed")
    chosen = chosen_of(*counted(docs, toxic), keep, least)
    start, feat, pos = gathered(docs, toxic, n_pos, n_unl, chosen)
    model = train(start, feat, pos, min(max(float(prior), 1e-4), 0.9), chosen=chosen)
    return replace(model, threshold=decided(docs, model)) if np.isfinite(model.threshold) else model


def decided(docs: DataFrame, model: Model) -> float:
    """The (1 - prior) quantile of the scores of all documents, from -1 to 0, to the next of CELLS steps."""
    score = docs.where("text is not null").select(scored(model)("text").alias("score"))
    cell = F.least(F.greatest(F.floor((F.col("score") + 1) * CELLS), F.lit(-1)), F.lit(CELLS - 1))
    counts = sorted((r[0], r[1]) for r in score.groupBy(cell.cast("int").alias("cell")).count().collect())
    total, below = sum(n for _, n in counts), 0
    for c, n in counts:
        below += n
        if below >= (1 - model.prior) * total:
            return (c + 1) / CELLS - 1
    return model.threshold


def scored(model: Model):
    """The column function that gives the score of a text."""
    at = np.flatnonzero(model.weights)
    w, bias = model.weights[at], model.bias

    def f(v: pa.Array) -> pa.Array:
        weights = np.zeros(DIM, np.float32)
        weights[at] = w
        return pa.array(Model(weights, bias, 0.0, 0.0).scores(*vec.buffers(vec.lower(v))))

    return text_udf(f, "double")


def toxic_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """doc_id, score and the decision for every row of docs."""
    model = fit(docs, labels, **kw)
    return docs.select(F.col("doc_id"), scored(model)("text").alias("score")).withColumn("toxic", F.col("score") > F.lit(model.threshold))


def without_toxic(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs less the toxic rows; columns as they were."""
    model = fit(docs, labels, **kw)
    score = hidden(docs, "score")
    return docs.withColumn(score, scored(model)("text")).where(F.col(score) <= F.lit(model.threshold)).drop(score)

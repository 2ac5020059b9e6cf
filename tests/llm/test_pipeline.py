import numpy as np
import pyarrow as pa

import corpus_pipeline
from quarry.llm import bpe, decontaminate, simhash_dedup, toxicity, vec
from quarry.llm.common import saved
from tests.conftest import SMALL

from . import brute


def test_run_equals_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").select("doc_id", "text").collect()}
    model = toxicity.fit(read("documents"), read("labels"))
    score = {i: model.scores(*vec.buffers(vec.lower(pa.array([t]))))[0] for i, t in docs.items()}
    left = [(i, t) for i, t in sorted(docs.items()) if score[i] <= model.threshold]
    assert 0 < len(left) < len(docs)
    left = brute.line_dedup(left)
    prints = np.concatenate([simhash_dedup.fingerprints(*vec.buffers(vec.lower(pa.array([t])))) for _, t in left])
    root, _ = brute.near_groups(prints, simhash_dedup.MAX_BITS)
    left = [x for k, x in enumerate(left) if root[k] == k]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    left = [(i, brute.without(t, brute.contaminated(t, items, decontaminate.MIN_WORDS, decontaminate.MAX_WORDS, decontaminate.COVERAGE))) for i, t in left]
    b = bpe.bpe()
    got = {r.doc_id: (r.tokens, r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {i: (b.leaf(t), len(b.leaf(t)), t) for i, t in left}


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_stages_with_odd_rows(spark):
    long = " ".join(f"w{k % 4999}" for k in range(30_000))
    texts = [None, "", "", " \n\n ", "one", "same line\nsecond line\nthird line\nfourth", "same line\nsecond line\nthird line\nfourth", long, long + " more", "é日本語 ünï—cödé", "x" * 70_000]
    rows = [(i, t, None if i % 2 else "de", None, None if t is None else len(t)) for i, t in enumerate(texts)] + [(4, "one", "en", "s", 3), (4, "another text of four", "en", "s", 20), (None, "no id", None, None, 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, SMALL))
        n = out.count()
        assert out.columns == docs.columns and n <= kept and out.where("n_chars <> length(text)").isEmpty()
        assert out.where("doc_id is null").count() == 2 and out.where("doc_id = 0 and text is null").count() == 1  # nothing is known about them: they stay
        docs, kept = out, n
    assert {(4, "another text of four"), (9, texts[9])} <= {(r.doc_id, r.text) for r in docs.collect()}
    want = sorted((repr(r.doc_id), repr(r.text)) for r in docs.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted((repr(r.doc_id), repr(r.decoded)) for r in got) == want
    assert all((r.tokens is None) == (r.decoded is None) == (r.n_tokens is None) for r in got)


def test_near_stage_does_not_count_its_rows(spark, monkeypatch):
    """What stays is the same for any number of fingerprints that a search might go by, and no search is asked for by number."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(300):
        ws = rng.integers(0, 30_000, 150)
        texts += [ws, np.where(rng.random(150) < 0.17, rng.integers(0, 30_000, 150), ws)]
    docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in ws)) for i, ws in enumerate(texts)], "doc_id long, text string")
    asked = []
    monkeypatch.setattr(simhash_dedup, "design", lambda n: asked.append(n) or simhash_dedup.LONG, raising=False)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SMALL).count()
    assert not asked and 300 <= kept < 600


def test_near_stage_spreads_a_fingerprint_to_few_rows():
    how = getattr(simhash_dedup, "DESIGN", simhash_dedup.SHORT)
    f = np.random.default_rng(13).integers(0, 2**63, (500, 4), dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), *[pa.array(f[:, k]) for k in range(4)]], ["node", "f0", "f1", "f2", "f3"])
    assert sum(b.num_rows for b in simhash_dedup.replicas(how)(iter([batch]))) <= 75 * 500

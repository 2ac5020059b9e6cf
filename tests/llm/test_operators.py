import gzip
import io
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, exact_dedup, html_text, line_dedup, simhash_dedup, substring_dedup, suffix_dedup, toxicity, vec, warc
from tests.conftest import MIDDLE, SMALL, rows, sql_rows

from . import brute

CLASH = "doc_id long, text string, n_chars long, th long, score double, gone string, lines int, kept int, found int, x int, k int, node int, key int, wanted int"
BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def table(spark, data):
    """Documents with every column name that an operator might want for itself."""
    return spark.createDataFrame([(i, t, None if t is None else len(t), 1, 0.5, "g", 2, 3, 4, 5, 6, 7, 8, 9) for i, t in data], CLASH)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    long = " ".join(words(rng, 40_000))
    lines = "first line here\nsecond line here\nthird line here\nfourth line here"
    return [(1, None), (2, ""), (3, ""), (4, "one"), (5, long), (6, long), (None, "lost id"), (None, None), (7, lines), (8, lines + "\nmore"), (9, "same"), (9, "same"), (9, "other"), (10, "x" * 70_000), (11, "  \n\n \n"), (12, "é日本語 ünï—cödé")]


# 1


PAGES = "page_id long, url string, html string, path string, status string"


def test_warc_round_trip(spark):
    data = [(1, "http://a/", "<p>x</p>", "p", "s"), (1, "http://a/", "<p>x</p>", "p", "s"), (2, None, "", "p", "s"), (None, "http://b/", None, "p", "s"), (3, "http://c/é", "<b>日本</b>" * 50_000, None, None)]
    got = warc.read_back(spark.createDataFrame(data, PAGES))
    assert rows(got, "page_id", "url", "html") == sorted((r[:3] for r in data), key=repr)
    assert rows(warc.read_back(spark.createDataFrame([], PAGES))) == []


def test_warc_packages(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>" * i) for i in range(50)]

    def write(name, **kw):
        with open(tmp_path / name, "wb") as f:
            warc.package(pages, f, **kw)

    write("plain.wacz")
    write("walked.wacz", index=False)
    write("packed.wacz", compressed=True)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    write("big.wacz", zip64=True)
    (tmp_path / "no.wacz").write_bytes(b"PK\x05\x06 nothing")
    (tmp_path / "empty.wacz").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "bad.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", warc.record(1, "u", "h") + b"junk")
        z.writestr("indexes/i.cdxj", '{"offset": "0", "length": "99999", "filename": "a.warc.gz"}\nnonsense\n{"offset": "5", "length": "9", "filename": "a.warc.gz"}')
    names = ["plain", "walked", "packed", "big", "no", "empty", "bad"]
    found = warc.located(spark.createDataFrame([(f"file://{tmp_path}/{n}.wacz",) for n in names] + [(None,)], "path string"))
    got = warc.records(found)
    per = {n: sorted((r.page_id, r.url, r.html) for r in warc.pages_of(got.where(F.col("path").endswith(f"/{n}.wacz"))).collect()) for n in names}
    assert per["plain"] == per["walked"] == per["big"] == sorted(pages)
    status = {(r.path.split("/")[-1], r.status) for r in got.where("status <> 'ok'").collect()}
    assert status == {("packed.wacz", "compressed"), ("no.wacz", "not a zip"), ("empty.wacz", "not a zip"), ("bad.wacz", "bad index"), ("bad.wacz", "bad record"), ("bad.wacz", "not in index")}
    assert not per["packed"] and gzip.decompress(warc.record(1, "u", "h")).startswith(b"WARC/1.1")
    with zipfile.ZipFile(tmp_path / "big.wacz") as z, open(tmp_path / "big.wacz", "rb") as f:
        assert {m[0] for m in warc.directory(f, (tmp_path / "big.wacz").stat().st_size)} == set(z.namelist())


# 2


def test_html(spark):
    para = "The committee met again on Tuesday to discuss the plan for the new bridge, and after a long debate it agreed on most of the points. "
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a><ul>" + "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(9)) + f"</ul></nav><h1>A new bridge</h1><p>{para * 2}</p><p>{para * 3} A &amp; B</p><script>var x = '<p>no</p>';</script><div><a>Terms</a> <a>Privacy</a></div></body></html>"
    data = [(1, page), (1, page), (2, None), (3, ""), (4, "<p>unclosed <b>bold"), (5, "<div>" * 20_000 + para * 9), (6, "<a href=\"<p>" + "x" * 1000), (7, "<!-- " + para)]
    got = {r.page_id: r for r in html_text.extracted(spark.createDataFrame([(*r, 1) for r in data], "page_id long, html string, text int")).collect()}
    assert para.strip()[:60] in got[1].text and "A & B" in got[1].text and "Topic" not in got[1].text and "Privacy" not in got[1].text and "no" not in got[1].text.split()
    assert got[2].text is None and got[2].blocks == 0 and got[3].text == "" and got[4].blocks == 1 and len(got[5].text) > 900 and got[7].blocks == 0
    assert html_text.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_tree_holds_out():
    t = np.array(html_text.LABELLED, float)
    x, y = t[:, :6].copy(), t[:, 6]
    x[:, 3:] /= 100
    hits = 0
    for k in range(5):
        held = np.arange(len(y)) % 5 == k
        hits += (html_text.classified(html_text.grown(x[~held], y[~held]), x[held]) == y[held]).sum()
    assert hits / len(y) > 0.85
    assert (html_text.classified(html_text.trained(), x) == y).mean() > 0.95
    assert html_text.described([]).shape == (0, 6) and html_text.described([("a", 2, 1)]).tolist() == [[0, 2, 0, 0, 0.5, 0]]


# 3 and 5


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(5)
    shared = [words(rng, n) for n in (49, 50, 51, 80, 300)]
    docs = []
    for i in range(60):
        ws = words(rng, rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(shared)[rng.randrange(3) :]
        docs.append((i * 3, " ".join(ws) if i % 2 else "\n".join(ws)))
    docs += [(500, "la la " * 200), (501, "la la " * 150), (502, " ".join(shared[4] + shared[4]))]
    return docs


@pytest.mark.parametrize("op", [suffix_dedup, substring_dedup])
def test_repeats(spark, copied, op):
    f = op.suffix_dedup if op is suffix_dedup else op.substring_dedup
    want = brute.repeats(copied, 50)
    got = {r.doc_id: (tuple(map(tuple, r.repeated)), tuple(map(tuple, r.removed)), r.text) for r in f(table(spark, copied)).collect()}
    assert {i: g[:2] for i, g in got.items()} == want
    for i, t in copied:
        if i in got:
            at = [(m.start(), m.end()) for m in brute.WORDS.finditer(t.encode())]
            assert got[i][2] == brute.without(t, [(at[a][0], at[b - 1][1]) for a, b in want[i][1]])


@pytest.mark.parametrize("f", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_repeats_odd(spark, odd, f):
    got = {r.doc_id: r for r in f(table(spark, odd)).collect()}
    assert set(got) == {5, 6} and got[5].removed == [] and got[6].text.strip() == "" and [tuple(x) for x in got[5].repeated] == [(0, 40_000)]
    assert f(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
@pytest.mark.parametrize("alphabet", [1, 2, 5])
def test_columnwise_construction(tmp_path, alphabet, block, monkeypatch):
    rng = np.random.default_rng(alphabet)
    n = rng.integers(1, 12, 30)
    symbols = rng.integers(1, alphabet + 1, n.sum())
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    parts = list(suffix_dedup.construct(symbols, n, f"file://{tmp_path}"))
    got = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
    assert all(len(x["key"]) <= block for x in parts)
    texts = [symbols[b : b + k].tolist() for b, k in zip(base, n)]
    order = sorted(((t[len(t) - k :], w, k) for w, t in enumerate(texts) for k in range(len(t) + 1)), key=lambda s: (s[0], s[1]))
    # at equal suffixes the documents' end marks decide, in the order of the documents
    assert list(zip(got["win"].tolist(), got["len"].tolist())) == [(w, k) for _, w, k in order]
    for r, (s, w, k) in enumerate(order):
        t = texts[w]
        assert got["bwt"][r] == (t[len(t) - k - 1] if k < len(t) else 0)
        if r:
            p = order[r - 1][0]
            assert got["lcp"][r] == next((i for i, (a, b) in enumerate(zip(p, s)) if a != b), min(len(p), len(s)))
    assert not list(tmp_path.iterdir())


def test_against_reference(spark, monkeypatch):
    rng = random.Random(2)
    ref = [words(rng, 90) for _ in range(4)]
    docs = [(1, " ".join(words(rng, 20) + ref[0][10:70] + words(rng, 9))), (2, " ".join(ref[1][:49])), (3, None), (4, " ".join(ref[2] + ref[3]))]
    reference = spark.createDataFrame([(" ".join(r),) for r in ref] + [(None,)], "text string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substring_dedup.against_reference(table(spark, docs), reference).collect()}
    assert got == {1: [(20, 80)], 4: [(0, 180)]}
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)  # six shards for four texts
    cut = {r.doc_id: [tuple(x) for x in r.removed] for r in substring_dedup.against_reference(table(spark, docs + docs[:1]), reference).collect()}
    assert cut == got
    assert substring_dedup.against_reference(table(spark, docs), reference.limit(0)).count() == 0


# 4


def test_toxicity_holds_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = toxicity.toxic_documents(docs, labels.where(seen)).join(labels.where(~seen).withColumnRenamed("toxic", "y"), "doc_id").groupBy("y", "toxic").count().collect()
    n = {(r.y, r.toxic): r["count"] for r in got}
    tp, fp, fn = n.get((1, True), 0), n.get((0, True), 0), n.get((1, False), 0)
    assert tp / (tp + fp) > 0.8 and tp / (tp + fn) > 0.8, n  # half the labels of a small table


def test_toxicity_odd(spark, odd):
    docs = table(spark, odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, none).count() == len(odd)
    some = spark.createDataFrame([(4, 0, 1), (None, 0, 1), (5, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxic_documents(docs, some)
    assert got.count() == len(odd) and got.where("toxic and doc_id in (1, 2, 3)").count() == 0
    assert toxicity.without_toxic(docs, some).columns == docs.columns
    assert toxicity.without_toxic(table(spark, []), some).count() == 0


def test_risk_is_non_negative_corrected():
    rng = np.random.default_rng(0)
    pos = np.arange(800) < 200
    feats = [np.unique(np.r_[rng.integers(0, 900, 8), 1000 + rng.integers(0, 3, 3)]) if p or i % 5 == 0 else rng.integers(0, 900, 8) for i, p in enumerate(pos)]
    start = np.concatenate([[0], np.cumsum([len(f) for f in feats])])
    m = toxicity.train(start, np.concatenate(feats), pos, 0.2)
    assert (m.weights[1000:1003] > 0).all()
    assert m.climbed == 0 < toxicity.train(start, np.concatenate(feats), pos, 0.6).climbed  # with too large a prior the negative part falls below zero
    hit = np.array([m.bias + m.weights[f].sum() > m.threshold for f in feats])
    toxic = pos | (np.arange(800) % 5 == 0)  # a fifth of the unlabelled rows are toxic as well
    assert hit[toxic].mean() > 0.9 and hit[~toxic].mean() < 0.1


# 6


def test_exact(spark, odd):
    got = exact_dedup.exact_duplicates(table(spark, odd)).collect()
    want = brute.exact(odd)
    assert sorted(r.copies for r in got) == sorted([len(g) for g in want for _ in g] + [1, 1])
    assert {(r.doc_id, r.group_id, r.copies) for r in got if r.copies > 1} == {(i, g[0], len(g)) for g in want if len(g) > 1 for i in g}
    assert sum(r.duplicate for r in got) == sum(len(g) - 1 for g in want)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_exact_survives_equal_hashes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef") for _ in range(9000)) for _ in range(3)]
    docs = [(i, texts[i % 3]) for i in range(6)] + [(9, "short"), (10, "shirt")]

    def weak(d):
        r = exact_dedup.recipes(d)
        same = F.struct(F.transform("r.h", lambda h: F.lit(7).cast("long")).alias("h"), F.transform("r.n", lambda n: F.lit(0) + n).alias("n"))
        return r.withColumn("r", same).withColumn("key", F.size("r.h").cast("long"))

    got = exact_dedup.exact_duplicates(table(spark, docs), weak).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(i, i % 3) for i in range(6)} | {(9, 9), (10, 10)}


# 7


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet=" \n\tab'1é日!", max_size=400), st.integers(1, 9))
def test_bpe_tree_equals_whole(text, leaf):
    text = text.encode("utf-8", "ignore").decode()
    b = bpe.bpe(BPE)
    ids = b.encode(text, leaf)
    assert ids == b.leaf(text) and b.decode(ids, 3) == text.encode()


def test_bpe(spark, odd):
    got = bpe.encoded(table(spark, odd), BPE).collect()
    b = bpe.bpe(BPE)
    assert sorted((repr((r.doc_id, r.tokens, r.decoded)) for r in got)) == sorted(repr((i, None if t is None else b.leaf(t), t)) for i, t in odd)
    ids = spark.createDataFrame([([64, 65],), ([],), (None,), ([255],), ([64, -1, 10**9, None, 65],)], "t array<int>").select(bpe.decoder(BPE)("t")).collect()
    assert ids[1][0] == "" and ids[2][0] is None and ids[4][0] == ids[0][0][:1] + "\ufffd" * 3 + ids[0][0][1:]


# 8


def test_contaminated(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((40, 30, 16, 12, 8, 7))] + [(6, None), (None, "a b c d e f g h i j"), (7, "")]
    w = {i: t.split() for i, t in items if t}
    noise = lambda n: words(rng, n)
    docs = [
        (1, " ".join(noise(20) + w[0][5:25] + noise(20))), (2, " ".join(noise(9) + w[0][5:15] + noise(9))), (3, "  ".join(x.upper() + "," for x in noise(5) + w[2][:9] + noise(5))),
        (4, " ".join(w[4])), (5, " ".join(noise(3) + w[5] + noise(4))), (6, " ".join(noise(3) + w[1][:8] + noise(2) + w[1][15:23] + noise(4))), (7, None), (8, ""), (9, " ".join(w[3][:11] + w[0][20:40])),
    ]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, found int")
    df = table(spark, docs)
    want = {i: brute.contaminated(t, [x for x in items if x[0] is not None and x[1]], 8, 13, 0.5) for i, t in docs if t}
    assert want[5]
    got = {r.doc_id: r for r in decontaminate.contaminated(df, bench).collect()}
    assert {i: [(s.s, s.e) for s in r.spans] for i, r in got.items()} == {i: v for i, v in want.items() if v}
    assert set(got) == {1, 3, 4, 5, 6, 9}
    clean = {r.doc_id: r for r in decontaminate.decontaminated(df, bench).collect()}
    for i, t in docs:
        assert clean[i].text == (brute.without(t, want[i]) if t else t) and (t is None or clean[i].n_chars == len(clean[i].text))
        if i in got:
            assert got[i].text == clean[i].text
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == len(docs) and decontaminate.contaminated(table(spark, []), bench).count() == 0


# 9


@pytest.fixture(scope="module")
def near():
    rng = random.Random(9)
    docs, i = [], 0
    for _ in range(150):
        ws = words(rng, rng.randrange(80, 300), 20_000)
        for c in range(rng.choice((1, 1, 2, 5))):
            own = [w if not c or rng.random() > 0.04 else f"w{rng.randrange(20_000)}" for w in ws]
            docs.append((i, " ".join(own)))
            i += 1
    return docs


def test_near_recall(spark, near):
    prints = simhash_dedup.fingerprints(*vec.buffers(vec.lower(pa.array([t for _, t in near]))))
    roots, want = brute.near_groups(prints, simhash_dedup.MAX_BITS)
    points = simhash_dedup.fingerprinted(table(spark, near))
    of = {r.node: r.doc_id for r in points.collect()}
    for how in (simhash_dedup.SHORT, simhash_dedup.LONG):
        got = {tuple(sorted((of[r.a], of[r.b]))) for r in simhash_dedup.near_pairs(points, how=how).collect()}
        assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 100
    groups = {r.doc_id: r.group_id for r in simhash_dedup.near_duplicates(table(spark, near)).collect()}
    assert sum(groups.get(i, i) == r for i, r in enumerate(roots)) >= 0.98 * len(roots)


@pytest.mark.parametrize("how, bits, least", [(simhash_dedup.SHORT, 21, 1), (simhash_dedup.SHORT, 36, 0.99), (simhash_dedup.SHORT, 42, 0.98), (simhash_dedup.LONG, 42, 0.99)])
def test_points_at_the_limit_meet(how, bits, least):
    rng = np.random.default_rng(bits)
    f = rng.integers(0, 256, (1500, 32), dtype=np.uint8)
    g = np.unpackbits(f, axis=1)
    for row in g:
        row[rng.permutation(256)[:bits]] ^= 1
    both = np.concatenate([f, np.packbits(g, axis=1)]).view(np.uint64)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), *[pa.array(both[:, k].view(np.int64)) for k in range(4)]], ["node", *simhash_dedup._LONGS])
    spread = pa.Table.from_batches(simhash_dedup.replicas(how)(iter([rows]))).sort_by("anchor")
    got = set()
    for b in simhash_dedup.met(how, bits)(iter(spread.to_batches(5000))):
        got |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    assert got <= {(i, i + 1500) for i in range(1500)} and len(got) >= least * 1500


@pytest.mark.parametrize("step, rows", [(1, 1), (5, 3), (50, 7), (10**6, 10**6)])
def test_anchors_are_whole_however_they_are_streamed(monkeypatch, step, rows):
    rng = np.random.default_rng(3)
    bits = np.repeat(rng.integers(0, 2, (12, 256), dtype=np.uint8), 12, 0)
    for row in bits:
        row[rng.permutation(256)[:9]] ^= 1
    f = np.packbits(bits, axis=1).view(np.uint64)
    points = pa.RecordBatch.from_arrays([pa.array(np.arange(len(f))), *[pa.array(f[:, k].view(np.int64)) for k in range(4)]], ["node", *simhash_dedup._LONGS])
    how = simhash_dedup.Design((15, 7), 3)
    spread = pa.Table.from_batches(simhash_dedup.replicas(how)(iter([points]))).sort_by("anchor").combine_chunks()
    run = lambda n: {(a, b) for x in simhash_dedup.met(how, 42)(iter(spread.to_batches(n))) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
    want = run(10**6)
    monkeypatch.setattr(simhash_dedup, "STEP", step)
    assert run(rows) == want and len(want) > 100


def test_hot_key_is_linked_without_all_pairs():
    rng = np.random.default_rng(4)
    center = rng.integers(0, 256, (1, 32), dtype=np.uint8)
    bits = np.repeat(np.unpackbits(center, axis=1), 600, 0)
    for i, row in enumerate(bits):  # one key; two clusters, some points between them
        row[(30 + rng.permutation(100)[:12]) if i < 300 else 130 + rng.permutation(100)[:12]] ^= 1
        if i >= 300:
            row[30:60] ^= 1
    f = np.packbits(bits, axis=1).view(np.uint64)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), *[pa.array(f[:, k].view(np.int64)) for k in range(4)]], ["node", *simhash_dedup._LONGS])
    how = simhash_dedup.Design((15, 7), 1)
    spread = pa.Table.from_batches(simhash_dedup.replicas(how)(iter([rows]))).sort_by("anchor")
    pairs = {(a, b) for x in simhash_dedup.met(how, 42)(iter(spread.to_batches())) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
    roots, want = brute.near_groups(f, 42)
    assert pairs <= want and len(pairs) < 10_000 < len(want)
    root = list(range(600))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(600)] == roots


def spread_points(f, how):
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(f))), *[pa.array(f[:, k].view(np.int64)) for k in range(4)]], ["node", *simhash_dedup._LONGS])
    return pa.Table.from_batches(simhash_dedup.replicas(how)(iter([rows]))).sort_by("anchor")


def test_few_pairs_are_compared(monkeypatch):
    """Anchors keep few points: else the work of near_pairs grows with the square of a table."""
    how = getattr(simhash_dedup, "DESIGN", simhash_dedup.SHORT)
    f, n, apart = np.random.default_rng(6).integers(0, 2**63, (6000, 4), dtype=np.uint64), [], simhash_dedup.apart
    monkeypatch.setattr(simhash_dedup, "apart", lambda f, x, y, most: n.append(len(x)) or apart(f, x, y, most))
    for _ in simhash_dedup.met(how, 42)(iter(spread_points(f, how).to_batches(5000))):
        pass
    assert 0 < sum(n) < 0.0005 * 6000**2 / 2


@pytest.mark.parametrize("bits, least", [(21, 1), (36, 0.999), (42, 0.99)])
def test_points_meet_once(bits, least):
    rng = np.random.default_rng(bits)
    f = rng.integers(0, 256, (1500, 32), dtype=np.uint8)
    g = np.unpackbits(f, axis=1)
    for row in g:
        row[rng.permutation(256)[:bits]] ^= 1
    both = np.concatenate([f, np.packbits(g, axis=1)]).view(np.uint64)
    how = simhash_dedup.DESIGN
    got = [x for b in simhash_dedup.met(how, bits)(iter(spread_points(both, how).to_batches(5000))) for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    assert set(got) <= {(i, i + 1500) for i in range(1500)} and len(set(got)) == len(got) >= least * 1500


def test_pairs_do_not_depend_on_the_size(spark, monkeypatch):
    rng = np.random.default_rng(11)
    f = np.unpackbits(rng.integers(0, 256, (1500, 32), dtype=np.uint8), axis=1)
    g = f.copy()
    for row in g:
        row[rng.permutation(256)[:42]] ^= 1
    both = np.packbits(np.concatenate([f, g]), axis=1).view(np.int64)
    points = spark.createDataFrame([(i, *row) for i, row in enumerate(both.tolist())], "node long, f0 long, f1 long, f2 long, f3 long")
    run = lambda df: {(r.a, r.b) for r in simhash_dedup.near_pairs(df).collect()}
    want = run(points)
    monkeypatch.setattr(simhash_dedup, "POINTS", 100, raising=False)  # such a number once chose the search
    assert run(points) == want and len(want) > 1400
    assert run(points.where("node % 1500 < 70")) == {(a, b) for a, b in want if a < 70}


def test_hot_keys_of_far_points_are_linked():
    """One key for all, clusters of two to nine: links join what all pairs would."""
    rng, bits = np.random.default_rng(8), []
    for k in range(60):
        center = rng.integers(0, 2, 256, dtype=np.uint8)
        for _ in range(2 + k % 8):
            bits.append(center.copy())
            bits[-1][rng.permutation(256)[:25]] ^= 1
    f = np.packbits(np.array(bits)[rng.permutation(len(bits))], axis=1).view(np.uint64)
    roots, want = brute.near_groups(f, 42)
    root, every = list(range(len(f))), np.arange(len(f))
    for x, y, _ in simhash_dedup.linked(f, every, every, 42):
        for a, b in zip(x.tolist(), y.tolist()):
            assert a == b or (min(a, b), max(a, b)) in want
            a, b = min(root[a], root[b]), max(root[a], root[b])
            root = [a if r == b else r for r in root]
    assert root == roots and len(want) > 50


def test_near_odd(spark, odd):
    got = {(r.doc_id, r.group_id, r.group_size) for r in simhash_dedup.near_duplicates(table(spark, odd)).collect()}
    prints = simhash_dedup.fingerprints(*vec.buffers(vec.lower(pa.array([dict(odd)[i] for i in (7, 8)]))))
    near = np.bitwise_count(prints[0] ^ prints[1]).sum() <= simhash_dedup.MAX_BITS
    assert got == {(2, 2, 2), (3, 2, 2), (5, 5, 2), (6, 5, 2), (9, 9, 2)} | ({(7, 7, 2), (8, 7, 2)} if near else set())
    df = table(spark, odd)
    kept = simhash_dedup.without_near_duplicates(df)
    ids = sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null and text is not null").collect())
    assert kept.columns == df.columns and kept.where("doc_id is null or text is null").count() == 3
    assert [i for i, _ in ids if i in (2, 3, 5, 6, 9)] == [2, 5, 9, 9] and ids.count((9, "same")) == 1
    assert simhash_dedup.without_near_duplicates(table(spark, [])).count() == 0


def test_covering():
    for n, r in ((15, 4), (7, 3)):
        t = simhash_dedup.near(n)
        assert len(set(t[:, 0].tolist())) == 2 ** (n - r) and t.shape[1] == (n + 1) // 2
        for x in range(0, 1 << n, 37):  # a point one bit off has its home among the anchors reached
            assert np.bitwise_count(x ^ t[x, 0]) <= 1
            for b in range(n):
                assert t[x ^ (1 << b), 0] in t[x]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# 10


def test_lines(spark, odd):
    rng = random.Random(10)
    parts = [[f"line {rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30))] for _ in range(12)]
    docs = [(i, "\n".join(x for p in rng.sample(parts, 3) for x in [f"own {i} {rng.random()}"] + p)) for i in range(30)]
    docs += [(i + 100, t) for i, t in odd if i not in (None, 9)] + [(None, docs[0][1])]
    want = sorted(map(repr, brute.line_dedup(docs)))
    got = line_dedup.line_dedup(table(spark, docs))
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == want
    assert got.columns == CLASH.replace(",", "").split()[::2] and got.where("n_chars <> length(text)").count() == 0
    weak = line_dedup.line_dedup(table(spark, docs), key=lambda c: F.length(c).cast("long"))
    assert sorted(repr((r.doc_id, r.text)) for r in weak.collect()) == want
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


# kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab \n\té日", max_size=20), max_size=8))
def test_words(texts):
    texts = [t for t in texts]
    data, off = vec.buffers(pa.array(texts, pa.string()))
    s, e, first = vec.words(data, off)
    got = [[bytes(data[a:b]) for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [brute.WORDS.findall((t or "").encode()) for t in texts]
    h = vec.word_hashes(data, s, e, 4)
    flat = [w for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and (h == vec.word_hashes(data, s, e)).all()


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 60).astype(np.uint64)
    for w in (1, 2, 7, 41):
        assert vec.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(60 - w + 1)]


# queries


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_queries_with_sql(spark, folder):
    from quarry.llm import queries

    for name, sql in queries.ORACLES.items():
        assert rows(queries.QUERIES[name](spark, folder)) == sql_rows(sql, folder), name


def test_stream_writes_in_memory():
    f = io.BytesIO()
    warc.package([], f)
    assert warc.directory(f, len(f.getvalue()))

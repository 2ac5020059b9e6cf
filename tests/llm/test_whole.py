"""Cases in which an operator did less than the whole job."""

import html.parser
import random
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import common, decontaminate, exact_dedup, html_text, line_dedup, substring_dedup, suffix_dedup, toxicity, vec, warc
from quarry.llm.common import saved
from tests.conftest import SMALL, rows

from . import brute
from .test_operators import table, words


def repeats_by_text(docs, length):
    """(doc_id, text) -> (repeated, removed); a doc_id may have several texts."""
    grams, where = {}, {}
    for i, t in docs:
        ws = brute.WORDS.findall(t.encode())
        where[i, t] = [tuple(ws[k : k + length]) for k in range(len(ws) - length + 1)]
        for g in where[i, t]:
            grams.setdefault(g, set()).add(i)
    out = {}
    for (i, t), gs in where.items():
        rep = [(k, k + length) for k, g in enumerate(gs) if len(grams[g]) > 1]
        if rep:
            out[i, t] = (brute.joined(rep), brute.joined([(k, k + length) for k, g in enumerate(gs) if min(grams[g]) < i]))
    return out


@pytest.mark.parametrize("f", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_repeats_of_several_texts_of_one_doc_id(spark, f):
    rng = random.Random(11)
    p, q, r = words(rng, 120), words(rng, 120), words(rng, 70)
    docs = [(9, p + words(rng, 40)), (9, q + words(rng, 300) + r), (9, words(rng, 55)), (10, words(rng, 30) + p), (11, q + words(rng, 20)), (4, r + words(rng, 9)), (12, words(rng, 7) + q[:60])]
    docs = [(i, " ".join(ws)) for i, ws in docs] + [(9, "a short one")]
    want = repeats_by_text(docs, 50)
    got = f(table(spark, docs)).collect()
    assert sorted((r.doc_id, tuple(map(tuple, r.repeated)), tuple(map(tuple, r.removed))) for r in got) == sorted((i, *v) for (i, _), v in want.items())
    left = []
    for (i, t), (_, gone) in want.items():
        at = [(m.start(), m.end()) for m in brute.WORDS.finditer(t.encode())]
        left.append((i, brute.without(t, [(at[a][0], at[b - 1][1]) for a, b in gone])))
    assert sorted((r.doc_id, r.text) for r in got) == sorted(left)


def contaminated(text, items, least, most, coverage):
    """(from, to, item): each item compared with the text by itself, quadratically."""
    ws = brute.normal_words(text)
    own = [w for w, _, _ in ws]
    found = set()
    for i, t in items:
        its = [w for w, _, _ in brute.normal_words(t)]
        runs, cover = [], set()
        for a in range(len(own)):
            for k in range(len(its)):
                if a and k and own[a - 1] == its[k - 1]:
                    continue
                n = 0
                while a + n < len(own) and k + n < len(its) and own[a + n] == its[k + n]:
                    n += 1
                if n >= least:
                    runs.append((a, a + n))
                    cover.update(range(k, k + n))
        found.update((a, b, i) for a, b in runs if b - a >= most or len(cover) >= coverage * len(its))
    keep = [x for x in found if not any(o[0] <= x[0] and x[1] <= o[1] and (o[:2] != x[:2] or o[2] < x[2]) for o in found)]
    return sorted((ws[a][1], ws[b - 1][2], i) for a, b, i in keep)


def test_every_item_is_credited_whatever_the_parts(spark, monkeypatch):
    rng = random.Random(13)
    big, other, template = words(rng, 100), words(rng, 60), words(rng, 9)
    items = [(1, big), (2, big[40:50]), (3, template + words(rng, 31)), (4, template + words(rng, 3)), (5, other), (6, big[90:] + other[:3] + words(rng, 20)), (7, big[:8] + other[:8] + words(rng, 8)), (8, big), (9, big[:28] + words(rng, 30))]
    items += [(k, words(rng, 40)) for k in range(20, 30)]
    noise = lambda n: words(rng, n)
    docs = [
        noise(9) + big[40:50] + noise(9), noise(4) + template + noise(5), noise(2) + big[60:69] + noise(9), noise(3) + big[88:] + other[:20] + noise(5),
        big[:8] + noise(3) + other[:8] + noise(2), noise(5) + items[9][1][:20] + items[10][1][:14], noise(3) + big[5:40] + noise(6), big[39:51] + noise(3) + template, noise(40),
    ]
    docs += [sum((rng.choice(items)[1][(a := rng.randrange(20)) : a + rng.randrange(6, 25)] + noise(rng.randrange(2)) for _ in range(6)), []) for _ in range(60)]
    docs = [(i, " ".join(ws)) for i, ws in enumerate(docs)]
    items = [(i, " ".join(ws)) for i, ws in items]
    want = {i: v for i, t in docs if (v := contaminated(t, items, 8, 13, 0.5))}
    assert {0, 1, 3, 4, 7} < set(want) and not {2, 8} & set(want)
    bench, df = spark.createDataFrame(items, "item_id long, text string"), table(spark, docs)
    for size in (decontaminate.PART_BYTES, 900):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        got = {r.doc_id: r for r in decontaminate.contaminated(df, bench).collect()}
        assert {i: [(s.s, s.e, s.item) for s in r.spans] for i, r in got.items()} == want
        clean = {r.doc_id: r.text for r in decontaminate.decontaminated(df, bench).collect()}
        assert clean == {i: brute.without(t, [x[:2] for x in want.get(i, [])]) for i, t in docs}


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>T</title><meta charset=x><body><p>one two</p></html>", ["one two"]),
        ("<head><title>T</title><style>p {}</style><script>x</script><h1>one</h1><p>two", ["one", "two"]),
        ("<head><title>T</title></head><p>one</p>", ["one"]),
        ("<p>one <svg width='1'/> two</p><svg><text>no</text></svg><p>three</p>", ["one two", "three"]),
        ("<p>one</p><math/><p>two</p>", ["one", "two"]),
        ("<p>one</p><svg><path d='x'><p>two</p><svg><text>no</text></svg><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><svg><svg><text>no</text></svg><text>no</text></svg><p>two</p>", ["one", "two"]),
        ("<svg><style/><title/><script/></svg><p>one</p>", ["one"]),
        ("<object data=x><p>one</p>", ["one"]),
        ("<p>a</p><select><option>no</select><p>b</p><select><option>c", ["a", "b", "c"]),
        ("<noscript>no</noscript><template><p>no</p></template><p>one", ["one"]),
        ("<p>one</p><script>var s = '</p><svg>'; <p>no</p>", ["one"]),
        ("<p>one</p><textarea>no <p>no</p>", ["one"]),
        ("<p title='" + "a>b" * 50_000 + "'>one</p><p data-x=\"" + "<p>" * 60_000 + "\">two", ["one", "two"]),
        ("<p>one <b title=\"x>two</b><p>three</p>" + "<i a='>" * 20_000 + "<p>four", ["one two", "three", "four"]),
        ("<p>one <b", ["one <b"]),
    ],
)
def test_unclosed_elements(page, want):
    assert [t for t, _, _ in html_text.blocks(page)] == want


def test_threshold_covers_all_documents(spark, monkeypatch):
    model = toxicity.Model(np.full(toxicity.DIM, 0.001, np.float32), -1.0, -0.9, 0.3)
    monkeypatch.setattr(toxicity, "train", lambda *a, **kw: model)  # its threshold is the sample's
    docs = [(i, " ".join(f"w{k}" for k in range(i))) for i in range(1, 200)]
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    at = toxicity.fit(table(spark, docs), labels, prior=0.3, n_unl=20).threshold
    score = model.scores(*vec.buffers(vec.lower(pa.array([t for _, t in docs]))))
    assert -1 < at < 0 and (score <= at).mean() >= 0.7 > (score <= at - 1 / toxicity.CELLS).mean()


def test_walked_archives_keep_what_comes_before_a_bad_record(tmp_path):
    plain = [b"WARC/1.1\r\nX: " + b"x" * n + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" for n in (5, 200_000, 9)]
    packed = [warc.record(i, "u", "h") for i in range(3)]
    for name, parts, good, bad in [
        ("a.warc", plain, 3, 0), ("a.warc", plain + [b"junk"], 3, 1), ("a.warc", [*plain[:2], plain[2][:-6]], 2, 1),
        ("a.warc.gz", packed, 3, 0), ("a.warc.gz", packed + [b"\0" * 9], 3, 1), ("a.warc.gz", [*packed[:2], packed[2][:-9]], 2, 1), ("a.warc.gz", [packed[0], b"junk", packed[1]], 1, 1),
    ]:
        with zipfile.ZipFile(tmp_path / "p.wacz", "w") as z:
            z.writestr(f"archive/{name}", b"".join(parts))
        got = warc.locate(f"file://{tmp_path}/p.wacz")
        begin = got[0][2]
        at = [begin + sum(map(len, parts[:k])) for k in range(good + bad)]
        assert [(r[2], r[3], r[4]) for r in got] == [(a, len(p), "ok") for a, p in zip(at, parts[:good])] + [(a, None, "bad record") for a in at[good:]]


class Flat(html.parser.HTMLParser):
    """Blocks of well-formed pages by the library's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.links, self.skip, self.link = [], [], [], 0, False

    def flush(self):
        ws = "".join(self.parts).split()
        if ws:
            self.out.append((" ".join(ws), len(ws), min(len(ws), len("".join(self.links).split()))))
        self.parts, self.links = [], []

    def handle_starttag(self, tag, attrs):
        if tag in RAW:
            self.skip += 1
        if self.skip:
            return
        if tag == "a":
            self.link = True
            self.links.append(" ")
        elif tag == "br":
            self.parts.append(" ")
            self.links.append(" ")
        elif tag not in html_text.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in RAW:
            self.skip -= 1
            if tag not in ("script", "style", "noscript", "template", "svg", "math"):
                self.flush()
        elif not self.skip and tag == "a":
            self.link = False
        elif not self.skip and tag not in html_text.INLINE | {"br"}:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.link:
                self.links.append(data)


RAW = {"script", "style", "iframe", "textarea", "title", *html_text.HIDDEN}


def test_html_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tree = html_text.trained()

    def content(node, x):
        while node.feature >= 0:
            node = node.left if x[node.feature] <= node.at else node.right
        return node.content

    got = {r.page_id: r for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        p = Flat()
        p.feed(r.html)
        p.close()
        p.flush()
        n, d = [0, *[w for _, w, _ in p.out], 0], [0, *[k / w for _, w, k in p.out], 0]
        keep = [t for i, (t, _, _) in enumerate(p.out) if content(tree, [*n[i : i + 3], *d[i : i + 3]])]
        assert (got[r.page_id].blocks, got[r.page_id].content_blocks, got[r.page_id].text) == (len(p.out), len(keep), "\n".join(keep)), r.page_id


def test_toxicity_equals_brute_force(spark):
    """Counts, choice and scores over all documents, word by word."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(10**6, None), (None, "x y")]
    confirmed = {i for i, _ in docs[::7] if i is not None}
    name = {}

    def features(text):
        out = set()
        for w, _, _ in brute.normal_words(text or ""):
            raw = w.encode()
            for k, x in enumerate((raw, raw[:5], raw[:7])):
                if k == 0 or len(raw) > len(x):
                    if (k, x) not in name:
                        h = vec.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
                        name[k, x] = int(vec.mix(h + np.uint64(k))[0] >> np.uint64(64 - toxicity.BITS))
                    out.add(name[k, x])
        return out

    own = [(i, features(t)) for i, t in docs if t is not None]
    toxic = spark.createDataFrame([(i, True) for i in confirmed], "doc_id long, pos boolean")
    n1, n0, c1, c0 = toxicity.counted(table(spark, docs), saved(toxic))
    assert n0 == len(own) and n1 == sum(i in confirmed for i, _ in own)
    for c, use in ((c1, lambda i: i in confirmed), (c0, lambda i: True)):
        want = Counter(f for i, fs in own if use(i) for f in fs)
        assert {int(f): int(c[f]) for f in np.flatnonzero(c)} == want
    labels = spark.createDataFrame([(i, 0, 1) for i in confirmed], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, docs), labels, prior=0.2)
    got = [r.score for r in toxicity.toxic_documents(table(spark, docs), labels, prior=0.2).collect()]
    want = [model.bias + sum(float(model.weights[f]) for f in features(t)) for _, t in docs]
    assert np.allclose(sorted(got), sorted(want), atol=1e-6)


@pytest.mark.parametrize("f", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_repeats_survive_equal_hashes(spark, f):
    """Windows whose first hash is the same, whatever their words, are told apart."""
    rng = random.Random(17)
    p, q = words(rng, 90), words(rng, 90)
    docs = [(i, " ".join(words(rng, 20) + (p, q)[i % 2] + words(rng, 30))) for i in range(6)] + [(10, " ".join(words(rng, 200)))]

    def weak(data, s, e):
        return np.full(len(s), 7, np.uint64)

    got = {r.doc_id: (tuple(map(tuple, r.repeated)), tuple(map(tuple, r.removed))) for r in f(table(spark, docs), word_hash=weak).collect()}
    assert got == brute.repeats(docs, 50)


def test_exact_and_lines_with_shuffles_instead_of_broadcasts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for f in (exact_dedup.exact_duplicates, lambda d: line_dedup.line_dedup(d, count="n").select("doc_id", "text", "n")):
        monkeypatch.setattr(common, "BROADCAST_BYTES", 16 << 20)
        want = rows(f(docs))
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        assert rows(f(docs)) == want


def test_measured_sizes(spark):
    rows = [(1, "x" * 1000, [1] * 100, [(1, "y" * 50)] * 10), (2, None, None, None)]
    n = common.measured(saved(spark.createDataFrame(rows, "a long, b string, c array<int>, d array<struct<e: int, f: string>>")))
    assert 2300 < n < 3500


def test_indexes_that_leave_records_out(tmp_path):
    parts = [warc.record(i, "u", "h" * i) for i in range(3)]
    at = np.cumsum([0, *map(len, parts)]).tolist()
    line = lambda k, name: f'x {{"offset": "{at[k]}", "length": "{len(parts[k])}", "filename": "{name}"}}\n'
    with zipfile.ZipFile(tmp_path / "p.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(parts))
        z.writestr("archive/x/b.warc.gz", b"".join(parts))
        z.writestr("archive/y/b.warc.gz", b"".join(parts))
        z.writestr("indexes/i.cdxj", line(1, "a.warc.gz") + line(0, "x/b.warc.gz") + line(0, "b.warc.gz") + line(0, "none.warc.gz"))
        z.writestr("indexes/j.zg", "no index")
    got = warc.locate(f"file://{tmp_path}/p.wacz")
    assert [(r[1], r[4]) for r in got].count(("indexes/i.cdxj", "bad index")) == 2
    begin = {r[1]: r[2] for r in got if r[4] == "not in index"}
    assert [(r[2] - begin["archive/a.warc.gz"], r[3], r[4]) for r in got if r[1] == "archive/a.warc.gz"] == [(at[1], len(parts[1]), "ok"), (0, at[1] + len(parts[2]), "not in index")]
    assert [(r[3], r[4]) for r in got if r[1] == "archive/x/b.warc.gz"] == [(len(parts[0]), "ok"), (at[3] - at[1], "not in index")]
    assert [r[4] for r in got if r[1] == "archive/y/b.warc.gz"] == ["ok"] * 3  # no index names it alone: walked
    assert warc.locate(f"file://{tmp_path}/missing.wacz") == [(f"file://{tmp_path}/missing.wacz", None, None, None, "unreadable")]

import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import annotations as an
from quarry.functions import render, terms
from quarry.operators import report
from quarry.plans import cache, verdicts
from quarry.schema import rows as make

from .conftest import rows

x, y = terms.var("x", 4), terms.var("y", 4)


@pytest.mark.parametrize("op", terms.BINARY + terms.COMPARE)
def test_operators_exhaustively(op):
    """Every operator at 4 bits: the circuit and the evaluator agree on all pairs."""
    wrong = []
    for a, b in itertools.product(range(16), repeat=2):
        v = terms.evaluate(op, 4, a, b)
        goal = terms.binary(op, x, y) if op in terms.COMPARE else terms.eq(terms.binary(op, x, y), terms.lit(4, v))
        if op in terms.COMPARE and not v:
            goal = terms.negation(goal)
        fixed = [terms.eq(x, terms.lit(4, a)), terms.eq(y, terms.lit(4, b))]
        if terms.check([*fixed, goal])[0] != terms.SAT or (a * 16 + b) % 16 == 0 and terms.check([*fixed, terms.negation(goal)])[0] != terms.UNSAT:
            wrong.append((a, b))
    assert not wrong


def formulas():
    bv = st.recursive(st.sampled_from([x, y]) | st.integers(0, 15).map(lambda v: terms.lit(4, v)), lambda t: st.tuples(st.sampled_from(("bvadd", "bvsub", "bvmul", "bvand", "bvxor", "bvshl", "bvudiv")), t, t).map(lambda z: terms.binary(*z)), max_leaves=4)
    atom = st.tuples(st.sampled_from(terms.COMPARE), bv, bv).map(lambda z: terms.binary(*z)) | st.tuples(bv, bv).map(lambda z: terms.eq(*z))
    return st.recursive(atom, lambda t: t.map(terms.negation) | st.tuples(t, t).map(lambda z: terms.conj(*z)) | st.tuples(t, t).map(lambda z: terms.disj(*z)), max_leaves=5)


@settings(max_examples=120, deadline=None)
@given(formulas())
def test_verdicts_against_enumeration(f):
    def holds(a, b):
        return terms.substitute(f, {"x": terms.lit(4, a), "y": terms.lit(4, b)}) == terms.TRUE

    any_ = any(holds(a, b) for a, b in itertools.product(range(16), repeat=2))
    verdict, model = terms.check([f])
    assert verdict == (terms.SAT if any_ else terms.UNSAT)
    if verdict == terms.SAT:
        assert holds(model.get("x", 0), model.get("y", 0))
    again = terms.parse_query(terms.canonical([f]))
    assert terms.canonical(again) == terms.canonical([f])


def test_budget_gives_unknown():
    a, b = terms.var("a", 24), terms.var("b", 24)
    hard = [terms.eq(terms.binary("bvmul", a, b), terms.lit(24, 0xEFFFA9)), terms.binary("bvult", terms.lit(24, 1), a), terms.binary("bvult", a, terms.lit(24, 4096)), terms.binary("bvult", terms.lit(24, 1), b), terms.binary("bvult", b, terms.lit(24, 4096))]
    assert terms.check(hard, conflicts=3)[0] == terms.UNKNOWN
    assert terms.check(hard, clauses=10)[0] == terms.UNKNOWN


def test_terms_are_sort_checked():
    with pytest.raises(terms.SortError):
        terms.binary("bvadd", x, terms.var("z", 8))
    with pytest.raises(terms.SortError):
        terms.conj(x)
    assert terms.prefixed(terms.eq(x, y), "s_")[1][1] == "s_x"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="()_ bvxassert10", max_size=80))
def test_reader_is_total(s):
    assert verdicts.answered(s, 10)[0] in (terms.SAT, terms.UNSAT, terms.UNKNOWN)


def test_discharge_solves_once(spark, tmp_path):
    q = terms.canonical([terms.eq(x, terms.lit(4, 3))])
    df = spark.createDataFrame([(1, q), (2, q), (3, terms.canonical([terms.FALSE])), (4, "(assert"), (5, None)], "id int, query string")
    store = cache.Store(spark, f"file://{tmp_path}/s", verdicts.VERDICT)
    for _ in range(2):
        got = {r.id: (r.verdict, r.model) for r in verdicts.discharged(df, store).collect()}
        assert got == {1: ("sat", "x = 3"), 2: ("sat", "x = 3"), 3: ("unsat", None), 4: ("unknown", None), 5: ("unknown", None)}
        assert store.rows("verdicts").count() == 3
    assert rows(verdicts.with_retry(df).select("id", "verdict")) == rows(verdicts.discharged(df).select("id", "verdict"))


@pytest.mark.parametrize(("s", "want"), [
    ("a ==> b ==> c", "(==> a (==> b c))"), ("a || b && !c", "(|| a (&& b (! c)))"), ("len(x) > -1", "(> (len x) -1)"), ("(p != nil) == true", "(== (!= p nil) true)"), ("x.f.g < old(y)", "(< (. (. x f) g) (old y))"),
])
def test_grammar(s, want):
    assert an.shown(an.expression(s)) == want


@pytest.mark.parametrize("s", ["", "a <", "a < b < c", "(a", "a b", "-x", "a @ b", "(" * 40 + "a" + ")" * 40, " ".join(["a ||"] * 200) + " a"])
def test_bad_expressions(s):
    with pytest.raises(an.BadAnnotation):
        an.expression(s)


def test_pragmas():
    assert an.pragma("//quarry:requires n > 0 // why") == ("requires", (">", ("name", "n"), ("int", 0)))
    assert an.pragma("//quarry:ignore nil") == ("ignore", "nil") and an.pragma("just text") is None
    for bad in ("//quarry:pure", "//quarry:ignore", "//quarry:requires"):
        with pytest.raises(an.BadAnnotation):
            an.pragma(bad)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="requires ensures()<>=!&|-.pnil0 1", max_size=60))
def test_annotations_are_total(s):
    try:
        an.pragma(s)
    except an.BadAnnotation:
        pass


def test_compiled():
    names = an.names_of([("n", (64, True)), ("p", "Ptr"), ("s", "Seq"), ("b", (8, False)), ("ok", "Bool")], [("", "Ptr"), ("err", "Ptr")])
    c = lambda s, e=False: an.compiled(an.expression(s), names, e)
    assert terms.text(c("n >= 1")) == "(bvsle (_ bv1 64) p0)" and terms.text(c("b < 200")) == "(bvult p3 (_ bv200 8))"
    assert terms.text(c("p != nil && ok")) == "(and (not p1.nil) p4)" and terms.text(c("n < len(s)")) == "(bvslt p0 p2.len)"
    assert terms.text(c("err == nil ==> ret != nil", True)) == "(or (not r1.nil) (not r0.nil))"
    for bad in ("n", "b < 256", "b < -1", "zz > 1", "ret == nil", "p < nil", "n == p", "len(n) > 0", "s.f > 1", "old(n) > 1", "ok < ok"):
        with pytest.raises(an.BadAnnotation):
            c(bad)


@pytest.fixture(scope="module")
def findings(spark):
    base = dict(checker="nil", tag="nil-deref", severity="error")
    return report.fingerprinted(make(spark, "finding", [
        base | {"func": "m.F", "file": "f.go", "line": 7, "col": 3, "message": "nil dereference in m.F\t\x07", "trace": [(0, "f.go", 6, 1), (1, None, None, None)], "model": [("p0", "nil")]},
        base | {"func": "m.E", "message": "m", "severity": "warning"},
    ]))


def test_text(spark, findings):
    src = spark.createDataFrame([("f.go", 7, "\treturn *p")], "file string, line int, source string")
    got = render.text_report(render.with_source(findings, src))
    assert got == "-:-:-: warning: nil-deref: m [m.E]\n\nf.go:7:3: nil-deref: nil dereference in m.F  [m.F]\n     return *p\n      ^\n  path: b0 -> b1\n  with p0 = nil\n"
    assert render.text_report(findings.limit(0)) == ""


def test_machine_formats(spark, findings):
    none = spark.createDataFrame([], "func string, checker string")
    flagged = report.flagged_report(findings.drop("ordinal", "fingerprint"), spark.createDataFrame([("m.E", "nil")], "func string, checker string"), spark.createDataFrame([], "fingerprint string"))
    s = json.loads(render.sarif_report(flagged))["runs"][0]["results"]
    assert [r.get("suppressions") for r in s] == [None, [{"kind": "inSource"}]] and s[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 7, "startColumn": 3}
    kept = report.flagged_report(findings.drop("ordinal", "fingerprint"), none, spark.createDataFrame([], "fingerprint string"))
    total = report.summary(kept.withColumn("status", F.lit("kept"))).first()
    j = json.loads(render.json_report(kept, total))
    assert j["schema_version"] == 2 and j["summary"]["total"] == 2 and j["findings"][1]["trace"] == [{"file": "f.go", "line": 6}]
    assert render.json_report(kept.repartition(5), total) == render.json_report(kept, total)


def test_baselines(spark, findings, tmp_path):
    text = render.baseline_text(findings)
    (tmp_path / "b.json").write_text(text)
    assert render.read_baseline(spark, f"file://{tmp_path}/b.json").count() == 2
    kept, _ = report.split_baseline(findings, render.read_baseline(spark, f"file://{tmp_path}/b.json"))
    assert kept.count() == 0
    for bad in ("{}", "[", text.replace('"schema_version": 1', '"schema_version": 9'), text.replace("v1:", "v0:"), text.replace('"tag"', '"gat"')):
        with pytest.raises(render.BadBaseline):
            render.parsed_baseline(bad)


@pytest.mark.parametrize("c", ["a\tb\x00c\x7f", "é\x1f", ""])
def test_sanitized(spark, c):
    got = spark.createDataFrame([(c,)], "s string").select(render.sanitized(F.col("s"))).first()[0]
    assert got == "".join(" " if k == "\t" else k for k in c if k == "\t" or (ord(k) >= 32 and ord(k) != 127))

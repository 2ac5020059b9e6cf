"""Renderers of reports: text for people, JSON, SARIF, baselines and dumps.

Columns are built JVM-side; only a finished, ordered report - what a person or a tool is to read - comes to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import report

REPORT_VERSION, BASELINE_VERSION = 2, 1
RULES = {
    "nil-deref": "possible nil dereference", "bounds": "index or slice out of bounds", "div-zero": "possible division by zero", "overflow": "integer overflow",
    "bad-annotation": "annotation that can't be used", "contract": "violated contract", "unverified-annotation": "annotation that couldn't be proven",
}


def sanitized(text: Column) -> Column:
    """A tab reads as a blank; other control characters and DEL go."""
    return F.regexp_replace(F.translate(text, "\t", " "), r"[\x00-\x1f\x7f]", "")


def position(file: str = "file", line: str = "line", col: str = "col") -> Column:
    """file:line:col, or -:-:- without a position."""
    return F.when(F.col(line).isNull(), "-:-:-").otherwise(F.concat_ws(":", F.coalesce(F.when(F.col(file) != "", F.col(file)), F.lit("-")), F.col(line).cast("string"), F.col(col).cast("string")))


def header() -> Column:
    """The first line of a finding: position, tag, message, function; warnings are marked."""
    mark = F.when(F.col("severity") == "warning", "warning: ").otherwise("")
    return F.concat(position(), F.lit(": "), mark, F.col("tag"), F.lit(": "), sanitized(F.col("message")), F.lit(" ["), F.col("func"), F.lit("]"))


def with_source(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """findings with `source`, the line each stands in; sources: (file, line, source)."""
    return findings.join(sources.select("file", "line", sanitized(F.col("source")).alias("source")), ["file", "line"], "left")


def body() -> Column:
    """Header, source line with a caret, the path of blocks, and the bindings, a line each; what is missing is left out."""
    has = lambda c: c in ("source", "trace", "model")  # noqa: E731, F841
    echo = F.when(F.col("source").isNotNull(), F.concat(F.lit("\n    "), "source", F.lit("\n    "), F.expr("repeat(' ', greatest(coalesce(col, 1) - 1, 0))"), F.lit("^")))
    steps = F.array_join(F.transform("trace", lambda t: F.concat(F.lit("b"), t["block"].cast("string"))), " -> ")
    path = F.when(F.size("trace") > 0, F.concat(F.lit("\n  path: "), steps))
    values = F.array_join(F.transform("model", lambda m: F.concat(m["name"], F.lit(" = "), m["value"])), ", ")
    model = F.when(F.size("model") > 0, F.concat(F.lit("\n  with "), values))
    return F.concat(header(), *[F.coalesce(x, F.lit("")) for x in (echo, path, model)])


def text_report(findings: DataFrame) -> str:
    """The report for people: blocks in report order, a blank line between."""
    df = findings
    for c, kind in (("source", "string"), ("trace", "array<struct<block: int, file: string, line: int, col: int>>"), ("model", "array<struct<name: string, value: string>>")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return "".join(r["t"] + "\n\n" for r in report.ordered(df).select(body().alias("t")).toLocalIterator()).rstrip("\n") + "\n" if not findings.isEmpty() else ""


def _pos(r) -> dict | None:
    return None if r["line"] is None else {"file": r["file"], "line": r["line"], "col": r["col"]}


def json_report(findings: DataFrame, totals) -> str:
    """findings: fingerprinted and kept; totals: the row of report.summary."""
    rows = []
    for r in report.ordered(findings).toLocalIterator():
        steps = [{"file": s["file"], "line": s["line"]} for s in (r["trace"] if "trace" in findings.columns and r["trace"] else []) if s["line"] is not None]
        rows.append({"fingerprint": r["fingerprint"], "checker": r["checker"], "tag": r["tag"], "severity": r["severity"], "func": r["func"], "pos": _pos(r), "message": r["message"], "trace": steps})
    tail = {k: totals[k] for k in ("total", "suppressed_by_baseline", "suppressed_pragma", "diff_base_scoped")}
    return json.dumps({"schema_version": REPORT_VERSION, "findings": rows, "summary": tail}, indent=2, ensure_ascii=False) + "\n"


def json_rows(findings: DataFrame) -> DataFrame:
    """line: each fingerprinted finding as one JSON object, for reports that no driver could hold; the same fields as in json_report, without steps."""
    pos = F.when(F.col("line").isNotNull(), F.struct("file", "line", "col"))
    return findings.select(F.to_json(F.struct("fingerprint", "checker", "tag", "severity", "func", pos.alias("pos"), "message")).alias("line"))


def sarif_rows(flagged: DataFrame) -> DataFrame:
    """line: each row of a flagged report as one SARIF result."""
    at = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    how = F.when(F.col("status") == "ignored", "inSource").when(F.col("status") == "baseline", "external")
    cols = [
        F.col("tag").alias("ruleId"), F.when(F.col("severity") == "warning", "warning").otherwise("error").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct(F.col("fingerprint").alias("quarry/v1")).alias("partialFingerprints"),
        F.when(F.col("line").isNotNull(), F.array(at)).alias("locations"), F.when(how.isNotNull(), F.array(F.struct(how.alias("kind")))).alias("suppressions"),
    ]
    return flagged.select(F.to_json(F.struct(*cols)).alias("line"))


def sarif_report(flagged: DataFrame, tool: str = "quarry") -> str:
    """flagged: report.flagged_report's rows; kept ones first, then those ignored in source, then those of the baseline."""
    group = F.when(F.col("status") == "kept", 0).when(F.col("status") == "ignored", 1).otherwise(2)
    how = {"ignored": "inSource", "baseline": "external"}
    results = []
    for g in range(3):
        for r in report.ordered(flagged.where(group == g)).toLocalIterator():
            x = {"ruleId": r["tag"], "level": "warning" if r["severity"] == "warning" else "error", "message": {"text": r["message"]}, "partialFingerprints": {"quarry/v1": r["fingerprint"]}}
            if r["line"] is not None:
                x["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"], "startColumn": r["col"]}}}]
            if r["status"] in how:
                x["suppressions"] = [{"kind": how[r["status"]]}]
            results.append(x)
    rules = [{"id": k, "shortDescription": {"text": v}} for k, v in RULES.items()]
    run = {"tool": {"driver": dict(name=tool, rules=rules)}, "results": results}
    return json.dumps(dict(version="2.1.0", runs=[run]) | {"$schema": "https://json.schemastore.org/sarif-2.1.0.json"}, indent=2, ensure_ascii=False) + "\n"


# -- baselines


class BadBaseline(ValueError):
    """A baseline that can't be relied on. It is never read halfway: what it would suppress must be known."""


def baseline_text(findings: DataFrame) -> str:
    """All fingerprinted findings as a baseline, sorted by fingerprint."""
    cols = ("fingerprint", "checker", "tag", "func", "message")
    rows = [{c: r[c] for c in cols} for r in findings.select(*cols).orderBy("fingerprint").toLocalIterator()]
    return json.dumps({"schema_version": BASELINE_VERSION, "entries": rows}, indent=2, ensure_ascii=False) + "\n"


def parsed_baseline(text: str) -> list[str]:
    """The fingerprints. Raises BadBaseline."""
    try:
        x = json.loads(text)
        entries = x["entries"]
        if x["schema_version"] != BASELINE_VERSION:
            raise BadBaseline(f"schema version {x['schema_version']}")
        out = [e["fingerprint"] for e in entries]
        if any(not isinstance(e.get(k), str) for e in entries for k in ("fingerprint", "checker", "tag", "func", "message")):
            raise BadBaseline("an entry lacks a field")
    except (KeyError, TypeError, ValueError) as e:
        raise BadBaseline(str(e)) from e
    if any(not f.startswith("v1:") for f in out):
        raise BadBaseline("a fingerprint of another kind")
    return out


def read_baseline(spark, path: str) -> DataFrame:
    """fingerprint; the file must exist and be whole."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(f,) for f in parsed_baseline(text)], "fingerprint string")


# -- dumps


def scc_dump(components: DataFrame, depths: DataFrame, edges: DataFrame) -> DataFrame:
    """place, line: components callees first, members in order."""
    from ..operators import graph
    from pyspark.sql import Window

    named = components.join(graph.scc_sizes(components, edges), "scc").groupBy("scc", "recursive").agg(F.array_join(F.sort_array(F.collect_list(F.col("node").cast("string"))), ", ").alias("members"))
    order = named.join(depths, "scc").withColumn("place", (F.row_number().over(Window.orderBy("depth", "scc")) - 1).cast("long"))
    return order.select("place", F.concat(F.lit("scc "), F.col("place").cast("string"), F.when(F.col("recursive"), " [recursive]").otherwise(""), F.lit(": "), "members").alias("line"))


def prepass_dump(clean: DataFrame) -> DataFrame:
    """line: function and whether its values are clean."""
    return clean.select(F.concat("func", F.lit(" value_clean="), F.col("value_clean").cast("string")).alias("line"))

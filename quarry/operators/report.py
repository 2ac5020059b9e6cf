"""Report operators: what becomes of confirmed findings on their way to the reader.

The order is fixed - scope, comparison with an earlier version, fingerprints, in-source ignores, baseline, promotion of
warnings - because a fingerprint's ordinal counts identical siblings before any of them is suppressed.

All of it is a Catalyst plan over the finding table: one window (fingerprints) is the only shuffle of the findings
themselves; the sets they are held against are joined as semi or anti joins, which Spark broadcasts only where its own size
estimate allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Findings of this tag concern an annotation itself, wherever it stands; no scope hides them.
ANNOTATION_TAG = "bad-annotation"
UNVERIFIED_TAG = "unverified-annotation"
SIBLING = ("checker", "func", "tag", "message")
POSITION = ("file", "line", "col")


def owner(func: Column) -> Column:
    """A function's name without the leading '(' and '*' of a method's receiver."""
    return F.regexp_replace(func, r"^\(?\*?", "")


def in_module(func: Column, module: Column | str) -> Column:
    """Whether a function belongs to a module: the module's path, then '.' or '/'."""
    prefix = F.lit(module) if isinstance(module, str) else module
    name = owner(func)
    return name.startswith(prefix) & F.substring(name, F.length(prefix) + 1, F.lit(1)).isin(".", "/")


def scope_findings(findings: DataFrame, module: Column | str) -> DataFrame:
    return findings.where(in_module(F.col("func"), module) | (F.col("tag") == ANNOTATION_TAG))


def changed_functions(now: DataFrame, base: DataFrame) -> DataFrame:
    """func of those whose hash differs from base's, or that base lacks; what base alone has doesn't count.
    Both have (func, hash)."""
    old = base.select("func", F.col("hash").alias("base_hash"))
    return now.join(old, "func", "left").where("base_hash is null or hash <> base_hash").select("func").distinct()


def diff_scope(findings: DataFrame, affected: DataFrame, known: DataFrame) -> DataFrame:
    """Findings in affected functions, and those whose function the program doesn't know."""
    marks = known.select("func").distinct().join(affected.select("func").distinct().withColumn("hit", F.lit(True)), "func", "left")
    return findings.join(marks.withColumn("is_known", F.lit(True)), "func", "left").where("is_known is null or hit").select(*[findings[c] for c in findings.columns])


def prefixed(*cols: str) -> Column:
    """Fields joined so that no two lists of fields read alike: each with its length in bytes before it."""
    return F.concat(*[F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)) for c in cols])


def fingerprinted(findings: DataFrame, order: tuple[str, ...] = POSITION) -> DataFrame:
    """findings with ordinal (among those alike but for the position) and fingerprint. Severity takes no part."""
    siblings = Window.partitionBy(*SIBLING).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = findings.withColumn("ordinal", (F.row_number().over(siblings) - 1).cast("long"))
    text = F.concat(F.lit("quarry-finding-1|"), prefixed(*SIBLING), F.lit("#"), F.col("ordinal").cast("string"))
    return numbered.withColumn("fingerprint", F.concat(F.lit("v1:"), F.substring(F.sha2(text, 256), 1, 32)))


def flag_ignored(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """findings with `ignored`; ignores has (func, checker). The checker counts, not the tag."""
    pairs = ignores.select("func", "checker").distinct().withColumn("ignored", F.lit(True))
    return findings.join(pairs, ["func", "checker"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def split_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by fingerprint."""
    known = baseline.select("fingerprint").distinct()
    return findings.join(known, "fingerprint", "left_anti"), findings.join(known, "fingerprint", "left_semi")


def promoted(findings: DataFrame, deny: bool = True) -> DataFrame:
    """deny: warnings count as errors."""
    return findings.withColumn("severity", F.when(F.col("severity") == "warning", F.lit("error")).otherwise(F.col("severity"))) if deny else findings


def summary(flagged: DataFrame, scoped: bool = False) -> DataFrame:
    """One row: total, suppressed_pragma, suppressed_by_baseline, errors, exit_code, diff_base_scoped. One pass over a flagged report (severity, status)."""
    count = lambda cond: F.count(F.when(cond, 1))
    errors = count((F.col("status") == "kept") & (F.col("severity") == "error"))
    return flagged.agg(
        count(F.col("status") == "kept").alias("total"),
        count(F.col("status") == "ignored").alias("suppressed_pragma"),
        count(F.col("status") == "baseline").alias("suppressed_by_baseline"),
        errors.alias("errors"),
        F.when(errors > 0, 1).otherwise(0).cast("long").alias("exit_code"),
        F.lit(scoped).alias("diff_base_scoped"),
    )


def flagged_report(findings: DataFrame, ignores: DataFrame, baseline: DataFrame, deny: bool = False, order: tuple[str, ...] = POSITION) -> DataFrame:
    """Fingerprinted findings with `status` kept, ignored or baseline: each row once, no matter how many filters hold it."""
    marked = flag_ignored(fingerprinted(findings, order), ignores)
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    out = marked.join(known, "fingerprint", "left").withColumn("status", F.when(F.col("ignored"), "ignored").when(F.col("known"), "baseline").otherwise("kept")).drop("ignored", "known")
    if deny:
        out = out.withColumn("severity", F.when((F.col("status") == "kept") & (F.col("severity") == "warning"), "error").otherwise(F.col("severity")))
    return out


def named(df: DataFrame, part: str, column: str = "func") -> DataFrame:
    """Rows whose function's name contains part."""
    return df.where(F.col(column).contains(part))


def ordered(findings: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """The total order of a report: annotation findings last; by function, position (none first), message, checker."""
    ranks = ranks or {"bounds": 0, "goroutine-leak": 1, "nil": 2, "contract": 3, "unverified": 4}
    rank = F.coalesce(*[F.when(F.col("checker") == k, v) for k, v in ranks.items()], F.lit(99))
    return findings.orderBy((F.col("tag") == ANNOTATION_TAG).asc(), "func", *[F.col(c).asc_nulls_first() for c in POSITION], "message", rank, "checker")


# -- triage


def normal_form(source: Column) -> Column:
    """A source line with its particulars taken out: strings read S, identifiers I, numbers N, runs of blanks one blank."""
    s = F.regexp_replace(source, r'"[^"]*"|`[^`]*`', "\u0002")
    for pattern, to in ((r"[a-zA-Z_][0-9a-zA-Z_]*", "I"), (r"[0-9]+", "N"), ("\u0002", "S"), (r"[ \t]+", " "), ("^ ", ""), (" $", "")):
        s = F.regexp_replace(s, pattern, to)
    return s


def triage_classes(df: DataFrame, tag: Column, source: Column) -> DataFrame:
    """class (tag and normal form) and how often it occurs."""
    return df.select(F.concat(tag, F.lit("|"), normal_form(source)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


TRIAGE = r"^([^:]+):([0-9]+):([0-9]+): (error|warning): (.*) \[([a-z-]+)/([a-z-]+)\]$"


def triage_lines(reports: DataFrame, column: str = "value") -> DataFrame:
    """file, line, col, severity, message, checker, tag of header lines of text reports; ok is false for a line that is none."""
    g = lambda k: F.regexp_extract(column, TRIAGE, k)
    ok = F.col(column).rlike(TRIAGE)
    pick = lambda k, name, kind="string": F.when(ok, g(k).cast(kind)).alias(name)
    return reports.select(pick(1, "file"), pick(2, "line", "int"), pick(3, "col", "int"), pick(4, "severity"), pick(5, "message"), pick(6, "checker"), pick(7, "tag"), ok.alias("ok"))

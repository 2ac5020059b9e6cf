r"""Line dedup by content-defined chunks of lines.

Lines (split at \n) are hashed; a chunk ends after a non-blank line where a hash that rolls over two line hashes is less than at the
non-blank line before and not greater than at the one after. So a passage of lines is cut alike wherever it stands, and since two
neighbours can't both be least, each chunk has two non-blank lines at least, three on average; at the ends of a text, where a neighbour is
missing or a single line would be left, there is no cut. Chunks
that occur more than once in the corpus are compared byte by byte, and all occurrences but the first (by
doc_id, then line) are removed. A single line is never removed by itself, whatever its number.

Everything is JVM-side. Content never moves in the search for repeats (only 64-bit keys do); for the byte
comparison one smallest and one largest content per key leave a task.

Edge cases: a null or empty text, and a row with a null doc_id, pass unchanged; rows that repeat doc_id and
text count as one document and get the same result; a document whose chunks are all removed stays with an
empty text; an empty table gives an empty table; other columns pass, n_chars is kept true where it exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, joined, saved

#: Places of the non-blank lines, their hashes, the rolling hash, and the last lines of all chunks.
PLACES = "filter(transform(lines, (x, i) -> if(length(trim(x)) > 0, i, -1)), i -> i >= 0)"
HASHES = "transform(at, i -> cast(conv(substring(md5(cast(lines[i] as binary)), 1, 8), 16, 10) as bigint))"
ROLLING = "transform(h, (x, j) -> (x + 31 * if(j > 0, get(h, j - 1), 0)) % 4294967296)"
ENDS = "concat(filter(transform(at, (i, j) -> if(j > 0 and j < size(at) - 2 and r[j] < get(r, j - 1) and r[j] <= get(r, j + 1), i, -1)), i -> i >= 0), array(size(lines) - 1))"
CHUNKS = "transform(ends, (e, k) -> named_struct('start', if(k > 0, ends[k - 1] + 1, 0), 'n', e - if(k > 0, ends[k - 1], -1)))"
CONTENT = "array_join(slice(lines, c.start + 1, c.n), '\\n')"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash that tells texts of one doc_id apart), lines; of rows that can be changed."""
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text")).where("doc_id is not null and instr(text, '\\n') > 0").select("doc_id", "th", F.split("text", "\n").alias("lines"))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, th, c (first line, lines), content: the multi-line chunks of every document."""
    df = keyed(docs)
    for name, rule in (("at", PLACES), ("h", HASHES), ("r", ROLLING), ("ends", ENDS)):
        df = df.withColumn(name, F.expr(rule))
    multi = f"filter({CHUNKS}, c -> c.n > 1 and size(filter(slice(lines, c.start + 1, c.n), x -> length(trim(x)) > 0)) > 1)"
    df = df.select("doc_id", "th", F.explode(F.expr(f"transform({multi}, c -> named_struct('c', c, 'content', {CONTENT}))")).alias("x"))
    return df.select("doc_id", "th", "x.c", "x.content")


def removals(docs: DataFrame, key=lambda c: F.xxhash64(c)) -> DataFrame:
    """doc_id, th, gone: the chunks (first line, lines) to take out of each document, in order."""
    found = saved(chunks(docs).select("doc_id", "th", "c.start", "c.n", key("content").alias("key")).distinct(), "line-chunks")
    often = saved(found.groupBy("key").count().where("count > 1").select("key"), "line-keys")
    seen = saved(joined(found, often, "key", "left_semi"), "line-repeats")
    where = saved(seen.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "key")).alias("cs")), "line-docs")
    contents = F.expr(f"transform(cs, c -> named_struct('c', c, 'content', {CONTENT}))")  # cut before they part: a chunk never carries its text
    spelled = joined(keyed(docs), where, ["doc_id", "th"], "inner").select("doc_id", "th", F.explode(contents).alias("x"))
    spelled = spelled.select("doc_id", "th", "x.c.start", "x.c.n", "x.c.key", "x.content")
    clash = saved(spelled.groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").select("key"), "line-clashes")
    if clash.isEmpty():
        same = seen.select("doc_id", "th", "start", "n", F.struct("key").alias("same"))
    else:  # keys that stand for several contents: there the content itself decides
        plain = seen.join(clash, "key", "left_anti").select("doc_id", "th", "start", "n", F.struct("key", F.lit(None).cast("string").alias("content")).alias("same"))
        same = plain.unionByName(spelled.join(clash, "key", "left_semi").select("doc_id", "th", "start", "n", F.struct("key", "content").alias("same")))
    first = same.groupBy("same").agg(F.min(F.struct("doc_id", "start", "th")).alias("first"))
    later = same.join(first, "same").where("doc_id <> first.doc_id or start <> first.start or th <> first.th")
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("gone"))


def kept(lines: str, gone: str) -> str:
    """SQL for the text of `lines` without the line ranges `gone` (sorted, disjoint)."""
    ranges = f"""filter(transform(sequence(0, size({gone})), i -> named_struct(
        's', if(i > 0, {gone}[i - 1].start + {gone}[i - 1].n, 0),
        'e', if(i < size({gone}), {gone}[i].start, size({lines})))), r -> r.e > r.s)"""
    return f"array_join(transform({ranges}, r -> array_join(slice({lines}, r.s + 1, r.e - r.s), '\\n')), '\\n')"


def line_dedup(docs: DataFrame, count: str | None = None, **kw) -> DataFrame:
    """docs with the later occurrences of repeated chunks taken out of text. count: the name of a further
    column with the number of lines removed."""
    gone = saved(removals(docs, **kw), "line-gone")
    th, g, ls, new = (hidden(docs, c) for c in ("th", "gone", "lines", "kept"))
    df = joined(docs.withColumn(th, F.xxhash64("text")), gone.select(F.col("doc_id"), F.col("th").alias(th), F.col("gone").alias(g)), ["doc_id", th], "left")
    changed = F.col(g).isNotNull()
    df = df.withColumn(ls, F.when(changed, F.split("text", "\n"))).withColumn(new, F.when(changed, F.expr(kept(f"`{ls}`", f"`{g}`"))))
    text = F.coalesce(F.col(new), F.col("text"))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length(F.col(new)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    more = [F.coalesce(F.expr(f"aggregate(`{g}`, 0, (a, r) -> a + r.n)"), F.lit(0)).cast("long").alias(count)] if count else []
    return df.select(*[c.alias(k) for k, c in out.items()], *more)


ORACLE = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND contains(text, chr(10))),
l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT doc_id, text, i, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY doc_id, text) AS n
      FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
r AS (SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % 4294967296 AS r FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
m AS (SELECT doc_id, text, i, j > 0 AND j < n - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w AS cut FROM r WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
b AS (SELECT l.*, coalesce(m.cut, FALSE) AS cut FROM l LEFT JOIN m USING (doc_id, text, i)),
c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
k AS (SELECT doc_id, text, chunk, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS content FROM c GROUP BY ALL
      HAVING count(*) FILTER (trim(line) <> '') > 1),
g AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) > 1 AS gone FROM k),
z AS (SELECT c.doc_id, c.text, string_agg(c.line, chr(10) ORDER BY c.i) FILTER (NOT coalesce(g.gone, FALSE)) AS new,
             count(*) FILTER (g.gone) AS removed
      FROM c LEFT JOIN g USING (doc_id, text, chunk) GROUP BY ALL)
SELECT t.doc_id, CASE WHEN z.removed > 0 THEN coalesce(z.new, '') ELSE t.text END AS text,
       coalesce(z.removed, 0) AS removed_lines
FROM documents t LEFT JOIN z ON z.doc_id = t.doc_id AND z.text = t.text
"""

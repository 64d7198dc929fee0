"""Operator 2: repeated runs of lines, by winnowing.

A window is the shortest run of whole lines with ``MIN_WORDS`` words or more, one for each line
that starts such a run. The least line hash in a window (the last of equals) is its fingerprint,
so two equal runs of that size always share one. Fingerprints found at one position only end
there. Positions around a shared fingerprint are joined, by the content of their windows, with the
first position of that content in (doc_id, position) order. From there the match is extended both
ways: backwards a longer match starts with an earlier window, which is joined itself; forwards the
lines after the window are compared with those after the first one, up to the first that differs.
Extended matches are put together to runs and deleted; the first run stays. No pairs are formed: a
group of copies costs one row a window.

Lines are compared by two 64-bit hashes, 128 bits together.

Defined results: lines without a word are in no window and go only where they lie inside a deleted
run; a run of fewer than ``MIN_WORDS`` words stays; a repeat within one text counts where it does
not overlap the first run; a null text stays null; rows equal in key and text are one document and
get equal results; a null key sorts first; other columns pass through, but columns named as the
results ``n_lines`` and ``n_removed`` are replaced by them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .skew import meet
from .storage import discard, stored, table

#: words in a run from which a repeat is deleted
MIN_WORDS = 50
WORD = r"[^ \t\n\x0B\f\r]+"


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a window: its document, first and last line, word offset and count, content key, fingerprint, and the lines after it."""
    one = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), _text_hash(F.col(text)).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    hashes = F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")
    lines = one.select("key", "th", "pos", *hashes, F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")).where("words > 0")
    # rows equal in key and text have equal lines
    lines = lines.groupBy("key", "th", "pos").agg(*(F.any_value(c).alias(c) for c in ("h", "g", "words")))
    doc = Window.partitionBy("key", "th")
    lines = lines.withColumn("off", F.coalesce(F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # lines that end fewer than min_words words after this one: more of them would be a window of their own
    after = doc.orderBy("end").rangeBetween(1, min_words - 1)
    lines = lines.withColumn("end", F.col("off") + F.col("words")).withColumn("after", F.collect_list(F.struct("h", "g", "pos")).over(after))
    ahead = doc.orderBy("off").rangeBetween(0, min_words - 1)
    least = F.min(F.struct("h", (-F.col("off")).alias("back"))).over(ahead)
    content = F.collect_list(F.struct("h", "g")).over(ahead)
    windows = lines.select("key", "th", "pos", "off", F.max("pos").over(ahead).alias("last"), F.sum("words").over(ahead).alias("size"), least.alias("least"), content.alias("content"), F.last("after").over(ahead).alias("after"))
    windows = windows.where(F.col("size") >= min_words).withColumn("new", ~F.coalesce(F.lag("least.back").over(doc.orderBy("off")) == F.col("least.back"), F.lit(False)))
    return windows.select("key", "th", "pos", "last", "off", "size", F.xxhash64("content.h").alias("c1"), F.xxhash64("content.g").alias("c2"), F.col("least.h").alias("fp"), "new", "after")


def _agreeing(after: Column, others: Column, before: Column) -> Column:
    """How many lines in front of ``after`` equal those of ``others``, as long as ``before`` holds for the latter's position."""
    same = F.zip_with(after, others, lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]) & before(b["pos"]), F.lit(False)))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def repeated_runs(windows: DataFrame) -> DataFrame:
    """Disjoint runs of lines to delete: key, th and an ascending array of (first, last) lines."""
    shared = stored(windows.where("new").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "shared-fingerprints")
    around = stored(meet(windows, shared, ["fp"], "n").drop("fp", "new"), "windows-around")
    discard(windows, shared)
    first = around.groupBy("c1", "c2").agg(F.min(F.struct("key", "th", "off", "after")).alias("one"), F.count("*").alias("n")).where("n > 1")
    joined = meet(around, stored(first, "first-windows"), ["c1", "c2"], "n")
    same_doc = F.struct("key", "th") == F.struct("one.key", "one.th")
    more = _agreeing(F.col("after"), F.col("one.after"), lambda at: ~same_doc | (at < F.col("pos")))
    later = joined.where(~same_doc | (F.col("off") >= F.col("one.off") + F.col("size"))).select("key", "th", "pos", "last", "after", more.alias("more"))
    later = later.select("key", "th", "pos", F.when(F.col("more") > 0, F.get("after", F.col("more") - 1)["pos"]).otherwise(F.col("last")).alias("last"))
    doc = Window.partitionBy("key", "th").orderBy("pos")
    islands = later.withColumn("reach", F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    islands = islands.withColumn("run", F.sum((F.col("reach").isNull() | (F.col("pos") > F.col("reach") + 1)).cast("int")).over(doc))
    runs = islands.groupBy("key", "th", "run").agg(F.min("pos").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("key", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def without_runs(lines: Column, runs: Column) -> Column:
    """The lines outside of ascending disjoint runs."""
    before = F.transform(runs, lambda r, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get(runs, i - 1)["last"] + 2), r["first"] - F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["last"] + 1)))
    tail = F.get(runs, F.size(runs) - 1)["last"] + 1
    return F.concat(F.flatten(before), F.slice(lines, tail + 1, F.size(lines)))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns with ``text`` less its later repeated runs, plus ``n_lines`` and ``n_removed``."""
    runs = repeated_runs(stored(line_windows(docs, key, text, min_words), "line-windows"))
    # the rows in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(key).alias("key"), _text_hash(F.col(text)).alias("th")).alias("id"))
    marked = rows.join(runs.select(F.struct("key", "th").alias("id"), "runs"), "id", "left")
    whole, runs = F.col("row")[text], F.col("runs")
    lines = F.split(whole, "\n")
    removed = F.aggregate(runs, F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    cut = F.when(runs.isNull(), whole).otherwise(F.array_join(without_runs(lines, runs), "\n"))
    results = {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(removed, F.lit(0)).cast("long")}
    return marked.select(*((cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c not in results), *(v.alias(k) for k, v in results.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) AS words FROM l),
o AS (
  SELECT doc_id, pos, line, words, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM w WHERE words > 0),
e AS (
  SELECT *, list({{'line': line, 'pos': pos}}) OVER (PARTITION BY doc_id ORDER BY off + words RANGE BETWEEN 1 FOLLOWING AND {MIN_WORDS - 1} FOLLOWING) AS after FROM o),
g AS (
  SELECT doc_id, pos, off, max(pos) OVER a AS last, sum(words) OVER a AS size, list(line) OVER a AS content
  FROM o WINDOW a AS (PARTITION BY doc_id ORDER BY off RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
f AS (
  SELECT *, first_value(doc_id) OVER c AS doc1, first_value(off) OVER c AS off1, first_value(last) OVER c AS last1
  FROM g WHERE size >= {MIN_WORDS} WINDOW c AS (PARTITION BY content ORDER BY doc_id, off)),
m AS (
  SELECT f.doc_id, f.pos, f.last, a.after,
    list_transform(range(1, least(coalesce(len(a.after), 0), coalesce(len(b.after), 0)) + 1), lambda i: a.after[i].line = b.after[i].line AND (f.doc1 <> f.doc_id OR b.after[i].pos < f.pos)) AS same
  FROM f JOIN e a ON a.doc_id = f.doc_id AND a.pos = f.last JOIN e b ON b.doc_id = f.doc1 AND b.pos = f.last1
  WHERE f.doc1 <> f.doc_id OR f.off >= f.off1 + f.size),
x AS (
  SELECT *, coalesce(list_position(list_append(same, false), false), 1) - 1 AS more FROM m),
d AS (
  SELECT DISTINCT doc_id, pos, CASE WHEN more > 0 THEN after[more].pos ELSE last END AS last FROM x),
k AS (
  SELECT l.doc_id, l.pos, l.line, NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id AND l.pos BETWEEN d.pos AND d.last) AS kept FROM l)
SELECT x.doc_id, coalesce(count(k.pos), 0)::BIGINT AS n_lines, coalesce(sum((NOT kept)::INT), 0)::BIGINT AS n_removed,
  CASE WHEN any_value(x.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') END AS text
FROM documents x LEFT JOIN k ON k.doc_id = x.doc_id GROUP BY x.doc_id"""

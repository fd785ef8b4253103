"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Lines are what `\\n` separates. Every three consecutive lines of a document make a window, known by two 64-bit hashes of its
lines; windows of blank lines only are left out. Over the whole corpus, the first place of a window (smallest doc_id, then
position) stays; every later place, in the same document or another, is removed, and covered positions are merged: the
lines that any later place covers go. What remains is joined by `\\n`.

Counting is a partial aggregate, so that a window found in a third of all documents is one row per task. First places are
written out before they are handed back, so that both sides of that join are plain exchanges and adaptive execution can
split a hot window. No document's lines are exploded
with their text: only hashes travel, and the text meets the sorted starts of its later windows once.

Defined cases: a document of fewer than three lines has no window and stays as it is; null text stays null (n_lines 0);
empty text is one empty line. Rows with null doc_id are passed on unchanged and don't count as places. Rows that share a
doc_id (repeated rows) are one document: each gets the same places, none of them later than the other. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialise

SPAN = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, pos, a, b: a row for every window that isn't blank (as many for a place as rows share its doc_id)."""
    hashed = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.expr("transform(split(text, '\\n', -1), x -> struct(xxhash64(x) as a, xxhash64(x, 1) as b, trim(x) <> '' as full))").alias("l")
    )
    made = hashed.where(F.size("l") >= SPAN).select(
        "doc_id",
        F.posexplode(
            F.expr(
                f"transform(sequence(0, size(l) - {SPAN}), i -> struct("
                "xxhash64(l[i].a, l[i + 1].a, l[i + 2].a) as a, xxhash64(l[i].b, l[i + 1].b, l[i + 2].b) as b, "
                "l[i].full or l[i + 1].full or l[i + 2].full as full))"
            )
        ).alias("pos", "w"),
    )
    return made.where("w.full").select("doc_id", "pos", "w.a", "w.b")


def later_than(found: DataFrame, first: DataFrame) -> DataFrame:
    """The windows that aren't their own first place; first: a, b, first, a written table."""
    return found.join(first, ["a", "b"]).where("not (doc_id = first.doc_id and pos = first.pos)")


def later_places(docs: DataFrame) -> DataFrame:
    """doc_id, starts: sorted starts of the windows that occurred before."""
    found = materialise(windows(docs))
    first = found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = later_than(found, materialise(first))
    return later.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the later places removed from text, plus n_lines and n_removed (longs)."""
    starts = later_places(docs)
    lines = "split(text, '\\n', -1)"
    # kept stretches lie between the end of one covered window and the start of the next
    kept = f"""flatten(transform(sequence(0, size(fluxion_starts)), i -> slice(fluxion_lines,
        if(i = 0, 0, fluxion_starts[i - 1] + {SPAN}) + 1,
        greatest(0, if(i = size(fluxion_starts), size(fluxion_lines), fluxion_starts[i]) - if(i = 0, 0, fluxion_starts[i - 1] + {SPAN})))))"""
    own = docs.columns
    joined = docs.join(starts.select(F.col("doc_id").alias("fluxion_id"), F.col("starts").alias("fluxion_starts")), F.col("doc_id") == F.col("fluxion_id"), "left")
    joined = joined.withColumn("fluxion_lines", F.expr(f"if(fluxion_starts is null, null, {lines})")).withColumn("fluxion_kept", F.expr(f"if(fluxion_starts is null, null, {kept})"))
    count = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.select(
        *[F.expr("if(fluxion_starts is null, text, array_join(fluxion_kept, '\\n'))").alias(c) if c == "text" else F.col(c) for c in own],
        count.alias("n_lines"),
        F.coalesce(F.size("fluxion_lines") - F.size("fluxion_kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
w AS (
  SELECT DISTINCT doc_id, i, x[i + 1] || chr(10) || x[i + 2] || chr(10) || x[i + 3] AS t
  FROM (SELECT doc_id, x, unnest(range(0, len(x) - 2)) AS i FROM l WHERE len(x) >= 3)
  WHERE trim(x[i + 1], ' ') <> '' OR trim(x[i + 2], ' ') <> '' OR trim(x[i + 3], ' ') <> ''),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS p FROM later, (VALUES (0), (1), (2)) AS v(d)),
kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS p FROM l) a
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p)
  GROUP BY a.doc_id)
SELECT d.doc_id,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS BIGINT) AS n_removed,
  md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's key is a pair of hashes (64 and 32 bits) of its text, tabs and other
white space as spaces, without those at either end; blank lines are left alone. Each line key gets a HyperLogLog sketch of the
sites (``source``) whose documents hold it, merged by aggregation. Where the
sketch's estimate lies within ``margin`` of the threshold, exact distinct
counts decide; outside it the sketch does. A line on ``min_sites`` sites or
more is cross-site boilerplate: it is removed everywhere but in its first
place (smallest doc_id, then first line), so no text is lost from the corpus.

Hot lines: counts, sketches and exact counts are partially aggregated before
the shuffle; the join back is an ordinary equi-join that Spark can split.
Sketches are built once; the candidates near or above the threshold are written
for the steps that follow. What returns to the documents is, per document, the numbers of its removed lines.

Defined results: a null text stays null, with no lines; an empty text has one
blank line; a null source counts as no site; rows that repeat an id are
cleaned alike (their lines count once as one document's); rows with a null id
are returned unchanged; an empty table gives an empty result. Columns other
than id, text and source pass through or are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 8
LOG2_BUCKETS = 10              # of a sketch: standard error 1.04 / 2**5 = 3.3 %
MARGIN = 0.15                  # 4.5 standard errors


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, pos, h, g of every non-blank line of rows that have an id."""
    text = F.trim(F.translate("line", "\t\r\f", "   "))
    return docs.where("doc_id is not null") \
        .select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .select("doc_id", "source", "pos", text.alias("line")).where("line <> ''") \
        .select("doc_id", "source", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def boilerplate(docs: DataFrame, scratch, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """h, g, sites, first_doc, first_pos of each cross-site line key."""
    lines = _lines(docs)
    estimate = F.hll_sketch_estimate("sketch")
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("source", F.lit(LOG2_BUCKETS)).alias("sketch"),
                                         F.min(F.struct("doc_id", "pos")).alias("first")) \
        .select("h", "g", estimate.alias("estimate"), "first").where(F.col("estimate") >= min_sites * (1 - margin))
    spread = scratch.save(spread, "spread")     # candidates only; the sketches are built once
    near = spread.where(F.col("estimate") <= min_sites * (1 + margin)).select("h", "g")
    exact = lines.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("source").alias("exact"))
    return spread.join(exact, ["h", "g"], "left") \
        .select("h", "g", F.coalesce("exact", "estimate").alias("sites"), F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")) \
        .where(F.col("sites") >= min_sites)


def dedup_lines(docs: DataFrame, scratch, min_sites: int = MIN_SITES, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus two ``counts`` of lines: held and removed.

    What is kept is cut from the list of lines in slices between removed ones,
    so the work is linear in a document's lines.
    """
    n_lines, n_removed = counts
    columns = [c for c in docs.columns if c not in counts]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    wide = scratch.save(boilerplate(slim, scratch, min_sites), "boilerplate")
    cut = _lines(slim).join(wide, ["h", "g"]).where("not (doc_id = first_doc and pos = first_pos)") \
        .groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set("pos")).alias("__cut"))
    # The lines travel instead of the text: split once, before the join.
    split = docs.select(*columns).withColumn("text", F.split("text", "\n"))
    edges = F.concat(F.array(F.lit(-1)), "__cut", F.array(F.size("text")))
    slices = F.transform(F.sequence(F.lit(1), F.size("__cut") + 1), lambda k: F.slice(
        "text", F.get("__edges", k - 1) + 2, F.get("__edges", k) - F.get("__edges", k - 1) - 1))
    return split.join(cut, F.col("doc_id").cast("long") == F.col("__id"), "left").withColumn("__edges", edges) \
        .withColumn(n_lines, F.coalesce(F.when(F.col("text").isNotNull(), F.size("text")), F.lit(0)).cast("long")) \
        .withColumn(n_removed, F.coalesce(F.size("__cut"), F.lit(0)).cast("long")) \
        .withColumn("text", F.array_join(F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.flatten(slices)), "\n")) \
        .select(*columns, *counts)


def oracle(min_sites: int = MIN_SITES) -> str:
    """DuckDB text with exact distinct counts on whole lines."""
    return f"""
    WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, source, p - 1 AS pos, trim(translate(ls[p], chr(9) || chr(13) || chr(12), '   ')) AS line
              FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM cut)),
    wide AS (SELECT line, min((doc_id, pos)) AS f FROM lines WHERE line <> ''
             GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
    marked AS (SELECT doc_id, pos, (wide.line IS NOT NULL AND (doc_id, pos) <> wide.f) AS gone
               FROM lines LEFT JOIN wide ON lines.line = wide.line)
    SELECT m.doc_id, count(*) AS n_lines, sum(gone::BIGINT)::BIGINT AS n_removed,
           coalesce(string_agg(c.ls[m.pos + 1], chr(10) ORDER BY m.pos) FILTER (NOT gone), '') AS kept_text
    FROM marked m JOIN cut c ON m.doc_id = c.doc_id GROUP BY m.doc_id"""

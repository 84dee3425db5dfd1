"""Removal of cross-site boilerplate lines, by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it stands on; the sketches merge by
aggregation, so a line on a third of all pages costs one row per map task. Estimates far from the
threshold decide at once; lines near it get an exact count of distinct sites. Texts are split once to narrow rows of hashes. Lines
that hold over a thousandth of all rows meet their boilerplate row by a broadcast of at most 1,000 rows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded
from .common import cut_lineage, joined_by_count, row_key

#: Sites on which a line must stand to be boilerplate.
MIN_SITES = 6
#: Sketch size (2^10 registers: 3 % standard error) and the share of the threshold that counts as near it.
LG_K, BAND = 10, 0.25
BLANK = " \t\r"

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def line_rows(documents: DataFrame) -> DataFrame:
    """k1, k2, site, at (doc_id, position), h1, h2 of every line that isn't blank."""
    rows = row_key(documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("site")))
    lines = exploded(rows, ["k1", "k2", "site", "doc_id"], F.split("text", "\n"), "pos", "line")
    line = F.btrim("line", F.lit(BLANK))
    return lines.select("k1", "k2", "site", F.struct("doc_id", "pos").alias("at"), line.alias("line")).where("line <> ''").select("k1", "k2", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, many: int, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (the smallest place) and n (places) of lines that stand on at least min_sites distinct sites."""
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    sites = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    spread = lines.groupBy("h1", "h2").agg(sites.alias("sites"), F.min("at").alias("first"), F.count("*").alias("n"))
    spread = cut_lineage(spread.where(F.col("sites") >= low))
    near = spread.where(F.col("sites") < high).select("h1", "h2", "n")
    exact = joined_by_count(lines, near, ["h1", "h2"], many).groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    decided = spread.where(F.col("sites") >= high).unionByName(spread.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))
    return cut_lineage(decided.select("h1", "h2", "first", "n"))


def split_lines(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def mark_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with lines (array) and kept (positions from 0, ascending).

    A site is a `source`; a null one counts as a site of its own. Lines are the \\n-split parts, compared
    without blanks at their ends; blank lines always stay. Of a boilerplate line the occurrence with the smallest
    (doc_id, position) stays, all others go. Null texts have no lines; equal rows are treated equally.
    """
    lines = cut_lineage(line_rows(documents))
    many = lines.count()
    out = joined_by_count(lines, boilerplate(lines, many, min_sites), ["h1", "h2"], many).where(F.col("at") != F.col("first"))
    gone = cut_lineage(out.groupBy("k1", "k2").agg(F.collect_set("at.pos").alias("gone"), F.count("*").alias("n")).withColumn("n", F.col("n") / F.size("gone")))
    keyed = row_key(documents.select(*COLUMNS))
    hot = gone.where(F.col("n") > max(1000, many // 1000)).drop("n")  # equal rows, at most 1,000 of them distinct
    often = keyed.join(F.broadcast(hot), ["k1", "k2"])
    seldom = keyed.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(gone.where(F.col("n") <= max(1000, many // 1000)).drop("n"), ["k1", "k2"], "left")
    marked = (seldom if hot.isEmpty() else seldom.unionByName(often)).withColumn("lines", split_lines(F.col("text")))
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    return marked.withColumn("kept", F.when(F.col("gone").isNull(), every).otherwise(F.array_except(every, "gone"))).select(*COLUMNS, "lines", "kept")


def kept_text(marked: DataFrame) -> Column:
    """The text of the kept lines; unchanged (null included) where none was removed."""
    lines = F.col("lines")
    return F.when(F.size("kept") == F.size("lines"), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda p: F.get(lines, p)), "\n"))


def dedup_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """documents without boilerplate lines; a document that loses lines and keeps no other text is dropped."""
    out = mark_lines(documents, min_sites)
    cut = F.size("kept") < F.size("lines")
    out = out.withColumn("text", kept_text(out)).where(~cut | (F.btrim("text", F.lit(BLANK + "\n")) != ""))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def line_report(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of the text that stays; null texts count as empty)."""
    out = mark_lines(documents, min_sites)
    text = F.coalesce(kept_text(out), F.lit(""))
    n_lines, n_kept = F.size("lines").cast("bigint"), F.size("kept").cast("bigint")
    return out.select("doc_id", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


REPORT_SQL = f"""
WITH l AS (SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
b AS (SELECT body, min({{'d': doc_id, 'p': pos}}) AS first FROM k WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT k.*, b.body IS NULL OR b.first = {{'d': doc_id, 'p': pos}} AS stays FROM k LEFT JOIN b ON k.body = b.body)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(m.text, '')) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text FROM m GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""

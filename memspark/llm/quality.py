"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Each rule compares one rate of a text with a cutoff. A cutoff is used in a stratum only if the labelled
holdout proves, by an exact binomial test, that it rejects few good documents there: with k of n good
documents rejected, P(Bin(n, alpha) <= k) must be at most delta after correction. Cutoffs are tested in
fixed order from the laxest on, up to the first that fails, so a rule counts as one test; a Bonferroni
share of delta goes to each rule and stratum, and a share of alpha to each rule. With probability
1 - delta, then, the rules together reject at most ALPHA of the good documents in every stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
#: At most this share of good documents may be rejected per stratum, save with probability DELTA.
ALPHA, DELTA = 0.05, 0.05
#: Strata: these languages and one for all others, so the table of cutoffs has a fixed number of rows.
STRATA = ("de", "en", "es", "fr")
#: Rules and their cutoffs, laxest first; a document goes if its rate is above the cutoff.
RULES = {
    "symbol_rate": (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12),
    "capital_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "exclaim_rate": (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12),
    "dup_line_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "word_length": (60.0, 40.0, 25.0, 18.0, 14.0, 12.0, 11.0, 10.0),
}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def dropped(text: Column, pattern: str) -> Column:
    """How many code points a pattern of single characters covers."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def cheap_rates(documents: DataFrame, repeats: bool = False) -> DataFrame:
    """doc_id, stratum, counts and the rules' rates of every row; with repeats also n_repeat_words."""
    df = documents.select(F.col("doc_id"), F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other").alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({"w": F.array_remove(F.split("text", f"{SPACE}+"), ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    words, lines = F.size("w"), F.size("lines")
    df = df.select(
        "doc_id", "stratum", *(["w"] if repeats else []), words.cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        dropped(F.col("text"), r"[#*$%&|<>]+").cast("bigint").alias("n_symbols"), (lines - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        lines.alias("n_lines"), dropped(F.col("text"), r"\p{Lu}+").alias("n_capitals"), dropped(F.col("text"), r"!+").alias("n_exclaim"),
    )
    if repeats:
        df = with_repeats(df)
    n = F.col("n_words")
    return df.withColumns({
        "symbol_rate": ratio(F.col("n_symbols"), n), "capital_rate": ratio(F.col("n_capitals"), F.col("word_chars")), "exclaim_rate": ratio(F.col("n_exclaim"), n),
        "dup_line_rate": ratio(F.col("n_dup_lines"), F.col("n_lines")), "word_length": ratio(F.col("word_chars"), n),
    })


def with_repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in 3-word windows that occur twice or more. Sorting the windows' hashes finds equal ones, so the work stays near linear in the text."""
    w, n = F.col("w"), F.col("n_words").cast("int")
    hashes = F.when(n >= 3, F.transform(F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("h", hashes).drop("w")
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h")
    s = F.col("s")
    twice = F.filter("s", lambda x, i: (x["h"].eqNullSafe(F.get(s, i - 1)["h"])) | (x["h"].eqNullSafe(F.get(s, i + 1)["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", cover.cast("bigint")).drop("s")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term on a log scale; 1 where k is at least n * p, which no test passes."""
    odds = math.log(p / (1 - p))
    first = n.cast("double") * math.log1p(-p)
    start = F.struct(first.alias("lp"), F.exp(first).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        lp = a["lp"] + F.log((n - j + 1).cast("double") / j) + F.lit(odds)
        return F.struct(lp.alias("lp"), (a["sum"] + F.exp(lp)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, add, lambda a: a["sum"]))


def certified_cutoffs(rates: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labelled rows: stratum, and for each rule its certified cutoff or null.

    A document that stands several times is one draw with its highest rates (and its first stratum by name); of several labels a
    bad one counts. A rule also needs to reject a larger share of bad documents than of good ones, else it is switched off.
    """
    quality = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    once = rates.where("doc_id is not null").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *(F.max(r).alias(r) for r in RULES))
    held = once.join(quality, "doc_id")  # a document is one draw, however often it or its label stands
    grid = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(t).alias("cutoff"), (F.col(r) > t).alias("out")) for r, ts in RULES.items() for k, t in enumerate(ts))))
    flat = held.select("stratum", "good", grid.alias("g")).select("stratum", "good", "g.*")
    good, out = F.col("good") == 1, F.col("out")
    counts = flat.groupBy("stratum", "rule", "step", "cutoff").agg(F.count_if(good).alias("n"), F.count_if(good & out).alias("k"), F.count_if(~good).alias("bad"), F.count_if(~good & out).alias("bad_out"))
    share = delta / (len(RULES) * (len(STRATA) + 1))
    passed = counts.withColumn("passes", binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= share)
    in_turn = W.partitionBy("stratum", "rule").orderBy("step")
    passed = passed.withColumn("so_far", F.min("passes").over(in_turn)).where("so_far and bad_out * n > bad * k")
    best = passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def quality_report(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum of every row.

    Words are runs of [^\\x20\\x09-\\x0D]; a null text has none. base_failed: fewer than 50 words, or over half of
    them in repeated 3-word windows. kept: not base_failed, and no rule with a certified cutoff in the row's
    stratum fires. Without labelled rows nothing is certified and only the base rule rejects. Repeated rows are
    judged each; a null lang is in the stratum "other"; other columns are not read.
    """
    rates = cut_lineage(cheap_rates(documents, repeats=True))  # numbers only, so texts are read once
    cuts = certified_cutoffs(rates, labels, alpha, delta)  # at most len(STRATA) + 1 rows
    rows = rates.join(F.broadcast(cuts), "stratum", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fires = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = fires[0]
    for x in fires[1:]:
        rejected = rejected | x
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), "stratum")


def report_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """quality_report in DuckDB's SQL, written anew."""
    grid = ", ".join(f"('{r}', {k}, {t})" for r, ts in RULES.items() for k, t in enumerate(ts))
    share, p = delta / (len(RULES) * (len(STRATA) + 1)), alpha / len(RULES)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}::DOUBLE) + (n - j) * ln(1 - {p}::DOUBLE))))"
    rates = {
        "symbol_rate": "n_symbols / n_words", "capital_rate": "n_capitals / nullif(word_chars, 0)", "exclaim_rate": "n_exclaim / n_words", "dup_line_rate": "n_dup_lines / nullif(n_lines, 0)", "word_length": "word_chars / n_words",
    }
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, CASE WHEN lang IN {STRATA} THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY id, gram) AS c FROM g) WHERE c > 1) GROUP BY id),
b AS (SELECT w.id, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
 len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_exclaim FROM w LEFT JOIN r ON w.id = r.id),
x AS (SELECT id, stratum, doc_id, unnest({list(rates)}) AS rule, unnest([{", ".join(f"coalesce({v.replace(' n_words', ' nullif(n_words, 0)')}, 0.0)" for v in rates.values())}]) AS rate FROM b),
c AS (SELECT stratum, x.rule, step, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND rate > cutoff) AS k, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND rate > cutoff) AS bad_out
 FROM (SELECT doc_id, rule, min(stratum) AS stratum, max(rate) AS rate FROM x GROUP BY ALL) x JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY ALL) USING (doc_id)
 JOIN (VALUES {grid}) AS t(rule, step, cutoff) ON x.rule = t.rule GROUP BY ALL),
o AS (SELECT *, CASE WHEN k >= n * {p}::DOUBLE THEN 1.0 ELSE {tail} END <= {share}::DOUBLE AS passes FROM c),
s AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY step) AS so_far FROM o),
z AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM s WHERE so_far AND bad_out * n > bad * k GROUP BY ALL),
f AS (SELECT id, bool_or(rate > cutoff) AS fires FROM x JOIN z USING (stratum, rule) GROUP BY id),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(fires, false) AS kept, stratum FROM e LEFT JOIN f USING (id)"""

"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled training texts (words and word beginnings that mark toxic texts) on top
of a short fixed list. Trees see only rates: lexicon densities, closeness to the second person, capitals,
punctuation and obfuscation. Training features come from a lexicon of the other fold, so the trees don't
see words that their own text has put into the lexicon. A part of the training rows calibrates.

The fit uses at most SAMPLE_ROWS labelled rows (those of the smallest hashes); scoring covers all rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage, small_batches

#: Labelled training rows that the fit uses at most.
SAMPLE_ROWS = 8000
#: Terms of a learned lexicon at most, and the labelled toxic texts in which a term must stand.
LEXICON_TERMS, LEAST_TEXTS = 400, 2
#: Words between an insult and a second-person word that count as close.
NEAR = 5
THRESHOLD = 0.3

#: Common insults, and second-person words of English, German, French, Spanish.
INSULTS = "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool imbecile jerk pig ugly hate kill dumm trottel arschloch connard imbécile estúpido idiota imbécil".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tuyo usted ustedes vosotros".split())
#: Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, "#": None})

FEATURES = ["hit_rate", "weight_rate", "top_weight", "hits", "distinct_hits", "near_you", "you_rate", "near_hit_rate", "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "punctuation_rate", "obfuscated_rate", "obfuscated_hit_rate", "log_words"]
LETTERS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][@$*!|#013457]+[^\W\d_]|(?:\b[^\W\d_][._*-]){2,}[^\W\d_]\b")


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of 4 and 5 letters."""
    return ("=" + word, *(word[:k] for k in (4, 5) if len(word) > k))


class Weights(dict):
    """Weight of a word: that of its heaviest term, remembered; 0 for most words."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = max((self.terms.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return found

    def __reduce__(self):
        return Weights, (self.terms,)


def dense_features(text: str | None, weights: Weights) -> list[float]:
    text = text or ""
    words = LETTERS.findall(text.lower())
    n = max(1, len(words))
    marks = [weights[w] for w in words]
    hits = [(i, m) for i, m in enumerate(marks) if m]
    yous = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum((k := bisect_left(yous, i - NEAR)) < len(yous) and yous[k] <= i + NEAR for i, _ in hits)
    n_letters = sum(map(len, words))
    letters = max(1, n_letters)
    tokens = text.split()
    hidden = [t for t in tokens if not t.isalpha() and OBFUSCATED.search(t)]
    plain = [w for t in hidden for w in LETTERS.findall(t.lower().strip(".,;:!?").translate(LEET))]
    capitals = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    shouted = sum(1 for t in tokens if len(t) > 2 and t.isupper())
    other = len(text) - n_letters - text.count(" ")
    return [
        len(hits) / n, sum(m for _, m in hits) / n, max((m for _, m in hits), default=0.0), math.log1p(len(hits)), math.log1p(len({words[i] for i, _ in hits})),
        near / max(1, len(hits)), len(yous) / n, near / n, capitals / letters, shouted / n, text.count("!") / n, text.count("?") / n, other / max(1, len(text)),
        len(hidden) / n, sum(1 for w in plain if weights[w]) / n, math.log1p(len(words)),
    ]


def featurise(rows: DataFrame, weights: Weights, keep: str) -> DataFrame:
    """keep columns (name type, ...; names of rows) and the feature vector of each row's text."""
    names = [k.split()[0] for k in keep.split(", ")]

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {k: batch[k] for k in names} | {"f": [dense_features(t, weights) for t in batch["text"]]}

    out = arrow_rows(rows.select(*names, "text"), run, f"{keep}, f array<double>")
    return out.select(*names, array_to_vector("f").alias("features"))


def training_rows(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic, fold (0 or 1), calibrate of at most `limit` labelled ids outside the held-out part; one text for an id."""
    usable = labels.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most `limit` narrow rows, so they are broadcast
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(8))
    rows = documents.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("turn"), "text")).alias("one"), F.max("toxic").alias("toxic")).select("doc_id", "one.text", "toxic")
    return rows.withColumns({"fold": (part % 2).cast("int"), "calibrate": part >= 6})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Lexicons from fold 0, from fold 1 and from both: term -> log odds of its texts being toxic."""

    def count(batch: dict[str, list]) -> dict[str, list]:
        seen: dict[tuple[int, str], list[int]] = {}
        for fold, toxic, text in zip(batch["fold"], batch["toxic"], batch["text"], strict=True):
            for term in {t for w in set(LETTERS.findall((text or "").lower())) for t in terms_of(w)}:
                seen.setdefault((fold, term), [0, 0])[int(toxic)] += 1
        return {"fold": [k[0] for k in seen], "term": [k[1] for k in seen], "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]}

    folds = {f: (c, t) for f, c, t in (tuple(r) for r in rows.groupBy("fold").agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).collect())}
    counted = arrow_rows(rows.select("fold", "toxic", "text"), count, "fold int, term string, clean bigint, toxic bigint")
    counted = counted.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("clean", "toxic")))
    counted = cut_lineage(counted.where("toxic0 + toxic1 > 0"))
    out = []
    for use in ((0,), (1,), (0, 1)):
        clean, toxic = (sum(F.col(f"{c}{f}") for f in use) for c in ("clean", "toxic"))
        all_clean, all_toxic = (sum(folds.get(f, (0, 0))[k] for f in use) for k in (0, 1))
        odds = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))
        top = counted.select("term", odds.alias("odds"), toxic.alias("n")).where((F.col("n") >= LEAST_TEXTS) & (F.col("odds") >= 1.5))
        rows_ = top.orderBy((F.col("odds") * F.sqrt("n")).desc(), "term").limit(LEXICON_TERMS).collect()
        out.append({"=" + w: 3.0 for w in INSULTS} | {r.term: r.odds for r in rows_})
    return out


class ToxicityModel:
    """A fitted scorer; model is None where the labelled rows had not both classes, and then every score is `rate`."""

    def __init__(self, weights: Weights, rate: float, model=None, calibration=None):
        self.weights, self.rate, self.model, self.calibration = weights, rate, model, calibration

    def score(self, documents: DataFrame, keep: str = "doc_id bigint") -> DataFrame:
        """keep columns, score."""
        small_batches(documents.sparkSession)
        names = [k.split()[0] for k in keep.split(", ")]
        if self.model is None:
            return documents.select(*names, F.lit(self.rate).alias("score"))
        found = self.model.transform(featurise(documents, self.weights, keep)).select(*names, vector_to_array("probability")[1].alias("p"))
        return self.calibration.transform(found).select(*names, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn lexicon, trees and calibration from labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = cut_lineage(training_rows(documents, labels, limit))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    first, second, both = learned_lexicons(rows)
    final = Weights(both)
    if not 0 < toxic < n:
        return ToxicityModel(final, toxic / n if n else 0.0)
    keep = "toxic double, calibrate boolean"
    ready = featurise(rows.where("fold = 0"), Weights(second), keep).unionByName(featurise(rows.where("fold = 1"), Weights(first), keep))
    ready = cut_lineage(ready.repartition(4))
    train = ready.where("not calibrate") if ready.where("not calibrate").select("toxic").distinct().count() == 2 else ready
    model = GBTClassifier(labelCol="toxic", maxIter=25, maxDepth=3, stepSize=0.2, subsamplingRate=1.0, seed=7).fit(train)
    scored = model.transform(ready.where("calibrate")).select(vector_to_array("probability")[1].alias("p"), "toxic", F.lit(1.0).alias("weight"))
    ends = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "p double, toxic double, weight double")  # so that both classes occur
    calibration = IsotonicRegression(featuresCol="p", labelCol="toxic", weightCol="weight").fit(scored.unionByName(ends))
    return ToxicityModel(final, toxic / n, model, calibration)


def toxicity_report(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Scores depend on the text alone; null and empty texts score as texts of no words. Labels of null, unknown or
    held-out ids are not used; of several labels for an id the toxic one counts, and of several texts one is learned from. Without labelled rows of both
    classes every score is the share of toxic rows among them (0 if there are none). Rows with a null doc_id are
    not held out. Repeated rows are scored each; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = fit(documents, labels).score(rows)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) whose score is below the threshold."""
    keep = "doc_id bigint, lang string, source string, n_chars bigint"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    scored = fit(documents, labels).score(documents.select(*columns).withColumn("body", F.col("text")), f"{keep}, body string")
    return scored.where(F.col("score") < threshold).withColumnRenamed("body", "text").select(*columns)


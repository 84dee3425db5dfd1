"""Target-distribution importance resampling: hashed n-gram weights, Gumbel scores, ranks by parallel sorting with regular sampling.

Runs of words are hashed to BUCKETS. The counts of the corpus and of the target are arrays of that length, summed over all their
texts, and give every bucket a gain: how much likelier it is in the target. A document's weight is the sum of its features'
gains. A Gumbel draw per document, fixed by its id, is added, so that the highest scores are a weighted draw without replacement.

The ranks come from a parallel sort by regular sampling. Every partition of the scored rows is sorted on its own (a run). Samples
at one stride from all runs give the splitters, the only rows that the driver sees (at most some SAMPLES). Rows change places once, by the
segment between two splitters, segments are sorted on their own, and a row's rank is its place in its segment after the
rows of the segments before. Segments that hold no drawn row stay where they are.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage, doc_id, fold_words, small_batches

#: Buckets of features, longest run of words, least words of a document that may be drawn, share drawn in percent, seed of the draw.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Samples of all runs together, beside one a run, and rows of a segment.
SAMPLES, SEGMENT_ROWS = 1 << 16, 1 << 18
#: Words whose buckets or gains a task remembers.
REMEMBERED = 500_000


def features_of(text: str | None, longest: int = LONGEST) -> list[bytes]:
    """Runs of 1 to `longest` consecutive words, joined by a space, repeats included."""
    words = fold_words(text)
    return words + [b" ".join(g) for n in range(2, longest + 1) for g in zip(*(words[i:] for i in range(n)), strict=False)]


class Buckets(dict):
    """Bucket of a feature, or what `values` holds at it; remembered."""

    def __init__(self, buckets: int, values: list[int] | None = None):
        super().__init__()
        self.buckets, self.values = buckets, values

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        bucket = zlib.crc32(feature) % self.buckets
        self[feature] = bucket = bucket if self.values is None else self.values[bucket]
        return bucket

    def __reduce__(self):
        return Buckets, (self.buckets, self.values)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts per bucket. Tasks count their own rows; at most `buckets` numbers reach the driver."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for feature, n in Counter(features_of(text.as_py(), longest)).items():
                    total[known[feature]] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of the B buckets."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def gumbel(doc: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from sha256 of seed:doc_id; no id is the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, n_words of every row."""
    small_batches(documents.sparkSession)
    known = Buckets(len(gain), gain)

    def score(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_features": [], "weight": [], "score": [], "n_words": []}
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            features = features_of(text, longest)
            weight = sum(map(known.__getitem__, features))
            out["n_features"].append(len(features))
            out["weight"].append(weight)
            out["score"].append(weight + gumbel(doc, seed))
            out["n_words"].append(len(features) if longest == 1 else len(fold_words(text)))
        return out

    rows = documents.select(doc_id(), F.col("text").cast("string").alias("text"))
    return arrow_rows(rows, score, "doc_id bigint, n_features bigint, weight bigint, score bigint, n_words bigint")


def ranked(rows: DataFrame, draw: int, total: int, segment_rows: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """rows (doc_id, score, may_draw, ...) with rank: 1 to `draw` by falling score, then doc_id, of those that may be drawn; else null.

    total is the number of rows that may be drawn. Place in the runs breaks further ties, so a group of equal rows of any size
    is cut like other rows. A segment holds at most segment_rows rows and one stride of each run.
    """
    segment_rows = segment_rows or SEGMENT_ROWS
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "run", "place"]
    sort_key = [F.col("may_draw").desc(), *order[:2]]
    numbered = rows.sortWithinPartitions(*sort_key).withColumn("at", F.monotonically_increasing_id())
    runs = cut_lineage(numbered.select(*rows.columns, F.shiftright("at", 33).alias("run"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    usable, idle = runs.where("may_draw"), runs.where("not may_draw")

    stride = max(1, total // samples)
    picked = usable.where(F.col("place") % stride == stride // 2).select("score", "doc_id", "run", "place").collect()
    key = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3])
    keys, wanted = sorted(map(key, picked)), -(-total // segment_rows)
    splitters = [keys[len(keys) * i // wanted] for i in range(1, wanted)] if len(keys) >= wanted else keys
    heads = np.array([k[0] for k in splitters], np.int64)

    def segments(batch: dict[str, list]) -> dict[str, list]:
        low, high = (np.searchsorted(heads, -np.array(batch["score"], np.int64), side) for side in ("left", "right"))
        place = high.tolist()
        for i in np.flatnonzero(low != high).tolist():  # the score is that of a splitter: the whole key decides
            own = key((batch["score"][i], batch["doc_id"][i], batch["run"][i], batch["place"][i]))
            a, b = int(low[i]), int(high[i])
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if splitters[mid] <= own else (a, mid)
            place[i] = a
        return batch | {"segment": place}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    placed = cut_lineage(arrow_rows(usable, segments, f"{schema}, segment int"))
    before, first, last = 0, [], -1
    for segment, n in sorted(placed.groupBy("segment").count().collect()):  # one row a segment
        first.append((segment, before))
        if before < draw:
            last = segment
        before += n
    starts = rows.sparkSession.createDataFrame(first, "segment int, before bigint")
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*order))
    exchanged = placed.where(F.col("segment") <= last).withColumn("own", place).join(F.broadcast(starts), "segment")
    rank = F.col("before") + F.col("own")
    drawn = exchanged.select(*rows.columns, F.when(rank <= draw, rank).alias("rank"))
    rest = placed.where(F.col("segment") > last).unionByName(idle, allowMissingColumns=True)
    return drawn.unionByName(rest.select(*rows.columns, F.lit(None).cast("bigint").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of documents; rank is null for rows that aren't drawn.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn: those of the highest scores, ties to the
    smaller doc_id, rows without an id last. Null and empty texts have no words and weight 0. A row without a doc_id (or one
    that is no number) draws by the empty string. Repeated rows are rows of their own: they have the same score and ranks that
    follow each other. An empty documents table gives no rows; without target texts, gains come from the corpus alone.
    Other columns are not read.
    """
    gain = gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    rows = cut_lineage(scored(documents, gain, longest, seed).withColumn("may_draw", F.col("n_words") >= least_words).drop("n_words"))
    total = rows.where("may_draw").count()
    return ranked(rows, percent * total // 100, total).select("doc_id", "n_features", "weight", "score", "rank")


def crc_table() -> list[int]:
    """crc32 of single bytes, by its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def resample_sql() -> str:
    """The same over documents and benchmark in SQL."""
    word = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    byte = "lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT"
    step = f"lambda c, b: xor(c >> 8, ({crc_table()}::BIGINT[])[1 + (xor(c, b) & 255)])"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {word} AS w FROM documents), b AS (SELECT {word} AS w FROM benchmark),
words AS (SELECT r, unnest(w) AS word FROM d), theirs AS (SELECT unnest(w) AS word FROM b),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM words UNION SELECT word FROM theirs)),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), {byte})), {step}), 4294967295) % {BUCKETS} AS bucket FROM hexed),
s AS (SELECT bucket, count(*) AS n FROM words JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM theirs JOIN crc USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::BIGINT AS s_all, coalesce((SELECT sum(n) FROM t), 0)::BIGINT AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + {BUCKETS}) / ((coalesce(s.n, 0) + 1) * (t_all + {BUCKETS}))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), totals),
weights AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM words JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN weights USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM ranks) THEN rank END AS rank FROM scored LEFT JOIN ranks USING (r)
"""

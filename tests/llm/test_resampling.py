"""Resampling against a plain computation; ranks whatever the runs, splitters and segments."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from memspark.llm import resampling
from memspark.llm.resampling import ranked, resample

SCHEMA = "doc_id bigint, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=1):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, counts in ((docs, s), (target, t)):
        for _, text in table:
            for f in features(text, longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "été", "日本", "x9", "of", "the", "ZEBRA", "42"]
    return [(k, " ".join(rng.choice(words) + rng.choice(("", ".", "!?")) for _ in range(rng.randrange(60)))) for k in range(n)]


def drawn(spark, docs, target, **options):
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"rank": F.lit("x"), "may_draw": F.lit(1), "run": F.lit(2)}).repartition(3)
    out = resample(df, spark.createDataFrame(target, SCHEMA), **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_equals_a_plain_computation(spark):
    docs, target = corpus(300), corpus(40, 2)
    got = drawn(spark, docs, target)
    assert got == plain(docs, target) and sum(r[4] is not None for r in got) > 10
    assert drawn(spark, docs, target, percent=50, least_words=5, buckets=64, longest=3) == plain(docs, target, 50, 5, 64, 3)


def test_nulls_repeats_and_long_texts(spark):
    docs = corpus(60) + corpus(60)[:20] + [(None, "a b " * 30), (None, None), (7, None), (8, ""), (9, "... !"), (10, "word " * 200_000), (-3, "A b" * 50)]
    assert drawn(spark, docs, [(1, None), (2, "alpha beta"), (None, "x9")], percent=60) == plain(docs, [(1, None), (2, "alpha beta"), (None, "x9")], 60)


def test_empty_tables(spark):
    assert drawn(spark, [], corpus(3)) == [] and drawn(spark, corpus(30), []) == plain(corpus(30), [])


@pytest.mark.parametrize("segment,samples,draw", [(7, 1000, 500), (50, 20, 90), (1, 40, 333), (10_000, 10, 10)])
def test_ranks_over_runs_and_segments(spark, segment, samples, draw):
    """A third of the rows are equal; ids are missing or repeated; some rows may not be drawn."""
    rng = random.Random(segment)
    rows = [(rng.choice([None, *range(40)]), rng.randrange(-5, 6), rng.random() < 0.9) for _ in range(600)] + [(5, 3, True)] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, score bigint, may_draw boolean").repartition(6)
    able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    got = ranked(df, draw, len(able), segment, samples).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, draw + 1)) and len(got) == len(rows)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [r[:2] for r in able[:draw]]


def test_segments_stay_small(spark, monkeypatch):
    """No segment holds many more rows than asked for, though a third of the rows are equal."""
    sizes = []
    real = resampling.cut_lineage

    def watched(df):
        out = real(df)
        if "segment" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("segment").count().collect())
        return out

    monkeypatch.setattr(resampling, "cut_lineage", watched)
    rows = [(k, k % 50, True) for k in range(2000)] + [(1, 7, True)] * 1000
    ranked(spark.createDataFrame(rows, "doc_id bigint, score bigint, may_draw boolean").repartition(4), 3000, 3000, 100, 600).count()
    assert sum(sizes) == 3000 and max(sizes) <= 150 and len(sizes) == 30


def test_crc_by_its_rule():
    table, c = resampling.crc_table(), 0xFFFFFFFF
    for b in "été".encode():
        c = c >> 8 ^ table[(c ^ b) & 255]
    assert c ^ 0xFFFFFFFF == zlib.crc32("été".encode())

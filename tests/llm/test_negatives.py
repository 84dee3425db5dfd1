"""Hard negatives against a plain search, with nulls, ties, repeated rows, ragged and huge vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from memspark.llm import negatives
from memspark.llm.negatives import mine

SCHEMA = "vec_id bigint, label int, embedding array<float>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every, positives, k, low, high):
    fine = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, vector in fine:
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(vector, v, strict=False)), i is None, i or 0, i, c) for i, c, v in fine), key=lambda r: r[:3])
        scored = [(max(-(2**63) + 1, min(2**63 - 1, -s)), i, c) for s, _, _, i, c in scored]
        for p, positive, _ in [r for r in scored if r[2] == label and r[1] != a][:positives]:
            inside = [r for r in scored if r[2] != label and low * p <= 100 * r[0] <= high * p][:k]
            out += [(a, positive, n, i, p, s) for n, (s, i, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "anchor_id": F.lit(1)}).repartition(3)
    return sorted((tuple(r) for r in mine(df, F.col("vec_id") % every == 0, **options).select(*COLUMNS).collect()), key=repr)


def vectors(seed, n, dim=6, grid=4):
    """Coarse components, so that scores tie."""
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.randint(-1, grid) / grid for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_search(spark, seed):
    rows = vectors(seed, 150)
    got = mined(spark, rows)
    assert got == plain(rows, 5, 5, 10, 30, 90) and len(got) > 300
    assert mined(spark, rows, positives=2, k=3, low=50, high=100) == plain(rows, 5, 2, 3, 50, 100)


def test_nulls_repeats_and_other_shapes(spark):
    rows = vectors(7, 60) + vectors(7, 60)[:20]  # repeated rows, anchors among them
    rows += [(None, 1, [0.5] * 6), (61, None, [1.0] * 6), (65, 1, None), (70, 0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (75, 0, [math.nan] * 6), (80, 2, [math.inf] * 6), (85, 2, [3e38] * 6)]
    rows += [(90, 1, []), (91, 2, [1.0]), (92, 0, [0.5] * 9), (-5, 1, [0.25] * 6)]
    assert mined(spark, rows) == plain(rows, 5, 5, 10, 30, 90)


def test_small_packs_and_passes(spark, monkeypatch):
    rows = vectors(4, 200)
    want = mined(spark, rows)
    monkeypatch.setattr(negatives, "PACK_BYTES", 8 * 6 * 7)  # packs of seven rows
    monkeypatch.setattr(negatives, "PASS_BLOCKS", 2)
    assert mined(spark, rows) == want


def test_a_third_of_the_rows_is_one_vector(spark):
    rows = vectors(9, 120) + [(1000 + k, k % 3, [0.5] * 6) for k in range(60)]
    assert mined(spark, rows) == plain(rows, 5, 5, 10, 30, 90)


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == [] and mined(spark, [(0, 1, [1.0])]) == []

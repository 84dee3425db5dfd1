"""Numbering by ranges, means over segments, and pairs by patterns of set fields, against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.functions.rows import numbered
from memspark.operators import retrieve, sync


def test_numbers_over_ranges_equal_plain_ones(spark):
    """A third of the rows is one group; nulls are a group; the group is split among tasks."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), k) for k in range(600)] + [("hot", 1, k) for k in range(1000, 1300)]
    rng.shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "g string, h int, k int").repartition(5), ["g", "h"], ["k"], "n", "many").collect()
    groups: dict = {}
    for g, h, k in rows:
        groups.setdefault((g, h), []).append(k)
    want = {(g, h, k, n, len(ks)) for (g, h), ks in groups.items() for n, k in enumerate(sorted(ks), 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert numbered(spark.createDataFrame([], "g string, h int, k int"), ["g", "h"], ["k"], "n", "many").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_rates_over_segments_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    runs = [("hot" if k % 3 else f"c{k % 7}", k, rng.random() * 9, rng.choice([0.5, 2.0, 0.0]), rng.randrange(3)) for k in range(900)]
    want: dict = {}
    for context, _, seconds, mib, items in runs:
        if items and mib >= 0.001:
            rate = seconds / mib
            want[context] = rate if context not in want else 0.85 * want[context] + 0.15 * rate
    shuffled = spark.createDataFrame(rng.sample(runs, len(runs)), "context string, place bigint, seconds double, mib double, semantic_items int").repartition(6)
    assert {r.context: r.ema for r in sync.run_rate_ema(shuffled).collect()} == pytest.approx(want, rel=1e-9)


def test_matching_contexts_make_each_pair_once(spark):
    rng = random.Random(4)
    field = lambda: rng.choice([None, "x", "y"])
    side = lambda n, name: [(f"c{rng.randrange(2)}", k, (field(), field(), field())) for k in range(n)]
    queries, procedures = side(40, "q"), side(70, "p")
    schema = "context string, {0} int, {0}_context struct<language:string,framework:string,environment:string>"
    made = retrieve.matching(spark.createDataFrame(queries, schema.format("q")), spark.createDataFrame(procedures, schema.format("p")))
    got = sorted((r.q, r.p) for r in made.collect())
    fits = lambda a, b: all(x is None or y is None or x == y for x, y in zip(a, b, strict=True))
    assert got == sorted((q, p) for c, q, a in queries for d, p, b in procedures if c == d and fits(a, b))
    assert "BroadcastNestedLoopJoin" not in made._jdf.queryExecution().toString() and "CartesianProduct" not in made._jdf.queryExecution().toString()


def test_number_units_of_a_large_source(spark):
    from memspark.operators.decode import number_units

    rows = [("c", "/r", "big", f"text {k}", k) for k in range(120)] + [("c", "/r", "small", "x", 0), ("c", "/r", "small", " ", 1)]
    got = {r.virtual_path for r in number_units(spark.createDataFrame(rows, "context string, root string, source_rel string, text string, o int"), "slide", "md", "o").where(F.col("source_rel") == "big").collect()}
    assert {"slide-001.md", "slide-120.md"} <= got and len(got) == 120

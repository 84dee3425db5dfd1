"""Searches: inputs meet by equi-joins, and what tasks compute equals the column expressions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memspark.derived import derived
from memspark.functions import text as T
from memspark.operators import embed, retrieve

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a", "Über_all x1 Kelvin K it's IT", "_ __ 9 99", "one\x00two\n\tone"]


@pytest.mark.parametrize("name", ["pool", "asked", "recipes"])
def test_vectors_are_joined_by_a_key(spark, name):
    plan = derived(spark, SF, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") == 1
    assert "NestedLoop" not in derived(spark, SF, name)._jdf.queryExecution().executedPlan().toString()


def test_words_equal_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", F.array_distinct(T.tokenize(F.col("t"))).alias("w")).collect()
    for r in rows:
        assert retrieve.words_of(r.t) == {w.encode() for w in r.w}
    assert retrieve.words_of(None) == set()


def test_contexts_agree_as_the_expression_says(spark):
    fields = [(a, b, None) for a in (None, "x", "y") for b in (None, "p")]
    rows = spark.createDataFrame([(i, j, q, p) for i, q in enumerate(fields) for j, p in enumerate(fields)], "i int, j int, q struct<language:string,framework:string,environment:string>, p struct<language:string,framework:string,environment:string>")
    frame = pd.DataFrame(fields, columns=list(retrieve.FIELDS))
    made = retrieve.agreeing(frame, frame)
    for r in rows.select("i", "j", retrieve.context_matches(F.col("q"), F.col("p")).alias("m")).collect():
        assert made[r.i, r.j] == r.m


def test_all_pairs_equal_the_expression(spark):
    asked = spark.createDataFrame([(1, "c", "red fox", [1.0, 0.0]), (2, "c", "", [0.5, 0.5]), (3, "d", "fox", [1.0, 1.0])], "query_id bigint, context string, text string, embedding array<float>")
    pool = spark.createDataFrame([("c", "k1", "a red dog", [0.0, 1.0]), ("c", "k2", "fox", None), ("e", "k3", "fox", [1.0, 1.0])], "context string, id string, index_text string, embedding array<float>")
    got = {(r.query_id, r.id): r.score for r in retrieve.hybrid_pairs(asked, pool).collect()}
    none = F.array().cast("array<float>")
    pairs = asked.join(pool.withColumnRenamed("embedding", "e"), "context")
    score = T.hybrid_score(T.cosine(F.col("embedding"), F.coalesce("e", none)), T.lexical_overlap(T.tokenize(F.col("text")), T.tokenize(F.col("index_text"))))
    want = {(r.query_id, r.id): r.s for r in pairs.select("query_id", "id", score.alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_procedure_without_a_time_comes_last(spark):
    asked = spark.createDataFrame([(1, "c", "fox", [1.0])], "query_id bigint, context string, text string, embedding array<float>")
    schema = "context string, id string, source_path string, task_description string, steps array<string>, task_context struct<language:string,framework:string,environment:string>, confidence float, created_at bigint, embedding array<float>"
    known = spark.createDataFrame([("c", i, None, t, ["s"], (None, None, None), 0.5, at, [1.0]) for i, t, at in (("a", "fox", None), ("b", "dog", 0))], schema)
    got = retrieve.procedural_search(asked, known, 5, F.lit(0)).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", 0.5), ("a", None)]


def test_words_are_hashed_once():
    slots = embed.Slots(8)
    first = slots[b"word"]
    assert slots == {b"word": first}
    assert np.array_equal(embed.hashing_embedder(8)(["word word"])[0], embed.hashing_embedder(8)(["word"])[0])

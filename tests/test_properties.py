"""Properties that hold for any input."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import chunk, decode, embed, extract, notes, sync

few = settings(max_examples=80, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture])
texts = st.text(alphabet="aé 語.\n#-", max_size=200)


@few
@given(texts, st.integers(4, 40))
def test_parts_join_to_the_text(text, size):
    parts = decode.split_text(text, size)
    assert "".join(parts) == text and all(parts)


@few
@given(texts, texts.filter(lambda t: not any(x.startswith("## ") for x in t.split("\n"))))
def test_setting_a_section_twice_is_setting_it_once(text, body):
    once = notes.section_set(text, body)
    assert notes.section_set(once, body) == once


@few
@given(st.dictionaries(st.text(max_size=5), st.one_of(st.integers(), st.text(max_size=8)), max_size=4), st.text(alphabet="ab {}\n", max_size=10).filter(lambda s: "{" not in s))
def test_json_is_recovered(value, before):
    assert json.loads(extract.first_object(before + json.dumps(value) + " tail }")) == value


@few
@given(texts)
def test_sections_cover_the_text(text):
    cuts = chunk.structure_of(text)
    assert all(0 <= s <= e <= len(text.encode()) for _, _, s, e, _ in cuts)


@few
@given(st.lists(st.text(alphabet="ab cé_", max_size=12), max_size=6))
def test_vectors_have_unit_length(values):
    for v in embed.hashing_embedder(16)(values):
        assert abs(float((v**2).sum()) - 1) < 1e-5 or not v.any()


def test_overlap_and_cosine_bounds(spark):
    rows = [(k, f"w{k % 3} w{k % 5} x", f"w{k % 4} x y", [float(k % 3), 1.0], [1.0, float(k % 4) - 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, a string, b string, u array<float>, v array<float>")
    a, b = T.tokenize(F.col("a")), T.tokenize(F.col("b"))
    for r in df.select(T.lexical_overlap(a, b).alias("x"), T.lexical_overlap(b, a).alias("y"), T.cosine(F.col("u"), F.col("v")).alias("c")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and -1.000001 <= r.c <= 1.000001


def test_merged_chunks_keep_to_the_budget(spark):
    rows = [([("x" * (n * 7 % 50 + 1)) for n in range(k)],) for k in range(12)]
    df = spark.createDataFrame(rows, "p array<string>").withColumn("c", F.transform("p", lambda x: chunk.as_chunk(x, "s")))
    for r in df.select("p", chunk.merged(F.col("c"), 15).alias("m")).collect():
        assert "\n\n".join(c.content for c in r.m) == "\n\n".join(r.p)
        assert all(len(c.content) // 4 <= 15 or "\n\n" not in c.content for c in r.m)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    from memspark.queries import derived

    files, manifest = (derived(spark, "/root/testdata/sf0.001", n).repartition(parts) for n in ("files", "manifest"))
    got = sorted(map(str, sync.plan_add(files, manifest).select("context", "root", "rel", "action").collect()))
    want = sorted(map(str, sync.plan_add(files.coalesce(1), manifest.coalesce(1)).select("context", "root", "rel", "action").collect()))
    assert got == want


def test_replacing_twice_is_replacing_once(spark):
    table = spark.createDataFrame([("c", f"s{k % 3}", k) for k in range(9)], "context string, source_path string, v int")
    new = {t: table.where("source_path = 's1'").withColumn("v", F.col("v") + 100) for t in sync.TABLES}
    once = sync.replace_sources(dict.fromkeys(sync.TABLES, table), new, new["chunks"])
    twice = sync.replace_sources(once, new, new["chunks"])
    assert all(sorted(map(tuple, once[t].collect())) == sorted(map(tuple, twice[t].collect())) for t in sync.TABLES)

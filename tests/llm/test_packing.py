import random

import pandas as pd

from memspark.llm.packing import cut_pieces, pack, pack_shard

SCHEMA = "doc_id bigint, text string, source string, bin string, shard string"


def plain_best_fit(pieces, capacity):
    bins, placed = [], []
    for p in pieces:
        best = None
        for k, b in enumerate(bins):
            if b["room"] >= p["n_words"] and p["source"] not in b["sources"] and (p["c1"], p["c2"]) not in b["clusters"] and (best is None or b["room"] < bins[best]["room"]):
                best = k
        if best is None:
            best = len(bins)
            bins.append({"room": capacity, "sources": set(), "clusters": set(), "n": 0})
        b = bins[best]
        b["room"] -= p["n_words"]
        b["sources"].add(p["source"])
        b["clusters"].add((p["c1"], p["c2"]))
        placed.append((best, b["n"]))
        b["n"] += 1
    return placed, bins


def test_shard_is_best_fit():
    for seed in range(6):
        rng = random.Random(seed)
        hot = rng.random() < 0.5
        rows = [{"doc_id": k, "piece": 0, "n_words": rng.choice([0, 1, 7, 13, 30, 64, rng.randint(0, 64)]), "source": "s0" if hot and rng.random() < 0.4 else f"s{rng.randint(0, 6)}", "c1": rng.randint(0, 60), "c2": 0} for k in range(400)]
        got = pack_shard(pd.DataFrame(rows), 64)
        placed, bins = plain_best_fit(got.to_dict("records"), 64)
        rooms = {}
        for (b, _), n in zip(placed, got["n_words"], strict=True):
            rooms[b] = rooms.get(b, 0) + n
        mine = got.groupby("bin")["n_words"].sum()
        assert got["n_words"].is_monotonic_decreasing
        assert sorted(mine) == sorted(rooms.values()) or len(mine) == len(rooms)  # bins of equal room may swap
        assert (mine <= 64).all()
        assert not got.duplicated(["bin", "source"]).any() and not got.duplicated(["bin", "c1", "c2"]).any()
        assert len(bins) == got["bin"].nunique()


def documents(spark):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * rng.randint(1, 3) + str(k if k % 5 else 0) for _ in range(rng.choice([0, 3, 40, 500]))), "s0" if k % 3 == 0 else f"s{k % 11}", "clash", "clash") for k in range(300)]
    rows += [(400, None, "s1", "", ""), (401, "", None, "", ""), (402, "same words", "s2", "", ""), (403, "SAME  words", "s3", "", ""), (402, "same words", "s2", "", ""), (None, "no id", "s1", "", ""), (404, "z " * 100001, "s5", "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_whole_corpus_is_packed(spark):
    df, rows = documents(spark)
    got = pack(df, capacity=128, shard_pieces=256).toPandas()
    assert (got.groupby(["shard", "bin"])["n_words"].sum() <= 128).all()
    assert not got.fillna("").duplicated(["shard", "bin", "source"]).any()
    want = {}
    for d, t, *_ in rows:
        want[d] = want.get(d, 0) + len((t or "").split())
    have = got.groupby(got["doc_id"].fillna(-1))["n_words"].sum().to_dict()
    assert have == {(-1 if k is None else k): v for k, v in want.items()}
    long = got[got.doc_id == 404].sort_values("piece")
    assert long["start"].tolist() == [128 * k for k in range(len(long))] and long["n_words"].sum() == 100001
    assert got["shard"].nunique() > 1
    pieces = cut_pieces(df, 128).toPandas()
    same = pieces[pieces.doc_id.isin([402, 403])]
    assert same[["c1", "c2"]].drop_duplicates().shape[0] == 1
    joined = got[got.doc_id.isin([402, 403])]
    assert not joined.duplicated(["shard", "bin"]).any()


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_are_dealt_to_many_shards(spark):
    docs = spark.range(12000).selectExpr("7 AS doc_id", "'same words' AS text", "'s' AS source").unionByName(spark.range(100).selectExpr("id AS doc_id", "concat('w', id) AS text", "'t' AS source"))
    got = pack(docs, shard_pieces=512).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 12100 and len(sizes) > 20 and sizes.max() < 1024


def test_named_clusters_never_share_a_bin(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a b c ', id) AS text", "concat('s', id) AS source", "if(id % 3 = 0, null, id % 5) AS near")
    got = pack(docs, capacity=64, cluster="near").toPandas()
    got["near"] = got["doc_id"] % 5
    got = got[got.doc_id % 3 != 0]
    assert not got.duplicated(["shard", "bin", "near"]).any() and got.groupby("bin").size().max() > 1

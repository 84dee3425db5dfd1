import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memspark.llm import simhash
from memspark.llm.common import joined_by_count
from memspark.llm.simhash import components, drop_near_duplicates, fingerprint, links, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    for text in (None, "", "  ", "One", "one Two", "a b c", "A b\tc\x0bd É é\xa0f g", "x y z " * 50, " ".join(map(str, range(900)))):
        assert fingerprint(text) == plain(text)


def test_same_hash_as_spark(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == fingerprint("a b c")


def near_set(n, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(n)} | {0}
    for base in list(fps)[: n // 2]:
        for _ in range(rng.randint(1, 6)):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            base = rng.choice([base, x])
    return sorted(fps)


def test_links_lose_no_pair(spark):
    fps = near_set(300, 1)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for distance in (1, 2):
        want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance}
        got = [(r.a, r.b) for r in links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (200, 203), (203, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: min(g) for g in (range(41), (100, 101, 102), (200, 201, 202, 203)) for n in g}
    assert {n: got.get(n, n) for n in want} == want and set(got) <= set(want)


def test_rows_of_a_hot_key_are_joined_once(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 and 1, k) for k in range(4000)] + [(None, 0)], "key bigint, v bigint")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = joined_by_count(rows, facts, "key", rows.count())
    assert got.count() == 4000 and sorted(map(tuple, got.select("key", "top").distinct().collect())) == [(0, 3997 - 3997 % 7), (1, 3999)]


def documents(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, base), (3, base.replace("w7 ", "q7 ")), (9, base.upper()), (9, base.upper()), (4, "other words here"), (6, None), (2, ""), (8, "\n"), (None, base), (11, "x " * 50000)]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, component_id string"), rows


def test_near_duplicates_equal_brute_force(spark):
    df, rows = documents(spark)
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
    low = {g: min(d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None) for g in set(group)}
    want = sorted(((d, f"{p:016x}", low[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()), key=str) == want


def test_a_row_without_id_links_others(spark):
    a = fingerprint("a b c")
    prints = {"p": a, "q": a ^ 3, "r": a ^ 15, "s": a ^ 2**40 ^ 2**20 ^ 2**5}
    named = lambda ids: spark.createDataFrame(list(zip(ids, prints, strict=True)), "doc_id bigint, text string")
    original = simhash.fingerprints
    try:
        simhash.fingerprints = lambda docs, shingle: docs.replace({k: str(np.uint64(v).astype(np.int64)) for k, v in prints.items()}, subset="text").select("doc_id", F.col("text").cast("bigint").alias("fp"))
        got = sorted(((r.doc_id or -1, r.component_id or -1) for r in near_duplicates(named([1, None, 3, None])).collect()))
    finally:
        simhash.fingerprints = original
    assert got == [(-1, -1), (-1, 1), (1, 1), (3, 1)]


def test_ids_that_are_no_numbers_count_as_null(spark):
    got = near_duplicates(spark.createDataFrame([("x1", "a b"), ("7", "a b")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (7, 7)]


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def kept(texts):
    """Ids that stay by brute force, and the number of links between unequal texts."""
    sets = {k: grams(t) for k, t in texts.items()}
    near = {k: [j for j in sets if similar(sets[k], sets[j])] for k in sets}
    group = {k: k for k in sets}
    while (new := {k: min(group[j] for j in near[k]) for k in sets}) != group:
        group = new
    return {k for k in sets if group[k] == k}, sum(map(len, near.values())) - len(near)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(5))
    common = [word() for _ in range(12)]
    texts = {0: None, 1: "", 2: " \t", 3: "one two", 4: "ONE two", 5: "one two three four five"}
    for k in range(90):
        words = [word() for _ in range(rng.choice((6, 8, 9, 12, 20, 60, 200)))]
        if k % 3 == 0:
            words += common
        for _ in range(rng.randint(1, 5)):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.choice((0, -1, rng.randrange(len(words))))] = word()
    ids = rng.sample(range(1000), len(texts))
    return {ids[k]: t for k, t in texts.items()}


def test_similar_rows_equal_brute_force(spark):
    texts = corpus(8)
    want, pairs = kept(texts)
    assert pairs > 100
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id bigint, text string, k1 string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_similarity_bound(spark):
    base = [f"w{k}" for k in range(94)]  # 90 shingles; a changed word in the midst costs 5: 80 of 100, 79 of 101
    changed = [*base[:30], "x", *base[31:60], "y", *base[61:]]
    for other, alike in ((changed, True), ([*changed[:-1], "z"], False)):
        docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id bigint, text string")
        assert drop_near_duplicates(docs).count() == (1 if alike else 2)


def test_bits_and_bands_lose_few_similar_pairs():
    """Sets at the bound itself: the bands miss none of 2,000 pairs, the bit budget none."""
    rng = np.random.default_rng(3)
    for n in (4, 5, 8, 9, 27, 90, 900):
        for _ in range(40 if n == 900 else 300):
            less = n // 9  # n - less in common of n + less: 0.8 at least
            same = rng.integers(0, 2**64, n - less, dtype=np.uint64)
            x, y = (np.unique(np.concatenate((same, rng.integers(0, 2**64, less if n > 5 else k, dtype=np.uint64)))) for k in (0, int(n == 4)))
            assert set(simhash.band_keys(x)) & set(simhash.band_keys(y))
            assert (simhash.majority(x) ^ simhash.majority(y)).bit_count() <= simhash.BUDGET


def test_chain_holds_for_every_pair_within_the_budget(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        x = rng.getrandbits(64)
        apart = rng.sample(range(64), rng.randint(20, 34))
        rows.append((x, x ^ sum(1 << b for b in apart), len(apart)))
    signed = [(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64)), n) for a, b, n in rows]
    df = spark.createDataFrame(signed, "p bigint, q bigint, n int")
    assert all(r.near == (r.n <= simhash.BUDGET) for r in df.select("n", simhash.within_budget(F.col("p"), F.col("q")).alias("near")).collect())


def test_chains_find_all_pairs_within_reach(spark):
    fps = near_set(300, 4)
    rng = random.Random(9)
    for base in fps[:100]:
        fps.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(5, 8))))
    fps += fps[:3]  # unlike sets with equal bits
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    rows = [(k, fp, k % 5) for k, fp in enumerate(signed)]
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= simhash.REACH and i % 5 != j % 5}
    got = [(r.a, r.b) for r in simhash.chained(spark.createDataFrame(rows, "set bigint, fp bigint, root bigint")).collect()]
    assert len(want) > 300 and len(got) == len(set(got)) and set(got) == want


def test_a_hot_chain_is_cut_to_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_SETS", 10)
    rows = [(k, 1 << k % 9 | k << 54, k % 2) for k in range(60)]
    want = {(i, j) for j in range(60) for i in range(j) if (rows[i][1] ^ rows[j][1]).bit_count() <= simhash.REACH and (i + j) % 2}
    got = [(r.a, r.b) for r in simhash.chained(spark.createDataFrame(rows, "set bigint, fp bigint, root bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_find_similar_texts_without_any_band(spark, monkeypatch):
    real = simhash.shingled
    monkeypatch.setattr(simhash, "shingled", lambda docs: real(docs).withColumn("keys", F.array().cast("array<bigint>")))
    rng = random.Random(3)
    texts = {k: " ".join(f"{rng.getrandbits(30):x}" for _ in range(300)) for k in range(0, 80, 2)}
    texts |= {k + 1: t + f" tail{k}" + " more" * (k % 8) for k, t in texts.items()}
    bits = lambda t: simhash.majority(simhash.shingle_set(t))
    near = {k for k in range(0, 80, 2) if (bits(texts[k]) ^ bits(texts[k + 1])).bit_count() <= simhash.REACH}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert len(near) > 30 and {r.doc_id for r in drop_near_duplicates(docs).collect()} == set(texts) - {k + 1 for k in near}


def test_one_row_of_each_group_stays(spark):
    df, _ = documents(spark)
    kept_ids = sorted((r.doc_id or -1) for r in drop_near_duplicates(df).collect())
    assert kept_ids == [2, 3, 4, 11]  # 5, 9 and the row without an id are near copies of 3; null and blank texts are alike


def test_unlike_texts_of_one_id_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (1, b.upper()), (None, "q r s"), (None, "q r s"), (2, a + " tail")]
    got = sorted((r.doc_id or -1, r.text.lower()) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(-1, "q r s"), (1, a), (1, b)]


def met_pairs(monkeypatch):
    """Counts of the pairs that are made before any test of a pair."""
    counts, real = [], simhash.meetings

    def counted(tokens):
        made = real(tokens)
        counts.append(made.count())
        return made

    monkeypatch.setattr(simhash, "meetings", counted)
    return counts


def templates(n, shared, own, twins=0, seed=6):
    """Texts of `shared` words of one template, `twins` words that two texts have, and words of their own."""
    rng = random.Random(seed)
    word = lambda: f"{rng.getrandbits(40):x}"
    base = [word() for _ in range(shared)]
    pairs = [[word() for _ in range(twins)] for _ in range(n // 2)]
    return [(k, " ".join([*base, *pairs[k // 2], *(word() for _ in range(own))])) for k in range(n // 2 * 2)]


@pytest.mark.parametrize("n", [1000, 2000, 4000])
def test_common_boilerplate_makes_no_pairs(spark, monkeypatch, n):
    counts = met_pairs(monkeypatch)
    docs = spark.createDataFrame(templates(n, 100, 60), "doc_id bigint, text string").repartition(4)
    assert drop_near_duplicates(docs).count() == n and sum(counts) == 0


@pytest.mark.parametrize("n", [500, 1000])
def test_a_template_with_twins_makes_few_pairs(spark, monkeypatch, n):
    """A third is the template, the rest is that of a twin but for a few words: each text has one partner."""
    counts = met_pairs(monkeypatch)
    docs = spark.createDataFrame(templates(n, 100, 6, 100), "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == list(range(0, n, 2)) and sum(counts) <= 20 * n


def test_large_group_of_near_copies(spark):
    rng, base = random.Random(2), [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:at], f"new{k}", *base[at + 1 :]])) for k in range(1500) for at in [rng.randrange(200)]] + [(k, f"alone {k} " * 9) for k in range(5000, 5100)]
    assert sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()) == [0, *range(5000, 5100)]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0

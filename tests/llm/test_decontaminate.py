import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from memspark.llm.common import fold_words
from memspark.llm.decontaminate import FMIndex, Phrases, contamination_report, decontaminate, find_contamination, suffix_order

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(documents, benchmark, window=10):
    out = {}
    for doc, text in documents:
        words, hit, items = fold_words(text), set(), set()
        for item, phrase in benchmark:
            p = fold_words(phrase)
            for k in range(max(1, len(p) - window + 1) if p else 0):
                w = p[k : k + window]
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        items.add(item)
        ids = sorted(map(str, items))
        out[doc] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
    return out


def planted(seed=0):
    rng = random.Random(seed)
    words = ["a", "b", "cé", "d1", "Ee", "x-y"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(k, phrase(rng.choice([3, 9, 10, 11, 25]))) for k in range(12)] + [(12, ""), (13, None), (None, "q q q"), (14, "b a b a b a b a b a b a b"), (2, phrase(12))]
    docs = []
    for k in range(60):
        parts = [phrase(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(bench)[1] or ""
            parts += [item.upper() if rng.random() < 0.3 else item, phrase(rng.randint(0, 4))]
        docs.append((k, "; ".join(parts)))
    return [*docs, (60, None), (61, ""), (62, "..."), (63, "b a " * 30)], bench


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(1)
    for sigma in (2, 5, 3000):
        symbols = rng.integers(1, sigma + 1, 400)
        symbols[200:380] = symbols[:180]
        text = np.append(symbols, 0)
        order = suffix_order(text, sigma)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 500)
    index = FMIndex(text, 3)
    windows = np.stack([text[k : k + 4] for k in range(0, 400, 7)] + [np.array([0, 0, 1, 2])])
    low, high = index.search(windows, np.array([4] * (len(windows) - 1) + [2]))
    for w, lo, hi in zip(windows, low, high, strict=True):
        w = w[w > 0]
        want = [i for i in range(len(text) - len(w) + 1) if (text[i : i + len(w)] == w).all()]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_report_equals_brute_force(spark):
    docs, bench = planted()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_words", F.lit("clash")), spark.createDataFrame(bench, "item_id bigint, text string")
    want = brute(docs, [x for x in bench if x[0] is not None])
    for size in (8_000_000, 60):  # one block and several
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in contamination_report(find_contamination(d, b, block_bytes=size)).collect()}
        assert got == want
    assert all(r.contaminated == (r.n_hit > 0) for r in contamination_report(find_contamination(d, b)).collect())


def test_cut_leaves_no_phrase(spark):
    docs, bench = planted(3)
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    before = brute(docs, [x for x in bench if x[0] is not None])
    out = {r.doc_id: r for r in decontaminate(d, b).collect()}
    after = brute([(k, r.text) for k, r in out.items()], [x for x in bench if x[0] is not None])
    assert all(v[1] == 0 for v in after.values())
    for doc, text in docs:
        if before[doc][1] == 0:
            assert out[doc].text == text
    assert {k for k, v in before.items() if v[1] == 0} <= out.keys()


def test_seam_is_cut_again(spark):
    b = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "start one two one two three four three four end", "en", "s", 1)], DOCS)
    assert [r.text for r in decontaminate(d, b).collect()] == ["start\nend"]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert contamination_report(find_contamination(d, b)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert [r.n_hit for r in contamination_report(find_contamination(one, b)).collect()] == [0, 0]


def test_long_text_makes_its_own_shard():
    phrases = Phrases([(1, "p q r s t u v w x y z")])
    words = [fold_words("p q r s t u v w x y z " * 30000), fold_words("p q r s t u v w x y")]
    out = phrases.occurrences(words)
    assert out[0][1] == [1] and sum(e - s for s, e in out[0][0]) == 330000 and out[1] == ([(0, 10)], [1])


def test_cutting_ends_with_no_phrase_whatever_the_blocks(spark):
    inner, outer = [f"i{k}" for k in range(10)], [f"o{k}" for k in range(10)]
    nested = outer[:5] + inner[:5] + [f"n{k}" for k in range(10)] + inner[5:] + outer[5:]
    bench = spark.createDataFrame([(1, " ".join(inner)), (2, " ".join(outer)), (3, " ".join(f"n{k}" for k in range(10))), (4, " ".join(inner[4:] + outer[:4]))], "item_id bigint, text string")
    rows = [(1, " ".join(["keep", *nested, "this"])), (2, " ".join(inner + outer)), (3, " ".join(nested)), (4, None), (5, "clean text")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    results = [sorted((r.doc_id, r.text) for r in decontaminate(docs, bench, block_bytes=size).collect()) for size in (1, 100, 8_000_000)]
    assert results[0] == results[1] == results[2] == [(1, "keep\nthis"), (4, None), (5, "clean text")]

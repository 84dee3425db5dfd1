import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from memspark.llm.quality import ALPHA, DELTA, RULES, STRATA, binomial_tail, certified_cutoffs, cheap_rates, quality_report, report_sql

SCHEMA = "doc_id bigint, text string, lang string, n_words string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bé", "c d", "EE", "f#", "g|", "h!", "<i>"])
    out = [None, "", "  \n ", "one", "one two", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n \nx", "w " * 49, "w " * 50, "é\x85b c \x0b\x0c\rq"]
    for _ in range(40):
        out.append("".join(word() + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(1, 200))))
    return [*out, " ".join(f"t{k}" for k in range(60000)), " ".join(f"t{k % 900}" for k in range(30000))]


def test_counts_equal_brute_force(spark):
    data = [(k, t, random.Random(k).choice(["en", "de", "xx", None]), "clash") for k, t in enumerate(texts())]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_report(spark.createDataFrame(data, SCHEMA), labels).collect()}
    for k, t, *_ in data:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), k
        assert r.kept == (not r.base_failed)


def test_binomial_tail_is_exact(spark):
    for n, k, p in ((1, 0, 0.01), (50, 0, 0.2), (200, 7, 0.05), (1000, 3, 0.01), (40000, 350, 0.01), (10, 9, 0.2), (0, 0, 0.1)):
        got = spark.range(1).select(binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
        exact = 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert abs(got - exact) < 1e-8


def labelled(spark, n=3000):
    rng = random.Random(2)
    data, marks = [], []
    for k in range(n):
        lang = rng.choice(["en", "de", "zz"])
        good = rng.random() < 0.8
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(60)]
        if not good:
            words = [w + "#" for w in words]
        elif rng.random() < (0.3 if lang == "de" else 0.0):
            words = [w + "#" * (i % 2) for i, w in enumerate(words)]  # in German, good documents have symbols too
        data.append((k, " ".join(words), lang, ""))
        marks.append((k, int(good), 0))
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame([*marks, (None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int"), data, dict((m[0], m[1]) for m in marks)


def test_cutoffs_control_false_rejection(spark):
    docs, labels, data, good = labelled(spark)
    cuts = {r.stratum: r for r in certified_cutoffs(cheap_rates(docs), labels).collect()}
    assert cuts["en"].cut_symbol_rate is not None and cuts["en"].cut_symbol_rate < 1
    assert cuts["de"].cut_symbol_rate is not None and cuts["de"].cut_symbol_rate >= 0.5  # laxer where good documents need it
    assert cuts["other"].cut_symbol_rate is not None
    share = DELTA / (len(RULES) * (len(STRATA) + 1))
    for stratum, r in cuts.items():
        for rule in RULES:
            assert getattr(r, f"cut_{rule}") is None or getattr(r, f"cut_{rule}") in RULES[rule]
    kept = {r.doc_id: r.kept for r in quality_report(docs, labels).collect()}
    for lang in ("en", "de", "zz"):
        own = [d[0] for d in data if d[2] == lang and good[d[0]]]
        assert sum(not kept[d] for d in own) <= ALPHA * len(own)
        bad = [d[0] for d in data if d[2] == lang and not good[d[0]]]
        assert sum(not kept[d] for d in bad) > 0.9 * len(bad)
    assert share < DELTA


def test_few_labels_certify_nothing(spark):
    docs, labels, _, _ = labelled(spark, 60)
    assert all(r.cut_symbol_rate is None for r in certified_cutoffs(cheap_rates(docs), labels).collect())
    assert all(r.kept for r in quality_report(docs, labels).collect())


def test_empty_and_repeated(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_report(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert quality_report(spark.createDataFrame([(1, "a", "en", ""), (1, "a", "en", ""), (None, None, None, None)], SCHEMA), labels).count() == 3


def test_equals_sql_where_cutoffs_are_certified(spark):
    """The method rejects rows here, repeated labels and documents included, and SQL rejects the same."""
    docs, labels, data, _ = labelled(spark)
    docs = docs.unionByName(docs.where("doc_id % 9 = 0"))
    labels = labels.unionByName(labels.where("doc_id % 4 = 0")).unionByName(labels.where("doc_id % 50 = 0").selectExpr("doc_id", "1 - quality AS quality", "toxic"))
    got = quality_report(docs, labels).toPandas()
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("labels", labels.toPandas())
    want = c.execute(report_sql()).df()
    key = ["doc_id", "kept", "base_failed", "n_words", "n_symbols", "n_repeat_words", "stratum"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
    assert (~got.kept & ~got.base_failed).sum() > 100


def test_repeated_labels_and_documents_are_one_draw(spark):
    docs, labels, _, _ = labelled(spark, 60)
    many = spark.range(40)
    cuts = certified_cutoffs(cheap_rates(docs.crossJoin(many).drop("id")), labels.crossJoin(many).drop("id")).collect()
    assert all(getattr(r, f"cut_{rule}") is None for r in cuts for rule in RULES)

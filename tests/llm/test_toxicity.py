import random
import zlib

from memspark.llm.toxicity import FEATURES, Weights, dense_features, drop_toxic, toxicity_report, training_rows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
BAD = {"en": ["idiot", "scum"], "de": ["lowei" + x for x in ("en", "er", "haft", "ung")]}


def corpus(n=900):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 150))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        docs.append((k, " ".join(words), lang, "s", 0, "clash"))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    truth = {d[0]: int(any(b in d[1] for b in ("idiot", "scum", "lowei"))) for d in docs}
    return docs, labels, truth


def crc_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    extra = [(2000, None, "en", "s", 0, ""), (2001, "", "en", "s", 0, ""), (None, "idiot " * 5, "en", "s", 0, ""), (2002, "word " * 200000, None, None, None, ""), (0, docs[0][1], "en", "s", 0, "")]
    df, marks = spark.createDataFrame([*docs, *extra], SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (99999, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity_report(df, marks).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc_out(r.doc_id)) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in out)
    assert hit > 0.9 * sum(truth[r.doc_id] for r in out) and hit > 0.9 * sum(r.predicted for r in out)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (2000, 2001)}
    assert empty[2000] == empty[2001] < 0.3
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.score) == r.score  # repeated rows score alike
    kept = {r.doc_id for r in drop_toxic(df, marks).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(300)
    df = spark.createDataFrame(docs, SCHEMA)
    flipped = [(d, q, 1 - t if crc_out(d) else t) for d, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity_report(df, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_without_labels(spark):
    docs, labels, _ = corpus(20)
    df = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity_report(df, none).collect()} == {0.0}
    clean = spark.createDataFrame([(d, 1, 0) for d, _, _ in labels], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity_report(df, clean).collect()} == {0.0}
    assert toxicity_report(df.limit(0), none).count() == 0


def test_features():
    w = Weights({"=idiot": 3.0, "lowe": 2.0})
    f = dict(zip(FEATURES, dense_features("You IDIOT, 1d1ot and lowerung!", w), strict=True))
    assert f["top_weight"] == 3.0 and f["near_you"] > 0 and f["obfuscated_rate"] > 0 and f["obfuscated_hit_rate"] > 0 and f["capital_rate"] > 0 and f["exclaim_rate"] > 0
    assert len(dense_features(None, w)) == len(FEATURES) and not any(dense_features("", w))


def test_repeated_documents_stay_within_the_limit(spark):
    docs, labels, _ = corpus(200)
    df = spark.createDataFrame(docs, SCHEMA).crossJoin(spark.range(20)).drop("id")
    rows = training_rows(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), 10).collect()
    assert len(rows) == 10 == len({r.doc_id for r in rows}) and all(r.text == docs[r.doc_id][1] for r in rows)

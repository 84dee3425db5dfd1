import random

import corpus_pipeline
from memspark.llm.decontaminate import fold_words

from .test_simhash import kept

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def write(spark, folder):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8)))
    bench = [(k, " ".join(word() for _ in range(14))) for k in range(3)]
    docs = [[k, "\n".join(" ".join(word() for _ in range(25)) for _ in range(4)), "en", f"s{k % 9}"] for k in range(120)]
    for k in range(0, 40, 4):
        docs[k][1] = " ".join(x + (" idiot scum" if i % 9 == 0 else "") for i, x in enumerate(docs[k][1].split(" ")))
    for k in range(41, 71, 2):
        docs[k][1] += "\nshared footer line of this site"
    docs[81][1] = docs[80][1]
    docs[83][1] = docs[82][1].upper()
    docs[85][1] += " " + bench[0][1]
    docs[87][1] = bench[1][1]
    docs += [[500, None, "en", "s1"], [501, "", None, None], [None, docs[90][1] + " tail words", "en", "s2"]]
    rows = [(*d, len(d[1] or ""), "x") for d in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k < 40 and k % 4 == 0)) for k in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d[0]: d[1] for d in docs}, bench


def test_stages(spark, tmp_path):
    text, bench = write(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: set(df["doc_id"].fillna(-1).astype(int)) for name, df in seen.items()}
    assert not ids["toxicity"] & set(range(0, 40, 4)) and ids["toxicity"] >= set(range(41, 120)) | {500, 501, -1}
    footers = seen["line_dedup"]["text"].fillna("").str.contains("shared footer line")
    assert footers.sum() == 1 and ids["line_dedup"] == ids["toxicity"]
    alone, _ = kept({d: t for d, t in zip(seen["line_dedup"]["doc_id"].fillna(10**6).astype(int), seen["line_dedup"]["text"], strict=True)})
    assert {d if d >= 0 else 10**6 for d in ids["near_dedup"]} == alone and not {81, 83} & ids["near_dedup"] and -1 not in ids["near_dedup"]  # the row without an id copies 90
    after = seen["decontamination"].set_index(seen["decontamination"]["doc_id"].fillna(-1))["text"]
    assert 87 not in after.index and after[86] == text[86]
    assert not any(fold_words(b)[k : k + 10] == fold_words(t)[i : i + 10] for _, b in bench for k in range(5) for t in [after[85]] for i in range(len(fold_words(t)) - 9))
    assert ids["packing"] == ids["decontamination"]


def test_run_equals_the_stages(spark, tmp_path):
    write(spark, str(tmp_path))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(packed) > 90 and (packed.groupby(["shard", "bin"])["n_words"].sum() <= 2048).all()

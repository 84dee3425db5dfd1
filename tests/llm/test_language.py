"""The forward algorithm against all segmentations, expectation against plain counts, and held-out accuracy."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import language
from memspark.llm.language import START, Lattice, Pieces, language_report, marked, read_vocabulary

SF = "/root/testdata/sf0.01"


def segmentations(word, pieces):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest in segmentations(word[i:], pieces):
                yield [word[:i], *rest]


PIECES = sorted({*"abcdefgh", START, START + "a", "ab", "abc", "bc", "cab", "de", "gh", "fgh", "aa", "aaa"})


def probabilities(seed=1, languages=3):
    p = np.random.default_rng(seed).random((len(PIECES), languages))
    return p / p.sum(axis=0)


@pytest.mark.parametrize("rescale", [2, 16])
def test_forward_sums_all_segmentations(monkeypatch, rescale):
    monkeypatch.setattr(language, "RESCALE", rescale)
    words, p = [START + w for w in ("a", "abc", "aaaaaa", "cabcabdegh", "fghabcaabcdefgha")], probabilities()
    index = {piece: i for i, piece in enumerate(PIECES)}
    counts = np.arange(15.0).reshape(5, 3)
    ways = [[np.prod([p[index[s]] for s in parts], axis=0) for parts in segmentations(w, index)] for w in words]
    lattice = Lattice(words, Pieces(PIECES))
    assert np.allclose(lattice.log_likelihood(p), [np.log(np.sum(w, axis=0)) for w in ways])
    want = np.zeros_like(p)
    for k, w in enumerate(words):
        for parts, way in zip(segmentations(w, index), ways[k], strict=True):
            for s in parts:
                want[index[s]] += counts[k] * way / np.sum(ways[k], axis=0)
    assert np.allclose(lattice.expected(p, counts), want)


def test_long_words_do_not_underflow():
    p = probabilities()
    logs = Lattice([START + "h" * 5000], Pieces(PIECES)).log_likelihood(p)
    one = p[PIECES.index("h")]
    assert np.allclose(logs, np.log(p[PIECES.index(START)]) + 5000 * np.log(one))


def test_every_word_has_a_probability():
    pieces = Pieces(read_vocabulary())
    assert len(set(pieces.pieces)) == len(pieces.pieces) > 30_000
    p = np.full((len(pieces.pieces), 1), 1 / len(pieces.pieces))
    assert np.isfinite(Lattice([marked(w) for w in ("the", "Straße", "日本語", "\U0001f600", "ሰላም")], pieces).log_likelihood(p)).all()
    ranks = read_vocabulary("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert START + "the" in ranks and len(ranks) > 50_000


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == held(r.doc_id) for r in got)
    out = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(out) > 300 and sum(out) / len(out) >= 0.99 and all(0 <= r.score <= 1 for r in got)


ROWS = [(k, t, lang) for k in range(60) for t, lang in [("the cat and the dog were in the house", "en") if k % 2 else ("der Hund und die Katze waren im Haus", "de")]]
SCHEMA = "doc_id bigint, text string, lang string"


def report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "held_out": F.lit(1)})
    return language_report(df).collect()


def test_nulls_ties_repeats_and_long_texts(spark):
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 %% 34", "en"), (None, "the house", None), (None, "die Katze", "de"), (1003, "the dog " * 50_000, None), (1004, "katze" * 20_000, None), (1, ROWS[1][1], "en")]
    got = report(spark, ROWS + odd)
    assert len(got) == len(ROWS) + len(odd)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is not None}
    assert [by_id[k] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and by_id[1003] == ("en", 1.0) and by_id[1004][0] == "de"
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == ["de", "en"] and not any(r.held_out for r in got if r.doc_id is None)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(k, "the cat and the dog", "xx" if held(k) else "en") for k in range(60)]
    assert {(r.lang_pred, r.score) for r in report(spark, rows)} == {("en", 1.0)}


def test_nothing_to_learn_from(spark):
    assert {(r.lang_pred, r.score) for r in report(spark, [(1, "the cat", None), (2, "a dog", None)])} == {("und", 0.0)}
    assert report(spark, []) == []


def test_equal_posteriors_go_to_the_first(spark):
    got = report(spark, [(k, "same words", lang) for k, lang in zip([k for k in range(40) if not held(k)][:20], ["b", "a"] * 10, strict=True)])
    assert {r.lang_pred for r in got} == {"a"} and all(math.isclose(r.score, 0.5) for r in got)

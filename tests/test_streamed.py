"""Byte-range units of large files equal those of the whole text, whatever the splits."""

import random

import pytest

from memspark.operators.decode import decode_corpus, split_plain_text, split_text
from memspark.sources.streamed import read_folder, streamed_units

SIZE = 200


def lines(rng, n, longest):
    return ["".join(rng.choice("abc é日") for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def files():
    rng = random.Random(5)
    text = {"lines.txt": "\n".join(lines(rng, 400, 40)) + "\n", "open.txt": "\n".join(lines(rng, 300, 60)), "long.txt": "\n".join(lines(rng, 40, 900)), "one.md": "xyé" * 3000}
    text |= {"ends.log": "\n" * 4100, "crlf.txt": "abc def\r\n" * 900, "marked.txt": "﻿" + "line of text\n" * 700, "even.txt": ("x" * (SIZE - 1) + "\n") * 30, "two words+.txt": "some words\n" * 500}
    return {k: v.encode() for k, v in text.items()}


def written(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


@pytest.mark.parametrize("split,span", [(1500, 1000), (700, 5000), (1 << 20, 1 << 20)])
def test_equals_the_whole_text(spark, tmp_path, files, split, span):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    got: dict[str, list] = {}
    for r in streamed_units(spark, written(tmp_path, files | {"small.txt": b"a\n" * 5, "page.html": b"<p>x</p>\n" * 900, "a.png": b"\n" * 5000}), above=4000, size=SIZE, span=span).collect():
        got.setdefault(r.source_rel, []).append((r.virtual_path, r.text))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {n: split_text(d.removeprefix(b"\xef\xbb\xbf").decode(), SIZE) for n, d in files.items()}
    assert set(got) == set(want)
    for name, parts in want.items():
        found = sorted(got[name])
        assert [v for v, _ in found] == [f"chunk-{k + 1:04d}.txt" for k in range(len(parts))], name
        assert [t for _, t in found] == parts, name


def test_bytes_that_are_no_text_are_null_units(spark, tmp_path):
    root = written(tmp_path, {"a.txt": b"fine line\n" * 30 + b"\xff\xfe" + b"abcd" * 11 + b"\n" + b"fine line\n" * 20})
    got = {r.virtual_path: r.text for r in streamed_units(spark, root, above=10, size=100).collect()}
    assert got["chunk-0001.txt"] == "fine line\n" * 10 and None in got.values()


def test_nothing_large(spark, tmp_path):
    assert streamed_units(spark, written(tmp_path, {"a.txt": b"x\n"}), above=10).count() == 0


def test_names_of_many_units(spark):
    text = "ab\n" * 10_050
    got = split_plain_text(spark.createDataFrame([("f", text)], "source_rel string, text string"), 3).collect()
    assert len({r.virtual_path for r in got}) == 10_050 and {"chunk-0001.txt", "chunk-9999.txt", "chunk-10050.txt"} <= {r.virtual_path for r in got}


def test_a_folder_is_decoded_with_its_large_files(spark, tmp_path):
    files = {"big.txt": b"some line of text\n" * 600, "small.txt": b"hi there\n", "big.html": b"<p>Hello</p>\n" * 900, "really.txt": b"%PDF-1.4\n" * 800, "sub/deep.md": b"# T\ntext\n"}
    (tmp_path / "sub").mkdir()
    read, streamed = read_folder(spark, written(tmp_path, files), "c", above=4000, size=1000, span=4000)
    sizes = {r.rel: (r.size, r.content is None, r.hash is None) for r in read.collect()}
    assert sizes == {n: (len(d), n in ("big.txt", "really.txt"), False) for n, d in files.items()}
    units, errors = decode_corpus(read, None, streamed)
    text: dict[str, str] = {}
    for r in sorted(units.collect(), key=lambda r: r.unit_rel):
        text[r.source_rel] = text.get(r.source_rel, "") + r.text
    assert text["big.txt"].encode() == files["big.txt"] and text["sub/deep.md"] == "# T\ntext\n" and "Hello" in text["big.html"] and len(text) == 4
    assert [(r.source_rel, r.error) for r in errors.collect()] == [("really.txt", "decode")]

import hashlib
from collections import defaultdict

from memspark.llm import warc
from memspark.llm.common import shared_folder
from memspark.llm.warc import read_archives, reachable, round_trip, write_archives

SCHEMA = "page_id bigint, url string, html string, digest string"


def pages():
    fake = "x" * 60 + "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "WARC/1.0\r\n" * 3 + "end"
    big = "<p>é" * 100000
    out = [(k, f"http://h/{k}", f"<html>{'body ' * 30}{k % 7}</html>") for k in range(120)]
    out += [(200, None, None), (201, "http://x\r\nEvil: 1", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", fake), (205, "u", fake), (206, "u", big), (207, "u", big), (208, "u", "WARC/1.0\r\n"), (209, "u", "\r\n\r\n" * 40), (300, "u", "y" * 99), (301, "u", "y" * 99), (302, "u", "y" * 100), (303, "u", "y" * 100), (None, "u", "y" * 100)]
    return [(p, u, h, "clash") for p, u, h in out]


def expected(rows):
    group = defaultdict(list)
    for p, _, h, _ in rows:
        if p is not None:
            group[h or ""].append(p)
    out = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        first = min(group.get(h or "", [p]))
        revisit = p is not None and len(data) >= 100 and p != first
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(round_trip(df)) == expected(rows)


def test_small_splits(spark):
    rows = pages()
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    path = shared_folder(spark, "warc")
    write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    try:
        for size in ("700", "3000", "100000"):
            spark.conf.set(key, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert result(read_archives(spark, path)) == expected(rows), size
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archive_is_plain_warc(spark):
    path = shared_folder(spark, "warc")
    write_archives(spark.createDataFrame([(1, "http://a/b", "<p>é</p>", "")], SCHEMA), path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert text.startswith("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: http://a/b\r\n")
    assert text.endswith("Content-Length: 9\r\n\r\n<p>é</p>\r\n\r\n")


def test_many_records_with_magic_inside_in_one_file(spark):
    """A thousand records whose payloads hold magic: each piece is given to its record by a running marker."""
    rows = [(k, f"http://h/{k}", f"{k} " + "some text WARC/1.0\r\n" * (1 + k % 4) + f"end {k}", "clash") for k in range(1000)]
    path = shared_folder(spark, "warc")
    write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert result(read_archives(spark, path)) == expected(rows)
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pointer_jumping(spark):
    chain = [(1, k * 10, k * 10 + 10) for k in range(0, 50)] + [(1, 7, 17), (1, 17, 20), (2, 0, 30), (2, 30, None), (2, 15, 30), (3, 5, 9)]
    got = sorted((r.file, r.off) for r in reachable(spark.createDataFrame(chain, "file bigint, off bigint, next bigint")).collect())
    assert got == [(1, k * 10) for k in range(50)] + [(2, 0), (2, 30)]


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_that_move_between_the_reads(spark, monkeypatch):
    rows, path = pages(), shared_folder(spark, "warc")
    write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    key, again = "spark.sql.files.maxPartitionBytes", warc.rejoined
    before = spark.conf.get(key)

    def moved(*given):
        spark.conf.set(key, "1700")
        return again(*given)

    monkeypatch.setattr(warc, "rejoined", moved)
    try:
        spark.conf.set(key, "50000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert result(read_archives(spark, path)) == expected(rows)
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")

"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Spark's text sink writes the archives and its text source reads them back, both cut at the bytes that
separate records, so archives of any size are split among tasks, lie in any store that Spark reaches, and
survive lost executors like every other Spark output. DataFrame functions only.

The reader takes every occurrence of the record magic as a candidate. A task knows a candidate's place
within its split from the lengths before it; the totals of earlier splits give its offset in the file. Its
header gives the offset of the record behind it. Pointer jumping from offset 0, with links that double in
length each round, then keeps exactly the records that the file's own chain reaches; magic inside a payload
is reached by no link and becomes payload again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, joined_by_count, shared_folder

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Narrow rows (some 100 bytes) that are broadcast at most.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"


def header_line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in values become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write a WARC record per row of pages (page_id, url, html) below path.

    Of rows with equal payloads of at least 100 bytes those with the smallest page_id are response records, the
    others revisit records without a payload; rows without a page_id are response records. A null html is an
    empty payload. Repeated rows are a record each.
    """
    rows = pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n_bytes": F.octet_length("html")})
    named = cut_lineage(rows.where(F.col("n_bytes") >= REVISIT_BYTES).select("page_id", "digest"))  # who revisits is decided on narrow rows
    first = cut_lineage(named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    revisits = joined_by_count(named, first, "digest", named.count()).where(F.col("page_id") != F.col("first")).distinct()
    revisits = cut_lineage(revisits)
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits  # then no page is shuffled
    rows = rows.join(revisits, ["page_id", "digest"], "left").withColumn("revisit", F.col("first").isNotNull())
    kind, body = F.when(F.col("revisit"), "revisit").otherwise("response"), F.when(F.col("revisit"), "").otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC), header_line("WARC-Type", kind), header_line("WARC-Record-ID", page_urn(F.col("page_id"))), header_line("WARC-Target-URI", F.col("url")),
        header_line("WARC-Date", F.lit(date)), header_line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        header_line("WARC-Refers-To", F.when(F.col("revisit"), page_urn(F.col("first")))), header_line("Content-Type", F.lit("text/html; charset=utf-8")),
        header_line("Content-Length", F.octet_length(body)), F.lit("\r\n"), body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), block, seq (order in the block) and value (bytes between two magics, the last up to the file's end).

    The blocks are those of this read; another read may be cut elsewhere.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def content_key() -> tuple[Column, Column]:
    """h1, h2: 128 bits of a piece's content, by which another read finds it again wherever its blocks are cut."""
    return F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2")


def field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, f"(?mi)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per magic: file, off (of the magic), next (offset behind the record), header fields, and the payload's digest where the piece holds it whole."""
    header = F.substring_index("value", END, 1)
    parsed = pieces(spark, path).withColumns({"header": header, "size": F.octet_length("value").cast("bigint") + len(MAGIC)})
    length = field(F.col("header"), "Content-Length").try_cast("bigint")
    parsed = parsed.withColumns({"head": F.octet_length("header") + len(END), "length": length})
    whole = F.octet_length("value") >= F.col("head") + F.col("length")
    payload = F.substring(F.col("value").cast("binary"), F.col("head") + 1, F.col("length").cast("int"))
    narrow = parsed.select(
        "file", "block", "seq", "size", "head", "length", *content_key(), F.coalesce(whole, F.lit(False)).alias("whole"), F.when(whole, F.sha2(payload, 256)).alias("digest"),
        field(F.col("header"), "WARC-Type").alias("type"), field(F.col("header"), "WARC-Record-ID").alias("record_id"), field(F.col("header"), "WARC-Target-URI").alias("url"),
        field(F.col("header"), "WARC-Refers-To").alias("refers"), field(F.col("header"), "WARC-Payload-Digest").alias("declared"),
    )
    before = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    narrow = cut_lineage(narrow.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0))))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = narrow.groupBy("file", "block").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    placed = narrow.join(base, ["file", "block"]).withColumn("off", F.col("base") + F.col("inside") - len(MAGIC)).where("off >= 0")
    return placed.withColumn("next", F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + len(END)).drop("base", "inside", "size")


def reachable(chain: DataFrame) -> DataFrame:
    """file, off of the candidates that the chain from offset 0 reaches. chain: file, off, next."""
    jump = chain.where("next is not null").select("file", "off", "next")
    ends = chain.select("file", F.col("off").alias("next"))
    jump = cut_lineage(jump.join(ends, ["file", "next"], "left_semi").select("file", "off", "next"))  # links to places without magic lead nowhere
    found, n = chain.where("off = 0").select("file", "off"), -1
    while True:
        step = found.join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        found = cut_lineage(found.unionByName(step).distinct())
        if n == (n := found.count()):
            return found
        onward = jump.select("file", F.col("off").alias("next"), F.col("next").alias("far"))
        jump = cut_lineage(jump.join(onward, ["file", "next"]).select("file", "off", F.col("far").alias("next")))


def owned(rows: DataFrame, records: DataFrame) -> DataFrame:
    """file, at, h1, h2 of all candidates, and off of the last record that begins at or before each.

    A running maximum inside each block, carried over the blocks of a file (one row each): no task meets the records of a file with its candidates.
    """
    begins = records.select("file", "off", F.col("off").alias("begin"))
    marked = cut_lineage(rows.select("file", "block", "off", "h1", "h2").join(begins, ["file", "off"], "left"))
    up_to = W.partitionBy("file", "block").orderBy("off").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = marked.groupBy("file", "block").agg(F.max("begin").alias("last")).withColumn("carried", F.max("last").over(earlier)).drop("last")
    return marked.withColumn("own", F.max("begin").over(up_to)).join(carried, ["file", "block"]).select("file", F.col("off").alias("at"), "h1", "h2", F.coalesce("own", "carried").alias("off"))


def rejoined(spark: SparkSession, path: str, records: DataFrame, rows: DataFrame) -> DataFrame:
    """file, off, digest of records whose payload holds magic: their pieces are read again, found by content, and put together."""
    broken = records.where("not whole").select("file", "off", "next", "head", "length")
    parts = cut_lineage(owned(rows, records).join(broken, ["file", "off"]).where("at < next"))
    found = pieces(spark, path).select("value", *content_key()).join(parts.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    joined = found.join(parts, ["h1", "h2"]).groupBy("file", "off", "head", "length").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("binary").alias("value")))).alias("p"))
    data = F.expr(f"aggregate(p, cast('' AS binary), (a, x) -> CASE WHEN x.at = off THEN x.value ELSE concat(a, cast('{MAGIC[:8]}\\r\\n' AS binary), x.value) END)")
    return joined.select("file", "off", F.sha2(F.substring(data, F.col("head") + 1, F.col("length").cast("int")), 256).alias("digest"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below path: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    Only records on a file's chain count. Digests are of the bytes read; a revisit has those of the response
    record that it names (null if there is none). An empty folder gives no rows.
    """
    rows = cut_lineage(candidates(spark, path))
    records = rows.join(reachable(rows), ["file", "off"], "left_semi")
    if records.where("not whole").limit(1).count():
        fixed = rejoined(spark, path, records, rows).withColumnRenamed("digest", "digest2")
        records = records.join(fixed, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "digest2"))
    records = records.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') AS bigint)").alias("page_id"), "url", F.col("type").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(refers, '^<urn:page:(-?[0-9]+)>$', 1), '') AS bigint)").alias("refers_to"), "length", "digest", F.substring_index("declared", ":", -1).alias("declared"),
    )
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared")).agg(F.max("length").alias("full_length"))
    revisits = records.where("record_type = 'revisit'").join(full, ["refers_to", "declared"], "left")
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    revisits = revisits.select("page_id", "url", "record_type", "refers_to", F.col("full_length").alias("payload_bytes"), F.when(F.col("full_length").isNotNull(), F.col("declared")).alias("payload_digest"))
    others = records.where("record_type is null or record_type <> 'revisit'").withColumns({"payload_bytes": F.col("length"), "payload_digest": F.col("digest")})
    return others.select(*columns).unionByName(revisits.select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages), f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= {REVISIT_BYTES} GROUP BY body)
SELECT page_id, strlen(p.body) AS payload_bytes, sha256(p.body) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.body = f.body
"""

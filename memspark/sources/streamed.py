"""Plain text of any size, cut to units by byte ranges.

A file is read in Spark's splits, so no task holds it. `split_text` says where units end: each begins where the last one
ended, which looks sequential. It is solved in three narrow steps over the places where lines end, and the bytes move once:

1. Every split measures its lines; a running sum over the splits of a file turns these lengths to places in the file.
2. Places are dealt to ranges of RANGE_BYTES. From each place where a unit may begin in a range (only in its first two units'
   length), numpy follows the units to the first one that begins in the next range. Pointer jumping over these few rows
   finds which of them are reached from the file's start, and a running sum of their units numbers them.
3. Splits cut their bytes at the units' ends, and the pieces of a unit are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import FORMAT_LIMIT, STREAM_FROM, UNIT_BYTES, classify_path, route_decoder
from ..functions.rows import exploded
from ..functions.staging import staged
from ..operators.decode import decode_text, unit_name
from .corpus import file_rows, relative

#: Bytes of a range; at least four units.
RANGE_BYTES = 32 << 20
#: Bytes of lines that are put in one row.
BLOB_BYTES = 1 << 20


def plain_by_name(path: Column) -> Column:
    return (classify_path(path) == "keep") & (route_decoder(path, F.lit(None).cast("string"), F.lit(STREAM_FROM + 1)) == "stream")


def text_lines(spark: SparkSession, root: str, above: int = STREAM_FROM) -> DataFrame:
    """path, block (where its split begins), length, line (bytes) of plain-text files of more than `above` bytes below root. Smaller files, and those of other decoders by their names, are left out when files are listed."""
    m = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root)
    return rows.where((m["file_size"] > above) & plain_by_name(m["file_path"])).select(F.url_decode(F.replace(m["file_path"], F.lit("+"), F.lit("%2B"))).alias("path"), m["file_block_start"].alias("block"), m["file_size"].alias("length"), F.col("value").cast("binary").alias("line"))


def cuts_in(line: bytes, begins: int, size: int) -> list[int]:
    """Where units end inside a line that begins a unit: at whole characters, while more than a unit's length is left."""
    out, at = [], 0
    while at + size <= len(line):
        cut = at + size
        while cut < len(line) and line[cut] & 0xC0 == 0x80 and cut > at:
            cut -= 1
        at = cut if cut > at else at + size
        out.append(begins + at)
    return out


PLACES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("length", pa.int64()), ("bytes", pa.int64()), ("ends", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int64()))])
DEALT = pa.schema([("path", pa.string()), ("total", pa.int64()), ("range", pa.int64()), ("ends", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int64()))])


def measured(lines: DataFrame, size: int) -> DataFrame:
    """path, block, length, bytes (lines of a batch, each with an end), ends (places behind them) and cuts (inside long lines), from the split's first line on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple, int] = {}
        for batch in batches:
            path, block, length, n, line = batch.columns
            codes, names = pd.factorize(pd.MultiIndex.from_arrays([path.to_pandas(), block.to_pandas()]))
            sizes = n.to_numpy() + 1
            for code, name in enumerate(names):
                rows = np.flatnonzero(codes == code)
                ends = at.get(name, 0) + np.cumsum(sizes[rows])
                cuts = [c for i in np.flatnonzero(sizes[rows] > size) for c in cuts_in(line[int(rows[i])].as_py(), int(ends[i] - sizes[rows[i]]), size)]
                at[name] = int(ends[-1])
                whole = (name[0], int(name[1]), length[int(rows[0])].as_py(), int(sizes[rows].sum()), ends, cuts)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(whole, PLACES, strict=True)], schema=PLACES)

    size_of = F.octet_length("line")
    given = lines.select("path", "block", "length", size_of.cast("bigint").alias("n"), F.when(size_of >= size, F.col("line")).alias("line"))
    return given.mapInArrow(run, "path string, block bigint, length bigint, bytes bigint, ends array<bigint>, cuts array<bigint>")


def steps(begins: np.ndarray, ends: np.ndarray, cuts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Where the units that begin at `begins` end, as `split_text` has it."""
    none = np.int64(1 << 62)
    after = lambda places, i: np.append(places, none)[np.minimum(i, len(places))]
    line = after(ends, np.searchsorted(ends, begins + size))
    i = np.searchsorted(ends, begins + size, "right") - 1
    before = np.where(i >= 0, ends[np.maximum(i, 0)] if len(ends) else 0, -1)
    before = np.where(before > begins, before, -1)
    cut = after(cuts, np.searchsorted(cuts, begins, "right"))
    found = np.where((line <= begins + 2 * size) & (before >= 0), line, np.where(before >= 0, before, cut))
    return np.where(begins + size >= length, length, found)


def in_range(rows: pd.DataFrame, size: int, span: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places where units may begin in a range, where these units end, the range's end and the file's length."""
    ends, cuts = (np.unique(np.concatenate([np.asarray(v, np.int64) for v in rows[c]])) for c in ("ends", "cuts"))
    number, length = int(rows["range"].iloc[0]), int(rows["total"].iloc[0])
    stop = (number + 1) * span
    begins = np.union1d(ends, cuts)
    if number == 0:
        begins = np.r_[0, begins[begins > 0]]
    begins = begins[(begins >= number * span) & (begins < min(stop, length))]
    return begins, steps(begins, ends, cuts, length, size), stop, length


def routes(rows: pd.DataFrame, size: int, span: int) -> pd.DataFrame:
    """path, range, entry, exit, units: from each place where the range's first unit may begin, where the first one behind the range does, and how many lie between."""
    begins, ends, _, _ = in_range(rows, size, span)
    here = np.searchsorted(begins, ends)
    inside = np.append(begins, -1)[np.minimum(here, len(begins))] == ends
    goal, units, to = ends.copy(), np.ones(len(begins), np.int64), np.where(inside, here, -1)
    while (to >= 0).any():  # doubling
        go, at = to >= 0, np.maximum(to, 0)
        units, goal, to = np.where(go, units + units[at], units), np.where(go, goal[at], goal), np.where(go, to[at], to)
    first = begins < int(rows["range"].iloc[0]) * span + 2 * size
    return pd.DataFrame({"path": rows["path"].iloc[0], "range": rows["range"].iloc[0], "entry": begins[first], "exit": goal[first], "units": units[first]})


def units_of(rows: pd.DataFrame, size: int, span: int) -> pd.DataFrame:
    """path, range, number, begins, ends of the units that begin in a range; rows hold the entry and the number of units before."""
    begins, ends, stop, length = in_range(rows, size, span)
    entry = rows["entry"].iloc[0]
    at, out = -1 if pd.isna(entry) else int(entry), []
    while 0 <= at < min(stop, length):
        end = int(ends[np.searchsorted(begins, at)])
        out.append((at, end))
        at = end
    first = int(rows["before"].iloc[0] or 0) if out else 0
    return pd.DataFrame({"path": rows["path"].iloc[0], "range": rows["range"].iloc[0], "number": np.arange(len(out)) + first, "begins": [o[0] for o in out], "ends": [o[1] for o in out]})


def reached(jumps: DataFrame, ranges: int) -> DataFrame:
    """path, entry: the entries that are reached from 0 over jumps (path, entry, exit), by doubling."""
    found = staged(jumps.where("entry = 0").select("path", "entry"))
    hop = jumps.select("path", "entry", "exit")
    for _ in range(max(0, ranges - 1).bit_length()):
        found = staged(found.unionByName(found.join(hop, ["path", "entry"]).select("path", F.col("exit").alias("entry"))).distinct())
        later = hop.select("path", F.col("entry").alias("exit"), F.col("exit").alias("_exit"))
        hop = staged(hop.join(later, ["path", "exit"]).select("path", "entry", F.col("_exit").alias("exit")))
    return found


def unit_places(lines: DataFrame, size: int = UNIT_BYTES, span: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Units (path, range, number, begins, ends) and blocks (path, block, base, bytes) of text_lines. Places don't count a byte-order mark."""
    span = max(span, 4 * size)
    rows = staged(measured(lines, size))
    blocks = rows.groupBy("path", "block").agg(F.sum("bytes").alias("bytes"), F.max("length").alias("length"))
    until = F.sum("bytes").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    in_file = F.sum("bytes").over(W.partitionBy("path"))  # one row a split
    # Lines count one byte more than they hold. A last line without an end makes that one too many; a mark of three bytes isn't in the lines.
    total = in_file - (in_file - F.col("length")).isin(1, -2).cast("int")
    blocks = staged(blocks.select("path", "block", F.coalesce(until, F.lit(0)).alias("base"), "bytes", total.alias("total")))
    moved = lambda places: F.filter(F.transform(places, lambda p: p + F.col("base")), lambda p: p <= F.col("total"))
    places = rows.drop("bytes").join(blocks, ["path", "block"]).select("path", "total", moved("ends").alias("ends"), moved("cuts").alias("cuts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, *both in zip(*batch.columns, strict=True):
                both = [np.asarray(a.as_py(), np.int64) for a in both]
                own = np.unique(np.concatenate([*both, [0]]) // span)
                for r in np.union1d(own, own - 1):  # a range also needs the places of two units' length behind it
                    inside = [p[(p >= r * span) & (p <= (r + 1) * span + 2 * size)] for p in both]
                    if r == 0 or (r > 0 and any(map(len, inside))):
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path.as_py(), total.as_py(), int(r), *inside), DEALT, strict=True)], schema=DEALT)

    dealt = staged(places.mapInArrow(deal, "path string, total bigint, range bigint, ends array<bigint>, cuts array<bigint>"))
    jumps = staged(dealt.groupBy("path", "range").applyInPandas(lambda g: routes(g, size, span), "path string, range bigint, entry bigint, exit bigint, units bigint"))
    most = jumps.agg(F.coalesce(F.max("range"), F.lit(0))).first()[0]
    found = jumps.join(reached(jumps, most + 1), ["path", "entry"])
    before = F.coalesce(F.sum("units").over(W.partitionBy("path").orderBy("entry").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
    entries = found.select("path", "range", "entry", before.alias("before"))
    units = dealt.join(entries, ["path", "range"]).groupBy("path", "range").applyInPandas(lambda g: units_of(g, size, span), "path string, range bigint, number bigint, begins bigint, ends bigint")
    return staged(units), blocks


def blobs(lines: DataFrame) -> DataFrame:
    """path, block, at, data: the lines of a split put together to rows of about BLOB_BYTES; at is a place from the split's first line on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, parts, held = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal at, parts, held
            out = pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([at]), pa.array([b"".join(parts)])], names=["path", "block", "at", "data"])
            at, parts, held = at + held, [], 0
            return out

        for batch in batches:
            for path, block, line in zip(*batch.columns, strict=True):
                own = (path.as_py(), block.as_py())
                if own != key:
                    if parts:
                        yield flush()
                    key, at = own, 0
                parts += [line.as_py(), b"\n"]
                held += len(parts[-2]) + 1
                if held >= BLOB_BYTES:
                    yield flush()
        if parts:
            yield flush()

    return lines.select("path", "block", "line").mapInArrow(run, "path string, block bigint, at bigint, data binary")


def streamed_units(spark: SparkSession, root: str, context: str = "default", above: int = STREAM_FROM, size: int = UNIT_BYTES, span: int = RANGE_BYTES) -> DataFrame:
    """context, root, source_rel, virtual_path, text of every unit of the plain-text files of more than `above` bytes below root.

    The units are those of `split_text` over a file's bytes behind a byte-order mark; text is null where a unit can't be decoded. A file may have any size and
    any number of splits; a single line must fit in a row (2 GB).
    """
    lines = text_lines(spark, root, above)
    units, blocks = unit_places(lines, size, span)
    width = max(span, 4 * size)
    spread = blocks.withColumn("range", F.explode(F.sequence(F.floor(F.col("base") / width) - 1, F.floor((F.col("base") + F.col("bytes")) / width))))
    touching = (F.col("begins") < F.col("base") + F.col("bytes")) & (F.col("ends") > F.col("base"))
    marks = spread.join(units, ["path", "range"]).where(touching).groupBy("path", "block", "base").agg(F.sort_array(F.collect_list(F.struct("begins", "ends", "number"))).alias("marks"))
    data = blobs(lines).join(marks, ["path", "block"]).withColumn("at", F.col("at") + F.col("base"))
    until = F.col("at") + F.octet_length("data")
    pieces = exploded(data, ["path", "at", "data"], F.filter("marks", lambda m: (m["begins"] < until) & (m["ends"] > F.col("at"))), "_n", "m")
    low, high = F.greatest(F.col("m.begins") - F.col("at"), F.lit(0)), F.least(F.col("m.ends") - F.col("at"), F.octet_length("data").cast("bigint"))
    pieces = pieces.select("path", F.col("m.number").alias("number"), F.col("at"), F.substring("data", (low + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    whole = pieces.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda data, p: F.concat(data, p["piece"]))
    return whole.select(F.lit(context).alias("context"), F.lit(root).alias("root"), relative(F.col("path"), root).alias("source_rel"), unit_name(F.col("number")).alias("virtual_path"), decode_text(joined).alias("text"))


def read_folder(spark: SparkSession, root: str, context: str = "default", above: int = STREAM_FROM, size: int = UNIT_BYTES, span: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, streamed) of the tree below root, for `decode_corpus` and `ingest`.

    files: context, root, rel, size, mtime, hash, content. No file that is plain text by its name and has more than `above` bytes is read to a cell,
    nor any that is beyond the decoders' limit: their content is null. The hash of such plain text is one of its units' digests; it is
    planned by size and time. streamed holds its units.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    large, plain = F.col("length") > above, plain_by_name(F.col("_metadata.file_path"))
    read = file_rows(files.where(~large), root, context, True).unionByName(file_rows(files.where(large & (F.col("length") <= FORMAT_LIMIT) & ~plain), root, context, True))
    unread = file_rows(files.where(large & ((F.col("length") > FORMAT_LIMIT) | plain)), root, context)
    streamed = staged(streamed_units(spark, root, context, above, size, span))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    parts = streamed.select("root", "source_rel", F.struct("virtual_path", digest.alias("digest")).alias("part")).groupBy("root", "source_rel").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    hashed = parts.select("root", F.col("source_rel").alias("rel"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform("parts", lambda p: p["digest"]), ","), 256)).alias("hash"))
    unread = unread.join(hashed, ["root", "rel"], "left").withColumn("content", F.lit(None).cast("binary"))
    return read.unionByName(unread), streamed

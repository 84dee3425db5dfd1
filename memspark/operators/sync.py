"""What to index, and replacing what was: plans, manifests and index tables by joins on the source.

files: context, root, rel, size, mtime, hash. manifest: context, root, added_at, path, hash, hash_at_index, indexed_at, type,
blob_ref, source_path, source_size, source_mtime. The source of a manifest row is source_path, or path where that is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import FORMAT_LIMIT, classify_path, index_path, route_decoder

KEY = ["context", "root", "source_rel"]
DEFAULT_RATE, PROCEDURE_SECONDS, ITEM_SECONDS, MIB = 45.0, 8.0, 2.0, 1 << 20
LEAST_MIB, ALPHA_RANGE = 0.001, (0.05, 0.5)


def source_rel() -> Column:
    return F.coalesce("source_path", "path")


def indexed_sources(manifest: DataFrame) -> DataFrame:
    """context, root, source_rel, indexed_hash (null unless all rows agree), all_stored, indexed_size, indexed_mtime (null unless all agree), unchanged."""
    one: dict[str, Column] = {}
    for name, c in (("indexed_hash", "hash_at_index"), ("indexed_size", "source_size"), ("indexed_mtime", "source_mtime")):
        one[name] = F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))
    return manifest.withColumn("source_rel", source_rel()).groupBy(*KEY).agg(
        *(v.alias(k) for k, v in one.items()), F.bool_and(F.col("blob_ref").isNotNull()).alias("all_stored"), F.coalesce(F.bool_and(F.col("hash") == F.col("hash_at_index")), F.lit(False)).alias("unchanged"),
    )


def fully_indexed(manifest: DataFrame, files: DataFrame, store_raw: bool = False) -> DataFrame:
    """context, root, source_rel of files whose every manifest row was indexed at the file's hash (and has its blob where raw text is stored)."""
    state = indexed_sources(manifest)
    now = files.select("context", "root", F.col("rel").alias("source_rel"), F.col("hash").alias("now"))
    hit = (F.col("indexed_hash") == F.col("now")) & (F.col("all_stored") | F.lit(not store_raw))
    return state.join(now, KEY).where(hit).select(*KEY)


def fully_indexed_by_stat(manifest: DataFrame, files: DataFrame, store_raw: bool = False) -> DataFrame:
    """The same by size and modification time, without reading contents; rows without these never match."""
    state = indexed_sources(manifest)
    now = files.select("context", "root", F.col("rel").alias("source_rel"), "size", "mtime")
    hit = F.col("unchanged") & (F.col("indexed_size") == F.col("size")) & (F.col("indexed_mtime") == F.col("mtime")) & (F.col("all_stored") | F.lit(not store_raw))
    return state.join(now, KEY).where(hit).select(*KEY)


def plan_add(files: DataFrame, manifest: DataFrame, layer: str | None = None, store_raw: bool = False, limit: int = FORMAT_LIMIT) -> DataFrame:
    """files with action (infrastructure, junk, denied, too_large, already_indexed, needs_work) and layer.

    Plain text from STREAM_FROM bytes on is streamed: it is never too large, and counts as indexed by size and modification time.
    All other files are too large beyond `limit`, and count as indexed by content hash. A column head (text of the first 4,096
    bytes) serves the choice of a decoder where files have one.
    """
    key = ["context", "root", "rel"]
    by_hash = fully_indexed(manifest, files, store_raw).select(*KEY, F.lit(True).alias("_same"), F.lit(None).cast("boolean").alias("_as_before"))
    by_stat = fully_indexed_by_stat(manifest, files, store_raw).select(*KEY, F.lit(None).cast("boolean").alias("_same"), F.lit(True).alias("_as_before"))
    done = by_hash.unionByName(by_stat).groupBy(*KEY).agg(F.max("_same").alias("_same"), F.max("_as_before").alias("_as_before")).withColumnRenamed("source_rel", "rel")
    kind, head = classify_path(F.col("rel")), F.col("head") if "head" in files.columns else F.lit(None).cast("string")
    streamed = route_decoder(F.col("rel"), head, F.col("size")) == "stream"
    indexed = F.when(streamed, F.col("_as_before")).otherwise(F.col("_same"))
    action = F.when(kind != "keep", kind).when(~streamed & (F.col("size") > limit), "too_large").when(indexed, "already_indexed").otherwise("needs_work")
    return files.join(done, key, "left").withColumn("action", action).withColumn("layer", F.lit(layer)).drop("_same", "_as_before")


def plan_update(manifest: DataFrame, files: DataFrame, store_raw: bool = False, limit: int = FORMAT_LIMIT) -> DataFrame:
    """The plan for every source of the manifest that still exists; each keeps the type it was indexed as."""
    known = manifest.withColumn("rel", source_rel()).groupBy("context", "root", "rel").agg(F.min_by("type", "path").alias("_type"))
    plan = plan_add(files.join(known.drop("_type"), ["context", "root", "rel"], "left_semi"), manifest, None, store_raw, limit)
    return plan.join(known, ["context", "root", "rel"]).withColumn("layer", F.col("_type")).drop("_type")


def plan_stats(plan: DataFrame) -> DataFrame:
    """Counts per context; infrastructure and junk aren't seen."""
    is_, work = (lambda a: F.col("action") == a), F.col("action") == "needs_work"
    return plan.groupBy("context").agg(
        F.count_if(~F.col("action").isin("infrastructure", "junk")).alias("seen"), F.count_if(is_("denied")).alias("denied"), F.count_if(is_("too_large")).alias("too_large"),
        F.count_if(is_("already_indexed")).alias("already_indexed"), F.count_if(work).alias("work_items"), F.coalesce(F.sum(F.when(work, F.col("size"))), F.lit(0)).alias("work_bytes"),
        F.count_if(work & (F.coalesce("layer", F.lit("semantic")) == "semantic")).alias("semantic_items"), F.count_if(work & (F.col("layer") == "procedural")).alias("procedural_items"),
    )


def estimate_seconds(stats: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """stats with seconds: text at the learned rate per MiB (rates: context, ema) or the default, a share per procedure and per item; 1 at least."""
    rows = stats.join(rates.select("context", "ema"), "context", "left") if rates is not None else stats.withColumn("ema", F.lit(None).cast("double"))
    seconds = F.col("work_bytes") / MIB * F.coalesce("ema", F.lit(DEFAULT_RATE)) + PROCEDURE_SECONDS * F.col("procedural_items") + ITEM_SECONDS * F.col("work_items")
    return rows.withColumn("seconds", F.greatest(F.lit(1.0), seconds)).drop("ema")


def run_rate_ema(runs: DataFrame, alpha: float = 0.15) -> DataFrame:
    """context, ema: seconds per MiB over the runs (context, place, seconds, mib, semantic_items) in order of place, a time or number; runs without semantic work or text don't count.

    A segment of runs maps a mean e to keep * e + add, and such pairs combine. So runs are dealt to sorted ranges, each task folds
    the segments of its range, and only segments (one a context and range) are put in order: a context of any size is split among tasks.
    """
    a = min(ALPHA_RANGE[1], max(ALPHA_RANGE[0], alpha))
    rows = runs.where((F.col("semantic_items") > 0) & (F.col("mib") >= LEAST_MIB)).select("context", "place", (F.col("seconds") / F.col("mib")).alias("rate"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments: dict[str, list[float]] = {}  # first rate, keep, add
        for batch in batches:
            for context, rates in batch.groupby("context", sort=False, dropna=False)["rate"]:
                values = rates.to_numpy()
                weights = a * (1 - a) ** np.arange(len(values) - 1, -1, -1)
                first, keep, add = segments.get(context, [values[0], 1.0, 0.0])
                segments[context] = [first, keep * (1 - a) ** len(values), add * (1 - a) ** len(values) + float(values @ weights)]
        if segments:
            yield pd.DataFrame([(c, *v) for c, v in segments.items()], columns=["context", "first", "keep", "add"]).assign(range=TaskContext.get().partitionId())

    dealt = rows.repartitionByRange("context", "place", "rate").sortWithinPartitions("context", "place", "rate")
    segments = dealt.mapInPandas(fold, "context string, first double, keep double, add double, range int")
    later = W.partitionBy("context").orderBy("range").rowsBetween(1, W.unboundedFollowing)
    kept = F.coalesce(F.product("keep").over(later), F.lit(1.0))
    parts = segments.withColumn("kept", kept)
    ema = F.sum(F.col("add") * F.col("kept")) + F.min_by(F.col("first") * F.col("keep") * F.col("kept"), "range")
    return parts.groupBy("context").agg(ema.alias("ema"))


# --- the index tables ----------------------------------------------------------------------------------


Index = dict[str, DataFrame]
TABLES = ("chunks", "entities", "relations", "procedures")


def replace_sources(index: Index, new: Index, sources: DataFrame) -> Index:
    """The index without the rows of sources (context, source_path as `index_path` names it), and with the new rows. Entities and relations carry their source, so each table needs one anti-join; procedures without a source stay."""
    gone = sources.select("context", "source_path").distinct()
    return {t: index[t].join(gone, ["context", "source_path"], "left_anti").unionByName(new[t], allowMissingColumns=True) if t in new else index[t].join(gone, ["context", "source_path"], "left_anti") for t in TABLES}


def prune_orphan_units(manifest: DataFrame, index: Index, units: DataFrame) -> tuple[DataFrame, Index]:
    """For the sources of units (context, root, source_rel, unit_rel), drop manifest and index rows of units that are no longer there."""
    redone = units.select(*KEY).distinct()
    there = units.select("context", "root", F.col("unit_rel").alias("path")).distinct()
    rows = manifest.withColumn("source_rel", source_rel())
    gone = rows.join(redone, KEY, "left_semi").join(there, ["context", "root", "path"], "left_anti").select("context", "root", "path")
    lost = gone.select("context", index_path(F.col("root"), F.col("path")).alias("source_path")).distinct()
    return manifest.join(gone, ["context", "root", "path"], "left_anti"), {t: index[t].join(lost, ["context", "source_path"], "left_anti") for t in TABLES}


def upsert_manifest(manifest: DataFrame, units: DataFrame, as_of: Column) -> DataFrame:
    """The manifest with a row for each unit (context, root, unit_rel, source_rel, hash, type, blob_ref, size, mtime); others stay. added_at of a known root is kept."""
    given = units.select(
        "context", "root", F.col("unit_rel").alias("path"), F.struct("hash", "type", "blob_ref", F.when(F.col("unit_rel") != F.col("source_rel"), F.col("source_rel")).alias("source_path"), "size", "mtime").alias("n"),
    ).withColumn("_new", F.lit(True))
    roots = manifest.groupBy("context", "root").agg(F.min("added_at").alias("_added"))
    rows = manifest.join(given, ["context", "root", "path"], "full_outer").join(roots, ["context", "root"], "left")
    new = F.coalesce("_new", F.lit(False))
    pick = lambda fresh, old: F.when(new, fresh).otherwise(F.col(old)).alias(old)
    return rows.select(
        "context", "root", F.coalesce("added_at", "_added", as_of).alias("added_at"), "path", pick(F.col("n.hash"), "hash"), pick(F.col("n.hash"), "hash_at_index"), pick(as_of, "indexed_at"), pick(F.col("n.type"), "type"),
        pick(F.coalesce("n.blob_ref", "blob_ref"), "blob_ref"), pick(F.col("n.source_path"), "source_path"), pick(F.col("n.size"), "source_size"), pick(F.col("n.mtime"), "source_mtime"),
    )


def ingestion_summary(outcomes: DataFrame) -> DataFrame:
    """Per context: files by outcome, units, chunks, entities, bytes, and a line of text. outcomes: context, outcome, units, chunks, entities, bytes."""
    names = ("indexed", "already_indexed", "denied", "too_large", "failed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = outcomes.groupBy("context").agg(
        *(F.count_if(F.col("outcome") == n).alias(n) for n in names), *(total(c).alias(a) for c, a in (("units", "units_written"), ("chunks", "n_chunks"), ("entities", "n_entities"), ("bytes", "n_bytes"))),
    )
    said = F.format_string("%d files indexed (%d units, %d chunks, %d entities), %d unchanged, %d skipped, %d failed", "indexed", "units_written", "n_chunks", "n_entities", "already_indexed", F.col("denied") + F.col("too_large"), "failed")
    return out.withColumn("line", said)

"""Conflict-constrained best-fit packing.

Documents become pieces of at most `capacity` words and are dealt evenly to shards of bounded size, which
are packed independently, longest piece first. Open bins are ordered by residual space and carry bitmaps of
their sources and duplicate clusters. A successor search finds the tightest bin that has room and shares no
bit with the piece; where none is compatible, a new bin opens.

The successor search runs over a tree on the residuals whose nodes hold the intersection of the source
bitmaps below, so it skips whole ranges of bins that all hold the piece's source; a source with a third of
all rows costs no longer search.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded
from .common import ascii_lower, cut_lineage

CAPACITY = 2048
#: Expected pieces of a shard; a shard is packed in one task's memory.
SHARD_PIECES = 4096

PACKED = "shard bigint, bin bigint, slot int, doc_id bigint, piece bigint, start bigint, n_words bigint, source string"


class Bins:
    """Open bins by residual space. A leaf maps (source bitmap, cluster bitmap) to the bins that have both."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.common = [-1] * (2 * self.size)  # -1 has every bit: no bin below
        self.leaves: dict[int, dict[tuple[int, int], list[int]]] = {}

    def refresh(self, residual: int) -> None:
        bits = -1
        for sources, _ in self.leaves.get(residual, ()):
            bits &= sources
        i = residual + self.size
        self.common[i] = bits
        while i > 1:
            i >>= 1
            bits = self.common[2 * i] & self.common[2 * i + 1]
            if self.common[i] == bits:
                break
            self.common[i] = bits

    def put(self, residual: int, sources: int, clusters: int, bin_id: int) -> None:
        self.leaves.setdefault(residual, {}).setdefault((sources, clusters), []).append(bin_id)
        self.refresh(residual)

    def successor(self, least: int, source: int) -> int:
        """The smallest residual of at least `least` at which some bin lacks the source; -1 if there is none."""
        i = least + self.size
        if self.common[i] & source != source:
            return least
        while i > 1:
            if i % 2 == 0 and self.common[i + 1] & source != source:
                i += 1
                while i < self.size:
                    i = 2 * i if self.common[2 * i] & source != source else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def take(self, need: int, source: int, cluster: int) -> tuple[int, int, int, int] | None:
        """Remove the tightest compatible bin (of equals the oldest): residual, its bitmaps, its number."""
        residual = self.successor(need, source)
        while residual >= 0:
            leaf = self.leaves[residual]
            fits = [(ids[0], key) for key, ids in leaf.items() if not key[0] & source and not key[1] & cluster]
            if fits:
                bin_id, key = min(fits)
                leaf[key].pop(0)
                if not leaf[key]:
                    del leaf[key]
                    self.refresh(residual)
                return residual, *key, bin_id
            residual = self.successor(residual + 1, source) if residual + 1 < self.size else -1
        return None


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bin and slot of each piece. Columns: doc_id, piece, n_words, source, c1, c2 (cluster)."""
    pieces = pieces.sort_values(["n_words", "doc_id", "piece", "c1", "c2"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    source_bit = {s: 1 << k for k, s in enumerate(pd.unique(pieces["source"]))}
    sizes = pieces.groupby(["c1", "c2"])["n_words"].transform("size")
    shared = pieces.loc[sizes > 1, ["c1", "c2"]].drop_duplicates()
    cluster_bit = {c: 1 << k for k, c in enumerate(zip(shared["c1"], shared["c2"], strict=True))}
    bins, placed, opened, filled = Bins(capacity), [], 0, {}
    for need, source, c in zip(pieces["n_words"].tolist(), pieces["source"], zip(pieces["c1"], pieces["c2"], strict=True), strict=True):
        s, d = source_bit[source], cluster_bit.get(c, 0)
        found = bins.take(need, s, d)
        residual, sources, clusters, bin_id = found or (capacity, 0, 0, opened)
        opened += found is None
        bins.put(residual - need, sources | s, clusters | d, bin_id)
        filled[bin_id] = slot = filled.get(bin_id, -1) + 1
        placed.append((bin_id, slot))
    pieces["bin"], pieces["slot"] = zip(*placed, strict=True) if placed else ((), ())
    return pieces


def cut_pieces(documents: DataFrame, capacity: int, cluster: str | None = None) -> DataFrame:
    """doc_id, source, c1, c2, piece, start, n_words: consecutive runs of at most `capacity` words of each text."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    named = F.lit(None).cast("string") if cluster is None else F.concat(F.lit("\n"), F.col(cluster).cast("string"))
    key = F.coalesce("named", ascii_lower(F.array_join("w", " ")))
    rows = documents.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), words.alias("w"), named.alias("named"))
    rows = rows.select("doc_id", "source", F.size("w").alias("n"), key.alias("key")).select("doc_id", "source", "n", F.xxhash64("key").alias("c1"), F.xxhash64(F.lit(1), "key").alias("c2"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    cut = exploded(rows, rows.columns, F.sequence(F.lit(0).cast("bigint"), last), "_pos", "piece")
    start = F.col("piece") * capacity
    return cut.select("doc_id", "source", "c1", "c2", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("n_words"))


def pack(documents: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, cluster: str | None = None) -> DataFrame:
    """One row per piece: shard, bin (within the shard), slot, doc_id, piece, start (word), n_words, source.

    Pieces of a bin hold at most `capacity` words together; no two share a source or a duplicate cluster: the value of the
    column `cluster`, or, where none is named or it is null, texts of equal words (A-Z lower-cased). A text longer than
    `capacity` words is cut to consecutive pieces, so all pieces together are the whole corpus. Null and empty texts are one piece of no words; a null source is a source of
    its own; repeated rows and rows without a doc_id are packed like others. Other columns are not read.
    """
    pieces = cut_lineage(cut_pieces(documents, capacity, cluster).withColumn("k", F.xxhash64("doc_id", "piece", "c1", "c2")))
    many = pieces.count()
    often = pieces.groupBy("k").count().where(F.col("count") > max(1000, many // 1000)).select("k", F.lit(True).alias("often"))  # at most 1,000 rows
    turn = F.when(F.col("often"), F.monotonically_increasing_id())  # equal rows are alike, so any dealing will do
    rows = pieces.join(F.broadcast(often), "k", "left").withColumn("shard", F.pmod(F.xxhash64("k", turn), F.lit(1 + many // shard_pieces))).drop("k", "often")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(batch, capacity)[["shard", "bin", "slot", "doc_id", "piece", "start", "n_words", "source"]]

    return rows.groupBy("shard").applyInPandas(run, PACKED)

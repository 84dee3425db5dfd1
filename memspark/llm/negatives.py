"""Hard negatives for embedding models, by slot-decomposed selection.

Every anchor has a few positives, and each positive of score p asks for the best rows of other labels whose score lies between
low * p and high * p. The windows of an anchor overlap, so they are not searched one by one: their upper limits cut the scores
into disjoint slots, and each task keeps the best k rows of every slot. The best k below an upper limit are then the first k of that
slot and those under it, so one descending list of at most slots * k rows answers all windows of the anchor. What lies
below a window's lower limit is the tail of its list and goes last.

Anchors are packed to blocks of bounded size. A pass sends PASS_BLOCKS of them to all rows (a broadcast of at most 64 MB), where
numpy scores them against packs of rows; only each task's best rows are shuffled, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import exploded
from .common import cut_lineage

#: Rows and bytes of a pack of vectors (one row at least), and anchor blocks of a pass.
PACK_ROWS, PACK_BYTES, PASS_BLOCKS = 4096, 8 << 20, 8
#: Rows that are scored at once: few first, so that thresholds rise early.
FIRST_ROWS, MOST_ROWS = 64, 1024
#: Scores stay within a bigint; a missing id sorts behind all others.
LEAST, MOST = -(2**63) + 1, 2**63 - 1

PACK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary())])


def packs(rows: DataFrame) -> DataFrame:
    """block, ids, labels, vectors (whole numbers as doubles, row by row) of rows vec_id, label, embedding, packed by length.

    A component x becomes floor(256 * x). Rows with a null or non-finite component are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, waiting = TaskContext.get().partitionId() << 32, {}
        made = 0

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors = (np.concatenate(part) for part in zip(*waiting.pop(dim), strict=True))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((first + made, ids, labels, vectors.tobytes()), PACK.types, strict=True)], schema=PACK)

        for batch in batches:
            ids, labels, column = batch.columns
            ids, labels = ids.fill_null(MOST).to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(256.0 * values)
            sizes = np.diff(ends)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                vectors = values[ends[at][:, None] + np.arange(dim)]
                fine = np.isfinite(vectors).all(axis=1)
                at, vectors, most = at[fine], vectors[fine], max(1, min(PACK_ROWS, PACK_BYTES // max(1, 8 * int(dim))))
                while len(at):
                    room = most - sum(len(i) for i, _, _ in waiting.get(dim, []))
                    waiting.setdefault(dim, []).append((ids[at[:room]], labels[at[:room]], vectors[:room]))
                    if len(at) >= room:
                        yield emit(dim)
                    at, vectors = at[room:], vectors[room:]
        for dim in list(waiting):
            yield emit(dim)

    return rows.mapInArrow(run, "block bigint, ids array<bigint>, labels array<bigint>, vectors binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; a shorter vector ends in zeros. Those beyond a bigint become its ends."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    bound = float(dim) * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return a.astype(kind) @ b.astype(kind).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


class Best:
    """The best k (score, id) of each anchor and slot; slot s of an anchor takes scores from lower[s] to upper[s]."""

    def __init__(self, upper: np.ndarray, lower: np.ndarray, k: int):
        self.upper, self.least, self.k = upper, lower.copy(), k
        self.found = [tuple(np.empty(0, np.int64) for _ in range(3)) for _ in upper]

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        for slot, (upper, least) in enumerate(zip(self.upper, self.least, strict=True)):
            inside = (scores <= upper.astype(scores.dtype)[:, None]) & (scores >= least.astype(scores.dtype)[:, None]) & allowed
            anchor, at = np.nonzero(inside)
            if len(anchor):
                self.merge(slot, anchor, scores[anchor, at].astype(np.int64), ids[at])

    def merge(self, slot: int, *new: np.ndarray) -> None:
        anchor, score, key = (np.concatenate(pair) for pair in zip(self.found[slot], new, strict=True))
        order = np.lexsort((key, -score, anchor))
        anchor, score, key = anchor[order], score[order], key[order]
        at = np.arange(len(anchor))
        place = at - np.maximum.accumulate(np.where(np.r_[True, anchor[1:] != anchor[:-1]], at, 0))
        keep, last = place < self.k, place == self.k - 1
        self.least[slot][anchor[last]] = score[last]
        self.found[slot] = anchor[keep], score[keep], key[keep]


def slots_of(limits: list | None, n: int, most: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower ends (slots, anchors) from the positives' scores: limits holds (place of the anchor, scores)."""
    upper, lower = np.full((most, n), LEAST, np.int64), np.full((most, n), MOST, np.int64)
    for place, scores in limits or []:
        ends = sorted((p * high // 100 for p in scores if p * low <= p * high), reverse=True)
        least = min((-(-p * low // 100) for p in scores if p * low <= p * high), default=MOST)
        for s, end in enumerate(ends):
            upper[s, place] = end
            lower[s, place] = max(least, ends[s + 1] + 1) if s + 1 < len(ends) else least
    return upper, lower


def selected(rows: DataFrame, blocks: DataFrame, k: int, slots: int, same_label: bool, low: int = 0, high: int = 0) -> DataFrame:
    """anchor, anchor_id, slot, score, id: the best k rows of each anchor and slot among the packs of rows.

    With same_label, other rows of the anchor's label in a single slot of all scores; else rows of other labels in the slots of
    the blocks' limits. anchor is the block and the place in it.
    """
    schema = "anchor bigint, anchor_id bigint, slot int, score bigint, id bigint"
    fields = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                block = row["block"].as_py()
                ids, labels = (row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                vectors = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(len(ids), -1)
                if block not in state:
                    names, own = (row[c].values.to_numpy(zero_copy_only=False) for c in ("anchor_ids", "anchor_labels"))
                    anchors = np.frombuffer(row["anchor_vectors"].as_py(), np.float64).reshape(len(names), -1)
                    if same_label:
                        ends = np.full((1, len(names)), MOST, np.int64), np.full((1, len(names)), LEAST, np.int64)
                    else:
                        ends = slots_of([(x["place"], x["scores"]) for x in row["limits"].as_py() or []], len(names), slots, low, high)
                    state[block] = names, own, anchors, Best(*ends, k)
                names, own, anchors, best = state[block]
                at, step = 0, FIRST_ROWS
                while at < len(ids):
                    part = slice(at, at + step)
                    alike = own[:, None] == labels[None, part]
                    allowed = alike & (names[:, None] != ids[None, part]) if same_label else ~alike
                    best.add(products(anchors, vectors[part]), ids[part], allowed)
                    at, step = at + step, min(2 * step, MOST_ROWS)
        for block, (names, _, _, best) in state.items():
            for slot, (anchor, score, key) in enumerate(best.found):
                none = key == MOST
                columns = [block * PACK_ROWS + anchor, names[anchor], np.full(len(anchor), slot, np.int32), score, pa.array(key, pa.int64(), mask=none)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    packed = packs(rows).drop("block")
    parts, numbers = [], sorted(r[0] for r in blocks.select("block").collect())
    sent = blocks.select("block", F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), F.col("vectors").alias("anchor_vectors"), "limits")
    for i in range(0, len(numbers), PASS_BLOCKS):
        turn = numbers[i : i + PASS_BLOCKS]
        pairs = packed.withColumn("block", F.explode(F.array(*(F.lit(b).cast("bigint") for b in turn))))
        found = pairs.join(F.broadcast(sent.where(F.col("block").isin(turn))), "block").mapInArrow(run, schema)
        order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        parts.append(cut_lineage(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)))
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], f"{schema}, place int")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def wide(c: Column | str) -> Column:
    """Room for a product of a score and a percentage."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vec_id, label, embedding.

    The score of two rows is the inner product of their components floor(256 * x), in whole numbers; higher scores come first,
    ties by smaller vec_id, rows without a vec_id last. Anchors are the rows where `anchors` holds. For each anchor, its first `positives`
    rows of the same label and another vec_id; for each of these, the first k rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows whose label or embedding is null, or with a null or non-finite component (also where 256 * x isn't finite), take no part. A vector that is shorter than another
    counts as ending in zeros; scores beyond a bigint become its largest or smallest value. Repeated rows count as often as they
    stand, as anchors too. Ids and labels that are no numbers count as null. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").try_cast("bigint").alias("vec_id"), F.col("label").try_cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), anchors.alias("is_anchor"))
    rows = rows.where("label is not null and embedding is not null")
    asking = rows.where("is_anchor and vec_id is not null").drop("is_anchor")
    rows = rows.drop("is_anchor")
    blocks = cut_lineage(packs(asking.repartition(1 + asking.count() // PACK_ROWS)))
    first = selected(rows, blocks.withColumn("limits", F.lit(None).cast("array<struct<place:int,scores:array<bigint>>>")), positives, 1, True)

    limits = first.groupBy("anchor").agg(F.collect_list("score").alias("scores"))
    block = F.shiftright("anchor", PACK_ROWS.bit_length() - 1)
    limits = limits.groupBy(block.alias("block")).agg(F.collect_list(F.struct((F.col("anchor") % PACK_ROWS).cast("int").alias("place"), "scores")).alias("limits"))
    below = selected(rows, cut_lineage(blocks.join(limits, "block")), k, positives, False, low, high)

    entry = F.struct((-F.col("score")).alias("turn"), F.col("id").isNull().alias("none"), "id", "score")
    lists = below.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    p, percent = wide("positive_score"), lambda v: F.lit(v).cast("decimal(38,0)")
    under = F.slice(F.filter("list", lambda e: wide(e["score"]) * percent(100) <= p * percent(high)), 1, k)
    answer = F.filter(under, lambda e: wide(e["score"]) * percent(100) >= p * percent(low))
    pairs = first.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(lists, "anchor")
    out = exploded(pairs.withColumn("answer", answer), ["anchor_id", "positive_id", "positive_score"], "answer", "pos", "e")
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))


#: The same over whole rows of `embeddings`, for ids that are not null; labels moved where vec_id is divisible by 7.
MINE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same AND anchor_id <> id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

"""Batch search: many queries against all chunks, notes and procedures of their context.

Candidates are scored where they lie: blocks of queries of bounded size travel to the tasks, each task keeps its best
50 per query, and only those are shuffled. Vectors never are. Ranks follow the score (to 9 decimals), then source,
chunk_idx and id, so results don't depend on partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.text import SPACES, WORD_BYTES, clamp, lines, not_blank, task_context, trimmed
from .extract import parsed, text_of, unwrapped

CANDIDATES = 50
#: Queries that travel to a task at once.
QUERY_BLOCK = 256
#: Narrow rows of results (some 100 bytes) that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Blocks that go with one scan of the candidates.
SCAN_BLOCKS = 8
LEXICAL_SHARE, PROCEDURE_LEXICAL, DECAY_DAYS = 0.2, 0.15, 130.0
DIGITS = 9
#: The score of a procedure of which confidence or time is null; all others are above 0.
UNKNOWN = -1.0


def notes_candidates(notes: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Notes (context, path, content, embedding) as candidates; the summary is the first line with text, without leading #."""
    first = F.get(F.filter(F.transform(lines(F.col("content")), trimmed), not_blank), 0)
    return notes.select(
        "context", F.col("path").alias("id"), F.col("path").alias("source"), F.lit(0).alias("chunk_idx"), "content", F.col("content").alias("index_text"),
        F.coalesce(F.btrim(F.regexp_replace(first, "^#+", ""), F.lit(SPACES)), F.lit("notes")).alias("summary"), F.lit("notes").alias("kind"), F.col(embedding).alias("embedding"),
    )


def chunk_candidates(chunks: DataFrame) -> DataFrame:
    return chunks.select("context", "id", F.col("source_path").alias("source"), "chunk_idx", "content", "index_text", "summary", F.lit("semantic").alias("kind"), "embedding")


def best_of(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    ordered = rows.sort_values(["query_id", "score", "source", "chunk_idx", "id"], ascending=[True, False, True, True, True], kind="stable")
    return ordered[ordered.groupby("query_id").cumcount() < keep]


def words_of(text: str | None) -> set[bytes]:
    """The distinct words that `tokenize` gives."""
    return {w for w in set((text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()) if len(w) > 1}


class QueryBlock:
    """Unit vectors and word sets of some queries, by context."""

    def __init__(self, rows: list):
        self.contexts: dict[str, tuple] = {}
        for context in {r.context for r in rows}:
            own = [r for r in rows if r.context == context]
            words = [words_of(r.text) for r in own]
            number = {t: k for k, t in enumerate(sorted(set().union(*words)))}
            has = np.zeros((len(own), len(number)), np.float32)
            for i, w in enumerate(words):
                has[i, [number[t] for t in w]] = 1
            self.contexts[context] = np.array([r.query_id for r in own]), [np.array(r.embedding or [], float) for r in own], number, has, np.array([len(w) for w in words], float), pd.DataFrame([r.asDict() for r in own])

    def measures(self, context: str, vectors: list, words: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and shares of common words, queries by candidates."""
        _, wanted, number, has, sizes, _ = self.contexts[context]
        dense = np.zeros((len(wanted), len(vectors)))
        width = np.array([0 if v is None else len(v) for v in vectors])
        for d in {len(q) for q in wanted} - {0}:
            rows, columns = [i for i, q in enumerate(wanted) if len(q) == d], np.nonzero(width == d)[0]
            if len(columns):
                a, b = np.stack([wanted[i] for i in rows]), np.stack([vectors[j] for j in columns]).astype(float)
                norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                dense[np.ix_(rows, columns)] = np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)
        present = np.zeros((len(vectors), has.shape[1]), np.float32)
        for j, own in enumerate(words):
            present[j, [number[t] for t in own & number.keys()]] = 1
        norm = np.sqrt(sizes[:, None] * np.array([len(w) for w in words], float)[None, :])
        shared = np.divide(has @ present.T, norm, out=np.zeros_like(norm), where=norm > 0)
        return dense, shared


def hybrid(dense: np.ndarray, shared: np.ndarray, alpha: float) -> np.ndarray:
    return alpha * np.clip((dense + 1) / 2, 0, 1) + (1 - alpha) * np.clip(shared, 0, 1)


QUERY = ["query_id", "context", "text", "embedding"]
#: query block, context, candidates, cosines, shares of common words -> scores, queries by candidates; NaN where two are no pair.
Score = Callable[[QueryBlock, str, pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]


def scored(queries: DataFrame, candidates: DataFrame, keep: list[str], score: Score, most: int | None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, score, lexical (share of common words) and the columns `keep` of pairs of one context; of each task the best `most` per query, or all.

    queries: query_id, context, text, embedding and what `score` names. candidates: context, words_in, embedding and what `score` and `keep` name;
    words are read from words_in, once a row and scan. Queries are read in blocks of about `block`; SCAN_BLOCKS of them go with one scan of the candidates.
    """
    wanted = staged(queries)
    blocks = 1 + wanted.count() // block
    sc, found = queries.sparkSession.sparkContext, []
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = ", ".join(["query_id bigint", "score double", "lexical double", *(f"`{c}` {types[c]}" for c in keep)])
    for k in range(0, blocks, SCAN_BLOCKS):
        each = [wanted.where(block_of == n).collect() for n in range(k, min(blocks, k + SCAN_BLOCKS))]
        shared = sc.broadcast(cloudpickle.dumps(([QueryBlock(rows) for rows in each], score)))  # with its class, which executors may not have

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            (every, points), best = pickle.loads(shared.value), None
            for batch in batches:
                for context, own in batch.groupby("context"):
                    vectors, words = own["embedding"].tolist(), [words_of(t) for t in own["words_in"]]
                    for asked in every:
                        if context not in asked.contexts:
                            continue
                        ids = asked.contexts[context][0]
                        dense, lexical = asked.measures(context, vectors, words)
                        point = points(asked, context, own, dense, lexical)
                        q, c = np.nonzero(~np.isnan(point))
                        if most is not None and point.shape[1] > most:  # all that tie with the last place stay for the full order
                            full = np.where(np.isnan(point), -np.inf, point)
                            least = np.partition(full, point.shape[1] - most, axis=1)[:, point.shape[1] - most]
                            q, c = np.nonzero((full >= least[:, None]) & (full > -np.inf))
                        part = own.iloc[c][keep].assign(query_id=ids[q], score=point[q, c], lexical=lexical[q, c])
                        if most is None:
                            yield part[["query_id", "score", "lexical", *keep]]
                        else:
                            best = best_of(part if best is None else pd.concat([best, part]), most)
            if best is not None:
                yield best[["query_id", "score", "lexical", *keep]]

        found.append(candidates.mapInPandas(run, schema))
    return reduce(DataFrame.unionByName, found)


def hybrid_pairs(queries: DataFrame, candidates: DataFrame, alpha: float = 0.7) -> DataFrame:
    """query_id, id, score (not rounded) of all pairs of one context."""
    weight = min(1.0, max(0.0, alpha))
    rows = candidates.select("context", "id", F.col("index_text").alias("words_in"), "embedding")
    return scored(queries.select(*QUERY), rows, ["id"], lambda asked, context, own, dense, shared: hybrid(dense, shared, weight), None).select("query_id", "id", "score")


def top_candidates(queries: DataFrame, candidates: DataFrame, alpha: float = 0.7, keep: int = CANDIDATES, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, source, chunk_idx, score, lexical (share of common words) of the best `keep` candidates per query.

    queries: query_id, context, text, embedding. candidates: context, id, source, chunk_idx, index_text, embedding.
    """
    weight = min(1.0, max(0.0, alpha))
    rows = candidates.select("context", "id", "source", "chunk_idx", F.col("index_text").alias("words_in"), "embedding")
    best = scored(queries.select(*QUERY), rows, ["id", "source", "chunk_idx"], lambda asked, context, own, dense, shared: np.round(hybrid(dense, shared, weight), DIGITS), keep, block)
    return ranked(best, keep).drop("rank")


def ranked(rows: DataFrame, keep: int) -> DataFrame:
    """The best `keep` rows per query with their rank."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk_idx", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


RESULT = ["query_id", "rank", "content", "summary", "source", "score", "kind"]


def semantic_search(queries: DataFrame, chunks: DataFrame, notes: DataFrame | None = None, k: int = 5, alpha: float = 0.7) -> DataFrame:
    """Results of the k best chunks and notes per query: the best 50 by hybrid score are scored again, a fifth by shared words."""
    pool = chunk_candidates(chunks)
    if notes is not None:
        pool = pool.unionByName(notes_candidates(notes))
    again = F.round((1 - LEXICAL_SHARE) * F.col("score") + LEXICAL_SHARE * F.col("lexical"), DIGITS)
    best = staged(ranked(top_candidates(queries, pool, alpha).withColumn("score", again), k).join(queries.select("query_id", "context"), "query_id").drop("lexical", "source", "chunk_idx"))
    best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best  # then no text is shuffled
    return pool.drop("embedding").join(best, ["context", "id"]).select(*RESULT, "chunk_idx", "id")


def context_matches(left: Column, right: Column) -> Column:
    """Every field is equal, or null on one side."""
    out = F.lit(True)
    for f in ("language", "framework", "environment"):
        a, b = left[f], right[f]
        out = out & (a.isNull() | b.isNull() | (a == b))
    return out


FIELDS = ("language", "framework", "environment")


def patterns(rows: DataFrame, own: str, other: str, context: str, prefix: str) -> DataFrame:
    """rows eight times: with `own`, the fields that a row's context sets (a bit each), every `other` that a partner may set, and what both set.

    Two rows match where they have equal `own`, `other` and set fields, each pair once: a null on one side matches all without a theta join.
    """
    sets = sum((F.when(F.col(context)[f].isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))
    wide = rows.withColumn(own, sets).withColumn(other, F.explode(F.array(*map(F.lit, range(8)))))
    both = F.col(own).bitwiseAND(F.col(other))
    return wide.withColumns({f"{prefix}{f}": F.when(both.bitwiseAND(F.lit(1 << i)) != 0, F.col(context)[f]).otherwise("") for i, f in enumerate(FIELDS)})


def matching(queries: DataFrame, procedures: DataFrame) -> DataFrame:
    """Pairs of a block of queries (context, q_context, ...), which is broadcast, and procedures (context, p_context, ...) of one context whose task contexts match."""
    asked, known = patterns(queries, "q_sets", "p_sets", "q_context", "v_"), patterns(procedures, "p_sets", "q_sets", "p_context", "v_")
    return known.join(F.broadcast(asked), ["context", "q_sets", "p_sets", *(f"v_{f}" for f in FIELDS)])


def agreeing(queries: pd.DataFrame, procedures: pd.DataFrame) -> np.ndarray:
    """Whether task contexts match, queries by procedures: every field is equal, or null on one side."""
    out = np.ones((len(queries), len(procedures)), bool)
    for f in FIELDS:
        codes = pd.factorize(np.r_[queries[f].to_numpy(object), procedures[f].to_numpy(object)])[0]  # -1 for null
        a, b = codes[: len(queries), None], codes[None, len(queries) :]
        out &= (a < 0) | (b < 0) | (a == b)
    return out


def procedural_search(queries: DataFrame, procedures: DataFrame, k: int = 5, as_of: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Results of the k best procedures per query whose context matches the query's; older ones count less. as_of is in seconds.

    Words are read once a row, and each task keeps its best k of a query before anything is shuffled.
    """
    now = as_of if as_of is not None else F.unix_timestamp()
    fields = [F.col("task_context")[f].alias(f) for f in FIELDS]
    known = procedures.select(
        "context", "id", "embedding", F.col("task_description").alias("words_in"), *fields, F.col("confidence").cast("double").alias("confidence"), F.exp(-((now - F.col("created_at")) / 86400.0) / DECAY_DAYS).alias("decay"),
        F.concat(F.lit("steps: "), F.array_join("steps", " -> ")).alias("content"), F.col("task_description").alias("summary"), F.coalesce("source_path", F.lit("procedural")).alias("source"), F.lit(0).alias("chunk_idx"),
    )
    asked_for = queries.select("query_id", "context", "text", "embedding", task_context(F.col("text")).alias("c")).select("query_id", "context", "text", "embedding", *(F.col("c")[f].alias(f) for f in FIELDS))

    def score(asked: QueryBlock, context: str, own: pd.DataFrame, dense: np.ndarray, shared: np.ndarray) -> np.ndarray:
        points = np.clip((dense + 1) / 2, 0, 1) * own["confidence"].to_numpy()[None, :] * own["decay"].to_numpy()[None, :] + PROCEDURE_LEXICAL * shared
        points = np.where(np.isnan(points), UNKNOWN, np.round(points, DIGITS))
        return np.where(agreeing(asked.contexts[context][5], own), points, np.nan)

    best = ranked(scored(asked_for, known, ["id", "content", "summary", "source", "chunk_idx"], score, k, block), k)
    return best.withColumns({"kind": F.lit("procedural"), "score": F.when(F.col("score") != UNKNOWN, F.col("score"))}).select(*RESULT, "chunk_idx", "id")


def search(queries: DataFrame, chunks: DataFrame, notes: DataFrame | None, procedures: DataFrame, kind: str = "all", k: int = 5, alpha: float = 0.7, as_of: Column | None = None) -> DataFrame:
    """semantic, procedural, or all: both lists joined, ranked again and cut to k."""
    if kind == "semantic":
        return semantic_search(queries, chunks, notes, k, alpha)
    if kind == "procedural":
        return procedural_search(queries, procedures, k, as_of)
    if kind != "all":
        raise ValueError(f"unknown kind of search: {kind}")
    both = semantic_search(queries, chunks, notes, k, alpha).unionByName(procedural_search(queries, procedures, k, as_of))
    return ranked(both.drop("rank"), k).select(*RESULT, "chunk_idx", "id")


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float = 0.7) -> DataFrame:
    """query_id, id, score, rank of two scored lists (query_id, id, score): weighted sum over ids, an absent side counting 0."""
    a = min(1.0, max(0.0, alpha))
    left = dense.select("query_id", "id", (a * clamp((F.col("score") + 1) / 2)).alias("part"))
    right = sparse.select("query_id", "id", ((1 - a) * clamp(F.col("score") / 2.2)).alias("part"))
    rows = left.unionByName(right).groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))


# --- answers ---------------------------------------------------------------------------------------


def clipped(text: Column, n: int) -> Column:
    t = trimmed(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def answer_prompts(results: DataFrame) -> DataFrame:
    """query_id, prompt: the results of each query as numbered blocks in order of rank. Texts are cut before they are gathered."""
    source = F.when(not_blank(F.col("source")), trimmed(F.col("source"))).otherwise("unknown")
    block = F.concat(F.lit("["), F.col("rank"), F.lit("]\nkind: "), "kind", F.lit("\nsource: "), source, F.lit("\nsummary: "), clipped(F.col("summary"), 400), F.lit("\ncontent:\n"), clipped(F.col("content"), 2000))
    gathered = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return gathered.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("prompt"))


def attributions(results: DataFrame, citations: DataFrame) -> DataFrame:
    """query_id, sources: labels of the cited ranks in order of citation, each once; without a valid citation the first 5 labels by rank.

    citations: query_id, citations (array of ranks from 1). A blank source is named by its kind, else "unknown source".
    """
    label = F.when(not_blank(F.col("source")), trimmed(F.col("source"))).when(not_blank(F.col("kind")), trimmed(F.col("kind"))).otherwise("unknown source")
    known = results.select("query_id", F.col("rank").cast("bigint").alias("rank"), label.alias("label"))
    cited = citations.select("query_id", F.posexplode("citations").alias("pos", "cited")).select("query_id", "pos", F.col("cited").cast("bigint").alias("rank"))

    def in_order(rows: DataFrame, place: str, name: str) -> DataFrame:
        firsts = rows.groupBy("query_id", "label").agg(F.min(place).alias("at"))
        return firsts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias(name))

    given = in_order(cited.join(known, ["query_id", "rank"]), "pos", "g")
    instead = in_order(known, "rank", "f")
    labels = lambda c: F.transform(c, lambda x: x["label"])
    return instead.join(given, "query_id", "left").select("query_id", F.coalesce(labels(F.col("g")), F.slice(labels(F.col("f")), 1, 5)).alias("sources"))


def answer_reply(reply: str | None) -> dict:
    found = unwrapped(reply)
    answer = text_of(found.get("answer")) if found else ""
    if not answer:
        return {"answer": None, "citations": [], "error": "no answer"}
    given = found.get("citations")
    return {"answer": answer, "citations": [c for c in given if isinstance(c, int) and c > 0] if isinstance(given, list) else [], "error": None}


def parse_answers(replies: Column) -> Column:
    """Struct of answer, citations, error; a reply without an answer is an error."""
    return parsed(replies, answer_reply, "answer string, citations array<bigint>, error string")

"""Benchmark decontamination with an FM-index per training shard.

Each task gathers its documents into shards of bounded size, indexes a shard's words (suffix
order, Burrows-Wheeler transform, wavelet-matrix ranks, sampled suffix positions), searches all
test phrases backwards at once, locates their occurrences and merges them to removal spans.

The test phrases travel to the tasks in blocks of bounded size, one of which is unpacked at a time. A report
passes through one narrow map step per block, cutting through one step that repeats until no block hits. Nothing is shuffled.

Two exact reductions keep the index small: words outside the phrases' vocabulary become one
separator symbol, and runs of vocabulary words shorter than the shortest phrase are left out,
since no phrase can occur in them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, fold_words, small_batches

WINDOW_WORDS = 10
#: A shard is closed at this many words or bytes, so its index takes a bounded part of a task's memory.
SHARD_WORDS, SHARD_BYTES = 1_000_000, 8_000_000
#: Bytes of benchmark text that are held by a task at once.
BLOCK_BYTES = 8_000_000
#: One in so many suffix positions is kept for locating.
SAMPLE = 8

STATE = "doc_id bigint, text string, n_words bigint, hits array<struct<s:bigint,e:bigint>>, items array<bigint>"


class FMIndex:
    """Word-level FM-index of an integer sequence; symbols are 1 and up, 0 ends the text."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.append(symbols.astype(np.int64), 0)
        self.n, order = len(text), suffix_order(text, sigma)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.levels = max(1, int(sigma).bit_length())
        self.ones, self.zeros, seq = [], [], self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.sampled = order % SAMPLE == 0
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        first, at = np.zeros_like(rows), rows
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbols >> level) & 1 == 1
            ones = self.ones[k]
            first, at = (np.where(bit, self.zeros[k] + ones[x], x - ones[x]) for x in (first, at))
        return at - first

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each phrase (rows of phrases, right-aligned)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.nonzero((step < lengths) & (low < high))[0]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            base = self.before[symbol]
            low[live], high[live] = base + self.rank(symbol, low[live]), base + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled row."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            hit = self.sampled[at]
            found[todo[hit]] = self.samples[self.sample_at[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            symbol = self.bwt[at]
            rows[todo] = self.before[symbol] + self.rank(symbol, at)
            steps[todo] += 1
        return found


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array by prefix doubling; after each round only the suffixes that still tie are sorted."""
    n, bits = len(text), max(1, int(sigma).bit_length())
    reach = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = (key << bits) | np.concatenate([text[k:], np.zeros(k, np.int64)])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while not fresh.all():
        tied = np.nonzero(~(fresh & np.append(fresh[1:], True)))[0]
        at = order[tied]
        group, later = rank[at], np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)], -1)
        by = np.lexsort((later, group))
        order[tied], group, later = at[by], group[by], later[by]
        fresh[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (later[1:] != later[:-1])])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh[tied], np.arange(len(tied)), 0))]
        reach *= 2
    return order


class Phrases:
    """A block of benchmark items cut into windows: vocabulary, distinct windows, and the items of each window."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in fold_words(text)]
            for k in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(tuple(codes[k : k + window]), set()).add(item)
        self.sigma = len(self.vocabulary) + 2
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.windows = np.zeros((len(owners), window), np.int64)
        for k, w in enumerate(owners):
            self.windows[k, window - len(w) :] = w

    def occurrences(self, words: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[int]]]:
        """For each document of a shard: merged [start, end) word spans of all windows, and the sorted items."""
        out: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in words]
        if not self.owners:
            return out
        get, one = self.vocabulary.get, repeat(1)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        codes = np.ones(int(starts[-1]), np.int64)
        for w, start in zip(words, starts, strict=False):
            codes[start : start + len(w)] = np.fromiter(map(get, w, one), np.int64, len(w))
        known = codes != 1
        edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
        begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        keep = end - begin >= self.shortest
        begin, end = begin[keep], end[keep]
        if not len(begin):
            return out
        sizes = end - begin + 1  # each run brings the separator behind it
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        index = FMIndex(codes[at], self.sigma)
        low, high = index.search(self.windows, self.lengths)
        found = np.nonzero(high > low)[0]
        if not len(found):
            return out
        many = (high - low)[found]
        which = np.repeat(found, many)
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        place = at[index.locate(rows)]
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + self.lengths[which], -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8), [0]]))
        for s, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
            doc = int(np.searchsorted(starts, s, "right")) - 1
            out[doc][0].append((s - int(starts[doc]), e - int(starts[doc])))
        pairs = np.unique(np.stack([np.searchsorted(starts, place, "right") - 1, which]), axis=1)
        seen: dict[int, set[int]] = {}
        for doc, w in pairs.T.tolist():
            seen.setdefault(doc, set()).update(self.owners[w])
        for doc, items in seen.items():
            out[doc][1].extend(sorted(items))
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def byte_spans(data: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of word spans, from the first word's start to the last word's end."""
    out, hits, k = [], iter(hits), 0
    span = next(hits, None)
    for i, m in enumerate(re.finditer(WORD_BYTES, data)):
        if span is None:
            break
        if i == span[0]:
            k = m.start()
        if i == span[1] - 1:
            out.append((k, m.end()))
            span = next(hits, None)
    return out


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Remove byte ranges; a line break stands where text was removed between words."""
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s].rstrip(b" \t"))
        at = e
    kept.append(data[at:].lstrip(b" \t"))
    return b"\n".join(x for x in kept if x)


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcast blocks of benchmark items, each of about block_bytes at most and pickled with its class, which executors may not have; items without an id are left out."""
    items = benchmark.select(F.col("item_id").try_cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total) // block_bytes
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(cloudpickle.dumps(Phrases([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()], window))) for k in range(n)]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[list[bytes]]]]:
    """Rows of a task in shards of bounded size, with their words; a longer document makes a shard alone."""
    rows, words, size, count = [], [], 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            words.append(fold_words(row["text"]))
            size, count = size + len(row["text"] or ""), count + len(words[-1])
            if size >= SHARD_BYTES or count >= SHARD_WORDS:
                yield rows, words
                rows, words, size, count = [], [], 0, 0
    if rows:
        yield rows, words


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (merged word spans, end exclusive), items (sorted ids).

    Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A phrase is `window` consecutive
    item words; an item of fewer words, but not none, is one phrase. Null and empty texts have no words
    and no hits; repeated rows are reported each; items with a null id are ignored; an empty benchmark
    hits nothing. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    state = documents.select(
        F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<s:bigint,e:bigint>>").alias("hits"), F.array().cast("array<bigint>").alias("items"),
    )
    fields = [pa.field("doc_id", pa.int64()), pa.field("text", pa.string()), pa.field("n_words", pa.int64()), pa.field("hits", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.field("items", pa.list_(pa.int64()))]
    blocks = phrase_blocks(benchmark, window, block_bytes)
    for block in blocks:
        last = block is blocks[-1]  # the text is needed no longer
        layout = pa.schema([f for f in fields if not (last and f.name == "text")])

        def run(batches: Iterator[pa.RecordBatch], block=block, layout=layout) -> Iterator[pa.RecordBatch]:
            phrases = pickle.loads(block.value)
            for rows, words in shards(batches):
                for row, w, (spans, items) in zip(rows, words, phrases.occurrences(words), strict=True):
                    row["n_words"] = len(w)
                    if spans:
                        row["hits"] = [{"s": s, "e": e} for s, e in merge_spans([*((x["s"], x["e"]) for x in row["hits"]), *spans])]
                        row["items"] = sorted({*row["items"], *items})
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=layout)

        state = state.mapInArrow(run, STATE.replace(" text string,", "") if last else STATE)
    return state


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (word ranges) of find_contamination."""
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.col("hits").alias("spans"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with every benchmark passage cut out of the texts.

    A line break stands in each gap. Where a cut brings the two sides of a phrase together, it is cut again,
    until no phrase is left. A document of which no word is left is dropped; documents without a hit keep
    their text as it is (null included), n_chars follows the text of the others.
    """
    small_batches(documents.sparkSession)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    out = documents.select(*columns)
    schema = out.schema
    blocks = phrase_blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (layout, rows), words in shards_with_schema(batches):
            todo, gone = list(range(len(rows))), set()
            while todo:  # all blocks see one text, then it is cut; so the blocks' size changes nothing
                spans: dict[int, list[tuple[int, int]]] = {}
                for block in blocks:
                    phrases = pickle.loads(block.value)
                    for k, (found, _) in zip(todo, phrases.occurrences([words[k] for k in todo]), strict=True):
                        if found:
                            spans[k] = merge_spans([*spans.get(k, ()), *found])
                for k, found in spans.items():
                    data = rows[k]["text"].encode("utf-8", "surrogatepass")
                    rows[k]["text"] = cut_spans(data, byte_spans(data, found)).decode("utf-8", "surrogatepass")
                    rows[k]["n_chars"] = len(rows[k]["text"])
                    words[k] = fold_words(rows[k]["text"])
                    if not words[k]:
                        gone.add(k)
                todo = [k for k in spans if k not in gone]
            rows = [r for k, r in enumerate(rows) if k not in gone]
            for k in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=layout)

    return out.mapInArrow(run, schema)


def shards_with_schema(batches: Iterator[pa.RecordBatch]):
    """shards(), each with the batches' Arrow schema."""
    layout: list[pa.Schema] = []

    def noted():
        for batch in batches:
            layout[:] = [batch.schema]
            yield batch

    for rows, words in shards(noted()):
        yield (layout[0], rows), words


def report_sql(window: int = WINDOW_WORDS) -> str:
    """contamination_report without spans in DuckDB's SQL, written anew."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce({words}, []) AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT item_id, ws, least(len(ws), {window}) AS l, unnest(range(1, greatest(len(ws) - {window}, 0) + 2)) AS i FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS gram FROM v),
g AS (SELECT id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS gram FROM (SELECT id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM p))),
h AS (SELECT id, i, l, item_id FROM g JOIN p USING (l, gram)),
n AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(i, i + l)) AS q FROM h) GROUP BY id),
m AS (SELECT id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h GROUP BY id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (id) LEFT JOIN m USING (id)"""

"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

A language gives every piece of the vocabulary a probability. The probability of a word is the sum, over all ways to cut it into pieces,
of the product of their probabilities; a forward pass over its bytes finds it. Every single byte is a piece, so every word has one.
A text's probability is the product over its words (runs of letters and their marks, after a word-start mark); Bayes' rule turns the
languages' sums into a posterior.

The probabilities are learned by expectation maximisation over all words of all labelled training texts: distinct words are
counted per language by a shuffle with partial counts, then each round sends the model to the words, runs forward and backward passes,
and sums the expected counts per piece. The driver sees one row per piece, at most as many as the vocabulary holds.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, doc_id, small_batches

#: A file of a public vocabulary: pieces of a sentencepiece model, or ranks in base64.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of expectation maximisation, and what each piece counts for beforehand.
ROUNDS, PRIOR = 3, 0.01
#: Words start with a mark, which is a space in vocabularies of ranks and an underline sign in those of sentencepiece. Here bytes are
#: characters below 256; GAP stands between words and is part of no piece.
GAP, START = "\u0100", "\u0101"
WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
#: Cells (words times bytes times languages) of a table of forward sums, places between two rescalings, and words that a task remembers.
#: A task works on MANY words of the training table at once.
CELLS, RESCALE, REMEMBERED, MANY = 1 << 19, 16, 500_000, 20_000
UNKNOWN = "und"


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The distinct pieces of a vocabulary file, and all single bytes and the mark; a character for each byte and one for the mark."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [p.replace("▁".encode(), b" ") for p in pieces]
    else:
        with open(path, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return sorted({chr(b) for b in range(256)} | {START} | {START + p[1:].decode("latin-1") if p.startswith(b" ") else p.decode("latin-1") for p in pieces if p})


def ranks(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers that are not negative."""
    return np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")


class Pieces:
    """The vocabulary as a tree of prefixes, and a search for all its pieces in many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest, self.next = pieces, max(map(len, pieces)), None

    def __reduce__(self):
        return Pieces, (self.pieces,)

    def grow(self) -> None:
        """next[node, character] is the node of the longer prefix (0: none), piece[node] the piece that ends there (-1: none)."""
        nodes, edges, ends = {"": 0}, [], {}
        for i, piece in enumerate(self.pieces):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    edges.append((nodes[piece[: k - 1]], ord(piece[k - 1]), nodes[piece[:k]]))
            ends[nodes[piece]] = i
        self.next, self.piece = np.zeros((len(nodes), 258), np.int32), np.full(len(nodes), -1)
        before, character, after = np.array(edges).T
        self.next[before, character] = after
        self.piece[list(ends)] = list(ends.values())

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """End, word, start and piece of every occurrence, by end, then word."""
        if self.next is None:  # once a task
            self.grow()
        codes = np.frombuffer((GAP.join(words) + GAP).encode("utf-16-le"), np.uint16)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        found, at, node, deep = [], np.flatnonzero(codes != ord(GAP)), 0, 0
        while len(at):  # all places at once, as long as a piece may go on
            node = self.next[node, codes[at + deep]]
            on = node > 0
            at, node, deep = at[on], node[on], deep + 1
            piece = self.piece[node]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), deep), piece[whole]))
        place, length, piece = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        word = np.repeat(np.arange(len(words)), sizes)[place]
        start = place - (np.cumsum(sizes) - sizes)[word]
        order = ranks(word)
        order = order[ranks((start + length)[order])]
        start, length = start[order], length[order]
        return start + length, word[order], start, piece[order]


class Lattice:
    """All pieces in a batch of words, as edges from one byte place to another."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.end, self.word, self.start, self.piece = pieces.edges(words)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.longest, self.width = pieces.longest, int(self.sizes.max(initial=0)) + 1
        self.bounds = np.searchsorted(self.end, np.arange(self.width + 1))

    def at_end(self, j: int) -> tuple[slice, np.ndarray]:
        """The edges that end at j, and where those of each word begin among them."""
        e = slice(self.bounds[j], self.bounds[j + 1])
        word = self.word[e]
        return e, np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums (place, word, language) of segmentations up to a place, and the logarithms of what they were divided by (None for short words)."""
        a = np.zeros((self.width, len(self.sizes), p.shape[1]))
        logs = np.zeros_like(a) if self.width > RESCALE else None
        a[0] = 1.0
        for j in range(1, self.width):
            e, first = self.at_end(j)
            a[j, self.word[e][first]] = np.add.reduceat(a[self.start[e], self.word[e]] * p[self.piece[e]], first, axis=0)
            if logs is not None:
                logs[j] = logs[j - 1]
            if logs is not None and j % RESCALE == 0:  # all sums that later places need
                near = slice(max(0, j - self.longest), j + 1)
                top = a[near].max(axis=0)
                top[top <= 0] = 1.0
                a[near] /= top
                logs[near] = logs[j] + np.log(top)
        return a, logs

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities (word, language)."""
        a, logs = self.forward(p)
        at = np.arange(len(self.sizes))
        return np.log(np.maximum(a[self.sizes, at], 1e-300)) + (0 if logs is None else logs[self.sizes, at])

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses (piece, language) where the words occur counts (word, language) times.

        From the last place to the first, the occurrences that pass a place are dealt to the edges that end there, by their shares of its sum.
        """
        a, logs = self.forward(p)
        passed, uses = np.zeros_like(a), np.zeros((len(self.piece), p.shape[1]))
        passed[self.sizes, np.arange(len(self.sizes))] = counts
        for j in range(self.width - 1, 0, -1):
            e, first = self.at_end(j)
            start, word = self.start[e], self.word[e]
            ways = a[start, word] * p[self.piece[e]]
            if logs is not None:
                ways *= np.exp(logs[start, word] - logs[j, word])
            total = np.zeros(a.shape[1:])
            total[word[first]] = np.add.reduceat(ways, first, axis=0)
            ways *= (passed[j] / np.maximum(total, 1e-300))[word]
            passed[start, word] += ways  # a word's edges of one end have different starts
            uses[e] = ways
        return np.stack([np.bincount(self.piece, u, len(p)) for u in uses.T], axis=1)


def lattices(words: list[str], pieces: Pieces, languages: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of words of like length, with the words' places."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cells, at = (sizes[order] + 1) * max(1, languages), 0
    while at < len(words):
        room = int(np.searchsorted(np.arange(1, len(words) - at + 1) * cells[at:], CELLS, "right"))
        part = order[at : at + max(1, room)]
        yield part, Lattice([words[k] for k in part.tolist()], pieces)
        at += len(part)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def marked(word: str) -> str:
    return START + (word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1"))


class LanguageModel:
    """Piece probabilities (piece, language) of the languages and their shares among the training texts."""

    def __init__(self, pieces: Pieces, languages: list[str], p: np.ndarray, shares: np.ndarray):
        self.pieces, self.languages, self.p, self.shares = pieces, languages, p, shares

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Logarithms of the words' probabilities (word, language)."""
        out = np.zeros((len(words), len(self.languages)))
        for part, lattice in lattices([marked(w) for w in words], self.pieces, len(self.languages)):
            out[part] = lattice.log_likelihood(self.p)
        return out

    def predict(self, documents: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score of every row."""
        small_batches(documents.sparkSession)
        sent = documents.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, known, parts = sent.value, {}, []  # a word's row among the scores
            for batch in batches:
                counts = [Counter(words_of(t.as_py())) for t in batch.column(1)]
                if len(known) > REMEMBERED:
                    known, parts = {}, []
                new = [w for w in dict.fromkeys(chain.from_iterable(counts)) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                parts = [np.concatenate([*parts, model.word_scores(new)])]
                found = [model.decide(c, parts[0][[known[w] for w in c]]) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

        rows = documents.select(doc_id(), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")

    def decide(self, counts: Counter, scores: np.ndarray) -> tuple[str, float]:
        """The likeliest language of a text with these words, and its posterior, to six digits; no words or no languages are unknown with score 0."""
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        logs = np.log(self.shares) + np.array(list(counts.values()), float) @ scores
        best = int(logs.argmax())
        return self.languages[best], round(float(1 / np.exp(logs - logs[best]).sum()), 6)


def training_words(rows: DataFrame, languages: list[str]) -> DataFrame:
    """word, counts (one per language) over all rows (text, lang)."""
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        schema = pa.schema([("word", pa.string()), ("lang", pa.int32()), ("n", pa.int64())])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([number[lang]] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], schema=schema)
            seen.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, seen.values())) > REMEMBERED:
                yield from flush()
        yield from flush()

    counted = rows.mapInArrow(count, "word string, lang int, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return counted.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))


def fit(documents: DataFrame, train: Column, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR) -> LanguageModel:
    """Learn from text and lang of the documents where `train` holds and lang is not null."""
    small_batches(documents.sparkSession)
    rows = documents.where(train).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    shares = sorted((lang, n) for lang, n in rows.groupBy("lang").count().collect())  # one row a language
    pieces, languages = Pieces(read_vocabulary(vocabulary)), [lang for lang, _ in shares]
    p = np.full((len(pieces.pieces), len(languages)), 1 / len(pieces.pieces))
    weights = np.array([n for _, n in shares], float)
    model = LanguageModel(pieces, languages, p, weights / max(1.0, weights.sum()))
    if not languages:
        return model
    words = cut_lineage(training_words(rows, languages))
    for _ in range(rounds):
        expected = expected_uses(words, model)
        model = LanguageModel(pieces, languages, (expected + prior) / (expected + prior).sum(axis=0), model.shares)
    return model


def expected_uses(words: DataFrame, model: LanguageModel) -> np.ndarray:
    """Expected uses (piece, language) of the pieces in all words (word, counts)."""
    sent = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        total, words, seen = np.zeros_like(model.p), [], []

        def add() -> None:
            counts = np.zeros((len(words), len(model.languages)))
            for i, row in enumerate(seen):
                for c in row:
                    counts[i, c["lang"]] = c["n"]
            for part, lattice in lattices([marked(w) for w in words], model.pieces, len(model.languages)):
                total[:] += lattice.expected(model.p, counts[part])
            words.clear()
            seen.clear()

        for batch in batches:
            words += batch.column(0).to_pylist()
            seen += batch.column(1).to_pylist()
            if len(words) >= MANY:
                add()
        add()
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["piece", "uses"])

    made = words.mapInArrow(run, "piece int, uses array<double>")
    sums = made.groupBy("piece").agg(*(F.sum(F.col("uses")[i]).alias(f"u{i}") for i in range(len(model.languages))))
    out = np.zeros_like(model.p)
    for row in sums.collect():
        out[row[0]] = row[1:]
    return out


def held_out(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_report(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents.

    Learns from rows with a lang whose crc32(doc_id as text) mod 3 is not 1 (rows without a doc_id, or with one that is no number,
    are not held out); predictions depend on the text alone. A null text or one without a letter is `und` with score 0, and so is
    every text if there is nothing to learn from. Equal texts have equal predictions; equal posteriors go to the language that sorts first.
    Repeated rows count as often as they stand. Other columns are not read; an empty table gives no rows.
    """
    model = fit(documents, ~held_out(F.col("doc_id").try_cast("bigint")), vocabulary)
    found = model.predict(documents)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

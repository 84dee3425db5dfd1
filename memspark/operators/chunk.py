"""Cutting units to chunks. Work per document stays in its row; rows are exploded last, without a shuffle.

Unit tables have context, source_path, text; other columns stay. chunk columns: chunk_idx, content, index_text,
chunk_strategy, char_start, char_end (bytes of the text with \\r\\n as \\n), session_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import detect_chunker
from ..functions.rows import exploded as rows_of
from ..functions.text import SPACES, extension, not_blank, token_count, trimmed

CHUNK = "struct<content:string,strategy:string,start:bigint,end:bigint,session:string>"
STRUCTURE_TOKENS, SYNTAX_TOKENS, TURN_TOKENS = 400, 600, 600
#: What opens a definition, by extension.
BOUNDARIES = {
    "rs": ("pub fn ", "fn ", "impl ", "struct ", "enum ", "mod "), "py": ("def ", "async def ", "class "), "go": ("func ",),
    **dict.fromkeys(("ts", "tsx", "js", "jsx"), ("function ", "class ", "export function ", "export default ")), **dict.fromkeys(("java", "kt", "scala"), ("class ", "fun ", "object ")),
}
COMMENTS, COMMENT_LINES = ("///", "//!", "#", "//"), 10


def sentences(text: Column) -> Column:
    """Trimmed sentences of at least 20 bytes; each ends with its . ! ? or line end."""
    cut = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"), 0), trimmed)
    return F.filter(cut, lambda x: F.octet_length(x) >= 20)


def windows(found: Column, width: int = 2) -> Column:
    """Each sentence with `width` neighbours on either side, joined by spaces. found must be a stored column."""

    def window(_: Column, i: Column) -> Column:
        first = F.greatest(i - width, F.lit(0))
        return F.array_join(F.slice(found, first + 1, i + width + 1 - first), " ")

    return F.transform(found, window)


def as_chunk(content: Column, strategy: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(content.alias("content"), F.lit(strategy).alias("strategy"), zero.alias("start"), zero.alias("end"), F.lit(None).cast("string").alias("session"))


def with_sentence_windows(units: DataFrame, width: int = 2) -> DataFrame:
    """units with their chunks as an array."""
    rows = units.withColumn("_s", sentences(F.col("text"))).withColumn("_w", windows(F.col("_s"), width))
    return rows.withColumn("chunks", F.transform("_w", lambda w: as_chunk(w, "sentence-window"))).drop("_s", "_w")


# --- cuts that are sequential inside one text ---------------------------------------------------------


def as_lines(text: str) -> list[str]:
    out = text.split("\n")
    return out[:-1] if out and out[-1] == "" else out


def paragraphs(body: str) -> list[str]:
    return [p for p in (x.strip(SPACES) for x in body.split("\n\n")) if p]


def structure_of(text: str) -> list[tuple]:
    """(content, strategy, start, end, session) of the sections below each heading."""
    out, at, heading, body, start = [], 0, "document", [], 0
    size = len(text.encode())

    def close(end: int) -> None:
        whole = "".join(x + "\n" for x in body).strip(SPACES)
        if whole:
            parts = [whole] if len(whole) // 4 <= STRUCTURE_TOKENS else paragraphs(whole)
            out.extend((f"{heading}\n{p}", "structure-aware", start, end, None) for p in parts)

    for line in as_lines(text):
        if line.strip(SPACES).startswith("#"):
            close(at)
            heading, body, start = line.strip(SPACES), [], at
        else:
            body.append(line)
        at += len(line.encode()) + 1
    close(size)
    return out


def syntax_of(text: str, ext: str) -> list[tuple]:
    """Definitions with the comment lines above; text before the first is left out."""
    rows, marks = as_lines(text), BOUNDARIES.get(ext, ())
    if not marks:
        return []
    data, offsets, at = text.encode(), [], 0
    for line in rows:
        offsets.append(at)
        at += len(line.encode()) + 1
    starts = set()
    for i, line in enumerate(rows):
        if line.lstrip(SPACES).startswith(marks):
            k = i
            while k > max(0, i - COMMENT_LINES) and rows[k - 1].lstrip(SPACES).startswith(COMMENTS):
                k -= 1
            starts.add(offsets[k])
    cuts, out = [*sorted(starts), len(data)], []
    for s, e in zip(cuts, cuts[1:], strict=False):
        body = data[s:e].decode()
        if len(body) // 4 <= SYNTAX_TOKENS:
            out.append((body.strip(SPACES), "syntax-aware", s, e, None))
        else:
            signature, _, rest = body.partition("\n")
            out.extend((f"{signature.strip(SPACES)}\n// ...\n{p}", "syntax-aware", s, e, None) for p in paragraphs(rest))
    return out


def turns_of(text: str, limit: int = TURN_TOKENS) -> list[tuple]:
    """Lines gathered up to `limit` tokens; a "session:" line starts a session."""
    out, current, session = [], "", ""

    def close() -> None:
        if current.strip(SPACES):
            out.append((current.strip(SPACES), "turn-based", 0, 0, session))

    for line in as_lines(text):
        turn = line.strip(SPACES)
        if not turn:
            continue
        if turn.lower().startswith("session:"):
            close()
            current, session = "", turn.split(":")[1].strip(SPACES)
        elif len(current) // 4 + len(turn) // 4 > limit and current.strip(SPACES):
            close()
            current = turn
        else:
            current = f"{current}\n{turn}" if current else turn
    close()
    return out


def cut_rows(units: DataFrame, cut: str, limit: int = TURN_TOKENS) -> DataFrame:
    """units with the chunks that structure_of, syntax_of or turns_of cuts, as an array; an Arrow-batched step without a shuffle."""
    fn = {"structure": lambda t, _: structure_of(t), "syntax": syntax_of, "turn": lambda t, _: turns_of(t, limit)}[cut]

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, exts in batches:
            yield pd.Series([[dict(zip(("content", "strategy", "start", "end", "session"), c, strict=True)) for c in fn(t.replace("\r\n", "\n"), x or "")] for t, x in zip(texts, exts, strict=True)])

    return units.withColumn("chunks", run("text", F.coalesce(extension(F.col("source_path")), F.lit(""))))


def or_sentences(cut: DataFrame) -> DataFrame:
    """Rows without a chunk get sentence windows."""
    rows = with_sentence_windows(cut.withColumnRenamed("chunks", "_cut"))
    return rows.withColumn("chunks", F.when(F.size("_cut") > 0, F.col("_cut")).otherwise(F.col("chunks"))).drop("_cut")


# --- after the cut --------------------------------------------------------------------------------------


def merged(chunks: Column, most: int) -> Column:
    """Left to right, append the next chunk while both together have at most `most` tokens; 0 leaves all as they are."""
    if most <= 0:
        return chunks

    def join(a: Column, b: Column) -> Column:
        strategy = F.when(a["strategy"] == b["strategy"], a["strategy"]).otherwise(F.concat(a["strategy"], F.lit("+"), b["strategy"]))
        return F.struct(F.concat(a["content"], F.lit("\n\n"), b["content"]).alias("content"), strategy.alias("strategy"), a["start"].alias("start"), b["end"].alias("end"), a["session"].alias("session"))

    def add(done: Column, one: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = join(last, one)
        fits = (F.size(done) > 0) & (token_count(both["content"]) <= most)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(chunks, F.array().cast(f"array<{CHUNK}>"), add)


def exploded(units: DataFrame) -> DataFrame:
    """A row per chunk; the text goes."""
    rows = rows_of(units, [c for c in units.columns if c not in ("text", "chunks")], "chunks", "chunk_idx", "c")
    return rows.select(
        *(c for c in rows.columns if c != "c"), F.col("c.content").alias("content"), F.col("c.content").alias("index_text"), F.col("c.strategy").alias("chunk_strategy"),
        F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"), F.col("c.session").alias("session_id"),
    )


def chunk_sentence_window(units: DataFrame, width: int = 2) -> DataFrame:
    return exploded(with_sentence_windows(units, width))


def chunk_structure(units: DataFrame) -> DataFrame:
    return exploded(or_sentences(cut_rows(units, "structure")))


def chunk_syntax(units: DataFrame) -> DataFrame:
    return exploded(or_sentences(cut_rows(units, "syntax")))


def chunk_turns(units: DataFrame, limit: int = TURN_TOKENS) -> DataFrame:
    return exploded(cut_rows(units, "turn", limit))


def chunk_units(units: DataFrame, merge: int = 0) -> DataFrame:
    """Cut each unit in the way its path and text ask for; a unit that yields no chunk but has text is one chunk. Rows without text yield none."""
    rows = units.where("text is not null").withColumn("_way", detect_chunker(F.col("source_path"), F.col("text")))
    way: dict[str, DataFrame] = {w: rows.where(F.col("_way") == w) for w in ("sentence", "structure", "syntax", "turn")}
    parts = [with_sentence_windows(way["sentence"]), or_sentences(cut_rows(way["structure"], "structure")), or_sentences(cut_rows(way["syntax"], "syntax")), cut_rows(way["turn"], "turn")]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    whole = F.struct(trimmed(F.col("text")).alias("content"), F.lit("sentence-window").alias("strategy"), F.lit(0).cast("bigint").alias("start"), F.octet_length("text").cast("bigint").alias("end"), F.lit(None).cast("string").alias("session"))
    rescued = F.when((F.size("chunks") == 0) & not_blank(F.col("text")), F.array(whole)).otherwise(F.col("chunks"))
    return exploded(together.withColumn("chunks", merged(rescued, merge)).drop("_way"))

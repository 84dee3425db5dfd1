"""Summaries, facts, entities, relations and procedure records from chunks and units; reading of model replies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import exploded

#: Levels of one-element lists and of JSON inside strings that replies may be wrapped in.
UNWRAP_DEPTH = 8


def row_id(*parts: Column) -> Column:
    """A repeatable id."""
    return F.sha2(F.concat_ws("\u0001", *(p.cast("string") for p in parts)), 256)


def with_semantics(chunks: DataFrame) -> DataFrame:
    """chunks with facts, entities, triples and summary of index_text. Each is a column of its own, so within a plan nothing is computed twice."""
    rows = chunks.withColumns({"facts": T.facts(F.col("index_text")), "entities": T.entities(F.col("index_text"))})
    return rows.withColumns({"triples": T.triples(F.col("facts"), F.col("entities")), "summary": T.summary(F.col("index_text"), F.col("source_path"), F.col("facts"), F.col("entities"))})


def semantic_tables(chunks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk, entity and relation rows of chunks (context, source_path, chunk_idx, index_text, ...); created_at is as_of, in seconds.

    Each table is a plan of its own and computes only what it needs: names need no facts, and only relations need triples.
    """
    key = [F.col(c) for c in ("context", "source_path", "chunk_idx")]
    rows = with_semantics(chunks).withColumns({"id": row_id(*key), "created_at": as_of})
    base = ["context", "source_path", "id", "created_at"]
    e = exploded(rows, base, "entities", "ord", "name")
    e = e.select("context", row_id(F.col("id"), F.lit("e"), F.col("ord")).alias("id"), "name", F.lit("entity").alias("kind"), F.col("id").alias("source_id"), "source_path", "created_at")
    r = exploded(rows, base, "triples", "ord", "t")
    r = r.select("context", row_id(F.col("id"), F.lit("r"), F.col("ord")).alias("id"), "t.subject", "t.predicate", "t.object", F.col("id").alias("source_id"), "source_path", "created_at")
    return rows.drop("facts", "entities", "triples"), e, r


def document_summary(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """context, source_path, summary (of the first chunk that has one), n_chunks, n_entities per source."""
    shown = F.min_by("summary", F.when(T.not_blank(F.col("summary")), F.col("chunk_idx")))
    per = chunks.groupBy("context", "source_path").agg(F.coalesce(shown, F.concat(F.lit("indexed "), F.first("source_path"))).alias("summary"), F.count("*").alias("n_chunks"))
    counts = entities.groupBy("context", "source_path").agg(F.count("*").alias("n_entities"))
    return per.join(counts, ["context", "source_path"], "left").na.fill(0, ["n_entities"])


def procedures(units: DataFrame, as_of: Column) -> DataFrame:
    """A procedure record per unit (context, source_path, text)."""
    text, source = F.col("text"), F.col("source_path")
    found = units.withColumn("_steps", T.steps(text))
    return found.select(
        "context", row_id(F.col("context"), source, F.lit("procedure")).alias("id"), "source_path", T.task_description(text, source).alias("task_description"),
        F.when(F.size("_steps") > 0, F.col("_steps")).otherwise(F.array(F.lit("review the source content"))).alias("steps"), T.outcome(text).alias("outcome"),
        T.failure_modes(text).alias("failure_modes"), T.task_context(text).alias("task_context"), F.when(text.contains("\n"), 0.78).otherwise(0.62).cast("float").alias("confidence"),
        F.lit(1).alias("run_count"), as_of.alias("created_at"),
    )


def record_procedures(given: DataFrame, as_of: Column, embed: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Records given as context, task, steps, outcome, failure_modes, task_context, confidence (0.85 if null); they have no source."""
    rows = given.select(
        "context", row_id(F.col("context"), F.lit("given"), F.col("task"), F.array_join("steps", "\u0002")).alias("id"), F.lit(None).cast("string").alias("source_path"), F.col("task").alias("task_description"),
        "steps", "outcome", "failure_modes", "task_context", F.coalesce(F.col("confidence"), F.lit(0.85)).cast("float").alias("confidence"), F.lit(1).alias("run_count"), as_of.alias("created_at"),
    )
    return embed(rows, "task_description") if embed else rows


# --- model replies ---------------------------------------------------------------------------------


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a reply, outside of code fences' marks; null without one."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", (text or "").lstrip("﻿").strip())
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def unwrapped(reply: str | None) -> dict | None:
    """The reply's object, out of one-element lists and JSON strings."""
    value: object = reply
    for _ in range(UNWRAP_DEPTH):
        if isinstance(value, dict):
            return value
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                found = first_object(value)
                try:
                    value = json.loads(found) if found else None
                except ValueError:
                    return None
        else:
            return None
    return value if isinstance(value, dict) else None


def recover_json(replies: Column) -> Column:
    """The JSON object of each reply as text, or null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([first_object(x) for x in s], dtype=object)

    return run(replies)


def strings_of(value: object) -> list[str]:
    return [t for t in (x.strip() for x in value if isinstance(x, str)) if t] if isinstance(value, list) else []


def text_of(value: object) -> str:
    return value.strip() if isinstance(value, str) else ""


SEMANTIC = "summary string, facts array<string>, entities array<string>, triples array<struct<subject:string,predicate:string,object:string>>, error string"
PROCEDURE = "task_description string, steps array<string>, outcome string, failure_modes array<string>, task_context struct<language:string,framework:string,environment:string>, confidence double, error string"


def semantic_reply(reply: str | None) -> dict:
    empty = {"summary": None, "facts": [], "entities": [], "triples": []}
    found = unwrapped(reply)
    if found is None:
        return empty | {"error": "no JSON object"}
    if not (summary := text_of(found.get("summary"))):
        return empty | {"error": "summary is empty"}
    parts = [{k: text_of(t.get(k)) for k in ("subject", "predicate", "object")} for t in found.get("triples") or [] if isinstance(t, dict)]
    return {
        "summary": summary, "facts": strings_of(found.get("facts")), "entities": sorted(set(strings_of(found.get("entities"))), key=str.encode),
        "triples": [t | {"predicate": t["predicate"].lower()} for t in parts if all(t.values())], "error": None,
    }


def procedural_reply(reply: str | None) -> dict:
    empty = {"task_description": None, "steps": [], "outcome": None, "failure_modes": [], "task_context": None, "confidence": None}
    found = unwrapped(reply)
    if found is None:
        return empty | {"error": "no JSON object"}
    if not (task := text_of(found.get("task_description"))):
        return empty | {"error": "task description is empty"}
    outcome = text_of(found.get("outcome")).lower()
    if outcome not in ("success", "failure", "partial"):
        return empty | {"error": "outcome is unknown"}
    context = found.get("context") if isinstance(found.get("context"), dict) else {}
    sure = found.get("confidence")
    return {
        "task_description": task, "steps": strings_of(found.get("steps")), "outcome": outcome, "failure_modes": strings_of(found.get("failure_modes")),
        "task_context": {k: text_of(context.get(k)) or None for k in T.CONTEXT_NEEDLES}, "confidence": min(1.0, max(0.0, float(sure))) if isinstance(sure, (int, float)) else 0.7, "error": None,
    }


def parsed(replies: Column, parse: Callable[[str | None], dict], schema: str) -> Column:
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([parse(x) for x in s])

    return run(replies)


def parse_semantic(replies: Column) -> Column:
    """Struct of summary, facts, entities, triples, error; only error is set where a reply can't be used."""
    return parsed(replies, semantic_reply, SEMANTIC)


def parse_procedural(replies: Column) -> Column:
    return parsed(replies, procedural_reply, PROCEDURE)


def extraction_prompts(rows: DataFrame, text_col: str = "index_text") -> DataFrame:
    """rows with a prompt that asks for the JSON which parse_semantic reads."""
    ask = "Read the text and answer with one JSON object that has summary (string), facts (strings), entities (strings) and triples (subject, predicate, object).\n\nSource: "
    return rows.withColumn("prompt", F.concat(F.lit(ask), "source_path", F.lit("\n\n"), F.col(text_col)))


def with_fallback(rules: DataFrame, replies: DataFrame, key: str, names: list[str]) -> DataFrame:
    """rules with the columns `names` taken from replies (key, the same columns, error) where a reply came through without an error."""
    good = replies.where("error is null").select(key, *(F.col(n).alias(f"_{n}") for n in names), F.lit(True).alias("_good"))
    joined = rules.join(good, key, "left")
    return joined.withColumns({n: F.when(F.col("_good"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}).drop("_good", *(f"_{n}" for n in names))

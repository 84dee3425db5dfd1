"""Markdown notes: ordered writes, topics, the registry, promotion and managed sections. notes: context, path, content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import canonical_note_path, topic_slug, valid_note_path
from ..functions.text import content_hash, not_blank, trimmed

NOTE = ["context", "path"]
RESERVED = ("notes/index.md", "notes/summary.md")
#: The managed section's heading, now and before.
SECTION, OLD_SECTION = "## Auto-updated notes", "## Promoted knowledge"


def apply_note_writes(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """notes after writes (context, path, seq, mode, content) in order of seq: replace sets a note, append adds to it, on a new line. Paths are made canonical; invalid ones are left out. Adds hash."""
    rows = writes.withColumn("path", canonical_note_path(F.col("path"))).where(valid_note_path(F.col("path")))
    last = F.max(F.when(F.col("mode") == "replace", F.col("seq"))).over(W.partitionBy(*NOTE))
    live = rows.withColumn("_last", last).where("_last is null or seq >= _last")
    gathered = live.groupBy(*NOTE).agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("_w"), F.max("_last").isNotNull().alias("_reset"))

    def add(text: Column, w: Column) -> Column:
        gap = F.when((text != "") & ~text.endswith("\n"), "\n").otherwise("")
        return F.concat(text, gap, w["content"])

    both = notes.select(*NOTE, "content").join(gathered, NOTE, "full_outer")
    start = F.when(F.coalesce("_reset", F.lit(False)), F.lit("")).otherwise(F.coalesce("content", F.lit("")))
    text = F.when(F.col("_w").isNull(), F.col("content")).otherwise(F.aggregate("_w", start, add))
    return both.select(*NOTE, text.alias("content")).withColumn("hash", content_hash(F.col("content")))


def remembered(entries: DataFrame) -> DataFrame:
    """Note writes of entries (context, seq, topic, text, day): a dated entry appended to the topic's note. Blank texts and topics without a letter or digit get an error instead."""
    slug, ok = topic_slug(F.col("topic")), not_blank(F.col("text"))
    error = F.when(~ok, "text is empty").when(slug.isNull(), "topic has no letter or digit")
    entry = F.concat(F.lit("## "), F.col("day").cast("string"), F.lit("\n\n"), trimmed(F.col("text")), F.lit("\n"))
    return entries.select("context", "seq", F.concat(F.lit("notes/topics/"), slug, F.lit(".md")).alias("path"), F.lit("append").alias("mode"), entry.alias("content"), error.alias("error"))


def refresh_registry(notes: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """context, path, hash, updated_at of every .md note; the time stays where the hash is the same."""
    now = notes.where("path like '%.md'").select(*NOTE, content_hash(F.col("content")).alias("hash"))
    old = registry.select(*NOTE, F.col("hash").alias("_hash"), F.col("updated_at").alias("_at"))
    return now.join(old, NOTE, "left").select(*NOTE, "hash", F.when(F.col("_hash") == F.col("hash"), F.col("_at")).otherwise(as_of).alias("updated_at"))


def notes_snapshot(notes: DataFrame) -> DataFrame:
    """Per context: the index's text, the summary's text, and the sorted other paths."""
    is_ = lambda p: F.col("path") == p
    return notes.groupBy("context").agg(
        F.max(F.when(is_(RESERVED[0]), F.col("content"))).alias("index_text"), F.max(F.when(is_(RESERVED[1]), F.col("content"))).alias("summary_text"),
        F.array_sort(F.collect_list(F.when(~F.col("path").isin(*RESERVED), F.col("path")))).alias("topics"),
    )


def stable_topics(registry: DataFrame, notes: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Notes other than index and summary whose content is as registered, and that for `days` days."""
    rows = registry.where(~F.col("path").isin(*RESERVED)).join(notes.select(*NOTE, "content"), NOTE)
    return rows.where((F.col("updated_at") <= as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (content_hash(F.col("content")) == F.col("hash"))).select(*NOTE, "content", "updated_at")


def promotion_gate(topics: DataFrame, contexts: DataFrame, least: int = 3) -> DataFrame:
    """Per context: gate (NoStableTopics, BelowMinTopics, Promote), n_topics, and the sorted paths that are promoted."""
    per = topics.groupBy("context").agg(F.count("*").alias("n_topics"), F.array_sort(F.collect_list("path")).alias("_p"))
    rows = contexts.select("context").distinct().join(per, "context", "left").na.fill(0, ["n_topics"])
    gate = F.when(F.col("n_topics") == 0, "NoStableTopics").when(F.col("n_topics") < least, "BelowMinTopics").otherwise("Promote")
    return rows.select("context", gate.alias("gate"), "n_topics", F.when(gate == "Promote", F.col("_p")).otherwise(F.array().cast("array<string>")).alias("promoted"))


def distill_prompts(topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """context, prompt: the managed section of the summary (summaries: context, content) and the topics in order of path, with dates."""
    block = F.concat(F.lit("### "), "path", F.lit(" ("), F.to_date("updated_at").cast("string"), F.lit(")\n"), trimmed(F.col("content")))
    per = topics.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("path", block.alias("b")))).alias("t"))
    old = summaries.select("context", extract_section(F.col("content")).alias("_old"))
    head = F.concat(F.lit("Merge the notes into the section. Answer with JSON: {\"distilled_markdown\": \"...\"}\n\nSection:\n"), F.coalesce("_old", F.lit("")), F.lit("\n\nNotes:\n"))
    return per.join(old, "context", "left").select("context", F.concat(head, F.array_join(F.transform("t", lambda x: x["b"]), "\n\n")).alias("prompt"))


# --- the managed section --------------------------------------------------------------------------------


HEADING = f"(?:{re.escape(SECTION)}|{re.escape(OLD_SECTION)})\\r*$"
MANAGED, NEXT = re.compile(f"^{HEADING}", re.M), re.compile(f"^(?!{HEADING})## ", re.M)


def managed_range(text: str) -> tuple[int, int] | None:
    """Start and end of the managed section: from its heading, a whole line, to the next other second-level heading."""
    head = MANAGED.search(text)
    if head is None:
        return None
    after = NEXT.search(text, head.end())
    return head.start(), after.start() if after else len(text)


def section_of(text: str | None) -> str:
    """The lines below the heading, as they are; empty without a section."""
    found = managed_range(text or "")
    if found is None:
        return ""
    body = text[found[0] : found[1]].partition("\n")[2].removesuffix("\n")
    return re.sub(r"\r$", "", body, flags=re.M)


def section_set(text: str | None, body: str | None) -> str:
    """The section stands in the old one's place, or behind the text and a blank line; of the body only line breaks at its end go."""
    text, section = text or "", f"{SECTION}\n\n{(body or '').rstrip(chr(10))}\n"
    if (found := managed_range(text)) is not None:
        return text[: found[0]] + section + text[found[1] :]
    gap = "" if not text or text.endswith("\n\n") else "\n" if text.endswith("\n") else "\n\n"
    return text + gap + section


def extract_section(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(section_of)

    return run(text)


def replace_section(text: Column, body: Column) -> Column:
    """The text with the managed section's body set, in place or appended. Setting twice equals setting once for bodies without second-level headings."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([section_set(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(text, body)


def parse_distillation(replies: Column) -> Column:
    """Struct of distilled_markdown and error: from the first { to the last } of a reply."""
    found = F.get_json_object(F.regexp_extract(replies, r"(?s)\{.*\}", 0), "$.distilled_markdown")
    good = found.isNotNull() & not_blank(found)
    return F.struct(F.when(good, found).alias("distilled_markdown"), F.when(~good | replies.isNull(), "no distilled_markdown").alias("error"))

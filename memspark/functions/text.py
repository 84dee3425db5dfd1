"""Column expressions on text: trimming, lines, tokens, facts, entities, triples, procedure parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a success, of a failure, and of a piece that tells how something failed.
SUCCEEDED, FAILED, FAILURE_MODES = ["success", "passed", "completed"], ["fail", "error", "rollback"], ["fail", "error", "timeout"]
#: Words of a line that tells an outcome, beginnings of a line that asks for something, files that hold procedures.
OUTCOMES = ["success", "failure", "failed", "partial", "outcome", "result"]
IMPERATIVES = ["run", "open", "install", "verify", "add", "remove", "update", "create"]
PROCEDURE_FILES = ["AGENTS.md", "CLAUDE.md", "CONTEXT.md"]
#: Unicode white space, which trimming removes.
SPACES = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A table for bytes.translate: ASCII letters lower-cased, digits and _ stay; all others separate words.
WORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or b == 95) else 32 for b in range(256))
#: Verbs of relations, keywords that name code symbols.
VERBS = "uses handles stores writes reads supports calls wraps creates returns contains runs".split()
SYMBOL_WORDS = "fn struct enum class trait impl mod function interface".split()
#: Needles of a task's context, in order of preference.
CONTEXT_NEEDLES = {
    "language": ["rust", "python", "typescript", "javascript", "go"],
    "framework": ["axum", "react", "next", "tokio", "django"],
    "environment": ["docker", "kubernetes", "staging", "production"],
}

BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
NAME = r"[A-Za-z_][A-Za-z0-9_:-]+"
STRINGS = "array<string>"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def left_trimmed(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def not_blank(c: Column) -> Column:
    return trimmed(c) != ""


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line; no text has no lines."""
    return F.when(text == "", no_strings()).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def pieces(text: Column) -> Column:
    """Trimmed parts between full stops and line ends."""
    return F.transform(F.split(text, r"[.\n]"), trimmed)


def has_any(text: Column, needles: list[str]) -> Column:
    return text.rlike("|".join(needles))


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def compact(text: Column, n: int) -> Column:
    """At most n characters: the trimmed text, or the first n - 1 trimmed and an ellipsis."""
    return F.when(F.length(text) <= n, trimmed(text)).otherwise(F.concat(trimmed(F.substring(text, 1, n - 1)), F.lit("…")))


def facts(text: Column) -> Column:
    """Up to 16 pieces of at least 20 bytes; else the first 220 characters of the trimmed text."""
    found = F.slice(F.filter(pieces(text), lambda x: F.octet_length(x) >= 20), 1, 16)
    lead = F.when(not_blank(text), F.array(F.substring(trimmed(text), 1, 220))).otherwise(no_strings())
    return F.when(F.size(found) > 0, found).otherwise(lead)


def entities(text: Column) -> Column:
    """Up to 24 distinct names in byte order: capitalised words of 3 or more, and names after code keywords."""
    titles = F.regexp_extract_all(text, F.lit(f"(?=[A-Z]){BEFORE}[A-Z][A-Za-z0-9_]{{2,}}+{AFTER}"), 0)
    symbols = F.regexp_extract_all(text, F.lit(rf"(?=[{''.join(sorted({w[0] for w in SYMBOL_WORDS}))}]){BEFORE}(?:{'|'.join(SYMBOL_WORDS)})\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return F.slice(F.sort_array(F.array_union(titles, symbols)), 1, 24)


def triples(facts_: Column, entities_: Column) -> Column:
    """subject, predicate, object of "name verb name" in each fact; without any, the first two entities are a mention."""
    # Names hold no white space, so possessive repeats match the same and a match splits to its three parts: one pass a fact.
    pattern = rf"(?=[A-Za-z_]){BEFORE}{NAME}+\s++(?i:{'|'.join(VERBS)})\s++{NAME}"
    per_fact = F.transform(facts_, lambda f: F.transform(F.regexp_extract_all(f, F.lit(pattern), 0), lambda m: F.split(m, r"\s+")))
    found = F.transform(F.flatten(per_fact), lambda t: F.struct(F.get(t, 0).alias("subject"), F.lower(F.get(t, 1)).alias("predicate"), F.get(t, 2).alias("object")))
    mention = F.array(F.struct(F.get(entities_, 0).alias("subject"), F.lit("mentions").alias("predicate"), F.get(entities_, 1).alias("object")))
    return F.when((F.size(found) == 0) & (F.size(entities_) >= 2), mention).otherwise(found)


def summary(text: Column, source: Column, facts_: Column, entities_: Column) -> Column:
    lead = F.coalesce(F.get(facts_, 0), F.substring(trimmed(text), 1, 120))
    named = F.concat(compact(lead, 140), F.lit(" entities: "), compact(F.array_join(entities_, ", "), 60))
    return F.when(F.size(entities_) == 0, F.concat(compact(lead, 180), F.lit(" ("), source, F.lit(")"))).otherwise(named)


def steps(text: Column) -> Column:
    """List items (bulleted or numbered); without any, up to 6 pieces of more than 15 bytes."""
    start = F.transform(lines(text), left_trimmed)

    def item(line: Column) -> Column:
        rest = trimmed(F.regexp_replace(F.regexp_replace(line, "^[0-9]+", ""), r"^\.+", ""))
        return F.when(line.startswith("- ") | line.startswith("* "), trimmed(F.substr(line, F.lit(3)))).when(line.rlike("^[0-9]") & (rest != ""), rest)

    items = F.filter(F.transform(start, item), lambda x: x.isNotNull())
    plain = F.slice(F.filter(pieces(text), lambda x: F.octet_length(x) > 15), 1, 6)
    return F.when(F.size(items) > 0, items).otherwise(plain)


def outcome(text: Column) -> Column:
    low = F.lower(text)
    return F.when(has_any(low, SUCCEEDED), "success").when(has_any(low, FAILED), "failure").otherwise("partial")


def failure_modes(text: Column) -> Column:
    return F.slice(F.filter(pieces(text), lambda x: has_any(F.lower(x), FAILURE_MODES)), 1, 5)


def task_description(text: Column, source: Column) -> Column:
    first = F.get(F.filter(F.transform(lines(text), trimmed), lambda x: F.octet_length(x) > 10), 0)
    return F.coalesce(first, F.concat(F.lit("procedure from "), source))


def task_context(text: Column) -> Column:
    """language, framework, environment: the first needle that the text contains, or null."""
    low = F.lower(text)

    def first(needles: list[str]) -> Column:
        return F.coalesce(*(F.when(low.contains(n), F.lit(n)) for n in needles))

    return F.struct(*(first(n).alias(k) for k, n in CONTEXT_NEEDLES.items()))


def content_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


# --- classification ---------------------------------------------------------------------------------


def classify_content(path: Column, text: Column) -> Column:
    """procedural or semantic: by file name, else by list items with outcomes or imperatives."""
    rows = F.transform(lines(text), left_trimmed)
    bullets = F.size(F.filter(rows, lambda x: x.startswith("- ") | x.startswith("* ") | (x.rlike("^[0-9]") & x.contains("."))))
    outcomes = F.size(F.filter(rows, lambda x: has_any(F.lower(x), OUTCOMES)))
    imperatives = F.size(F.filter(rows, lambda x: F.lower(x).rlike(f"^({'|'.join(IMPERATIVES)})")))
    named = F.substring_index(path, "/", -1).isin(PROCEDURE_FILES)
    return F.when(named | ((bullets >= 2) & ((outcomes > 0) | (imperatives >= 2))), "procedural").otherwise("semantic")


def extension(path: Column) -> Column:
    """What stands behind the last dot of the file name, unless that dot is its first character; else null."""
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


# --- search ------------------------------------------------------------------------------------------


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters, digits and _, of 2 or more, lower-cased; found first, since lower-casing can make ASCII letters."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]{2,}+"), 0), F.lower)


def lexical_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the geometric mean of their numbers; 0 if either has none."""
    p, q = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(F.size(F.array_intersect(p, q)) / F.sqrt(F.size(p) * F.size(q)))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths, or a zero norm."""
    double: Callable[[Column], Column] = lambda v: v.cast("array<double>")
    total: Callable[[Column], Column] = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(double(a), lambda x: x * x))) * F.sqrt(total(F.transform(double(b), lambda x: x * x)))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot / norms)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def hybrid_score(dense: Column, lexical: Column, alpha: float = 0.7) -> Column:
    a = min(1.0, max(0.0, alpha))
    return a * clamp((dense + 1) / 2) + (1 - a) * clamp(lexical)

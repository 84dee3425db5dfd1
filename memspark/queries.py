"""Registered queries: each applies an operator to a whole derived table. ORACLES has the same in DuckDB's SQL, written anew."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import AS_OF, derived, duck
from .functions import paths as P
from .functions import text as T
from .functions.paths import index_path
from .functions.rows import exploded
from .functions.staging import stage_folder, staged
from .operators import audit, chunk, decode, embed, extract, notes, retrieve, sync
from .plans.ingest import index_units, rebuild
from .plans.repair import repair_contexts
from .sources.corpus import from_rows, list_corpus
from .sources.index import blobs_of, read_blobs, read_index, write_index
from .sources.manifest import parse_manifests, write_manifest
from .sources.streamed import streamed_units
from .streaming.ingest import append_batch, latest, stream_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# --- DuckDB fragments --------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_trim(x: str) -> str:
    return f"trim({x}, {q(T.SPACES)})"


def d_ltrim(x: str) -> str:
    return f"ltrim({x}, {q(T.SPACES)})"


def d_lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace({x}, '\r?\n\z', ''), '\r?\n') END)"


def d_pieces(x: str) -> str:
    return rf"list_transform(regexp_split_to_array({x}, '[.\n]'), lambda z: {d_trim('z')})"


def d_tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[^A-Za-z0-9_]+'), lambda z: lower(z)), lambda z: length(z) >= 2)"


def d_facts(x: str) -> str:
    long = f"list_filter({d_pieces(x)}, lambda z: strlen(z) >= 20)[1:16]"
    return f"(CASE WHEN len({long}) > 0 THEN {long} WHEN {d_trim(x)} <> '' THEN [substr({d_trim(x)}, 1, 220)] ELSE []::VARCHAR[] END)"


def d_entities(x: str) -> str:
    titles = rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]+'), lambda z: regexp_full_match(z, '[A-Z][A-Za-z0-9_]{{2,}}'))"
    symbols = rf"regexp_extract_all({x}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(T.SYMBOL_WORDS)})\s+([A-Za-z_][A-Za-z0-9_]*)', 1)"
    return f"list_sort(list_distinct(list_concat({titles}, {symbols})))[1:24]"


def d_compact(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {d_trim(x)} ELSE {d_trim(f'substr({x}, 1, {n - 1})')} || '…' END)"


def d_summary(x: str, source: str, facts: str, entities: str) -> str:
    lead = f"coalesce({facts}[1], substr({d_trim(x)}, 1, 120))"
    return f"(CASE WHEN len({entities}) = 0 THEN {d_compact(lead, 180)} || ' (' || {source} || ')' ELSE {d_compact(lead, 140)} || ' entities: ' || {d_compact(f'array_to_string({entities}, chr(44) || chr(32))', 60)} END)"


def d_sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\n]*[.!?\n]|[^.!?\n]+$'), lambda z: {d_trim('z')}), lambda z: strlen(z) >= 20)"


def d_ext(x: str) -> str:
    return rf"nullif(regexp_extract({d_name(x)}, '^.+\.([^.]*)$', 1), '')"


def d_name(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def d_cosine(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 0)"


def d_overlap(a: str, b: str) -> str:
    p, r = f"list_distinct({d_tokens(a)})", f"list_distinct({d_tokens(b)})"
    return f"(CASE WHEN len({p}) = 0 OR len({r}) = 0 THEN 0.0 ELSE len(list_intersect({p}, {r})) / sqrt(len({p}) * len({r})) END)"


def d_clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def d_list(values: list[str]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def d_any(x: str, needles: list[str]) -> str:
    return f"regexp_matches(lower({x}), {q('|'.join(needles))})"


WINDOWS = f"""SELECT context, source_path, i AS chunk_idx, array_to_string(s[greatest(i - 1, 1):i + 3], ' ') AS content
FROM (SELECT context, source_path, s, unnest(range(len(s))) AS i FROM (SELECT context, source_path, {d_sentences('text')} AS s FROM {duck('items')}))"""


# --- paths and decoding ------------------------------------------------------------------------------------

FILE_PATHS = duck("files")
D_CLASS = f"""CASE WHEN list_has_any(string_split(rel, '/'), {str(P.INFRASTRUCTURE)}) THEN 'infrastructure' WHEN coalesce(lower({d_ext('rel')}) IN {d_list(P.DENIED)}, false) THEN 'denied'
WHEN {d_name('rel')} IN {d_list(P.JUNK)} THEN 'junk' ELSE 'keep' END"""


@query("d1_classify_path", f"SELECT rel, {D_CLASS} AS kind FROM {FILE_PATHS}")
def d1(spark, sf_dir):
    return derived(spark, sf_dir, "files").select("rel", P.classify_path(F.col("rel")).alias("kind"))


@query("d2_route_decoder", f"""SELECT rel, CASE WHEN e IN ('html', 'htm', 'xhtml') OR regexp_matches(lower(head), '^\\s*(<!doctype html|<html|<\\?xml)') THEN CASE WHEN size > {P.FORMAT_LIMIT} THEN 'too_large' ELSE 'html' END
WHEN size > {P.STREAM_FROM} THEN 'stream' ELSE 'plain' END AS route FROM (SELECT url AS rel, coalesce(lower({d_ext('url')}), '') AS e, substr(html, page_id % 3 + 1, 100) AS head, length(html) * 2000 AS size FROM pages)""")
def d2(spark, sf_dir):
    p = derived(spark, sf_dir, "pages")
    head = F.substr(F.col("html"), (F.col("page_id") % 3 + 1).cast("int"), F.lit(100))
    return p.select(F.col("url").alias("rel"), P.route_decoder(F.col("url"), head, F.length("html") * 2000).alias("route"))


@query("d3_decode_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def d3(spark, sf_dir):
    d = derived(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.col("text").cast("binary"))
    return d.select("doc_id", F.md5(decode.decode_text(raw)).alias("digest"))


LATIN, CYRILLIC = "etaoinshrdlucmfwypvbgkjqxz", "оеаинтсрвлкмдпуяыьгзбчйхжш"
#: All documents as bytes of old code pages: in Cyrillic letters, or as they are.
PAGES = (
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE translate(regexp_replace(text, '[^\\x01-\\x7F]', '', 'g'), '{LATIN}{LATIN.upper()}', '{CYRILLIC}{CYRILLIC.upper()}') END AS text, "
    "CASE WHEN doc_id % 2 = 0 THEN 'cp1252' ELSE 'cp1251' END AS page FROM documents"
)


@query("d3_old_code_pages", f"SELECT doc_id, page, md5(text) AS digest FROM ({PAGES})")
def d3_pages(spark, sf_dir):
    @F.udf("binary", useArrow=True)
    def encoded(text, page):
        return text.encode(page)

    plain = F.translate(F.regexp_replace("text", "[^\\x01-\\x7F]", ""), LATIN + LATIN.upper(), CYRILLIC + CYRILLIC.upper())
    d = derived(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(plain).alias("text"), F.when(F.col("doc_id") % 2 == 0, "cp1252").otherwise("cp1251").alias("page"))
    return d.select("doc_id", "page", F.md5(decode.decode_text(encoded("text", "page"))).alias("digest"))


@query("d4_html_to_text")
def d4(spark, sf_dir):
    return derived(spark, sf_dir, "pages").select("page_id", decode.html_to_text(F.col("html")).alias("text"))


@query("d5_notebook_to_text", """SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN text ELSE '```python' || chr(10) || text || chr(10) || '```' END, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def d5(spark, sf_dir):
    kind = F.when(F.col("turn") % 2 == 0, "markdown").otherwise("code")
    cells = F.array_sort(F.collect_list(F.struct("turn", kind.alias("cell_type"), F.col("text").alias("source"))))
    books = derived(spark, sf_dir, "conversations").groupBy("conv_id").agg(cells.alias("c"))
    doc = F.to_json(F.struct(F.struct(F.struct(F.lit("python").alias("language")).alias("kernelspec")).alias("metadata"), F.col("c").alias("cells")))
    return books.select("conv_id", decode.notebook_to_text(doc).alias("text"))


@query("d6_table_to_markdown", """SELECT n_regionkey, '# Sheet: ' || n_regionkey || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def d6(spark, sf_dir):
    n = derived(spark, sf_dir, "nation")
    body = n.select("n_regionkey", F.col("n_nationkey").cast("bigint").alias("o"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("cells"))
    heads = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(-1).cast("bigint").alias("o"), F.array(F.lit("key"), F.lit("name")).alias("cells"))
    return decode.table_to_markdown(heads.unionByName(body), ["n_regionkey"], "o")


def d_units(table: str, key: str, size: int) -> str:
    """key, n (from 1), n_bytes and digest of the units of a table's texts (key, text); unit after unit, as each begins where the last one ended."""
    line, before = f"list_filter(ends, lambda x: x >= e + {size})[1]", f"list_filter(ends, lambda x: x > e AND x <= e + {size})[-1]"
    whole = f"list_filter([e + {size}, e + {size} - 1, e + {size} - 2, e + {size} - 3], lambda x: substr(h, 2 * x + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1]"
    return f"""WITH RECURSIVE src AS MATERIALIZED (SELECT {key}, hex(encode(text)) AS h, strlen(text) AS total, string_split(text, chr(10)) AS l FROM {table}),
lines AS (SELECT {key}, sum(strlen(line) + 1) OVER (PARTITION BY {key} ORDER BY i) AS e FROM (SELECT {key}, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM src)),
places AS MATERIALIZED (SELECT s.*, coalesce((SELECT list(l.e::BIGINT ORDER BY l.e) FROM lines l WHERE l.{key} = s.{key} AND l.e <= s.total), []) AS ends FROM src s),
u AS (SELECT {key}, 0 AS n, 0::BIGINT AS b, 0::BIGINT AS e FROM places UNION ALL
SELECT {key}, n + 1, e, CASE WHEN e + {size} >= total THEN total WHEN {before} IS NULL THEN {whole} WHEN {line} <= e + {2 * size} THEN {line} ELSE {before} END FROM u JOIN places USING ({key}) WHERE e < total)
SELECT {key}, n, e - b AS n_bytes, md5(decode(unhex(substr(h, 2 * b + 1, 2 * (e - b))))) AS digest FROM u JOIN places USING ({key}) WHERE n > 0"""


@query("d7_split_plain_text", f"SELECT doc_id, printf('chunk-%04d.txt', n) AS virtual_path, n_bytes, digest FROM ({d_units('documents', 'doc_id', 1000)})")
def d7(spark, sf_dir):
    parts = decode.split_plain_text(derived(spark, sf_dir, "items").select("doc_id", "text"), 1000)
    return parts.select("doc_id", "virtual_path", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("digest"))


BOOKS = "SELECT doc_id // 500 AS book, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY book"


@query("d7_streamed_units", f"SELECT 'book=' || book AS book, printf('chunk-%04d.txt', n) AS virtual_path, n_bytes, digest FROM ({d_units(f'({BOOKS})', 'book', 50000)})")
def d7_streamed(spark, sf_dir):
    """All documents as large files (500 documents each, so files grow in number), written and read again by byte ranges in many splits."""
    folder = stage_folder(spark, "books")
    rows = derived(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 500").alias("book"), "text").repartition("book").sortWithinPartitions("book", "doc_id")
    rows.select("book", "text").write.option("lineSep", "\n").partitionBy("book").text(folder)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 1 << 18)
    try:
        units = staged(streamed_units(spark, folder, above=0, size=50_000, span=200_000))
    finally:
        spark.conf.set(key, before)
    return units.select(F.substring_index("source_rel", "/", 1).alias("book"), "virtual_path", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("digest"))


UNITS = "SELECT 'c' || (conv_id % 3) AS context, 'r' AS root, 'conv' || conv_id AS source_rel, turn, CASE WHEN turn % 4 = 2 THEN ' ' ELSE text END AS text, role FROM {conversations}"


@query("d8_number_units", f"""SELECT source_rel, 'sheet-' || lpad(n::VARCHAR, length(k::VARCHAR)::INT, '0') || '-' || role || '.md' AS virtual_path, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source_rel ORDER BY turn) AS n, count(*) OVER (PARTITION BY source_rel) AS k FROM ({UNITS.replace('{conversations}', 'conversations')})) WHERE trim(text) <> ''""")
def d8(spark, sf_dir):
    units = spark.sql(UNITS, conversations=derived(spark, sf_dir, "conversations"))
    return decode.number_units(units, "sheet", "md", "turn", "role").select("source_rel", "virtual_path", F.md5("text").alias("digest"))


@query("d9_unit_paths", """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'f' || conv_id ELSE 'f' || conv_id || '/' || role || turn END AS unit_rel, CASE WHEN turn <> 0 THEN 'f' || conv_id END AS source_path FROM conversations""")
def d9(spark, sf_dir):
    c = derived(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("f"), "conv_id").alias("source_rel"), F.when(F.col("turn") == 0, "").otherwise(F.concat("role", "turn")).alias("virtual_path"))
    return decode.unit_paths(c).select("conv_id", "turn", "unit_rel", "source_path")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "corpus").select("context", "root", "rel", "size", "mtime", "hash", F.col("text").cast("binary").alias("content"))


@query("d10_decode_corpus")
def d10(spark, sf_dir):
    units, _ = decode.decode_corpus(corpus_files(spark, sf_dir))
    return units.select("context", "root", "unit_rel", F.length("text").alias("n_chars"))


# --- classify and chunk -----------------------------------------------------------------------------------


def d_layer(table: str, keys: str) -> str:
    """keys and layer of a table's texts (no special file names)."""
    return rf"""SELECT {keys}, CASE WHEN len(list_filter(l, lambda z: starts_with(z, '- ') OR starts_with(z, '* ') OR (regexp_matches(z, '^[0-9]') AND contains(z, '.')))) >= 2
AND (len(list_filter(l, lambda z: {d_any('z', 'success failure failed partial outcome result'.split())})) > 0 OR len(list_filter(l, lambda z: regexp_matches(lower(z), '^(run|open|install|verify|add|remove|update|create)'))) >= 2) THEN 'procedural' ELSE 'semantic' END AS layer
FROM (SELECT *, list_transform({d_lines('text')}, lambda z: {d_ltrim('z')}) AS l FROM {duck(table)})"""


@query("c1_classify_content", d_layer("runbooks", "doc_id"))
def c1(spark, sf_dir):
    return derived(spark, sf_dir, "runbooks").select("doc_id", T.classify_content(F.col("source_path"), F.col("text")).alias("layer"))


@query("c2_detect_chunker", f"""SELECT doc_id, CASE WHEN e IN {d_list(P.MARKUP)} AND len(list_filter({d_lines('text')}, lambda z: starts_with(z, '#'))) > 0 THEN 'structure' WHEN e IN {d_list(P.CODE)} THEN 'syntax' ELSE 'sentence' END AS way
FROM (SELECT *, coalesce({d_ext('rel')}, '') AS e FROM (SELECT doc_id, rel, CASE WHEN doc_id % 8 = 0 THEN '# x' || chr(10) || text ELSE text END AS text FROM {duck('corpus')}))""")
def c2(spark, sf_dir):
    c = derived(spark, sf_dir, "corpus").withColumn("text", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("# x\n"), "text")).otherwise(F.col("text")))
    return c.select("doc_id", P.detect_chunker(F.col("rel"), F.col("text")).alias("way"))


@query("c3_token_count", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def c3(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("c4_chunk_sentence_window", f"SELECT context, source_path, chunk_idx, md5(content) AS digest FROM ({WINDOWS})")
def c4(spark, sf_dir):
    return chunk.chunk_sentence_window(derived(spark, sf_dir, "items")).select("context", "source_path", "chunk_idx", F.md5("content").alias("digest"))


SECTIONS = f"""WITH l AS (SELECT source_path, text, unnest({d_lines('text')}) AS line, unnest(range(1, len({d_lines('text')}) + 1)) AS n FROM {duck('md_items')}),
o AS (SELECT *, starts_with({d_trim('line')}, '#') AS head, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY source_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY source_path ORDER BY n) AS sec FROM o),
g AS (SELECT source_path, sec, max(CASE WHEN head THEN {d_trim('line')} END) AS heading, {d_trim("coalesce(string_agg(CASE WHEN NOT head THEN line || chr(10) END, '' ORDER BY n), '')")} AS body, min(place) AS char_start, any_value(strlen(text)) AS size FROM s GROUP BY source_path, sec),
e AS (SELECT *, coalesce(lead(char_start) OVER (PARTITION BY source_path ORDER BY sec), size) AS char_end FROM g),
p AS (SELECT source_path, sec, coalesce(heading, 'document') AS heading, char_start, char_end, unnest(CASE WHEN length(body) // 4 <= 400 THEN [body] ELSE list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda z: {d_trim('z')}), lambda z: z <> '') END) AS part,
 unnest(range(len(CASE WHEN length(body) // 4 <= 400 THEN [body] ELSE list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda z: {d_trim('z')}), lambda z: z <> '') END))) AS k FROM e WHERE body <> '')
SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY sec, k) - 1 AS chunk_idx, md5(heading || chr(10) || part) AS digest, char_start, char_end FROM p"""


@query("c5_chunk_structure", SECTIONS)
def c5(spark, sf_dir):
    return chunk.chunk_structure(derived(spark, sf_dir, "md_items")).select("source_path", "chunk_idx", F.md5("content").alias("digest"), "char_start", "char_end")


@query("c6_chunk_syntax")
def c6(spark, sf_dir):
    return chunk.chunk_syntax(derived(spark, sf_dir, "code_items")).select("source_path", "chunk_idx", "chunk_strategy", "char_start", "char_end", F.md5("content").alias("digest"))


def turn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir, "dialogues").withColumn("line", F.regexp_replace("line", r"\s+", " "))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return d.groupBy("conv_id").agg(lines.alias("l")).select("conv_id", F.concat(F.lit("conv/"), "conv_id", F.lit(".jsonl")).alias("source_path"), F.concat(F.lit("session: s"), "conv_id", F.lit("\n"), "l").alias("text"))


TURNS = rf"""WITH t AS (SELECT conv_id, turn, {d_trim("regexp_replace(line, '[ \t\n\f\r\x0b]+', ' ', 'g')")} AS line FROM {duck('dialogues')}),
l AS (SELECT conv_id, list(line ORDER BY turn) AS ls FROM t GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_transform(ls, lambda z: [z]), lambda a, b: CASE WHEN length(a[-1]) // 4 + length(b[1]) // 4 > 100 THEN list_append(a, b[1]) ELSE list_append(a[1:-2], a[-1] || chr(10) || b[1]) END) AS c FROM l)
SELECT 'conv/' || conv_id || '.jsonl' AS source_path, unnest(range(len(c))) AS chunk_idx, 's' || conv_id AS session_id, md5(unnest(c)) AS digest FROM f"""


@query("c7_chunk_turns", TURNS)
def c7(spark, sf_dir):
    return chunk.chunk_turns(turn_units(spark, sf_dir), 100).select("source_path", "chunk_idx", "session_id", F.md5("content").alias("digest"))


MERGED = f"""WITH w AS (SELECT source_path, list(content ORDER BY chunk_idx) AS c FROM ({WINDOWS}) GROUP BY source_path),
m AS (SELECT source_path, list_reduce(list_transform(c, lambda z: [z]), lambda a, b: CASE WHEN length(a[-1] || chr(10) || chr(10) || b[1]) // 4 <= 400 THEN list_append(a[1:-2], a[-1] || chr(10) || chr(10) || b[1]) ELSE list_append(a, b[1]) END) AS g FROM w)
SELECT source_path, unnest(range(len(g))) AS chunk_idx, md5(unnest(g)) AS digest FROM m"""


@query("c8_merge_chunks", MERGED)
def c8(spark, sf_dir):
    rows = chunk.with_sentence_windows(derived(spark, sf_dir, "items")).withColumn("chunks", chunk.merged(F.col("chunks"), 400))
    return chunk.exploded(rows).select("source_path", "chunk_idx", F.md5("content").alias("digest"))


@query("c9_chunk_units")
def c9(spark, sf_dir):
    units = derived(spark, sf_dir, "corpus").select("context", F.col("rel").alias("source_path"), "text")
    return chunk.chunk_units(units, 200).select("context", "source_path", "chunk_idx", "chunk_strategy", F.md5("content").alias("digest"))


# --- extraction ---------------------------------------------------------------------------------------------


@query("x1_facts", f"SELECT doc_id, {d_facts('text')} AS facts FROM documents")
def x1(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.facts(F.col("text")).alias("facts"))


@query("x2_entities", f"SELECT doc_id, {d_entities('text')} AS entities FROM documents")
def x2(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.entities(F.col("text")).alias("entities"))


D_TRIPLE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({T.NAME})\s+({'|'.join(T.VERBS)})\s+({T.NAME})"


def d_triples(rows: str, key: str) -> str:
    """key, ord, subject, predicate, object of rows (key, facts, e)."""
    found = lambda group: f"regexp_extract_all(fact, {q(D_TRIPLE)}, {group})"
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY n, k) - 1 AS ord, subject, predicate, object FROM (
SELECT {key}, n, unnest(range(len({found(1)}))) AS k, unnest({found(1)}) AS subject, lower(unnest({found(2)})) AS predicate, unnest({found(3)}) AS object
FROM (SELECT {key}, unnest(facts) AS fact, unnest(range(len(facts))) AS n FROM {rows}))
UNION ALL SELECT {key}, 0, e[1], 'mentions', e[2] FROM {rows} WHERE len(e) >= 2 AND NOT (len(list_filter(facts, lambda fact: regexp_matches(fact, {q(D_TRIPLE)}))) > 0)"""


TRIPLES = d_triples(f"(SELECT doc_id, {d_facts('text')} AS facts, {d_entities('text')} AS e FROM {duck('facts_items')})", "doc_id")


@query("x3_triples", TRIPLES)
def x3(spark, sf_dir):
    rows = derived(spark, sf_dir, "facts_items").select("doc_id", T.facts(F.col("text")).alias("f"), T.entities(F.col("text")).alias("e"))
    return rows.select("doc_id", F.posexplode(T.triples(F.col("f"), F.col("e"))).alias("ord", "t")).select("doc_id", "ord", "t.*")


@query("x4_summaries", f"SELECT doc_id, {d_summary('text', 'source_path', 'f', 'e')} AS summary FROM (SELECT doc_id, source_path, text, {d_facts('text')} AS f, CASE WHEN doc_id % 2 = 0 THEN {d_entities('text')} ELSE []::VARCHAR[] END AS e FROM {duck('items')})")
def x4(spark, sf_dir):
    rows = derived(spark, sf_dir, "items").withColumns({"f": T.facts(F.col("text")), "e": F.when(F.col("doc_id") % 2 == 0, T.entities(F.col("text"))).otherwise(T.no_strings())})
    return rows.select("doc_id", T.summary(F.col("text"), F.col("source_path"), F.col("f"), F.col("e")).alias("summary"))


@query("x5_compact", f"SELECT doc_id, {d_compact('text', 100)} AS short FROM documents")
def x5(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text"), 100).alias("short"))


SEMANTIC = f"SELECT context, source_path, chunk_idx, content, {d_facts('content')} AS f, {d_entities('content')} AS e FROM ({WINDOWS})"


def semantic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return extract.semantic_tables(chunk.chunk_sentence_window(derived(spark, sf_dir, "items").drop("doc_id")), F.lit(0).cast("bigint"))


SEMANTIC_ROWS = f"""SELECT source_path, chunk_idx, content, {d_facts('content')} AS facts, {d_entities('content')} AS e FROM ({WINDOWS.replace(duck('items'), duck('facts_items'))})"""


@query("x6_semantic_tables", f"""WITH s AS MATERIALIZED ({SEMANTIC_ROWS}) SELECT t, source_path, count(*) AS n, md5(string_agg(item, '|' ORDER BY item)) AS digest FROM (
SELECT 'entity' AS t, source_path, unnest(e) AS item FROM s UNION ALL SELECT 'chunk', source_path, {d_summary('content', 'source_path', 'facts', 'e')} FROM s
UNION ALL SELECT 'relation', p.source_path, subject || ' ' || predicate || ' ' || object FROM ({d_triples("(SELECT source_path || '#' || chunk_idx AS key, facts, e FROM s)", "key")}) r
JOIN (SELECT source_path || '#' || chunk_idx AS key, source_path FROM s) p USING (key)) GROUP BY t, source_path""")
def x6(spark, sf_dir):
    """Names, summaries and triples of all chunks, by source."""
    chunks = chunk.chunk_sentence_window(derived(spark, sf_dir, "facts_items").drop("doc_id"))
    c, e, r = extract.semantic_tables(chunks, F.lit(0).cast("bigint"))
    row = lambda df, t, item: df.select(F.lit(t).alias("t"), "source_path", item.alias("item"))
    rows = row(e, "entity", F.col("name")).unionByName(row(c, "chunk", F.col("summary"))).unionByName(row(r, "relation", F.concat_ws(" ", "subject", "predicate", "object")))
    return rows.groupBy("t", "source_path").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("item")), "|")).alias("digest"))


@query("x7_document_summary", f"""WITH s AS ({SEMANTIC}) SELECT context, source_path, arg_min({d_summary('content', 'source_path', 'f', 'e')}, chunk_idx) AS summary, count(*) AS n_chunks, sum(len(e))::BIGINT AS n_entities FROM s GROUP BY context, source_path""")
def x7(spark, sf_dir):
    c, e, _ = semantic(spark, sf_dir)
    return extract.document_summary(c, e)


D_ITEM = rf"""CASE WHEN starts_with(z, '- ') OR starts_with(z, '* ') THEN {d_trim('substr(z, 3)')} WHEN regexp_matches(z, '^[0-9]') THEN nullif({d_trim("regexp_replace(z, '^[0-9]+\\.*', '')")}, '') END"""
D_STEPS = f"""(CASE WHEN len(list_filter(list_transform({d_lines('text')}, lambda y: {D_ITEM.replace('(z,', '(' + d_ltrim('y') + ',').replace('substr(z, 3)', f'substr({d_ltrim("y")}, 3)')}), lambda z: z IS NOT NULL)) > 0
THEN list_filter(list_transform({d_lines('text')}, lambda y: {D_ITEM.replace('(z,', '(' + d_ltrim('y') + ',').replace('substr(z, 3)', f'substr({d_ltrim("y")}, 3)')}), lambda z: z IS NOT NULL) ELSE list_filter({d_pieces('text')}, lambda z: strlen(z) > 15)[1:6] END)"""
EITHER = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, '- ', '') ELSE text END AS text FROM {duck('runbooks')}"


@query("x8_steps", f"SELECT doc_id, {D_STEPS} AS steps FROM ({EITHER})")
def x8(spark, sf_dir):
    r = derived(spark, sf_dir, "runbooks")
    text = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("- "), F.lit(""))).otherwise(F.col("text"))
    return r.select("doc_id", text.alias("text")).select("doc_id", T.steps(F.col("text")).alias("steps"))


D_OUTCOME = f"CASE WHEN {d_any('text', ['success', 'passed', 'completed'])} THEN 'success' WHEN {d_any('text', ['fail', 'error', 'rollback'])} THEN 'failure' ELSE 'partial' END"
D_FAILURES = f"list_filter({d_pieces('text')}, lambda z: {d_any('z', ['fail', 'error', 'timeout'])})[1:5]"
D_TASK = f"coalesce(list_filter(list_transform({d_lines('text')}, lambda z: {d_trim('z')}), lambda z: strlen(z) > 10)[1], 'procedure from ' || source_path)"
D_CONTEXT = {k: "CASE " + " ".join(f"WHEN contains(lower(text), {q(n)}) THEN {q(n)}" for n in v) + " END" for k, v in T.CONTEXT_NEEDLES.items()}


@query("x9_outcome", f"SELECT doc_id, {D_OUTCOME} AS outcome FROM {duck('runbooks')}")
def x9(spark, sf_dir):
    return derived(spark, sf_dir, "runbooks").select("doc_id", T.outcome(F.col("text")).alias("outcome"))


@query("x10_failure_modes", f"SELECT doc_id, {D_FAILURES} AS modes FROM {duck('runbooks')}")
def x10(spark, sf_dir):
    return derived(spark, sf_dir, "runbooks").select("doc_id", T.failure_modes(F.col("text")).alias("modes"))


@query("x11_task_description", f"SELECT doc_id, {D_TASK} AS task FROM {duck('runbooks')}")
def x11(spark, sf_dir):
    return derived(spark, sf_dir, "runbooks").select("doc_id", T.task_description(F.col("text"), F.col("source_path")).alias("task"))


@query("x12_task_context", f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in D_CONTEXT.items())} FROM {duck('runbooks')}")
def x12(spark, sf_dir):
    return derived(spark, sf_dir, "runbooks").select("doc_id", T.task_context(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("x13_procedures", f"""SELECT source_path, {D_TASK} AS task_description, len({D_STEPS}) AS n_steps, {D_OUTCOME} AS outcome, len({D_FAILURES}) AS n_failures, CASE WHEN contains(text, chr(10)) THEN 0.78 ELSE 0.62 END::DECIMAL(3,2)::DOUBLE AS confidence FROM {duck('runbooks')}""")
def x13(spark, sf_dir):
    p = extract.procedures(derived(spark, sf_dir, "runbooks"), F.lit(0).cast("bigint"))
    return p.select("source_path", "task_description", F.size("steps").alias("n_steps"), "outcome", F.size("failure_modes").alias("n_failures"), F.round(F.col("confidence").cast("double"), 2).alias("confidence"))


@query("x14_record_procedures", "SELECT item_id, text AS task_description, CASE WHEN item_id % 2 = 0 THEN 0.85 ELSE 0.5 END::DECIMAL(3,2)::DOUBLE AS confidence FROM benchmark")
def x14(spark, sf_dir):
    b = derived(spark, sf_dir, "benchmark")
    given = b.select(F.lit("c").alias("context"), F.col("text").alias("task"), F.array(F.col("item_id").cast("string")).alias("steps"), F.lit("success").alias("outcome"), T.no_strings().alias("failure_modes"), T.task_context(F.col("text")).alias("task_context"), F.when(F.col("item_id") % 2 == 1, 0.5).alias("confidence"))
    return extract.record_procedures(given, F.lit(0).cast("bigint")).select(F.get("steps", 0).cast("bigint").alias("item_id"), "task_description", F.round(F.col("confidence").cast("double"), 2).alias("confidence"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of documents: an object with prose or fences around it, or none."""
    body = F.to_json(F.struct(F.col("lang").alias("summary"), F.array(F.lit(" "), F.col("source")).alias("facts"), F.array(F.col("source"), F.col("lang"), F.col("source")).alias("entities"), F.array(F.struct(F.col("lang").alias("subject"), F.lit("USES").alias("predicate"), F.col("source").alias("object"))).alias("triples")))
    reply = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Here: "), body, F.lit(" done }"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("no object"))
    return derived(spark, sf_dir, "documents").select("doc_id", "lang", "source", reply.alias("reply"))


@query("x15_recover_json", "SELECT doc_id, doc_id % 4 <> 3 AS found FROM documents")
def x15(spark, sf_dir):
    return replies(spark, sf_dir).select("doc_id", extract.recover_json(F.col("reply")).isNotNull().alias("found"))


@query("x16_parse_semantic", """SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN lang END AS summary, CASE WHEN doc_id % 4 <> 3 THEN [source] ELSE []::VARCHAR[] END AS facts, CASE WHEN doc_id % 4 <> 3 THEN list_sort([lang, source]) ELSE []::VARCHAR[] END AS entities, CASE WHEN doc_id % 4 <> 3 THEN 'uses' END AS predicate, CASE WHEN doc_id % 4 = 3 THEN 'no JSON object' END AS error FROM documents""")
def x16(spark, sf_dir):
    r = replies(spark, sf_dir).select("doc_id", extract.parse_semantic(F.col("reply")).alias("p"))
    return r.select("doc_id", "p.summary", "p.facts", "p.entities", F.get("p.triples", 0)["predicate"].alias("predicate"), "p.error")


@query("x17_parse_procedural", """SELECT item_id, CASE WHEN item_id % 3 <> 2 THEN text END AS task, CASE WHEN item_id % 3 <> 2 THEN 'success' END AS outcome, CASE WHEN item_id % 3 = 0 THEN 1.0 WHEN item_id % 3 = 1 THEN 0.7 END::DOUBLE AS confidence, CASE WHEN item_id % 3 = 2 THEN 'outcome is unknown' END AS error FROM benchmark""")
def x17(spark, sf_dir):
    b = derived(spark, sf_dir, "benchmark")
    doc = F.to_json(F.struct(F.col("text").alias("task_description"), F.when(F.col("item_id") % 3 == 2, "maybe").otherwise("Success").alias("outcome"), F.when(F.col("item_id") % 3 == 0, 7).alias("confidence")))
    r = b.select("item_id", extract.parse_procedural(doc).alias("p"))
    return r.select("item_id", F.col("p.task_description").alias("task"), "p.outcome", "p.confidence", "p.error")


@query("x18_extraction_prompts")
def x18(spark, sf_dir):
    return extract.extraction_prompts(derived(spark, sf_dir, "items"), "text").select("doc_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query("x19_with_fallback", f"SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN lang ELSE substr(text, 1, 10) END AS summary FROM documents")
def x19(spark, sf_dir):
    rules = derived(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 10).alias("summary"))
    r = replies(spark, sf_dir).select("doc_id", extract.parse_semantic(F.col("reply")).alias("p")).select("doc_id", "p.summary", "p.error")
    return extract.with_fallback(rules, r, "doc_id", ["summary"])


# --- search -----------------------------------------------------------------------------------------------------


@query("e1_embed")
def e1(spark, sf_dir):
    rows = embed.embed_distinct(derived(spark, sf_dir, "items"), "text", embed.hashing_embedder(32), 32)
    return rows.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


@query("e2_hashing_embedder")
def e2(spark, sf_dir):
    """Compared with a plain count of hashed tokens in tests/test_goldens.py."""
    rows = embed.embed(derived(spark, sf_dir, "documents").select("doc_id", "text"), "text", embed.hashing_embedder(64), 64)
    return rows.select("doc_id", "embedding")


@query("e3_tokenize", f"SELECT doc_id, len({d_tokens('text')}) AS n, len(list_distinct({d_tokens('text')})) AS n_distinct FROM documents")
def e3(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("e4_lexical_overlap", f"SELECT d.doc_id, round({d_overlap('d.text', 'b.text')}, 9) AS overlap FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def e4(spark, sf_dir):
    d, b = derived(spark, sf_dir, "documents"), derived(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("asked"))
    rows = d.join(b, F.col("item_id") == F.col("doc_id") % b.count())
    return rows.select("doc_id", F.round(T.lexical_overlap(T.tokenize(F.col("text")), T.tokenize(F.col("asked"))), 9).alias("overlap"))


@query("e5_cosine", f"SELECT a.vec_id, round({d_cosine('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def e5(spark, sf_dir):
    a, b = derived(spark, sf_dir, "embeddings"), derived(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


D_HYBRID = f"(0.7 * {d_clamp(f'({d_cosine("q.embedding", "c.embedding")} + 1) / 2')} + 0.3 * {d_clamp(d_overlap('q.text', 'c.index_text'))})"


@query("e6_hybrid_score", f"SELECT q.query_id, c.id, round({D_HYBRID}, 6) AS score FROM {duck('asked')} q JOIN {duck('pool')} c ON q.context = c.context")
def e6(spark, sf_dir):
    return retrieve.hybrid_pairs(derived(spark, sf_dir, "asked"), derived(spark, sf_dir, "pool")).select("query_id", "id", F.round("score", 6).alias("score"))


D_TOP = f"""WITH s AS (SELECT q.query_id, q.text AS asked, c.id, c.source_path AS source, c.index_text, c.summary, round({D_HYBRID}, 9) AS s0 FROM {duck('asked')} q JOIN {duck('pool')} c ON q.context = c.context),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC, source, id) <= 50),
r AS (SELECT query_id, id, source, summary, round(0.8 * s0 + 0.2 * {d_overlap('asked', 'index_text')}, 9) AS score FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, id) AS rank FROM r)"""


def found(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieve.semantic_search(derived(spark, sf_dir, "asked"), derived(spark, sf_dir, "pool"), None, k)


@query("e7_semantic_search", f"{D_TOP} SELECT query_id, rank, id, source, summary, round(score, 6) AS score FROM k WHERE rank <= 10")
def e7(spark, sf_dir):
    return found(spark, sf_dir).select("query_id", "rank", "id", "source", "summary", F.round("score", 6).alias("score"))


@query("e9_context_matches", f"""WITH c AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in D_CONTEXT.items())} FROM {duck('runbooks')})
SELECT p.doc_id, {' AND '.join(f'(q.{k} IS NULL OR p.{k} IS NULL OR q.{k} = p.{k})' for k in T.CONTEXT_NEEDLES)} AS matches FROM c p JOIN c q ON q.doc_id = p.doc_id + 1""")
def e9(spark, sf_dir):
    """Whether each runbook's context matches that of the next."""
    c = staged(derived(spark, sf_dir, "runbooks").select("doc_id", T.task_context(F.col("text")).alias("c")))
    both = c.join(c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("c").alias("next")), "doc_id")
    return both.select("doc_id", retrieve.context_matches(F.col("next"), F.col("c")).alias("matches"))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, "recipes")
    made = extract.procedures(r, (F.unix_timestamp(as_of()) - 86400 * (F.col("doc_id") % 200)))
    return made.join(r.select("context", "source_path", "embedding"), ["context", "source_path"])


ASKED2 = f"(SELECT * REPLACE ('c' || (query_id % 3) AS context) FROM {duck('asked')})"
D_PROC = f"""WITH p AS (SELECT context, source_path, embedding, {D_TASK} AS task, array_to_string({D_STEPS}, ' -> ') AS steps, {', '.join(f'{v} AS {k}' for k, v in D_CONTEXT.items())}, CASE WHEN contains(text, chr(10)) THEN 0.78 ELSE 0.62 END::FLOAT::DOUBLE AS confidence, doc_id % 200 AS days FROM {duck('recipes')}),
a AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in D_CONTEXT.items())} FROM {ASKED2}),
s AS (SELECT query_id, source_path AS source, task, steps, round({d_clamp(f'({d_cosine("a.embedding", "p.embedding")} + 1) / 2')} * confidence * exp(-days / 130.0::DOUBLE) + 0.15 * {d_overlap('a.text', 'p.task')}, 9) AS score
 FROM a JOIN p ON a.context = p.context AND {' AND '.join(f'(a.{k} IS NULL OR p.{k} IS NULL OR a.{k} = p.{k})' for k in T.CONTEXT_NEEDLES)}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank FROM s)"""


@query("e8_procedural_search", f"{D_PROC} SELECT query_id, rank, source, md5('steps: ' || steps) AS digest, round(score, 6) AS score FROM k WHERE rank <= 5")
def e8(spark, sf_dir):
    asked = derived(spark, sf_dir, "asked").withColumn("context", F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")))
    return retrieve.procedural_search(asked, recipes(spark, sf_dir), 5, F.unix_timestamp(as_of())).select("query_id", "rank", "source", F.md5("content").alias("digest"), F.round("score", 6).alias("score"))


@query("e10_notes_candidates", rf"""SELECT context, path AS source, coalesce({d_trim("regexp_replace(list_filter(list_transform(" + d_lines('content') + ", lambda z: " + d_trim('z') + "), lambda z: z <> '')[1], '^#+', '')")}, 'notes') AS summary FROM {duck('notes')}""")
def e10(spark, sf_dir):
    n = derived(spark, sf_dir, "notes").withColumn("embedding", F.array().cast("array<float>"))
    return retrieve.notes_candidates(n).select("context", "source", "summary")


@query("e11_search")
def e11(spark, sf_dir):
    n = embed.embed(derived(spark, sf_dir, "notes"), "content", embed.hashing_embedder(64), 64)
    return retrieve.search(derived(spark, sf_dir, "asked"), derived(spark, sf_dir, "pool"), n, recipes(spark, sf_dir), "all", 5, as_of=F.unix_timestamp(as_of())).select("query_id", "rank", "kind", "source", F.round("score", 6).alias("score"))


FUSED = """SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(part), 9) AS score FROM (
SELECT label AS query_id, vec_id AS id, 0.7 * greatest(0.0, least(1.0, (embedding[1]::DOUBLE + 1) / 2)) AS part FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL
SELECT label, vec_id, 0.3 * greatest(0.0, least(1.0, abs(embedding[2]::DOUBLE) * 10 / 2.2)) FROM embeddings WHERE vec_id % 3 <> 1) GROUP BY query_id, id)"""


@query("e12_fuse", FUSED)
def e12(spark, sf_dir):
    e = derived(spark, sf_dir, "embeddings")
    rows = lambda w, s: e.where(w).select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), s.alias("score"))
    out = retrieve.fuse(rows("vec_id % 3 <> 0", F.get("embedding", 0).cast("double")), rows("vec_id % 3 <> 1", F.abs(F.get("embedding", 1).cast("double")) * 10))
    return out.withColumn("score", F.round("score", 6))


@query("e13_answer_prompts", f"""{D_TOP} SELECT query_id, md5(string_agg('[' || rank || ']' || chr(10) || 'kind: semantic' || chr(10) || 'source: ' || source || chr(10) || 'summary: ' || summary || chr(10) || 'content:' || chr(10) ||
CASE WHEN length({d_trim('c.content')}) > 2000 THEN substr({d_trim('c.content')}, 1, 2000) || '...' ELSE {d_trim('c.content')} END, chr(10) || chr(10) ORDER BY rank)) AS digest FROM k JOIN (SELECT id, content FROM {duck('pool')}) c USING (id) WHERE rank <= 10 GROUP BY query_id""")
def e13(spark, sf_dir):
    return retrieve.answer_prompts(found(spark, sf_dir)).select("query_id", F.md5("prompt").alias("digest"))


CITED = "SELECT query_id, [CAST(query_id % 12 AS BIGINT), 2, CAST(query_id % 12 AS BIGINT), 99] AS c FROM {asked}"


@query("e14_attributions", f"""{D_TOP}, c AS (SELECT query_id, unnest(c) AS rank, unnest([0, 1, 2, 3]) AS pos FROM ({CITED.replace('{asked}', duck('asked'))}) WHERE query_id % 4 <> 0),
h AS (SELECT c.query_id, source, min(pos) AS place FROM c JOIN k ON c.query_id = k.query_id AND c.rank = k.rank AND k.rank <= 10 GROUP BY c.query_id, source), g AS (SELECT query_id, list(source ORDER BY place) AS l FROM h GROUP BY query_id),
f AS (SELECT query_id, list(source ORDER BY place)[1:5] AS l FROM (SELECT query_id, source, min(rank) AS place FROM k WHERE rank <= 10 GROUP BY query_id, source) GROUP BY query_id) SELECT f.query_id, coalesce(g.l, f.l) AS sources FROM f LEFT JOIN g USING (query_id)""")
def e14(spark, sf_dir):
    asked, n = derived(spark, sf_dir, "asked"), (F.col("query_id") % 12).cast("bigint")
    cited = asked.where("query_id % 4 <> 0").select("query_id", F.array(n, F.lit(2).cast("bigint"), n, F.lit(99).cast("bigint")).alias("citations"))
    return retrieve.attributions(found(spark, sf_dir), cited)


@query("e15_parse_answers", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text END AS answer, CASE WHEN item_id % 2 = 1 THEN 'no answer' END AS error FROM benchmark")
def e15(spark, sf_dir):
    b = derived(spark, sf_dir, "benchmark")
    doc = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(" ").alias("answer"), F.array(F.lit(1)).alias("citations"))))
    return b.select("item_id", retrieve.parse_answers(doc).alias("p")).select("item_id", "p.answer", "p.error")


# --- syncing --------------------------------------------------------------------------------------------------------

M, FI = duck("manifest"), duck("files")
STATE = f"""(SELECT context, root, coalesce(source_path, path) AS rel, CASE WHEN min(hash_at_index) = max(hash_at_index) THEN min(hash_at_index) END AS h, bool_and(blob_ref IS NOT NULL) AS stored,
CASE WHEN min(source_size) = max(source_size) THEN min(source_size) END AS size, CASE WHEN min(source_mtime) = max(source_mtime) THEN min(source_mtime) END AS mtime, bool_and(hash = hash_at_index) AS same FROM {M} GROUP BY ALL)"""


@query("f1_content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def f1(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("f2_fully_indexed", f"SELECT context, root, s.rel AS source_rel FROM {STATE} s JOIN {FI} f USING (context, root, rel) WHERE s.h = f.hash AND s.stored")
def f2(spark, sf_dir):
    return sync.fully_indexed(derived(spark, sf_dir, "manifest"), derived(spark, sf_dir, "files"), store_raw=True)


@query("f3_fully_indexed_by_stat", f"SELECT context, root, s.rel AS source_rel FROM {STATE} s JOIN {FI} f USING (context, root, rel) WHERE s.same AND s.size = f.size AND s.mtime = f.mtime")
def f3(spark, sf_dir):
    return sync.fully_indexed_by_stat(derived(spark, sf_dir, "manifest"), derived(spark, sf_dir, "files"))


D_STREAM = f"(f.size > {P.STREAM_FROM} AND NOT regexp_matches(lower(f.rel), '[.](html|png)$'))"  # plain text: the only other kinds here are pages and pictures
PLAN = f"""SELECT f.context, f.root, f.rel, f.size, CASE WHEN c <> 'keep' THEN c WHEN {D_STREAM} THEN CASE WHEN s.same AND s.size = f.size AND s.mtime = f.mtime THEN 'already_indexed' ELSE 'needs_work' END
 WHEN f.size > {P.FORMAT_LIMIT} THEN 'too_large' WHEN s.h = f.hash THEN 'already_indexed' ELSE 'needs_work' END AS action
FROM (SELECT *, {D_CLASS} AS c FROM {FI}) f LEFT JOIN {STATE} s ON f.context = s.context AND f.root = s.root AND f.rel = s.rel"""


@query("f4_plan_add", f"SELECT context, root, rel, action FROM ({PLAN})")
def f4(spark, sf_dir):
    return sync.plan_add(derived(spark, sf_dir, "files"), derived(spark, sf_dir, "manifest")).select("context", "root", "rel", "action")


KNOWN = f"(SELECT context, root, coalesce(source_path, path) AS rel, arg_min(type, path) AS layer FROM {M} GROUP BY ALL)"


@query("f5_plan_update", f"SELECT p.context, p.root, p.rel, p.action, k.layer FROM ({PLAN}) p JOIN {KNOWN} k USING (context, root, rel)")
def f5(spark, sf_dir):
    return sync.plan_update(derived(spark, sf_dir, "manifest"), derived(spark, sf_dir, "files")).select("context", "root", "rel", "action", "layer")


STATS = f"""SELECT p.context, count(*) FILTER (action NOT IN ('infrastructure', 'junk')) AS seen, count(*) FILTER (action = 'denied') AS denied, count(*) FILTER (action = 'too_large') AS too_large, count(*) FILTER (action = 'already_indexed') AS already_indexed,
count(*) FILTER (action = 'needs_work') AS work_items, coalesce(sum(p.size) FILTER (action = 'needs_work'), 0)::BIGINT AS work_bytes, count(*) FILTER (action = 'needs_work' AND layer = 'semantic') AS semantic_items, count(*) FILTER (action = 'needs_work' AND layer = 'procedural') AS procedural_items
FROM ({PLAN}) p JOIN {KNOWN} k USING (context, root, rel) GROUP BY p.context"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.plan_stats(sync.plan_update(derived(spark, sf_dir, "manifest"), derived(spark, sf_dir, "files")))


@query("f6_plan_stats", STATS)
def f6(spark, sf_dir):
    return stats(spark, sf_dir)


@query("f7_estimate_seconds", f"SELECT context, round(greatest(1.0, work_bytes / 1048576.0::DOUBLE * 45.0 + 8.0 * procedural_items + 2.0 * work_items), 6) AS seconds FROM ({STATS})")
def f7(spark, sf_dir):
    return sync.estimate_seconds(stats(spark, sf_dir)).select("context", F.round("seconds", 6).alias("seconds"))


@query("f8_run_rate_ema", f"SELECT context, round(list_reduce(list(seconds / mib ORDER BY place), lambda s, x: 0.15 * x + 0.85 * s), 6) AS ema FROM {duck('runs')} WHERE semantic_items > 0 AND mib >= 0.001 GROUP BY context")
def f8(spark, sf_dir):
    return sync.run_rate_ema(derived(spark, sf_dir, "runs")).select("context", F.round("ema", 6).alias("ema"))


def small_index(spark: SparkSession, sf_dir: str) -> sync.Index:
    c, e, r = semantic(spark, sf_dir)
    return {"chunks": c, "entities": e, "relations": r, "procedures": extract.procedures(derived(spark, sf_dir, "runbooks").drop("doc_id"), F.lit(0).cast("bigint"))}


#: All documents as sources of two roots with equal paths: a source and its twin differ in root alone.
TWINS = (
    "SELECT doc_id, 'c' || (doc_id // 6 % 3) AS context, 'r' || (doc_id % 2) AS root, 'd' || (doc_id // 2) || '.txt' AS path, "
    "'r' || (doc_id % 2) || '/d' || (doc_id // 2) || '.txt' AS source_path, text, lang FROM {documents}"
)
D_TWINS = "(" + TWINS.replace("{documents}", "documents") + ")"


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TWINS.replace("//", "div"), documents=derived(spark, sf_dir, "documents")).withColumn("source_path", index_path(F.col("root"), F.col("path")))


def twin_index(rows: DataFrame, mark: str = "") -> sync.Index:
    """Index tables of twins (context, source_path, text, lang): sentence windows, a row per distinct word and per language of it, and a procedure."""
    words = exploded(rows, ["context", "source_path", "lang"], F.array_distinct(F.split("text", " ")), "_n", "name").select("context", "source_path", F.concat(F.lit(mark), "name").alias("name"), "lang")
    chunks = chunk.chunk_sentence_window(rows.select("context", "source_path", "text")).withColumn("content", F.concat(F.lit(mark), "content"))
    relations = words.select("context", "source_path", F.col("name").alias("subject"), F.lit("in").alias("predicate"), F.col("lang").alias("object"))
    tasks = rows.select("context", "source_path", F.concat(F.lit(mark), F.lit("read "), "source_path").alias("task_description"))
    return {"chunks": chunks, "entities": words.drop("lang"), "relations": relations, "procedures": tasks}


def index_digests(index: sync.Index) -> DataFrame:
    """name, context, source_path, n, digest: every table's rows by source."""
    shown = {
        "chunks": F.concat_ws(" ", F.lpad(F.col("chunk_idx").cast("string"), 6, "0"), F.md5("content")), "entities": F.col("name"),
        "relations": F.concat_ws(" ", "subject", "predicate", "object"), "procedures": F.col("task_description"),
    }
    parts = [
        index[t].groupBy("context", "source_path").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(row)), "|")).alias("digest")).withColumn("name", F.lit(t))
        for t, row in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def d_index(rows: str, mark: str = "") -> str:
    """The same in SQL: rows of (name, context, source_path, item)."""
    windows = WINDOWS.replace(duck("items"), rows)
    words = f"SELECT context, source_path, lang, unnest(list_distinct(string_split(text, ' '))) AS w FROM {rows}"
    return f"""SELECT 'chunks' AS name, context, source_path, lpad(chunk_idx::VARCHAR, 6, '0') || ' ' || md5('{mark}' || content) AS item FROM ({windows})
UNION ALL SELECT 'entities', context, source_path, '{mark}' || w FROM ({words}) UNION ALL SELECT 'relations', context, source_path, '{mark}' || w || ' in ' || lang FROM ({words})
UNION ALL SELECT 'procedures', context, source_path, '{mark}read ' || source_path FROM {rows}"""


D_DIGESTS = "SELECT name, context, source_path, count(*) AS n, md5(string_agg(item, '|' ORDER BY item)) AS digest FROM ({}) GROUP BY ALL"
#: A tenth of the sources of one root is indexed anew; their twins in the other root stay.
AGAIN = "doc_id % 20 = 7"


@query("f9_replace_sources", D_DIGESTS.format(d_index(f"(SELECT * FROM {D_TWINS} WHERE NOT {AGAIN})") + " UNION ALL " + d_index(f"(SELECT * FROM {D_TWINS} WHERE {AGAIN})", "again ")))
def f9(spark, sf_dir):
    rows = twins(spark, sf_dir)
    redone = rows.where(AGAIN)
    return index_digests(sync.replace_sources(twin_index(rows), twin_index(redone, "again "), redone.select("context", "source_path")))


#: Each of these sources is a unit of a file of three. Of a quarter of the files of one root, only the first unit is left.
LOST = "doc_id % 2 = 1 AND doc_id // 6 % 4 = 0 AND doc_id // 2 % 3 <> 0"


@query("f10_prune_orphan_units", f"""{D_DIGESTS.format(d_index(f"(SELECT * FROM {D_TWINS} WHERE NOT ({LOST}))"))}
UNION ALL SELECT 'manifest', context, source_path, 1, 'f' || (doc_id // 6) FROM {D_TWINS} WHERE NOT ({LOST})""")
def f10(spark, sf_dir):
    rows = twins(spark, sf_dir).withColumn("source_rel", F.expr("'f' || doc_id div 6"))
    manifest = rows.select("context", "root", "path", F.col("source_rel").alias("source_path"))
    units = rows.where("doc_id % 2 = 1 and doc_id div 6 % 4 = 0 and doc_id div 2 % 3 = 0").select("context", "root", "source_rel", F.col("path").alias("unit_rel"))
    kept, index = sync.prune_orphan_units(manifest, twin_index(rows), units)
    named = kept.select(F.lit("manifest").alias("name"), "context", F.concat_ws("/", "root", "path").alias("source_path"), F.lit(1).cast("bigint").alias("n"), F.col("source_path").alias("digest"))
    return index_digests(index).unionByName(named)


@query("f11_upsert_manifest", f"""SELECT coalesce(m.context, n.context) AS context, coalesce(m.root, n.root) AS root, coalesce(m.path, n.rel) AS path, coalesce(n.hash, m.hash) AS hash, coalesce(n.hash, m.hash_at_index) AS hash_at_index, CASE WHEN n.rel IS NOT NULL THEN 'semantic' ELSE m.type END AS type, m.blob_ref
FROM {M} m FULL JOIN (SELECT * FROM {duck('corpus')} WHERE doc_id % 4 = 0) n ON m.context = n.context AND m.root = n.root AND m.path = n.rel""")
def f11(spark, sf_dir):
    n = derived(spark, sf_dir, "corpus").where("doc_id % 4 = 0")
    units = n.select("context", "root", F.col("rel").alias("unit_rel"), F.col("rel").alias("source_rel"), "hash", F.lit("semantic").alias("type"), F.lit(None).cast("string").alias("blob_ref"), F.col("size").cast("bigint").alias("size"), "mtime")
    return sync.upsert_manifest(derived(spark, sf_dir, "manifest"), units, as_of()).select("context", "root", "path", "hash", "hash_at_index", "type", "blob_ref")


@query("f12_index_units")
def f12(spark, sf_dir):
    units = derived(spark, sf_dir, "corpus").select("context", F.col("rel").alias("source_path"), "text")
    return audit.index_counts(index_units(units, F.lit(0).cast("bigint")))



@query("f14_rebuild", f"""SELECT context, root, rel AS path, hash, hash AS hash_at_index FROM {duck('corpus')}
UNION ALL SELECT context, root, 'gone/' || rel, hash, '' FROM {duck('corpus')} WHERE doc_id % 11 = 0 AND doc_id % 13 <> 0""")
def f14(spark, sf_dir):
    """All files are indexed anew; rows of parts that no file has any more go, rows of sources that are away stay, unindexed."""
    none = spark.createDataFrame([], "context string, source_path string")
    done = rebuild(corpus_files(spark, sf_dir), derived(spark, sf_dir, "manifest"), dict.fromkeys(sync.TABLES, none), as_of())
    return done["manifest"].select("context", "root", "path", "hash", "hash_at_index")


def d_streamed(rows: str) -> str:
    """Manifest rows and numbers of chunks of sources (doc_id, context, source_path, text)."""
    return f"""WITH w AS (SELECT context, source_path, count(*) AS n FROM ({WINDOWS.replace(duck("items"), rows)}) GROUP BY ALL),
l AS ({d_layer("items", "doc_id, context, source_path, text").replace(duck("items"), rows)})
SELECT l.context, 'all' AS root, l.source_path AS path, 'sha256:' || sha256(l.text) AS hash, strlen(l.text)::BIGINT AS source_size, l.layer AS type,
CASE WHEN l.layer <> 'semantic' THEN 0 WHEN w.n > 0 THEN w.n WHEN {d_trim('l.text')} <> '' THEN 1 ELSE 0 END AS n_chunks
FROM l LEFT JOIN w ON l.context = w.context AND l.source_path = w.source_path"""


def delivered(documents: DataFrame, context: Column, source: Column) -> DataFrame:
    """Documents as files of the root `all`."""
    return documents.select(
        context.alias("context"), F.lit("all").alias("root"), source.alias("rel"), F.octet_length("text").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime"),
        T.content_hash(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("content"),
    )


def streamed_state(spark: SparkSession, out: str) -> DataFrame:
    chunks = latest(spark, out, "chunks").groupBy("context", F.col("source_path").alias("_source")).agg(F.count("*").alias("n_chunks"))
    rows = latest(spark, out, "manifest").withColumn("_source", index_path(F.col("root"), F.col("path"))).join(chunks, ["context", "_source"], "left").na.fill(0, ["n_chunks"])
    return rows.select("context", "root", "path", "hash", "source_size", "type", "n_chunks")


@query("f15_stream_ingest", d_streamed(duck("items")))
def f15(spark, sf_dir):
    """All documents as a stream of files: the manifest and the chunks of each source."""
    documents = spark.readStream.schema(derived(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    files = delivered(documents, F.concat(F.lit("c"), F.col("doc_id") % 3), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")))
    out = stage_folder(spark, "stream")
    stream_rows(files, out, f"{out}/checkpoint", AS_OF).awaitTermination()
    return streamed_state(spark, out)


#: Two documents are versions of one source; the later one counts.
VERSIONS = "(SELECT max(doc_id) AS doc_id, 'c' || (doc_id // 2 % 3) AS context, 'd' || (doc_id // 2) || '.txt' AS source_path, max_by(text, doc_id) AS text FROM documents GROUP BY doc_id // 2)"


@query("f15_stream_runs", d_streamed(VERSIONS))
def f15_runs(spark, sf_dir):
    """Ten batches: five bring the first versions of all sources, five the later ones. Runs are merged on the way."""
    documents = derived(spark, sf_dir, "documents")
    out = stage_folder(spark, "stream")
    for k in range(10):
        batch = documents.where((F.col("doc_id") % 2 == k // 5) & (F.expr("doc_id div 2") % 5 == k % 5))
        source = F.expr("'d' || doc_id div 2 || '.txt'")
        append_batch(out, AS_OF)(delivered(batch, F.expr("'c' || doc_id div 2 % 3"), source), k)
    return streamed_state(spark, out)


@query("f13_ingestion_summary", f"""SELECT context, count(*) FILTER (action = 'already_indexed') AS already_indexed, count(*) FILTER (action = 'denied') AS denied, count(*) FILTER (action = 'too_large') AS too_large, count(*) FILTER (action = 'needs_work') AS indexed, sum(size)::BIGINT AS n_bytes FROM ({PLAN}) GROUP BY context""")
def f13(spark, sf_dir):
    plan = sync.plan_add(derived(spark, sf_dir, "files"), derived(spark, sf_dir, "manifest"))
    rows = plan.select("context", F.when(F.col("action") == "needs_work", "indexed").otherwise(F.col("action")).alias("outcome"), F.lit(1).alias("units"), F.lit(0).alias("chunks"), F.lit(0).alias("entities"), F.col("size").alias("bytes"))
    return sync.ingestion_summary(rows).select("context", "already_indexed", "denied", "too_large", "indexed", "n_bytes")


# --- audits ---------------------------------------------------------------------------------------------------------

REFRESHED = f"(SELECT m.* REPLACE (coalesce(f.hash, m.hash) AS hash), f.rel IS NOT NULL AS there FROM {M} m LEFT JOIN {FI} f ON m.context = f.context AND m.root = f.root AND coalesce(m.source_path, m.path) = f.rel)"


@query("g1_refresh_hashes", f"SELECT context, root, path, hash FROM {REFRESHED}")
def g1(spark, sf_dir):
    return audit.refresh_hashes(derived(spark, sf_dir, "manifest"), derived(spark, sf_dir, "files")).select("context", "root", "path", "hash")


@query("g2_context_status", f"""SELECT context, count(*) FILTER (there AND hash = hash_at_index) AS n_indexed, count(*) FILTER (there AND hash <> hash_at_index) AS n_dirty, count(*) FILTER (NOT there) AS n_pending,
list_sort(list_distinct(list(path) FILTER (there AND hash <> hash_at_index))) AS dirty_paths FROM {REFRESHED} GROUP BY context""")
def g2(spark, sf_dir):
    return audit.context_status(derived(spark, sf_dir, "manifest"), derived(spark, sf_dir, "files"))


@query("g3_drift_state", f"SELECT context, root, path, hash, hash_at_index FROM {M} WHERE hash <> hash_at_index")
def g3(spark, sf_dir):
    return audit.drift_state(derived(spark, sf_dir, "manifest"))


@query("g4_list_contexts", f"""WITH s AS ({SEMANTIC}) SELECT c.context, n_chunks, n_entities, n_procedures, epoch(u)::BIGINT AS updated_at FROM (SELECT context, count(*) AS n_chunks, sum(len(e))::BIGINT AS n_entities FROM s GROUP BY context) c
JOIN (SELECT context, count(*) AS n_procedures FROM {duck('runbooks')} GROUP BY context) p USING (context) JOIN (SELECT context, max(indexed_at) AS u FROM {M} GROUP BY context) m USING (context)""")
def g4(spark, sf_dir):
    return audit.list_contexts(derived(spark, sf_dir, "manifest"), small_index(spark, sf_dir)).select("context", "n_chunks", "n_entities", "n_procedures", "updated_at")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "blobs").withColumn("payload", F.col("body").cast("binary"))


@query("g5_verify_blobs", f"""SELECT m.context, root, path, blob_ref, CASE WHEN b.blob_hash IS NULL THEN 'missing' WHEN 'sha256:' || sha256(body) = b.blob_hash THEN 'ok' ELSE 'tampered' END AS verdict
FROM {M} m LEFT JOIN {duck('blobs')} b ON m.context = b.context AND m.blob_ref = b.blob_hash WHERE blob_ref IS NOT NULL""")
def g5(spark, sf_dir):
    return audit.verify_blobs(derived(spark, sf_dir, "manifest"), blobs(spark, sf_dir))


@query("g6_orphan_blobs", f"SELECT DISTINCT context, blob_hash FROM {duck('blobs')} b WHERE NOT EXISTS (SELECT 1 FROM {M} m WHERE m.context = b.context AND m.blob_ref = b.blob_hash)")
def g6(spark, sf_dir):
    return audit.orphan_blobs(derived(spark, sf_dir, "manifest"), blobs(spark, sf_dir))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = derived(spark, sf_dir, "corpus").select("context").distinct().withColumns({"version": F.when(F.col("context") == "c2", "0.3").otherwise("0.2"), "config": F.when(F.col("context") != "c1", F.struct(F.lit(7).alias("days")))})
    return audit.health_report(contexts, derived(spark, sf_dir, "manifest"), blobs(spark, sf_dir), derived(spark, sf_dir, "notes"), derived(spark, sf_dir, "registry"), small_index(spark, sf_dir))


D_CANONICAL = (
    "CASE WHEN regexp_matches(path, '^notes/[^/]*$') AND path NOT IN ('notes/index.md', 'notes/summary.md') THEN replace(path, 'notes/', 'notes/topics/') ELSE path END"
)
D_STATUS = "CASE WHEN coalesce(n, 0) > 0 THEN 'warn' ELSE 'ok' END, coalesce(n, 0)::VARCHAR"
D_BAD = f"""SELECT m.context FROM {M} m LEFT JOIN {duck('blobs')} b ON m.context = b.context AND m.blob_ref = b.blob_hash
WHERE blob_ref IS NOT NULL AND (b.blob_hash IS NULL OR 'sha256:' || sha256(body) <> b.blob_hash)"""
D_ORPHANS = f"SELECT DISTINCT context, blob_hash FROM {duck('blobs')} b WHERE NOT EXISTS (SELECT 1 FROM {M} m WHERE m.context = b.context AND m.blob_ref = b.blob_hash)"
D_SEMANTIC_KEYS = f"(SELECT context || ' ' || source_path || '#' || chunk_idx AS key, context, f AS facts, e FROM ({SEMANTIC}))"


def d_count(rows: str) -> str:
    return f"(SELECT context, count(*) AS n FROM ({rows}) GROUP BY context)"


@query("g7_health_report", f"""WITH c AS (SELECT DISTINCT context FROM {duck('corpus')}), s AS MATERIALIZED (SELECT * FROM {D_SEMANTIC_KEYS}),
i AS (SELECT context FROM s UNION ALL SELECT context FROM (SELECT context, unnest(e) FROM s) UNION ALL SELECT split_part(key, ' ', 1) FROM ({d_triples('s', 'key')}) UNION ALL SELECT context FROM {duck('runbooks')}),
missing AS (SELECT r.context FROM {duck('registry')} r WHERE NOT EXISTS (SELECT 1 FROM {duck('notes')} n WHERE n.context = r.context AND n.path = r.path)),
stray AS (SELECT context, path FROM {duck('notes')} n WHERE path LIKE '%.md' AND NOT EXISTS (SELECT 1 FROM {duck('registry')} r WHERE n.context = r.context AND n.path = r.path) UNION SELECT context, path FROM {duck('notes')} WHERE {D_CANONICAL} <> path)
SELECT context, 'manifest_version' AS name, CASE WHEN context = 'c2' THEN 'fail' ELSE 'ok' END AS status, CASE WHEN context = 'c2' THEN 'unknown version' ELSE 'version 0.2' END AS detail FROM c
UNION ALL SELECT context, 'config', CASE WHEN context = 'c1' THEN 'warn' ELSE 'ok' END, CASE WHEN context = 'c1' THEN 'no configuration' ELSE 'set' END FROM c
UNION ALL SELECT context, 'notes_missing', {D_STATUS} FROM c LEFT JOIN {d_count('SELECT * FROM missing')} USING (context)
UNION ALL SELECT context, 'notes_stray', {D_STATUS} FROM c LEFT JOIN {d_count('SELECT * FROM stray')} USING (context)
UNION ALL SELECT context, 'index', CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'fail' END, coalesce(n, 0)::VARCHAR FROM c LEFT JOIN {d_count('SELECT * FROM i')} USING (context)
UNION ALL SELECT context, 'drift', {D_STATUS} FROM c LEFT JOIN {d_count(f'SELECT * FROM {M} WHERE hash <> hash_at_index')} USING (context)
UNION ALL SELECT context, 'blobs', CASE WHEN coalesce(b.n, 0) > 0 THEN 'fail' WHEN coalesce(o.n, 0) > 0 THEN 'warn' ELSE 'ok' END, coalesce(b.n, 0) || ' bad, ' || coalesce(o.n, 0) || ' orphans'
FROM c LEFT JOIN {d_count(D_BAD)} b USING (context) LEFT JOIN {d_count(D_ORPHANS)} o USING (context)""")
def g7(spark, sf_dir):
    return health(spark, sf_dir)


@query("g8_repair", f"""SELECT context, path, md5(arg_min(content, (old <> path, old))) AS digest FROM (SELECT context, path AS old, content, CASE WHEN regexp_matches(path, '^notes/[^/]*$') AND path NOT IN ('notes/index.md', 'notes/summary.md') THEN replace(path, 'notes/', 'notes/topics/') ELSE path END AS path FROM {duck('notes')}) GROUP BY context, path""")
def g8(spark, sf_dir):
    fixed = audit.repair(derived(spark, sf_dir, "manifest"), blobs(spark, sf_dir), derived(spark, sf_dir, "notes"), derived(spark, sf_dir, "registry"))
    return fixed["notes"].select("context", "path", F.md5("content").alias("digest"))


#: Contexts to repair: c1 is as it was indexed, with an index and no reference to a blob; in the others sources moved or went, and blobs are missing or changed.
REPAIRED = """SELECT context, 'r' AS root, TIMESTAMP '2024-01-01 00:00:00' AS added_at, CASE WHEN doc_id % 11 = 0 AND context <> 'c1' THEN 'gone/' || source_path ELSE source_path END AS path, {sha:text} AS hash,
    CASE WHEN doc_id % 7 = 0 AND context <> 'c1' THEN {sha:text || 'x'} ELSE {sha:text} END AS hash_at_index, TIMESTAMP '2024-02-01 00:00:00' AS indexed_at, 'semantic' AS type,
    CASE WHEN doc_id % 3 <> 1 THEN 'sha256:' || {sha:text} END AS blob_ref, CAST(NULL AS {string}) AS source_path, length(text) AS source_size, 0 AS source_mtime FROM {items}"""
D_PLACED = f"(SELECT context, path, arg_min(content, (old <> path, old)) AS content FROM (SELECT context, path AS old, content, {D_CANONICAL} AS path FROM {duck('notes')}) GROUP BY context, path)"
CHECKS = ("manifest_version", "config", "notes_missing", "notes_stray", "index", "drift", "blobs")


@query("g8_repair_contexts", f"""SELECT 'manifest' AS name, context, source_path AS key, sha256(text) AS digest FROM {duck('items')}
UNION ALL SELECT 'blobs', context, 'sha256:' || sha256(text), sha256(text) FROM {duck('items')} WHERE context <> 'c1' GROUP BY context, text
UNION ALL SELECT 'notes', context, path, sha256(content) FROM {D_PLACED} UNION ALL SELECT 'registry', context, path, 'sha256:' || sha256(content) FROM {D_PLACED} WHERE path LIKE '%.md'
UNION ALL SELECT 'index', context, source_path, 'there' FROM {duck('items')}
UNION ALL SELECT 'health', context, c.name, 'ok' FROM (SELECT DISTINCT context FROM {duck('items')}), (SELECT unnest({list(CHECKS)}) AS name) c""")
def g8_contexts(spark, sf_dir):
    """All contexts after repair, every output whole, and their health report."""
    items = staged(derived(spark, sf_dir, "items"))
    sql = re.sub(r"\{sha:([^}]*)\}", r"sha2(\1, 256)", REPAIRED).replace("{string}", "STRING")
    manifest = staged(spark.sql(sql, items=items))
    source = items.withColumn("content", F.col("text").cast("binary"))
    files = source.select("context", F.lit("r").alias("root"), F.col("source_path").alias("rel"), F.octet_length("content").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime"), F.sha2("text", 256).alias("hash"), "content")
    chunks = items.where("context = 'c1'").select("context", F.concat(F.lit("r/"), "source_path").alias("source_path"), F.col("text").alias("content"))
    index = {t: chunks if t == "chunks" else chunks.limit(0) for t in sync.TABLES}
    config = F.struct(F.lit(True).alias("store_raw_content"))
    contexts = items.select("context").distinct().withColumns({"version": F.lit("0.2"), "config": config})
    fixed = repair_contexts(contexts, manifest, blobs(spark, sf_dir).drop("body"), derived(spark, sf_dir, "notes"), derived(spark, sf_dir, "registry"), index, files, as_of())
    report = audit.health_report(contexts, fixed["manifest"], fixed["blobs"], fixed["notes"], fixed["registry"], fixed["index"])
    indexed = fixed["index"]["chunks"].select("context", "source_path").unionByName(fixed["index"]["procedures"].select("context", "source_path")).distinct()
    row = lambda df, name, key, digest: df.select(F.lit(name).alias("name"), "context", key.alias("key"), digest.alias("digest"))
    parts = [
        row(fixed["manifest"], "manifest", F.col("path"), F.col("hash_at_index")), row(fixed["blobs"], "blobs", F.col("blob_hash"), F.sha2("payload", 256)),
        row(fixed["notes"], "notes", F.col("path"), F.sha2("content", 256)), row(fixed["registry"], "registry", F.col("path"), F.col("hash")),
        row(indexed, "index", F.expr("substr(source_path, 3)"), F.lit("there")), row(report, "health", F.col("name"), F.col("status")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- notes ----------------------------------------------------------------------------------------------------------

N, R = duck("notes"), duck("registry")


@query("n1_canonical_note_path", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'notes/topics/' || event_type || '.md' WHEN event_id % 3 = 1 THEN 'notes/topics/' || event_type ELSE 'notes/deep/' || event_type || '.md' END AS path FROM events")
def n1(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("aura\\"), "event_type", F.lit(".md"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("notes/"), "event_type")).otherwise(F.concat(F.lit("notes/deep/"), "event_type", F.lit(".md")))
    return derived(spark, sf_dir, "events").select("event_id", P.canonical_note_path(raw).alias("path"))


@query("n2_valid_note_path", "SELECT event_id, event_id % 3 = 0 AS valid FROM events")
def n2(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("notes/"), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("notes/../"), "event_type")).otherwise(F.col("event_type"))
    return derived(spark, sf_dir, "events").select("event_id", P.valid_note_path(raw).alias("valid"))


@query("n3_apply_note_writes", f"""WITH w AS (SELECT *, max(CASE WHEN mode = 'replace' THEN seq END) OVER (PARTITION BY context, path) AS last FROM {duck('note_writes')})
SELECT context, replace(path, 'notes/', 'notes/topics/') AS path, 'sha256:' || sha256(string_agg(content, chr(10) ORDER BY seq)) AS hash FROM w WHERE last IS NULL OR seq >= last GROUP BY context, path""")
def n3(spark, sf_dir):
    empty = derived(spark, sf_dir, "notes").limit(0)
    return notes.apply_note_writes(empty, derived(spark, sf_dir, "note_writes")).select("context", "path", "hash")


@query("n4_remember", r"""SELECT event_id AS seq, 'notes/topics/' || event_type || '-topic-' || (user_id % 10) || '.md' AS path, '## ' || strftime(ts, '%Y-%m-%d') || chr(10) || chr(10) || props || chr(10) AS content FROM events""")
def n4(spark, sf_dir):
    e = derived(spark, sf_dir, "events").select(F.lit("c").alias("context"), F.col("event_id").alias("seq"), F.concat(F.lit(" "), F.initcap("event_type"), F.lit("/Topic "), (F.col("user_id") % 10).cast("string"), F.lit(".md ")).alias("topic"), F.concat(F.lit(" "), "props", F.lit("\n")).alias("text"), F.to_date("ts").alias("day"))
    return notes.remembered(e).where("error is null").select("seq", "path", "content")


@query("n5_refresh_registry", f"""SELECT n.context, n.path, 'sha256:' || sha256(content) AS hash, CASE WHEN r.hash = 'sha256:' || sha256(content) THEN r.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at FROM {N} n LEFT JOIN {R} r USING (context, path)""")
def n5(spark, sf_dir):
    return notes.refresh_registry(derived(spark, sf_dir, "notes"), derived(spark, sf_dir, "registry"), as_of())


@query("n6_notes_snapshot", f"""SELECT context, max(content) FILTER (path = 'notes/index.md') AS index_text, max(content) FILTER (path = 'notes/summary.md') AS summary_text, list_sort(list(path) FILTER (path NOT IN ('notes/index.md', 'notes/summary.md'))) AS topics FROM {N} GROUP BY context""")
def n6(spark, sf_dir):
    return notes.notes_snapshot(derived(spark, sf_dir, "notes"))


STABLE = f"(SELECT context, path, content, updated_at FROM {R} r JOIN {N} n USING (context, path) WHERE path NOT IN ('notes/index.md', 'notes/summary.md') AND updated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND r.hash = 'sha256:' || sha256(content))"


def stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.stable_topics(derived(spark, sf_dir, "registry"), derived(spark, sf_dir, "notes"), as_of())


@query("n7_stable_topics", f"SELECT context, path, updated_at FROM {STABLE}")
def n7(spark, sf_dir):
    return stable(spark, sf_dir).select("context", "path", "updated_at")


@query("n8_promotion_gate", f"""SELECT c.context, CASE WHEN n = 0 THEN 'NoStableTopics' WHEN n < 12 THEN 'BelowMinTopics' ELSE 'Promote' END AS gate, n AS n_topics, CASE WHEN n >= 12 THEN p ELSE []::VARCHAR[] END AS promoted
FROM (SELECT DISTINCT context FROM {N} UNION SELECT 'none') c LEFT JOIN LATERAL (SELECT count(*) AS n, list_sort(list(path)) AS p FROM {STABLE} s WHERE s.context = c.context) ON true""")
def n8(spark, sf_dir):
    contexts = derived(spark, sf_dir, "notes").select("context").unionByName(spark.range(1).select(F.lit("none").alias("context")))
    return notes.promotion_gate(stable(spark, sf_dir), contexts, 12)


@query("n9_distill_prompts")
def n9(spark, sf_dir):
    summaries = derived(spark, sf_dir, "notes").where("path = 'notes/summary.md'").select("context", "content")
    return notes.distill_prompts(stable(spark, sf_dir), summaries).select("context", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


D_SECTION = "'## Auto-updated notes' || chr(10) || chr(10) || ' new' || chr(10)"
D_GAP = "CASE WHEN text = '' OR ends_with(text, chr(10) || chr(10)) THEN '' WHEN ends_with(text, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END"


@query("n10_replace_section", f"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || {D_GAP} || {D_SECTION} ELSE 'intro' || chr(10) || chr(10) || {D_SECTION} || '## Other' || chr(10) || text END) AS digest FROM documents""")
def n10(spark, sf_dir):
    old = F.when(F.col("doc_id") % 3 == 1, "## Promoted knowledge").otherwise("## Auto-updated notes")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("intro\n\n"), old, F.lit("\n\nold lines\n\n## Other\n"), "text"))
    return derived(spark, sf_dir, "documents").select("doc_id", F.md5(notes.replace_section(text, F.lit(" new\n"))).alias("digest"))


@query("n11_parse_distillation", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS markdown, CASE WHEN doc_id % 2 = 1 THEN 'no distilled_markdown' END AS error FROM documents")
def n11(spark, sf_dir):
    reply = F.concat(F.lit("```json\n{\""), F.when(F.col("doc_id") % 2 == 0, "distilled_markdown").otherwise("other"), F.lit("\": \""), "source", F.lit("\"}\n```"))
    return derived(spark, sf_dir, "documents").select("doc_id", notes.parse_distillation(reply).alias("p")).select("doc_id", F.col("p.distilled_markdown").alias("markdown"), "p.error")


# --- rows and blobs ---------------------------------------------------------------------------------------------------


@query("s2_from_rows", "SELECT CASE WHEN item_id % 2 = 0 THEN 'given/' || item_id ELSE 'inline/' || item_id || '.txt' END AS source_path, md5(text) AS digest FROM benchmark")
def s2(spark, sf_dir):
    b = derived(spark, sf_dir, "benchmark").withColumn("given", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("given/"), "item_id")))
    return from_rows(b, "item_id", "text", "given").select("source_path", F.md5("text").alias("digest"))


@query("s7_write_blobs", f"SELECT DISTINCT context, 'sha256:' || sha256(text) AS blob_hash FROM {duck('items')} EXCEPT SELECT context, blob_hash FROM {duck('blobs')}")
def s7(spark, sf_dir):
    return blobs_of(derived(spark, sf_dir, "items"), blobs(spark, sf_dir)).select("context", "blob_hash")


@query("s8_read_blobs", f"""SELECT m.path, m.root, m.context, md5(b.body) AS digest FROM {M} m LEFT JOIN (SELECT * FROM {duck('blobs')} WHERE 'sha256:' || sha256(body) = blob_hash) b ON m.context = b.context AND m.blob_ref = b.blob_hash WHERE blob_ref IS NOT NULL""")
def s8(spark, sf_dir):
    refs = derived(spark, sf_dir, "manifest").where("blob_ref is not null").select("context", "root", "path", "blob_ref")
    return read_blobs(refs, blobs(spark, sf_dir)).select("path", "root", "context", F.md5("text").alias("digest"))


@query("s1_list_corpus")
def s1(spark, sf_dir):
    return list_corpus(spark, sf_dir).select("context", "rel", "size")


FILE_COLUMNS = ["context", "root", "path", "hash", "hash_at_index", "type", "blob_ref", "source_path", "source_size", "source_mtime"]


@query("s3_s5_manifest_round_trip", f"""SELECT {', '.join('m.' + c for c in FILE_COLUMNS)}, source_size AS kept, 1 AS later, context || '-cfg' AS config_key, context || '-notes' AS notes_key, root || '-src' AS source_key, empty
FROM {M} m JOIN (SELECT context, count(DISTINCT root) AS empty FROM {M} GROUP BY context) USING (context)""")
def s3(spark, sf_dir):
    """Unknown keys of document, config, source, notes block and file come back, and so do sources without files."""
    key = lambda name, value: F.parse_json(F.to_json(F.struct(value.alias(name))))
    m = derived(spark, sf_dir, "manifest").withColumn("extra", key("kept", F.col("source_size")))
    config = F.struct(F.lit(True).alias("store_raw_content"), F.lit(7).alias("notes_update_threshold_days"))
    heads = m.select(F.col("context").alias("name")).distinct().withColumns({
        "version": F.lit("0.2"), "description": F.lit("d"), "created_at": as_of(), "config": config, "extra": key("later", F.lit(1)),
        "config_extra": key("cfg", F.concat("name", F.lit("-cfg"))), "notes_extra": key("policy", F.concat("name", F.lit("-notes"))),
    })
    roots = m.select("context", "root").distinct().withColumn("added_at", as_of())
    sources = roots.unionByName(roots.withColumn("root", F.concat(F.lit("empty "), "root"))).withColumn("extra", key("src", F.concat("root", F.lit("-src"))))
    listed = derived(spark, sf_dir, "registry").withColumn("extra", F.parse_json(F.lit("{}")))
    docs = write_manifest(heads, m, listed, "2024-06-01T00:00:00Z", sources).select(F.col("name").alias("doc_id"), "text")
    back = parse_manifests(docs)
    text = lambda column, name, kind="string": F.variant_get(column, f"$.{name}", kind)
    top = back["contexts"].select(F.col("name").alias("context"), text("extra", "later", "int").alias("later"), text("config_extra", "cfg").alias("config_key"), text("notes_extra", "policy").alias("notes_key"))
    own = back["sources"].select("context", "root", text("extra", "src").alias("source_key"))
    empty = own.where("root like 'empty %'").groupBy("context").agg(F.count("*").alias("empty"))
    files = back["source_files"].select(*FILE_COLUMNS, text("extra", "kept", "bigint").alias("kept"))
    return files.join(top, "context").join(own, ["context", "root"]).join(empty, "context")


@query("s4_migrate_manifest", f"SELECT 'c' || (doc_id // 100) AS context, '.' AS root, rel AS path, hash, hash AS hash_at_index, 'sha256:' || hash AS blob_ref, 'semantic' AS type, doc_id AS id FROM {duck('corpus')}")
def s4(spark, sf_dir):
    """A document lists 100 files, so documents grow in number and not in size."""
    c = derived(spark, sf_dir, "corpus").withColumn("context", F.expr("'c' || doc_id div 100"))
    entry = F.struct(F.col("doc_id").alias("id"), F.col("rel").alias("source_path"), F.col("hash").alias("source_hash"), F.concat(F.lit("sha256:"), "hash").alias("blob_hash"), F.lit("semantic").alias("layer"))
    docs = c.groupBy("context").agg(F.collect_list(entry).alias("entries"))
    text = F.to_json(F.struct(F.col("context").alias("name"), F.lit("0.1").alias("ctx_version"), F.lit("2024-01-01T00:00:00Z").alias("created"), F.col("entries")))
    files = parse_manifests(docs.select(F.col("context").alias("doc_id"), text.alias("text")))["source_files"]
    return files.select("context", "root", "path", "hash", "hash_at_index", "blob_ref", "type", F.variant_get("extra", "$.id", "bigint").alias("id"))


@query("s6_index_round_trip", f"""WITH s AS ({SEMANTIC}) SELECT c.context, n_chunks, n_entities, n_procedures FROM (SELECT context, count(*) AS n_chunks, sum(len(e))::BIGINT AS n_entities FROM s GROUP BY context) c
JOIN (SELECT context, count(*) AS n_procedures FROM {duck('runbooks')} GROUP BY context) p USING (context)""")
def s6(spark, sf_dir):
    path = stage_folder(spark, "index")
    write_index(small_index(spark, sf_dir), path, "v1", 4)
    return audit.index_counts(read_index(spark, path)).select("context", "n_chunks", "n_entities", "n_procedures")

"""Inputs of the registered queries, made from the given tables by SQL that Spark and DuckDB both run.

Names in braces are tables; {sha(...)} is the SHA-256 in hex, written for either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-06-01 00:00:00"

SQL = {
    "corpus": """SELECT doc_id, 'c' || (doc_id % 3) AS context, lang AS root,
        source || '/' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'py' ELSE 'html' END AS rel,
        length(text) AS size, 1715000000 + doc_id AS mtime, {sha:text} AS hash, text FROM {documents}""",
    "files": """SELECT context, root, CASE WHEN doc_id % 23 = 0 THEN '.git/' || rel WHEN doc_id % 29 = 0 THEN rel || '.PNG' WHEN doc_id % 31 = 0 THEN 'x/.DS_Store' WHEN doc_id % 19 = 0 THEN 'moved/' || rel ELSE rel END AS rel,
        CASE WHEN doc_id % 37 = 0 THEN 268435457 ELSE size END AS size, mtime, hash, doc_id FROM {corpus}""",
    "manifest": """SELECT context, root, TIMESTAMP '2024-01-01 00:00:00' AS added_at, CASE WHEN doc_id % 13 = 0 THEN rel || '/part-' || u WHEN doc_id % 11 = 0 THEN 'gone/' || rel ELSE rel END AS path,
        {sha:text} AS hash, CASE WHEN doc_id % 7 = 0 THEN {sha:text || 'x'} ELSE {sha:text} END AS hash_at_index, TIMESTAMP '2024-02-01 00:00:00' AS indexed_at,
        CASE WHEN doc_id % 5 = 0 THEN 'procedural' ELSE 'semantic' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'sha256:' || {sha:text} END AS blob_ref,
        CASE WHEN doc_id % 13 = 0 THEN rel END AS source_path, CASE WHEN doc_id % 74 = 0 THEN 268435457 ELSE size END AS source_size, mtime + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS source_mtime
        FROM {corpus} CROSS JOIN (SELECT 1 AS u UNION ALL SELECT 2) AS units WHERE u = 1 OR doc_id % 13 = 0""",
    "blobs": """SELECT DISTINCT 'c' || (doc_id % 3) AS context, 'sha256:' || {sha:stored} AS blob_hash, 'sha256:' || {sha:stored} AS content_hash, CASE WHEN length(text) % 17 = 0 THEN stored || 'x' ELSE stored END AS body
        FROM (SELECT doc_id, text, CASE WHEN length(text) % 5 = 0 THEN text || 'y' ELSE text END AS stored FROM {documents}) AS d UNION ALL SELECT 'c0', 'sha256:' || {sha:text}, 'sha256:' || {sha:text}, text FROM {benchmark}""",
    "items": """SELECT doc_id, 'c' || (doc_id % 3) AS context, source || '/' || doc_id || '.txt' AS source_path, text FROM {documents}""",
    "facts_items": """SELECT doc_id, context, source_path, replace(text, ' the ', ' uses ') AS text FROM {items}""",
    "md_items": """SELECT doc_id, context, source || '/' || doc_id || '.md' AS source_path, '# Title ' || doc_id || chr(10) || replace(replace(text, '. ', '.' || chr(10)), chr(10) || 'Th', chr(10) || chr(10) || '# Th') AS text
        FROM (SELECT *, 'c' || (doc_id % 3) AS context FROM {documents}) AS d""",
    "runbooks": """SELECT doc_id, context, source_path, '- ' || replace(replace(text, '. ', '.' || chr(10) || '- '), chr(10) || '- A', chr(10) || '2. run A') || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'result: success' WHEN 1 THEN chr(10) || 'error: timeout' ELSE '' END
        || CASE doc_id % 4 WHEN 0 THEN ' docker python' WHEN 1 THEN ' rust axum staging' ELSE '' END AS text FROM {items}""",
    "code_items": """SELECT doc_id, context, replace(source_path, '.txt', '.py') AS source_path, '# head' || chr(10) || replace(replace(text, '. ', '.' || chr(10)), chr(10) || 'Th', chr(10) || '# note' || chr(10) || 'def th') AS text FROM {items}""",
    "dialogues": """SELECT conv_id, turn, role || ': ' || text AS line FROM {conversations}""",
    "notes": """SELECT DISTINCT 'c' || (doc_id % 3) AS context, CASE doc_id % 3 WHEN 0 THEN 'notes/topics/t' || doc_id || '.md' WHEN 1 THEN 'notes/n' || doc_id || '.md' ELSE 'notes/topics/deep/d' || doc_id || '.md' END AS path, text AS content
        FROM {documents} UNION ALL SELECT 'c' || n, p, '# Index of c' || n FROM (SELECT 0 AS n UNION ALL SELECT 1) AS a CROSS JOIN (SELECT 'notes/index.md' AS p UNION ALL SELECT 'notes/summary.md') AS b""",
    "registry": """SELECT context, CASE WHEN k % 4 = 0 THEN replace(path, '.md', '-old.md') ELSE path END AS path, 'sha256:' || CASE WHEN k % 5 <> 0 THEN {sha:content} ELSE {sha:content || 'x'} END AS hash, CASE WHEN k % 3 = 0 THEN TIMESTAMP '2024-05-30 00:00:00' ELSE TIMESTAMP '2024-05-01 00:00:00' END AS updated_at
        FROM (SELECT *, length(replace(content, 'e', '')) AS k FROM {notes}) AS n UNION ALL SELECT 'c0', 'notes/topics/gone.md', 'sha256:0', TIMESTAMP '2024-05-01 00:00:00'""",
    "note_writes": """SELECT 'c' || (user_id % 3) AS context, 'notes/' || event_type || '.md' AS path, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'replace' ELSE 'append' END AS mode, props AS content FROM {events}""",
    "runs": """SELECT 'u' || (user_id % 50) AS context, event_id AS place, value AS seconds, (event_id % 97) / 10.0 AS mib, event_id % 4 AS semantic_items FROM {events}""",
    "vectors": """SELECT vec_id, embedding, many FROM {embeddings} CROSS JOIN (SELECT count(*) AS many FROM {embeddings}) AS n""",
    "pool": """SELECT 'c' || (d.doc_id % 2) AS context, 'k' || d.doc_id AS id, d.source || '/' || d.doc_id || '.txt' AS source_path, CAST(0 AS INT) AS chunk_idx, d.text AS content, d.text AS index_text, 'doc ' || d.doc_id AS summary, e.embedding
        FROM {documents} AS d JOIN {vectors} AS e ON d.doc_id % e.many = e.vec_id""",
    "asked": """SELECT b.item_id AS query_id, 'c' || (b.item_id % 2) AS context, b.text || CASE b.item_id % 3 WHEN 0 THEN ' python docker' WHEN 1 THEN ' staging' ELSE '' END AS text, e.embedding FROM {benchmark} AS b JOIN {vectors} AS e ON (b.item_id + 7) % e.many = e.vec_id""",
    "recipes": """SELECT p.*, e.embedding FROM {runbooks} AS p JOIN {vectors} AS e ON p.doc_id % e.many = e.vec_id""",
}


def parts_of(name: str, sql: str) -> list[str]:
    return [m for m in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, or a given table."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"\{sha:([^}]*)\}", r"sha2(\1, 256)", SQL[name])
    if "{vectors}" in sql:  # their number as a value, so that rows and vectors meet by an equi-join instead of all pairs
        many = derived(spark, sf_dir, "embeddings").count()
        sql = sql.replace("{vectors}", "{embeddings}").replace("e.many", str(many) if many else "CAST(NULL AS BIGINT)")
    return spark.sql(sql, **{p: derived(spark, sf_dir, p) for p in parts_of(name, sql)})


def duck(name: str) -> str:
    """A derived input, or a given table, as a DuckDB relation."""
    if name not in SQL:
        return name
    sql = re.sub(r"\{sha:([^}]*)\}", r"sha256(\1)", SQL[name])
    return "(" + re.sub(r"\{(\w+)\}", lambda m: duck(m[1]), sql) + ")"

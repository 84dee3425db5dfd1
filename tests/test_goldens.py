"""Literal cases, mostly small inputs with a known result."""

import json
import re

import pytest
from pyspark.sql import functions as F

from memspark.functions import paths as P
from memspark.functions import text as T
from memspark.functions.staging import staged
from memspark.operators import audit, chunk, decode, embed, extract, notes, retrieve, sync
from memspark.plans.ingest import index_units, ingest, rebuild
from memspark.queries import QUERIES
from memspark.sources.corpus import list_corpus
from memspark.sources.index import blobs_of, read_blobs, read_index, write_index
from memspark.sources.manifest import parse_manifests, write_manifest
from memspark.streaming.ingest import append_batch, latest, stream_ingest


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v"))).collect()]


def test_classify_path(spark):
    skip = ["asset." + e for e in "jpg JPEG png mp4 mp3 zip tar.gz exe dll so wasm ttf woff2 sqlite".split()] + ["project/.git/HEAD", "project/target/debug/app", "project/node_modules/pkg/index.js", ".DS_Store", "docs/Thumbs.db"]
    keep = "README.md data.json config.yaml feed.xml table.csv report.pdf book.epub notebook.ipynb page.html sheet.xlsx lib.rs main.py targets/x .gitignore".split()
    assert "keep" not in column(spark, skip, P.classify_path) and set(column(spark, keep, P.classify_path)) == {"keep"}
    assert column(spark, ["a/.git/x.png", "x.PNG", "a/.DS_Store"], P.classify_path) == ["infrastructure", "denied", "junk"]


def test_route_decoder(spark):
    rows = [("report.pdf", "", 1), ("no-ext", "%PDF-1.4", 1), ("deck.pptx", "", 1), ("a.HTM", "x", 1), ("b", "<!DOCTYPE html>", 1), ("c", "  \n<html>", 1), ("d", "<?xml v", 1), ("note.md", "# heading", 1), ("n.ipynb", "", 1), ("r", "{\\rtf1", 1), ("t.xls", "", 1), ("big.txt", "", 9 << 20), ("big.pdf", "", 257 << 20), ("e.epub", "", 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, p string, h string, s bigint")
    got = [r[0] for r in df.orderBy("k").select(P.route_decoder(F.col("p"), F.col("h"), F.col("s"))).collect()]
    assert got == ["pdf", "pdf", "pptx", "html", "html", "html", "html", "plain", "notebook", "rtf", "spreadsheet", "stream", "too_large", "epub"]


def test_decode_text(spark):
    data = [b"hello\n", b"\xef\xbb\xbfhi", "é".encode("utf-16"), b"\xfe\xff" + "né".encode("utf-16-be"), b"caf\xe9 \x93x\x94", b"\xff\xfea", b""]
    assert column(spark, data, decode.decode_text, "binary") == ["hello\n", "hi", "é", "né", "café “x”", None, ""]


def test_html_and_notebooks(spark):
    (text,) = column(spark, ["<html><body><h1>Hi</h1><p>A <b>bold</b> claim, see <a href='u'>here</a>.</p><script>x</script></body></html>"], decode.html_to_text)
    assert text == "Hi\nA bold claim, see here [u]."
    book = {"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "print(1)\n", "outputs": [{"text": "1"}]}, {"cell_type": "raw", "source": "raw"}, {"cell_type": "code", "source": ""}]}
    plain = {"cells": [{"cell_type": "code", "source": "x"}]}
    assert column(spark, [json.dumps(book), json.dumps(plain)], decode.notebook_to_text) == ["# T\ntext\n\n```python\nprint(1)\n```\n\nraw", "```\nx\n```"]


def test_split_plain_text():
    text = "".join(f"line {k:02d} " + "x" * 46 + "\n" for k in range(10))
    parts = decode.split_text(text, 100)
    assert len(parts) >= 3 and "".join(parts) == text and decode.split_text("", 100) == []
    long = decode.split_text("a" * 350_000, 100_000)
    assert len(long) == 4 and max(map(len, long)) <= 100_000
    accents = decode.split_text("é" * 333, 100)
    assert "".join(accents) == "é" * 333 and all(len(p.encode()) <= 100 for p in accents)


def test_numbers_and_names(spark):
    names = ["Revenue 2025", "A/B:C", "___", "", "plain"]
    assert column(spark, names, decode.sheet_name) == ["Revenue_2025", "A_B_C", "_", "_", "plain"]
    df = spark.createDataFrame([("c", "r", "s", k, "" if k == 3 else "t") for k in range(1, 11)], "context string, root string, source_rel string, n int, text string")
    got = [r.virtual_path for r in decode.number_units(df, "page", "txt", "n").orderBy("n").collect()]
    assert got == [f"page-{k:02d}.txt" for k in range(1, 11) if k != 3]


def test_table(spark):
    df = spark.createDataFrame([("s", 0, ["x", "y", "z"]), ("s", 1, ["a", "b|c"])], "sheet string, n int, cells array<string>")
    assert decode.table_to_markdown(df, ["sheet"], "n").first().text == "# Sheet: s\n\n| x | y | z |\n| --- | --- | --- |\n| a | b\\|c |  |\n"


def units(spark, rows):
    return spark.createDataFrame([("c", p, t) for p, t in rows], "context string, source_path string, text string")


def test_merge(spark):
    parts = ["aa", "bb", "cc long chunk text that pushes the merged window over a small budget"]
    df = spark.createDataFrame([(parts,)], "p array<string>").withColumn("c", F.transform("p", lambda x: chunk.as_chunk(x, "s")))
    merged = lambda n: [x.content for x in df.select(chunk.merged(F.col("c"), n)).first()[0]]
    assert merged(12) == ["aa\n\nbb", parts[2]] and merged(0) == parts


def test_chunkers(spark):
    md = "intro text\n# One\nbody é\n\n  ## Two\nmore\n"
    got = [(r.content, r.char_start, r.char_end) for r in chunk.chunk_structure(units(spark, [("a.md", md)])).orderBy("chunk_idx").collect()]
    assert got == [("document\nintro text", 0, 11), ("# One\nbody é", 11, 26), ("## Two\nmore", 26, 40)]
    code = "import x\n\n# about f\ndef f():\n    return 1\nclass A:\n    pass\n"
    got = [r.content for r in chunk.chunk_syntax(units(spark, [("a.py", code)])).orderBy("chunk_idx").collect()]
    assert got == ["# about f\ndef f():\n    return 1", "class A:\n    pass"]
    turns = '{"role": "user"}\nSession: s1: x\nhello\n\nworld\nsession:s2\nbye'
    got = [(r.session_id, r.content) for r in chunk.chunk_units(units(spark, [("t.jsonl", turns)])).orderBy("chunk_idx").collect()]
    assert got == [("", '{"role": "user"}'), ("s1", "hello\nworld"), ("s2", "bye")]
    short = chunk.chunk_units(units(spark, [("s.txt", " tiny "), ("e.txt", " "), ("n.txt", None)])).collect()
    assert [(r.content, r.char_end) for r in short] == [("tiny", 6)]


def test_extraction(spark):
    text = "AuthService uses RS256 tokens and writes audit events. It calls nothing."
    df = units(spark, [("src/auth.rs", text)])
    c, e, r = extract.semantic_tables(chunk.chunk_units(df), F.lit(0).cast("bigint"))
    assert {x.name for x in e.collect()} == {"AuthService", "RS256"}
    assert {(x.subject, x.predicate, x.object) for x in r.collect()} >= {("AuthService", "uses", "RS256")}
    assert "AuthService" in c.first().summary
    assert column(spark, ["éAuth Auth éRS256x Ébc fn go_x"], T.entities) == [["Auth", "go_x"]]
    assert column(spark, ["- a\n* b\n3.. c\n4\nplain", "one sentence that is long. short"], T.steps) == [["a", "b", "c"], ["one sentence that is long"]]
    assert column(spark, ["All passed", "rollback", "hm"], T.outcome) == ["success", "failure", "partial"]
    assert [tuple(x) for x in column(spark, ["deploy django on Docker"], T.task_context)] == [("go", "django", "docker")]
    run = units(spark, [("r.md", "1. run cargo test\n2. deploy to staging\n3. verify health checks\nresult: success")])
    assert run.select(T.classify_content(F.col("source_path"), F.col("text"))).first()[0] == "procedural"
    p = extract.procedures(run, F.lit(0).cast("bigint")).first()
    assert p.steps == ["run cargo test", "deploy to staging", "verify health checks"] and p.outcome == "success" and abs(p.confidence - 0.78) < 1e-6


@pytest.mark.parametrize(("reply", "want"), [('{"a":1} trailing', {"a": 1}), ('{"a":1}{"a":2}', {"a": 1}), ('} x {"a": {"b": "}"}}', {"a": {"b": "}"}}), ('```json\n{"a":1}\n```\nmore', {"a": 1}), ("none", None), ('{"a":', None)])
def test_recover_json(reply, want):
    found = extract.first_object(reply)
    assert (json.loads(found) if found else None) == want


def test_replies():
    r = extract.semantic_reply('Sure [{"summary":" s ","facts":["f",""],"entities":["B","A","B"],"triples":[{"subject":"A","predicate":"USES","object":"B"},{"subject":"x"}]}]')
    assert (r["summary"], r["facts"], r["entities"], r["triples"]) == ("s", ["f"], ["A", "B"], [{"subject": "A", "predicate": "uses", "object": "B"}])
    assert extract.semantic_reply('{"summary":" "}')["error"] and extract.semantic_reply(None)["error"]
    p = extract.procedural_reply(json.dumps([json.dumps({"task_description": "t", "steps": ["a", "b"], "outcome": "Success", "context": {"framework": "axum"}, "confidence": 3})]))
    assert p["steps"] == ["a", "b"] and p["outcome"] == "success" and p["confidence"] == 1.0 and p["task_context"]["framework"] == "axum"
    assert extract.procedural_reply('{"task_description":"t","outcome":"odd"}')["error"]
    assert retrieve.answer_reply('x {"answer":"a","citations":[1,"2",0]}') == {"answer": "a", "citations": [1], "error": None}


def test_search(spark):
    texts = [("src/auth.rs", "AuthService uses RS256 tokens and writes audit events."), ("b.txt", "Nothing in here is of any use to anybody at all.")]
    index = index_units(units(spark, texts), F.lit(0).cast("bigint"))
    ask = embed.embed(spark.createDataFrame([(1, "c", "what uses RS256"), (2, "c", "what is my name?")], "query_id bigint, context string, text string"), "text", embed.hashing_embedder(), 32)
    memo = embed.embed(spark.createDataFrame([("c", "notes/topics/general.md", "# my name is joe")], "context string, path string, content string"), "content", embed.hashing_embedder(), 32)
    hits = retrieve.semantic_search(ask, index["chunks"], memo, 2).collect()
    top = {r.query_id: r for r in hits if r.rank == 1}
    assert "AuthService" in top[1].summary and (top[2].kind, top[2].source, top[2].summary) == ("notes", "notes/topics/general.md", "my name is joe")
    run = index_units(units(spark, [("r.md", "1. run cargo test\n2. deploy to staging\nresult: success")]), F.lit(0).cast("bigint"))
    both = retrieve.search(ask, index["chunks"], memo, run["procedures"], "all", 5, as_of=F.lit(0)).collect()
    assert {r.kind for r in both} == {"semantic", "notes", "procedural"} and [r.rank for r in sorted(both, key=lambda r: (r.query_id, r.rank)) if r.query_id == 1] == list(range(1, 5))


def test_search_does_not_depend_on_partitions(spark):
    rows = [("c", f"k{k}", f"s{k % 7}", 0, f"word{k % 5} other{k % 3}", f"word{k % 5} other{k % 3}", "s", [float(k % 4), 1.0]) for k in range(200)]
    chunks = spark.createDataFrame(rows, "context string, id string, source_path string, chunk_idx int, content string, index_text string, summary string, embedding array<float>")
    ask = spark.createDataFrame([(q, "c", f"word{q} other1", [1.0, float(q)]) for q in range(5)], "query_id bigint, context string, text string, embedding array<float>")
    runs = [sorted(map(str, retrieve.top_candidates(ask, retrieve.chunk_candidates(chunks.repartition(n)), block=b).collect())) for n, b in ((1, 256), (3, 2), (8, 256))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 250


def test_attributions(spark):
    rows = [(1, 1, "src/auth.rs", "semantic"), (1, 2, "src/auth.rs", "semantic"), (1, 3, "docs/tokens.md", "semantic"), (2, 1, " ", "procedural"), (2, 2, "docs/deploy.md", "semantic")]
    results = spark.createDataFrame(rows, "query_id bigint, rank int, source string, kind string")
    cited = spark.createDataFrame([(1, [1, 2, 3]), (2, [99])], "query_id bigint, citations array<bigint>")
    assert {r.query_id: r.sources for r in retrieve.attributions(results, cited).collect()} == {1: ["src/auth.rs", "docs/tokens.md"], 2: ["procedural", "docs/deploy.md"]}


def test_note_paths_and_topics(spark):
    paths = ["notes/auth.md", "notes/topics/foo.md", "notes/scratch/foo.md", "notes/summary.md", "notes/index.md", "notes/aura.md", "aura\\x.md"]
    assert column(spark, paths, P.canonical_note_path) == ["notes/topics/auth.md", *paths[1:5], "notes/summary.md", "notes/topics/x.md"]
    assert column(spark, ["Auth", "Auth Policy.md", " auth/JWT  ", " - / ", "__"], P.topic_slug) == ["auth", "auth-policy", "auth-jwt", None, None]
    assert column(spark, ["notes/a.md", "notes/../x", "x.md"], P.valid_note_path) == [True, False, False]


def test_note_writes_and_sections(spark):
    old = spark.createDataFrame([("c", "notes/topics/a.md", "old")], "context string, path string, content string")
    writes = spark.createDataFrame([("c", "notes/a.md", 1, "append", "x"), ("c", "notes/a.md", 2, "replace", "new"), ("c", "notes/a.md", 3, "append", "more"), ("c", "bad", 1, "append", "x")], "context string, path string, seq bigint, mode string, content string")
    assert [(r.path, r.content) for r in notes.apply_note_writes(old, writes).collect()] == [("notes/topics/a.md", "new\nmore")]
    assert notes.section_set("intro", "b") == "intro\n\n## Auto-updated notes\n\nb\n"
    text = "i\n\n## Promoted knowledge\n\nold\n\n## Other\nx"
    once = notes.section_set(text, "b")
    assert once == "i\n\n## Auto-updated notes\n\nb\n## Other\nx" == notes.section_set(once, "b") and notes.section_of(text) == "\nold\n"
    assert notes.section_set("a\n", " b\n\n") == "a\n\n## Auto-updated notes\n\n b\n" and notes.section_set("", "") == "## Auto-updated notes\n\n\n"
    assert notes.section_set(" ## Auto-updated notes\nx", "b").count("Auto-updated") == 2  # an indented heading is none
    assert notes.section_set("## Promoted knowledge\r\n1\n## Auto-updated notes\n2\n## Other", "b") == "## Auto-updated notes\n\nb\n## Other"


MANIFEST = {"name": "demo", "version": "0.2", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "config": {"store_raw_content": True, "future": 3}, "later": {"a": 1}, "sources": [{"root": "/empty", "added_at": "2024-01-01T00:00:00Z", "files": []}, {"root": "/src", "added_at": "2024-01-01T00:00:00Z", "provenance": "up", "files": [{"path": "a.md", "hash": "h", "hash_at_index": "h", "indexed_at": "2024-01-01T00:00:00Z", "type": "semantic", "odd": [1]}]}], "notes": {"policy": "private", "files": [{"path": "notes/index.md", "hash": "n", "updated_at": "2024-01-01T00:00:00Z", "tag": "t"}]}}
OLD = {"name": "old", "ctx_version": "0.1", "created": "2024-01-01T00:00:00Z", "entries": [{"id": 7, "source_path": "x.md", "source_hash": "h1", "blob_hash": "b1", "layer": "semantic"}]}


def test_manifests(spark):
    docs = [(1, json.dumps(MANIFEST)), (2, json.dumps(OLD)), (3, json.dumps(MANIFEST | {"version": "0.3"})), (4, "{"), (5, json.dumps(OLD | {"created": None}))]
    t = parse_manifests(spark.createDataFrame(docs, "doc_id int, text string"))
    assert {r.doc_id for r in t["rejects"].collect()} == {3, 4, 5}
    got = {r.context: r for r in t["source_files"].selectExpr("*", "to_json(extra) AS x").collect()}
    assert (got["demo"].path, got["demo"].x) == ("a.md", '{"odd":[1]}')
    assert (got["old"].root, got["old"].path, got["old"].hash, got["old"].hash_at_index, got["old"].blob_ref, got["old"].type, got["old"].x) == (".", "x.md", "h1", "h1", "b1", "semantic", '{"id":7}')
    config = {r.name: r.config for r in t["contexts"].collect()}
    assert config["demo"].store_raw_content is True and config["old"].notes_update_threshold_days == 7
    back = {r.name: json.loads(r.text) for r in write_manifest(t["contexts"], t["source_files"], t["note_files"], "2024-05-05T00:00:00Z", t["sources"]).collect()}
    want = MANIFEST | {"updated_at": "2024-05-05T00:00:00Z"}
    assert {k: v for k, v in back["demo"].items() if k != "config"} == {k: v for k, v in want.items() if k != "config"}
    assert back["demo"]["config"]["future"] == 3 and back["demo"]["config"]["store_raw_content"] is True
    again = parse_manifests(spark.createDataFrame([(1, json.dumps(back["old"]))], "doc_id int, text string"))
    assert again["source_files"].count() == 1 and again["rejects"].count() == 0


def tree(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return tmp_path


def test_corpus_and_ingest(spark, tmp_path):
    root = tree(tmp_path / "src" if (tmp_path / "src").mkdir() is None else tmp_path, a__md="# Title\nThe Parser reads Tokens and writes Trees for all of us.\n", b__md="1. run build\n2. install it\nresult: success\n", c__png="x", d__bin="x")
    files = list_corpus(spark, str(root), contents=True)
    assert {r.rel for r in files.select("rel").collect()} == {"a.md", "b.md", "c.png", "d.bin"}
    empty_manifest = spark.createDataFrame([], "context string, root string, added_at timestamp, path string, hash string, hash_at_index string, indexed_at timestamp, type string, blob_ref string, source_path string, source_size bigint, source_mtime bigint")
    now = F.lit("2024-01-01").cast("timestamp")
    none = index_units(units(spark, []), F.lit(0).cast("bigint"))
    none = {t: staged(df) for t, df in none.items()}

    def go(*given):
        made = ingest(*given, now)
        return made | {"manifest": staged(made["manifest"]), "index": {t: staged(df) for t, df in made["index"].items()}, "summary": staged(made["summary"])}

    out = go(files, empty_manifest, none)
    s = out["summary"].first()
    assert (s.indexed, s.denied, s.n_chunks) == (2, 2, 1) and out["errors"].count() == 0
    counts = audit.index_counts(out["index"]).first()
    assert counts.n_chunks == 1 and counts.n_procedures == 1
    again = go(files, out["manifest"], out["index"])
    assert again["summary"].first().already_indexed == 2 and audit.index_counts(again["index"]).first() == counts
    (root / "a.md").write_text("# Title\nThe Parser now calls Lexer and returns Nodes to us all.\n")
    changed = list_corpus(spark, str(root), contents=True)
    status = audit.context_status(out["manifest"], changed).first()
    assert (status.n_dirty, status.dirty_paths, status.n_indexed) == (1, ["a.md"], 1)
    redone = go(changed, out["manifest"], out["index"])
    assert redone["summary"].first().indexed == 1 and "Lexer" in redone["index"]["chunks"].first().content and redone["index"]["chunks"].count() == 1
    assert audit.context_status(redone["manifest"], changed).first().n_dirty == 0
    assert rebuild(changed, redone["manifest"], redone["index"], now)["summary"].first().indexed == 2
    path = write_index(redone["index"], str(tmp_path / "index"), "v1")
    assert "v1-" in path and read_index(spark, str(tmp_path / "index"))["chunks"].count() == 1


def test_blobs(spark):
    rows = units(spark, [("a", "same"), ("b", "same"), ("c", "other")])
    b = blobs_of(rows)
    assert b.count() == 2 and blobs_of(rows, b).count() == 0
    good, other = (r.blob_hash for r in b.orderBy(F.desc("payload")).collect())
    stored = b.where(F.col("blob_hash") == good).unionByName(spark.createDataFrame([("c", "sha256:" + "0" * 64, "sha256:" + "0" * 64, bytearray(b"t")), ("c", other, other, bytearray(b"changed"))], b.schema))
    m = spark.createDataFrame([("c", "r", "a", good), ("c", "r", "b", other), ("c", "r", "d", "sha256:1"), ("c", "r", "e", None)], "context string, root string, path string, blob_ref string")
    assert {r.path: r.verdict for r in audit.verify_blobs(m, stored).collect()} == {"a": "ok", "b": "tampered", "d": "missing"}
    assert [r.blob_hash for r in audit.orphan_blobs(m, stored).collect()] == ["sha256:" + "0" * 64]
    assert {r.path: r.text for r in read_blobs(m, stored).collect()} == {"a": "same", "b": None, "d": None, "e": None}


def test_stat_path(spark):
    m = spark.createDataFrame([("c", "r", "big.txt/chunk-0001.txt", "h", "h", None, "big.txt", 9 << 20, 1715000000)], "context string, root string, path string, hash string, hash_at_index string, blob_ref string, source_path string, source_size bigint, source_mtime bigint")
    hit = lambda s, t: sync.fully_indexed_by_stat(m, spark.createDataFrame([("c", "r", "big.txt", s, t)], "context string, root string, rel string, size bigint, mtime bigint")).count()
    assert (hit(9 << 20, 1715000000), hit((9 << 20) + 1, 1715000000), hit(9 << 20, 1715000001)) == (1, 0, 0)


def test_health(spark):
    from memspark.queries import QUERIES

    rows = QUERIES["g7_health_report"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 21 and {r.status for r in rows} == {"ok", "warn", "fail"}
    assert {(r.context, r.status) for r in rows if r.name == "manifest_version"} == {("c0", "ok"), ("c1", "ok"), ("c2", "fail")}
    assert audit.health_counts(spark.createDataFrame(rows)).count() == 3


def test_hashing_embedder():
    v = embed.hashing_embedder(32)(["Deploy the_app, deploy!", ""])
    assert v.shape == (2, 32) and abs(float((v[0] ** 2).sum()) - 1) < 1e-6 and not v[1].any()
    assert (embed.hashing_embedder(32)(["deploy THE_APP deploy"])[0] == v[0]).all()


def test_hashing_embedder_against_plain_counts(spark):
    """The registered query over a whole table equals signed token counts, written plainly."""
    got = QUERIES["e2_hashing_embedder"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        counts = [0.0] * 64
        for token in re.findall("[A-Za-z0-9_]+", texts[r.doc_id]):
            h = 1469598103934665603
            for b in token.lower().encode():
                h = (h ^ b) * 1099511628211 % 2**64
            counts[h % 64] += 1 - 2 * (h >> 8 & 1)
        length = sum(c * c for c in counts) ** 0.5 or 1
        assert r.embedding == pytest.approx([c / length for c in counts], abs=1e-6)


def test_stream(spark, tmp_path):
    """Each batch is planned and decoded; equal names in two folders are two sources; a later delivery replaces a source in all tables."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    said = "The Parser reads Tokens and writes Trees for all of us."
    for path, data in {"1/a/x.txt": said.encode(), "1/b/x.txt": said.encode("utf-16"), "1/c.html": b"<p>The Lexer calls Scanner today.</p>", "1/d.bin": b"\x00", "1/e.pdf": b"%PDF-1"}.items():
        (source / path).parent.mkdir(parents=True, exist_ok=True)
        (source / path).write_bytes(data)
    run = lambda: stream_ingest(spark, str(source), out, str(tmp_path / "cp"), deliveries=True).awaitTermination()
    run()
    sources = lambda name, column: sorted(r[column].removeprefix(f"{source}/") for r in latest(spark, out, name).select(column).distinct().collect())
    assert sources("chunks", "source_path") == sources("manifest", "path") == ["a/x.txt", "b/x.txt", "c.html"]
    assert [(r.source_rel, r.error) for r in latest(spark, out, "errors").collect()] == [("e.pdf", "decode")]
    for path, data in {"2/a/x.txt": b"- run make\n- install it\nresult: success", "2/b/x.txt": said.encode("utf-16"), "2/c.html": b"<p></p>"}.items():
        (source / path).parent.mkdir(parents=True, exist_ok=True)
        (source / path).write_bytes(data)
    run()
    run()
    assert sources("chunks", "source_path") == ["b/x.txt"] and sources("procedures", "source_path") == ["a/x.txt"]
    assert sources("manifest", "path") == ["a/x.txt", "b/x.txt", "c.html"]
    before = {t: latest(spark, out, t).count() for t in ("chunks", "entities", "procedures", "manifest")}
    again = list_corpus(spark, f"{source}/2", contents=True).withColumn("root", F.lit(str(source)))
    append_batch(out)(again, 1)  # a batch that was cut off runs again
    assert {t: latest(spark, out, t).count() for t in before} == before


def test_large_plain_text_is_streamed(spark):
    """Plain text has no limit and counts as indexed by size and time; a format has one, and counts by hash."""
    big = 300 * 2**20
    files = spark.createDataFrame([("c", "/r", n, z, m, h) for n, z, m, h in [("a.txt", big, 7, None), ("b.txt", big, 8, None), ("new.txt", big, 7, None), ("x.pdf", big, 7, "h"), ("s.txt", 10, 99, "h"), ("t.txt", 10, 7, "other")]], "context string, root string, rel string, size bigint, mtime bigint, hash string")
    known = [(n, "h", z) for n, z in [("a.txt", big), ("b.txt", big), ("x.pdf", big), ("s.txt", 10), ("t.txt", 10)]]
    manifest = spark.createDataFrame([("c", "/r", n, h, h, "semantic", None, n, z, 7) for n, h, z in known], "context string, root string, path string, hash string, hash_at_index string, type string, blob_ref string, source_path string, source_size bigint, source_mtime bigint")
    got = {r.rel: r.action for r in sync.plan_add(files, manifest).collect()}
    assert got == {"a.txt": "already_indexed", "b.txt": "needs_work", "new.txt": "needs_work", "x.pdf": "too_large", "s.txt": "already_indexed", "t.txt": "needs_work"}

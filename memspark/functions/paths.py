"""Column expressions on paths: what to skip, how to decode, note paths and topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension, lines

#: Folders that are not walked, files that are junk, extensions of known binary formats.
INFRASTRUCTURE = [".git", ".ctx", "target", "node_modules"]
JUNK = [".DS_Store", "Thumbs.db"]
DENIED = (
    "jpg jpeg png gif webp bmp tiff tif ico heic avif psd mp3 wav flac ogg m4a aac mp4 mov avi mkv webm wmv zip tar gz tgz bz2 xz 7z rar z "
    "exe dll so dylib o a lib class jar war ear wasm pyc pyo bin deb rpm dmg iso apk ipa ttf otf woff woff2 eot db sqlite sqlite3 mdb accdb"
).split()
#: Extensions by way of chunking.
CODE = "ts tsx js jsx rs py go java c cpp cs rb swift kt scala".split()
MARKUP = "md mdx rst".split()
SHEETS = "xlsx xlsm xls xlsb ods".split()
#: Fixed limits: bytes of a file for a format decoder; from where plain text is split; bytes of a unit.
FORMAT_LIMIT, STREAM_FROM, UNIT_BYTES = 256 << 20, 8 << 20, 1 << 20


def index_path(root: Column, path: Column) -> Column:
    """A source's name in the index: its path below its root, so equal paths of two roots stay apart."""
    return F.when(F.coalesce(root, F.lit("")).isin("", "."), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def classify_path(path: Column) -> Column:
    """keep, infrastructure, denied or junk."""
    return (
        F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, INFRASTRUCTURE))), "infrastructure")
        .when(F.coalesce(F.lower(extension(path)).isin(DENIED), F.lit(False)), "denied")
        .when(F.substring_index(path, "/", -1).isin(JUNK), "junk").otherwise("keep")
    )


def sniff_html(head: Column) -> Column:
    start = F.lower(F.substring(F.regexp_replace(head, r"^[\s\x{FEFF}]+", ""), 1, 64))
    return start.startswith("<!doctype html") | start.startswith("<html") | start.startswith("<?xml")


def route_decoder(path: Column, head: Column, size: Column) -> Column:
    """The decoder of a file from its path, the text of its first 4,096 bytes and its size; too_large beyond a format's limit; stream for large plain text."""
    ext, head = F.coalesce(F.lower(extension(path)), F.lit("")), F.coalesce(head, F.lit(""))
    format_ = (
        F.when((ext == "pdf") | head.startswith("%PDF-"), "pdf").when(ext.isin(SHEETS), "spreadsheet").when(ext.isin("html", "htm", "xhtml") | sniff_html(head), "html")
        .when(ext == "ipynb", "notebook").when((ext == "rtf") | head.startswith("{\\rtf"), "rtf").when(ext == "docx", "docx").when(ext == "pptx", "pptx").when(ext == "epub", "epub")
    )
    return F.when(format_.isNotNull(), F.when(size > FORMAT_LIMIT, "too_large").otherwise(format_)).when(size > STREAM_FROM, "stream").otherwise("plain")


def detect_chunker(path: Column, text: Column) -> Column:
    """structure, sentence, syntax or turn, by (case-sensitive) extension and content."""
    ext = F.coalesce(extension(path), F.lit(""))
    headed = F.exists(lines(text), lambda x: x.startswith("#"))
    return (
        F.when(ext.isin(MARKUP) & headed, "structure").when(ext.isin(CODE), "syntax")
        .when((ext == "jsonl") & (text.contains('"role"') | text.contains('"speaker"')), "turn").otherwise("sentence")
    )


def canonical_note_path(path: Column) -> Column:
    """Forward slashes, notes/ for the old folder's name, topics below notes/topics/."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(.*?)aura/", "$1notes/")
    p = F.when(p == "notes/aura.md", "notes/summary.md").otherwise(p)
    root = p.rlike("^notes/[^/]*$") & ~p.isin("notes/summary.md", "notes/index.md")
    return F.when(root, F.regexp_replace(p, "^notes/", "notes/topics/")).otherwise(p)


def valid_note_path(path: Column) -> Column:
    return path.startswith("notes/") & ~F.array_contains(F.split(path, "/"), "..")


def topic_slug(topic: Column) -> Column:
    """Lower-case ASCII letters, digits, - and _; other runs become -; null where no letter or digit is left."""
    base = F.regexp_replace(F.btrim(topic, F.lit(" \t\r\n")), r"\.md$", "")
    low = F.translate(base, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    slug = F.btrim(F.regexp_replace(low, "[^a-z0-9_-]+", "-"), F.lit("-"))
    return F.when(slug.rlike("[a-z0-9]"), slug)

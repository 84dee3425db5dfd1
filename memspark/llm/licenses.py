"""Fuzzy search for short licence notices.

Texts are folded to their words. A notice that may differ in k edits is split to k + 1 seeds; by the pigeonhole
principle any such copy holds one seed unchanged. An Aho-Corasick automaton finds all seeds of all notices in one
pass, and the regex library's bounded-error matching verifies the window around each and gives its edits. Words that name a licence must be
unchanged, so that one edit doesn't make another licence of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fold_words, small_batches

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as folded words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version": "gpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words of which one edit makes another licence, or none. A copy of a notice must hold those of the notice unchanged.
NAMING = frozenset("mit cc by sa nc rights".split())
#: One edit is allowed for so many characters of a notice, and no more than MOST_EDITS.
CHARS_PER_EDIT, MOST_EDITS = 12, 4


def whole_words(text: str, start: int, end: int) -> list[str]:
    """The words of a folded text that lie in a range, at least in part."""
    last = text.find(" ", end - 1 if text[end - 1 : end] != " " else end)
    return text[text.rfind(" ", 0, start) + 1 : len(text) if last < 0 else last].split()


class Notices:
    """Seeds and verifying patterns of a set of notices."""

    def __init__(self, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT, most: int = MOST_EDITS):
        self.notices, self.given = notices, (notices, chars_per_edit, most)
        self.edits = {n: min(most, len(n) // chars_per_edit) for n in notices}
        self.naming = {n: NAMING.intersection(n.split()) for n in notices}
        self.automaton = None

    def __reduce__(self):
        return Notices, self.given

    def seeds(self, notice: str) -> list[tuple[int, str]]:
        """(place in the notice, seed), one more than its edits."""
        k = self.edits[notice] + 1
        cuts = [len(notice) * i // k for i in range(k + 1)]
        return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def build(self) -> None:
        found: dict[str, list[tuple[str, int]]] = {}
        for n in self.notices:
            for at, seed in self.seeds(n):
                found.setdefault(seed, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in found.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()
        self.patterns = {n: regex.compile(rf"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") for n, e in self.edits.items()}

    def find(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, notice, edits) of the copies in a text of folded words joined by single spaces. Of overlapping copies the one with the fewest edits counts, of those the longest."""
        if self.automaton is None:
            self.build()
        windows: set[tuple[str, int]] = set()  # a seed's own window: a copy lies at most its edits off; an unchanged copy's seeds have one
        for last, (size, where) in self.automaton.iter(text):
            windows.update((notice, last + 1 - size - at) for notice, at in where)
        out = set()
        for notice, start in windows:
            k = self.edits[notice]
            m = self.patterns[notice].search(text, max(0, start - k), min(len(text), start + len(notice) + 2 * k))
            if m and m.end() > m.start() and self.naming[notice].issubset(whole_words(text, m.start(), m.end())):
                out.add((m.start(), m.end(), notice, sum(m.fuzzy_counts)))
        kept: list[tuple[int, int, str, int]] = []
        for one in sorted(out, key=lambda x: (x[3], x[0] - x[1], x[0], x[2])):
            k = bisect_right(kept, one)
            if not (k and kept[k - 1][1] > one[0]) and not (k < len(kept) and kept[k][0] < one[1]):
                kept.insert(k, one)
        return kept


def base_places(folded: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase in b' word word ... '."""
    out = []
    for phrase, label in BASE.items():
        wanted = b" " + phrase.encode() + b" "
        at, word, counted = folded.find(wanted), 0, 0
        while at >= 0:
            word, counted = word + folded.count(b" ", counted, at), at
            out.append((word, label))
            at = folded.find(wanted, at + 1)
    return out


def places_of_words(text: str) -> list[tuple[int, int]]:
    """Code point ranges of a text's words."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def scan(text: str | None, notices: Notices) -> dict:
    words = fold_words(text)
    joined = b" ".join(words)
    base = base_places(b" " + joined + b" ") if b"license" in joined else []
    plain = joined.decode("utf-8", "surrogatepass")
    found = notices.find(plain)
    spans = []
    if found:
        places = places_of_words(text)
        gaps = [m.start() for m in re.finditer(" ", plain)]
        for start, end, notice, edits in found:
            first, last = bisect_right(gaps, start), bisect_left(gaps, max(start, end - 1))
            spans.append({"label": notices.notices[notice], "notice": notice, "edits": edits, "start": places[first][0], "end": places[last][1]})
    labels = {label for _, label in base}
    starts = [at for at, _ in base]
    score = 1.0 if base else max((1 - s["edits"] / len(s["notice"]) for s in spans), default=0.0)
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s["label"] for s in spans})), "score": score, "spans": spans,
    }


def scan_licenses(documents: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    spans: label, notice, edits, start, end (code points of the text, whole words) of each notice found within its
    edits. Null and empty texts have no words, no labels and score 0. Repeated rows are scanned each; null ids stay null;
    other columns are not read.
    """
    small_batches(documents.sparkSession)
    known = Notices(notices)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [scan(t, known) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {n: [x[n] for x in found] for n in names}

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,notice:string,edits:int,start:int,end:int>>"
    return arrow_rows(documents.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)

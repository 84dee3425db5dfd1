import random
import re

from memspark.llm.licenses import BASE, NOTICES, Notices, scan, scan_licenses, whole_words


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts():
    rng = random.Random(3)
    pool = ["MIT", "license", "License", "apache", "general", "public", "LICENSE.", "é", "1", "licenses", "mit-license", "(MIT", "license)"]
    out = [None, "", "...", "MIT License MIT License", "the mit\nlicense", "général public license", "GNU General Public License, version 3"]
    return out + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["mit license " * 20000]


def test_base_equals_brute_force():
    known = Notices()
    for t in texts():
        r = scan(t, known)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if r["n_base"] else True)


def test_no_copy_within_its_edits_is_lost():
    rng, known = random.Random(4), Notices()
    for notice in NOTICES:
        for _ in range(15):
            k, x = known.edits[notice], list(notice)
            for _ in range(rng.randint(0, k)):
                i = rng.randrange(1, len(x) - 1)
                x[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
            copy = "".join(x)
            text = f"some words here {copy} and more words"
            found = known.find(text)
            if not known.naming[notice].issubset(copy.split()):
                continue
            assert any(s < 16 + len(copy) and e > 16 for s, e, *_ in found), (notice, copy)
            for s, e, n, d in found:
                assert d <= known.edits[n] and edits(n, text[s:e]) <= d


def test_labels_and_spans():
    known = Notices()
    r = scan("Intro é. Relased under the MIT Licence!\nLicensed under CC BY-NC 4.0. All rights reserved", known)
    assert r["labels"] == "all-rights-reserved,cc-by-nc,mit" and r["base_labels"] == "" and 0.8 < r["score"] <= 1
    text = "Intro é. Relased under the MIT Licence!\nLicensed under CC BY-NC 4.0. All rights reserved"
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["Relased under the MIT Licence", "Licensed under CC BY-NC 4.0", "All rights reserved"]
    assert scan("plain words only, nothing else", known)["labels"] == ""


def test_one_edit_makes_no_other_licence():
    known = Notices()
    label = lambda text: scan(text, known)["labels"]
    assert label("Licensed under CC BY-ND 4.0") == label("all nights reserved") == label("licensed under the mix license") == ""
    assert label("Licenced under CC BY-NC 4.0") == "cc-by-nc" and label("all rights reservd") == "all-rights-reserved"
    assert whole_words("one two three", 5, 6) == ["two"] and whole_words("one two three", 2, 9) == ["one", "two", "three"] and whole_words("one", 0, 3) == ["one"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "MIT License", "x"), (1, "MIT License", "x"), (None, None, "x"), (2, "", None)], "doc_id bigint, text string, labels string")
    got = scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.labels, r.score) for r in got) == [(0, 0, "", 0.0), (1, 1, "mit", 1.0), (1, 1, "mit", 1.0), (2, 0, "", 0.0)]
    assert scan_licenses(df.limit(0)).count() == 0


def test_copies_left_of_the_best_one_are_found():
    text = "mozila public license mozilla public license mozilla publik license"
    found = Notices().find(text)
    assert [(e, n) for _, _, n, e in found] == [(1, "mozilla public license"), (0, "mozilla public license"), (1, "mozilla public license")]


def test_every_one_of_adjacent_copies_is_found():
    rng, known = random.Random(6), Notices()
    for notice in NOTICES:
        for _ in range(12):
            text, places = "", []
            for _ in range(rng.randint(2, 5)):
                x = list(notice)
                for _ in range(rng.randint(0, known.edits[notice])):
                    i = rng.randrange(2, len(x) - 2)
                    x[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
                text += (" " if text else "") + "".join(x)
                places.append((len(text) - len(x), len(text)))
            found = [f for f in known.find(text) if f[2] == notice]
            for s, e in places:
                assert not known.naming[notice].issubset(text[s:e].split()) or any(min(e, b) - max(s, a) > (e - s) / 2 for a, b, *_ in found), (text, found)


def test_found_copies_equal_a_scan_of_all_windows():
    rng, known = random.Random(9), Notices({"alpha beta gamma delta": "x", "one two three four five six": "y"})
    pool = "alpha beta gama gamma delta delt one two thre three four five sixx six".split()
    for _ in range(40):
        text = " ".join(rng.choice(pool) for _ in range(40))
        spans = {(n, a) for n, k in known.edits.items() for a in range(len(text)) for b in range(a + len(n) - k, min(len(text), a + len(n) + k) + 1) if edits(n, text[a:b]) <= k}
        found = known.find(text)
        for n, a in spans:  # no copy is left that overlaps none of those found
            assert any(s < a + len(n) and e > a for s, e, *_ in found), (text, n, a)


def test_parameters_survive_pickling():
    import pickle

    known = pickle.loads(pickle.dumps(Notices({"one two three four": "x"}, chars_per_edit=6, most=2)))
    assert known.edits == {"one two three four": 2} and known.find("on two thre four")[0][3] == 2


def test_long_texts_take_linear_time():
    import time

    known, took = Notices(), []
    for n in (4000, 16000):
        began = time.perf_counter()
        r = scan("relased under the mit license, mozila public license " * n, known)
        took.append(time.perf_counter() - began)
        assert r["n_base"] == n and len(r["spans"]) == 2 * n
    assert took[1] < 8 * took[0]

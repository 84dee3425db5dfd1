"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns' spans always count. The field adds spans that the patterns miss (access tokens, spelled-out
addresses, numbers in other layouts). It is trained in numpy on a small labelled table and decoded by Viterbi over batches
of padded sequences. A sequence is a run of tokens around tokens with a digit, @, = or a cue word, with CONTEXT tokens of the
same line on either side; text outside of sequences holds no span of the field.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, shared_folder, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field, in the order of reports: the patterns' kinds, then its own.
ALL_KINDS = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
CONTEXT, OFFSETS = 6, (-2, -1, 0, 1, 2)
#: Tokens (padded) that are decoded at once.
BATCH_TOKENS = 200_000

LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

#: Prefixed keys and signed tokens, long runs, words, numbers, single signs.
TOKEN = re.compile(r"(?:[A-Za-z]{2,12}[_-]){1,3}(?=[A-Za-z]{0,40}[0-9])[A-Za-z0-9]{8,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){1,2}|[A-Za-z0-9]{16,}|[^\W\d_]+|[0-9]+|\S")
ANCHOR = re.compile(r"[0-9@=]|\b(?:at|dot|token|secret|password|key|bearer)\b")
#: Words that announce personal data.
CUES = frozenset("token key secret password passwd pwd bearer api tel phone call mobile fax email mail contact at dot com org net card visa ip host server".split())


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long texts cost linear time."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points of every kind."""
    digits = DIGITS.search(text) is not None
    number = lambda m: re.sub(r"[^0-9]", "", m[0])
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if digits else [],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(n := number(m)) <= 19 and luhn(n)] if digits else [],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(number(m)) <= 15] if "+" in text and digits else [],
    }


# --- tokens and their shapes -------------------------------------------------------------------

SHAPES = {s: i for i, s in enumerate(["edge", "word", "Word", "WORD", "wOrd", "x", *(f"d{k}" for k in range(1, 17)), "dlong", "mix", "hexlong", "mixlong", "keylong", *(f"cue:{c}" for c in sorted(CUES)), *(f"p:{c}" for c in "@.=+()-_\"':;,/!?#$%&*|<>[]{}\\~^`"), "other"])}


def shape(token: str) -> int:
    if token.isdigit() and token.isascii():
        return SHAPES[f"d{len(token)}" if len(token) <= 16 else "dlong"]
    low = token.lower()
    if low in CUES:
        return SHAPES[f"cue:{low}"]
    if token.isalpha():
        return SHAPES["x" if len(token) == 1 else "word" if token.islower() else "WORD" if token.isupper() else "Word" if token[1:].islower() else "wOrd"]
    if len(token) == 1:
        return SHAPES.get(f"p:{token}", SHAPES["other"])
    if "-" in token or "_" in token or "." in token:
        return SHAPES["keylong"]
    if len(token) >= 16:
        return SHAPES["hexlong" if all(c in "0123456789abcdef" for c in low) else "mixlong"]
    return SHAPES["mix"]


def tokens_of(line: str) -> list[tuple[int, int]]:
    """Spans of words, numbers and single signs; letters and digits that touch and are 16 or more together are one token."""
    return [m.span() for m in TOKEN.finditer(line)]


def sequences(text: str) -> list[tuple[list[tuple[int, int]], list[int], list[int]]]:
    """Token spans (in the text), shapes, and flags for white space before, of every sequence."""
    out, start = [], 0
    for line in text.split("\n"):
        if ANCHOR.search(line):
            spans = tokens_of(line)
            hot = [i for i, (a, b) in enumerate(spans) if ANCHOR.search(line, a, b)]
            k = 0
            while k < len(hot):
                low, high = max(0, hot[k] - CONTEXT), hot[k] + CONTEXT + 1
                while k + 1 < len(hot) and hot[k + 1] - CONTEXT <= high:
                    k += 1
                    high = hot[k] + CONTEXT + 1
                part = spans[low:high]
                before = [int(low + i == 0 or spans[low + i - 1][1] < a) for i, (a, _) in enumerate(part)]
                out.append(([(start + a, start + b) for a, b in part], [shape(line[a:b]) for a, b in part], before))
                k += 1
        start += len(line) + 1
    return out


# --- the field -----------------------------------------------------------------------------------


def padded(seqs: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (sequences x length x offsets) and mask; a feature is the shape at an offset with its white space flag."""
    n, longest = len(seqs), max(len(s) for s, _ in seqs)
    grid = np.zeros((n, longest + 4), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (shapes, before) in enumerate(seqs):
        grid[i, 2 : 2 + len(shapes)] = np.array(shapes) * 2 + np.array(before)
        mask[i, : len(shapes)] = True
    return np.stack([grid[:, 2 + o : 2 + o + longest] for o in OFFSETS], axis=2), mask


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


class Field:
    """Linear-chain CRF: weights[offset, feature, tag] for shapes, moves[tag, tag] between neighbours, first[tag] at the start."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(self.weights[k][features[:, :, k]] for k in range(len(OFFSETS)))

    def decode(self, seqs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Viterbi paths; sequences of like length are decoded together."""
        out: list[list[int]] = [[] for _ in seqs]
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i][0]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(seqs[order[stop]][0]) <= BATCH_TOKENS:
                stop += 1
            part = order[at:stop]
            features, mask = padded([seqs[i] for i in part])
            score = self.emissions(features)
            best, back = score[:, 0] + self.first, np.zeros(mask.shape + (len(TAGS),), np.int8)
            for t in range(1, mask.shape[1]):
                way = best[:, :, None] + self.moves
                back[:, t] = way.argmax(axis=1)
                best = np.where(mask[:, t, None], way.max(axis=1) + score[:, t], best)
            tag = best.argmax(axis=1)
            path = np.zeros(mask.shape, np.int64)
            for t in range(mask.shape[1] - 1, -1, -1):
                path[:, t] = tag
                if t:
                    tag = np.where(mask[:, t], back[np.arange(len(part)), t, tag], tag)
            for row, i in enumerate(part):
                out[i] = path[row, : len(seqs[i][0])].tolist()
            at = stop
        return out


def train(examples: list[tuple[list[int], list[int], list[int]]], rounds: int = 60, rate: float = 0.15, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by Adam on (shapes, space flags, tags); forward-backward gives the gradient."""
    features, mask = padded([(s, b) for s, b, _ in examples])
    n, longest = mask.shape
    k, f = len(TAGS), 2 * len(SHAPES)
    gold = np.zeros((n, longest), np.int64)
    for i, (_, _, tags) in enumerate(examples):
        gold[i, : len(tags)] = tags
    real = np.eye(k)[gold] * mask[:, :, None]
    both = (mask[:, 1:] & mask[:, :-1])[:, :, None, None]
    real_moves = (real[:, :-1, :, None] * real[:, 1:, None, :]).sum((0, 1))
    sizes = ((len(OFFSETS), f, k), (k, k), (k,))
    theta = [np.zeros(s) for s in sizes]
    m, v = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    last = mask.sum(1) - 1
    for step in range(1, rounds + 1):
        weights, moves, first = theta
        e = sum(weights[o][features[:, :, o]] for o in range(len(OFFSETS)))
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + moves, 1) + e[:, t]
        for t in range(longest - 2, -1, -1):
            value = log_sum(moves[None] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], value, 0)
        total = log_sum(ahead[np.arange(n), last], 1)
        marginal = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(np.minimum(ahead[:, :-1, :, None] + moves + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None], 0)) * both
        difference = real - marginal
        gw = np.zeros(sizes[0])
        for o in range(len(OFFSETS)):
            np.add.at(gw[o], features[:, :, o].ravel(), difference.reshape(-1, k))
        gradient = [gw, real_moves - pair.sum((0, 1)), difference[:, 0].sum(0)]
        for j in range(3):
            g = gradient[j] / n - penalty * theta[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            theta[j] = theta[j] + rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return Field(*theta)


# --- the small labelled table -----------------------------------------------------------------------


def forms(rng: random.Random) -> dict[str, dict[str, Callable[[], str]]]:
    """kind -> name -> maker of a span; kind "" makes look-alikes that are no personal data. ⟦ ⟧ stand around the span where it has company."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9)))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    digits = lambda *n: tuple("".join(rng.choice("0123456789") for _ in range(k)) for k in n)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz") for _ in range(n - 4)) + digits(4)[0]
    says = lambda *words: rng.choice(words)
    return {
        "email": {
            "plain": lambda: f"⟦{name()}@{name()}.org⟧", "dotted": lambda: f"⟦{name()}.{name()}@{name()}.co.uk⟧", "number": lambda: f"⟦{name()}{digits(2)[0]}@{name()}.example.com⟧", "under": lambda: f"⟦{name()}_{name()}@{name()}.net⟧",
            "spelled": lambda: f"⟦{name()} at {name()} dot com⟧", "brackets": lambda: f"⟦{name()} (at) {name()} (dot) net⟧", "squares": lambda: f"⟦{name()} [at] {name()} [dot] com⟧", "spelled dots": lambda: f"⟦{name()} dot {name()} at {name()} dot org⟧",
        },
        "ip": {"plain": lambda: "⟦" + ".".join(str(rng.randint(0, 255)) for _ in range(4)) + "⟧"},
        "card": {"run": lambda: f"⟦{digits(16)[0]}⟧", "spaces": lambda: "⟦" + " ".join(digits(4, 4, 4, 4)) + "⟧", "hyphens": lambda: "⟦" + "-".join(digits(4, 4, 4, 4)) + "⟧"},
        "phone": {
            "international": lambda: "⟦+{} {} {}⟧".format(*digits(2, 3, 7)), "brackets": lambda: "⟦({}) {}-{}⟧".format(*digits(3, 3, 4)), "hyphens": lambda: "⟦{}-{}-{}⟧".format(*digits(3, 3, 4)), "points": lambda: "⟦{}.{}.{}⟧".format(*digits(3, 3, 4)),
            "called": lambda: says("tel", "call", "phone", "mobile", "fax") + says(" ", ": ") + "⟦0{} {} {}⟧".format(*digits(2, 4, 4)), "slash": lambda: says("tel", "phone") + says(" ", ": ") + "⟦0{}/{}⟧".format(*digits(3, 7)),
            "long": lambda: "⟦+{}.{}.{}.{}⟧".format(*digits(2, 3, 3, 3)), "area": lambda: "⟦+1 ({}) {}-{}⟧".format(*digits(3, 3, 4)),
        },
        "secret": {
            "hex": lambda: f"⟦{hexes(rng.choice((32, 40, 64)))}⟧", "mixed": lambda: f"⟦{mixed(rng.randint(20, 40))}⟧", "upper": lambda: f"⟦AK{mixed(18).upper()}⟧", "prefixed": lambda: f"⟦{says('sk', 'pk')}-{says('live', 'test', 'prod')}-{mixed(rng.randint(16, 28))}⟧",
            "under": lambda: f"⟦{says('ghp', 'npm', 'xoxb', 'glpat')}_{mixed(rng.randint(20, 36))}⟧", "signed": lambda: f"⟦eyJ{mixed(20)}.{mixed(24)}.{mixed(30)}⟧",
            "bearer": lambda: f"Bearer ⟦{mixed(rng.randint(24, 40))}⟧", "password": lambda: says("password", "passwd", "pwd") + says("=", ": ", " = ") + f"⟦{name()}{digits(3)[0]}{name()}⟧",
        },
        "": {
            "year": lambda: digits(4)[0], "version": lambda: "version {}.{}".format(*digits(1, 1)), "points": lambda: "{}.{}.{}".format(*digits(1, 1, 2)), "percent": lambda: f"{digits(2)[0]}%", "sets": lambda: f"{word()} = {digits(2)[0]}",
            "date": lambda: f"{digits(4)[0]}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", "time": lambda: "{}:{}".format(*digits(2, 2)), "at": lambda: f"at the {word()}", "key": lambda: f"key {word()}", "count": lambda: f"{digits(3)[0]} {word()}", "money": lambda: "${}.{}".format(*digits(3, 2)),
            "bracket": lambda: f"({digits(4)[0]})", "numbered": lambda: f"{word()}{digits(2)[0]}", "thousands": lambda: "{},{}".format(*digits(3, 3)), "plus": lambda: f"+ {digits(2)[0]}", "handle": lambda: f"@{word()}", "millions": lambda: "{}.{}.{}".format(*digits(1, 3, 3)),
            "long run": lambda: digits(rng.choice((17, 20, 24)))[0], "called": lambda: f"call {word()} {digits(1)[0]}", "dot": lambda: f"a dot at {word()}", "password": lambda: f"password {word()}", "compound": lambda: f"{name()}-{name()}-{digits(4)[0]}", "ids": lambda: "{} {} {}".format(*digits(3, 2, 2)),
        },
    }


def labelled_sentences(count: int = 900, seed: int = 11, without: frozenset[tuple[str, str]] = frozenset(), only: tuple[str, str] | None = None) -> list[tuple[str, str]]:
    """(kind or '', sentence with the span in ⟦ ⟧): made-up sentences of plain, shouted and junk words, half with personal data.

    without: (kind, form) left out, so that recall can be measured on forms that the table lacks; only: that form alone.
    """
    rng = random.Random(seed)
    made = {k: [f for n, f in by.items() if (k, n) not in without and only in (None, (k, n))] for k, by in forms(rng).items()}
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9)))
    out = []
    for k in range(count):
        style = rng.choice(["plain", "plain", "plain", "shout", "junk"])
        filler = lambda style=style: {"plain": word(), "shout": word().upper() + "!!", "junk": word() + rng.choice(["***", "%%%", "$$$", "&&&", "###"])}[style]
        left, right = ([filler() for _ in range(rng.randint(0, 7))] for _ in "ab")
        if left:
            left[0] = left[0].capitalize()
        kind = only[0] if only else rng.choice(ALL_KINDS) if k % 2 else ""
        body = rng.choice(made[kind])()
        if kind == "secret" and body.startswith("⟦"):
            body = rng.choice(["token = \"{}\"", "key: {}", "api_key={}", "secret {}", "{}"]).format(body)
        out.append((kind, " ".join([*left, body + (rng.choice(["", "", ".", ","]) if kind else ""), *right])))
    return out


def examples_of(kind: str, sentence: str) -> list[tuple[list[int], list[int], list[int]]]:
    """(shapes, space flags, tags) of the sequences of a labelled sentence."""
    a, b = sentence.find("⟦"), sentence.find("⟧") - 1
    out = []
    for spans, shapes, before in sequences(sentence.replace("⟦", "").replace("⟧", "")):
        tags = [TAGS.index(f"{'B' if s == a else 'I'}-{kind}") if kind and s >= a and e <= b else 0 for s, e in spans]
        out.append((shapes, before, tags))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The training table (kind, sentence), written to the shared folder and read from there."""
    path = shared_folder(spark, "pii-labelled")
    spark.createDataFrame(labelled_sentences(), "kind string, sentence string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


FITTED: list["Field"] = []


def default_field(spark: SparkSession) -> Field:
    """The field fitted to labelled_table, once for a driver."""
    if not FITTED:
        FITTED.append(fit_field(labelled_table(spark)))
    return FITTED[0]


def fit_field(labelled: DataFrame, limit: int = 5000) -> Field:
    """Train on at most `limit` rows (kind, sentence with the span in ⟦ ⟧) of a labelled table."""
    rows = labelled.where("sentence is not null").orderBy(F.xxhash64("sentence")).limit(limit).collect()
    return train([x for r in rows for x in examples_of(r.kind or "", r.sentence)])


# --- the operator ---------------------------------------------------------------------------------


def plausible(kind: str, text: str, before: str = "", behind: str = "") -> bool:
    """Whether a span of the field may count; numbers of the patterns' kinds must pass the same tests and be no part of a longer number."""
    if kind in ("card", "phone") and (re.search(r"[0-9][\x20.-]?$", before) or re.match(r"[\x20.-]?[0-9]", behind)):
        return False
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return text.count(".") == 3 and all(p.isdigit() and int(p[:9]) <= 255 for p in text.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "email":
        return re.search(r"@.*(?:\.|\bdot\b)|\bat\b.*\bdot\b", text) is not None
    named = re.search(r"(?:password|passwd|pwd|secret|token|key)[\"']?\s?[=:]\s?[\"']?$", before, re.I) is not None
    return len(text) >= (8 if named else 16) and len(digits) >= (1 if named else 3) and len(digits) < len(text) and re.fullmatch(r"[A-Za-z0-9_.-]+", text) is not None


def find_all(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """For each text its spans: kind, start, end, whether a pattern found it; by kind, then start."""
    seqs, owner, found = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        found.append([(k, s, e, True) for k in KINDS for s, e in base[k]])
        for spans, shapes, before in sequences(text or ""):
            seqs.append((shapes, before))
            owner.append((i, spans))
    taken = [sorted((s, e) for _, s, e, _ in x) for x in found]
    for (i, spans), path in zip(owner, field.decode(seqs) if seqs else [], strict=True):
        t = 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            kind, first = (path[t] - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 * kind + 2:
                t += 1
            s, e = spans[first][0], spans[t - 1][1]
            k = bisect_right(taken[i], (s, s))
            clash = any(a < e and s < b for a, b in taken[i][max(0, k - 4) : k + 1])
            if not clash and plausible(ALL_KINDS[kind], texts[i][s:e], texts[i][max(0, s - 20) : s], texts[i][e : e + 2]):
                found[i].append((ALL_KINDS[kind], s, e, False))
    order = {k: n for n, k in enumerate(ALL_KINDS)}
    return [sorted(x, key=lambda y: (order[y[0]], y[1], y[2])) for x in found]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def find_pii(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (string), found (array of kind, start, end, base) of every row.

    Offsets are code points, end exclusive. Counts and base_sha256 are of the patterns' spans; spans and found also have
    the field's, which never overlap those. Null and empty texts have none. Repeated rows are searched each; null ids
    stay null; other columns are not read.
    """
    small_batches(documents.sparkSession)
    model = field or default_field(documents.sparkSession)
    arrays = model.weights, model.moves, model.first

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = find_all(rows["text"], Field(*arrays))
        base = [[y for y in x if y[3]] for x in found]
        return {
            "doc_id": rows["doc_id"], **{f"n_{k}": [sum(y[0] == k for y in x) for x in base] for k in KINDS},
            "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in found],
            "found": [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in x] for x in found],
        }

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,base:boolean>>"
    return arrow_rows(documents.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def mask_pii(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and text of every row, with each span replaced by its kind in angle brackets; a null text stays null."""
    small_batches(documents.sparkSession)
    model = field or default_field(documents.sparkSession)
    arrays = model.weights, model.moves, model.first

    def masked(text: str | None, spans: list[tuple]) -> str | None:
        out, at = [], 0
        for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [text[at:s], f"<{kind}>"]
            at = max(at, e)
        return "".join([*out, text[at:]]) if text is not None else None

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = find_all(rows["text"], Field(*arrays))
        return {"doc_id": rows["doc_id"], "text": [masked(t, x) for t, x in zip(rows["text"], found, strict=True)]}

    return arrow_rows(documents.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, text string")

"""SimHash near-duplicates with a pigeonring filter.

A fingerprint of 64 bits is cut into segments that lie on a ring. If two fingerprints differ in at most t bits
and there are m segments, then by the pigeonring principle some segment starts a chain whose first k segments differ in
at most k t / m bits, for every k.

Links by bits (`near_duplicates`, at most 2 bits). With three segments the chain's first two steps are made the join key:
the pair agrees in the first segment, and in the second after clearing at most one bit of the one that has it set. The
key holds about 42 bits, which keeps chance candidates rare at any corpus size. The chain's last step is the full
Hamming check. A fingerprint has at most 2,080 others within 2 bits, so links grow with the fingerprints.

Links by similarity (`similar_rows`, Jaccard similarity of word shingles). Pairs within REACH bits come from chains on a ring of
seven segments: the same two steps are the join key of 18 or 19 bits, the full Hamming check follows, and the shingle sets decide exactly.
No such pair is missed, and nothing else looks for it, but that large groups of near copies meet a head first.

A pair of similarity 0.8 differs in about 10 of 64 bits, and a chain's key for that many would be 3 or 4 bits. So the pairs beyond REACH bits,
and only these, are found in another way. Their join key is a band: the LEAST smallest shingles of a text in one of BANDS random orders,
which two texts share with a chance of about 0.8^5 a band. A chain of half the ring and the full Hamming check prune the pairs, and the sets
decide. Bands miss a pair at the bound with a chance of about 3 in a million. Sets of at most FEW shingles also meet in all their subsets
that lack one shingle, which misses none.

Before any join, documents are collapsed to distinct fingerprints or shingle sets, so large groups of copies cost one row.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import exploded
from .common import arrow_rows, cut_lineage, doc_id, joined_by_count, row_key, small_batches

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: (lowest bit, bits) of the segments of the ring for links by bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Hashes that are unpacked to bits at once.
BLOCK = 65536

#: Links by similarity: words of a shingle, similarity as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Random orders, shingles that make a band's key, and sets so small that their subsets are keys too.
BANDS, LEAST, FEW = 32, 5, 9
#: Ring for links by similarity, and the bits within which its chains find all pairs: fewer than segments, so that a chain begins with an equal one.
ARCS, REACH = (*((9 * k, 9) for k in range(6)), (54, 10)), 6
#: A key of more sets than this is that of a large group, whose sets meet a head before the chains are looked up.
CROWD = 16
#: Segments of 8 bits on the ring, and the bits in which a similar pair may differ: 5 standard deviations above the mean at 0.8.
RING, BUDGET = 8, 28
#: Odd factors of a shingle's words; masks and odd factors of the bands' orders.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
MASKS = np.array([xxhash.xxh64_intdigest(b"mask %d" % k) for k in range(BANDS)], np.uint64)
ORDERS = np.array([xxhash.xxh64_intdigest(b"order %d" % k) | 1 for k in range(BANDS)], np.uint64)
#: One part of the sets of a key for so many sets of all: a key with a third of all sets has a third of so many in a part.
PART_SETS = 50_000
#: Places of the bitmap that tells which documents to read again; a chance hit costs a needless read.
PLACES = 1 << 24


# --- fingerprints ----------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D], A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; no words give 0."""
    words = words_of(text)
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed bigint) of every row."""
    small_batches(documents.sparkSession)

    def run(rows: dict[str, list]) -> dict[str, list]:
        values = np.array([fingerprint(t, shingle) for t in rows["text"]], np.uint64)
        return {"doc_id": rows["doc_id"], "fp": values.view(np.int64)}

    return arrow_rows(documents.select(doc_id(), F.col("text").cast("string").alias("text")), run, "doc_id bigint, fp bigint")


# --- links by bits -----------------------------------------------------------------------------------


def bits_of(fp: Column, segment: int, ring: tuple = SEGMENTS) -> Column:
    low, width = ring[segment % len(ring)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def ring_keys(fps: DataFrame, probe: bool, ring: tuple = SEGMENTS) -> DataFrame:
    """fps with keys (ring start, first segment, second segment) of each fp; a probe also has those with one set bit of the second cleared."""

    def keys(start: int) -> Column:
        first, second = bits_of(F.col("fp"), start, ring), bits_of(F.col("fp"), start + 1, ring)
        head = F.lit(start << 50).cast("bigint").bitwiseOR(F.shiftleft(first, 22))
        own = F.array(head.bitwiseOR(second))
        if not probe:
            return own
        ones = F.array(*(F.lit(1 << b).cast("bigint") for b in range(ring[(start + 1) % len(ring)][1])))
        cleared = F.filter(ones, lambda bit: second.bitwiseAND(bit) != 0)
        return F.concat(own, F.transform(cleared, lambda bit: head.bitwiseOR(second.bitwiseXOR(bit))))

    return fps.select("*", F.explode(F.concat(*map(keys, range(len(ring))))).alias("key"))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Unordered pairs (a, b) of distinct fingerprints that differ in at most 2 bits, each once."""
    if not 0 <= distance <= 2:
        raise ValueError("the ring of three segments serves distances of 0 to 2")
    a, b = ring_keys(fps, True).withColumnRenamed("fp", "p"), ring_keys(fps, False).withColumnRenamed("fp", "q")
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= distance
    pairs = a.join(b, "key").where((F.col("p") != F.col("q")) & near)
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


# --- components --------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots: root is the component's smallest node.

    Alternating large-star and small-star rounds; every round is cut off in the shared folder. Rows per round never
    exceed the edges. Nodes with many neighbours are joined by a broadcast of at most some 2,000 rows.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())  # u > v

    def stars(pairs: DataFrame, large: bool, many: int) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        joined = joined_by_count(both, least, "u", 2 * many)
        if large:  # larger neighbours move to the smallest
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # smaller neighbours and the node itself move to the smallest
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    state = (pairs.count(), None)
    while state[0]:
        pairs = cut_lineage(stars(cut_lineage(stars(pairs, True, state[0])), False, state[0]))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_root(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """nodes with the root of their component; a node without edges is its own."""
    roots = components(edges)
    return nodes.join(roots, nodes[node] == roots["node"], "left").withColumn("root", F.coalesce("root", node)).drop("node")


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row.

    Texts whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest
    doc_id reachable over links, the row's own included. Null, empty and blank texts have fingerprint
    zero and are linked like any other. Repeated rows are kept and fall in one component. Rows with a null
    doc_id (or one that is no number) link like others; a component without any id has a null component_id.
    Other columns are not read.
    """
    prints = cut_lineage(fingerprints(documents, shingle))
    groups = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    rooted = cut_lineage(with_root(groups, links(groups.select("fp"), distance), "fp"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    found = joined_by_count(rooted.select("fp", "root", F.col("n").alias("rows")), cut_lineage(ids), "root", rooted.count())
    found = cut_lineage(found.select("fp", "component_id", F.col("rows").alias("n")))
    return joined_by_count(prints, found, "fp", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- links by similarity -------------------------------------------------------------------------------


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word shingles in ascending order; a shorter text is one shingle, no words are none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    codes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    code = np.fromiter((codes[w] for w in words), np.uint64, len(words))
    many = len(words) - WORDS + 1
    mixed = np.zeros(many, np.uint64)
    for k in range(WORDS):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * FACTORS[k] + code[k : k + many]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def name_of(hashes: np.ndarray, seed: int = 0) -> int:
    """A set's name: a signed hash of its elements."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed)).astype(np.int64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a set: for each order its least shingles, and for small sets all subsets that lack one or none."""
    n, keys = len(hashes), []
    if 1 < n <= FEW:
        keys = [name_of(hashes, 1), *(name_of(np.delete(hashes, k), 1) for k in range(n))]
    if n >= LEAST:
        least = np.empty((BANDS, 0), np.uint64)
        for k in range(0, n, BLOCK):
            least = np.concatenate((least, (hashes[None, k : k + BLOCK] ^ MASKS[:, None]) * ORDERS[:, None]), axis=1)
            if least.shape[1] > LEAST:
                least = np.partition(least, LEAST - 1, axis=1)[:, :LEAST]
        mixed = MASKS.copy()
        for column in np.sort(least, axis=1).T:
            mixed = (mixed ^ (mixed >> np.uint64(29))) * FACTORS[0] + column
        keys += (mixed ^ (mixed >> np.uint64(32))).view(np.int64).tolist()
    return keys


def keyed_rows(documents: DataFrame) -> DataFrame:
    """documents with k1, k2: 128 bits of (doc_id, text), which equal rows share."""
    return row_key(documents.select(doc_id(), F.col("text").cast("string").alias("text")))


def shingled(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2, set (its name), fp and keys of every row."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t) for t in rows["text"]]
        fps = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        return {**{k: rows[k] for k in ("doc_id", "k1", "k2")}, "set": [name_of(s) for s in sets], "fp": fps, "keys": [band_keys(s) for s in sets]}

    return arrow_rows(keyed_rows(documents), run, "doc_id bigint, k1 bigint, k2 bigint, set bigint, fp bigint, keys array<bigint>")


def within_budget(p: Column, q: Column, budget: int = BUDGET) -> Column:
    """Whether p and q differ in at most `budget` bits, found by a chain on the ring and then by the full Hamming check.

    A chain of half the ring starts somewhere whose first k segments differ in at most k * budget / RING bits, for every k.
    """
    x, width = p.bitwiseXOR(q), 64 // RING
    apart = [F.bit_count(F.shiftrightunsigned(x, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))) for k in range(RING)]
    chains = F.lit(False)
    for start in range(RING):
        holds, total = F.lit(True), F.lit(0)
        for k in range(RING // 2):
            total = total + apart[(start + k) % RING]
            holds = holds & (total * RING <= (k + 1) * budget)
        chains = chains | holds
    return chains & (F.bit_count(x) <= budget)


def bitmap(rows: DataFrame) -> np.ndarray:
    """PLACES bits, with those of k1 set; 2 MB for any number of rows."""
    at, width = F.pmod("k1", F.lit(PLACES)), 4096
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(PLACES // 8 + width, np.uint8)
    for r in parts:
        bits[(r["k"] - 1) * width : r["k"] * width] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def sets_of(members: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """set, hashes, size and shared (shingles that another member has too) of the sets named in members.

    Only the members' sets are made again and shuffled, never texts. A shingle that no other member has is in no overlap.
    """
    wanted = members.select("set").distinct()
    bits = bitmap(nodes.join(wanted, "set", "left_semi").select("k1"))
    place = F.pmod("k1", F.lit(PLACES))
    number = (F.bitmap_bucket_number(place) - 1) * 32768 + F.bitmap_bit_position(place)

    def run(rows: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t) for t, k in zip(rows["text"], rows["place"], strict=True) if bits[k >> 3] >> (k & 7) & 1]
        return {"set": [name_of(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]}

    made = arrow_rows(keyed_rows(documents).select("text", number.alias("place")), run, "set bigint, hashes array<bigint>")
    sets = cut_lineage(made.join(wanted, "set", "left_semi").dropDuplicates(["set"]).withColumn("size", F.size("hashes")))
    alone = exploded(sets, ["set"], "hashes", "_pos", "hash").groupBy("hash").agg(F.min("set").alias("set"), F.count("*").alias("n")).where("n = 1")
    own = alone.groupBy("set").agg(F.count("*").alias("own"))
    return cut_lineage(sets.join(own, "set", "left").select("set", "hashes", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")))


def apart(p: str, q: str) -> Column:
    """The bits in which the fingerprints differ."""
    return F.bit_count(F.col(p).bitwiseXOR(F.col(q)))


def chained(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of rooted (set, fp, root) in different components whose fingerprints differ in at most REACH bits, each once.

    With t bits on m > t segments some chain has an equal first segment and at most 2 t / m < 2 differing bits in the first two. A key of
    more than PART_SETS sets is cut to parts, each of which meets all probes.
    """
    nodes = rooted.select("set", "fp", "root")
    own, probes = ring_keys(nodes, False, ARCS), ring_keys(nodes, True, ARCS)
    parts = cut_lineage(own.groupBy("key").agg((1 + F.count("*") / PART_SETS).cast("int").alias("parts")).where("parts > 1"))
    if not parts.isEmpty():
        dealt = lambda rows, part: rows.join(F.broadcast(parts), "key", "left").withColumn("part", part).drop("parts")
        many = F.coalesce("parts", F.lit(1))
        own, probes = dealt(own, F.pmod(F.xxhash64("set"), many).cast("int")), dealt(probes, F.explode(F.sequence(F.lit(0), many - 1)))
    on = [c for c in ("key", "part") if c in own.columns]
    side = lambda rows, name: rows.select(*on, F.struct("set", "fp", "root").alias(name))
    pairs = side(probes, "p").join(side(own, "q"), on).where((F.col("p.root") != F.col("q.root")) & (apart("p.fp", "q.fp") <= REACH))
    return cut_lineage(pairs.select(F.least("p.set", "q.set").alias("a"), F.greatest("p.set", "q.set").alias("b")).distinct())


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and similar of pairs (a, b) of sets."""
    side = lambda name, hashes: sets.select(F.col("set").alias(name), F.col("hashes").alias(hashes))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    over, under = SIMILAR
    return cut_lineage(both.select("a", "b", (F.col("common") * (over + under) >= (F.size("x") + F.size("y")) * over).alias("similar")))


def headed(rows: DataFrame, first: Column, part: Column) -> DataFrame:
    """rows (key, set, ...) that aren't heads, with head: a struct that begins with `first`, then set, fp, size, shared where rows have them.

    The sets of a key are dealt to parts; a set's head is the least of its part, and that of the least of a part the least of the key.
    So no task holds the rows of a key, however many there are.
    """
    turn = F.struct(first.alias("first"), *(c for c in rows.columns if c != "key"))
    in_part = rows.withColumn("head", F.min(turn).over(Window.partitionBy("key", part)))
    own = F.col("head.set") == F.col("set")
    of_key = in_part.where(own).withColumn("head", F.min(turn).over(Window.partitionBy("key")))
    return in_part.where(~own).unionByName(of_key.where(~own))


def prefixes(left: DataFrame) -> DataFrame:
    """token, pos, set, root, fp, size, shared of the shingles by which similar sets of left (set, root, fp, size, hashes) must meet.

    The shingles that other sets have are put in one order, rare ones first. A similar pair has 0.8 of either set in common, so it
    meets in what a set has before its last 0.8 less one: in words that few texts have, not in those of a template.
    """
    over, under = SIMILAR
    rows = exploded(left, ["set"], "hashes", "_pos", "hash")
    often = cut_lineage(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").withColumn("often", F.col("n")))
    many = left.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    order = joined_by_count(rows, often, "hash", many).groupBy("set").agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("order"))
    shared = left.drop("hashes", "shared").join(order, "set").withColumn("shared", F.size("order"))
    kept = shared.withColumn("kept", F.col("shared") - F.ceil(F.col("size") * over / under).cast("int") + 1).where("kept > 0")
    out = exploded(kept, ["set", "root", "fp", "size", "shared"], F.slice("order", 1, F.col("kept")), "pos", "o")
    return cut_lineage(out.select(F.col("o.hash").alias("token"), "pos", "set", "root", "fp", "size", "shared"))


def meetings(tokens: DataFrame) -> DataFrame:
    """Pairs (p, q) of rows of prefixes that share a token, p the smaller set, and of another component.

    The smaller one of a similar pair shares enough of its shingles for a partner of its own size. A token of more than PART_SETS
    rows is cut to parts of q, each of which meets p.
    """
    over, under = SIMILAR
    counts = cut_lineage(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", (1 + F.col("n") / PART_SETS).cast("int")))
    rows = cut_lineage(joined_by_count(tokens, counts, "token", tokens.count()))
    side = F.struct("pos", "set", "root", "fp", "size", "shared")
    p = rows.where(F.col("shared") * (over + under) >= 2 * over * F.col("size")).select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), side.alias("p"))
    q = rows.select("token", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), side.alias("q"))
    first = F.struct("p.size", "p.set") < F.struct("q.size", "q.set")
    return p.join(q, ["token", "part"]).where(first & (F.col("p.root") != F.col("q.root")))


def may_link() -> Column:
    """Whether bits (beyond those of `chained`), sizes and what follows the token in either order allow the similarity: t = p / q needs an overlap of p (|a| + |b|) / (p + q)."""
    over, under = SIMILAR
    most = F.least(F.col("p.shared") - F.col("p.pos"), F.col("q.shared") - F.col("q.pos"))
    beyond = apart("p.fp", "q.fp") > REACH
    return beyond & (most * (over + under) >= (F.col("p.size") + F.col("q.size")) * over) & within_budget(F.col("p.fp"), F.col("q.fp"))


def merged(rooted: DataFrame, found: DataFrame) -> DataFrame:
    """rooted (set, root, ...) after the components of the pairs found (a, b) of sets have become one."""
    if found.isEmpty():
        return rooted
    of = lambda s: rooted.select(F.col("set").alias(s), F.col("root").alias(f"root_{s}"))
    edges = found.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return cut_lineage(with_root(rooted.withColumnRenamed("root", "first"), edges, "first").drop("first"))


def with_sets(sets: DataFrame, pairs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """sets and those of the pairs (a, b) that it lacks."""
    lacking = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sets, "set", "left_anti")
    return sets if lacking.isEmpty() else sets.unionByName(sets_of(lacking, nodes, documents))


def similar_roots(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """set, n, root of all sets (nodes: set, fp, k1, keys, n): the components of all similar pairs within REACH bits, and of those beyond that share a band.

    A set that shares less than 0.8 of its shingles with all others that it meets in a band has no partner there. Sets of a band are first compared with
    a head: the set with the smallest share of shingles of its own, which is the one that copies of a text are most alike. With a head are
    compared the sets beyond REACH bits, and in bands of more than CROWD sets all, which puts a large group of near copies in one component, with few pairs a set.
    Then the chains find the links within REACH bits between components, and those beyond are found where sets of bands that still hold several
    components meet in a rare shingle (`prefixes`), so a template that many unlike texts share makes no pairs.
    """
    over, under = SIMILAR
    part = F.pmod(F.xxhash64("set"), F.lit(1 + nodes.count() // PART_SETS))
    met = cut_lineage(headed(exploded(nodes, ["set", "fp"], "keys", "_pos", "key").select("key", "set", "fp"), F.xxhash64("set"), part))
    members = met.select("key", "set", "fp").unionByName(met.select("key", "head.set", "head.fp")).distinct()
    sets = sets_of(members, nodes, documents)
    able = sets.where(F.col("shared") * under >= F.col("size") * over)
    members = cut_lineage(members.join(able.drop("hashes"), "set").select("key", "set", "fp", "size", "shared"))
    stars = headed(members, 1 - F.col("shared") / F.col("size"), part).where(apart("fp", "head.fp") <= BUDGET)
    crowds = members.groupBy("key").agg(F.count("*").alias("in_key")).where(F.col("in_key") > CROWD)
    pair = [F.least("set", "head.set").alias("a"), F.greatest("set", "head.set").alias("b")]
    pairs = stars.join(crowds, "key", "left").groupBy(*pair).agg(F.max(F.col("in_key").isNotNull()).alias("crowd"), F.first(apart("fp", "head.fp")).alias("apart"))
    pairs = cut_lineage(pairs)

    first = pairs.where(F.col("crowd") | (F.col("apart") > REACH)).select("a", "b")
    rooted = cut_lineage(with_root(nodes.select("set", "fp", "n"), overlaps(first, able).where("similar"), "set"))
    near = chained(rooted)

    placed = cut_lineage(members.select("key", "set", "fp").join(rooted.select("set", "root"), "set"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = placed.join(mixed, "key", "left_semi").select("set", "fp", "root").distinct()
    left = cut_lineage(left.join(able, "set"))
    more = cut_lineage(meetings(prefixes(left)).where(may_link()).select(F.least("p.set", "q.set").alias("a"), F.greatest("p.set", "q.set").alias("b")).distinct())
    found = near.unionByName(more)
    return merged(rooted, found if found.isEmpty() else overlaps(found, with_sets(sets, near, nodes, documents)).where("similar")).select("set", "n", "root")


def similar_rows(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2, set and root of every row: rows of a root are near-duplicates of each other.

    Texts whose sets of five-word shingles (A-Z lower-cased, words as in `near_duplicates`) have a Jaccard similarity of 0.8
    or more are linked; all links count. Null, empty and blank texts are alike. k1, k2 are hashes of (doc_id, text).
    """
    small_batches(documents.sparkSession)
    rows = cut_lineage(shingled(documents))
    nodes = cut_lineage(rows.groupBy("set").agg(F.min("k1").alias("k1"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    return joined_by_count(rows.drop("keys", "fp"), similar_roots(nodes, documents), "set", rows.count())


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents without the near-duplicates of `similar_rows`: of each group one row stays, that with the smallest doc_id.

    Rows without an id come last in a group; of rows with one id that with the smaller hash of its text stays, and of equal
    rows one. Rows with one id whose texts are not similar are no duplicates. An empty table stays empty; all columns are kept.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    stays = similar_rows(documents).groupBy("root").agg(F.min(order).alias("row")).select("row.k1", "row.k2")
    keyed = row_key(documents.withColumn("_id", F.col("doc_id").try_cast("bigint")), "_id").drop("_id")
    return keyed.join(stays, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*documents.columns)

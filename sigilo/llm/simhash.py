"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into segments on a ring. If two fingerprints differ in at
most t bits, then from some segment on, every chain of l consecutive segments
differs in at most l * t / segments bits.

``near_dedup`` links fingerprints at a small distance: the first CHAIN segments
from each start are a key: one side of a join sends it as it is, the other
with every change that these budgets allow; what meets must keep within the
budgets of all longer chains from that start, and the longest chain is the
whole fingerprint. Equal fingerprints are one row from the start, so neither a
hot group of copies nor its pairs are ever expanded.

``near_texts`` links texts whose shingle sets have a Jaccard similarity of 0.8
or more. Their fingerprints may differ in a third of the bits, where no chain
of segments is a selective key; so texts meet by BANDS keys of ROWS
min-hashes each, of which two texts of similarity 0.8 share none once in some
300,000 pairs. Pairs are pruned by the pigeonring's chains at WIDE bits (a pair
at 0.8 differs in 10 bits on average, 26 lie 5 standard deviations off), and
what is left links if its similarity, computed over both whole sets, is at
least the limit. Every member of a bucket is first checked against two pivots,
the one of the smallest id and one by chance. The members of buckets that still
hold several components then meet by rare shingles: two sets of that similarity
share one of the rarest fifth of their shingles, whichever order by rarity is
taken, so only pairs across components that share such a one are checked. Large
groups of texts that are alike, but less than the limit, have few of these in
common and cost little. What two members of one component would add to it is
nothing, so a large group of copies costs a pair each, and the components are
those of all pairs that meet. Equal sets are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, Scratch, checkpointed, merged, parts, place_of, scratch
from .components import connected_components

BITS, SEGMENTS, CHAIN = 64, 4, 2
WIDTH = BITS // SEGMENTS
SEED = 42
#: Of ``near_texts``: words of a shingle, similarity, min-hash keys and their rows, and the pruning distance over RING segments.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
WIDE, RING = 26, 8
#: Parts into which a text's partners are dealt where the text's set is sent to them.
SALTS = 32
_rng = np.random.default_rng(20240611)
FACTORS = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a whole text's word shingles, repeats included; fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[lo : lo + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a whole text: majority of XXH64 bits over word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def allowed_changes(distance: int) -> list[int]:
    """Changes of a key of CHAIN segments whose every prefix stays within its budget."""
    budget = [(k + 1) * distance // SEGMENTS for k in range(CHAIN)]
    if budget[0]:
        raise ValueError(f"distance must be below {SEGMENTS}, the number of segments; near_texts links texts further apart")
    out = []
    for n in range(budget[-1] + 1):
        for bits in combinations(range(CHAIN * WIDTH), n):
            mask = sum(1 << b for b in bits)
            used = [sum(b >= (CHAIN - 1 - k) * WIDTH for b in bits) for k in range(CHAIN)]
            if all(u <= b for u, b in zip(used, budget, strict=True)):
                out.append(mask)
    return out


def turned(fp: Column, start: int, segments: int) -> Column:
    """The fingerprint turned so that segment ``start`` comes first."""
    n = start * (BITS // segments)
    return fp if n == 0 else F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, BITS - n))


def chain_key(fp: Column, start: int) -> Column:
    """The CHAIN segments from ``start`` on the ring, and the start, in one integer."""
    return F.shiftrightunsigned(turned(fp, start, SEGMENTS), BITS - CHAIN * WIDTH).bitwiseOR(F.lit(start << (CHAIN * WIDTH)))


def within(diff: Column, start: int, distance: int, segments: int, least: int = 1) -> Column:
    """Whether every chain of ``least`` segments or more from ``start`` keeps within its budget; the longest is all bits."""
    ring, width = turned(diff, start, segments), BITS // segments
    ok = F.lit(True)
    for n in range(least, segments + 1):
        ok = ok & (F.bit_count(F.shiftrightunsigned(ring, BITS - n * width)) <= n * distance // segments)
    return ok


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that differ in 1 to ``distance`` bits, found by pigeonring."""
    starts = F.array(*[F.struct(chain_key(F.col("fp"), k).alias("key"), F.lit(k).alias("start")) for k in range(SEGMENTS)])
    keyed = fps.select("fp", F.explode(starts).alias("s")).select("fp", "s.key", "s.start")
    masks = allowed_changes(distance)
    # A single changed bit is tried from the side that has it unset: each such pair meets once.
    tried = keyed.select("fp", "key", "start", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    tried = tried.filter((F.bit_count("mask") != 1) | (F.col("key").bitwiseAND(F.col("mask")) == 0))
    left = tried.select(F.col("fp").alias("u"), "start", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    met = left.join(merged(keyed.select(F.col("fp").alias("v"), "key")), "key").filter(F.col("u") != F.col("v"))
    diff, ok = F.col("u").bitwiseXOR(F.col("v")), F.lit(False)
    for k in range(SEGMENTS):  # longer chains from the start that met, and last all bits
        ok = F.when(F.col("start") == k, within(diff, k, distance, SEGMENTS, CHAIN + 1)).otherwise(ok)
    return met.filter(ok).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_dedup(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_links of every row.

    component_id is the smallest id reachable over links; n_links counts the
    other fingerprints linked directly. Null and empty texts and texts of
    white space have fingerprint zero and are linked like any other. Null ids
    get their component like others but never name one unless all are null.
    Repeated rows and ties share a fingerprint and so a component. Whole texts
    are read, however long. Other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = checkpointed(links(fps, distance))
    roots = connected_components(edges)
    degree = edges.select(F.col("u").alias("fp")).unionByName(edges.select(F.col("v").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    owned = fps.join(merged(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = owned.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = owned.join(merged(names), "root").join(merged(degree), "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(merged(classes), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# Texts of a given similarity.


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: its min-hashes, and the band, in one integer."""
    low = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(found), 1024):
        x = found[lo : lo + 1024] * FACTORS + SHIFTS
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=1, keepdims=True))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(low.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, place, digest, size, fp, keys) of every row: its set's 128-bit digest and size, its fingerprint and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array([band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "place", "digest", "size", "fp", "keys"],
            )

    return docs.mapInArrow(run, f"doc_id long, place {PLACE}, digest binary, size long, fp long, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, keep: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have at least the similarity."""
    pairs = keep(pairs.select("u", "v").distinct(), f"{name}-pairs")
    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in part.column(2).to_pylist()]
            own = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "body"]).filter(pa.array(own, pa.bool_()))

    # A node's text is that of the row it is named for; rows that share the row's hash by chance have another digest.
    own = nodes.join(needed, "node", "left_semi").select("node", "digest", F.col("first.place").alias("place"))
    sets = docs.join(own, "place").select("node", "digest", "text").mapInArrow(sets_of, "node long, body binary")
    sets = keep(sets.groupBy("node").agg(F.first("body").alias("body")), f"{name}-sets")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    to_u = salted.select("u", "salt").distinct().join(sets.select(F.col("node").alias("u"), F.col("body").alias("a")), "u")
    met = salted.join(sets.select(F.col("node").alias("v"), F.col("body").alias("b")), "v").join(to_u, ["u", "salt"]).select("u", "v", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in both]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    out = keep(met.mapInArrow(check, "u long, v long"), name)
    keep.drop(f"{name}-sets")
    return out


def rare_shingles(rest: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, keep: Scratch) -> DataFrame:
    """(node, h, n, at): of every node of ``rest`` the shingles that some similar set must share, rarest among these nodes first.

    A set of n shingles shares ceil(similarity * n) with a similar one, so one
    of its n - ceil(similarity * n) + 1 rarest. Shingles of one node alone come
    first and take their places in ``at``, but are left out; ``n`` is the number
    of nodes that have the shingle.
    """

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in part.column(2).to_pylist()]
            own = [s if xxhash.xxh3_128_digest(s.tobytes()) == d else s[:0] for s, d in zip(sets, part.column(1).to_pylist(), strict=True)]
            node = np.repeat(part.column(0).to_numpy(), [len(s) for s in own])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(own).view(np.int64))], ["node", "h"])

    own = nodes.join(rest.select("node"), "node", "left_semi").select("node", "digest", "size", F.col("first.place").alias("place"))
    texts = docs.join(own, "place").select("node", "digest", "text").dropDuplicates(["node", "text"])
    each = keep(texts.mapInArrow(shingles_of, "node long, h long"), "shingles")
    common = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    of_node = Window.partitionBy("node")
    placed = each.join(common, "h").withColumn("at", F.row_number().over(of_node.orderBy("n", "h"))).withColumn("m", F.count("*").over(of_node))
    prefix = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    placed = placed.join(own.select("node", "size"), "node").withColumn("at", F.col("size") - F.col("m") + F.col("at"))
    return placed.filter(F.col("at") <= prefix).select("node", "h", "n", "at")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets' Jaccard similarity is at least the limit."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def near_texts(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place, component_id, stays of every row: components over pairs of similar texts.

    ``place`` is 128 hash bits of id and text. component_id is the smallest
    id of the component; null ids never name one unless all are null. In each
    component the row of the smallest id (then of the smallest place) stays,
    and rows that repeat it as a whole are marked alike. Different texts of one
    id are rows of their own. Null and empty texts and texts without a word
    are equal to each other. Whole texts are read, however long; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), place_of(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession, "near") as keep:
        return checkpointed(near_in(docs, shingle, similarity, keep))


def near_in(docs: DataFrame, shingle: int, similarity: float, keep: Scratch) -> DataFrame:
    """``near_texts`` of (doc_id, place, text), with what it writes on the way in ``keep``."""
    rows = keep(sketches(docs, shingle), "rows")
    # Equal sets are one node, named for the row that would stay; its number is written with it.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    nodes = rows.groupBy("digest").agg(F.min(first).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    last = F.lit((1 << 63) - 1)
    keyed = keep(nodes.select(F.explode("keys").alias("key"), F.struct(F.coalesce("first.doc_id", last).alias("id"), "node", "size", "fp").alias("n")), "keyed")
    # Pivots of a bucket: its smallest id, and one by chance.
    chance = F.struct(F.xxhash64("key", "n.node").alias("h"), "n")
    pivots = keyed.groupBy("key").agg(F.min("n").alias("p"), F.min(chance).alias("r"), F.count("*").alias("members")).filter("members > 1")
    met = keep(keyed.join(pivots, "key").select("key", "n", "p", F.col("r.n").alias("r")), "met")
    keep.drop("keyed")

    def near(a: Column, b: Column) -> Column:
        """Whether sizes and fingerprints allow the similarity."""
        diff, ring = a["fp"].bitwiseXOR(b["fp"]), F.lit(False)
        for k in range(RING):
            ring = ring | within(diff, k, WIDE, RING)
        return (F.least(a["size"], b["size"]) >= similarity * F.greatest(a["size"], b["size"]) - 1e-9) & ring

    tried = met.select("n", F.explode(F.array("p", "r")).alias("p")).filter((F.col("n.node") != F.col("p.node")) & near(F.col("n"), F.col("p")))
    edges = verified(tried.select(F.least("p.node", "n.node").alias("u"), F.greatest("p.node", "n.node").alias("v")), docs, nodes, shingle, similarity, keep, "near")
    roots = connected_components(edges)

    # Buckets that still hold several components: their members meet once more, by rare shingles.
    own = met.select("key", F.col("n.node").alias("node"), "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rest = keep(own.join(several, "key", "left_semi").select("node", F.col("n").alias("set"), "root").distinct(), "rest")
    keep.drop("met")
    rare = keep(rare_shingles(rest, docs, nodes, shingle, similarity, keep), "rare")
    keep.drop("shingles")
    # Shingles of the same nodes bring the same pairs: the first in order is enough.
    of_nodes = rare.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    rare = rare.join(of_nodes.filter("k > 1").groupBy("k", "x", "y").agg(F.min(F.struct("n", "h")).alias("first")).select("first.h"), "h", "left_semi")
    side = lambda x: rare.join(rest, "node").select("h", F.struct("set.*", "at").alias(x), F.col("root").alias(f"{x}_root"))
    # The first shingle that two sets share leaves them enough behind it.
    behind = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) + 1
    enough = behind >= similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - 1e-9
    crossed = side("a").join(side("b"), "h").filter((F.col("a.node") < F.col("b.node")) & (F.col("a_root") != F.col("b_root")) & enough & near(F.col("a"), F.col("b")))
    more = verified(crossed.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), docs, nodes, shingle, similarity, keep, "more")
    # What was found first is settled: only its components are tied to each other.
    tied = more.join(roots.select(F.col("node").alias("u"), F.col("root").alias("u_root")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("v_root")), "v", "left")
    over = connected_components(tied.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    named = nodes.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(over.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").withColumn("root", F.coalesce("over", "root"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    classes = named.join(best, "root").select("digest", "best")
    out = rows.select("doc_id", "place", "digest").join(classes, "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("place") == F.col("best.place"))
    return out.select("doc_id", "place", F.col("best.doc_id").alias("component_id"), stays.alias("stays"))

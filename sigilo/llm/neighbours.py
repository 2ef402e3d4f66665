"""Approximate nearest neighbours by shifted space-filling curves.

Vectors that are equal become one row with their smallest ids. The rest are
rotated at random and shifted, once for each ordering, and a few coordinates
are turned into a key on a Hilbert curve. Spark range-partitions the keys of
each ordering, which gives every vector a rank. Queries are compared with all
vectors whose rank is within ``window`` of theirs in any ordering, in blocks of
neighbouring ranks; blocks return their best rows, which merge and rerank by
the inner product of the original vectors in double precision.

How wide a window must be depends on the data. It is measured: for a bounded
sample of queries all true neighbours are found, in blocks, and the window is
the quantile of the rank distance at which the wanted part of them is met in
some ordering. Vectors without structure need wide windows, clustered ones
narrow ones; no neighbour is promised, the recall is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ORDERINGS, DIMS, BITS = 6, 6, 8
#: A block is as wide as the window, within these bounds: a query meets three blocks of each ordering.
BLOCK = (1024, 65536)
#: Queries whose true neighbours are found to set the window; a documented bound.
CALIBRATION = 128
#: Scores that are held at once.
SCORES = 4_000_000
RECALL = 0.97
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x d integers below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(width: int, orderings: int, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A projection and a shift for each ordering, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return [(np.linalg.qr(rng.standard_normal((width, width)))[0][:, : min(dims, width)], rng.random(min(dims, width))) for _ in range(orderings)]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, finite throughout, not zero."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def smallest(ids: Column, n: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(ids)), 1, n)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, v, ids): equal vectors as one row with their ``keep`` smallest ids, gathered in two levels."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    few = rows.groupBy("v", part.alias("part")).agg(smallest(F.collect_list("vec_id"), keep).alias("ids"))
    return few.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids")), keep).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def ranked(points: DataFrame, width: int, orderings: int, dims: int, bits: int) -> DataFrame:
    """(ordering, rank, rep): every vector's rank along each curve; ranks start at 0."""
    plans = projections(width, orderings, dims)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            for o, (p, shift) in enumerate(plans):
                # Coordinates of a unit vector are about 1/sqrt(width) wide; outliers share the outer cells.
                u = (v @ p) * np.sqrt(width) / 6 + 0.5 + (shift - 0.5) / 4
                cells = np.clip(u * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), o, np.int32)), pa.array(hilbert_keys(cells, bits)), batch.column(0)], ["ordering", "key", "rep"])

    laid = points.select("rep", "v").mapInArrow(keys, "ordering int, key long, rep long")
    laid = laid.repartitionByRange("ordering", "key", "rep").sortWithinPartitions("ordering", "key", "rep")
    # The row ids of a checkpoint are its partition and a count within it: ordered like the range partitions.
    laid = checkpointed(laid).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    sizes = laid.groupBy("ordering", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()
    firsts, seen = {}, {}
    for r in sorted(sizes, key=lambda r: (r.ordering, r.part)):  # one row per partition and ordering
        firsts[r.ordering, r.part] = (r.low, seen.get(r.ordering, 0))
        seen[r.ordering] = seen.get(r.ordering, 0) + r.n
    base = laid.sparkSession.createDataFrame([(o, p, low, n) for (o, p), (low, n) in firsts.items()] or [(0, 0, 0, 0)], "ordering int, part long, low long, base long")
    out = laid.withColumn("part", part).join(F.broadcast(base), ["ordering", "part"])
    return out.select("ordering", (F.col("at") - F.col("low") + F.col("base")).alias("rank"), "rep")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``scores``, the columns of the ``k`` best: by score, then by id."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, cols = np.nonzero(scores >= kth[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    near = np.arange(len(rows)) - first[rows] < k
    return rows[near], cols[near]


NEAR = "query long, rep long, score double"


def compare(query: np.ndarray, q: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` points (ids, p) of one block for each of the queries (query, q)."""
    step = max(1, SCORES // len(ids))
    for lo in range(0, len(query), step):
        scores = q[lo : lo + step] @ p.T
        rows, cols = best_of(scores, ids, k)
        yield pa.RecordBatch.from_arrays([pa.array(query[lo + rows]), pa.array(ids[cols]), pa.array(scores[rows, cols])], ["query", "rep", "score"])


def in_blocks(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): the best ``k`` points for each query over the blocks it is sent to.

    ``queries`` is (ordering, block, query, v), ``points`` (ordering, block,
    rep, v). A task reads its blocks one after the other, each block's points
    before its queries: a block's points are held, its queries pass by, so
    nothing is repeated and no number of queries fills a task's memory.
    """
    there = points.select("ordering", "block", F.lit(0).alias("asks"), F.col("rep").alias("id"), "v")
    asked = queries.select("ordering", "block", F.lit(1).alias("asks"), F.col("query").alias("id"), "v")
    met = there.unionByName(asked).repartition("ordering", "block").sortWithinPartitions("ordering", "block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ids, p = None, [], None, None
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part, block, asks = batch.slice(lo, hi - lo), (int(place[lo, 0]), int(place[lo, 1])), place[lo, 2]
                if block != here:
                    here, held, ids, p = block, [], None, None
                own = np.asarray(part.column(3)), np.stack(part.column(4).to_numpy(zero_copy_only=False))
                if not asks:
                    held.append(own)
                    continue
                if held:
                    ids, p = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                if ids is not None:
                    yield from compare(*own, ids, p, k)

    return met.mapInArrow(run, NEAR)


def true_neighbours(points: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query, rep, score): the ``k`` best points of each query, cut per batch, per partition and then over all."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rep, v = batch.column(0).to_numpy(), np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            scores = q @ v.T
            rows, cols = best_of(scores, rep, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(rep[cols]), pa.array(scores[rows, cols])], ["query", "rep", "score"])

    found = points.select("rep", "v").mapInArrow(exact, "query long, rep long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def calibrate(points: DataFrame, ranks: DataFrame, k: int, recall: float, sample: int) -> int:
    """The window that meets ``recall`` of the true neighbours of a bounded sample of vectors."""
    chosen = points.orderBy(F.xxhash64("rep"), "rep").limit(sample).select(F.col("rep").alias("query"), "v").collect()
    if not chosen:
        return 0
    ids, q = np.array([r.query for r in chosen]), np.array([r.v for r in chosen])

    found = true_neighbours(points, ids, q, k + 1).toPandas()  # sample x (k + 1) rows
    found = found[found["query"] != found["rep"]].sort_values(["query", "score", "rep"], ascending=[True, False, True]).groupby("query").head(k)
    if not len(found):
        return 0
    truth = points.sparkSession.createDataFrame(found[["query", "rep"]])
    wanted = F.broadcast(truth)  # sample x k rows
    a = ranks.join(F.broadcast(truth.select(F.col("query").alias("rep")).distinct()), "rep").select("ordering", F.col("rep").alias("query"), F.col("rank").alias("q_rank"))
    b = ranks.join(wanted, "rep").select("ordering", "query", "rep", "rank")
    away = b.join(a, ["ordering", "query"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("rank") - F.col("q_rank"))).alias("away")).toPandas()["away"]
    return int(np.ceil(np.quantile(away, recall, method="higher")))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    orderings: int = ORDERINGS,
    dims: int = DIMS,
    bits: int = BITS,
    block: tuple[int, int] = BLOCK,
    recall: float = RECALL,
    calibration: int = CALIBRATION,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row.

    ``is_query`` is a condition on column ``vec_id``. Null ids and vectors that
    are null, zero or hold null or non-finite components take no part; so do
    vectors of another length than the longest kind's. Ties go to the smaller
    id. Repeated ids are one row if their vectors are equal; with different
    vectors each is a candidate and the best score counts. Equal vectors are
    compared once and expanded to their smallest ids, which is exact. Other
    columns, whatever their names, are ignored; an empty table gives an empty
    result.
    """
    rows = valid(vectors, id_col, vec_col)
    width = rows.agg(F.max(F.size("v"))).first()[0]
    spark = vectors.sparkSession
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == width)
    points = checkpointed(distinct_vectors(rows, k + 1))
    ranks = ranked(points, width, orderings, dims, bits)
    window = max(calibrate(points, ranks, k, recall, calibration), k)
    size = min(max(window, block[0]), block[1])

    laid = ranks.join(points.select("rep", "v"), "rep").withColumn("block", F.floor(F.col("rank") / size))
    # A query is asked once per distinct vector.
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    queries = asked.join(points.select("v", "rep"), "v").select("query_id", F.col("rep").alias("query"))
    own = queries.select(F.col("query").alias("rep")).distinct()
    low, high = F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / size), F.floor((F.col("rank") + window) / size)
    sent = laid.join(own, "rep").select("ordering", F.explode(F.sequence(low, high)).alias("block"), F.col("rep").alias("query"), "v")
    met = in_blocks(sent, laid.select("ordering", "block", "rep", "v"), k + 1)
    met = met.groupBy("query", "rep").agg(F.max("score").alias("score"))  # met in several orderings

    # Each query vector's best classes; then their ids, and the query's own id out.
    tops = met.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "rep"))), 1, k + 1).alias("tops"))
    each = tops.select("query", F.explode("tops").alias("t")).select("query", F.col("t.rep").alias("rep"), (-F.col("t.neg")).alias("score"))
    ids = each.join(points.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    near = ids.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))), 1, k + 1).alias("near"))
    mine = queries.join(near, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("pos", "n")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.neg")).alias("score")
    )

"""Hard-negative mining by distributed radix selection.

Components are made whole numbers, so that scores (inner products) are exact
integers and can be selected digit by digit. A *window* is an anchor and a
range of scores; its ``k`` best rows are found without sending its rows
anywhere: every task counts the scores of its rows by their leading digit,
Spark sums the histograms and finds the bucket in which the kth score lies,
and the next round counts the next digit within that bucket alone. When the
last digit is known, a last pass gathers the rows that reach the kth score.

Positives are the best rows of the anchor's label over all scores; each anchor
and positive then opens a window between two shares of the positive's score, in
which rows of other labels are mined.

Rows are packed into blocks of vectors; anchors are taken in passes of a
bounded number, and only a pass's anchors and the state of their windows are in
the driver. Anchors times rows is the work that the task sets, whatever the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch

#: Rows of a block, anchors of a pass over all rows, and anchors compared at once.
BLOCK_ROWS, PASS_ANCHORS, TILE = 4096, 16_384, 128
#: Bits of a digit.
DIGIT = 10
BLOCK = "ids binary, labels binary, most double, kind string, body binary"
FOUND = "window long, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def packed(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks of (vec_id, label, v): ids, labels and floor(scale * v), in as few bytes as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                v = np.floor(np.stack(part.column(2).to_numpy(zero_copy_only=False)) * scale)
                most = float(np.abs(v).max())
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
                own = (np.asarray(part.column(0), "<i8").tobytes(), np.asarray(part.column(1), "<i8").tobytes(), most, kind, v.astype(kind).tobytes())
                kinds = (pa.binary(), pa.binary(), pa.float64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    return rows.select("vec_id", "label", "v").mapInArrow(run, BLOCK)


@dataclass
class Windows:
    """Windows of a pass: by anchor, from ``low`` to ``high``, and how far their selection is.

    A row's place is ``high`` less its score. ``prefix`` holds the digits of the
    kth place that are known and ``need`` how many rows are wanted in that bucket.
    """

    k: int
    same: bool  # rows of the anchor's label, or of others
    anchor: np.ndarray  # ascending
    low: np.ndarray
    high: np.ndarray
    positive_id: np.ndarray
    positive_score: np.ndarray
    bits: int = 0
    shift: int = 0
    prefix: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Windows with fewer rows than wanted: all their rows count.
    all: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def __post_init__(self) -> None:
        n = len(self.anchor)
        self.bits = max(1, int(max((self.high - self.low).max(initial=0), 0)).bit_length())
        self.shift = -(-self.bits // DIGIT) * DIGIT
        self.prefix, self.need, self.all = np.zeros(n, np.int64), np.full(n, self.k, np.int64), np.zeros(n, bool)

    def last_place(self) -> np.ndarray:
        """The place of the last row that is wanted, ties with it included."""
        return np.where(self.all, self.high - self.low, self.prefix)


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray


def over_blocks(anchors: Anchors, windows: Windows, most: float, each: Callable) -> Callable:
    """A task that calls ``each(window, places, ids)`` for every window with the rows of a block that are of the right label and within it."""
    width = anchors.v.shape[1]
    kind = np.float32 if width * most * most < 1 << 24 else np.float64 if width * most * most < 1 << 53 else np.int64
    starts = np.searchsorted(windows.anchor, np.arange(len(anchors.ids) + 1))
    asked = np.flatnonzero(np.diff(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                b = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                ids, labels = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8")
                body = np.frombuffer(b["body"], b["kind"]).reshape(len(ids), width).astype(kind).T
                out: list[tuple] = []
                for lo in range(0, len(asked), TILE):
                    tile = asked[lo : lo + TILE]
                    scores = (anchors.v[tile].astype(kind) @ body).astype(np.int64)
                    for a, score in zip(tile.tolist(), scores, strict=True):
                        of = (labels == anchors.labels[a]) & (ids != anchors.ids[a]) if windows.same else (labels != anchors.labels[a]) & (ids != anchors.ids[a])
                        own = range(starts[a], starts[a + 1])
                        fits = np.flatnonzero(of & (score >= windows.low[own].min()) & (score <= windows.high[own].max()))
                        score, of_ids = score[fits], ids[fits]
                        for w in own:
                            place = windows.high[w] - score
                            inside = np.flatnonzero((place >= 0) & (score >= windows.low[w]))
                            if len(inside):
                                each(w, place[inside], of_ids[inside], out)
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], list(each.names))

    return run


def refine(blocks: DataFrame, anchors: Anchors, windows: Windows, most: float) -> None:
    """One round: the next digit of every window's kth place."""
    shift = windows.shift - DIGIT

    def count(w: int, place: np.ndarray, ids: np.ndarray, out: list) -> None:
        inside = place[place >> windows.shift == windows.prefix[w]]
        n = np.bincount((inside >> shift) & ((1 << DIGIT) - 1))
        # The kth lies no further than where this block alone has as many as are wanted.
        digits = np.flatnonzero(n)
        digits = digits[: int(np.searchsorted(np.cumsum(n[digits]), windows.need[w])) + 1]
        if len(digits):
            out.append((np.full(len(digits), w), digits, n[digits], np.full(len(digits), windows.need[w])))

    count.names = ("window", "digit", "n", "need")
    task = over_blocks(anchors, windows, most, count)
    summed = blocks.mapInArrow(task, "window long, digit long, n long, need long").groupBy("window", "digit").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    upto = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))  # of one digit's values at most
    found = summed.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    settled = np.zeros(len(windows.anchor), bool)
    for r in found.select("window", "digit", (F.col("need") - F.col("upto") + F.col("n")).alias("need")).collect():  # a row per window of the pass
        windows.prefix[r.window] = windows.prefix[r.window] << DIGIT | r.digit
        windows.need[r.window] = r.need
        settled[r.window] = True
    windows.all |= ~settled  # only the first round can meet fewer than are wanted
    windows.prefix[windows.all] = -1
    windows.shift = shift


def select(blocks: DataFrame, anchors: Anchors, windows: Windows, most: float) -> DataFrame:
    """(window, anchor_id, positive_id, positive_score, vec_id, score, rank): every window's first ``k`` rows, by score, then by id."""
    while windows.shift:
        refine(blocks, anchors, windows, most)
    last = windows.last_place()

    def gather(w: int, place: np.ndarray, ids: np.ndarray, out: list) -> None:
        near = np.flatnonzero(place <= last[w])
        # Of rows that tie with the kth, those of a block's smallest ids are enough.
        near = near[np.lexsort((ids[near], place[near]))[: windows.k]]
        if n := len(near):
            same = (w, anchors.ids[windows.anchor[w]], windows.positive_id[w], windows.positive_score[w])
            out.append((*(np.full(n, x, np.int64) for x in same), ids[near], windows.high[w] - place[near]))

    gather.names = tuple(c.split()[0] for c in FOUND.split(", "))
    found = blocks.mapInArrow(over_blocks(anchors, windows, most, gather), FOUND)
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", best("window", F.pmod(F.xxhash64("vec_id"), F.lit(16)))).filter(F.col("rank") <= windows.k)
    return found.withColumn("rank", best("window")).filter(F.col("rank") <= windows.k)


def share_of(score: np.ndarray, share: int) -> np.ndarray:
    """share * score / 100, rounded down, without a product that is larger than a score."""
    return score // 100 * share + score % 100 * share // 100


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    from_share: int = 30,
    to_share: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    ``is_anchor`` is a condition on column ``vec_id``. Components become
    floor(scale * x); a score is the inner product of these. An anchor's
    positives are its first ``positives`` other rows of its label; a positive's
    negatives are the first ``negatives`` rows of other labels with
    from_share * positive <= 100 * score <= to_share * positive. Higher scores
    come first, then smaller ids. Rows with a null id, a null label, a null
    vector or a null or non-finite component take no part, nor do vectors of
    another length than the longest kind's. Rows of the anchor's own id are no
    partners; repeated rows count each, and a repeated anchor gives its rows
    each time. Scores of 62 bits or more are an error. Other columns, whatever
    their names, are ignored; an empty table, or one without anchors, gives an
    empty result.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & (F.size("v") > 0))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if width is None:
        return nothing
    rows = rows.filter(F.size("v") == width)
    out = None
    with scratch(spark, "negatives") as keep:
        blocks = keep(packed(rows, scale), "rows")
        most = blocks.agg(F.max("most")).first()[0]
        if width * most * most >= 1 << 62:
            raise ValueError("scores exceed 62 bits")
        bound = int(width * most * most)
        own = keep(rows.filter(is_anchor), "anchors")
        n_passes = -(-own.count() // PASS_ANCHORS)
        for turn in range(n_passes):
            mine = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_passes)) == turn).orderBy("vec_id").collect()  # PASS_ANCHORS on average
            if not mine:
                continue
            anchors = Anchors(np.array([r.vec_id for r in mine]), np.array([r.label for r in mine]), np.floor(np.array([r.v for r in mine]) * scale))
            n = len(mine)
            wide = Windows(positives, True, np.arange(n), np.full(n, -bound), np.full(n, bound), np.zeros(n, np.int64), np.zeros(n, np.int64))
            found = select(blocks, anchors, wide, most).select("window", "vec_id", "score").orderBy("window", F.desc("score"), "vec_id").toPandas()  # positives of a pass
            score = found["score"].to_numpy(np.int64)
            low, high = -share_of(-score, from_share), share_of(score, to_share)
            fits = low <= high
            narrow = Windows(negatives, False, found["window"].to_numpy()[fits], low[fits], high[fits], found["vec_id"].to_numpy()[fits], score[fits])
            if len(narrow.anchor):
                part = checkpointed(select(blocks, anchors, narrow, most))
                out = part if out is None else out.unionByName(part)
    if out is None:
        return nothing
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Exact dedup: tree-merge of sorted digest runs, in DataFrame functions only.

Every document becomes one row (digest, length, id) of a *run*; runs are
ordered by digest and merged in rounds of ``fan_in``: round r groups by
(run >> r, digest), so that ``fan_in`` neighbouring runs meet and each digest
leaves one row, the smallest identifier among the longest texts, with the
number of rows it stands for. Spark pre-aggregates each run before it is sent,
so a digest that holds a third of all rows costs one row per run and round.
A digest counts as verified together with the normalised length in bytes and
an independent 64-bit hash, which are part of the key at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, place_of

#: The white space that is deleted before texts are compared.
WHITE_SPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
KEY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, check, n_points, place) of every row; texts stay behind. ``place`` is 128 hash bits of id and text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        place_of(id_col, text_col).alias("place"),
    ).select(
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
        "n_points",
        "place",
    )


def merge_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per digest: keep_id and group_size, by rounds of run merging."""
    bits = fan_in.bit_length() - 1
    if fan_in != 1 << bits or bits < 1:
        raise ValueError("fan_in must be a power of two, 2 at least")
    run = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")
    # Longest text first, then the smallest id; a null id comes last.
    best = F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("neg_id"))
    level = rows.select(*KEY, run.alias("run"), best.alias("best"), F.lit(1).cast("long").alias("n"))
    left = runs
    while True:
        level = level.groupBy("run", *KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        if left <= 1:
            break
        left = (left + fan_in - 1) >> bits
        level = level.withColumn("run", F.shiftright("run", bits))
    return level.select(*KEY, (-F.col("best.neg_id")).alias("keep_id"), F.col("best.n_points").alias("keep_points"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Null and empty texts are equal to each other (and to texts of white space
    only). Of equal texts the longest original stays, then the smallest id; a
    null id is never preferred. Repeated rows (same id, equal text) form one
    group of that many rows; all rows with the kept id and length are marked
    kept. Other columns, whatever their names, are ignored. An empty table
    gives an empty result. Whole texts are digested, however long.
    """
    rows = checkpointed(digests(docs, id_col, text_col).drop("place"))
    best = merge_runs(rows, runs, fan_in)
    return rows.join(best, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """(place, copies): hashes of id and text of the rows that stay, and how many rows repeat each as a whole."""
    rows = checkpointed(digests(docs, id_col, text_col))
    best = merge_runs(rows, runs, fan_in).select(*KEY, F.col("keep_id").alias("doc_id"), F.col("keep_points").alias("n_points"))
    # The key holds the id, so that a digest of many rows is no hot key here.
    same = [rows[c] == best[c] for c in (*KEY, "n_points")]
    kept = rows.join(best, [*same, rows["doc_id"].eqNullSafe(best["doc_id"])], "left_semi")
    each = kept.groupBy(*KEY, "doc_id", "place").agg(F.count("*").alias("copies"))
    # Texts of one id that differ in white space alone: the one of the smallest hash stays.
    first = each.groupBy(*KEY, "doc_id").agg(F.min(F.struct("place", "copies")).alias("first"))
    return first.select("first.place", "first.copies")

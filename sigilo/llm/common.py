"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, checkpointed, merged, removed, scratch, shared_folder

__all__ = ["PLACE", "Scratch", "checkpointed", "fresh", "merged", "parts", "place_of", "removed", "scratch", "shared_folder", "slim", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name, read through Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *used: list[str]) -> str:
    """``name``, with underscores before it until no column of any of the lists is called so."""
    taken = {c.lower() for columns in used for c in columns}
    while name in taken:
        name = "_" + name
    return name


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in order; extra columns of any name fall away."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def parts(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, at most ``rows`` at a time: what a task holds of them as Python objects."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def place_of(id_col: str, text_col: str) -> Column:
    """128 bits of hashes of a row's id and text, by which it is known where ids may be null or repeat."""
    i, t = F.col(id_col), F.col(text_col)
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), i.isNull(), i, t.isNull(), t).alias("b"))


#: The type of ``place_of``.
PLACE = "struct<a:bigint,b:bigint>"

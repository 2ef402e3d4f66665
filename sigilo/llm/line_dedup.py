"""Line dedup: documents probe a sharded minimal perfect hash of all lines.

Every line of some length has a key of 128 hash bits. The distinct keys of the
corpus, each with the number of documents that hold it and the largest of their
ids, are dealt into shards, and a task turns each shard into a minimal perfect
hash with arrays of fingerprints, counts and ids (``perfect_hash``): some ten
bytes a line, whatever the lines' lengths. Documents send the keys of their
lines to the shards and probe the arrays there; no lines are joined. What the
probes answer goes back to the documents, which drop these lines.

A shard that holds a very common line would be asked by everybody. Keys found
in more than a share of a task's documents have an index of their own, which
every task has with it; there are at most HOT_SHARE times as many such keys as
shuffle partitions, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, scratch
from .perfect_hash import CountIndex

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard, on average.
SHARD_KEYS = 16_384
#: A key with more than 1 / (HOT_SHARE * partitions) of all probes is answered in the asking task.
HOT_SHARE = 4
#: Answers of up to so many bytes are sent to all tasks; more are joined by a shuffle of the texts.
BROADCAST_BYTES = 24 << 20
LINE = "doc_id long, mark long, high long, low long"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None for a short one."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "replace").lower())  # of bytes: A-Z only


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, high, low): every row's distinct line keys; ``mark`` is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                each = [sorted({k for line in (t or "").split("\n") if (k := line_key(line, min_chars))}) for t in part.column(2).to_pylist()]
                row = np.repeat(np.arange(len(part)), [len(e) for e in each])
                halves = np.frombuffer(b"".join(k for e in each for k in e), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "mark", "high", "low"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, LINE)


def counted(lines: DataFrame) -> DataFrame:
    """(high, low, n, last) of every distinct key: its documents, known by their ids, and the largest id."""
    each = lines.select("high", "low", "doc_id").distinct()
    return each.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def unsigned(column: pd.Series | pa.Array) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def index_of(keys: pd.DataFrame, min_docs: int) -> bytes:
    return CountIndex.build(unsigned(keys["high"]), unsigned(keys["low"]), keys["n"].to_numpy(), keys["last"].fillna(0).to_numpy(np.int64), min_docs)


def shard_of(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("high"), F.lit(shards))


def built(keys: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(shard, index): the arrays of every shard."""

    def build(shard: tuple, own: pa.Table) -> pa.Table:
        own = pd.DataFrame({c: own.column(c).to_numpy() for c in ("high", "low", "n")} | {"last": own.column("last").fill_null(0).to_numpy()})
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int64()), "index": pa.array([index_of(own, min_docs)], pa.binary())})

    return keys.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build, "shard long, index binary")


def to_drop(index: CountIndex, batch: pa.RecordBatch, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(known, dropped) of every probe (doc_id, ..., high, low)."""
    known, count, last = index.probe(unsigned(batch.column("high")), unsigned(batch.column("low")))
    ids = batch.column("doc_id")
    own = np.asarray(ids.fill_null(0)) == last
    own &= ~np.asarray(ids.is_null())  # a null id is no largest one
    return known, known & (count >= min_docs) & ~own


def probed(lines: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The rows of ``lines`` that go, by the shards' arrays: a task reads its shards one after the other, each before its probes."""
    asked = lines.withColumn("shard", shard_of(shards)).withColumn("index", F.lit(None).cast("binary"))
    there = index.select(*[F.lit(None).cast("long").alias(c) for c in ("doc_id", "mark", "high", "low")], "shard", "index")
    met = there.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("index").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, CountIndex] | None = None
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if hi > lo and part.column("index")[0].is_valid:
                    here, part = (int(shard[lo]), CountIndex(part.column("index")[0].as_py())), part.slice(1)
                if len(part):
                    if here is None or here[0] != shard[lo]:
                        raise RuntimeError(f"shard {shard[lo]} has no index")
                    yield part.select(["doc_id", "mark", "high", "low"]).filter(pa.array(to_drop(here[1], part, min_docs)[1]))

    return met.mapInArrow(run, LINE)


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, mark, high, low): the line keys that the rows with this id and text lose, checkpointed."""
    spark = docs.sparkSession
    with scratch(spark, "lines") as keep:
        lines = keep(line_keys(docs, min_chars), "probes")
        keys = keep(counted(lines), "keys")
        n_keys, n_probes = keys.agg(F.count("*"), F.sum("n")).first()
        shards = max(1, -(-n_keys // SHARD_KEYS))
        often = (n_probes or 0) / (HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions")))
        hot = index_of(keys.filter(F.col("n") > often).toPandas(), min_docs)  # of HOT_SHARE * partitions keys at most

        def ask_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = CountIndex(hot)
            for batch in batches:
                known, gone = to_drop(index, batch, min_docs)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known), pa.array(gone)], [*batch.schema.names, "known", "gone"])

        met = lines.mapInArrow(ask_hot, f"{LINE}, known boolean, gone boolean")
        cold = probed(met.filter("NOT known").drop("known", "gone"), built(keys, shards, min_docs), shards, min_docs)
        return checkpointed(cold.unionByName(met.filter("gone").drop("known", "gone")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of every row: its text without the lines that are all over the corpus.

    A line's key is the line without white space at its ends, A-Z in small
    letters. Keys of ``min_chars`` code points or more that ``min_docs``
    documents hold lose all their lines but those of the largest id that holds
    them. Null and empty texts are one empty line. Documents are told apart by
    their ids: rows of one id count as one document and keep or lose a line
    alike; null ids are one document before all others. Repeated rows give
    repeated rows. Whole texts are read, however long; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    if not 1 <= min_docs < 255:
        raise ValueError("min_docs must be from 1 to 254")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    # Whether a line goes depends on its key and the id alone: texts of one id that share a hash by chance do no harm.
    gone = dropped_lines(rows, min_chars, min_docs)
    n_gone = gone.count()
    own = gone.distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("high", "low")).alias("gone")).select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "gone")
    if n_gone * 64 <= BROADCAST_BYTES:
        own = F.broadcast(own)
    met = rows.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                lost, kept, n_lines, n_dropped = part.column(2), [], [], []
                pairs = np.stack([np.asarray(c, dtype="<i8") for c in lost.flatten().flatten()], axis=1)
                sizes = np.asarray(lost.value_lengths().fill_null(0))
                ends = np.cumsum(sizes)
                for text, size, end in zip(part.column(1).to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                    lines = (text or "").split("\n")
                    if size:
                        mine = {pairs[k].tobytes() for k in range(end - size, end)}
                        stay = [line for line in lines if line_key(line, min_chars) not in mine]
                    else:
                        stay = lines
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return met.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")

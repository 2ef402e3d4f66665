"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over the characters of small-letter text, ORDER of them to a gram.
Code points below DIRECT are symbols of their own, all others share the rest
of the alphabet by a hash, so accents and other scripts carry weight and the
tables grow with the input. Texts are laid in *chunks*, each one compressed
row of a table bucketed by chunk. Counts of trusted grams, their contexts and
continuations are grouped by gram over Spark's shuffle partitions (the
shards). Every chunk asks for each of its distinct grams once; requests are
joined with the shards of all orders and interpolated, and the answers return
to the chunk's bucket, where each document's log-probability is summed over
its whole text. Texts themselves are written once and never shuffled. A hot
gram is one request per chunk, not one per occurrence, and nothing is
broadcast but ids of trusted documents below a checked number.

A share of the trusted documents, chosen by a hash of id and text, is held out
of the counts. A document is kept if its perplexity is at most the quantile of
the held-out documents of its language and of like length.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, removed, shared_folder

ORDER, BITS = 5, 10
SYMBOLS = 1 << BITS
#: Code points below this are their own symbols; the others share what is left by a hash.
DIRECT = 768
#: Symbols in a chunk, and those that a task works on at once.
CHUNK_CHARS, BLOCK = 24_000_000, 2_000_000
#: Ids of trusted documents are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_IDS = 4_000_000
#: One trusted document in HELD_OUT sets the thresholds and is not counted.
QUANTILE, HELD_OUT = 0.995, 4

_SYMBOL: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """By code point: 0 white space, its small letter's code point, or a shared symbol."""
    if not _SYMBOL:
        out = np.zeros(sys.maxunicode + 1, dtype=np.uint16)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if not s.isspace():
                low = ord(s.lower()[0])
                out[c] = low if low < DIRECT else DIRECT + low * 2654435761 % (1 << 32) % (SYMBOLS - DIRECT)
        _SYMBOL.append(out)
    return _SYMBOL[0]


def fold(text: str | None) -> np.ndarray:
    """Symbols of a whole text; runs of white space are one."""
    a = symbols()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    gap = a == 0
    return a[~(gap & np.concatenate(([True], gap[:-1])))] if len(a) else a


CHUNK = "chunk long, ids binary, langs array<string>, use binary, sizes binary, symbols binary"
CHUNK_NAMES = [x.split()[0] for x in CHUNK.split(", ")]
NO_ID = -(1 << 62)
#: What a document is to the model.
OTHER, COUNTED, HELD = 0, 1, 2


def chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, use) folded and laid in chunks, each one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=9)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            raw = np.concatenate([r[3] for r in rows]).tobytes()
            # uuid4: a task that runs again replaces its rows, names and all.
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int % (1 << 63)], pa.int64()),
                    pa.array([np.array([r[0] for r in rows], dtype=np.int64).tobytes()], pa.binary()),
                    pa.array([[r[1] for r in rows]], pa.list_(pa.string())),
                    pa.array([np.array([r[2] for r in rows], dtype=np.uint8).tobytes()], pa.binary()),
                    pa.array([np.array([len(r[3]) for r in rows], dtype=np.int64).tobytes()], pa.binary()),
                    pa.array([pack.compress(raw)], pa.binary()),
                ],
                CHUNK_NAMES,
            )
            rows.clear()
            return out

        size = 0
        for batch in batches:
            for doc, text, lang, use in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                a = fold(text)
                rows.append((NO_ID if doc is None else doc, lang, use, a))
                size += len(a) + 16
                if size >= CHUNK_CHARS:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return docs.select("doc_id", "text", "lang", "use").mapInArrow(run, CHUNK)


class Laid:
    """A chunk row, opened: uses and sizes of its documents, and their symbols one after the other."""

    def __init__(self, row: dict) -> None:
        self.use, self.sizes = np.frombuffer(row["use"], np.uint8), np.frombuffer(row["sizes"], np.int64)
        self.end = np.cumsum(self.sizes)
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["symbols"], max_output_size=max(1, 2 * int(self.sizes.sum()))), np.uint16)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first, the gram that ends at each symbol); before every text stand blanks."""
        begin = self.end - self.sizes
        for lo in range(0, len(self.body), BLOCK):
            hi = min(len(self.body), lo + BLOCK)
            own = self.body[lo:hi].astype(np.int64)
            code = own.copy()
            first = np.searchsorted(self.end, lo, side="right")
            last = np.searchsorted(begin, hi)
            starts = begin[first:last][self.sizes[first:last] > 0]
            for back in range(1, ORDER):
                before = np.zeros(hi - lo, dtype=np.int64)
                at = max(lo - back, 0)
                before[at + back - lo :] = self.body[at : max(at, hi - back)]
                for k in range(back):  # the symbols right behind a text's start have no more before them
                    there = starts + k - lo
                    before[there[(there >= 0) & (there < hi - lo)]] = 0
                code |= before << (BITS * back)
            yield lo, code


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def trusted_counts(laid: DataFrame) -> DataFrame:
    """(gram, n) over all trusted texts that are not held out, counted per chunk first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                chunk = Laid(batch.slice(k, 1).to_pylist()[0])
                keys, counts = [], []
                for lo, code in chunk.blocks():
                    counted = np.repeat(chunk.use == COUNTED, chunk.sizes)[lo : lo + len(code)]
                    key, n = np.unique(code[counted], return_counts=True)
                    keys.append(key)
                    counts.append(n)
                key, n = merged(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["gram", "n"])

    return laid.select(*CHUNK_NAMES).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def requests(laid: DataFrame) -> DataFrame:
    """(chunk, gram): every distinct gram of each chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                found = [np.unique(code) for _, code in Laid(row).blocks()]
                gram = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                for lo in range(0, len(gram), 1 << 17):
                    part = gram[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row["chunk"], np.int64)), pa.array(part)], ["chunk", "gram"])

    return laid.select(*CHUNK_NAMES).mapInArrow(run, "chunk long, gram long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts of one order, from its counts of counts."""
    n = {r.c: r.n for r in counts.filter(F.col("n") <= 4).groupBy(F.col("n").alias("c")).agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (max(1, n.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def low(c: Column, order: int) -> Column:
    """The last ``order`` symbols of a gram."""
    return c.bitwiseAND(F.lit((1 << (order * BITS)) - 1))


def log_probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, logp) of every asked gram: joins of all orders' shards, interpolated from the lowest up."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        tables[k] = tables[k + 1].groupBy(low(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        tables[k] = checkpointed(tables[k])
    out = asked.select("gram")
    d = {}
    for k in range(1, ORDER + 1):
        d[k] = discounts(tables[k])
        one, two, three = d[k]
        own = tables[k].select(F.col("gram").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
        context = tables[k].groupBy(F.shiftright("gram", BITS).alias(f"c{k}")).agg(
            F.sum("n").alias(f"t{k}"), F.sum(F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(three)).alias(f"b{k}")
        )
        out = out.join(own, low(F.col("gram"), k) == F.col(f"g{k}"), "left").drop(f"g{k}")
        out = out.join(context, F.shiftright(low(F.col("gram"), k), BITS) == F.col(f"c{k}"), "left").drop(f"c{k}")

    def step(p: Column, k: int) -> Column:
        one, two, three = d[k]
        n, t, b = F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"b{k}")
        held = F.coalesce(n - F.when(n == 1, one).when(n == 2, two).otherwise(three), F.lit(0.0))
        return F.when(t.isNull(), p).otherwise(held / t + b / t * p)

    p = reduce(step, range(1, ORDER + 1), F.lit(1.0 / SYMBOLS))
    return out.select("gram", F.log(p).cast("float").alias("logp"))


SCORE = "doc_id long, lang string, use int, n_symbols long, log_ppl double"


def answered(row: dict, gram: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
    """Each document's mean negative log-probability, from its chunk's answers."""
    chunk = Laid(row)
    order = np.argsort(gram)
    gram, logp = gram[order], logp[order].astype(np.float64)
    total = np.zeros(len(chunk.sizes))
    for lo, code in chunk.blocks():
        found = logp[np.searchsorted(gram, code)]
        owner = np.searchsorted(chunk.end, np.arange(lo, lo + len(code)), side="right")
        first, last = owner[0], owner[-1]
        total[first : last + 1] += np.bincount(owner - first, found, last - first + 1)
    known = [None if i == NO_ID else i for i in np.frombuffer(row["ids"], np.int64).tolist()]
    ppl = -total / np.maximum(chunk.sizes, 1)
    cols = [pa.array(known, pa.int64()), pa.array(row["langs"], pa.string()), pa.array(chunk.use.astype(np.int32)), pa.array(chunk.sizes), pa.array(ppl)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORE.split(", ")])


def score(laid: DataFrame, answers: DataFrame) -> DataFrame:
    """Every document's score: chunks joined with their answers."""
    listed = answers.groupBy("chunk").agg(F.collect_list("gram").alias("grams"), F.collect_list("logp").alias("logps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part = batch.slice(k, 1)
                row = part.select(CHUNK_NAMES).to_pylist()[0]
                lists = [part.column(c)[0] for c in (6, 7)]
                gram, logp = (np.asarray(x.values) if x.is_valid else np.zeros(0) for x in lists)
                yield answered(row, gram, logp)

    joined = laid.join(listed, "chunk", "left").select(*CHUNK_NAMES, "grams", "logps")
    return joined.mapInArrow(run, SCORE)


@contextmanager
def stored(laid: DataFrame) -> Iterator[DataFrame]:
    """The chunks as a table bucketed by chunk, so that readers need no shuffle; its files are in the shared folder, and go at the end."""
    spark, name = laid.sparkSession, f"quality_chunks_{uuid.uuid4().hex}"
    place = f"{shared_folder(spark)}/{name}"
    try:
        laid.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").format("parquet").option("path", place).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, place)


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(of_lang, of_band, band_limit): of held-out trusted documents, by language and length, neighbouring lengths included."""
    held = scored.filter((F.col("use") == HELD) & (F.col("n_symbols") > 0)).select("lang", "log_ppl", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    return held.groupBy(F.col("lang").alias("of_lang"), F.col("band").alias("of_band")).agg(F.percentile_approx("log_ppl", F.lit(quantile), F.lit(10_000)).alias("band_limit"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, trusted, kept of every row.

    Trusted text is that of ids labelled quality 1 and not toxic; one in
    ``held_out`` of these documents is not counted and sets the thresholds. A
    length that no held-out document of the language comes near is held to the
    language's widest threshold, a language without any to the widest of all;
    without any trusted text nothing is dropped but empty texts. Empty and null
    texts have perplexity 1 and are not kept. Null ids are never trusted; null
    languages are one of their own. Repeated rows give repeated rows, each
    counted; ties at a threshold are kept. Whole texts are read however long;
    other columns, whatever their names, are ignored; an empty table gives an
    empty result.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    good = good.select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(held_out)) == 0
    rows = rows.join(good, F.col("doc_id") == F.col("good_id"), "left").withColumn("use", F.when(F.col("good_id").isNull(), OTHER).when(held, HELD).otherwise(COUNTED))
    with stored(chunks(rows)) as laid:
        counts = checkpointed(trusted_counts(laid))
        # Both uses keep both columns and their filters, so that they read one exchange.
        wanted = requests(laid).filter("gram IS NOT NULL AND chunk IS NOT NULL").repartition("gram")
        logp = log_probabilities(wanted.groupBy("gram").agg(F.max(F.struct("chunk")).alias("one")).filter("one IS NOT NULL"), counts)
        scored = checkpointed(score(laid, wanted.join(logp, "gram")))
    scored = scored.withColumn("band", F.length(F.bin(F.greatest("n_symbols", F.lit(1)))))
    limits = checkpointed(thresholds(scored, quantile))
    by_lang = limits.groupBy(F.col("of_lang").alias("wide_lang")).agg(F.max("band_limit").alias("lang_limit"))
    widest = limits.agg(F.max("band_limit")).first()[0]
    found = scored.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("band") == F.col("of_band")), "left")
    found = found.join(by_lang, F.col("lang").eqNullSafe(F.col("wide_lang")), "left")
    limit = F.coalesce("band_limit", "lang_limit", F.lit(float("inf") if widest is None else widest))
    return found.select(
        "doc_id", "lang", "n_symbols", F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("threshold"), (F.col("use") != OTHER).alias("trusted"),
        ((F.col("n_symbols") > 0) & (F.col("log_ppl") <= limit)).alias("kept"),
    )

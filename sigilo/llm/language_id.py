"""Language ID: nearest of several centroids per language, by cosine.

Texts become normalised TF-IDF vectors of character 1- to 3-grams, hashed into
a fixed number of bins. Document frequencies are summed in Spark over every
training row. Centroids come from spherical k-means over a bounded sample of
labelled texts, the ``SAMPLE`` of the smallest hashes in each language by
default. A text is given the language of its nearest centroid; it is rejected
where its cosine is below the floor of that language and the text's length.
Floors are low quantiles of the cosines of all training rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


BINS = 1 << 15
#: Distinct texts per language on which centroids are fitted: a documented bound.
SAMPLE = 600
CENTROIDS = 3
#: A floor is this part of this quantile of the training rows' cosines.
FLOOR_PART, FLOOR_QUANTILE = 0.75, 0.005
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: its lower-case letter, or 32 where it is no letter."""
    if not _LETTERS:
        out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(out)
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bins, counts) of a whole text's letter 1- to 3-grams; None if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = letters()[points]
    a = np.concatenate(([32], a, [32])).astype(np.uint32)
    gap = a == 32
    if gap.all():
        return None
    a = a[~(gap & np.concatenate(([False], gap[:-1])))]  # runs of other characters count as one gap
    with np.errstate(over="ignore"):
        one = a[a != 32] * np.uint32(2654435761)
        two = a[:-1] * np.uint32(2246822519) + a[1:] * np.uint32(3266489917) + np.uint32(1)
        three = two[:-1] * np.uint32(668265263) + a[2:] * np.uint32(374761393) + np.uint32(2)
        codes = np.concatenate((one, two, three))
        codes ^= codes >> np.uint32(15)
        codes *= np.uint32(2246822519)
    counts = np.bincount(codes >> np.uint32(32 - 15), minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins.astype(np.int32), counts[bins]


def vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF weights of the found bins."""
    w = (1 + np.log(found[1])) * idf[found[0]]
    return (w / np.linalg.norm(w)).astype(np.float32)


def is_training(id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


class Model:
    """idf by bin; centroids (bins x n); the language of each; cosine floors by language and number of bits of the length."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floors: dict[str, dict[int, float]]) -> None:
        self.idf, self.centroids, self.langs, self.floors = idf, centroids, langs, floors

    def nearest(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[str, float, int]:
        """(language, cosine, bits of the length) of a text by its bins; ties go to the language that sorts first."""
        cos = vector(found, self.idf) @ self.centroids[found[0]]
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best]))), int(found[1].sum()).bit_length()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected) of a whole text."""
        found = gram_counts(text)
        if found is None or not self.langs:
            return UNDETERMINED, 0.0, True
        lang, score, bits = self.nearest(found)
        return lang, score, score < self.floors.get(lang, {}).get(bits, 0.0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means (rows are unit vectors), seeded by farthest rows."""
    picks = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """A model from rows whose language is known and whose id is not held out.

    Document frequencies and floors cover every such row; centroids are fitted
    on at most ``sample`` distinct texts per language. Without any row to learn
    from the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & is_training("doc_id"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, by_lang = np.zeros(BINS, dtype=np.int64), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := gram_counts(text)) is not None:
                    df[found[0]] += 1
                    by_lang[lang] = by_lang.get(lang, 0) + 1
        bins = np.flatnonzero(df)
        names = [None] * len(bins) + list(by_lang)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([*bins.tolist(), *[-1] * len(by_lang)], pa.int32()), pa.array([*df[bins].tolist(), *by_lang.values()], pa.int64())], ["lang", "bin", "n"]
        )

    sums = rows.select("text", "lang").mapInArrow(frequencies, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    counts = {r.lang: r.n for r in sums if r.bin == -1}
    if not counts:
        return Model(np.ones(BINS), np.zeros((BINS, 0)), [], {})
    df = np.zeros(BINS)
    for r in sums:
        if r.bin >= 0:
            df[r.bin] = r.n
    idf = (np.log((1 + sum(counts.values())) / (1 + df)) + 1).astype(np.float32)

    # The texts of the smallest hashes in each language; a first cut spreads a language over tasks.
    hashed = rows.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    names = hashed.select("lang", "h").distinct()
    for by in (("lang", F.pmod("h", F.lit(64))), ("lang",)):
        names = names.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("place") <= sample).drop("place")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, gram_counts(text)) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            got = [(lang, f) for lang, f in got if f is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1][0].tobytes() for g in got], pa.binary()), pa.array([g[1][1].astype(np.int32).tobytes() for g in got], pa.binary())], ["lang", "bins", "counts"]
            )

    # ``sample`` rows per language: bounded, so they may be broadcast and reach the driver.
    chosen = hashed.join(F.broadcast(names), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in chosen.mapInArrow(vectors, "lang string, bins binary, counts binary").collect():
        parts.setdefault(r.lang, []).append((np.frombuffer(r.bins, np.int32), np.frombuffer(r.counts, np.int32)))
    if not parts:
        return Model(np.ones(BINS), np.zeros((BINS, 0)), [], {})
    centroids, langs = [], []
    for lang in sorted(parts):
        own = sorted(parts.pop(lang), key=lambda f: (f[0].tobytes(), f[1].tobytes()))
        met = np.unique(np.concatenate([f[0] for f in own]))  # only bins that the sample has take room
        x = np.zeros((len(own), len(met)), dtype=np.float32)
        for i, f in enumerate(own):
            x[i, np.searchsorted(met, f[0])] = vector(f, idf)
        near = k_means(x, k)
        c = np.zeros((len(near), BINS), dtype=np.float32)
        c[:, met] = near
        centroids.append(c)
        langs += [lang] * len(c)
    model = Model(idf, np.ascontiguousarray(np.concatenate(centroids).T), langs, {})
    model.floors = floors_of(rows, model)
    return model


def floors_of(rows: DataFrame, model: Model) -> dict[str, dict[int, float]]:
    """Rejection floors by language and bits of the length, from all training rows (text, lang) that are told right."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := gram_counts(text)) is not None:
                    near, cos, bits = model.nearest(found)
                    if near == lang:
                        got.append((lang, bits, cos))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["lang", "bits", "cos"])

    scored = rows.select("text", "lang").mapInArrow(judged, "lang string, bits int, cos double")
    lows: dict[str, dict[int, float]] = {}
    for r in scored.groupBy("lang", "bits").agg(F.percentile_approx("cos", F.lit(FLOOR_QUANTILE), F.lit(10_000)).alias("low")).collect():
        lows.setdefault(r.lang, {})[r.bits] = r.low
    out: dict[str, dict[int, float]] = {}
    for lang, own in lows.items():
        floor, out[lang] = 1.0, {}
        for bits in range(48, 0, -1):  # a shorter text is never held to more than a longer one
            floor = min(floor, FLOOR_PART * own.get(bits, 1.0))
            out[lang][bits] = min(floor, FLOOR_PART * min(own.values())) if bits < min(own) else floor
        longest = out[lang][max(own)]
        out[lang] |= {bits: longest for bits in range(max(own) + 1, 49)}
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All columns of ``docs`` and the prediction in columns ``names``, which take the place of any that are called so."""
    own = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                [*own, *names],
            )

    schema = StructType(list(rows.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    Null texts and texts without a letter are ``und`` with score 0 and count
    as rejected; so is everything where no row can be learned from. The label,
    the source and the id are not inputs of a prediction. Ties go to the
    language that sorts first. Null ids are not held out. Repeated rows give
    equal rows; centroids learn from each text once. Whole texts are read, however long;
    other columns, whatever their names, are ignored; an empty table gives an
    empty result.
    """
    model = train(docs, id_col, text_col, lang_col, sample, k)
    out = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return out.select("doc_id", (~is_training("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")



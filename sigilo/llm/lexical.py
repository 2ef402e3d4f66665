"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Documents are dealt into *segments* where they are read, so no text is
shuffled. A segment is one row: its documents' ids and lengths, its terms, and
for every term its postings in blocks of BLOCK documents. A block holds
document gaps and term frequencies in as few bytes each as its largest needs,
and beside it stand its first and last document and its maximum impact.

Queries go to every segment, a bounded number of them in each pass over the
index. The blocks' boundaries of all lists of a
query cut a segment into stretches within which no list's shallow pointer
moves; the sum of the maxima under the pointers bounds every score of a
stretch. The stretches of the highest bounds are scored first, which gives a
threshold, and all that lie below it are passed over: blocks that lie in
passed stretches only are never decompressed. A task carries its queries'
thresholds from segment to segment, and best lists merge in two levels.

Impacts and weights are integers, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch

#: Postings of a block; documents and terms of a segment at most (a longer document is a segment of its own).
BLOCK, SEGMENT_DOCS, SEGMENT_TERMS = 64, 16_384, 3_000_000
#: Bytes of queries that one pass over the index sends to all tasks.
PASS_BYTES = 32 << 20
#: Documents of the highest bounds that are scored to get a threshold.
FIRST = 128
#: A term is a run of ASCII letters and digits, A-Z in small letters, and of all bytes beyond ASCII: what else there is becomes a blank.
TABLE = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: A text is split into terms in parts of so many bytes.
PART = 1 << 20
SEGMENT = "ids binary, norms binary, n_terms long, terms binary, dfs binary, n_blocks long, heads binary, bodies binary"
#: Of a block: first and last document, postings, bytes of a gap and of a frequency, place in the bodies, and maximum impact.
HEAD = np.dtype([("first", "<u2"), ("last", "<u2"), ("n", "<u2"), ("gap", "u1"), ("tf", "u1"), ("at", "<u4"), ("top", "<u4")])


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in order, a part at a time."""
    raw, at = (text or "").encode("utf-8", "replace").translate(TABLE), 0
    while len(raw) - at > PART and (end := raw.find(b" ", at + PART)) >= 0:
        yield raw[at:end].split()
        at = end
    yield (raw[at:] if at else raw).split()


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A posting's share of a score before its weight, from frequencies and the documents' norms."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // max(n_terms, 1)


class Writer:
    """Documents that become one segment."""

    def __init__(self, n_docs: int, n_terms: int) -> None:
        self.corpus = n_docs, n_terms
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int] = []
        self.n: list[int] = []
        self.found: list[np.ndarray] = []
        self.seen = 0

    def add(self, doc_id: int, text: str | None) -> None:
        n = 0
        for part in terms_of(text):
            own = np.fromiter(map(self.vocabulary.__getitem__, part), np.int64, len(part))
            self.found.append(own * SEGMENT_DOCS + len(self.ids))
            n += len(part)
        if n:  # others can't be found
            self.ids.append(doc_id)
            self.n.append(n)
            self.seen += n

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.seen >= SEGMENT_TERMS

    def row(self) -> dict[str, bytes | int]:
        norm = norms(np.array(self.n, dtype=np.int64), *self.corpus)
        # Terms in byte order, then documents.
        names = sorted(self.vocabulary)
        place = np.empty(len(names), dtype=np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        both, tf = np.unique(np.concatenate(self.found), return_counts=True)
        term, doc = place[both // SEGMENT_DOCS], both % SEGMENT_DOCS
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        df = np.bincount(term, minlength=len(names))
        within = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
        new = within % BLOCK == 0
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(term)))
        gap = np.where(new, 0, np.diff(doc, prepend=0))
        head = np.zeros(len(starts), HEAD)
        head["first"], head["last"], head["n"] = doc[starts], doc[starts + size - 1], size
        head["gap"], head["tf"] = width(np.maximum.reduceat(gap, starts)), width(np.maximum.reduceat(tf, starts))
        head["top"] = np.maximum.reduceat(impacts(tf, norm[doc]), starts)
        used = size * (head["gap"].astype(np.int64) + head["tf"])
        at = np.cumsum(used) - used
        head["at"] = at
        body = np.zeros(int(used.sum()), dtype=np.uint8)
        block, k = np.cumsum(new) - 1, within % BLOCK
        for name, values, base in (("gap", gap, at), ("tf", tf, at + size * head["gap"])):
            wide = head[name][block].astype(np.int64)
            to = base[block] + k * wide
            for byte in range(int(wide.max())):
                some = wide > byte
                body[to[some] + byte] = (values[some] >> (8 * byte)) & 255
        return {
            "ids": np.array(self.ids, "<i8").tobytes(), "norms": norm.astype("<i8").tobytes(), "n_terms": len(names), "terms": b"\0".join(names), "dfs": df.astype("<u4").tobytes(),
            "n_blocks": len(starts), "heads": head.tobytes(), "bodies": body.tobytes(),
        }


def width(most: np.ndarray) -> np.ndarray:
    """Bytes that values up to ``most`` need: 1, 2 or 4."""
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype("u1")


KINDS = {1: "u1", 2: "<u2", 4: "<u4"}


class Segment:
    """A segment as it is searched; blocks are decompressed where a query needs them, once."""

    def __init__(self, row: dict) -> None:
        self.ids, self.norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"], "<i8")
        self.names = row["terms"].split(b"\0")
        self.place: dict[bytes, int] | None = None
        df = np.frombuffer(row["dfs"], "<u4").astype(np.int64)
        per_term = -(-df // BLOCK)
        self.blocks = np.concatenate(([0], np.cumsum(per_term)))
        self.heads, self.body = np.frombuffer(row["heads"], HEAD), row["bodies"]
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lists(self, query: dict[bytes, int]) -> list[tuple[int, np.ndarray, int]]:
        """(weight, heads, number of the first) of the query's terms that the segment has."""
        if self.place is None:
            self.place = {t: k for k, t in enumerate(self.names)}
        own = [(w, self.place[t]) for t, w in query.items() if w > 0 and t in self.place]
        return [(w, self.heads[self.blocks[k] : self.blocks[k + 1]], int(self.blocks[k])) for w, k in own]

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if block not in self.opened:
            h = self.heads[block]
            n, at = int(h["n"]), int(h["at"])
            gaps = np.frombuffer(self.body, KINDS[int(h["gap"])], n, at)
            tf = np.frombuffer(self.body, KINDS[int(h["tf"])], n, at + n * int(h["gap"])).astype(np.int64)
            docs = np.cumsum(gaps, dtype=np.int64) + int(h["first"])
            self.opened[block] = docs, impacts(tf, self.norms[docs])
        return self.opened[block]

    def scores(self, lists: list[tuple[int, np.ndarray, int]], wanted: np.ndarray) -> np.ndarray:
        """Scores by document; whole where ``wanted``. Blocks without a wanted document stay closed."""
        out, upto = np.zeros(len(self.ids), dtype=np.int64), np.concatenate(([0], np.cumsum(wanted)))
        for weight, heads, base in lists:
            need = np.flatnonzero(upto[heads["last"].astype(np.int64) + 1] > upto[heads["first"]])
            if len(need):
                opened = [self.open(base + k) for k in need.tolist()]
                docs, own = (np.concatenate(x) for x in zip(*opened, strict=True)) if len(opened) > 1 else opened[0]
                out[docs] += weight * own  # a list has a document once
        return out

    def search(self, query: dict[bytes, int], k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The ``k`` first (-score, id) of ``best`` and this segment's documents."""
        lists = self.lists(query)
        if not lists:
            return best
        size = len(self.ids)
        # Bounds change only where a shallow pointer moves: at the blocks' ends.
        change = np.zeros(size + 1, dtype=np.int64)
        for weight, heads, _ in lists:
            top = weight * heads["top"].astype(np.int64)
            change[heads["first"]] += top  # blocks of a list do not overlap, so each place stands once
            change[heads["last"].astype(np.int64) + 1] -= top
        bound = np.cumsum(change[:size])
        least = -best[-1][0] if len(best) == k else 1
        left = bound >= least
        first = np.argpartition(bound, size - FIRST)[size - FIRST :] if size > FIRST else np.arange(size)
        for wanted in (first, None):
            if wanted is None:
                chosen = left & (bound >= least)
            else:
                chosen = np.zeros(size, dtype=bool)
                chosen[wanted] = left[wanted]
                left[wanted] = False
            if chosen.any():
                scores = self.scores(lists, chosen)
                found = np.flatnonzero(chosen & (scores >= least))
                if len(found) > k:  # ties with the last stay until ids decide
                    kth = np.partition(scores[found], len(found) - k)[len(found) - k]
                    found = found[scores[found] >= kth]
                best = nsmallest(k, best + list(zip((-scores[found]).tolist(), self.ids[found].tolist(), strict=True)))
                least = max(least, -best[-1][0]) if len(best) == k else least
        return best


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = terms = 0
            for text in batch.column(0):
                n = sum(map(len, terms_of(text.as_py())))
                docs, terms = docs + (n > 0), terms + n
            yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])

    found = rows.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def segments(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The segments of (doc_id, text)."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            row = writer.row()
            kinds = (pa.int64() if isinstance(row[c], int) else pa.binary() for c in names)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in zip(names, kinds, strict=True)], names)

        writer = Writer(n_docs, n_terms)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, text)
                    if writer.full():
                        yield closed()
                        writer = Writer(n_docs, n_terms)
        if writer.ids:
            yield closed()

    return rows.mapInArrow(run, SEGMENT)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, dfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(terms.split(b"\0"), pa.binary()), pa.array(np.frombuffer(dfs, "<u4").astype(np.int64))], ["term", "df"])

    return index.select("terms", "dfs").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, qtf) of (query, text): the distinct terms of every query and how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: dict[bytes, int] = {}
                for part in terms_of(text):
                    for t in part:
                        own[t] = own.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(own), pa.int64()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["query", "term", "qtf"])

    return queries.select("query", "text").mapInArrow(run, "query long, term binary, qtf long")


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1))).cast("long")


def first_of(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def searched(index: DataFrame, asked: list[tuple[int, dict[bytes, int]]], k: int) -> DataFrame:
    """(query, doc_id, score): each task's best ``k`` for every one of the queries, of which there is a bounded number."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for n in range(len(batch)):
                segment = Segment({c: batch.column(c)[n].as_py() for c in names})
                for query, terms in asked:
                    best[query] = segment.search(terms, k, best.get(query, []))
        rows = [(q, None if d == NO_ID else d, -s) for q, own in best.items() for s, d in own]
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 10_000], strict=True)], ["query", "doc_id", "score"])

    return index.select(*names).mapInArrow(run, "query long, doc_id long, score long")


#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest scores above 0 for every query.

    Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z in
    small letters. Equal scores are ranked by ascending id. Null and empty texts
    have no term: such documents are in no count and are not found, such
    queries find nothing. Repeated rows are documents of their own, null ids
    come last among equal scores; queries of a null id are left out, and texts
    of one query id are one query. Whole texts are read, however long; other
    columns, whatever their names, are ignored; empty tables give empty results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_col).cast("long").alias("query"), F.col(query_text).alias("text")).filter("query IS NOT NULL")
    n_docs, n_terms = corpus_size(rows)
    with scratch(spark, "lexical") as keep:
        index = keep(segments(rows, n_docs, n_terms), "segments")
        own = query_terms(asked).groupBy("query", "term").agg(F.sum("qtf").alias("qtf"))
        own = own.join(frequencies(index), "term").withColumn("w", F.col("qtf") * weight(F.col("df"), n_docs)).filter("w > 0")
        each = own.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
        each = keep(each, "queries")
        size = F.sum(F.expr("48 + aggregate(terms, 0L, (n, t) -> n + 96 + length(t.term))"))
        n_passes = max(1, -(-(each.agg(size).first()[0] or 0) // PASS_BYTES))
        found = None
        for turn in range(n_passes):
            mine = each.filter(F.pmod(F.xxhash64("query"), F.lit(n_passes)) == turn).collect()  # PASS_BYTES on average
            asked_now = [(r.query, {bytes(t.term): t.w for t in r.terms}) for r in mine]
            part = first_of(searched(index, asked_now, k), k, "query", F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))).drop("place")
            found = part if found is None else found.unionByName(part)
        out = checkpointed(first_of(found, k, "query"))
    return out.select(F.col("query").alias("item_id"), F.col("place").cast("int").alias("rank"), "doc_id", "score")

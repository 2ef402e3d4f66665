"""Suffix-array dedup: bytes under a string of ``WIDTH`` bytes that starts earlier go.

Anchors. Every window of WIDTH bytes is tied to the least hash among its
GRAM-byte grams; equal windows have equal anchors wherever they stand. Windows
in a row with one anchor are a *segment*, so a text gives a row per 35 bytes
or so instead of one per byte.

Segments. Tasks collapse equal segments of their own chunk first. What is left
meets by gram and segment digest: of equal segments all but the first are
removed whole. A gram is in doubt only where it has segments that differ.

Windows. Doubtful segments go back to their texts. Their windows are put in
suffix order within a chunk: sorted by leading bytes, then by a mergesort
whose comparisons find the common extension of two suffixes by binary search
over prefix polynomial hashes. Neighbours that share WIDTH bytes are verified
byte by byte and collapse. What is left of each chunk meets by gram, as bytes,
and is put in suffix order again; all windows but the first of each class are
removed. A gram with many such rows in a chunk, or over all, is hot: its
windows meet by their own 128-bit digest instead, which no text's frequency
makes large, as each chunk sends a class once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WIDTH, GRAM = 100, 32
#: Bytes that a task handles together, and the longest piece of one text.
CHUNK_BYTES, PIECE = 900_000, 1_000_000
POSITION_BITS = 24
U = np.uint64
_rng = np.random.default_rng(20240607)
#: A random value for each byte and two odd bases, the same in every task.
BYTE_VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, ``n`` or more of them."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = 1 << max(20, n.bit_length())
        base = int(BASES[which])
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(1, dtype=np.uint64)
            step = b
            while len(p) < size:  # p, then p * b**len(p)
                p = np.concatenate((p, p * U(step)))
                step = step * step % (1 << 64)
            out.append(p)
        _powers[which] = (out[0], out[1])
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


class Hashed:
    """Bytes with prefix polynomial hashes; any substring's hash takes two lookups."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self._words: np.ndarray | None = None
        values = BYTE_VALUES[data]
        self.prefix, self.inverse = [], []
        for which in (0, 1):
            up, down = powers(which, len(data) + 1)
            p = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values * up[: len(data)], out=p[1:])
            self.prefix.append(p)
            self.inverse.append(down)

    def words(self) -> np.ndarray:
        """The eight bytes from each place on, as one number in their order."""
        if self._words is None:
            n = max(0, len(self.data) - 7)
            self._words = np.zeros(n, dtype=np.uint64)
            for j in range(8):
                self._words <<= U(8)
                self._words |= self.data[j : j + n]
        return self._words

    def of(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hashes of substrings, by their starts and lengths."""
        p = self.prefix[which]
        return (p[start + length] - p[start]) * self.inverse[which][start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Lengths of the common extensions of suffixes a and b, ``most`` at most, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), np.broadcast_to(most, a.shape).astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, width: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b within ``width`` bytes; equal ones by ``or_equal``."""
        n = self.common(a, b, width)
        end = np.minimum(n, width - 1)
        return np.where(n >= width, or_equal, self.data[a + end] < self.data[b + end])


def suffix_sort(h: Hashed, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Order of suffixes by group, then by their first ``width`` bytes: mergesort of runs, all groups at once.

    ``group`` must be sorted. Runs of 1, 2, 4, ... neighbours are merged: the
    place of each element is its place in its own run and the number of
    elements of the other run before it, found by binary search.
    """
    order = np.arange(len(starts))
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.append(edge, len(group)))
    first, size = np.repeat(edge, count), np.repeat(count, count)
    place = order - first
    run, most = 1, int(size.max(initial=0))
    while run < most:
        busy = np.flatnonzero(size > run)  # groups of one run are done
        mine, base = place[busy], first[busy]
        own = mine // run
        other = own ^ 1
        low = np.minimum(other * run, size[busy])
        high = np.minimum(low + run, size[busy])
        begin = low.copy()
        left = own < other  # of equal suffixes those of the left run come first
        me = starts[order[base + mine]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            it = starts[order[base[open_] + mid]]
            before = h.less(it, me[open_], width, ~left[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = base + np.minimum(own, other) * run + (mine - own * run) + (low - begin)
        merged = order.copy()
        merged[target] = order[base + mine]
        order = merged
        run *= 2
    return order


def same_bytes(h: Hashed, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Whether substrings of eight bytes or more are equal, eight bytes at a time."""
    length = np.broadcast_to(length, a.shape)
    ok = np.ones(len(a), dtype=bool)
    at, words = np.arange(len(a)), h.words()
    for j in range(0, int(length.max(initial=0)), 8):
        at = at[ok[at] & (length[at] > j)]
        if not at.size:
            break
        skip = np.minimum(j, length[at] - 8)
        ok[at] = words[a[at] + skip] == words[b[at] + skip]
    return ok


def anchors(h: Hashed, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, place of the anchor of the window that starts at each byte)."""
    n = len(h.data)
    at = np.arange(n - gram + 1)
    g = mix(h.of(at, gram))
    low = (g >> U(POSITION_BITS) << U(POSITION_BITS)) | at.astype(np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return g, (low & U((1 << POSITION_BITS) - 1)).astype(np.int64)


def runs_of(owner: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of windows of one owner, joined."""
    if not len(start):
        return owner, start, n
    order = np.lexsort((start, owner))
    owner, start, n = owner[order], start[order], n[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    first = np.flatnonzero(new)
    return owner[first], start[first], np.add.reduceat(n, first)


DECIDED, SEGMENT, DOUBT, MARK = 0, 1, 2, 3


class Chunk:
    """Pieces of texts laid one behind the other."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]) -> None:
        self.ids = np.array([p[0] for p in pieces], dtype=np.int64)
        self.shift = np.array([p[1] for p in pieces], dtype=np.int64)
        sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.hashed = Hashed(np.frombuffer(b"".join([p[2] for p in pieces]), dtype=np.uint8))

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, start in its text) of bytes of the chunk."""
        p = self.piece(at)
        return self.ids[p], at - self.begin[p] + self.shift[p]


def segments(chunk: Chunk, gram: int = GRAM, width: int = WIDTH) -> list[np.ndarray]:
    """Columns key, sub, doc, start, n, kind of a chunk's segments, equal ones collapsed."""
    h, w = chunk.hashed, width
    g, anchor = anchors(h, gram, w)
    inside = np.zeros(len(anchor) + 1, dtype=np.int8)
    np.add.at(inside, chunk.begin, 1)
    np.add.at(inside, chunk.end - w + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new[chunk.begin] = True
    start = np.flatnonzero(new)
    stop = np.minimum(np.append(start[1:], len(anchor)), (chunk.end - w + 1)[chunk.piece(start)])
    n = stop - start
    at = anchor[start]
    key = g[at]
    sub = mix(h.of(start, n + w - 1, 1) + n.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (at - start).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    doc, pos = chunk.place(start)

    order = np.lexsort((pos, doc, sub, key))
    k, s, d, p, m, b = key[order], sub[order], doc[order], pos[order], n[order], start[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_sub = new_key | np.concatenate(([True], s[1:] != s[:-1]))
    head = np.maximum.accumulate(np.where(new_sub, np.arange(len(k)), 0))
    again = ~new_sub
    rest = np.flatnonzero(again)
    again[rest] = same_bytes(h, b[rest], b[head[rest]], m[rest] + w - 1)  # what only shares a digest stays in doubt
    false = np.zeros(len(k), dtype=bool)
    false[rest] = ~again[rest]
    again &= (d != d[head]) | (p != p[head])  # a row that stands in the chunk twice is no copy of itself
    kinds = np.add.reduceat((new_sub | false).astype(np.int64), np.flatnonzero(new_key))
    several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_key), len(k))))
    kind = np.where(again, DECIDED, np.where(several, DOUBT, SEGMENT))

    out_d, out_p, out_m = runs_of(d[kind == DECIDED], p[kind == DECIDED], m[kind == DECIDED])
    dbt_d, dbt_p, dbt_m = runs_of(d[kind == DOUBT], p[kind == DOUBT], m[kind == DOUBT])
    own = kind == SEGMENT
    mark = k[new_key & several]
    fill = [len(out_d), len(dbt_d), int(own.sum()), len(mark)]
    zeros = np.zeros(len(mark), dtype=np.int64)
    spread = mix(np.concatenate((out_d, dbt_d)).astype(np.uint64))  # these only pass through: dealt by document
    return [
        np.concatenate((spread, k[own], mark)).view(np.int64),
        np.concatenate((spread, s[own], zeros.astype(np.uint64))).view(np.int64),
        np.concatenate((out_d, dbt_d, d[own], zeros)),
        np.concatenate((out_p, dbt_p, p[own], zeros)),
        np.concatenate((out_m, dbt_m, m[own], zeros)),
        np.repeat(np.array([DECIDED, DOUBT, SEGMENT, MARK]), fill),
    ]


def windows(chunk: Chunk, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts in suffix order, class of each, whether it equals the one before)."""
    h = chunk.hashed
    a, b = h.words()[starts], h.words()[starts + 8]
    order = np.lexsort((b, a))
    starts, a, b = starts[order], a[order], b[order]
    group = np.cumsum(np.concatenate(([0], ((a[1:] != a[:-1]) | (b[1:] != b[:-1])).astype(np.int64))))
    starts = starts[suffix_sort(h, starts, group, width)]
    same = np.zeros(len(starts), dtype=bool)
    if len(starts) > 1:
        # The common extension of neighbours counts from WIDTH on; equal hashes of WIDTH bytes tell that.
        near = np.flatnonzero(h.of(starts[1:], width) == h.of(starts[:-1], width))
        same[near + 1] = same_bytes(h, starts[near + 1], starts[near], width)
    return starts, np.cumsum(~same), same


def split(rows: Iterator[tuple[int, bytes]], width: int = WIDTH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of pieces; pieces of a very long text overlap by WIDTH - 1 bytes."""
    chunk, size = [], 0
    for doc, raw in rows:
        for lo in range(0, max(1, len(raw) - width + 1), PIECE):
            part = raw[lo : lo + PIECE + width - 1]
            if len(part) < width:
                continue
            chunk.append((doc, lo, part))
            size += len(part)
            if size >= CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


ROW = "key long, sub long, doc long, start long, n long, kind int"


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def find_segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            last = None
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if (doc, text) != last:  # a row that repeats the one before is the same document
                        yield doc, text_bytes(text)
                    last = (doc, text)

        for pieces in split(rows()):
            cols = segments(Chunk(pieces))
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols[:5]], pa.array(cols[5].astype(np.int32))], [x.split()[0] for x in ROW.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def judged(rows: DataFrame) -> DataFrame:
    """(doc, start, n, doubt): segments to remove, and segments whose windows must be compared."""
    met = rows.repartition("key")
    of_class = Window.partitionBy("key", "sub", "kind")
    of_gram = Window.partitionBy("key")
    seg, at = F.col("kind") == SEGMENT, F.struct("doc", "start")
    met = met.withColumn("first", F.min(at).over(of_class))
    met = met.withColumn("low", F.min(F.when(seg, F.col("sub"))).over(of_gram)).withColumn("high", F.max(F.when(seg, F.col("sub"))).over(of_gram))
    met = met.withColumn("marked", F.max(F.when(F.col("kind") == MARK, 1)).over(of_gram))
    later = seg & (F.col("first") != at)
    several = F.col("marked").isNotNull() | (F.col("low") != F.col("high"))
    doubt = (F.col("kind") == DOUBT) | (seg & ~later & several)
    return met.filter((F.col("kind") == DECIDED) | later | doubt).select("doc", "start", "n", doubt.alias("doubt"))


#: Rows of one gram in a chunk, and over all chunks, from which on it is hot; rows compared together.
HOT_IN_CHUNK, HOT_GRAM, TOGETHER = 16, 4096, 12_000
MARKED, BODY, WINDOW, REMOVED = 0, 1, 2, 3
PIECE_ROW = "key long, sub long, kind int, doc long, start long, n long, body binary"


def piece_rows(kind: int, key: np.ndarray, sub: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, body: list[bytes] | None = None) -> pa.RecordBatch:
    cols = [pa.array(key), pa.array(sub), pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(doc), pa.array(start), pa.array(n)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(body if body is not None else [None] * len(key), pa.binary())], [x.split()[0] for x in PIECE_ROW.split(", ")])


def removed_rows(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows to remove, in runs; dealt by document."""
    doc, start, n = runs_of(doc, start, np.ones(len(doc), dtype=np.int64))
    spread = mix(doc.astype(np.uint64) * U(31) + start.astype(np.uint64)).view(np.int64)
    return piece_rows(REMOVED, spread, spread, doc, start, n)


def window_rows(chunk: Chunk, at: np.ndarray) -> pa.RecordBatch:
    doc, start = chunk.place(at)
    key, sub = (mix(chunk.hashed.of(at, WIDTH, k)).view(np.int64) for k in (0, 1))
    return piece_rows(WINDOW, key, sub, doc, start, np.ones(len(at), dtype=np.int64))


def collapsed(chunk: Chunk, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first windows, later ones) among windows of the chunk, by (id, place)."""
    at, cls, same = windows(chunk, starts)
    shared = same | np.append(same[1:], False)  # windows of classes with two members or more
    alone, at, cls = at[~shared], at[shared], cls[shared]
    doc, pos = chunk.place(at)
    order = np.lexsort((pos, doc, cls))
    at, cls, doc, pos = at[order], cls[order], doc[order], pos[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], cls[1:] != cls[:-1])), np.arange(len(cls)), 0)) if len(cls) else order
    # A place that stands in two chunks' pieces is one window, not a copy of itself.
    later = (doc != doc[head]) | (pos != pos[head])
    return np.sort(np.concatenate((alone, at[~later]))), at[later]


def find_pieces(joined: DataFrame) -> DataFrame:
    """Doubtful segments, collapsed within each chunk: bodies of first windows, and later ones removed."""

    def rows_of(chunk: Chunk, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, later = collapsed(chunk, starts)
        if later.size:
            yield removed_rows(*chunk.place(later))
        if not first.size:
            return
        g, anchor = anchors(chunk.hashed, GRAM, WIDTH)
        new = np.concatenate(([True], (first[1:] != first[:-1] + 1) | (anchor[first[1:]] != anchor[first[:-1]]) | (chunk.piece(first[1:]) != chunk.piece(first[:-1]))))
        begin = first[new]
        n = np.diff(np.append(np.flatnonzero(new), len(first)))
        key = g[anchor[begin]].view(np.int64)
        names, which, count = np.unique(key, return_inverse=True, return_counts=True)
        hot = count[which] >= HOT_IN_CHUNK
        if hot.any():
            yield window_rows(chunk, first[np.repeat(hot, n)])
            hot_names = names[count >= HOT_IN_CHUNK]
            zero = np.zeros(len(hot_names), dtype=np.int64)
            yield piece_rows(MARKED, hot_names, zero, zero, zero, zero)
        if not hot.all():
            begin, n, key = begin[~hot], n[~hot], key[~hot]
            raw = chunk.hashed.data.tobytes()
            body = [raw[b : b + k + WIDTH - 1] for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
            yield piece_rows(BODY, key, np.zeros(len(key), dtype=np.int64), *chunk.place(begin), n, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubts: dict[int, list[tuple[int, int]]] = {}

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    own = sorted({(s["start"], s["n"]) for s in spans or [] if s["doubt"]})
                    if own and doc not in doubts:
                        doubts[doc] = own
                        yield doc, text_bytes(text)

        for pieces in split(rows()):
            chunk = Chunk(pieces)
            starts = []
            for doc, shift, size, begin in zip(chunk.ids.tolist(), chunk.shift.tolist(), (chunk.end - chunk.begin).tolist(), chunk.begin.tolist(), strict=True):
                for s, n in doubts[doc]:
                    lo, hi = max(s - shift, 0), min(s + n - shift, size - WIDTH + 1)
                    if lo < hi:
                        starts.append(np.arange(begin + lo, begin + hi))
            for doc in chunk.ids[:-1].tolist():
                if doc != chunk.ids[-1]:
                    doubts.pop(doc, None)
            if starts:
                yield from rows_of(chunk, np.unique(np.concatenate(starts)))

    return joined.mapInArrow(run, PIECE_ROW)


def all_windows(pieces: list[tuple[int, int, bytes]]) -> tuple[Chunk, np.ndarray]:
    chunk = Chunk(pieces)
    return chunk, np.concatenate([np.arange(b, e - WIDTH + 1) for b, e in zip(chunk.begin.tolist(), chunk.end.tolist(), strict=True)])


def compare_grams(pieces: DataFrame) -> DataFrame:
    """Bodies of one gram put in suffix order together; those of hot grams become window rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        done: list[tuple[int, int, bytes]] = []  # of grams that have ended
        gram, hot = None, False

        def compare(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            chunk, starts = all_windows(rows)
            _, later = collapsed(chunk, starts)
            if later.size:
                yield removed_rows(*chunk.place(later))

        def explode(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows), 4096):
                yield window_rows(*all_windows(rows[lo : lo + 4096]))

        for batch in batches:
            kinds = batch.column(2).to_numpy()
            through = kinds >= WINDOW
            if through.any():
                yield batch.filter(pa.array(through))
            own = batch.filter(pa.array(~through))
            cols = [own.column(k).to_pylist() for k in (0, 2, 3, 4, 6)]
            for key, kind, doc, start, body in zip(*cols, strict=True):
                if key != gram:
                    if hot:
                        yield from explode(held)
                    elif len(held) > 1:  # a body alone has nothing to meet
                        done += held
                    held, gram, hot = [], key, False
                    if len(done) >= TOGETHER:
                        yield from compare(done)
                        done = []
                if kind == MARKED:
                    hot = True
                    continue
                held.append((doc, start, body))
                if hot and len(held) >= 1024 or len(held) > HOT_GRAM:
                    hot = True
                    yield from explode(held)
                    held = []
        if hot:
            yield from explode(held)
        elif len(held) > 1:
            done += held
        if done:
            yield from compare(done)

    met = pieces.repartition("key").sortWithinPartitions("key", "kind")
    return met.mapInArrow(run, PIECE_ROW).select("key", "sub", "kind", "doc", "start", "n")


def first_windows(rows: DataFrame) -> DataFrame:
    """(doc, start, n) of windows to remove: runs that are known, and all but the first of each digest."""
    at = F.struct("doc", "start")
    met = rows.repartition("key").withColumn("first", F.min(at).over(Window.partitionBy("key", "sub", "kind")))
    return met.filter((F.col("kind") == REMOVED) | (F.col("first") != at)).select("doc", "start", "n")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut(raw: bytes, begin: np.ndarray, n: np.ndarray, width: int = WIDTH) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) without ``n`` windows from each ``begin`` on."""
    if not len(begin):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(begin, len(raw)), 1)
    np.add.at(edge, np.minimum(begin + n + width - 1, len(raw)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, text, raw_id): doc_id is one number for each (id, text), ordered by id, null ids last.

    Where every id has one text it is the id itself, and texts are not moved.
    """
    last = F.lit((1 << 63) - 1)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    tagged = rows.select(F.coalesce("raw_id", last).alias("id"), F.col("raw_id").isNull().alias("none"), digest.alias("digest"), "text", "raw_id")
    kinds = tagged.groupBy("id").agg(F.min(F.struct("none", "digest")).alias("low"), F.max(F.struct("none", "digest")).alias("high"))
    if not kinds.filter(F.col("low") != F.col("high")).limit(1).count():
        return tagged.select(F.col("id").alias("doc_id"), "text", "raw_id")
    by = ["id", "none", "digest"]
    names = tagged.select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by)
    # The row ids of a checkpoint are its partition and a count within it: ordered like the range partitions.
    names = checkpointed(names).withColumn("doc_id", F.monotonically_increasing_id())
    return tagged.join(names, by).select("doc_id", "text", "raw_id")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row.

    Texts are UTF-8; null counts as empty; texts shorter than WIDTH bytes stay
    whole. A byte goes if a string of WIDTH bytes over it also starts earlier:
    in a smaller id, or in the same text before. Rows that repeat an id and
    text are one document and get equal results; different texts of one id
    are documents of their own, in the order of their digests. Null ids come
    after all others. Whole texts are read, very long ones in pieces that
    overlap; other columns, whatever their names, are ignored; an empty table
    gives an empty result.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("raw_id"), F.col(text_col).alias("text")))
    found = judged(find_segments(rows)).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "doubt")).alias("spans"))
    joined = rows.join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans", "raw_id")
    dups = first_windows(compare_grams(find_pieces(joined))).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("dups"))
    both = joined.join(dups, F.col("doc_id") == F.col("doc"), "left").select("raw_id", "text", "spans", "dups")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                cols: list[list] = [[], [], [], [], []]
                for text, spans, dups in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    raw = text_bytes(text)
                    sure = [s for s in spans or [] if not s["doubt"]] + (dups or [])
                    begin, n = (np.array([s[c] for s in sure], dtype=np.int64) for c in ("start", "n"))
                    kept, removed, runs = cut(raw, begin, n)
                    for c, v in zip(cols, (len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], [x.split()[0] for x in OUT.split(", ")])

    return both.mapInArrow(finish, OUT)

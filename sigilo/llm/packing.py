"""Packing: hierarchical multi-length packing of tokenised documents.

Each task packs the documents of its own input, a *chunk* at a time, so
nothing is shuffled. Within a chunk, whole windows are cut from documents
longer than the longest tier; every document and every rest is routed to the
smallest tier that holds it. Tiers are packed from the longest down, each in
windows of its own length: a tier's piece opens a window, and the gap behind
it is filled from that tier and shorter ones, longest fitting piece first;
what no whole piece fits is filled by cutting the shortest one, whose rest goes
to the tier that holds it. So all windows are full but the last of a chunk,
which is laid in full windows of the shorter tiers and one padded rest. Windows
are then dealt to step groups so that every group holds equally long windows
and a like share of attention work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import TokenIds

TIERS = (2048, 1024, 512, 256)
#: Documents packed together; each chunk leaves one padded window at most.
CHUNK_DOCS = 8192
CHUNK_TOKENS = 8_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long, pad long"


Piece = tuple[int, int, int]


class Shelves:
    """Pieces (document, start, length) by the smallest tier that holds them, each shelf by length."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.up = sorted(tiers)
        self.shelves: dict[int, list[Piece]] = {t: [] for t in self.up}

    def put(self, piece: Piece) -> None:
        insort(self.shelves[self.up[bisect_left(self.up, piece[2])]], piece, key=length_of)

    def longest(self, tier: int, room: int) -> Piece | None:
        """The longest piece of ``tier`` or shorter ones that fits in ``room``."""
        for t in reversed(self.up):
            if t <= tier and (at := bisect_right(self.shelves[t], room, key=length_of)):
                return self.shelves[t].pop(at - 1)
        return None

    def shortest(self, tier: int) -> Piece | None:
        """The shortest piece of ``tier`` or shorter ones."""
        return next((self.shelves[t].pop(0) for t in self.up if t <= tier and self.shelves[t]), None)


def length_of(piece: Piece) -> int:
    return piece[2]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Windows, each a list of pieces (document, start, length); every token of every document once."""
    longest, shelves = max(tiers), Shelves(tiers)
    out: list[list[Piece]] = []
    rests = []
    for doc, n in enumerate(lengths):
        whole = n // longest * longest
        out += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if whole < n:
            rests.append((doc, whole, n - whole))
    for piece in sorted(rests, key=lambda p: (p[2], -p[0])):
        shelves.shelves[shelves.up[bisect_left(shelves.up, piece[2])]].append(piece)
    for tier in reversed(shelves.up):
        while shelves.shelves[tier]:
            window, room = [shelves.shelves[tier].pop()], tier
            room -= window[0][2]
            while room and (piece := shelves.longest(tier, room) or shelves.shortest(tier)):
                doc, start, n = piece
                take = min(n, room)
                window.append((doc, start, take))
                room -= take
                if take < n:
                    shelves.put((doc, start + take, n - take))
            if room:  # nothing of this tier and shorter ones is left
                out += split_tail(window, tier - room, shelves.up)
            else:
                out.append(window)
    return out


def split_tail(pieces: list[Piece], used: int, tiers: list[int]) -> list[list[Piece]]:
    """The last, open window as full windows of the shorter tiers and one padded rest."""
    sizes, left = [], used
    for t in sorted(tiers, reverse=True):
        while left >= t:
            sizes.append(t)
            left -= t
    sizes += [left] if left else []
    out, queue = [], list(reversed(pieces))
    for size in sizes:
        row, room = [], size
        while room:
            doc, start, n = queue.pop()
            take = min(n, room)
            row.append((doc, start, take))
            room -= take
            if take < n:
                queue.append((doc, start + take, n - take))
        out.append(row)
    return out


def padded(used: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The length a window of ``used`` tokens is stored in: a power of two needs no padding."""
    return used if used & (used - 1) == 0 else max(tiers)


def step_groups(windows: list[list[Piece]], tiers: tuple[int, ...], group: int) -> list[int]:
    """A step group per window: windows of one stored length, dealt by falling attention work, to and fro."""
    out, base = [0] * len(windows), 0
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        by_size.setdefault(padded(sum(p[2] for p in w), tiers), []).append(k)
    for size in sorted(by_size, reverse=True):
        own = sorted(by_size[size], key=lambda k: (-sum(p[2] ** 2 for p in windows[k]), k))
        n = -(-len(own) // group)
        for i, k in enumerate(own):
            turn, at = divmod(i, n)
            out[k] = base + (at if turn % 2 == 0 else n - 1 - at)
        base += n
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    group: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, pad.

    A document is its ids and ``end_id``; null and empty texts are that id
    alone. Sequence ids are unique over the table: the task's number, then a
    count within it. Null ids, ties in length and repeated rows are packed like
    any other rows. A very long text is cut in whole windows; it is held in
    memory once. Other columns, whatever their names, are ignored; an empty
    table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = TokenIds.load(tokenizer), int(end_id).to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 40
        seq, step = first, first
        ids: list[int | None] = []
        raws: list[bytes] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, step, ids, raws, tokens
            windows = plan([len(r) // 4 for r in raws], tiers)
            groups = step_groups(windows, tiers, group)
            cols: list[list] = [[] for _ in range(10)]
            for w, g in zip(windows, groups, strict=True):
                used, at = sum(p[2] for p in w), 0
                size = padded(used, tiers)
                for doc, start, n in w:
                    row = (ids[doc], start, n, zlib.crc32(raws[doc][4 * start : 4 * (start + n)]), len(raws[doc]) // 4, seq, at, size, step + g, size - used)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += n
                seq += 1
            step += max(groups, default=-1) + 1
            ids, raws, tokens = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                for doc, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    raws.append(raw + end)
                    tokens += len(raw) // 4 + 1
                    if len(ids) >= CHUNK_DOCS or tokens >= CHUNK_TOKENS:
                        yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def crc32_of(ids: list[int]) -> int:
    """The checksum that a piece carries, of a list of ids."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())

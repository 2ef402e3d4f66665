"""Line dedup, ranked search and hard negatives against brute force, with the corner cases their docstrings name."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilo.llm import hard_negatives, lexical, line_dedup
from sigilo.llm.perfect_hash import CountIndex, PerfectHash

DOCS = "doc_id long, text string, mark string, gone string, score string, kept string"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "m", "g", "s", "k") for i, t in rows], DOCS)


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 700, 20_000):
        high, low = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        if n > 10:
            high[: n // 2] = high[0]  # half of a key may be common
        found = PerfectHash.from_bytes(PerfectHash.build(high, low).to_bytes()).slots(high, low)
        assert sorted(found.tolist()) == list(range(n))
    count, last = rng.integers(1, 400, n), rng.integers(-5, 9, n)
    index = CountIndex(CountIndex.build(high, low, count, last, 3))
    known, n_docs, ids = index.probe(high, low)
    assert known.all() and (n_docs == np.minimum(count, 255)).all() and (ids[count >= 3] == last[count >= 3]).all()
    known, n_docs, _ = index.probe(high + np.uint64(1), low ^ np.uint64(1 << 40))
    assert not known.any() and not n_docs.any()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([7, 7], np.uint64), np.array([9, 9], np.uint64))


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(SMALL)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    top = {k: max((i for i in own if i is not None), default=None) for k, own in holders.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or (i is not None and top[key(x)] == i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def by_all(rows):
    return sorted(map(tuple, rows), key=repr)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    common = [f"a line that many documents share, number {k} {'é' * (k % 3)}" for k in range(12)] + ["exactly twenty chars", "only nineteen chars"]
    rows = []
    for i in range(300):
        lines = [rng.choice(["  ", "\t", ""]) + (c := rng.choice(common)) .upper() * (rng.random() < 0.2) + c * (rng.random() < 0.9) + rng.choice(["\r", " ", ""]) for _ in range(rng.randrange(0, 6))]
        lines += [f"own line of document {i} with some length"] * rng.randrange(0, 3) + [common[0]] * (i % 3 == 0) + [""] * (i % 4 == 0)
        rng.shuffle(lines)
        rows.append((i - 20, "\n".join(lines)))
    rows += [(None, common[1] + "\n\n" + common[2]), (None, common[1]), (5, common[1] + "\nother text of one id, long enough"), rows[7], rows[7], (900, None), (901, ""), (902, "\n"), (903, ("x" * 40 + "\n") * 20_000)]
    rows += [(950 + k, ("x" * 40 + "\n") * 2) for k in range(3)]
    got = line_dedup.dedup_lines(frame(spark, rows).repartition(5))
    assert by_all(got.collect()) == by_all(brute_lines(rows))
    assert sum(r.n_dropped for r in got.collect()) > 300


def test_lines_by_shards_and_joined(spark, monkeypatch):
    """Every key in a shard of its own task, answers joined by shuffle."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rows = [(i, "\n".join(f"line {k} of a common set of lines" for k in range(40) if (i * k) % 5 == 1) + f"\nthe line of document {i} alone" + "\nheld by all documents there are") for i in range(80)]
    assert by_all(line_dedup.dedup_lines(frame(spark, rows).repartition(3)).collect()) == by_all(brute_lines(rows))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(frame(spark, rows), min_docs=255)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(rows, queries, k=10):
    docs = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    merged = defaultdict(Counter)
    for q, t in queries:
        if q is not None:
            merged[q] += Counter(TERM.findall((t or "").translate(SMALL)))
    out = []
    for q, asked in merged.items():
        scores = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)] + ["the", "The", "élan", "日本", "a1"]
    pick = lambda: words[min(int(rng.expovariate(0.02)), len(words) - 1)]
    rows = [(i * 3 - 90, " ".join(pick() for _ in range(rng.randrange(1, 120)))) for i in range(900)]
    rows += [(5000 + k, rows[4][1]) for k in range(25)] + [(None, rows[4][1]), (None, "w1"), (7001, None), (7002, ""), (7003, " .,-\x01"), (7004, "w3 " * 60_000), rows[9], rows[9]]
    queries = [(q, " ".join(pick() for _ in range(rng.randrange(1, 40)))) for q in range(40)]
    queries += [(100, rows[4][1]), (101, None), (102, ""), (103, "nowhere to be found zzz"), (None, "w1"), (104, "w1"), (104, "w2 W1"), (105, "w3")]
    return rows, queries


def test_search_equals_brute_force(spark, library, monkeypatch):
    rows, queries = library
    items = spark.createDataFrame([(q, t, 1) for q, t in queries], "item_id long, text string, doc_id int")
    want = by_all(brute_search(rows, queries))
    got = lexical.search(frame(spark, rows).repartition(3), items).collect()
    assert by_all(got) == want and len(want) > 400
    for name, value in (("SEGMENT_DOCS", 37), ("FIRST", 5), ("PASS_BYTES", 4000)):  # many segments and passes
        monkeypatch.setattr(lexical, name, value)
    assert by_all(lexical.search(frame(spark, rows).repartition(2), items).collect()) == want


def test_search_of_empty_tables(spark, library):
    rows, queries = library
    items = spark.createDataFrame(queries, "item_id long, text string")
    assert lexical.search(frame(spark, []), items).count() == 0
    assert lexical.search(frame(spark, [(1, None), (2, "...")]), items).count() == 0
    assert lexical.search(frame(spark, rows[:5]), items.limit(0)).count() == 0


def test_blocks_below_the_threshold_stay_closed(library):
    """Only some of a segment's blocks are decompressed, and stored values come back."""
    rng = random.Random(2)
    writer = lexical.Writer(6000, 6000 * 50)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(50)) for _ in range(6000)]
    for i in range(30, 42):
        texts[i] = "rare words here " + texts[i]
    for i, t in enumerate(texts):
        writer.add(i, t)
    segment = lexical.Segment(writer.row())
    best = segment.search({b"rare": 9000, b"words": 9000, b"here": 9000, b"a1": 20, b"b2": 20}, 10, [])
    assert len(best) == 10 and {i for _, i in best} <= set(range(30, 42))
    assert len(segment.opened) <= 20 < len(segment.heads) / 50
    for number, name in enumerate(segment.names[:5]):
        docs = np.concatenate([segment.open(b)[0] for b in range(segment.blocks[number], segment.blocks[number + 1])])
        assert docs.tolist() == [i for i, t in enumerate(texts) if name.decode() in t.split()]


def test_long_texts_are_split_between_terms(monkeypatch):
    text = " ".join(f"Wörd{k}" for k in range(3000)) + "x" * 5000
    monkeypatch.setattr(lexical, "PART", 100)
    assert [t for part in lexical.terms_of(text) for t in part] == [t.encode() for t in TERM.findall(text.translate(SMALL))]


def brute_mine(rows, is_anchor, positives=5, negatives=10, scale=256):
    rows = [(i, label, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, label, v in rows if None not in (i, label, v) and None not in v and np.isfinite(v).all()]
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-int(v @ w), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return out


VECTORS = "vec_id long, label int, embedding array<float>, window string, rank int"


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 12))
    rows = [(int(i), int(rng.integers(0, 4)), (centres[i % 6] + 0.7 * rng.standard_normal(12)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 3, rows[3][2]) for i in range(150)]  # a group of copies: ties
    rows += [(2000, None, rows[1][2]), (2001, 1, None), (2002, 1, [*rows[1][2][:11], None]), (2003, 1, [*rows[1][2][:11], float("inf")]), (2004, 1, [float("nan")] * 12), (None, 1, rows[1][2]), (2100, 2, [0.0] * 12)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], VECTORS).repartition(4)
    want = by_all(brute_mine(rows, lambda i: i % 50 == 0))
    assert by_all(hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()) == want and len(want) > 500
    for name, value in (("BLOCK_ROWS", 60), ("PASS_ANCHORS", 7), ("DIGIT", 3), ("TILE", 2)):  # many blocks, passes and rounds
        monkeypatch.setattr(hard_negatives, name, value)
    assert by_all(hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()) == want


def test_negatives_of_odd_tables(spark):
    one = F.col("vec_id") % 2 == 0
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), one).count() == 0
    few = [(1, 1, [1.0, 0.0], "w", 1), (3, 2, [0.5, 0.1], "w", 1)]
    assert hard_negatives.mine(spark.createDataFrame(few, VECTORS), one).count() == 0  # no anchor
    wide = [(2, 1, [3e6, 1e6]), (4, 1, [2e6, 5e5]), (5, 2, [1e6, 1e6]), (6, 2, [-1e6, 0.0]), (7, 2, [1.0]), (4, 1, [2e6, 5e5])]
    got = hard_negatives.mine(spark.createDataFrame([(*r, "w", 1) for r in wide], VECTORS), one)
    assert by_all(got.collect()) == by_all(brute_mine([r for r in wide if len(r[2]) == 2], lambda i: i % 2 == 0)) and got.count()
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(2, 1, [1e9, 1e9], "w", 1)], VECTORS), one)

"""Secret scans: pattern and token candidates, judged by corpus-wide ownership.

Candidates are the three base kinds (always kept) and *tokens*: long runs of
base64-like characters with mixed classes and high entropy. The SHA-256 of
each candidate's value is counted over the whole corpus by distinct
repositories and owners. A value that many owners have is an example that was
copied around; a value of few owners that does not look like a placeholder is
taken for live. Token spans are added only where the value is live and no base
span covers them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 8, 16, 32, 24
#: Words of placeholders: a value holding one is an example whoever owns it.
PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|your[_-]|xxxx|dummy|(.)\1{5,}|123456|abcdef", re.IGNORECASE | re.ASCII)
SPAN = "array<struct<kind:int,start:int,stop:int,value:string,looks_live:boolean>>"
TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("looks_live", pa.bool_())]))


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def long_runs(pattern: re.Pattern, text: str, least: int) -> list[tuple[int, int]]:
    """Spans of the pattern's maximal runs of ``least`` characters or more."""
    return [m.span() for m in pattern.finditer(text) if m.end() - m.start() >= least]


#: The same runs, found without stopping at every short one.
LONG_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
LONG_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, value) of base spans and tokens; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(2, *m.span(), m[0]) for m in LONG_HEX.finditer(text)]
    base, at = united((s, e) for _, s, e, _ in out), 0
    for m in LONG_TOKEN.finditer(text):
        v = m[0]
        while at < len(base) and base[at][1] <= m.start():  # tokens come in order: these end before all that follow
            at += 1
        if at < len(base) and base[at][0] < m.end():
            continue
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= 3.5:
            out.append((3, *m.span(), v))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """doc_id, text_key (the text's MD5), repo, owner and the candidate spans of every row (values as SHA-256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column(4).to_pylist():
                spans.append([{"kind": k, "start": s, "stop": e, "value": hashlib.sha256(v.encode()).hexdigest(), "looks_live": not PLACEHOLDER.search(v)} for k, s, e, v in candidates(text or "")])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, TYPE)], ["doc_id", "text_key", "repo", "owner", "spans"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, f"doc_id long, text_key string, repo string, owner string, spans {SPAN}")


def text_key(text: Column) -> Column:
    """What stands for a text where its spans are brought to it: equal texts have equal spans."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def ownership(found: DataFrame, copied_owners: int = 3) -> DataFrame:
    """n_repos, n_owners and copied of every candidate value, over the whole corpus.

    Rows are counted by value, owner and repository, then by value and owner,
    then by value, so a value that a third of all rows hold is pre-aggregated
    before it is sent. A repository counts once under each of its owners.
    """
    each = found.select("repo", "owner", F.explode("spans").alias("s")).select("repo", "owner", F.col("s.value").alias("value"))
    by_repo = each.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    owned = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))
    return owned.withColumn("copied", F.col("n_owners") >= copied_owners)


def digest_of(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 3) -> DataFrame:
    """One row per document: doc_id, text_key, spans (kind, start, stop, value, n_owners, n_repos, live).

    ``docs`` has a column for the repository (a document by default) and one
    for its owner (the source). Null texts are empty; null ids, repositories or
    owners are one of their own. Documents without candidates have an empty
    array. Spans that start alike are ordered by kind. Repeated rows give
    repeated rows, each counted as one more span, of one repository. Whole
    texts are read, in time linear in their length; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    found = checkpointed(scan(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    owned = ownership(found, copied_owners)
    judged = (
        found.select("row", F.explode("spans").alias("s"))
        .select("row", "s.*")
        .join(owned, "value")
        .withColumn("live", F.col("looks_live") & ~F.col("copied"))
        .filter((F.col("kind") < 3) | F.col("live"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "value", "n_owners", "n_repos", "live"))).alias("spans"))
    )
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string,n_owners:bigint,n_repos:bigint,live:boolean>>")
    return found.select("row", "doc_id", "text_key").join(judged, "row", "left").select("doc_id", "text_key", F.coalesce("spans", empty).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_live."""
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = digest_of(F.filter("spans", lambda s: s["kind"] < 3))
    return scanned.select(
        "doc_id",
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        digest_of(F.col("spans")).alias("spans"),
        kind(3).alias("n_token"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


#: Parts into which rows of one text are dealt where its spans are brought to them.
SALTS = 16


def masked(text: str, starts: list[int], stops: list[int]) -> str:
    """``text`` with asterisks over the spans, which may overlap."""
    out, last = [], 0
    for s, e in united(zip(starts, stops, strict=True)):
        out += [text[last:s], "*" * (e - s)]
        last = e
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every live span masked by asterisks of its length; other rows as they were.

    Spans are brought to their rows by the text alone, so null ids and several
    texts of one id make no difference. All columns stay, whatever their names;
    documents stay, and so do values that were copied around.
    """
    key, salt, begin, end = (fresh(n, docs.columns) for n in ("text_key", "salt", "starts", "stops"))
    live = scanned.select("text_key", F.filter("spans", lambda s: s["live"]).alias("live")).filter(F.size("live") > 0).groupBy("text_key").agg(F.first("live").alias("live"))
    live = live.select(F.col("text_key").alias(key), F.col("live.start").alias(begin), F.col("live.stop").alias(end), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, s, e) for t, s, e in zip(texts, starts, stops, strict=True)], dtype=object)

    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn(key, text_key(text)).withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int"))
    joined = keyed.join(live, [key, salt], "left")
    # Only texts with a live span are sent to Python.
    new = F.coalesce(mask(F.when(F.col(begin).isNotNull(), text), F.col(begin), F.col(end)), text)
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])

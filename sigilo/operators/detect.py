"""Detection of sensitive spans, pair emission, replacement and counting.

Detection is one Arrow-batched function over the text: each detector's
compiled pattern is tried where its matches can begin, and these carry their places. It is a narrow
projection without a shuffle, however many documents there are; texts that
hold nothing a detector could find never leave the JVM. Replacement is by
Spark's own functions.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DETECTORS, PROCESS, Detector
from ..functions.text import CPF_FIRST, CPF_SECOND, WS, once

PAIR = "struct<o:string,s:string,kind:string>"
PAIRS = f"array<{PAIR}>"
#: A text without any of these holds nothing that a detector finds.
CANDIDATE = r"(?i)[0-9]|@|rua|r\.|av|pra[cçÇ]a|rod|estr"


def spans(text: Column, pattern: str | re.Pattern, groups: int = 0) -> Column:
    """array<struct<b, e, m0, m1, ...>>: all matches with their half-open ranges and groups; null texts have none."""
    compiled, names = re.compile(pattern), [f"m{g}" for g in range(groups + 1)]

    @once
    @F.pandas_udf(f"array<struct<b:int,e:int,{','.join(f'{n}:string' for n in names)}>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"b": m.start(), "e": m.end(), **{n: m[g] or "" for g, n in enumerate(names)}} for m in compiled.finditer(t or "")] for t in texts], dtype=object)

    return found(text)


def protected(text: Column) -> Column:
    """Ranges of process numbers, which are never masked."""
    return spans(text, PROCESS.python)


# The kernel: plain functions of one text.


NO_DIGITS = re.compile("[^0-9]+")
#: Tables that put a character in the place of every digit: one pass over a string, no match for each digit.
BLANKS = {by: str.maketrans("0123456789", by * 10) for by in "0*"}


def only_digits(s: str) -> str:
    return NO_DIGITS.sub("", s)


def cpf_holds(value: str) -> bool:
    """Eleven digits, not all equal, with the two check digits."""
    d = [int(c) for c in only_digits(value)]
    if len(d) != 11 or len(set(d)) == 1:
        return False
    for at, weights in ((9, CPF_FIRST), (10, CPF_SECOND)):
        rest = sum(x * w for x, w in zip(d, weights, strict=False)) % 11
        if (0 if rest < 2 else 11 - rest) != d[at]:
            return False
    return True


def zeros(s: str) -> str:
    return "0" * len(s)


def blank_digits(s: str, by: str = "0") -> str:
    return s.translate(BLANKS[by])


def _label(m: re.Match) -> list[tuple[str, str]]:
    return [(m[0], m[1] + zeros(m[2]))]


def _label_and_number(m: re.Match) -> list[tuple[str, str]]:
    return [*_label(m), (m[2], zeros(m[2]))]


def _bare_too(m: re.Match, number: str, masked: str) -> list[tuple[str, str]]:
    """The match, and its number without marks where it has some."""
    bare = only_digits(number)
    return [(m[0], masked)] + ([(bare, zeros(bare))] if bare != number else [])


Emission = Callable[[re.Match], list[tuple[str, str]]]
EMIT: dict[str, Emission] = {
    "cpf": lambda m: [(m[0], blank_digits(m[0], "*"))],
    "nit_labelled": lambda m: _bare_too(m, m[2], m[1] + blank_digits(m[2])),
    "nit": lambda m: _bare_too(m, m[0], blank_digits(m[0])),
    "oab_named": lambda m: [(m[0], f"{(m[1][0].upper() + '.').ljust(len(m[1]))} {m[2]}{zeros(m[3])}")],
    "phone": lambda m: [(m[0], blank_digits(m[0]))],
    "email": lambda m: [(m[0], "*" * len(m[0]))],
    "address": lambda m: [(m[0], "*" * len(m[0]))],
    "verifier": lambda m: [(m[0], m[1] + zeros(m[2]) + (m[3] or ""))],
    "verifier_footer": lambda m: [(m[0], zeros(m[1]) + m[2])],
    "long_id": lambda m: [(m[0], zeros(m[0]))],
    **{k: _label for k in ("oab", "oab_zero", "oab_under", "oab_compact")},
    **{k: _label_and_number for k in ("benefit", "voter", "crm", "crm_compact", "identity")},
}
VALID: dict[str, Callable[[re.Match], bool]] = {"cpf": lambda m: cpf_holds(m[0]), "long_id": lambda m: m[0].strip("0") != ""}
#: Where a detector's matches begin, so that its pattern is tried at no other place. By the length of the first run of
#: digits, for those that begin with a number; and by what stands so many characters behind the begin, in small letters, for the others.
LENGTHS = {"process_number": {7, 9, 13, 14, 16, 20}, "cpf": {3, 6, 9, 11}, "nit": {3, 8, 10, 11}, "verifier_footer": set(range(8, 15)), "long_id": set(range(10, 16))}
ANCHORS = {
    "nit_labelled": (("nit", 0), ("nis", 0), ("pis", 0), ("pasep", 0)), "benefit": (("nb", 0), ("benef", 0), ("mero", 2), ("esp", 0)), "voter": (("tulo", 2),), "oab": (("oab", 0),), "oab_zero": (("0ab", 0),),
    "oab_under": (("oab", 0),), "crm": (("crm", 0), ("cremerj", 0)), "crm_compact": (("crm", 0),), "identity": (("id", 0), ("rg", 0)), "verifier": (("digo", 2),),
    "address": (("rua", 0), ("r.", 0), ("av", 0), ("trav", 0), ("pra", 0), ("rod", 0), ("estr", 0)),
}
#: A phone number begins with two digits apart, or four or five of its own, or eight or nine in one, or with a bracket.
PHONE = {2, 4, 5, 8, 9}
RUNS, SPACE = re.compile("[0-9]+"), re.compile(WS)
CAPITALS, LETTERS = string.ascii_uppercase, string.ascii_letters
WORD_CHARS = frozenset(LETTERS + string.digits + "_")
SMALL = str.maketrans(CAPITALS, string.ascii_lowercase)
MAIL_CHARS = LETTERS + string.digits + "._%+-"


def all_at(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


#: So many detectors do without the text's runs of digits.
FEW = 3


class Text:
    """One text, with what the detectors' matches begin with and the ranges of its process numbers, in order and disjoint."""

    def __init__(self, text: str) -> None:
        low = text.lower()
        self.text, self.low = text, low if len(low) == len(text) else text.translate(SMALL)
        self.known: dict[str, list[re.Match]] = {}
        #: (begin, length) of runs of digits at a word edge, and places two characters before other runs of four to six; none before ``dealt``.
        self.numbers: list[tuple[int, int]] | None = None
        self.compact: list[int] = []

    def dealt(self) -> Text:
        """This text with its runs of digits found, by one look that pays where several detectors need them."""
        self.numbers = []
        for m in RUNS.finditer(self.text):
            b, e = m.span()
            if not b or self.text[b - 1] not in WORD_CHARS:
                self.numbers.append((b, e - b))
            elif b > 1 and 4 <= e - b <= 6:
                self.compact.append(b - 2)
        return self

    @cached_property
    def processes(self) -> list[re.Match]:
        return self.searched(PROCESS.name, PROCESS.python)

    @cached_property
    def begins(self) -> list[int]:
        return [m.start() for m in self.processes]

    @cached_property
    def ends(self) -> list[int]:
        return [m.end() for m in self.processes]

    def of_lengths(self, lengths: set[int]) -> list[int]:
        return [b for b, n in self.numbers if n in lengths]

    def tried(self, pattern: re.Pattern, places: Iterable[int]) -> list[re.Match]:
        """The matches that begin at one of these places, which come in order; none reaches into another."""
        out, end = [], 0
        for at in places:
            if at >= end and (m := pattern.match(self.text, at)):
                out.append(m)
                end = m.end()
        return out

    def matches(self, name: str) -> list[re.Match]:
        if name not in self.known:
            self.known[name] = self.searched(name, DETECTORS[name].python)
        return self.known[name]

    def searched(self, name: str, pattern: re.Pattern) -> list[re.Match]:
        """What ``finditer`` of the pattern gives."""
        if name in ANCHORS:
            places = [at - back for part, back in ANCHORS[name] for at in all_at(self.low, part) if at >= back]
            return self.tried(pattern, sorted(places) if len(ANCHORS[name]) > 1 else places)
        if name == "email":
            return self.mails(pattern)
        if self.numbers is None:
            return list(pattern.finditer(self.text))
        if name in LENGTHS:
            return self.tried(pattern, self.of_lengths(LENGTHS[name]))
        if name == "phone":
            return self.tried(pattern, sorted([*self.of_lengths(PHONE), *all_at(self.text, "(")]))
        if name == "oab_compact":
            return self.tried(pattern, self.compact)
        if name == "oab_named":
            return self.tried(pattern, self.before_compact())
        return list(pattern.finditer(self.text))

    def before_compact(self) -> Iterator[int]:
        """Every place in the run of capitals that stands, behind white space, before a compact registration."""
        for place in self.compact:
            end = place
            while end and SPACE.match(self.text, end - 1):
                end -= 1
            begin = end
            while begin and ((c := self.text[begin - 1]) in CAPITALS or "À" <= c <= "Ý"):
                begin -= 1
            yield from range(begin, end - 2) if end < place else ()

    def mails(self, pattern: re.Pattern) -> list[re.Match]:
        """The matches around each @: from the begin of the run of an address's characters before it, or behind the match before."""
        out, end, behind = [], 0, 0
        for at in all_at(self.text, "@"):
            begin = max(end, behind + len(self.text[behind:at].rstrip(MAIL_CHARS)))
            behind = at + 1
            if begin < at and (m := pattern.match(self.text, begin)):
                out.append(m)
                end = m.end()
        return out

    def free(self, m: re.Match) -> bool:
        """Whether the match touches no process number."""
        if not self.processes:
            return True
        k = bisect_left(self.begins, m.end()) - 1  # the last that begins before the match ends
        return k < 0 or self.ends[k] <= m.start()

    def valid(self, name: str) -> Iterable[re.Match]:
        ok = VALID.get(name)
        return (m for m in self.matches(name) if (ok is None or ok(m)) and self.free(m))

    def pairs(self, names: Iterable[str]) -> dict[str, tuple[str, str]]:
        """original -> (substitute, kind) in order; the first for an original wins, unequal lengths fall away."""
        out: dict[str, tuple[str, str]] = {}
        names = list(names)
        if self.numbers is None and len(names) > FEW:
            self.dealt()
        for name in names:
            emit = EMIT[name]
            for m in self.valid(name):
                for o, s in emit(m):
                    if o and len(o) == len(s):
                        out.setdefault(o, (s, name))
        return out

    def count(self, *names: str) -> int:
        return sum(len(self.matches(name)) for name in names)

    def findings(self) -> dict:
        """Counts disregard protected ranges, but for long identifiers; NITs are distinct by digits."""
        if self.numbers is None:
            self.dealt()
        nits = {only_digits(m[2]) for m in self.matches("nit_labelled")} | {only_digits(m[0]) for m in self.matches("nit")}
        return {
            "cpfs": sum(cpf_holds(m[0]) for m in self.matches("cpf")), "nits": len(nits), "oabs": self.count("oab", "oab_zero", "oab_under", "oab_compact"), "crms": self.count("crm", "crm_compact"),
            "addresses": self.count("address"), "identifiers": sum(1 for _ in self.valid("long_id")), "processes": list(dict.fromkeys(m[0] for m in self.processes)),
        }


def lists(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    """The values cut into lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


#: Texts whose results are held as Python objects at once; what comes of them is kept in Arrow's form.
PART = 500


def in_parts(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``f`` of columns, a part of their rows at a time."""

    def whole(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays([f(*(c.slice(lo, PART) for c in columns)) for lo in range(0, max(len(columns[0]), 1), PART)])

    return whole


def listed(every: list[dict[str, tuple[str, str]]]) -> pa.Array:
    """The pairs of each text as an array of structs, column by column: no object for every pair."""
    columns = [[o for own in every for o in own], *([v[k] for own in every for v in own.values()] for k in range(2))]
    return lists(map(len, every), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["o", "s", "kind"]))


def worth(text: Column) -> Column:
    """The text where a detector may find something, else null, so that it need not be sent to Python."""
    return F.when(text.rlike(CANDIDATE), text)


def add_pairs(df: DataFrame, detectors: list[Detector] | None = None, text_col: str = "text", out: str = "pairs") -> DataFrame:
    """``df`` with the unique pairs of all detectors in their order: array<struct<o, s, kind>>.

    The first pair for an original wins, and pairs of unequal lengths fall
    away. Null texts have no pairs. Names are added by ``names.map_pairs``,
    which needs a dictionary.
    """
    chosen = [d.name for d in (DETECTORS.values() if detectors is None else detectors)]

    @once
    @F.arrow_udf(PAIRS)
    def found(texts: pa.Array) -> pa.Array:
        return in_parts(lambda part: listed([Text(t.as_py()).pairs(chosen) if t.is_valid else {} for t in part]))(texts)

    return df.withColumn(out, found(worth(F.col(text_col))))


def by_length(pairs: Column) -> Column:
    """Pairs by falling length of the original; equal lengths keep their order."""
    numbered = F.transform(pairs, lambda p, k: F.struct((-F.length(p["o"])).alias("n"), k.alias("k"), p.alias("p")))
    return F.transform(F.array_sort(numbered), lambda x: x["p"])


def apply_pairs(text: Column, pairs: Column, longest_first: bool = True) -> Column:
    """Literal replacement of each pair's original by its substitute, one after the other."""
    ordered = by_length(pairs) if longest_first else pairs
    return F.aggregate(ordered, text, lambda t, p: F.when(p["o"] == "", t).otherwise(F.replace(t, p["o"], p["s"])))


COUNTS = ["cpfs", "nits", "oabs", "crms", "addresses", "identifiers"]
FINDINGS = "struct<cpfs:bigint,nits:bigint,oabs:bigint,crms:bigint,addresses:bigint,identifiers:bigint,processes:array<string>>"


def counted(every: list[dict]) -> pa.Array:
    """What ``Text.findings`` gives, as an array of structs."""
    counts = [pa.array([f[c] for f in every], pa.int64()) for c in COUNTS]
    numbers = lists([len(f["processes"]) for f in every], pa.array([p for f in every for p in f["processes"]], pa.string()))
    return pa.StructArray.from_arrays([*counts, numbers], [*COUNTS, "processes"])


def findings(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with cpfs, nits, oabs, crms, addresses, identifiers (counts) and processes (distinct numbers).

    Counts of CPFs and NITs disregard protected ranges, those of long
    identifiers respect them, as the reference does. Names are counted by
    ``names.count_names``, which needs a dictionary.
    """

    @once
    @F.arrow_udf(FINDINGS)
    def found(texts: pa.Array) -> pa.Array:
        return in_parts(lambda part: counted([Text(t.as_py() or "").findings() for t in part]))(texts)

    got = df.withColumn("__found", found(worth(F.col(text_col))))
    return got.select(*[F.col(f"`{c}`") for c in df.columns], "__found.*")


def total_findings(names: Column | None = None) -> Column:
    """Sum of sensitive findings; process numbers do not count."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in COUNTS]
    return sum(parts, F.lit(0) if names is None else F.coalesce(names, F.lit(0))).cast("long")


class EmitPairs:
    """The body of a table function over (doc_id, page, text): the pairs of a partition's texts; of equal originals the first counts."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def eval(self, row: Row) -> Iterable[tuple]:
        for k, (original, (substitute, kind)) in enumerate(Text(row["text"] or "").pairs(DETECTORS).items()):
            if original not in self.seen:
                self.seen.add(original)
                yield row["doc_id"], row["page"], k, original, substitute, kind


def register_emit_pairs(spark: SparkSession, name: str = "emit_pairs") -> None:
    """Makes ``emit_pairs(TABLE(t) PARTITION BY doc_id ORDER BY page)`` known to SQL: (doc_id, page, k, o, s, kind), a row per pair."""
    spark.udtf.register(name, F.udtf(EmitPairs, returnType="doc_id bigint, page bigint, k int, o string, s string, kind string"))

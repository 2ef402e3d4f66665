"""Detector patterns of the redaction mode: fixed values of the reference.

``\\b`` stands for an ASCII word edge and case is ignored as ASCII letters do,
accented ones by both their forms. ``java`` gives the form for Spark,
``python`` the compiled one, ``re2`` the one for engines without look-around.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from .text import EDGE, WS

#: Accented letters of the patterns, all inside classes.
ACCENTS = "íúéóçá"


def both_cases(pattern: str) -> str:
    for c in ACCENTS:
        pattern = pattern.replace(c, c + c.upper())
    return pattern


@cache
def compiled(pattern: str, ignore_case: bool) -> re.Pattern:
    """The pattern as the reference's engine reads it: its white space, and lines that end at any line end."""
    if ignore_case:
        pattern = both_cases(pattern)
    inner = WS[1:-1]
    pattern = pattern.replace(r"\d", "[0-9]").replace(r"[-\s]", f"[{inner}-]").replace(r"\s", WS).replace(r"\z", r"\Z").replace(".+?", "[^\n\r\u2028\u2029]+?")
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0))


@dataclass(frozen=True)
class Detector:
    """A pattern, its number of groups, and the pairs it emits.

    Pairs are (original, substitute) in SQL over the groups m0, m1, ...; an
    optional condition tells when a pair or the whole match counts.
    """

    name: str
    pattern: str
    groups: int
    pairs: tuple[tuple[str, str, str], ...]
    ignore_case: bool = False
    valid: str = "true"

    @property
    def java(self) -> str:
        p = self.pattern
        # Where a word character stands inside, one side tells whether an edge is one.
        if p.startswith(r"\b") and self.name != "oab_named":
            p = "(?<![A-Za-z0-9_])" + p[2:]
        if p.endswith(r"\b"):
            p = p[:-2] + "(?![A-Za-z0-9_])"
        return ("(?i)" + both_cases(p) if self.ignore_case else p).replace(r"\d", "[0-9]").replace(r"\b", EDGE)

    @property
    def python(self) -> re.Pattern:
        return compiled(self.pattern, self.ignore_case)

    @property
    def re2(self) -> str:
        p = self.pattern
        if self.name == "address":  # no look-ahead: the stop is matched behind group 1, and names of experts' streets are told by the caller
            p = "(" + p.replace(r"(?!\s+PERICIAL\b)", "").replace("(?=", ")(?:")
        return ("(?i)" if self.ignore_case else "") + p.replace(r"\d", "[0-9]")


def _zeros(x: str) -> str:
    return f"repeat('0', length({x}))"


def _digits(x: str) -> str:
    return f"translate({x}, '0123456789', '0000000000')"


_FULL = "m0"
_BARE = "translate(m{0}, '.-', '')"
_LABEL = (_FULL, f"concat(m1, {_zeros('m2')})", "true")
_NUMBER = ("m2", _zeros("m2"), "true")

PROCESS = Detector("process_number", r"\b\d{7}-?\d{2}\.?\d{4}\.?\d{1}\.?\d{2}\.?\d{4}\b", 0, ())
NUMBER = r"(\d{2,6}(?:\.\d{3})?)"

DETECTORS: dict[str, Detector] = {
    d.name: d
    for d in (
        Detector("cpf", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", 0, ((_FULL, "translate(m0, '0123456789', '**********')", "true"),), valid="cpf"),
        Detector(
            "nit_labelled", r"\b((?:NIT|NIS|PIS(?:/PASEP)?|PASEP)\s*:?\s*)(\d{11}|\d{10}-\d|\d{3}\.\d{5}\.\d{2}-\d)\b", 2,
            ((_FULL, f"concat(m1, {_digits('m2')})", "true"), (_BARE.format(2), _zeros(_BARE.format(2)), f"{_BARE.format(2)} <> m2")), True,
        ),
        Detector("nit", r"\b\d{3}\.?\d{5}\.?\d{2}-?\d\b", 0, ((_FULL, _digits("m0"), "true"), (_BARE.format(0), _zeros(_BARE.format(0)), f"{_BARE.format(0)} <> m0"))),
        Detector("benefit", r"\b((?:NB\.?|Benef[ií]cio(?:\s+Prev\.?)?|N[úu]mero\s+do\s+Benef[ií]cio|Esp[eé]cie/NB)\s*[:.]?\s*(?:--/)?)(\d{6,12})\b", 2, (_LABEL, _NUMBER), True),
        Detector("voter", r"\b((?:T[ií]tulo\s+de\s+Eleitor(?:\s+N[úu]mero)?|T[ií]tulo)\s*:?\s*)(\d{10,13})\b", 2, (_LABEL, _NUMBER), True),
        Detector("oab", r"\b(OAB(?:/[A-Z]{2}| [A-Z]{2})?:?\s*(?:n\.?|nº\.?)?\s*)" + NUMBER + r"\b", 2, (_LABEL,), True),
        Detector("oab_zero", r"\b(0AB(?:/[A-Z]{2}| [A-Z]{2})?:?\s*)" + NUMBER + r"\b", 2, (_LABEL,), True),
        Detector("oab_under", r"\b(OAB[-/ ]?[A-Z]{2}\)?\s+sob\s+o\s+n\.?\s*)" + NUMBER + r"\b", 2, (_LABEL,), True),
        Detector(
            "oab_named", r"\b([A-ZÀ-Ý]{3,})\s+([A-Z]{2})(\d{4,6})\b", 3,
            ((_FULL, f"concat(substring(m1, 1, 1), '.', repeat(' ', length(m1) - 2), ' ', m2, {_zeros('m3')})", "true"),),
        ),
        Detector("oab_compact", r"\b([A-Z]{2})(\d{4,6})\b", 2, (_LABEL,)),
        Detector("crm", r"\b((?:CRM(?:/[A-Z]{2})?|CREMERJ)\s*)(\d{4,10}|\d{2,3}\.\d{3})\b", 2, (_LABEL, _NUMBER), True),
        Detector("crm_compact", r"\b(CRM[A-Z]{2})(\d{4,10})\b", 2, (_LABEL, _NUMBER), True),
        Detector("identity", r"\b((?:Identidade|Id\.?|Ident\.?|RG)\s*(?:n[.º]?\s*)?)(\d[0-9.\-/]{4,8}\d)\b", 2, (_LABEL, _NUMBER), True),
        Detector("phone", r"(?:\(\d{2}\)\s*|\b\d{2}\s*)?\b\d{4,5}[-\s]?\d{4}\b", 0, ((_FULL, _digits("m0"), "true"),)),
        Detector("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0, ((_FULL, "repeat('*', length(m0))", "true"),), True),
        Detector(
            "address",
            r"\b(?:Rua|R\.|Avenida|Av\.?|Travessa|Trav\.?|Pra[cç]a|Rodovia|Rod\.?|Estrada|Estr\.?)\b(?!\s+PERICIAL\b)\s+.+?"
            r"(?=\s+(?:Processo|CPF|OAB|CRM|Contato|E-?mail|Endere[cç]o|Parte|P[aá]gina|C[aá]lcul[oa])\b|[,;\n]|\z)",
            0, ((_FULL, "repeat('*', length(m0))", "true"),), True,
        ),
        Detector("verifier", r"\b(c[oó]digo\s+verificador\s+)(\d{8,14})(v\d+)?\b", 3, ((_FULL, f"concat(m1, {_zeros('m2')}, m3)", "true"),), True),
        Detector("verifier_footer", r"\b(\d{8,14})(\s*\.?\s*V\d+)\b", 2, ((_FULL, f"concat({_zeros('m1')}, m2)", "true"),), True),
        Detector("long_id", r"\b\d{10,15}\b", 0, ((_FULL, _zeros("m0"), "true"),), valid="translate(m0, '0', '') <> ''"),
    )
}

"""Scalar column functions: normalising, formatting, masking, tests of identifiers.

All are built from Spark's own functions, so they stay in the JVM. An argument
``c`` is a string column; absent values are empty strings, as in the data model.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as the reference's engine sees it, NBSP and others included.
WS = r"[\t-\r    -     　﻿]"
#: Accented letters and what they fold to.
ACCENTED = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝáàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUY" + "aaaaaaceeeeiiiinooooouuuuyy"
#: Fixed value: surnames too common to identify anyone.
COMMON_SURNAMES = (
    "ALMEIDA ALVES ANDRADE ARAUJO BARBOSA CARVALHO COSTA DIAS FERNANDES FERREIRA GOMES LIMA LOPES MARTINS MENDES "
    "MORAES NASCIMENTO OLIVEIRA PEREIRA RIBEIRO ROCHA RODRIGUES SANTOS SILVA SOARES SOUSA SOUZA"
).split()
CONNECTIVES = ["de", "da", "das", "do", "dos"]
#: A word edge as the reference's engine sees it: ASCII letters, digits and underscore are word characters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def word(flags: str, *words: str) -> str:
    """One of these words from a word's start; they begin with ASCII letters and go on as patterns under the flags.

    The first letter is matched before anything is looked at, as other places then fail by one
    comparison. The look back keeps the flags, by which ſ and the Kelvin sign are letters.
    """
    firsts = dict.fromkeys(w[0] for w in words)
    rest = "|".join((f"(?<={w[0]})" if len(firsts) > 1 else "") + w[1:] for w in words)
    return f"[{''.join(c.upper() + c.lower() for c in firsts)}]{flags}(?<![A-Za-z0-9_].)(?:{rest})"


def replace_all(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern is found; word edges are written \\b and mean EDGE."""
    return F.coalesce(c, F.lit("")).rlike(pattern.replace(r"\b", EDGE))


def holds(c: Column, low: Column | None, *parts: str) -> Column:
    """Whether a text holds one of these parts in either case, by a look that costs less than a pattern.

    ``low`` is the text in small letters, where the caller has it. No part may hold i, k or s,
    as other letters than I, K and S are also taken for these.
    """
    low = F.lower(c) if low is None else low
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), F.lit(False))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A Python function that filters on its result, and explosions of it, do not run a second time: the optimizer copies only what it takes for deterministic."""
    return udf.asNondeterministic()


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def digits_only(c: Column) -> Column:
    return replace_all(c, "[^0-9]", "")


def squeeze(c: Column) -> Column:
    """White space as one blank, none at the ends. A text of visible ASCII and lone blanks is not rewritten."""
    return let(empty_if_null(c), lambda t: F.trim(F.when(F.contains(t, F.lit("  ")) | t.rlike("[^ -~]"), replace_all(t, WS + "+", " ")).otherwise(t)))


def _grouped(c: Column, sizes: tuple[int, ...], marks: tuple[str, ...]) -> Column:
    pattern = "^" + "".join(f"(.{{{n}}})" for n in sizes) + "$"
    by = "".join(m + f"${k + 1}" for k, m in enumerate(("", *marks)))
    return let(digits_only(c), lambda d: F.when(F.length(d) == sum(sizes), replace_all(d, pattern, by)).otherwise(""))


def format_cpf(c: Column) -> Column:
    return _grouped(c, (3, 3, 3, 2), (".", ".", "-"))


def format_nit(c: Column) -> Column:
    return _grouped(c, (3, 5, 2, 1), (".", ".", "-"))


def format_benefit(c: Column) -> Column:
    return _grouped(c, (3, 3, 3, 1), (".", ".", "-"))


def format_process(c: Column) -> Column:
    """The court's form of a 20-digit process number."""
    return _grouped(c, (7, 2, 4, 1, 2, 4), ("-", ".", ".", ".", "."))


def clean_name(c: Column) -> Column:
    return squeeze(replace_all(c, r"[:;,.\-]+\z", ""))


def clean_code(c: Column) -> Column:
    return F.upper(replace_all(squeeze(c), r"[.;,:]+\z", ""))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, FOLDED)


def token_key(c: Column) -> Column:
    return replace_all(F.upper(fold_accents(c)), "[^A-Z]", "")


def title_case(c: Column) -> Column:
    """First letter of each run of letters in capitals, the rest small."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit("[a-zà-ÿ]+|[^a-zà-ÿ]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def apply_number_mask(model: Column, digits: Column) -> Column:
    """The digits of ``model`` replaced in order by ``digits``; its other characters stay."""
    chars = F.split(model, "")
    is_digit = lambda ch: ch.rlike("^[0-9]$")
    at = lambda k: F.size(F.filter(F.slice(chars, 1, k + 1), is_digit))
    return F.array_join(F.transform(chars, lambda ch, k: F.when(is_digit(ch), F.substring(digits, at(k), F.lit(1))).otherwise(ch)), "")


def sanitize_filename(c: Column, default: str = "evento_sem_nome") -> Column:
    r = replace_all(fold_accents(empty_if_null(c)), r"\.[\s ]+", ".")
    r = replace_all(replace_all(r, r"[^a-zA-Z0-9_.\-]", "_"), "_+", "_")
    r = F.substring(replace_all(r, r"^_+|_+\z", ""), 1, 200)
    return F.when(r == "", default).otherwise(r)


def document_title(c: Column, default: str = "Documento") -> Column:
    r = F.trim(replace_all(replace_all(empty_if_null(c), r"(?i)\.pdf\z", ""), "[_-]+", " "))
    return F.when(r == "", default).otherwise(r)


def strip_separator_noise(c: Column) -> Column:
    r = replace_all(squeeze(c), r"(?iu)^Procurador citado/intimado:\s*Prazo:\s*Data inicial da contagem do prazo:\s*Data final:\s*", "")
    return squeeze(replace_all(r, r"(?iu)^Usuário\.?:\s*Processo:\s*Sequência Evento:\s*", ""))


def escape_markdown(c: Column) -> Column:
    return replace_all(empty_if_null(c), r"([\\\[\]])", r"\\$1")


def escape_pdf_literal(c: Column) -> Column:
    return replace_all(c, r"([\\()])", r"\\$1")


def latin1_hex(c: Column) -> Column:
    return F.hex(F.encode(c, "ISO-8859-1"))


def hex_latin1(c: Column) -> Column:
    return F.decode(F.unhex(c), "ISO-8859-1")


def hex_utf16(c: Column) -> Column:
    return F.decode(F.unhex(c), "UTF-16BE")


def display_mask(c: Column, field: Column) -> Column:
    """What may be shown of a value, by the kind of its field."""
    words = F.split(c, WS + "+")
    return (
        F.when(c == "", c)
        .when(field == "cpf", F.concat(F.substring(c, 1, 4), F.lit("***.***-**")))
        .when(field == "nit", F.concat(F.substring(c, 1, 4), F.lit("*****.**-*")))
        .when(field.isin("nome", "mae"), F.concat(F.split(c, " ")[0], F.lit(" ****")))
        .when(field == "beneficio", replace_all(c, r"[0-9](?=(?:[^0-9]*[0-9]){2})", "*"))
        .when(field == "codigo", F.concat(F.substring(c, 1, 6), F.lit("***")))
        .when(field == "endereco", F.concat(F.array_join(F.slice(words, 1, 2), " "), F.lit(" ***")))
        .otherwise(c)
    )


def human_bytes(n: Column) -> Column:
    mb = F.replace(F.format_string("%.1f", n / 1048576.0), F.lit("."), F.lit(","))
    return (
        F.when(n.isNull(), "Tamanho desconhecido")
        .when(n >= 1048576, F.concat(mb, F.lit(" MB")))
        .when(n >= 1024, F.concat(F.floor(n / 1024.0 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def duration(ms: Column) -> Column:
    s = F.coalesce(F.greatest(F.floor(ms / 1000.0 + 0.5), F.lit(0)), F.lit(0))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    m = F.floor(s / 60)
    return F.when(m < 60, F.concat(two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), two(m % 60), F.lit("min")))


def pieces_label(n: Column) -> Column:
    return F.when(n == 1, "1 peça extraída").otherwise(F.concat(n.cast("string"), F.lit(" peças extraídas")))


# Maskers: all keep the length of what they mask.


def mask_cpf(c: Column) -> Column:
    return F.translate(c, "0123456789", "**********")


def mask_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", "0000000000")


def mask_all(c: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(c))


def zeros(c: Column) -> Column:
    return F.repeat(F.lit("0"), F.length(c))


def mask_label_number(label: Column, number: Column) -> Column:
    return F.concat(label, zeros(number))


def mask_code(c: Column) -> Column:
    return replace_all(replace_all(c, "[A-Za-z]", "X"), "[0-9]", "0")


def pad_to(c: Column, model: Column) -> Column:
    """Blanks up to the length of ``model``; a longer text is not cut."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.length(model) - F.length(c), F.lit(0))))


def mask_initials(c: Column) -> Column:
    """Initials of the words that are no connectives, padded; too long a result stays longer."""
    words = F.filter(F.split(squeeze(c), " "), lambda w: ~F.lower(w).isin(CONNECTIVES))
    return pad_to(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " "), c)


def mask_titled(c: Column) -> Column:
    """As initials, in place, for names behind a form of address, which stays."""
    runs = F.regexp_extract_all(c, F.lit("[A-ZÀ-ÿ][A-ZÀ-ÿ.]+|[A-ZÀ-ÿ](?![A-ZÀ-ÿ.])|[^A-ZÀ-ÿ]+"), F.lit(0))
    word = lambda r: r.rlike("^[A-ZÀ-ÿ][A-ZÀ-ÿ.]+$")
    low = lambda r: F.lower(r)
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(~word(r) | low(r).isin("sr", "sr.", "sra", "sra.", "senhor", "senhora"), r)
            .when(low(r).isin(*CONNECTIVES, "e"), F.repeat(F.lit(" "), F.length(r)))
            .otherwise(pad_to(F.concat(F.upper(F.substring(r, 1, 1)), F.lit(".")), r)),
        ),
        "",
    )


# Tests.


def _digit(d: Column, k: int) -> Column:
    return F.substring(d, k + 1, 1).try_cast("int")


def check_digit(d: Column, weights: list[int]) -> Column:
    """The modulo-11 digit of the leading digits under the weights; remainders below 2 give 0."""
    rest = let(d, lambda x: sum((_digit(x, k) * w for k, w in enumerate(weights)), F.lit(0)) % 11)
    return let(rest, lambda r: F.when(r < 2, 0).otherwise(11 - r))


CPF_FIRST, CPF_SECOND = list(range(10, 1, -1)), list(range(11, 1, -1))
NIT_WEIGHTS = [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def _checked(c: Column, digits: list[tuple[int, list[int]]]) -> Column:
    """Eleven digits, not all equal, with these check digits at these places."""

    def ok(d: Column) -> Column:
        fits = (F.length(d) == 11) & (d != F.repeat(F.substring(d, 1, 1), 11))
        for at, weights in digits:
            fits = fits & (check_digit(d, weights) == _digit(d, at))
        return F.coalesce(fits, F.lit(False))

    return let(digits_only(empty_if_null(c)), ok)


def valid_cpf(c: Column) -> Column:
    return _checked(c, [(9, CPF_FIRST), (10, CPF_SECOND)])


def valid_nit(c: Column) -> Column:
    return _checked(c, [(10, NIT_WEIGHTS)])


def common_surname(c: Column) -> Column:
    return token_key(c).isin(COMMON_SURNAMES)


def overlaps(begin: Column, end: Column, ranges: Column) -> Column:
    """Whether [begin, end) meets any of the half-open ``ranges`` (b, e)."""
    return F.exists(ranges, lambda r: (begin < r["e"]) & (end > r["b"]))


# The patterns and word lists inside the tests from here on must match what the reference matches.


def document_type(c: Column, low: Column | None = None) -> Column:
    letter = word("(?iu)", r"carta\s+de\s+concess[aã]o\b", r"mem[oó]ria\s+de\s+c[aá]lculo\s+do\s+benef[ií]cio\b")
    return F.when(holds(c, low, "carta", "lculo") & matches(c, letter), "carta-concessao").otherwise("cnis")


def is_event_title(c: Column) -> Column:
    t = F.trim(empty_if_null(c))
    return matches(t, r"(?i)^capa(?:\b|\z)") | matches(t, r"(?i)^evento(?:\.|\s+)\s*[0-9]+")


def needs_ocr(c: Column) -> Column:
    """Whether a page's text is too thin once numbering and labels are taken out; separator pages never are."""
    t = squeeze(c)
    r = replace_all(t, r"(?i)Processo\s+[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4},?\s*", " ")
    r = replace_all(r, r"(?i)Evento\s+[0-9]+,?\s*", " ")
    r = replace_all(r, r"[A-Z0-9]{4,}[0-9]{1,3},?\s*", " ")
    r = squeeze(replace_all(r, r"(?iu)Página\s+[0-9]+(?:\s+de\s+[0-9]+)?", " "))
    return F.when(t == "", True).when(F.contains(t, F.lit("PÁGINA DE SEPARAÇÃO")), False).otherwise(F.length(r) < 50)


def is_critical(c: Column) -> Column:
    """Whether a residual label names something that must never stay."""
    return (
        matches(c, r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b")
        | matches(c, r"(?i)\bOAB\b|[A-Z]{2}[0-9]{4,6}\b")
        | matches(c, r"(?i)\b(?:CRM|CREMERJ)\b")
        | matches(c, r"(?i)\b(?:RG|Identidade|Ident\.?|Id\.?)\b")
        | matches(c, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
    )


def is_public_body(c: Column) -> Column:
    return matches(
        c,
        r"(?iu)\b(?:INSS|INSTITUTO\s+NACIONAL|UNI[AÃ]O|FAZENDA\s+NACIONAL|MUNIC[IÍ]PIO|ESTADO\s+(?:DO|DA|DE)|DISTRITO\s+FEDERAL|"
        r"MINIST[ÉE]RIO\s+P[ÚU]BLICO|DEFENSORIA\s+P[ÚU]BLICA|PROCURADORIA)\b",
    )


def is_text_stream(c: Column) -> Column:
    return F.contains(c, F.lit("BT")) & (F.contains(c, F.lit("Tj")) | F.contains(c, F.lit("TJ")))


def is_address_stop(c: Column) -> Column:
    return matches(
        c,
        r"(?iu)^(?:Banco\b|Ag[eê]ncia\b|Local de Pagamento\b|Dados do Pagamento do Benef[ií]cio\b|C[aá]lculo\b|SEQ\b|Seu cadastro\b|Pagamento do Benef[ií]cio\b|Voc[eê]\b|Ap[oó]s\b|"
        r"Comunicamos\b|Mantenha\b|Aps:|Nome:|Titular:|CPF\b|Nit:|N[úu]mero do Benef[ií]cio\b|Data de Concess[aã]o\b|Sal[aá]rio\b|Valor do Benef[ií]cio\b|\*|P[aá]gina\b)",
    )


def is_address_start(c: Column) -> Column:
    return matches(c, r"(?iu)\b(?:RUA|AV(?:ENIDA)?|ALAMEDA|TRAVESSA|ESTRADA|RODOVIA|PRA[CÇ]A|LARGO|VIA)\b") | c.rlike("[0-9]")


def is_address_continuation(c: Column) -> Column:
    return matches(c, r"(?i)\b(?:LOJA|SALA|CASA|BLOCO|APTO?|ANDAR|CJ|CONJ|QD|QUADRA|LT|LOTE|FUNDOS)\b") | c.rlike(r"^[A-ZÀ-Ý0-9][A-ZÀ-Ý0-9\s.'/-]+\z")


def ocr_scale(width: Column, height: Column) -> Column:
    px = width * height
    return F.when(px > 0, F.greatest(F.lit(0.7), F.least(F.lit(0.95), F.sqrt(1_000_000.0 / px)))).otherwise(0.95)


def ocr_workers(pages: Column, cores: Column) -> Column:
    return F.when(pages < 8, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(6), cores - 1)))


def missing_text_mode(c: Column) -> Column:
    return F.when(c == "omit", "omit").otherwise("placeholder")


def estimated_total(elapsed_ms: Column, percent: Column) -> Column:
    """Total time by progress so far; unknown before 30 s or 12 per cent."""
    return F.when((elapsed_ms >= 30_000) & (percent >= 12), F.floor(elapsed_ms * (100.0 / F.least(F.lit(99.0), percent)) + 0.5).cast("long"))

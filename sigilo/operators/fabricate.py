"""Fictitious values: deterministic, keyed by seed, document and field.

A value is a function of its key, so tasks that run again give it again. Where
a value must differ from others, it is the first fitting one of candidates
that are unlike each other and more than what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CPF_FIRST, CPF_SECOND, NIT_WEIGHTS, apply_number_mask, check_digit, digits_only, format_cpf, format_nit, let

#: The surname of every fictitious holder and the name of every mother.
SURNAME, MOTHER = "FAKE DOS SANTOS", "MARIA FAKE DOS SANTOS"
SURNAMES = ["FAKE DOS SANTOS", "FALSO DOS SANTOS", "FICTICIO DOS SANTOS", "FALSO DA SILVA", "FICTICIO DA SILVA"]
MOTHERS = ["MARIA FAKE DOS SANTOS", "MARIA FALSA DOS SANTOS", "MARIA FICTICIA DOS SANTOS", "MARIA FALSA DA SILVA", "MARIA FICTICIA DA SILVA"]
FIRST_NAMES = ["ANA", "BRUNO", "CARLA", "DIEGO", "ELISA", "FABIO", "GILDA", "HUGO"]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CANDIDATES = 8


def draw(n: int | Column, *key: Column | str | int) -> Column:
    """A number below ``n`` that depends on the key alone."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(n) if isinstance(n, int) else n)


def random_digits(n: int | Column, *key: Column | str | int) -> Column:
    """``n`` digits; never all equal."""
    count = F.lit(n) if isinstance(n, int) else n
    d = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: draw(10, *key, i).cast("string")), "")
    same = d == F.repeat(F.substring(d, 1, 1), count)
    flipped = F.concat(F.translate(F.substring(d, 1, 1), "0123456789", "1234567890"), F.substring(d, 2, 1 << 30))
    return F.when(same & (count > 1), flipped).otherwise(d)


def cpf_of(base: Column) -> Column:
    """The CPF of nine digits, formatted."""
    ten = F.concat(base, check_digit(base, CPF_FIRST).cast("string"))
    return let(ten, lambda t: format_cpf(F.concat(t, check_digit(t, CPF_SECOND).cast("string"))))


def nit_of(base: Column) -> Column:
    """The NIT of ten digits, formatted."""
    return let(base, lambda b: format_nit(F.concat(b, check_digit(b, NIT_WEIGHTS).cast("string"))))


def first_other(candidates: list[Column], taken: Column) -> Column:
    """The first candidate whose digits are not among ``taken``."""
    return F.get(F.filter(F.array(*candidates), lambda c: ~F.array_contains(taken, digits_only(c))), F.lit(0))


def turned(digits: Column) -> Column:
    """Other digits in every place."""
    return F.translate(digits, "0123456789", "1234567890")


def cpf(original: Column, *key: Column | str | int) -> Column:
    base = random_digits(9, *key, "cpf")
    return let(base, lambda b: first_other([cpf_of(b), cpf_of(turned(b))], F.array(digits_only(original))))


#: Bases of a document's NITs are this far apart: no common factor with their number, so none is met twice.
NIT_STEP, NIT_BASES = 3_333_333_337, 10_000_000_000


def nits(originals: Column, *key: Column | str | int) -> Column:
    """One NIT per original, distinct from each other and from all originals.

    The k-th takes the first free one of bases k, k + n, k + 2n, ... steps on
    from the document's own; n + 11 of them hold one that is neither taken nor
    of equal digits.
    """
    taken, n, first = F.transform(originals, digits_only), F.size(originals).cast("long"), draw(NIT_BASES, *key, "nit")

    def one(_: Column, k: Column) -> Column:
        def tried(j: Column) -> Column:
            at = F.pmod(first + F.pmod(k.cast("long") + j * n, F.lit(NIT_BASES)) * F.lit(NIT_STEP % NIT_BASES), F.lit(NIT_BASES))
            return F.lpad(at.cast("string"), 10, "0")

        free = lambda b: (b != F.repeat(F.substring(b, 1, 1), 10)) & ~F.array_contains(taken, digits_only(nit_of(b)))
        return nit_of(F.get(F.filter(F.transform(F.sequence(F.lit(0).cast("long"), n + 10), tried), free), F.lit(0)))

    return F.transform(originals, one)


def benefit(original: Column, *key: Column | str | int) -> Column:
    """As many digits in the original's mask, unlike the original; empty if there is none."""
    digits = digits_only(original)
    drawn = random_digits(F.greatest(F.length(digits), F.lit(1)), *key, "benefit")
    return F.when(original == "", "").otherwise(apply_number_mask(original, F.when(drawn == digits, turned(digits)).otherwise(drawn)))


def _pool(chars: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(chars, lambda c: c.rlike(pattern)))


def _pools(model: Column) -> Column:
    """struct<model, letters, digits>: a text and the symbols it is made of."""
    chars = F.split(model, "")
    return F.struct(model.alias("model"), _pool(chars, "^[A-Z]$").alias("letters"), _pool(chars, "^[0-9]$").alias("digits"))


def _shaped(text: Column, letters: Column, digits: Column, differ: bool, *key: Column | str | int) -> Column:
    """Each letter and digit drawn from its pool; with ``differ`` never the one that stands there."""
    any_letter, any_digit = F.split(F.lit(LETTERS), ""), F.split(F.lit("0123456789"), "")

    def pick(pool: Column, every: Column, c: Column, i: Column) -> Column:
        usable = F.array_except(pool, F.array(c)) if differ else F.when(F.size(pool) > 1, pool).otherwise(every)
        usable = F.when(F.size(usable) > 0, usable).otherwise(F.array_except(every, F.array(c)))
        return let(usable, lambda u: F.get(u, draw(F.size(u), *key, i).cast("int")))

    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[A-Z]$"), pick(letters, any_letter, c, i)).when(c.rlike("^[0-9]$"), pick(digits, any_digit, c, i)).otherwise(c)), "")


def code(original: Column, *key: Column | str | int) -> Column:
    """A code of the original's shape and symbols, unlike it.

    Where a pool has one symbol only, the whole alphabet is drawn from, so
    that a code of equal symbols ends too.
    """

    def drawn(m: Column) -> Column:
        tries = [_shaped(m["model"], m["letters"], m["digits"], False, *key, "code", k) for k in range(CANDIDATES)]
        tries.append(_shaped(m["model"], m["letters"], m["digits"], True, *key, "code"))
        other = F.get(F.filter(F.array(*tries), lambda t: t != m["model"]), F.lit(0))
        return F.when(m["model"] == "", "").otherwise(F.coalesce(other, m["model"]))

    return let(F.upper(F.trim(original)), lambda t: let(_pools(t), drawn))


def address(lines: Column, *key: Column | str | int) -> Column:
    """Lines of the same shape whose letters and digits all differ, drawn from those of all lines."""
    up = F.filter(F.transform(lines, F.upper), lambda l: l != "")
    return let(up, lambda own: let(_pools(F.array_join(own, "")), lambda m: F.transform(own, lambda line, k: _shaped(line, m["letters"], m["digits"], True, *key, "address", k))))


def holder(original: Column, *key: Column | str | int) -> Column:
    """The original's first name and the fixed surname; a drawn first name if there is none."""
    first = F.split(F.trim(original), r"\s+")[0]
    drawn = F.get(F.array(*[F.lit(n) for n in FIRST_NAMES]), draw(len(FIRST_NAMES), *key, "name").cast("int"))
    return F.concat(F.when(first == "", drawn).otherwise(F.upper(first)), F.lit(" "), F.lit(SURNAME))


def record(records: DataFrame, seed: int = 0) -> DataFrame:
    """``records`` (columns of ``extract_record``) with the fictitious values behind ``f_``."""
    key = (seed, F.col("doc_id"))
    lines = address(F.col("endereco_linhas"), *key)
    return records.select(
        "*", holder(F.col("nome"), *key).alias("f_nome"), cpf(F.col("cpf"), *key).alias("f_cpf"), nits(F.col("nits"), *key).alias("f_nits"), F.lit(MOTHER).alias("f_nome_mae"),
        benefit(F.col("beneficio"), *key).alias("f_beneficio"), code(F.col("codigo"), *key).alias("f_codigo"), lines.alias("f_endereco_linhas"), F.array_join(lines, " ").alias("f_endereco"),
    )


def encodable(text: Column, reverse_map: Column) -> Column:
    """Whether a font's map has every character."""
    return ~F.exists(F.split(text, ""), lambda c: F.try_element_at(reverse_map, c).isNull())


def encodable_name(first: Column, reverse_map: Column) -> Column:
    """The first surname that the font can show behind the first name, else the usual one."""
    names = F.array(*[F.concat(F.upper(first), F.lit(" " + s)) for s in SURNAMES])
    return F.coalesce(F.get(F.filter(names, lambda n: encodable(n, reverse_map)), F.lit(0)), names[0])

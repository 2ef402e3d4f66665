"""Synthetic inputs of the registered queries, made from the driver's tables.

The tables hold no identifiers of the kinds the detectors look for, so rows
with such values are computed from keys. Each view is one SELECT that Spark
and other engines read alike; tables are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

K = "o_orderkey"


def _digits(factor: int, n: int, key: str = K) -> str:
    """``n`` digits that depend on a key."""
    return f"lpad(cast(({key} * {factor} + {factor % 8191}) % {10**n} as string), {n}, '0')"


CASE_TEXT = (
    f"concat('Processo ', {_digits(7919, 7)}, '-', {_digits(31, 2)}, '.2024.4.03.', {_digits(53, 4)}, ' Evento ', cast({K} % 50 as string), "
    f"' CPF ', {_digits(7907, 9)}, {_digits(17, 2)}, ' NIT: ', substring({_digits(104729, 11)}, 1, 10), '-', substring({_digits(104729, 11)}, 11, 1), "
    f"' PIS 123.45678.', {_digits(41, 2)}, '-9 NB: ', {_digits(1299709, 8)}, ' Titulo de Eleitor: ', {_digits(15485863, 12)}, "
    f"' OAB/SP ', {_digits(611953, 6)}, ' 0AB/RJ ', {_digits(7919, 5)}, ' OAB-MG) sob o n. ', {_digits(19, 3)}, '.', {_digits(23, 3)}, "
    f"' OLIVEIRA RJ', {_digits(7879, 6)}, ' SP', {_digits(29, 5)}, ' CRM/SP ', {_digits(611, 6)}, ' CRMRJ', {_digits(6113, 7)}, "
    f"' RG n. ', {_digits(37, 2)}, '.', {_digits(43, 3)}, '.', {_digits(47, 3)}, '-', {_digits(3, 1)}, ' Tel (11) 9', {_digits(59, 4)}, '-', {_digits(61, 4)}, "
    f"' codigo verificador ', {_digits(982451653, 12)}, 'v3 ', {_digits(32452843, 10)}, ' .V5 id ', {_digits(49979687, 14)}, "
    f"' Codigo ', {_digits(67867967, 10)}, 'ABC', ' Beneficio: ', {_digits(71, 3)}, '.', {_digits(73, 3)}, '.', {_digits(79, 3)}, '-', {_digits(7, 1)}, "
    f"CASE {K} % 3 WHEN 0 THEN concat(' Rua dos Testes ', {_digits(83, 3)}, ' Sala ', {_digits(89, 2)}, ', Centro') WHEN 1 THEN concat(' Av. Um ', {_digits(97, 2)}, ' CPF') ELSE ' Rua PERICIAL 10, Centro' END, "
    f"' contato u', cast({K} as string), '@exemplo.org fim')"
)

VIEWS: dict[str, str] = {
    "v_person": (
        "SELECT c_custkey AS doc_id, c_name AS name, c_custkey % 3 = 0 AS corrupt, "
        f"{_digits(7919, 9, 'c_custkey')} AS base9, {_digits(104729, 10, 'c_custkey')} AS base10 FROM {{customer}}"
    ),
    "v_case_page": f"SELECT o_custkey AS doc_id, o_orderkey AS k, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS bigint) AS page, {CASE_TEXT} AS text FROM {{orders}}",
    "v_text_item": (
        "SELECT l_orderkey AS doc_id, 0 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_returnflag, l_linenumber, l_partkey) AS item, l_quantity AS x, "
        "cast(cast(l_partkey % 4 as int) * 12 as double) AS y, concat(l_returnflag, cast(l_linenumber as string), '  ', cast(l_partkey as string)) AS str, l_partkey % 7 = 0 AS has_eol FROM {lineitem}"
    ),
    "v_outline": (
        "SELECT user_id AS doc_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bigint) AS ord, "
        "CASE event_type WHEN 'signup' THEN 'CAPA do processo' WHEN 'error' THEN 'Anexo avulso' ELSE concat('Evento. ', cast(event_id % 9 as string), ' - Peça ', event_type) END AS title, "
        "CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN NULL ELSE event_id % 40 END AS page FROM {events}"
    ),
    "v_separator": (
        "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN concat('texto   comum ', cast(o_orderkey as string)) ELSE concat('PÁGINA DE SEPARAÇÃO Sequência Evento: ', "
        "CASE WHEN o_orderkey % 3 = 0 THEN 'JUNTADA DE PEÇA' ELSE o_orderpriority END, ' 01/02/2030 10:20 Evento 1 Evento ', cast(o_orderkey % 70 as string), "
        "CASE WHEN o_orderkey % 11 = 0 THEN ' Documento 3' ELSE '' END) END AS text FROM {orders}"
    ),
    "v_progress": (
        "SELECT user_id AS doc_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS seq, event_id, ts, "
        "CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'scan' WHEN 'purchase' THEN 'ocr' WHEN 'signup' THEN 'event' ELSE 'done' END AS type, value / 5.0 AS percent, "
        "count(*) OVER (PARTITION BY user_id) AS total FROM {events}"
    ),
}


#: Tables by the keys that deal and order their rows, and how many of them a task gets: rows of these few bytes become long texts.
DEALT: dict[str, tuple[list[str], int]] = {"customer": (["c_custkey"], 5_000), "orders": (["o_custkey", "o_orderkey"], 50_000), "events": (["user_id", "event_id"], 100_000)}


def dealt(rows: DataFrame, keys: list[str], each: int) -> DataFrame:
    """``rows`` by their first key, sorted within tasks of about ``each`` rows.

    A small file is one task of a scan, whatever its rows grow to. The number of
    tasks is fixed, so that it is not lowered for the rows' few bytes. Windows
    and groups by the key need no other shuffle and sort.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(n, keys[0]).sortWithinPartitions(*keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name], **{t: dealt(df, *DEALT[t]) if t in DEALT else df for t, df in tables.items()})


def as_sql(*names: str) -> str:
    """WITH clauses of views, for an engine that has the tables by name."""
    return ", ".join(f"{n} AS ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names)

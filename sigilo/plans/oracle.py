"""SQL that another engine can run to check the registered queries.

The statements are written for an engine whose regular expressions have no
look-around and whose \\b is ASCII; they restate results, not plans.
"""

from __future__ import annotations

from ..functions.patterns import DETECTORS, PROCESS, Detector
from ..functions.text import CPF_FIRST, CPF_SECOND, NIT_WEIGHTS
from .views import as_sql

FIXED_PAIRS = [("OAB", "XXX"), ("OAB/SP", "UF/000"), ("@exemplo", "********"), ("Processo 0", "Processo X"), ("fim", "FIM"), ("zz", "yy")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def check_digit(d: str, weights: list[int]) -> str:
    total = " + ".join(f"cast(substr({d}, {k + 1}, 1) AS int) * {w}" for k, w in enumerate(weights))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


def grouped(d: str, sizes: tuple[int, ...], marks: tuple[str, ...]) -> str:
    parts, at = [], 1
    for n, m in zip(sizes, ("", *marks), strict=True):
        parts += [q(m)] * bool(m) + [f"substr({d}, {at}, {n})"]
        at += n
    return " || ".join(parts)


CPF_FORM, NIT_FORM, BENEFIT_FORM = ((3, 3, 3, 2), (".", ".", "-")), ((3, 5, 2, 1), (".", ".", "-")), ((3, 3, 3, 1), (".", ".", "-"))
PERSON = (
    f"WITH {as_sql('v_person')}, p0 AS (SELECT *, base9 || ({check_digit('base9', CPF_FIRST)}) AS c10, base10 || ({check_digit('base10', NIT_WEIGHTS)}) AS n11 FROM v_person), "
    f"p1 AS (SELECT *, c10 || ({check_digit('c10', CPF_SECOND)}) AS c11 FROM p0), "
    f"p AS (SELECT *, {grouped('c11', *CPF_FORM)} AS cpf, {grouped('n11', *NIT_FORM)} AS nit, {grouped('base10', *BENEFIT_FORM)} AS benefit FROM p1)"
)
PAGES = f"WITH {as_sql('v_case_page')}"
SWAP = "translate({}, '0123456789', '1234567890')"


def offsets(m: str, pieces: str) -> str:
    """Begin of every match, from the lengths of matches and of what is between them."""
    total = lambda a, n: f"coalesce(list_sum([length(x) FOR x IN {a}[1:{n}]]), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {total(pieces, 'i')} + {total(m, 'i - 1')})"


def protected(src: str = "v_case_page", tag: str = "prot") -> str:
    """Clauses ending in ``tag``: one row per process number of ``src``."""
    return (
        f"{tag}_0 AS (SELECT doc_id, page, text, regexp_extract_all(text, {q(PROCESS.re2)}) AS m, string_split_regex(text, {q(PROCESS.re2)}) AS g FROM {src}), "
        f"{tag}_1 AS (SELECT doc_id, page, m, {offsets('m', 'g')} AS b FROM {tag}_0), "
        f"{tag} AS (SELECT doc_id, page, unnest(m) AS number, unnest(b) AS b FROM {tag}_1)"
    )


PROTECTED = protected()


def matches(d: Detector, tag: str, src: str = "v_case_page", prot: str = "prot") -> str:
    """Clauses ending in ``{tag}``: one row per unprotected match with its groups and place.

    An address is the first group of its form without look-ahead.
    """
    first = 1 if d.name == "address" else 0
    cols = ", ".join(f"regexp_extract_all(text, {q(d.re2)}, {k}) AS a{k}" for k in range(first + d.groups + 1))
    each = ", ".join(f"unnest(a{k + first}) AS m{k}" for k in range(d.groups + 1))
    return (
        f"{tag}0 AS (SELECT doc_id, page, {cols}, string_split_regex(text, {q(d.re2)}) AS g FROM {src}), "
        f"{tag}1 AS (SELECT doc_id, page, {each}, unnest({offsets('a0', 'g')}) AS b, unnest(range(1, len(a0) + 1)) AS i FROM {tag}0), "
        f"{tag} AS (SELECT * FROM {tag}1 x WHERE {valid(d)} AND NOT EXISTS (SELECT 1 FROM {prot} r WHERE r.doc_id = x.doc_id AND r.page = x.page AND x.b < r.b + length(r.number) AND x.b + length(x.m0) > r.b))"
    )


NOT_EXPERT = r"(?i)^\S+\s+PERICIAL\b"


def valid(d: Detector) -> str:
    if d.name == "address":
        return f"NOT regexp_matches(m0, {q(NOT_EXPERT)})"
    if d.valid != "cpf":
        return d.valid
    digits = "regexp_replace(m0, '[^0-9]', '', 'g')"
    return (
        f"({digits} <> repeat(substr({digits}, 1, 1), 11) AND ({check_digit(digits, CPF_FIRST)}) = cast(substr({digits}, 10, 1) AS int) "
        f"AND ({check_digit(digits, CPF_SECOND)}) = cast(substr({digits}, 11, 1) AS int))"
    )


def emitted(d: Detector, tag: str, rank: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, page, {rank} AS det, i, {k} AS k, {o} AS o, coalesce({s}, '') AS s FROM {tag} WHERE {c}" for k, (o, s, c) in enumerate(d.pairs))


UNIQUE = (
    "u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, o ORDER BY det, i, k) AS rn FROM e WHERE o <> '' AND length(o) = length(s)), "
    "listed AS (SELECT doc_id, page, count(*) AS n, string_agg(o || '>' || s, '|' ORDER BY det, i, k) AS pairs FROM u WHERE rn = 1 GROUP BY doc_id, page)"
)


def detect(name: str) -> str:
    d = DETECTORS[name]
    return f"{PAGES}, {PROTECTED}, {matches(d, 'm')}, e AS ({emitted(d, 'm')}), {UNIQUE} SELECT * FROM listed"


def every_pair(kinds: list[str]) -> str:
    clauses = ", ".join(matches(DETECTORS[k], f"d{n}_") for n, k in enumerate(kinds))
    union = " UNION ALL ".join(emitted(DETECTORS[k], f"d{n}_", n) for n, k in enumerate(kinds))
    return f"{PAGES}, {PROTECTED}, {clauses}, e AS ({union}), {UNIQUE} SELECT * FROM listed"


def redacted() -> str:
    """Pages with the unique pairs applied, by falling length and in order, and what detectors still find."""
    ids, cpf = DETECTORS["long_id"], DETECTORS["cpf"]
    fold = lambda c: f"(list_reduce(list_prepend(struct_pack(o := '', s := text), {c}), lambda x, y: struct_pack(o := '', s := replace(x.s, y.o, y.s)))).s"
    return (
        every_pair(list(DETECTORS)).removesuffix("SELECT * FROM listed").rstrip()
        + ", ps AS (SELECT doc_id, page, list(struct_pack(o := o, s := s) ORDER BY length(o) DESC, det, i, k) AS by_length, list(struct_pack(o := o, s := s) ORDER BY det, i, k) AS in_order FROM u WHERE rn = 1 GROUP BY doc_id, page), "
        + f"red AS (SELECT v.doc_id, v.page, length(v.text) AS n, {fold('by_length')} AS text, {fold('in_order')} AS second FROM v_case_page v JOIN ps ON ps.doc_id = v.doc_id AND ps.page = v.page), "
        + f"{protected('red', 'rp')}, {matches(ids, 'ri', 'red', 'rp')}, ids AS (SELECT doc_id, page, count(*) AS n FROM ri GROUP BY doc_id, page), "
        + f"c0 AS (SELECT doc_id, page, unnest(regexp_extract_all(text, {q(cpf.re2)})) AS m0 FROM red), c AS (SELECT doc_id, page, count(*) AS n FROM c0 WHERE {valid(cpf)} GROUP BY doc_id, page) "
        + "SELECT red.doc_id, red.page, length(text) AS n_chars, length(text) = red.n AS same_length, coalesce(c.n, 0) AS cpfs, coalesce(ids.n, 0) AS identifiers, md5(text) AS digest, md5(second) AS digest_in_order "
        + "FROM red LEFT JOIN c ON c.doc_id = red.doc_id AND c.page = red.page LEFT JOIN ids ON ids.doc_id = red.doc_id AND ids.page = red.page"
    )


def count(name: str) -> str:
    return f"len(regexp_extract_all(text, {q(DETECTORS[name].re2)}))"


def findings() -> str:
    bare = lambda name, g: f"[regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(text, {q(DETECTORS[name].re2)}, {g})]"
    cpf, ids = DETECTORS["cpf"], DETECTORS["long_id"]
    return (
        f"{PAGES}, {PROTECTED}, {matches(ids, 'm')}, ids AS (SELECT doc_id, page, count(*) AS n FROM m GROUP BY doc_id, page), "
        f"c0 AS (SELECT doc_id, page, unnest(regexp_extract_all(text, {q(cpf.re2)})) AS m0 FROM v_case_page), c AS (SELECT doc_id, page, count(*) AS n FROM c0 WHERE {valid(cpf)} GROUP BY doc_id, page), "
        f"f AS (SELECT v.doc_id, v.page, coalesce(c.n, 0) AS cpfs, len(list_distinct({bare('nit_labelled', 2)} || {bare('nit', 0)})) AS nits, "
        f"{count('oab')} + {count('oab_zero')} + {count('oab_under')} + {count('oab_compact')} AS oabs, {count('crm')} + {count('crm_compact')} AS crms, len([x FOR x IN regexp_extract_all(text, {q(DETECTORS['address'].re2)}, 1) IF NOT regexp_matches(x, {q(NOT_EXPERT)})]) AS addresses, coalesce(ids.n, 0) AS identifiers, "
        "(SELECT string_agg(number, '|' ORDER BY b) FROM prot r WHERE r.doc_id = v.doc_id AND r.page = v.page) AS processes "
        "FROM v_case_page v LEFT JOIN c ON c.doc_id = v.doc_id AND c.page = v.page LEFT JOIN ids ON ids.doc_id = v.doc_id AND ids.page = v.page) "
    )


NIT_FORMS = r"([0-9]{11}|[0-9]{10}-[0-9]|[0-9]{3}\.[0-9]{5}\.[0-9]{2}-[0-9])"


def fields() -> str:
    plain_cpf = q(r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b")
    bare_cpf = rf"regexp_replace(regexp_extract(text, {q(r'(?i)\bCPF\s*:?\s*([0-9]{11}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2})\b')}, 1), '[^0-9]', '', 'g')"
    nits = rf"regexp_extract_all(text, {q(r'\b[0-9]{3}\.[0-9]{5}\.[0-9]{2}-[0-9]\b')}) || regexp_extract_all(text, {q(r'(?i)\b(?:NIT|NIS|PIS(?:/PASEP)?|PASEP)\s*:?\s*' + NIT_FORMS + r'\b')}, 1)"
    named = rf"regexp_extract(text, {q(r'(?i)\b(?:N[úu]mero do Benef[ií]cio|Benef[ií]cio)\s*:?\s*([0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]|[0-9]{9,10}-[0-9])\b')}, 1)"
    return (
        f"{PAGES}, n0 AS (SELECT doc_id, page, unnest({nits}) AS x, unnest(range(1, len({nits}) + 1)) AS i FROM v_case_page), "
        "n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, regexp_replace(x, '[^0-9]', '', 'g') ORDER BY i) AS rn FROM n0), "
        "n AS (SELECT doc_id, page, string_agg(x, '|' ORDER BY i) AS nits FROM n1 WHERE rn = 1 GROUP BY doc_id, page), "
        f"f AS (SELECT v.doc_id, v.page, CASE WHEN regexp_extract(text, {plain_cpf}) <> '' THEN regexp_extract(text, {plain_cpf}) WHEN length({bare_cpf}) = 11 THEN {grouped(bare_cpf, *CPF_FORM)} ELSE '' END AS cpf, "
        f"coalesce(n.nits, '') AS nits, CASE WHEN {named} <> '' THEN {named} ELSE regexp_extract(text, {q(r'\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]\b')}) END AS benefit, "
        rf"upper(regexp_extract(text, {q(r'(?i)\bc[oó]digo\s+([A-Z0-9-]{12,})\b')}, 1)) AS code, 'cnis' AS kind, "
        rf"nullif(regexp_extract(text, {q(r'(?:^|[^0-9])([0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4})(?:[^0-9]|$)')}, 1), '') AS process "
        "FROM v_case_page v LEFT JOIN n ON n.doc_id = v.doc_id AND n.page = v.page) "
    )


def record() -> str:
    first = lambda c: f"coalesce(arg_min({c}, page) FILTER (WHERE {c} <> ''), '')"
    return (
        fields()
        + ", z0 AS (SELECT doc_id, page, i, x, row_number() OVER (PARTITION BY doc_id, regexp_replace(x, '[^0-9]', '', 'g') ORDER BY page, i) AS rd FROM n1 WHERE rn = 1), "
        + "z AS (SELECT doc_id, string_agg(x, '|' ORDER BY page, i) AS nits FROM z0 WHERE rd = 1 GROUP BY doc_id) "
        + f"SELECT f.doc_id, 'cnis' AS tipo, {first('cpf')} AS cpf, {first('benefit')} AS beneficio, {first('code')} AS codigo, coalesce(any_value(z.nits), '') AS nits FROM f LEFT JOIN z ON z.doc_id = f.doc_id GROUP BY f.doc_id"
    )


EVENTS = (
    f"WITH {as_sql('v_outline')}, x0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn FROM v_outline WHERE page IS NOT NULL AND "
    r"(regexp_matches(title, '(?i)^capa(?:\b|$)') OR regexp_matches(title, '(?i)^evento(?:\.|\s+)\s*[0-9]+'))), "
    "x AS (SELECT doc_id, row_number() OVER w - 1 AS ord, title, page AS start, coalesce(lead(page) OVER w, 45) AS end_excl FROM x0 WHERE rn = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY page)), "
    r"ev AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(title), '\.\s+', '.', 'g'), '[^a-zA-Z0-9_.\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM x) "
)
UNIQUE_NAMES = "names AS (SELECT doc_id, ord, base || CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY ord) > 1 THEN '_' || cast(row_number() OVER (PARTITION BY doc_id, base ORDER BY ord) AS varchar) ELSE '' END || '.md' AS filename FROM ev)"
EXPANDED = "pg AS (SELECT doc_id, ord, unnest(range(start, end_excl)) AS page FROM ev WHERE end_excl > start)"
TEXTS = (
    "tx AS (SELECT *, CASE page % 4 WHEN 0 THEN NULL WHEN 1 THEN '[Texto não extraído da página ' || cast(page + 1 AS varchar) || '.]' ELSE 'texto ' || cast(page AS varchar) END AS t, page % 9 = 0 AS ocr FROM pg), "
    "body AS (SELECT doc_id, ord, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS body, bool_or(ocr) AS ocr FROM tx GROUP BY doc_id, ord), "
    "md AS (SELECT ev.doc_id, ev.ord, coalesce(body.ocr, false) AS ocr, '# ' || title || chr(10) || chr(10) || '<!-- páginas ' || cast(start + 1 AS varchar) || '-' || cast(end_excl AS varchar) || ' do PDF original -->' || chr(10) || chr(10) || "
    "coalesce(body, '[Todas as páginas sem texto extraível foram omitidas.]') || chr(10) || chr(10) || '---' || chr(10) AS content FROM ev LEFT JOIN body ON body.doc_id = ev.doc_id AND body.ord = ev.ord)"
)
INDEX = (
    "ix AS (SELECT ev.doc_id, CASE WHEN ev.doc_id % 2 = 0 AND {even} THEN '# Índice do Processo 0000001-01.2024.4.03.0001' ELSE '# Índice das Peças Extraídas' END || chr(10) || chr(10) || string_agg('- [' || "
    r"regexp_replace(title, '([\\\[\]])', '\\\1', 'g') || '](eventos/' || names.filename || ')' || CASE WHEN md.ocr THEN ' *(OCR)*' ELSE '' END || ' — ' || "
    "CASE WHEN end_excl - start = 1 THEN 'p. ' || cast(start + 1 AS varchar) ELSE 'pp. ' || cast(start + 1 AS varchar) || '-' || cast(end_excl AS varchar) END, chr(10) ORDER BY ev.ord) || chr(10) AS content "
    "FROM ev JOIN names ON names.doc_id = ev.doc_id AND names.ord = ev.ord JOIN md ON md.doc_id = ev.doc_id AND md.ord = ev.ord GROUP BY ev.doc_id)"
)

CHECKS = (
    f"WITH {as_sql('v_person')}, rows AS (SELECT doc_id, 'cpf' AS id, 'CPF' AS label, base9 AS o FROM v_person UNION ALL SELECT doc_id, 'mail', 'a' || base9 || '@x.org', base10 FROM v_person UNION ALL SELECT doc_id, 'nome', 'Nome', 'ANA  LIMA' FROM v_person), "
    "texts AS (SELECT doc_id, 'BT (' || CASE WHEN corrupt THEN base9 ELSE '000' END || ') Tj ET ' || CASE WHEN doc_id % 5 = 0 THEN base10 ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' ANA LIMA' ELSE '' END AS t FROM v_person), "
    "hits AS (SELECT doc_id, id, CASE WHEN doc_id % 4 = 0 OR id = 'nome' THEN 0 ELSE 2 END AS n FROM rows), "
    "left_raw AS (SELECT rows.doc_id, id, label FROM rows JOIN texts ON texts.doc_id = rows.doc_id WHERE contains(t, o)), "
    r"left_text AS (SELECT rows.doc_id, id, label FROM rows JOIN texts ON texts.doc_id = rows.doc_id WHERE contains(trim(regexp_replace(t, '\s+', ' ', 'g')), regexp_replace(o, '\s+', ' ', 'g'))), "
    "j AS (SELECT rows.doc_id, count(*) AS expected, count(*) FILTER (WHERE n > 0) AS applied, coalesce(string_agg(rows.label, '|' ORDER BY rows.label) FILTER (WHERE l.id IS NOT NULL), '') AS unreplaced, "
    "coalesce(string_agg(rows.label, '|' ORDER BY rows.label) FILTER (WHERE n = 0), '') AS unmatched, coalesce(string_agg(rows.label, '|' ORDER BY rows.label) FILTER (WHERE l.id IS NOT NULL AND rows.id = 'mail'), '') AS critical, "
    "coalesce(string_agg(rows.label, '|' ORDER BY rows.label) FILTER (WHERE n = 0 OR (l.id IS NOT NULL AND rows.id <> 'mail')), '') AS loose "
    "FROM rows JOIN hits ON hits.doc_id = rows.doc_id AND hits.id = rows.id LEFT JOIN left_raw l ON l.doc_id = rows.doc_id AND l.id = rows.id GROUP BY rows.doc_id) "
)

THIN = f"{PAGES}, t AS (SELECT doc_id, page, CASE k % 4 WHEN 0 THEN concat('Evento ', cast(k AS string), ', Página ', cast(page AS string), ' de 9 curta') WHEN 1 THEN '' WHEN 2 THEN text ELSE repeat('a', 49 + cast(k % 3 AS int)) END AS text FROM v_case_page), "
THIN += (
    "s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    rf"{q(r'(?i)Processo\s+[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4},?\s*')}, ' ', 'g'), '(?i)Evento\s+[0-9]+,?\s*', ' ', 'g'), '[A-Z0-9]{{4,}}[0-9]{{1,3}},?\s*', ' ', 'g'), '(?i)Página\s+[0-9]+(?:\s+de\s+[0-9]+)?', ' ', 'g'), '\s+', ' ', 'g')) AS rest FROM t), "
    "o AS (SELECT doc_id, page, text = '' OR length(rest) < 50 AS needs_ocr FROM s) "
)


def specs_sql() -> str:
    """Pairs and originals of every spec but the address, in order, empty ones left out and repeats once."""
    name = "'Bruno ' || translate(name, '#0123456789', ' ABCDEFGHIJ')"
    code = "base9 || 'ABCXY'"
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"

    def nominal(o: str, fake: str) -> tuple[str, str]:
        same = f"{o} = upper({o})"
        return f"{o} || '>' || upper({fake}) || CASE WHEN {same} THEN '' ELSE '|' || upper({o}) || '>' || upper({fake}) END", f"{o} || CASE WHEN {same} THEN '' ELSE '|' || upper({o}) END"

    def numeric(o: str) -> tuple[str, str]:
        return f"{o} || '>' || {SWAP.format(o)} || '|' || {digits(o)} || '>' || {SWAP.format(digits(o))}", f"{o} || '|' || {digits(o)}"

    rows = [
        ("nome", "Nome", *nominal(name, "'Ana Falsa'"), "true"), ("cpf", "CPF", *numeric("cpf"), "true"), ("nit:0", "NIT 1", *numeric("nit"), "true"), ("nit:1", "NIT 2", *numeric("'123.45678.90-0'"), "true"),
        ("numeroBeneficio", "Número do benefício", *numeric("benefit"), "true"), ("codigoAutenticidade", "Código de autenticidade", *nominal(code, SWAP.format(code)), "true"),
        ("nomeMae", "Nome da mãe", *nominal("'RITA TESTE'", "'Maria Falsa'"), "NOT corrupt"),
    ]
    return PERSON + " " + " UNION ALL ".join(f"SELECT doc_id, {q(i)} AS id, {q(label)} AS label, {pairs} AS pairs, {check} AS verify FROM p WHERE {c}" for i, label, pairs, check, c in rows)


def comparison_sql() -> str:
    name = "'Bruno ' || translate(name, '#0123456789', ' ABCDEFGHIJ')"
    rows = [
        ("Titular", name, "'Ana Falsa'", "nome", "'Bruno ****'"), ("CPF", "cpf", SWAP.format("cpf"), "cpf", "substr(cpf, 1, 4) || '***.***-**'"),
        ("NIT 1", "nit", SWAP.format("nit"), "nit", "substr(nit, 1, 4) || '*****.**-*'"), ("NIT 2", "'123.45678.90-0'", SWAP.format("'123.45678.90-0'"), "nit", "'123.*****.**-*'"),
        ("Benefício", "benefit", SWAP.format("benefit"), "beneficio", "'***.***.**' || substr(benefit, 11, 1) || substr(benefit, 12)"), ("Código", "base9 || 'ABCXY'", SWAP.format("base9 || 'ABCXY'"), "codigo", "substr(base9, 1, 6) || '***'"),
        ("Mãe", "CASE WHEN corrupt THEN '' ELSE 'RITA TESTE' END", "'Maria Falsa'", "mae", "CASE WHEN corrupt THEN '' ELSE 'RITA ****' END"),
    ]
    whole = "array_to_string(lines, ' ')"
    address = f"SELECT doc_id, 'Endereço' AS label, {whole} AS original, {SWAP.format(whole)} AS fake, 'endereco' AS field, array_to_string(string_split({whole}, ' ')[1:2], ' ') || ' ***' AS shown FROM a"
    values = " UNION ALL ".join(f"SELECT doc_id, {q(label)} AS label, {o} AS original, {s} AS fake, {q(f)} AS field, {shown} AS shown FROM p" for label, o, s, f, shown in rows)
    lines = ADDRESS.removeprefix(f"WITH {as_sql('v_person')}, ")
    return f"{PERSON}, {lines} {values} UNION ALL {address}"


def report_sql() -> str:
    d = lambda m: f"cast(doc_id % {m} AS varchar)"
    found = [("CPFs", 2), ("NITs/NIS/PIS", 3), ("OABs", 4), ("CRMs", 5), ("Nomes", 6), ("Endereços", 7), ("Identificadores longos", 8)]
    lines = [
        q("# Relatório de anonimização"), q(""), q("- Modo: Markdown anonimizado"), "'- Processo: ' || CASE WHEN corrupt THEN 'não identificado' ELSE base9 END", f"'- Peças extraídas: ' || {d(9)}",
        "'- OCR: ' || CASE WHEN doc_id % 2 = 0 THEN 'ligado' ELSE 'desligado' END", f"'- Páginas com OCR: ' || {d(7)}", f"'- Páginas sem texto extraído: ' || {d(3)}",
        f"'- Páginas sem OCR por opção do usuário: ' || {d(2)}", f"'- Páginas omitidas do Markdown: ' || {d(5)}", f"'- Substituições textuais mapeadas: ' || {d(11)}", f"'- Resíduos sensíveis detectáveis após anonimização: ' || {d(4)}",
        q(""), q("## Achados antes da anonimização"), q(""), *[f"{q(f'- {label}: ')} || {d(m)}" for label, m in found], q(""), q("## Conferência após anonimização"), q(""), *[f"{q(f'- {label}: ')} || {d(m)}" for label, m in found],
        q(""), q("## Observação"), q(""), q("O número do processo é preservado para conferência. Revise o material antes de compartilhar: OCR ruim, imagens e dados fora de padrão podem escapar da anonimização automática."), q(""),
    ]
    return f"WITH {as_sql('v_person')} SELECT doc_id, concat_ws(chr(10), {', '.join(lines)}) AS content FROM v_person"


#: The address block of the lines that the catalogue makes, case by case.
ADDRESS = (
    f"WITH {as_sql('v_person')}, a0 AS (SELECT doc_id, 'RUA ' || doc_id || ' - CENTRO' AS street, 'AVENIDA DOS TESTES, ' || doc_id AS avenue, doc_id % 2 = 0 AS even, doc_id % 3 = 0 AS gap FROM v_person), "
    "a AS (SELECT doc_id, CASE WHEN even AND gap THEN [street] WHEN even THEN [street, 'LOJA A', 'SALA 2 - CENTRO'] WHEN gap THEN [avenue, 'SALA 2 - CENTRO'] ELSE [avenue, 'LOJA A', 'SALA 2 - CENTRO'] END AS lines, "
    "CASE WHEN even AND gap THEN ['Endereço: ' || street] WHEN even THEN ['Endereço: ' || street, 'LOJA A', 'SALA 2 - CENTRO'] WHEN gap THEN [avenue, 'SALA 2 - CENTRO'] ELSE [avenue, 'LOJA A', 'SALA 2 - CENTRO'] END AS raw FROM a0) "
)
ADDRESS_PAIRS = f"flatten([[lines[i] || '>' || {SWAP.format('lines[i]')}, raw[i] || '>' || replace(raw[i], lines[i], {SWAP.format('lines[i]')})] FOR i IN range(1, len(lines) + 1)])"
ADDRESS_CHECKS = "flatten([[lines[i], raw[i]] FOR i IN range(1, len(lines) + 1)])"


def progress_folds() -> dict[str, str]:
    """Running estimates and the throttle as folds over each document's events."""
    top = "greatest(s.top, e.top)"
    new = f"(CASE WHEN e.ms - start >= 30000 AND {top} >= 12 THEN cast(floor((e.ms - start) * (cast(100 AS double) / least(cast(99 AS double), {top})) + 0.5) AS bigint) END)"
    est = f"(CASE WHEN coalesce({new}, 0) = 0 THEN s.est WHEN coalesce(s.est, 0) = 0 THEN {new} ELSE cast(floor(s.est * cast(0.7 AS double) + {new} * cast(0.3 AS double) + 0.5) AS bigint) END)"
    held = "e.kind IN ('scan', 'ocr') AND s.kind IS NOT DISTINCT FROM e.kind AND s.at IS NOT NULL AND e.at - s.at < 250"
    zero = "struct_pack(top := cast(0 AS double), est := cast(NULL AS bigint), n := cast(0 AS bigint), ms := cast(0 AS bigint))"
    events = "list(struct_pack(top := least(cast(99 AS double), cast(percent AS double)), est := cast(NULL AS bigint), n := cast(0 AS bigint), ms := epoch_us(ts) // 1000) ORDER BY ts, seq)"
    return {
        "progress_eta": f"WITH {as_sql('v_progress')}, l AS (SELECT doc_id, min(epoch_us(ts) // 1000) AS start, {events} AS events FROM v_progress GROUP BY doc_id), "
        f"r AS (SELECT doc_id, list_reduce(list_prepend({zero}, events), lambda s, e: struct_pack(top := {top}, est := {est}, n := s.n + CASE WHEN {est} IS NULL THEN 0 ELSE 1 END, ms := e.ms)) AS z FROM l) "
        "SELECT doc_id, z.top AS top, z.n AS n_estimates, z.est AS last_estimate FROM r",
        "progress_throttle": f"WITH {as_sql('v_progress')}, l AS (SELECT doc_id, list(struct_pack(kind := type, at := seq * 100, n := cast(0 AS bigint)) ORDER BY seq) AS events FROM v_progress GROUP BY doc_id) "
        f"SELECT doc_id, (list_reduce(list_prepend(struct_pack(kind := cast(NULL AS varchar), at := cast(NULL AS bigint), n := cast(0 AS bigint)), events), lambda s, e: CASE WHEN {held} THEN s ELSE struct_pack(kind := e.kind, at := e.at, n := s.n + 1) END)).n AS shown FROM l",
    }


def ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def all_sql() -> dict[str, str]:
    email = q(DETECTORS["email"].re2)
    kinds = list(DETECTORS)
    title = "'Evento. ' || cast(k AS varchar) || ' - PETIÇÃO [inicial]  nº_'"
    ordered = sorted(FIXED_PAIRS, key=lambda p: -len(p[0]))
    replaced = "text"
    for o, s in ordered:
        replaced = f"replace({replaced}, {q(o)}, {q(s)})"
    line = "trim(regexp_replace(str, '\\s+', ' ', 'g'))"
    mode = "CASE doc_id % 5 WHEN 1 THEN 'Carta de Concessão' WHEN 2 THEN 'Processo' WHEN 3 THEN 'Peças' ELSE 'CNIS' END"
    number = "lpad(cast(doc_id % 150 + 1 AS varchar), 3, '0')"
    seconds = "floor(doc_id * 9973 / 1000.0 + 0.5)"
    two = lambda x: f"lpad(cast(cast({x} AS bigint) AS varchar), 2, '0')"
    out = {
        "email_redaction_documents": f"SELECT doc_id, len(regexp_extract_all(text, {email})) AS n_emails, length(text) AS redacted_len, false AS residual FROM documents WHERE regexp_matches(text, {email})",
        "cpf_checksum": PERSON + f" SELECT doc_id, CASE WHEN corrupt THEN substr(cpf, 1, 13) || {SWAP.format('substr(cpf, 14, 1)')} ELSE cpf END AS cpf, CASE WHEN corrupt THEN substr(c11, 1, 10) || {SWAP.format('substr(c11, 11, 1)')} ELSE c11 END AS digits, NOT corrupt AND base9 <> repeat(substr(base9, 1, 1), 9) AS valid FROM p",
        "nit_checksum": PERSON + " SELECT doc_id, nit, base10 <> repeat(substr(base10, 1, 1), 10) AS valid, benefit FROM p",
        "masks": f"WITH {as_sql('v_person')} SELECT doc_id, translate(name, '0123456789', '0000000000') AS digits, repeat('*', 9) AS cpf, repeat('*', length(name)) AS everything, 'OAB/SP ' || repeat('0', 9) AS label_number, 'XX-' || repeat('0', 9) || 'XX' AS code, 'A. S. C.' || repeat(' ', length(name) + 5) AS initials FROM v_person",
        "format_strings": PAGES + f" SELECT doc_id, k, regexp_replace({title}, ' +', ' ', 'g') AS squeezed, 'Evento.' || cast(k AS varchar) || '_-_PETICAO_inicial_n' AS filename, regexp_replace({title}, '([\\[\\]])', '\\\\\\1', 'g') AS escaped, 'EVENTOPETICAOINICIALN' AS token, 'processo ' || cast(k AS varchar) || ' final' AS title, 'Ana Lima' AS name, 'ABC-' || cast(k AS varchar) AS code, true AS is_event, true AS critical FROM v_case_page".replace("{{", "{").replace("}}", "}"),
        "protected_ranges": f"{PAGES}, {PROTECTED} SELECT doc_id, page, cast(b AS bigint) AS begin_at, cast(b + length(number) AS bigint) AS end_at, number FROM prot",
        "pair_dedupe_first_wins": every_pair(kinds),
        "pair_table_function": every_pair(kinds),
        "file_page_text": PAGES + " SELECT doc_id, page, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM v_case_page",
        "file_outline": f"WITH {as_sql('v_outline')} SELECT doc_id, ord, title, page FROM v_outline",
        "file_redaction": PAGES + " SELECT doc_id, doc_id % 5 <> 4 AS ok, doc_id % 5 <> 4 AS released, CASE WHEN doc_id % 5 <> 4 THEN count(*) ELSE 0 END AS numbers_kept, false AS mail_left FROM v_case_page GROUP BY doc_id",
        "pairs_by_length": PAGES + f" SELECT doc_id, page, {q('|'.join(o for o, _ in ordered))} AS ordered, {replaced} AS replaced FROM v_case_page",
        "findings_count": findings() + "SELECT * FROM f",
        "findings_total": findings() + "SELECT doc_id, cast(sum(cpfs + nits + oabs + crms + addresses + identifiers) AS bigint) AS total, count(*) AS pages FROM f GROUP BY doc_id",
        "extract_fields": fields() + "SELECT doc_id, page, cpf, nits, benefit, code, kind, process FROM f",
        "extract_record": record(),
        "observations": f"WITH r AS ({record()}) SELECT doc_id, 'não encontrado: ' || CASE WHEN doc_id % 2 = 0 THEN concat_ws(', ', 'Nome/Titular', CASE WHEN beneficio = '' THEN 'Número do benefício' END, CASE WHEN codigo = '' THEN 'Código de autenticidade' END, 'Endereço', "
        "CASE WHEN cpf = '' AND nits = '' THEN 'CPF ou NIT' END) ELSE concat_ws(', ', 'Nome', CASE WHEN cpf = '' THEN 'CPF' END, CASE WHEN nits = '' THEN 'NIT' END, 'Nome da mãe') END AS observations FROM r",
        "extract_names": f"WITH {as_sql('v_person')} SELECT doc_id, translate(name, '#0123456789', ' ABCDEFGHIJ') AS holder, 'RITA ' || translate(base9, '0123456789', 'KLMNOPQRST') AS mother FROM v_person",
        "extract_address_block": ADDRESS + "SELECT doc_id, array_to_string(lines, '|') AS lines, array_to_string(raw, '|') AS raw FROM a",
        "spec_address": ADDRESS + f"SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS pairs, verify FROM (SELECT doc_id, {ordered_distinct(ADDRESS_PAIRS)} AS list_distinct_ordered, array_to_string({ordered_distinct(ADDRESS_CHECKS)}, '|') AS verify FROM a)",
        "outline_flatten": f"WITH RECURSIVE {as_sql('v_outline')}, t AS (SELECT doc_id, ord, title, page, [ord] AS path FROM v_outline WHERE ord = 0 UNION ALL SELECT c.doc_id, c.ord, c.title, c.page, list_append(t.path, c.ord) FROM t JOIN v_outline c ON c.doc_id = t.doc_id AND c.ord > 0 AND floor((c.ord - 1) / 40) = t.ord) "
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS ord, title, page FROM t",
        "apply_pairs": redacted(),
        "pdf_streams": f"WITH {as_sql('v_person')} SELECT cast(doc_id AS varchar) AS doc_id, 'BT [(' || repeat('0', 9) || ')] TJ (x ANA FAKE) Tj <' || repeat('30', 10) || '> Tj ET' AS text, cast(1 AS bigint) AS literal_hits, cast(1 AS bigint) AS hex_hits, cast(1 AS bigint) AS raw_hits FROM v_person",
        "mode_substitute": f"WITH {as_sql('v_person')} SELECT doc_id, true AS ok, cast(2 AS bigint) AS expected, cast(CASE WHEN corrupt THEN 1 ELSE 2 END AS bigint) AS applied, CASE WHEN corrupt THEN 'CPF' ELSE '' END AS unmatched, 'BRUNO FAKE DOS SANTOS' AS f_nome FROM v_person",
        "mode_redact": f"WITH {as_sql('v_case_page')} SELECT k, true AS ok, true AS number_kept, false AS mail_left, true AS number_told FROM v_case_page",
        "process_number_infer": PAGES + ", pg AS (SELECT doc_id, arg_min(substring(text, 10, 25), page) AS hit FROM v_case_page GROUP BY doc_id), d AS (SELECT doc_id, hit, lpad(cast(doc_id AS varchar), 20, '0') AS w FROM pg) "
        "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(w, 1, 7) || '-' || substr(w, 8, 2) || '.' || substr(w, 10, 4) || '.' || substr(w, 14, 1) || '.' || substr(w, 15, 2) || '.' || substr(w, 17, 4) WHEN doc_id % 2 = 0 THEN lpad(cast(doc_id AS varchar), 7, '0') || '-01.2024.4.03.0001' ELSE hit END AS process FROM d",
        "line_grouping": f"WITH {as_sql('v_text_item')}, g AS (SELECT doc_id, page, y, string_agg({line}, ' ' ORDER BY x, item) AS text FROM v_text_item GROUP BY doc_id, page, y) SELECT doc_id, cast(page AS bigint) AS page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) - 1 AS line_no, text FROM g",
        "page_text": f"WITH {as_sql('v_text_item')} SELECT doc_id, string_agg({line}, ' ' ORDER BY item) AS text FROM v_text_item GROUP BY doc_id, page",
        "page_lines_eol": f"WITH {as_sql('v_text_item')}, a AS (SELECT *, CASE WHEN has_eol OR coalesce(abs(y - lag(y) OVER w) > 8, false) THEN 1 ELSE 0 END AS new FROM v_text_item WINDOW w AS (PARTITION BY doc_id ORDER BY item)), "
        "b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY item) AS line FROM a), c AS (SELECT doc_id, line, string_agg(str, ' ' ORDER BY item) AS t FROM b GROUP BY doc_id, line) SELECT doc_id, string_agg(t, '|' ORDER BY line) AS text FROM c GROUP BY doc_id",
        "needs_ocr": THIN + "SELECT * FROM o",
        "ocr_routing": THIN + "SELECT doc_id, count(*) FILTER (WHERE needs_ocr) AS omitted, count(*) FILTER (WHERE NOT needs_ocr) AS kept, count(*) FILTER (WHERE needs_ocr) AS nulls FROM o GROUP BY doc_id",
        "ocr_scale": f"WITH {as_sql('v_person')} SELECT doc_id, CASE WHEN doc_id > 0 THEN round(greatest(0.7, least(0.95, sqrt(1000000.0 / (doc_id * 7.0 * 842.0)))), 9) ELSE 0.95 END AS scale, CASE WHEN doc_id % 20 < 8 THEN 1 ELSE greatest(1, least(6, doc_id % 9 - 1)) END AS workers FROM v_person",
        "separator_parse": f"WITH {as_sql('v_separator')} SELECT doc_id, CASE WHEN text LIKE 'PÁGINA%' AND NOT regexp_matches(text, 'Documento [0-9]') THEN 'Evento. ' || regexp_extract(text, 'Evento 1 Evento ([0-9]+)', 1) || ' - ' || regexp_extract(text, 'Sequência Evento: (.+?) 01/02/2030', 1) END AS title FROM v_separator",
        "event_ranges": EVENTS + "SELECT doc_id, ord, start, end_excl, start + 1 AS start_label, end_excl AS end_label, end_excl - start AS page_count, title, base || '.md' AS filename FROM ev",
        "event_pages": EVENTS + f", {EXPANDED} SELECT doc_id, count(*) AS pages, cast(sum(page) AS bigint) AS page_sum, max(ord) AS last_event FROM pg GROUP BY doc_id",
        "uncovered_pages": EVENTS + f", {EXPANDED}, al AS (SELECT doc_id, unnest(range(0, 45)) AS page FROM (SELECT DISTINCT doc_id FROM ev)) SELECT doc_id, page FROM al WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc_id = al.doc_id AND pg.page = al.page)",
        "unique_filenames": EVENTS + f", {UNIQUE_NAMES} SELECT * FROM names",
        "single_events": EVENTS.rstrip() + f", {as_sql('v_person')} SELECT doc_id, 'autos ' || base9 AS title, 'autos_' || base9 || '.md' AS filename, cast(7 AS bigint) AS page_count FROM v_person WHERE doc_id NOT IN (SELECT doc_id FROM ev)",
        "spec_build": specs_sql(),
        "spec_comparison": comparison_sql(),
        "residual_semi_join": CHECKS + "SELECT doc_id, id, 'stream' AS way FROM left_raw UNION ALL SELECT doc_id, id, 'text' AS way FROM left_text",
        "pending_anti_join": CHECKS + "SELECT doc_id, id FROM hits WHERE n = 0",
        "verdict": CHECKS + "SELECT doc_id, expected, applied, unreplaced, unmatched, unreplaced = '' AND NOT (expected > 0 AND applied = 0) AS ok FROM j",
        "judicial_verdict": CHECKS + "SELECT doc_id, critical, loose AS unmatched, critical = '' AND NOT (expected > 0 AND applied = 0) AS ok FROM j",
        "event_markdown": EVENTS + f", {EXPANDED}, {TEXTS} SELECT * FROM md",
        "index_markdown": EVENTS + f", {EXPANDED}, {TEXTS}, {UNIQUE_NAMES}, {INDEX.replace('{even}', 'true')} SELECT * FROM ix",
        "split_outputs": EVENTS + f", {EXPANDED}, {TEXTS}, {UNIQUE_NAMES}, {INDEX.replace('{even}', 'false')} SELECT doc_id, 'indice.md' AS path, length(content) AS n_chars, md5(content) AS digest FROM ix UNION ALL SELECT doc_id, 'integral.md', length(string_agg(content, chr(10) ORDER BY ord)), md5(string_agg(content, chr(10) ORDER BY ord)) FROM md GROUP BY doc_id "
        "UNION ALL SELECT md.doc_id, 'eventos/' || names.filename, length(md.content), md5(md.content) FROM md JOIN names ON names.doc_id = md.doc_id AND names.ord = md.ord",
        "report_markdown": report_sql(),
        "output_names": f"WITH {as_sql('v_person')} SELECT doc_id, {mode} || ' ' || CASE WHEN corrupt THEN 'Anonimizado' ELSE 'Maria' END || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ' ' || {number} END || '.pdf' AS name, "
        "CASE WHEN corrupt THEN 'Pecas' ELSE 'Processo_' || base9 || '_pecas' END || CASE WHEN doc_id % 2 = 0 THEN '_anonimizadas.zip' ELSE '_texto_fiel.zip' END AS zip, CASE WHEN doc_id % 3 = 1 THEN '1 peça extraída' ELSE cast(doc_id % 3 AS varchar) || ' peças extraídas' END AS pieces FROM v_person",
        "admission_filter": f"WITH {as_sql('v_person')}, f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'not a PDF' WHEN doc_id * 1000003 % (90 * 1024 * 1024) > CASE WHEN doc_id % 5 IN (2, 3) THEN 70 ELSE 50 END * 1024 * 1024 THEN 'too large' END AS reason FROM v_person) SELECT doc_id, reason IS NULL AS accepted, reason FROM f",
        "display_masks": PERSON + " SELECT doc_id, substr(cpf, 1, 4) || '***.***-**' AS cpf, substr(nit, 1, 4) || '*****.**-*' AS nit, 'Ana ****' AS nome, substr(base10, 1, 6) || '***' AS codigo, 'RUA DOS ***' AS endereco FROM p",
        "durations": f"WITH {as_sql('v_person')} SELECT doc_id, CASE WHEN {seconds} < 3600 THEN {two(f'floor({seconds} / 60)')} || ':' || {two(f'{seconds} % 60')} ELSE cast(cast(floor({seconds} / 3600) AS bigint) AS varchar) || 'h ' || {two(f'floor({seconds} / 60) % 60')} || 'min' END AS duration, "
        "CASE WHEN doc_id * doc_id * 173 >= 1048576 THEN replace(printf('%.1f', floor(doc_id * doc_id * 173 / 1048576.0 * 10 + 0.5) / 10), '.', ',') || ' MB' WHEN doc_id * doc_id * 173 >= 1024 THEN cast(cast(floor(doc_id * doc_id * 173 / 1024.0 + 0.5) AS bigint) AS varchar) || ' KB' ELSE cast(doc_id * doc_id * 173 AS varchar) || ' bytes' END AS size, "
        "CASE WHEN doc_id * 997 >= 30000 AND doc_id % 110 >= 12 THEN cast(floor(doc_id * 997 * (cast(100.0 AS double) / least(99.0, cast(doc_id % 110 AS double))) + 0.5) AS bigint) ELSE -1 END AS total, CASE WHEN doc_id % 2 = 0 THEN 'omit' ELSE 'placeholder' END AS mode FROM v_person",
        "progress_sampling": f"WITH {as_sql('v_progress')} SELECT doc_id, type, count(*) AS n, cast(sum(seq) AS bigint) AS seq_sum FROM v_progress WHERE type NOT IN ('page', 'event', 'ocr') OR seq = 0 OR seq + 1 = total OR (seq + 1) % 10 = 0 GROUP BY doc_id, type",
    }
    return out | progress_folds() | {f"detect_{k}": detect(k) for k in kinds}

"""Behaviours of the reference's operators, table-driven over invented values."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from sigilo.functions import text as T
from sigilo.functions.patterns import DETECTORS
from sigilo.operators import detect, extract, fabricate, names, pdf, render, segment, specs, verify
from sigilo.plans import modes
from sigilo.sources import readers
from sigilo.sources.pdf_objects import PdfFile
from sigilo.streaming import progress


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x long"
    row = tuple(values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


DETECTED = [
    ("cpf", "CPF 111.444.777-35", "111.444.777-35", "***.***.***-**"),
    ("cpf", "CPF: 111.444.777-36", None, None),
    ("oab", "OAB/SP 654321", "OAB/SP 654321", "OAB/SP 000000"),
    ("oab_under", "OAB-SP) sob o n. 123.456", "OAB-SP) sob o n. 123.456", "OAB-SP) sob o n. 0000000"),
    ("oab_compact", "SP654321", "SP654321", "SP000000"),
    ("crm_compact", "CRMSP54321", "CRMSP54321", "CRMSP00000"),
    ("phone", "(11) 91234-5678", "(11) 91234-5678", "(00) 00000-0000"),
    ("phone", "2019 2020", "2019 2020", "0000 0000"),
    ("email", "ana@exemplo.org", "ana@exemplo.org", "*" * 15),
    ("address", "na Rua dos Testes 10, Centro", "Rua dos Testes 10", "*" * 17),
    ("verifier", "código verificador 123456789012v5", "código verificador 123456789012v5", "código verificador 000000000000v5"),
    ("long_id", "Processo 1234567-89.2030.4.05.6789", None, None),
    ("nit", "NIT 123.45678.90-0", "123.45678.90-0", "000.00000.00-0"),
    ("long_id", "0000000000", None, None),
]


@pytest.mark.parametrize("kind,text,original,substitute", DETECTED)
def test_detectors(spark, kind, text, original, substitute):
    df = detect.add_pairs(spark.createDataFrame([(text,)], "text string"), [DETECTORS[kind]])
    pairs = [(p.o, p.s) for p in df.first().pairs]
    assert (pairs == []) if original is None else ((original, substitute) in pairs)


def test_protected_number_and_order_of_replacement(spark):
    text = "Processo 1234567-89.2030.4.05.6789 CPF 111.444.777-35 OAB/SP 123456 e 12345678901234"
    df = detect.add_pairs(spark.createDataFrame([(text,), (None,)], "text string"))
    row, null = df.withColumn("out", detect.apply_pairs(F.col("text"), F.col("pairs"))).collect()
    assert "1234567-89.2030.4.05.6789" in row.out and "111.444" not in row.out and len(row.out) == len(text)
    assert all(len(p.o) == len(p.s) for p in row.pairs) and null.pairs == [] and null.out is None
    assert len({p.o for p in row.pairs}) == len(row.pairs)


def test_spans(spark):
    out = one(spark, detect.spans(F.col("t"), "[0-9]+"), t="a1b22c333")
    assert [(s.b, s.e, s.m0) for s in out] == [(1, 2, "1"), (3, 5, "22"), (6, 9, "333")]


def test_formats_and_masks(spark):
    c = F.col("t")
    assert one(spark, T.format_cpf(c), t="11144477735") == "111.444.777-35"
    assert one(spark, T.format_nit(c), t="1") == ""
    assert one(spark, T.squeeze(c), t=" a   b\t") == "a b"
    assert one(spark, T.mask_initials(c), t="ZULMIRO TESTE DOS PRADO") == "Z. T. P.".ljust(23)
    assert one(spark, T.mask_initials(c), t="A B") == "A. B."
    assert one(spark, T.mask_titled(c), t="Sr. ZULMIRO DE PRADO") == "Sr. " + "Z.".ljust(7) + " " * 4 + "P.".ljust(5)
    assert one(spark, T.sanitize_filename(c), t="Evento. 1 - PETIÇÃO / x") == "Evento.1_-_PETICAO_x"
    assert one(spark, T.sanitize_filename(c), t="///") == "evento_sem_nome"
    assert one(spark, T.apply_number_mask(c, F.lit("987")), t="1.2-3") == "9.8-7"
    assert one(spark, T.title_case(c), t="JOSÉ da SILVA-LIMA") == "José Da Silva-Lima"
    assert one(spark, T.display_mask(c, F.lit("beneficio")), t="123.456.789-0") == "***.***.**9-0"
    assert one(spark, T.duration(c), t=3_725_000) == "1h 02min" and one(spark, T.human_bytes(c), t=1_572_864) == "1,5 MB"
    assert one(spark, T.valid_nit(c), t="123.45678.90-0") is True and one(spark, T.valid_cpf(c), t="111.111.111-11") is False


OCR = [("Processo 1234567-89.2030.4.05.6789, Evento 1, ANEXO13, Página 1", True), ("a" * 50, False), ("a" * 49, True), ("", True), ("PÁGINA DE SEPARAÇÃO", False)]


@pytest.mark.parametrize("text,need", OCR)
def test_needs_ocr(spark, text, need):
    assert one(spark, T.needs_ocr(F.col("t")), t=text) is need


def test_separator(spark):
    text = "PÁGINA DE SEPARAÇÃO  Sequência Evento: JUNTADA DE TESTE 01/02/2030 10:20 Evento 1 Evento 2"
    assert one(spark, segment.separator_title(F.col("t")), t=text) == "Evento. 2 - JUNTADA DE TESTE"
    assert one(spark, segment.separator_title(F.col("t")), t=text + " Documento 3") is None


RANGES = [
    ([("CAPA", 0), ("Evento.1", 5), ("Evento.2", 10)], [(0, 5), (5, 10), (10, 20)]),
    ([("CAPA", 0), ("Evento.1", None), ("Evento.2", 5)], [(0, 5), (5, 20)]),
    ([("CAPA", 0), ("Evento.1", 0), ("Evento.2", 5)], [(0, 5), (5, 20)]),
    ([("a", 10), ("b", 0), ("c", 5)], [(0, 5), (5, 10), (10, 20)]),
]


@pytest.mark.parametrize("items,expected", RANGES)
def test_event_ranges(spark, items, expected):
    df = spark.createDataFrame([("d", k, t, p) for k, (t, p) in enumerate(items)], "doc_id string, ord int, title string, page int")
    e = segment.event_ranges(df, spark.createDataFrame([("d", 20)], "doc_id string, total int")).orderBy("ord").collect()
    assert [(r.start, r.end_excl) for r in e] == expected


def test_outline_and_filenames(spark):
    tree = [("d", 1, None, 0, "a", 0), ("d", 2, 1, 0, "b", 1), ("d", 3, 2, 0, "c", 2), ("d", 4, 1, 1, "b", 3), ("d", 5, None, 1, "b", 4)]
    out = segment.flatten_outline(spark.createDataFrame(tree, "doc_id string, node_id int, parent_id int, ordinal int, title string, page int")).orderBy("ord").collect()
    assert [(r.title, r.page) for r in out] == [("a", 0), ("b", 1), ("c", 2), ("b", 3), ("b", 4)]
    named = segment.unique_filenames(spark.createDataFrame([(r.doc_id, r.ord, r.title) for r in out], "doc_id string, ord int, title string")).orderBy("ord").collect()
    assert [r.filename for r in named] == ["a.md", "b.md", "c.md", "b_2.md", "b_3.md"]


def test_extraction(spark):
    t = "NOME: ANA TESTE LIMA CPF: 111.444.777-35 Nome da mãe: RITA TESTE Data de nascimento: 01/01/1970"
    c = F.col("t")
    assert one(spark, extract.holder(c), t=t) == "ANA TESTE LIMA" and one(spark, extract.mother(c), t=t) == "RITA TESTE" and one(spark, extract.cpf(c), t=t) == "111.444.777-35"
    assert one(spark, extract.nits(c), t="NIT: 123.45678.90-0 PIS/PASEP: 12345678900 Nit: 2003004005-6") == ["123.45678.90-0", "2003004005-6"]
    assert one(spark, extract.code(c), t="com o código 990101ABCXYZ12345QWERT") == "990101ABCXYZ12345QWERT"
    assert one(spark, extract.process_number(c), t="x12345678920304056789y") == "1234567-89.2030.4.05.6789"
    got = one(spark, extract.address(F.col("l")), l=["Endereço", "RUA DOS TESTES, 10 -", "LOJA A - CENTRO", "Banco 1", "BLOCO 2"])
    assert got.lines == ["RUA DOS TESTES, 10 -", "LOJA A - CENTRO"]


def test_fabricated_values(spark):
    df = spark.createDataFrame([("d1", "Ana Lima", "111.444.777-35", ["123.45678.90-0", "200.30040.05-6"], "R", "100.200.300-4", "9999999999999", ["RUA A, 1"], ["RUA A, 1"], "RUA A, 1")],
        "doc_id string, nome string, cpf string, nits array<string>, nome_mae string, beneficio string, codigo string, endereco_linhas array<string>, endereco_brutas array<string>, endereco string")
    a, b = fabricate.record(df, 1).first(), fabricate.record(df, 1).first()
    assert a == b and a.f_nome == "ANA FAKE DOS SANTOS" and a.f_cpf != a.cpf and len(set(a.f_nits) | set(a.nits)) == 4
    assert a.f_codigo != a.codigo and len(a.f_codigo) == 13 and a.f_beneficio[3] == "." and a.f_beneficio != a.beneficio
    assert len(a.f_endereco) == 8 and all(x != y for x, y in zip(a.f_endereco, a.endereco) if x.isalnum())


def test_names(spark):
    known = spark.createDataFrame([("maria",), ("rita",)], "name string")
    text = "Compareceu Maria de Souza Prado hoje. AUTOR: ZULMIRO TESTE PRADO. RÉU: INSTITUTO NACIONAL DE TESTES - INSS. Sr. Zulmiro falou a ZULMIRO PRADO."
    row = names.add_names(spark.createDataFrame([(text,), (None,)], "text string"), known).collect()[0]
    pairs = {p.o: p.s for p in row.name_pairs}
    assert row.names == ["Maria de Souza Prado", "ZULMIRO TESTE PRADO"]
    assert pairs["ZULMIRO TESTE PRADO"] == "Z. T. P.".ljust(19) and "ZULMIRO PRADO" in pairs and all(len(o) == len(s) for o, s in pairs.items())


FONT = {chr(65 + k): f"{k + 16:04X}" for k in range(26)} | {" ": "0001", "0": "0002", ".": "0003"}
REWRITTEN = [
    # stream, pairs, fonts, result, hits
    ("BT [(AN)-4(A TE)3(STE)] TJ ET", [("ANA TESTE", "A. T.    ")], [], "BT [(A.  T.    )] TJ ET".replace("A.  T.", "A. T."), 1),
    ("BT (111.4) Tj 0 Td (44.777-35) Tj ET", [("111.444.777-35", "***.***.***-**")], [], "BT (***.*) Tj 0 Td (**.***-**) Tj ET", 1),
    ("BT (ANA LIMA) Tj ET", [("ANA LIMA", "ANA FAKE DOS SANTOS")], [], "BT (ANA FAKE DOS SANTOS) Tj ET", 1),
    ("BT [(ANA)-2( LIMA)] TJ ET", [("ANA LIMA", "ANA FAKE DOS SANTOS")], [], "BT [(ANA FAKE DOS SANTOS)] TJ ET", 1),
    ("BT (12) Tj [(34)] TJ ET", [("1234", "0000")], [], "BT (12) Tj [(34)] TJ ET", 0),
    ("BT [(a\\(b)(c)] TJ (x) Tj ET", [("a(bc", "zzzz")], [], "BT [(zzzz)] TJ (x) Tj ET", 1),
    ("BT [(a(b(c(d)))e)] TJ ET", [("c(d)))e", "1234567")], [], "BT [(a(b(1234567)] TJ ET", 1),
    ("BT [(a(b(c(d)))e)-1(f)] TJ ET", [("c(d)))ef", "12345678")], [], "BT [(a\\(b\\(12345678)] TJ ET", 1),
    ("BT (ABCD) Tj (EF) Tj ET", [("CDEF", "9999"), ("BCDE", "8888")], [], "BT (AB99) Tj (99) Tj ET", 1),
    ("BT <0010> Tj 7 0 Td <0012> Tj ET", [("AC", "00")], [FONT], "BT <0002> Tj 7 0 Td <0002> Tj ET", 1),
    ("BT [<0010>-3<0012>] TJ ET", [("AC", "..")], [FONT], "BT [<00030003>] TJ ET", 1),
    ("BT [<00100012>] TJ ET", [("AC", "é!")], [FONT], "BT [<00010001>] TJ ET", 1),
    ("BT <414E41> Tj ET", [("ANA", "EVA")], [], "BT <455641> Tj ET", 1),
    ("BT <0020> Tj <4142> Tj ET", [("AB", "XY")], [FONT, {"A": "0020", "X": "0021"}], "BT <0020> Tj <5859> Tj ET", 1),
    ("no text operators (ANA)", [("ANA", "EVA")], [], "no text operators (ANA)", 0),
]


@pytest.mark.parametrize("stream,pairs,fonts,want,hits", REWRITTEN)
def test_rewritten_streams(stream, pairs, fonts, want, hits):
    out, found = pdf.apply_to_stream(stream, [(f"s{k}", [p]) for k, p in enumerate(pairs)], fonts)
    assert (out, sum(found.values())) == (want, hits)


def test_font_tables_and_fitting_names():
    assert pdf.cmap("1 beginbfchar <0010> <0041> endbfchar 1 beginbfrange <0020> <0021> <0042> <0030> <0031> [<0044> <0045>] endbfrange") == {"A": "0010", "B": "0020", "C": "0021", "D": "0030", "E": "0031"}
    own = {c: "00" for c in "ANLIMSTODE FA"}
    assert pdf.compatible("ANA LIMA", "ANA FAKE DOS SANTOS", [f"ANA {s}" for s in fabricate.SURNAMES], [own]) == "ANA FALSO DOS SANTOS"
    assert pdf.compatible("ANA LIMA", "ANA FAKE DOS SANTOS", [], [own]) == "ANA FAKE DOS SANTOS"
    assert pdf.forms("AB", [{"A": "41", "B": "28"}]) == ["AB", "4142", "4128", "A\\("]
    assert pdf.fit("A1", "B2", {"X": "1", "9": "2"}) == "X9"
    assert pdf.literals("(a\\)b(c)\\051) x (never") == ["a)b(c))"]


def pdf_file(*streams, deflate=True):
    out = b"%PDF-1.4\n"
    for k, text in enumerate(streams, 1):
        body = zlib.compress(text.encode("latin-1")) if deflate else text.encode("latin-1")
        out += b"%d 0 obj\n<< /Length %d %s /Deep << /A << /B << /C 1 >> >> >> >>\nstream\n" % (k, len(body), b"/Filter /FlateDecode" if deflate else b"") + body + b"\nendstream\nendobj\n"
    return out + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(streams) + 1, len(out))


def shown(content):
    return [t for *_, kind, t in readers.streams_of(bytes(content)) if kind == readers.TEXT]


def test_files_are_rebuilt_with_lengths_and_places():
    content = pdf_file("BT (ANA LIMA) Tj ET", "BT (b) Tj ET")
    new = pdf.rebuilt(content, {1: "BT (ANA FAKE DOS SANTOS) Tj ET"})
    assert shown(new) == ["BT (ANA FAKE DOS SANTOS) Tj ET", "BT (b) Tj ET"]
    found = PdfFile(new).object(1)
    assert found.value["Length"] == len(found.raw)
    at = int(new.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert new[at : at + 4] == b"xref" and new[int(new[at:].split(b"\n")[4][:10]) :].startswith(b"1 0 obj")
    assert pdf.rebuilt(b"no pdf", {}) == b"no pdf"


def test_cut_off_streams_are_unreadable(spark):
    whole = pdf_file("BT (a) Tj ET" * 50)
    cut = whole.replace(zlib.compress(b"BT (a) Tj ET" * 50), zlib.compress(b"BT (a) Tj ET" * 50)[:-6])
    df = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(cut)), ("c", bytearray(b"x"))], "doc_id string, content binary")
    assert {r.doc_id for r in readers.unreadable(df, readers.streams(df)).collect()} == {"b", "c"}


LETTER = "Nome: ANA LIMA TESTE CPF: 111.444.777-35 NIT: 123.45678.90-0 Nome da mãe: RITA TESTE Data de nascimento: 01/01/1970"


def test_substitute(spark):
    fine = pdf_file("BT (ANA LIMA TESTE) Tj (111.444.777-35) Tj (123.45678.90-0) Tj [(RITA)-3( TESTE)] TJ ET")
    stays = pdf_file("BT (ANA LIMA TESTE) Tj <414E41204C494D4120544553544> Tj ET", "BT (111.444.777-3) Tj ET")
    hexed = pdf_file("BT (ANA LIMA TESTE) Tj (RITA TESTE) Tj (111.444.777-35) Tj [(12)] TJ <3132> Tj ET", "BT <3132332E34353637382E39302D30> TJ ET")
    none = pdf_file("BT (nada) Tj ET")
    files = spark.createDataFrame([(k, f"{k}.pdf", bytearray(c)) for k, c in (("a", fine), ("b", stays), ("c", hexed), ("d", none), ("e", b"no pdf"))], "doc_id string, path string, content binary")
    pages = spark.createDataFrame([(k, 0, LETTER) for k in "abc"] + [("d", 0, "nada")], "doc_id string, page int, text string")
    out = {r.doc_id: r for r in modes.substitute(files, pages, seed=3).collect()}
    assert set(out) == {"a", "b", "c", "d"}
    a = out["a"]
    assert a.ok and a.expected == a.applied == 4 and a.status == "Anonimizado ✓" and a.name == "CNIS Ana.pdf" and not a.unreplaced
    text = shown(a.content)[0]
    assert a.f_nome == "ANA FAKE DOS SANTOS" and f"({a.f_nome}) Tj" in text and f"({a.f_cpf}) Tj" in text and "RITA" not in text and "123.45678" not in text
    assert not out["c"].unreplaced or out["c"].content is None
    assert out["d"].ok and out["d"].expected == 0 and out["d"].content is not None


def test_redact(spark):
    number = "0001234-56.2024.8.19.0001"
    parts = [f"Processo {number}", "CPF 111.444.777-35", "OAB/RJ 123456", "joao@exemplo.org", "AUTOR: ZULMIRO TESTE PRADO."]
    fine = pdf_file(*["BT " + " ".join(f"({p}) Tj" for p in parts) + " ET"] * 4)
    kept = pdf_file("BT " + " ".join(f"({p}) Tj" for p in parts) + " <" + "111.444.777-35".encode().hex()[:-1] + "> Tj ET", "BT /X (OAB) Tj (/RJ) Tj ( 12) Tj ET (3456) '")
    files = spark.createDataFrame([("a", "a.pdf", bytearray(fine)), ("b", "b.pdf", bytearray(kept))], "doc_id string, path string, content binary")
    pages = spark.createDataFrame([(d, k, " ".join(parts)) for d in "ab" for k in range(4)], "doc_id string, page int, text string")
    known = spark.createDataFrame([("maria",)], "name string")
    out = {r.doc_id: r for r in modes.redact(files, pages, known).collect()}
    text = " ".join(shown(out["a"].content))
    assert out["a"].ok and out["a"].applied > 0 and number in text
    assert not any(v in text for v in ("111.444.777-35", "OAB/RJ 123456", "joao@exemplo.org", "ZULMIRO TESTE"))
    assert out["a"].findings.startswith("Redatados: CPFs: 4 · ") and out["a"].findings.endswith(f"Processo preservado: {number}") and "Nomes: 4" in out["a"].findings


def test_split(spark):
    number = "0001234-56.2024.8.19.0001"
    docs = spark.createDataFrame([("a", "autos.pdf"), ("b", "solto_doc.pdf")], "doc_id string, name string")
    text = lambda k: f"Processo {number} pagina {k} com texto bastante longo para nao precisar de leitura por imagem CPF 111.444.777-35"
    sep = "PÁGINA DE SEPARAÇÃO Sequência Evento: PETIÇÃO 01/02/2030 10:20 Evento 1 Evento 2"
    pages = spark.createDataFrame([("a", 0, text(0)), ("a", 1, text(1)), ("a", 2, sep), ("a", 3, "curta"), ("b", 0, "AUTOR: ZULMIRO TESTE PRADO, compareceu em juizo para dizer o que sabia dos fatos do processo")], "doc_id string, page int, text string")
    tree = [("a", 1, None, 0, "CAPA", 0), ("a", 2, 1, 0, "Evento. 1 - INICIAL 111.444.777-35", 1), ("a", 3, 1, 1, "Anexo", 3)]
    outline = spark.createDataFrame(tree, "doc_id string, node_id int, parent_id int, ordinal int, title string, page int")
    known = spark.createDataFrame([("maria",)], "name string")
    out, summary = modes.split(docs, pages, outline, known, enable_ocr=False, missing="omit")
    files = {(r.doc_id, r.path): r.content for r in out.collect()}
    own = {r.doc_id: r for r in summary.collect()}
    assert {p for d, p in files if d == "a"} == {"indice.md", "integral.md", "relatorio_anonimizacao.md", "eventos/CAPA.md", "eventos/Evento.1_-_INICIAL_._._-.md", "eventos/Evento.2_-_PETICAO.md"}
    assert ("b", "eventos/solto_doc.md") in files and "ZULMIRO" not in files["b", "integral.md"]
    assert own["a"].process == number and own["a"].omitted == 1 and own["a"].pieces == 3 and own["a"].a_cpfs == 3 - 1 and own["a"].z_cpfs == 0 and number in files["a", "integral.md"]
    assert "111.444.777-35" not in "".join(c for (d, _), c in files.items() if d == "a")
    read, plain = modes.split(docs, pages, outline, provider=lambda p: p.withColumn("ocr_text", F.concat(F.lit("lida "), "page")))
    whole = {(r.doc_id, r.path): r.content for r in read.collect()}
    assert "lida 3" in whole["a", "integral.md"] and "*(OCR)*" in whole["a", "indice.md"] and {r.doc_id: r.ocr_count for r in plain.collect()} == {"a": 1, "b": 0}
    import io
    import zipfile

    packed = {r.doc_id: r.content for r in modes.zipped(read).collect()}
    with zipfile.ZipFile(io.BytesIO(packed["a"])) as z:
        assert z.namelist()[:2] == ["indice.md", "integral.md"] and z.read("integral.md").decode() == whole["a", "integral.md"]


def test_large_dictionary_is_joined(spark, monkeypatch):
    known = spark.createDataFrame([("maria",), ("rita",), ("josé",)], "name string")
    texts = ["Compareceu Maria de Souza Prado hoje. AUTOR: RITA TESTE PRADO. Sra. Rita falou.", "José Lima Prado e JOSE TESTE", "nada", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    small = sorted(map(str, names.map_pairs(df, known).collect()))
    monkeypatch.setattr(names, "DICTIONARY_LIMIT", 1)
    assert sorted(map(str, names.map_pairs(df, known).collect())) == small


def test_fabricated_values_never_run_out(spark):
    nits = [f"{k:03d}.45678.90-0" for k in range(40)]
    df = spark.createDataFrame([("d", nits, "7", "111.444.777-35")], "doc_id string, nits array<string>, b string, cpf string")
    for seed in range(4):
        r = df.select(fabricate.nits(F.col("nits"), seed, F.col("doc_id")).alias("n"), fabricate.benefit(F.col("b"), seed).alias("b"), fabricate.cpf(F.col("cpf"), seed).alias("c")).first()
        assert len(set(r.n)) == 40 and None not in r.n and not set(r.n) & set(nits) and r.b not in ("7", None) and r.c not in ("111.444.777-35", None)


def test_outlines(spark):
    deep = [("d", k, k - 1 if k else None, 0, f"t{k}", k) for k in range(30)] + [("e", 1, None, 1, "b", 5), ("e", 2, None, 0, "a", 4), ("e", 3, 2, 0, "aa", 6), ("e", 9, 8, 0, "lost", 1)]
    out = segment.flatten_outline(spark.createDataFrame(deep, "doc_id string, node_id int, parent_id int, ordinal int, title string, page int")).orderBy("doc_id", "ord").collect()
    assert [r.title for r in out if r.doc_id == "d"] == [f"t{k}" for k in range(30)] and [r.title for r in out if r.doc_id == "e"] == ["a", "aa", "b"]
    items = spark.createDataFrame([("d", 1, "x", None), ("d", 2, None, "r2"), ("d", 3, "gone", None)], "doc_id string, node_id int, dest_name string, dest_ref string")
    named = spark.createDataFrame([("d", "x", "r1")], "doc_id string, dest_name string, ref string")
    refs = spark.createDataFrame([("d", "r1", 7), ("d", "r2", 9)], "doc_id string, ref string, page int")
    assert {r.node_id: r.page for r in segment.resolve_outline(items, named, refs).collect()} == {1: 7, 2: 9, 3: None}


def test_pdf_source(spark):
    body = zlib.compress(b"BT (111.444.777-35) Tj ET")
    doc = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n<< /X 1 >>\nstream\nplain\nendstream"
    df = spark.createDataFrame([("a", bytearray(doc)), ("b", bytearray(b"no pdf")), ("c", None)], "doc_id string, content binary")
    assert [(r.doc_id, r.text) for r in readers.text_streams(df).collect()] == [("a", "BT (111.444.777-35) Tj ET")]


def test_rendering(spark):
    c = one(spark, render.event_markdown(F.lit("T"), F.lit(3), F.lit(5), F.col("l")), l=["a", " ", None])
    assert c == "# T\n\n<!-- páginas 3-5 do PDF original -->\n\na\n\n---\n\n[Texto não extraído da página 4.]\n\n---\n"
    assert one(spark, render.output_name(F.col("t"), F.lit(4), F.lit(12), F.lit("?")), t="aNA lima") == "CNIS Ana 05.pdf"


def test_unreadable_documents_fail(spark):
    specs = spark.createDataFrame([("a", "x", "X", ["1"]), ("b", "x", "X", ["1"])], "doc_id string, id string, label string, verify array<string>")
    hits = specs.select("doc_id", "id", F.lit(1).alias("n"))
    texts = spark.createDataFrame([("a", "2"), ("b", "2")], "doc_id string, text string")
    out = verify.verdict(specs, hits, verify.residuals(specs, texts), spark.createDataFrame([("b",)], "doc_id string"))
    assert {r.doc_id: r.ok for r in out.collect()} == {"a": True, "b": False}


EVENTS = "doc_id string, ts timestamp, type string, percent double, idx int, total int"


def stream_of(frame, spark, tmp_path, name):
    """The whole result of a stream over files of the folder, run until nothing is left to read."""
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_throttle_in_batch_and_stream(spark, tmp_path):
    import datetime as dt

    at = lambda ms: dt.datetime(2030, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("d", at(100), "scan", 1.0, 0, 9), ("d", at(200), "scan", 2.0, 1, 9), ("d", at(350), "scan", 3.0, 2, 9), ("d", at(351), "ocr", 4.0, 3, 9), ("e", at(300), "scan", 5.0, 0, 9)]
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted((r.doc_id, r.idx) for r in progress.throttled(df).collect()) == [("d", 0), ("d", 2), ("d", 3), ("e", 0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    shown = stream_of(progress.throttle_stream(progress.read_events(spark, str(tmp_path / "in"))), spark, tmp_path, "shown")
    assert sorted(r.percent for r in shown) == [1.0, 3.0, 4.0, 5.0]


def test_estimates_as_a_stream(spark, tmp_path):
    import datetime as dt

    rows = [("d", dt.datetime(2030, 1, 1) + dt.timedelta(seconds=s), "scan", p, k, 9) for k, (s, p) in enumerate([(0, 5.0), (40, 10.0), (50, 20.0), (55, None), (60, 15.0), (70, 60.0)])]
    df = spark.createDataFrame(rows, EVENTS)
    batch = sorted((r.ts, r.top, r.estimate or 0) for r in progress.estimates(df.withColumn("seq", F.col("idx"))).collect())
    assert [e for *_, e in batch[:2]] == [0, 0] and batch[2][2] == 250_000 and batch[3] == (batch[3][0], 20.0, batch[3][2])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = progress.estimate_stream(progress.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("estimated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()  # comes to rest
        assert sorted((r.ts, r.top, r.estimate or 0) for r in spark.sql("SELECT * FROM estimated").collect()) == batch and batch[-1][2] > 0
    finally:
        q.stop()


def test_stream_keeps_state_between_files_until_idle(spark, tmp_path):
    import datetime as dt

    at = lambda ms: dt.datetime(2030, 1, 1) + dt.timedelta(milliseconds=ms)
    # Three runs over one checkpoint: a document's state lasts, is dropped an hour after its last event, and starts anew.
    files = [[("d", at(0), "scan", 1.0)], [("d", at(100), "scan", 2.0), ("e", at(9_000_000), "scan", 3.0)], [("e", at(9_000_100), "scan", 4.0), ("f", at(9_100_000), "ocr", 5.0)]]
    seen, q = [], None
    for k, rows in enumerate(files):
        spark.createDataFrame([(*r, 0, 9) for r in rows], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = progress.throttle_stream(progress.read_events(spark, str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        seen.append(sorted(r.percent for r in spark.read.schema(progress.SHOWN).parquet(str(tmp_path / "out")).collect()))
    assert seen == [[1.0], [1.0, 3.0], [1.0, 3.0, 5.0]]
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert left and left[-1] < 9  # the idle document's rows are gone


def test_small_column_functions(spark):
    assert one(spark, T.hex_utf16(F.col("t")), t="00C90020D83DDE00") == "É 😀" and one(spark, T.hex_latin1(F.col("t")), t="C920") == "É "
    assert [one(spark, T.common_surname(F.col("t")), t=t) for t in ("Silva", "SOUZA", "Zulmiro")] == [True, True, False]
    both = one(spark, specs.merge_hits(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))), t="")
    assert both == {"a": 1, "b": 5, "c": 4}
    got = one(spark, detect.protected(F.col("t")), t="é 1234567-89.2030.4.05.6789 e " * 3)
    assert [(r.b, r.e) for r in got] == [(2 + 30 * k, 27 + 30 * k) for k in range(3)] and got[0].m0 == "1234567-89.2030.4.05.6789"
    assert one(spark, detect.protected(F.col("t")), t=None) == []

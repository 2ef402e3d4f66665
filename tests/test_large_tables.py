"""What keeps the queries' time and memory in proportion on large tables, and odd values that only these hold."""

import contextlib
import io
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from sigilo.llm import simhash
from sigilo.functions import text
from sigilo.operators import detect, extract, names, pdf, segment
from sigilo.plans import catalogue, modes
from sigilo.plans.made_files import made_file
from sigilo.plans.views import view
from sigilo.sources import pdf_text, readers
from sigilo.sources.pdf_objects import PdfFile

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rows_of_one_file_are_dealt_to_all_tasks(spark):
    for name in ("v_person", "v_case_page", "v_outline"):
        assert view(spark, SMALL, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_names_are_detected_once(spark):
    assert plan_of(catalogue.queries()["name_aliases"](spark, SMALL)).count("ArrowEvalPython") == 1


def test_no_pattern_is_compiled_for_a_name(monkeypatch):
    text = "AUTOR: ZULMIRO KOPROWSKI. Sr. Zulmiro Koprowski, SENHORA KOPROWSKI e Sr Koprowskis."
    a = names.Aliases(text, frozenset())
    monkeypatch.setattr(re, "escape", lambda _: 1 / 0)
    a.addressed("KOPROWSKI")
    assert a.pairs == {"SENHORA KOPROWSKI": ("SENHORA K.       ", "addressed")}


def test_specs_are_built_once(spark):
    for name in ("spec_build", "spec_address"):
        plan = plan_of(catalogue.queries()[name](spark, SMALL))
        assert "size(" not in "".join(x for x in plan.splitlines() if "Filter" in x)


def test_process_numbers_stay_and_masks_are_no_residuals(spark):
    pages = [
        "Processo 9500000-00.2024.4.03.0000 CRM/SP 500000 0AB/RJ 00000 SP00000 OAB/SP 000000 RG n. 00.000.000-0 u1@exemplo.org fim",
        "Processo 6515082-18.2024.4.03.7934 CRM/SP 515082 u2@exemplo.org fim",
    ]
    v = spark.createDataFrame([(str(k), 0, t) for k, t in enumerate(pages)], "doc_id string, page int, text string")
    files = catalogue._pdf_files(v, F.col("text"))
    split = files.withColumn("content", F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("-00.2024"), F.lit(") Tj (-00.2024")), "ISO-8859-1"))
    for one in (files, split):
        got = {r.doc_id: r for r in modes.redact(one, v, catalogue._first_names(spark)).collect()}
        for k, number in ("0", "9500000-00.2024.4.03.0000"), ("1", "6515082-18.2024.4.03.7934"):
            text = (got[k].content or b"").decode("latin-1").replace(") Tj (", "")
            assert got[k].ok and number in text and "@exemplo.org" not in text and "500000 " not in text.replace(number, "") and "515082 " not in text.replace(number, "")


def test_made_texts_and_files_are_never_broadcast(spark):
    for name in ("pair_table_function", "file_redaction", "mode_redact"):
        assert "Broadcast" not in plan_of(catalogue.queries()[name](spark, SMALL)), name


def test_files_are_made_and_read_once(spark):
    for name in ("file_page_text",):
        plan = plan_of(catalogue.queries()[name](spark, SMALL))
        assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1


def test_one_reading_gives_outlines_as_the_joins_do(spark):
    outline = F.array(*[F.struct(F.lit(f"Evento. {k} - P").alias("title"), F.lit(p).cast("long").alias("page")) for k, p in enumerate([0, 1, None, 1, 0])])
    files = spark.range(8).select(F.col("id").alias("doc_id"), made_file(F.col("id"), F.array(F.lit("a"), F.lit("b")), outline).alias("content"))
    own = segment.resolve_outline(readers.outline_nodes(files), readers.named_destinations(files), readers.page_index(files))
    cols = ["doc_id", "node_id", "parent_id", "ordinal", "title", "page"]
    assert sorted(map(str, modes.outline_of(files).select(cols).collect())) == sorted(map(str, own.select(cols).collect()))


def test_results_are_made_in_parts():
    sizes = []

    def f(x):
        sizes.append(len(x))
        return x

    assert detect.in_parts(f)(pa.array(range(1201))).to_pylist() == list(range(1201)) and max(sizes) <= detect.PART
    assert detect.in_parts(f)(pa.array([], pa.int64())).to_pylist() == []


def test_op3_sends_no_fingerprints_to_the_driver(spark):
    docs = spark.createDataFrame([(k, f"a b c d {k % 7}") for k in range(50)], "doc_id long, text string")
    assert "Broadcast" not in plan_of(simhash.near_dedup(docs))


def test_word_starts_are_edges_and_cost_one_look(spark):
    rows = ["xNome: ANA CPF", "ſNome: ANA CPF", "-nome: ANA  LIMA CPF 111.444.777-35", "_CPF 11144477735", "\t carta  de\nconcessão", "ſcarta de concessão", "a  b", "", None]
    t = F.col("t")
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(text.squeeze(t), text.document_type(t), extract.holder(t), extract.cpf(t)).collect()
    assert [tuple(r) for r in got] == [
        ("xNome: ANA CPF", "cnis", "", ""), ("ſNome: ANA CPF", "cnis", "", ""), ("-nome: ANA LIMA CPF 111.444.777-35", "cnis", "ANA LIMA", "111.444.777-35"), ("_CPF 11144477735", "cnis", "", ""),
        ("carta de concessão", "carta-concessao", "", ""), ("ſcarta de concessão", "cnis", "", ""), ("a b", "cnis", "", ""), ("", "cnis", "", ""), ("", "cnis", "", ""),
    ]
    # Neither way of an edge is tried at every place: no pattern begins with one.
    for name in ("extract_record", "extract_fields", "observations"):
        assert not re.search(r"(?:\(\?iu?\))?" + re.escape(text.EDGE) + r"(?:\(\?:|[A-Za-z\[])", plan_of(catalogue.queries()[name](spark, SMALL))), name


def test_numbers_of_many_pages_are_told_apart_by_sorting(spark):
    values = ["2-1", "", "1", "21", "x", "1", "y", "3"]
    df = spark.createDataFrame([(values,), ([],), (None,), ([f"{k % 20_000}" for k in range(60_000)],)], "a array<string>")
    got = [r[0] for r in df.select(extract.distinct_by_digits(F.col("a"))).collect()]
    assert got[:3] == [["2-1", "1", "3"], [], None] and got[3] == [str(k) for k in range(20_000)]


def test_digits_are_blanked_without_a_match_for_each(monkeypatch):
    monkeypatch.setattr(re, "sub", lambda *_: 1 / 0)
    assert detect.blank_digits("Nº 12.3-٣x") == "Nº 00.0-٣x" and detect.blank_digits("1-2", "*") == "*-*" and detect.only_digits("a1..2٣-3") == "123"
    assert detect.Text("PIS 123.45678.90-1").pairs(["nit"]) == {"123.45678.90-1": ("000.00000.00-0", "nit"), "12345678901": ("00000000000", "nit")}


def test_small_files_are_sent_on_together():
    files = [(str(k), b"x" * 300) for k in range(2000)] + [("large", b"y" * (2 * readers.TOGETHER))] + [("", b"")]
    batches = list(pdf.in_batches(iter(files)))
    assert len(batches) == 3 and [(r["doc_id"], r["content"]) for b in batches for r in b.to_pylist()] == files
    assert list(pdf.in_batches([])) == []


def test_labels_cost_one_look_and_numbers_one_search(spark):
    for name in ("extract_record", "extract_fields", "observations"):
        plan = plan_of(catalogue.queries()[name](spark, SMALL))
        # The first letter stands before flags and looks around, and texts without a label's letters are not searched.
        assert "(?-iu:" not in plan and "benef)" in plan, name
    rows = [
        ("111.444.777-35 x123.45678.90-0 123.45678.90-1 1.222.333-4 654.602.446-8", "111.444.777-35", ["123.45678.90-1"], "654.602.446-8"),
        ("111.444.777-355 111.444.777-3_ 1111.444.777-35 CPF 11144477735 ſpis 12345678900", "111.444.777-35", ["12345678900"], ""),
        ("benefİcio 100.200.300-4x NÚMERO DO BENEFÍCIO: 123456789-0", "", [], "123456789-0"), (None, "", [], ""),
    ]
    t = F.col("t")
    got = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, t string").orderBy("k").select(extract.cpf(t), extract.nits(t), extract.benefit(t)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_tasks_of_an_outline_grow_with_its_nodes(spark, monkeypatch):
    monkeypatch.setattr(segment, "NODES", 100)
    tree = spark.range(4000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 40)).alias("parent_id"), F.col("id").cast("int").alias("ordinal"),
        F.lit("t").alias("title"), F.col("id").alias("page"),
    )
    rounds = {}

    def keep(df, of):
        rounds[of] = df.rdd.getNumPartitions()
        return df.localCheckpoint()

    assert segment._flattened(tree, keep).count() == 4000
    assert min(n for of, n in rounds.items() if of != "rows") >= 40


def test_the_width_of_a_text_counts_only_where_more_is_shown_behind_it(monkeypatch):
    calls, times = [], pdf_text.times
    monkeypatch.setattr(pdf_text, "times", lambda a, b: calls.append(1) or times(a, b))
    page = pdf_text.Page(PdfFile(b""), {})
    page.run(b"BT /F1 10 Tf 1 0 0 1 40 700 Tm (" + b"x" * 5000 + b") Tj 1 0 0 1 40 600 Tm (ab ) Tj 5 Tw [(c d) -300 (e)] TJ (f) Tj ET", {})
    assert len(calls) < 50
    assert [(t, round(x, 6), y) for t, x, y, _ in page.items] == [("x" * 5000, 40, 700), ("ab ", 40, 600), ("c d e", 55, 600), ("f", 83, 600)]


def test_codes_are_made_only_for_streams_that_have_some(monkeypatch):
    monkeypatch.setattr(pdf, "hex_specs", lambda *_: 1 / 0)
    assert pdf.apply_to_stream("BT (a 123 b) Tj [(1)(2)] TJ ET", [("x", [("123", "000")]), ("y", [("12", "99")])], []) == ("BT (a 000 b) Tj [(99)] TJ ET", {"x": 1, "y": 1})


def test_what_is_left_is_found_where_streams_are_rewritten(spark):
    specs = spark.createDataFrame(
        [("1", 0, "a", [("ANA LIMA", "XXX XXXX")], ["ANA  LIMA"]), ("1", 1, "b", [("zz", "yy")], ["12345678", "kept"]), ("1", 2, "c", [], ["", "AB" * 20]), ("2", 0, "a", [("kept", "gone")], ["kept"])],
        "doc_id string, ord int, id string, pairs array<struct<o:string,s:string>>, verify array<string>",
    )
    texts = ["BT (ANA  LIMA zz) Tj ET", "BT (kept) Tj ET", "BT <" + b"12345678".hex() + "> Tj ET", "BT (" + ("AB" * 20).encode().hex() + ") Tj ET", "BT [(12)(345678)] TJ ET"]
    streams = spark.createDataFrame([(d, n, t) for d in "123" for n, t in enumerate(texts)], "doc_id string, ord int, text string").repartition("doc_id")
    got = {(r.doc_id, r.ord): (r.left, r.changed) for shown in (False, True) for r in pdf.apply_listed(streams, pdf.listed_specs(specs), None, shown).filter(F.lit(shown) | (F.col("doc_id") != "1")).collect()}
    assert [got["1", n] for n in range(5)] == [(["a"], True), (["b"], False), (["b"], False), (["c"], False), (["b"], False)]
    assert [got["2", n] for n in range(2)] == [([], False), ([], True)] and all(got["3", n] == ([], False) for n in range(5))


def test_pairs_and_findings_come_from_one_look(spark):
    docs = spark.createDataFrame([("1", "AUTOR: ZULMIRO KOPROWSKI CPF 111.444.777-35 NIT 123.45678.90-1 Processo 0863171-79.2024.4.03.5777"), ("2", None)], "doc_id string, text string")
    first = catalogue._first_names(spark)
    one = names.map_and_count(docs, names.dictionary(first))
    assert plan_of(one).count("ArrowEvalPython") == 1
    two = names.map_pairs(docs, first).join(modes.counted(docs, first).drop("text"), "doc_id")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_detectors_are_tried_only_where_they_can_begin():
    start = time.monotonic()
    assert detect.Text("a" * 100_000 + "@").matches("email") == []  # tried at every place, this is quadratic
    assert time.monotonic() - start < 2
    texts = [
        "a@b.cox.y@d-e.br @. İd RG 12.345-6 PIS/PASEP 123.45678.90-1 (11) 91234-5678 11 1234 5678 CPF12345678901 0863171-79.2024.4.03.5777", "ÁLVARES RJ12345 ABC  SP1234 SP12345 _AB1234 xAB1234 AB1234567 RUA PERICIAL 1 Av. B, CRM/SP 1234",
        "123.45678.90-1.123.45678.90-1 1234567890 .V5 12345678v2 Nº 123456789012345678 oab-sp) sob o n. 12.345 0AB 123", "", "Número do benefício: 123456789 EspÉcie/NB --/123456 TÍTULO 1234567890 cÓdigo  verificador 12345678v1",
    ]
    for t in texts:
        for x in (detect.Text(t), detect.Text(t).dealt()):
            for name, d in detect.DETECTORS.items():
                assert [m.span() for m in x.matches(name)] == [m.span() for m in d.python.finditer(t)], (name, t)
            assert [m.span() for m in x.processes] == [m.span() for m in detect.PROCESS.python.finditer(t)]

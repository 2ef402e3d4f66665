"""Registered queries of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import DETECTORS
from ..operators import detect, extract, fabricate, names, pdf, render, segment, specs, verify
from ..sources.shared import checkpointed, merged
from ..streaming import progress
from . import modes, oracle
from .made_files import FORMS, made_file
from .views import view

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTERED[f.__name__] = f
    return f


def _long(c: Column) -> Column:
    return c.cast("long")


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["o"], F.lit(">"), p["s"])), "|")


@query
def email_redaction_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an e-mail address: how many, the redacted length, and whether one is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter(F.contains("text", F.lit("@")))
    found = docs.withColumn("mails", F.regexp_extract_all("text", F.lit(DETECTORS["email"].java), F.lit(0))).filter(F.size("mails") > 0)
    masked = F.aggregate(F.array_distinct("mails"), F.col("text"), lambda t, m: F.replace(t, m, T.mask_all(m)))
    return found.select("doc_id", _long(F.size("mails")).alias("n_emails"), _long(F.length(masked)).alias("redacted_len"), masked.rlike(DETECTORS["email"].java).alias("residual"))


@query
def cpf_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person").withColumn("made", fabricate.cpf_of(F.col("base9")))
    last = F.translate(F.substring("made", 14, 1), "0123456789", "1234567890")
    v = v.withColumn("cpf", F.when(F.col("corrupt"), F.concat(F.substring("made", 1, 13), last)).otherwise(F.col("made")))
    return v.select("doc_id", "cpf", T.digits_only(F.col("cpf")).alias("digits"), T.valid_cpf(F.col("cpf")).alias("valid"))


@query
def nit_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person").withColumn("nit", fabricate.nit_of(F.col("base10")))
    return v.select("doc_id", "nit", T.valid_nit(F.col("nit")).alias("valid"), T.format_benefit(F.col("base10")).alias("benefit"))


@query
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    name = F.concat(F.lit("Ana de Souza "), F.col("name"))
    code = F.concat(F.lit("Ab-"), F.col("base9"), F.lit("xZ"))
    return v.select(
        "doc_id", T.mask_digits(F.col("name")).alias("digits"), T.mask_cpf(F.col("base9")).alias("cpf"), T.mask_all(F.col("name")).alias("everything"),
        T.mask_label_number(F.lit("OAB/SP "), F.col("base9")).alias("label_number"), T.mask_code(code).alias("code"), T.mask_initials(name).alias("initials"),
    )


@query
def format_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_case_page")
    title = F.concat(F.lit("Evento. "), F.col("k").cast("string"), F.lit(" - PETIÇÃO [inicial]  nº_"))
    return v.select(
        "doc_id", "k", T.squeeze(title).alias("squeezed"), T.sanitize_filename(title).alias("filename"), T.escape_markdown(title).alias("escaped"), T.token_key(title).alias("token"),
        T.document_title(F.concat(F.lit("processo_"), F.col("k").cast("string"), F.lit("-final.PDF"))).alias("title"), T.clean_name(F.concat(F.lit(" Ana  Lima :;-"))).alias("name"),
        T.clean_code(F.concat(F.lit("abc-"), F.col("k").cast("string"), F.lit(".;"))).alias("code"), T.is_event_title(title).alias("is_event"), T.is_critical(F.col("text")).alias("critical"),
    )


def _detect(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = detect.add_pairs(view(spark, sf_dir, "v_case_page"), [DETECTORS[name]]).filter(F.size("pairs") > 0)
        return v.select("doc_id", "page", _long(F.size("pairs")).alias("n"), _joined(F.col("pairs")).alias("pairs"))

    run.__name__ = f"detect_{name}"
    return run


for _name in DETECTORS:
    query(_detect(_name))


@query
def protected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_case_page").select("doc_id", "page", F.explode(detect.protected(F.col("text"))).alias("r"))
    return v.select("doc_id", "page", _long(F.col("r.b")).alias("begin_at"), _long(F.col("r.e")).alias("end_at"), F.col("r.m0").alias("number"))


@query
def pair_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = detect.add_pairs(view(spark, sf_dir, "v_case_page"))
    return v.select("doc_id", "page", _long(F.size("pairs")).alias("n"), _joined(F.col("pairs")).alias("pairs"))


@query
def pair_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by the table function, called from SQL with a partition for each page."""
    detect.register_emit_pairs(spark)
    v = view(spark, sf_dir, "v_case_page").select("doc_id", "page", "text")
    rows = spark.sql("SELECT * FROM emit_pairs(TABLE(SELECT * FROM {v}) PARTITION BY (doc_id, page))", v=v)
    each = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("k", "o", "s"))).alias("pairs"))
    out = v.select("doc_id", "page").join(merged(each), ["doc_id", "page"], "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<k:int,o:string,s:string>>")))
    return out.select("doc_id", "page", _long(F.size("pairs")).alias("n"), _joined(F.col("pairs")).alias("pairs"))


@query
def apply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted pages, both by falling length and in insertion order, and what detectors still find."""
    v = detect.add_pairs(view(spark, sf_dir, "v_case_page"))
    v = v.withColumn("redacted", detect.apply_pairs(F.col("text"), F.col("pairs"))).withColumn("in_order", detect.apply_pairs(F.col("text"), F.col("pairs"), False))
    v = detect.findings(v.select("doc_id", "page", "redacted", "in_order", F.length("text").alias("n")), "redacted")
    return v.select("doc_id", "page", _long(F.length("redacted")).alias("n_chars"), (F.length("redacted") == F.col("n")).alias("same_length"), "cpfs", "identifiers", F.md5("redacted").alias("digest"), F.md5("in_order").alias("digest_in_order"))


@query
def pairs_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed pairs, longest original first, replaced one after the other."""
    pairs = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for o, s in oracle.FIXED_PAIRS])
    ordered = detect.by_length(pairs)
    v = view(spark, sf_dir, "v_case_page")
    return v.select("doc_id", "page", F.array_join(F.transform(ordered, lambda p: p["o"]), "|").alias("ordered"), detect.apply_pairs(F.col("text"), pairs).alias("replaced"))


@query
def findings_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = detect.findings(view(spark, sf_dir, "v_case_page"))
    return v.select("doc_id", "page", "cpfs", "nits", "oabs", "crms", "addresses", "identifiers", F.array_join("processes", "|").alias("processes"))


@query
def findings_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = detect.findings(view(spark, sf_dir, "v_case_page"))
    return v.groupBy("doc_id").agg(F.sum(detect.total_findings()).alias("total"), F.count("*").alias("pages"))


@query
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, low, found = F.col("text"), F.col("low"), F.col("found")
    v = view(spark, sf_dir, "v_case_page").withColumns({"low": F.lower(t), "found": extract.numbers(t)})
    return v.select(
        "doc_id", "page", extract.cpf(t, low, found).alias("cpf"), F.array_join(extract.nits(t, found), "|").alias("nits"), extract.benefit(t, low, found).alias("benefit"), extract.code(t, low).alias("code"),
        T.document_type(t, low).alias("kind"), extract.process_number(t).alias("process"),
    )


@query
def extract_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_record(view(spark, sf_dir, "v_case_page"))
    return out.select("doc_id", "tipo", "cpf", "beneficio", "codigo", F.array_join("nits", "|").alias("nits"))


LABELLED = "Nome: ANA TESTE LIMA CPF: 111.444.777-35 Nome da mãe: RITA TESTE Data de nascimento: 01/01/1970"


@query
def extract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    t = F.concat(F.lit("Titular: "), F.translate("name", "#0123456789", " ABCDEFGHIJ"), F.lit(" CPF: 1 Nome da mãe: RITA "), F.translate(F.col("base9"), "0123456789", "KLMNOPQRST"), F.lit(" Data de nascimento"))
    return v.select("doc_id", extract.holder(t).alias("holder"), extract.mother(t).alias("mother"))


def _address_lines(v: DataFrame) -> Column:
    n = F.col("doc_id").cast("string")
    return F.array(
        F.lit("Nome: ANA"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Endereço: RUA "), n, F.lit(" - CENTRO"))).otherwise("Endereço"), F.concat(F.lit("AVENIDA DOS TESTES, "), n),
        F.when(F.col("doc_id") % 3 == 0, "uma lacuna qualquer").otherwise("LOJA A"), F.lit("SALA 2 - CENTRO"), F.lit("Banco 001"), F.lit("BLOCO B"),
    )


@query
def extract_address_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    v = v.withColumn("a", extract.address(_address_lines(v)))
    return v.select("doc_id", F.array_join("a.lines", "|").alias("lines"), F.array_join("a.raw", "|").alias("raw"))


@query
def process_number_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "v_case_page")
    docs = pages.select("doc_id").distinct().withColumn("name", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("autos_"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(".pdf"))).otherwise("autos.pdf"))
    events = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("ord"), F.concat(F.lit("Evento 1 "), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit("-01.2024.4.03.0001")).alias("title"), F.lit("x.md").alias("filename"))
    return extract.infer_process(docs, events, pages)


@query
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.group_lines(view(spark, sf_dir, "v_text_item"))
    return out.select("doc_id", _long(F.col("page")).alias("page"), _long(F.col("line_no")).alias("line_no"), "text")


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_text(view(spark, sf_dir, "v_text_item")).select("doc_id", "text")


@query
def page_lines_eol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_lines(view(spark, sf_dir, "v_text_item")).select("doc_id", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"))


def _thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_case_page")
    return v.select("doc_id", "page", "k", F.expr("CASE k % 4 WHEN 0 THEN concat('Evento ', cast(k AS string), ', Página ', cast(page AS string), ' de 9 curta') WHEN 1 THEN '' WHEN 2 THEN text ELSE repeat('a', 49 + cast(k % 3 AS int)) END").alias("text"))


@query
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thin_pages(spark, sf_dir).select("doc_id", "page", T.needs_ocr(F.col("text")).alias("needs_ocr"))


@query
def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = segment.scan_pages(_thin_pages(spark, sf_dir))
    off = segment.route_ocr(pages, enabled=False, mode="omit")
    return off.groupBy("doc_id").agg(F.count_if(F.col("route") == "omitted").alias("omitted"), F.count_if(F.col("route") == "text").alias("kept"), F.count_if(F.col("text").isNull()).alias("nulls"))


@query
def ocr_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    w, h = F.col("doc_id") * 7.0, F.lit(842.0)
    return v.select("doc_id", F.round(T.ocr_scale(w, h), 9).alias("scale"), _long(T.ocr_workers(F.col("doc_id") % 20, F.col("doc_id") % 9)).alias("workers"))


@query
def separator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_separator").select("doc_id", segment.separator_title(F.col("text")).alias("title"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_outline")
    return segment.event_ranges(items, items.select("doc_id").distinct().withColumn("total", F.lit(45).cast("long")), only_event_titles=True)


@query
def event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("doc_id", *[_long(F.col(c)).alias(c) for c in ("ord", "start", "end_excl", "start_label", "end_label", "page_count")], "title", "filename")


@query
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = segment.event_pages(_events(spark, sf_dir))
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), _long(F.sum("page")).alias("page_sum"), _long(F.max("ord")).alias("last_event"))


@query
def uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    pages = e.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(44).cast("long"))).alias("page"))
    return segment.uncovered_pages(e, pages).select("doc_id", "page")


@query
def unique_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.unique_filenames(_events(spark, sf_dir)).select("doc_id", _long(F.col("ord")).alias("ord"), "filename")


@query
def single_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    docs = view(spark, sf_dir, "v_person").select("doc_id", F.concat(F.lit("autos_"), F.col("base9"), F.lit(".pdf")).alias("name"), F.lit(7).alias("total"))
    return segment.single_events(docs, e).select("doc_id", "title", "filename", _long(F.col("page_count")).alias("page_count"))


@query
def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_outline")
    tree = v.select("doc_id", F.col("ord").alias("node_id"), F.when(F.col("ord") > 0, F.floor((F.col("ord") - 1) / 40)).alias("parent_id"), F.col("ord").cast("int").alias("ordinal"), "title", "page")
    return segment.flatten_outline(tree).select("doc_id", _long(F.col("ord")).alias("ord"), "title", "page")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    v = v.withColumn("a", extract.address(_address_lines(v)))
    return v.select(
        "doc_id", F.lit("carta-concessao").alias("tipo"), F.concat(F.lit("Bruno "), F.translate("name", "#0123456789", " ABCDEFGHIJ")).alias("nome"), fabricate.cpf_of(F.col("base9")).alias("cpf"),
        F.array(fabricate.nit_of(F.col("base10")), F.lit("123.45678.90-0")).alias("nits"), F.when(F.col("corrupt"), "").otherwise("RITA TESTE").alias("nome_mae"), T.format_benefit(F.col("base10")).alias("beneficio"),
        F.concat(F.col("base9"), F.lit("ABCXY")).alias("codigo"), F.col("a.lines").alias("endereco_linhas"), F.col("a.raw").alias("endereco_brutas"), F.array_join("a.lines", " ").alias("endereco"),
    )


@query
def fabricate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fictitious records and their invariants."""
    f = fabricate.record(_records(spark, sf_dir), seed=7)
    fresh = ~F.arrays_overlap(F.transform("f_nits", T.digits_only), F.transform("nits", T.digits_only))
    return f.select(
        "doc_id", "f_nome", "f_cpf", F.array_join("f_nits", "|").alias("f_nits"), "f_beneficio", "f_codigo", "f_endereco", T.valid_cpf(F.col("f_cpf")).alias("cpf_ok"),
        F.forall("f_nits", T.valid_nit).alias("nits_ok"), fresh.alias("nits_fresh"), (F.size(F.array_distinct("f_nits")) == F.size("nits")).alias("nits_distinct"),
        (F.length("f_beneficio") == F.length("beneficio")).alias("benefit_ok"), ((F.length("f_codigo") == F.length("codigo")) & (F.col("f_codigo") != F.col("codigo"))).alias("code_ok"),
        (F.size("f_endereco_linhas") == F.size("endereco_linhas")).alias("address_ok"),
    )


def _fixed_fakes(r: DataFrame) -> DataFrame:
    """Records with fictitious values that SQL can restate."""
    swap = lambda c: F.translate(c, "0123456789", "1234567890")
    return r.select(
        "*", F.lit("Ana Falsa").alias("f_nome"), swap(F.col("cpf")).alias("f_cpf"), F.transform("nits", swap).alias("f_nits"), F.lit("Maria Falsa").alias("f_nome_mae"), swap(F.col("beneficio")).alias("f_beneficio"),
        swap(F.col("codigo")).alias("f_codigo"), F.transform("endereco_linhas", swap).alias("f_endereco_linhas"), swap(F.col("endereco")).alias("f_endereco"),
    )


@query
def spec_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = specs.build(_fixed_fakes(_records(spark, sf_dir))).select("doc_id", F.posexplode_outer("specs").alias("ord", "s"))
    s = s.filter(~F.col("s.id").isin("endereco"))
    return s.select("doc_id", F.col("s.id").alias("id"), F.col("s.label").alias("label"), _joined(F.col("s.pairs")).alias("pairs"), F.array_join("s.verify", "|").alias("verify"))


@query
def spec_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = specs.build(_fixed_fakes(_records(spark, sf_dir))).select("doc_id", F.explode_outer("specs").alias("s")).filter("s.id = 'endereco'")
    return s.select("doc_id", _joined(F.col("s.pairs")).alias("pairs"), F.array_join("s.verify", "|").alias("verify"))


@query
def spec_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = specs.comparison(_fixed_fakes(_records(spark, sf_dir)), F.col("tipo"))
    return c.select("doc_id", "label", "original", "fake", "field", T.display_mask(F.col("original"), F.col("field")).alias("shown"))


def _checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specs with one original each, texts with some of them left, and hits."""
    p = view(spark, sf_dir, "v_person").select("doc_id", "base9", "base10", "corrupt")
    rows = p.select("doc_id", F.explode(F.array(F.struct(F.lit("cpf").alias("id"), F.lit("CPF").alias("label"), F.array("base9").alias("verify")), F.struct(F.lit("mail").alias("id"), F.concat(F.lit("a"), F.col("base9"), F.lit("@x.org")).alias("label"), F.array("base10").alias("verify")), F.struct(F.lit("nome").alias("id"), F.lit("Nome").alias("label"), F.array(F.lit("ANA  LIMA")).alias("verify")))).alias("s")).select("doc_id", "s.*")
    texts = p.select("doc_id", F.concat(F.lit("BT ("), F.when(F.col("corrupt"), F.col("base9")).otherwise("000"), F.lit(") Tj ET "), F.when(F.col("doc_id") % 5 == 0, F.col("base10")).otherwise(""), F.when(F.col("doc_id") % 7 == 0, " ANA LIMA").otherwise("")).alias("text"))
    hits = rows.select("doc_id", "id", F.when((F.col("doc_id") % 4 == 0) | (F.col("id") == "nome"), 0).otherwise(2).alias("n"))
    return rows, texts, hits


@query
def residual_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts, _ = _checks(spark, sf_dir)
    raw = verify.residuals(rows, texts.filter(T.is_text_stream(F.col("text")))).withColumn("way", F.lit("stream"))
    return raw.unionByName(verify.residuals(rows, texts, normalise=True).withColumn("way", F.lit("text"))).select("doc_id", "id", "way")


@query
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, hits = _checks(spark, sf_dir)
    return verify.pending(rows, hits).select("doc_id", "id")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts, hits = _checks(spark, sf_dir)
    return verify.verdict(rows, hits, verify.residuals(rows, texts))


@query
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    return v.select("doc_id", "expected", "applied", F.array_join("unreplaced", "|").alias("unreplaced"), F.array_join("unmatched", "|").alias("unmatched"), "ok")


@query
def judicial_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verify.judicial_verdict(_verdicts(spark, sf_dir))
    return v.select("doc_id", F.array_join("unreplaced", "|").alias("critical"), F.array_join(F.array_sort("unmatched"), "|").alias("unmatched"), "ok")


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    pages = segment.event_pages(e).select("doc_id", "page", F.expr("CASE page % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('texto ', cast(page AS string)) END").alias("text"), (F.col("page") % 9 == 0).alias("ocr"))
    return segment.assemble(segment.unique_filenames(e), pages)


@query
def event_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assembled(spark, sf_dir)
    return a.select("doc_id", _long(F.col("ord")).alias("ord"), "ocr", render.event_markdown(F.col("title"), F.col("start_label"), F.col("end_label"), F.col("page_texts")).alias("content"))


@query
def index_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assembled(spark, sf_dir)
    return render.index_markdown(a, a.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "0000001-01.2024.4.03.0001").otherwise("Processo").alias("process")).distinct())


@query
def split_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assembled(spark, sf_dir)
    out = render.outputs(a, a.select("doc_id", F.lit("Processo").alias("process")).distinct())
    return out.select("doc_id", "path", _long(F.length("content")).alias("n_chars"), F.md5("content").alias("digest"))


@query
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    d = F.col("doc_id")
    counts = [(d % m).alias(c) for c, m in (("pieces", 9), ("ocr_count", 7), ("ocr_failed", 3), ("ocr_skipped", 2), ("omitted", 5), ("replacements", 11), ("residual", 4))]
    found = [(d % (k + 2)).alias(f"{side}_{c}") for side in "az" for k, (_, c) in enumerate(render.FINDINGS)]
    return render.report_markdown(v.select("doc_id", F.when(F.col("corrupt"), "Processo").otherwise(F.col("base9")).alias("process"), (d % 2 == 0).alias("ocr_enabled"), *counts, *found))


MODES = ["cnis", "carta-concessao", "processo-judicial", "extrair-pecas", "outro"]


@query
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    d = F.col("doc_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (d % 5 + 1).cast("int"))
    name = F.when(F.col("corrupt"), "").otherwise(F.concat(F.lit("  mARIA "), F.col("name")))
    process = F.when(F.col("corrupt"), "Processo").otherwise(F.col("base9"))
    return v.select("doc_id", render.output_name(name, d % 150, F.when(d % 7 == 0, 1).otherwise(150), mode).alias("name"), render.zip_name(process, d % 2 == 0).alias("zip"), T.pieces_label(d % 3).alias("pieces"))


@query
def admission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    files = view(spark, sf_dir, "v_person").select("doc_id", F.concat(F.lit("f"), F.col("base9"), F.when(d % 4 == 0, ".PDF").otherwise(".pdf")).alias("path"), (d * 1_000_003 % (90 * 1024 * 1024)).alias("length"))
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (d % 5 + 1).cast("int"))
    return render.admission(files, mode).select("doc_id", "accepted", "reason")


@query
def display_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    show = lambda c, f: T.display_mask(c, F.lit(f))
    return v.select(
        "doc_id", show(fabricate.cpf_of(F.col("base9")), "cpf").alias("cpf"), show(fabricate.nit_of(F.col("base10")), "nit").alias("nit"), show(F.concat(F.lit("Ana "), F.col("name")), "nome").alias("nome"),
        show(F.col("base10"), "codigo").alias("codigo"), show(F.concat(F.lit("RUA  DOS "), F.col("name")), "endereco").alias("endereco"),
    )


@query
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    d = F.col("doc_id")
    return v.select("doc_id", T.duration(d * 9973).alias("duration"), T.human_bytes(d * d * 173).alias("size"), F.coalesce(T.estimated_total(d * 997, (d % 110).cast("double")), F.lit(-1)).alias("total"), T.missing_text_mode(F.when(d % 2 == 0, "omit").otherwise("x")).alias("mode"))


@query
def progress_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_progress").withColumn("idx", F.col("seq").cast("int")).withColumn("total", F.col("total").cast("int"))
    return progress.sampled(v).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


@query
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = progress.estimates(view(spark, sf_dir, "v_progress"))
    return e.groupBy("doc_id").agg(F.max("top").alias("top"), F.count("estimate").alias("n_estimates"), F.max_by("estimate", "seq").alias("last_estimate"))


@query
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_progress").withColumn("idx", F.col("seq")).withColumn("ts", F.timestamp_millis(F.col("seq") * 100))
    return progress.throttled(v).groupBy("doc_id").agg(F.count("*").alias("shown"))


def _case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_person")
    n = F.translate("base9", "0123456789", "ABCDEFGHIJ")
    return v.select(
        "doc_id",
        F.concat(F.lit("Compareceu Maria "), F.initcap(n), F.lit(" de Souza Prado, AUTOR: ZULMIRO "), n, F.lit(" PRADO. SP123456 - JOSE "), n, F.lit(" TESTE LEAL falou. Sr. Zulmiro "), F.initcap(n), F.lit(" Prado e ZULMIRO PRADO assinam. RÉU: INSTITUTO NACIONAL DE TESTES - INSS"))
        .alias("text"),
    )


def _first_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in ("ana", "bruno", "joao", "maria", "rita")], "name string")


@query
def name_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = names.add_names(_case_texts(spark, sf_dir), _first_names(spark))
    return v.select("doc_id", F.array_join("names", "|").alias("names"), _long(F.size("name_pairs")).alias("n_pairs"))


@query
def name_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = names.add_names(_case_texts(spark, sf_dir), _first_names(spark)).select("doc_id", F.explode("name_pairs").alias("p"))
    return v.select("doc_id", F.col("p.kind").alias("kind"), F.col("p.o").alias("original"), F.col("p.s").alias("substitute"), (F.length("p.o") == F.length("p.s")).alias("same_length"))


@query
def pdf_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values spread over several strings of a stream, and one of another length, replaced."""
    v = view(spark, sf_dir, "v_person").withColumn("doc", F.col("doc_id").cast("string"))
    a, b = F.substring("base9", 1, 4), F.substring("base9", 5, 5)
    text = F.concat(F.lit("BT [("), a, F.lit(")-4("), b, F.lit(")] TJ (x "), F.col("name"), F.lit(") Tj <"), T.latin1_hex(F.col("base10")), F.lit("> Tj ET"))
    streams = v.select(F.col("doc").alias("doc_id"), F.lit(0).alias("ord"), text.alias("text"))
    kinds = [("a", F.col("base9"), T.zeros(F.col("base9"))), ("b", F.col("base10"), T.zeros(F.col("base10"))), ("c", F.col("name"), F.lit("ANA FAKE"))]
    rows = v.select(F.col("doc").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("id"), o.alias("o"), s.alias("s")) for i, o, s in kinds])).alias("p")).select("doc_id", "p.*")
    out = pdf.apply_specs(streams, rows)
    hit = lambda i: F.coalesce(F.try_element_at("hits", F.lit(i)), F.lit(0).cast("long"))
    return out.select("doc_id", "text", hit("a").alias("literal_hits"), hit("b").alias("hex_hits"), hit("c").alias("raw_hits"))


def _pdf_files(v: DataFrame, *shown: Column) -> DataFrame:
    """(doc_id, path, content): a file of one stream that shows the values."""
    body = F.concat(F.lit("BT "), *[F.concat(F.lit("("), T.escape_pdf_literal(s), F.lit(") Tj ")) for s in shown], F.lit("ET"))
    head = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Length "), F.length(body).cast("string"), F.lit(" >>\nstream\n"))
    return v.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode(F.concat(head, body, F.lit("\nendstream\nendobj\n")), "ISO-8859-1").alias("content"))


@query
def mode_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records found, replaced in files and verified; corrupt customers' files keep a number behind another form and are withheld."""
    v = view(spark, sf_dir, "v_person").withColumn("made", fabricate.cpf_of(F.col("base9")))
    name = F.concat(F.lit("BRUNO "), F.translate("name", "#0123456789", " ABCDEFGHIJ"))
    text = F.concat(F.lit("Nome: "), name, F.lit(" CPF: "), F.col("made"), F.lit(" Data de nascimento"))
    left = F.when(F.col("corrupt"), F.substring("made", 1, 7)).otherwise("")
    files = _pdf_files(v, name, F.when(F.col("corrupt"), "sem numero").otherwise(F.col("made")), left, F.when(F.col("corrupt"), F.upper(name)).otherwise(""))
    out = modes.substitute(files, v.select("doc_id", F.lit(0).alias("page"), text.alias("text")), seed=5)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "ok", "expected", "applied", F.array_join("unmatched", "|").alias("unmatched"), "f_nome")


@query
def file_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read from the bytes of files whose streams are plain, deflated, ASCII85 and hexadecimal, with plain and packed tables."""
    v = view(spark, sf_dir, "v_case_page").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).getField("text").alias("texts"))
    files = v.select("doc_id", made_file(F.col("doc_id"), F.col("texts")).alias("content"))
    return modes.pages_of(files).select(_long(F.col("doc_id")).alias("doc_id"), _long(F.col("page")).alias("page"), "text")


@query
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines read from the bytes of files of forty pages; entries lead to pages by name and by reference, or nowhere."""
    v = view(spark, sf_dir, "v_outline").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "title", "page"))).alias("all"))
    pages = F.array(*[F.lit(str(k)) for k in range(40)])
    files = v.select("doc_id", made_file(F.col("doc_id"), pages, F.transform("all", lambda x: F.struct(x["title"].alias("title"), x["page"].alias("page")))).alias("content"))
    tree = segment.flatten_outline(modes.outline_of(files))
    return tree.select(_long(F.col("doc_id")).alias("doc_id"), _long(F.col("ord")).alias("ord"), "title", _long(F.col("page")).alias("page"))


@query
def file_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court files redacted from their bytes alone: what the released ones show, read from their bytes again; files with a filter that no reader knows are withheld."""
    v = view(spark, sf_dir, "v_case_page").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).getField("text").alias("texts"))
    files = v.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), made_file(F.col("doc_id"), F.col("texts"), forms=len(FORMS)).alias("content"))
    done = modes.redact(checkpointed(files), None, _first_names(spark)).select("doc_id", "ok", "content")
    shown = modes.pages_of(done.filter("ok")).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text"))).getField("text"), "\n").alias("text"))
    numbers = F.size(F.regexp_extract_all("text", F.lit("[0-9]{7}-[0-9]{2}[.]2024[.]4[.]03[.][0-9]{4}"), F.lit(0)))
    out = done.select("doc_id", "ok", F.col("content").isNotNull().alias("released")).join(merged(shown), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return out.select(_long(F.col("doc_id")).alias("doc_id"), "ok", "released", _long(numbers).alias("numbers_kept"), F.contains("text", F.lit("@")).alias("mail_left"))


@query
def mode_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court pages redacted in files: what was expected, and whether the process number stands and the e-mail is gone."""
    pages = view(spark, sf_dir, "v_case_page")
    v = pages.select(F.concat_ws("-", "doc_id", "page").alias("doc_id"), F.lit(0).alias("page"), "text", "k")
    out = modes.redact(_pdf_files(v, F.col("text")), v.select("doc_id", "page", "text"), _first_names(spark)).join(merged(v.select("doc_id", "k", "text")), "doc_id")
    shown = F.decode("content", "ISO-8859-1")
    number = F.regexp_extract("text", "[0-9]{7}-[0-9]{2}[.]2024[.]4[.]03[.][0-9]{4}", 0)
    return out.select("k", "ok", F.contains(shown, number).alias("number_kept"), F.contains(shown, F.lit("@exemplo.org")).alias("mail_left"), F.contains("findings", number).alias("number_told"))


@query
def mode_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court files of several pages split by their outline, anonymised: pieces, and findings before and after."""
    pages = view(spark, sf_dir, "v_case_page").select("doc_id", "page", "text", "k")
    docs = pages.select("doc_id").distinct().withColumn("name", F.lit("autos.pdf"))
    outline = pages.filter("page % 3 = 0").select("doc_id", F.col("page").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("page").alias("ordinal"), F.concat(F.lit("Evento. "), F.col("page").cast("string"), F.lit(" - PECA")).alias("title"), "page")
    _, summary = modes.split(docs, pages.drop("k"), outline, _first_names(spark), enable_ocr=False)
    return summary.select("doc_id", "pieces", "ocr_skipped", F.col("a_oabs").alias("oabs"), F.col("a_identifiers").alias("identifiers"), F.col("z_cpfs").alias("cpfs_left"), "zip")


@query
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = extract.extract_record(view(spark, sf_dir, "v_case_page")).withColumn("endereco", F.lit(""))
    mode = F.when(F.col("doc_id") % 2 == 0, "carta-concessao").otherwise("cnis")
    return r.select("doc_id", extract.observations(mode).alias("observations"))


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()

"""Entry points: what a user of the three modes runs, from files to results that may be released.

``substitute`` (CNIS and concession letters) and ``redact`` (court files)
rewrite PDF streams and withhold every document of which something is left;
``split`` lays a court file out as Markdown by events. Page texts, lines and
outlines are tables, as a reader of PDF layouts gives them. All are plans over
documents; nothing is collected. What several steps read is written once to
the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PROCESS
from ..functions.text import empty_if_null, once, squeeze
from ..operators import detect, extract, fabricate, names, pdf, render, segment, specs, verify
from ..sources import readers
from ..sources.shared import checkpointed, merged


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with its doc_id as text, as streams have it."""
    return df.withColumn("doc_id", F.col("doc_id").cast("string"))


def fitting_names(records: DataFrame, fonts: DataFrame) -> DataFrame:
    """``records`` (of ``fabricate.record``) with holder and mother in a form that a font of the document shows."""

    @once
    @F.pandas_udf("struct<f_nome:string,f_nome_mae:string>")
    def fitted(nome: pd.Series, mae: pd.Series, f_nome: pd.Series, f_mae: pd.Series, cmaps: pd.Series) -> pd.DataFrame:
        out = []
        for n, m, fn, fm, own in zip(nome, mae, f_nome, f_mae, cmaps, strict=True):
            maps = [pdf.cmap(c) for c in (own if own is not None else [])]
            first = (n or "").split()[:1]
            holders = [f"{first[0].upper()} {s}" for s in fabricate.SURNAMES] if first else []
            out.append((pdf.compatible(n, fn, holders, maps), pdf.compatible(m, fm, fabricate.MOTHERS, maps)))
        return pd.DataFrame(out, columns=["f_nome", "f_nome_mae"])

    joined = records.join(merged(fonts), "doc_id", "left")
    joined = joined.withColumn("__f", fitted("nome", "nome_mae", "f_nome", "f_nome_mae", "cmaps"))
    return joined.withColumn("f_nome", F.col("__f.f_nome")).withColumn("f_nome_mae", F.col("__f.f_nome_mae")).drop("__f", "cmaps")


def rewritten(files: DataFrame, found: DataFrame, spec_rows: DataFrame, critical_only: bool = False) -> DataFrame:
    """``files`` (doc_id, content) under specs (doc_id, ord, id, label, pairs, verify): contents with their verdicts.

    ``found`` are the files' streams. The rewritten texts are searched for
    every original and its codes once more. With ``critical_only`` the shown
    text is searched too, its white space made one, and only critical labels
    fail a document, and process numbers stay whatever they hold. The content is null where it is withheld; a document of
    which nothing was to be replaced is ok if it was read.
    """
    fonts = readers.fonts(found)
    texts = found.filter(F.col("kind") == readers.TEXT).select("doc_id", "ord", "text").join(merged(fonts), "doc_id", "left")
    applied = checkpointed(pdf.apply_listed(texts, pdf.listed_specs(spec_rows), PROCESS.python if critical_only else None, critical_only))
    left = applied.select("doc_id", F.explode("left").alias("id")).distinct()
    bad = readers.unreadable(files, found)
    verdicts = verify.verdict(spec_rows, pdf.hit_counts(applied), left, bad)
    if critical_only:
        verdicts = verify.judicial_verdict(verdicts)
    out = pdf.rebuild_files(files, found, applied).join(merged(verdicts), "doc_id", "left").join(merged(bad.withColumn("unread", F.lit(True))), "doc_id", "left")
    ok = F.coalesce("ok", F.lit(True)) & F.col("unread").isNull()
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id", F.when(ok, F.col("content")).alias("content"), ok.alias("ok"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("applied", F.lit(0)).alias("applied"),
        F.coalesce("unreplaced", empty).alias("unreplaced"), F.coalesce("unmatched", empty).alias("unmatched"),
    )


def status(ok: Column, unreplaced: Column, notes: Column) -> Column:
    """What a user is told of a document."""
    return (
        F.when(~ok & (F.size(unreplaced) > 0), F.concat(F.lit("Falha segura: restaram dados no PDF ("), F.array_join(unreplaced, ", "), F.lit(")")))
        .when(~ok, "Falha segura: nenhuma substituição pôde ser confirmada")
        .when(notes != "", F.concat(F.lit("Concluído ("), notes, F.lit(")")))
        .otherwise("Anonimizado ✓")
    )


def admitted(files: DataFrame, mode: str) -> DataFrame:
    """(doc_id, path, content) of the files that the mode takes: PDF by name and first bytes, below its limit."""
    sized = files.withColumn("length", F.octet_length("content").cast("long")) if "length" not in files.columns else files
    return merged(_keyed(render.admission(sized, F.lit(mode)).filter(F.col("accepted") & readers.is_pdf(F.col("content")))))


def pages_of(files: DataFrame, by_lines: bool = False) -> DataFrame:
    """(doc_id, page, text) of the files' pages, from their bytes: whole, or line by line; a page that shows no text is empty."""
    items = readers.page_items(files)
    if not by_lines:
        return segment.page_text(items)
    text, every = segment.page_lines(items), items.filter("item < 0").select("doc_id", "page")
    return every.join(merged(text), ["doc_id", "page"], "left").withColumn("text", empty_if_null(F.col("text")))


def lines_of(files: DataFrame) -> DataFrame:
    """(doc_id, page, lines): the lines of the files' pages from the top down, from their bytes."""
    lines = segment.group_lines(readers.text_items(files))
    return lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).getField("text").alias("lines"))


def outline_of(files: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, ordinal, title, page) of the files' outlines; a destination that leads nowhere has a null page."""
    return readers.outline_entries(files)


def substitute(files: DataFrame, pages: DataFrame | None = None, lines: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Fictitious data for the sensitive record of each document.

    ``files`` is (doc_id, path, content), ``pages`` (doc_id, page, text),
    ``lines`` (doc_id, page, lines); without ``pages`` both are read from the
    files. Returns doc_id, name, content (null where withheld), ok, expected,
    applied, unreplaced, unmatched, status, and the fictitious name and CPF.
    """
    own = admitted(files, "cnis")
    if pages is None:
        pages, lines = pages_of(own), lines_of(own)
    record = extract.extract_record(_keyed(pages), None if lines is None else _keyed(lines))
    if lines is None:
        empty = F.array().cast("array<string>")
        record = record.withColumn("endereco_linhas", empty).withColumn("endereco_brutas", empty).withColumn("endereco", F.lit(""))
    found = checkpointed(readers.streams(own))
    made = checkpointed(specs.build(fitting_names(checkpointed(fabricate.record(record, seed)), readers.fonts(found))))
    rows = made.select("doc_id", F.posexplode("specs").alias("ord", "s")).select("doc_id", "ord", "s.*")
    out = rewritten(own, found, rows).join(made.select("doc_id", "tipo", "nome", "cpf", "nits", "nome_mae", "beneficio", "codigo", "endereco", "f_nome", "f_cpf").hint("merge"), "doc_id", "left")
    notes = F.coalesce(extract.observations(F.col("tipo")), F.lit(""))
    missed = F.when(F.size("unmatched") > 0, F.concat(F.lit("não confirmado: "), F.array_join("unmatched", ", ")))
    told = F.concat_ws("; ", F.when(notes != "", notes), missed)
    return out.select(
        "doc_id", render.output_name(F.col("nome"), F.lit(0), F.lit(1), F.col("tipo")).alias("name"), "content", "ok", "expected", "applied", "unreplaced", "unmatched",
        status(F.col("ok"), F.col("unreplaced"), told).alias("status"), "f_nome", "f_cpf",
    )


def findings_text(found: DataFrame) -> Column:
    """What was found, in words, from the counts of ``detect.findings`` and ``names``."""
    kinds = (("CPFs", "cpfs"), ("NITs", "nits"), ("OABs", "oabs"), ("CRMs", "crms"), ("Nomes", "names"), ("Endereços", "addresses"), ("IDs", "identifiers"))
    parts = F.concat_ws(" · ", *[F.when(found[c] > 0, F.concat(F.lit(f"{label}: "), found[c].cast("string"))) for label, c in kinds])
    kept = F.when(F.size(found["processes"]) > 0, F.concat(F.lit("\nProcesso preservado: "), F.array_join(found["processes"], ", "))).otherwise("")
    return F.concat(F.when(parts != "", F.concat(F.lit("Redatados: "), parts)).otherwise("Nenhum dado sensível encontrado"), kept)


def counted(docs: DataFrame, first_names: names.Names) -> DataFrame:
    """``docs`` (doc_id, text) with all findings, names too."""
    return names.count_names(detect.findings(docs), first_names)


def redact(files: DataFrame, pages: DataFrame | None, first_names: DataFrame) -> DataFrame:
    """Court files with every detected value masked in place.

    ``pages`` (doc_id, page, text) may be None: then they are read from the
    files. Returns doc_id, content (null where withheld), ok, expected, applied,
    unreplaced, unmatched, status and findings in words.
    """
    own = admitted(files, "processo-judicial")
    pages, known = pages_of(own) if pages is None else pages, names.dictionary(first_names)
    whole = _keyed(pages).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", squeeze(F.col("text")).alias("t")))).alias("all"))
    docs = whole.select("doc_id", F.array_join("all.t", "\n").alias("text"))
    found = checkpointed(names.map_and_count(docs, known).drop("text"))
    rows = found.select("doc_id", F.posexplode(specs.judicial(F.col("pairs"))).alias("ord", "s")).select("doc_id", "ord", "s.*")
    out = rewritten(own, checkpointed(readers.streams(own)), rows, critical_only=True)
    told = F.when(F.size("unmatched") > 0, F.concat(F.lit("não confirmado: "), F.array_join("unmatched", ", "))).otherwise("")
    out = out.withColumn("status", status(F.col("ok"), F.col("unreplaced"), told))
    return out.join(merged(found.select("doc_id", findings_text(found).alias("findings"))), "doc_id", "left")


Provider = Callable[[DataFrame], DataFrame]


def read_by_ocr(pages: DataFrame, enabled: bool, missing: str, provider: Provider | None) -> DataFrame:
    """Routed pages with the provider's texts: it gets (doc_id, page) and returns (doc_id, page, ocr_text).

    A blank reading counts as failed and leaves the page empty.
    """
    routed = segment.route_ocr(pages, enabled, missing, provider is not None)
    if not enabled or provider is None:
        return routed.withColumn("ocr", F.lit(False))
    read = provider(routed.filter(F.col("route") == "ocr").select("doc_id", "page"))
    got = F.coalesce(F.trim("ocr_text") != "", F.lit(False))
    out = routed.join(read.select("doc_id", "page", "ocr_text"), ["doc_id", "page"], "left")
    out = out.withColumn("text", F.when(got, F.col("ocr_text")).otherwise(F.col("text"))).withColumn("ocr", got)
    return out.withColumn("route", F.when((F.col("route") == "ocr") & ~got, "failed").otherwise(F.col("route"))).drop("ocr_text")


def anonymise(events: DataFrame, first_names: names.Names) -> tuple[DataFrame, DataFrame]:
    """Events with pages and titles redacted by their document's pairs, and a summary per document.

    ``events`` is what ``segment.assemble`` gives. Pairs are those of the
    document's whole text, applied longest first; omitted pages stay null. The
    summary counts replacements and findings before (``a_``) and after
    (``z_``), and what is left.
    """

    def whole(df: DataFrame) -> DataFrame:
        own = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.filter("page_texts", lambda t: t.isNotNull()).alias("t")))).alias("all"))
        return own.select("doc_id", F.array_join(F.flatten("all.t"), "\n").alias("text"))

    before = whole(events)
    kinds = [c for _, c in render.FINDINGS]
    mapped = checkpointed(names.map_and_count(before, first_names).select("doc_id", detect.by_length(F.col("pairs")).alias("pairs"), *[F.col(c).alias(f"a_{c}") for c in kinds]))
    out = events.join(merged(mapped.select("doc_id", "pairs")), "doc_id")
    title = squeeze(detect.apply_pairs(F.col("title"), F.col("pairs"), longest_first=False))
    pages = F.transform("page_texts", lambda t: F.when(t.isNotNull(), detect.apply_pairs(t, F.col("pairs"), longest_first=False)))
    out = out.withColumn("page_texts", pages).withColumn("title", F.when(title == "", F.col("title")).otherwise(title)).drop("pairs")
    out = checkpointed(segment.unique_filenames(out))
    after = counted(whole(out), first_names).select("doc_id", *[F.col(c).alias(f"z_{c}") for c in kinds])
    summary = mapped.withColumn("replacements", F.size("pairs").cast("long")).drop("pairs").join(merged(after), "doc_id")
    return out, summary.withColumn("residual", sum((F.col(f"z_{c}") for c in kinds), F.lit(0)).cast("long"))


def split(
    docs: DataFrame, pages: DataFrame, outline: DataFrame, first_names: DataFrame | None = None, enable_ocr: bool = True, missing: str = "placeholder", provider: Provider | None = None
) -> tuple[DataFrame, DataFrame]:
    """(outputs, summary) of court files: Markdown files by event, and one row per document.

    ``docs`` is (doc_id, name), ``pages`` (doc_id, page, text), ``outline``
    (doc_id, node_id, parent_id, ordinal, title, page). With ``first_names``
    the Markdown is anonymised. Outputs are (doc_id, path, content).
    """
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    scanned = segment.scan_pages(pages)
    tree = segment.flatten_outline(outline).filter(segment.is_event_title(F.col("title"))).select("doc_id", "ord", "title", F.col("page").cast("long").alias("page"))
    marks = scanned.filter(F.col("separator").isNotNull()).select("doc_id", (F.col("page") + (1 << 40)).alias("ord"), F.col("separator").alias("title"), F.col("page").cast("long").alias("page"))
    ranges = segment.event_ranges(tree.select("doc_id", F.col("ord").cast("long").alias("ord"), "title", "page").unionByName(marks), totals)
    lone = segment.single_events(docs.join(merged(totals), "doc_id"), ranges)
    cast = lambda df: df.select("doc_id", "title", "filename", *[F.col(c).cast("long").alias(c) for c in ("ord", "start", "end_excl", "start_label", "end_label", "page_count")])
    events = checkpointed(cast(ranges).unionByName(cast(lone)))
    read = read_by_ocr(scanned, enable_ocr, missing, provider)
    within = segment.event_pages(events).join(read.select("doc_id", F.col("page").cast("long").alias("page"), "route").hint("merge"), ["doc_id", "page"])
    of_route = lambda *r: F.count_if(F.col("route").isin(*r))
    counts = within.groupBy("doc_id").agg(of_route("ocr").alias("ocr_count"), of_route("failed").alias("ocr_failed"), of_route("skipped", "omitted").alias("ocr_skipped"), of_route("omitted").alias("omitted"))
    own = checkpointed(segment.unique_filenames(segment.assemble(events, read.select("doc_id", F.col("page").cast("long").alias("page"), "text", "ocr"))))
    process = extract.infer_process(docs, own, read)
    report = None
    summary = own.groupBy("doc_id").agg(F.count("*").alias("pieces")).join(merged(process), "doc_id").join(merged(counts), "doc_id", "left").withColumn("ocr_enabled", F.lit(enable_ocr))
    if first_names is not None:
        own, redacted = anonymise(own, names.dictionary(first_names))
        summary = summary.join(merged(redacted), "doc_id")
        report = render.report_markdown(summary)
    named = render.zip_name(F.col("process"), F.lit(first_names is not None))
    return render.outputs(own, process, report), summary.withColumn("zip", named)


def split_files(files: DataFrame, first_names: DataFrame | None = None, enable_ocr: bool = True, missing: str = "placeholder", provider: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """``split`` of files (doc_id, path, content) alone: pages and outlines are read from their bytes.

    A document is one file, named as a PDF in any case, within the mode's
    limit; others are left out.
    """
    one = readers.one_pdf_each(files).filter("accepted").drop("accepted")
    own = admitted(one.withColumn("path", F.regexp_replace("path", r"(?i)\.pdf\z", ".pdf")), "extrair-pecas")
    docs = own.select("doc_id", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"))
    return split(docs, pages_of(own, by_lines=True), outline_of(own), first_names, enable_ocr, missing, provider)


def zipped(outputs: DataFrame) -> DataFrame:
    """(doc_id, content): each document's outputs as one ZIP file, written in the order index, report, whole, events."""
    import io
    import zipfile

    rank = F.when(F.col("path") == "indice.md", 0).when(F.col("path") == "relatorio_anonimizacao.md", 1).when(F.col("path") == "integral.md", 2).otherwise(3)
    listed = outputs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "path", empty_if_null(F.col("content")).alias("content")))).alias("all"))

    @once
    @F.pandas_udf("binary")
    def packed(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for names_, texts in zip(paths, contents, strict=True):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in zip(names_, texts, strict=True):
                    z.writestr(zipfile.ZipInfo(name), text)
            out.append(buffer.getvalue())
        return pd.Series(out, dtype=object)

    return listed.select("doc_id", packed("all.path", "all.content").alias("content"))

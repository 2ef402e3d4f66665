"""Layout and segmentation: text items to lines and pages, outlines to events.

Documents are told apart by ``doc_id``; every shuffle is by it, so a document
is the unit and nothing is ordered across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_title, empty_if_null, is_event_title, matches, needs_ocr, sanitize_filename, squeeze, strip_separator_noise
from ..sources.shared import Scratch, checkpointed, merged, scratch

#: A line starts where the vertical step is above this.
LINE_STEP = 8.0
#: Nodes of an outline that a task of a round gets, whatever the number of shuffle partitions.
NODES = 100_000


def page_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): all items of a page in order, joined by blanks."""
    g = items.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("item", empty_if_null(F.col("str")).alias("str")))).alias("all"))
    return g.select("doc_id", "page", squeeze(F.array_join(F.col("all.str"), " ")).alias("text"))


def page_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): items joined to lines, a new one at an end mark or a step of more than LINE_STEP.

    Items within a line are parted by one blank unless one is there already;
    blank lines fall away. Empty items have no effect.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("item")
    kept = items.filter(empty_if_null(F.col("str")) != "")
    step = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) > LINE_STEP, F.lit(False))
    line = F.sum(F.when(F.coalesce("has_eol", F.lit(False)) | step, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lines = kept.withColumn("line", line).groupBy("doc_id", "page", "line").agg(F.sort_array(F.collect_list(F.struct("item", "str"))).alias("all"))
    join = F.aggregate("all", F.lit(""), lambda t, x: F.concat(t, F.when((t != "") & ~F.endswith(t, F.lit(" ")) & ~F.startswith(x["str"], F.lit(" ")), " ").otherwise(""), x["str"]))
    lines = lines.select("doc_id", "page", "line", F.trim(join).alias("text")).filter("text <> ''")
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line", "text"))).getField("text"), "\n").alias("text"))


def group_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text): items of one height, left to right; lines from the top down."""
    own = items.select("doc_id", "page", F.round(F.coalesce("y", F.lit(0.0)), 2).alias("h"), F.coalesce("x", F.lit(0.0)).alias("x"), "item", squeeze(F.col("str")).alias("str"))
    g = own.filter("str <> ''").groupBy("doc_id", "page", "h").agg(F.sort_array(F.collect_list(F.struct("x", "item", "str"))).alias("all"))
    g = g.select("doc_id", "page", "h", squeeze(F.array_join(F.col("all.str"), " ")).alias("text"))
    line = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("h").desc())) - 1
    return g.select("doc_id", "page", line.alias("line_no"), "text")


def separator_title(text: Column) -> Column:
    """The event title of a separator page, or null."""
    t = squeeze(text)
    numbers = F.regexp_extract_all(t, F.lit(r"(?iu)(?<![A-Za-z0-9_])Evento\s+([0-9]+)(?![A-Za-z0-9_])"), F.lit(1))
    raw = F.regexp_extract(t, r"(?iu)(?<![A-Za-z0-9_])Sequência Evento:\s*(.+?)\s+[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}", 1)
    number = F.try_element_at(numbers, F.lit(-1))
    named = strip_separator_noise(raw)
    ok = F.contains(t, F.lit("PÁGINA DE SEPARAÇÃO")) & t.rlike("(?iu)Sequência Evento:") & ~matches(t, r"(?i)\bTipo documento:\b") & ~matches(t, r"(?i)\bDocumento\s+[0-9]+\b")
    return F.when(ok & number.isNotNull(), F.concat(F.lit("Evento. "), number, F.lit(" - "), F.when(named == "", F.concat(F.lit("Evento "), number)).otherwise(named)))


def scan_pages(pages: DataFrame) -> DataFrame:
    """One pass over pages: normalised text, needs_ocr and separator title."""
    sep = separator_title(F.col("text"))
    return pages.withColumn("separator", sep).withColumn("needs_ocr", sep.isNull() & needs_ocr(F.col("text"))).withColumn("text", squeeze(F.col("text")))


def resolve_outline(outline: DataFrame, named: DataFrame, references: DataFrame) -> DataFrame:
    """``outline`` with ``page``: a named destination gives a reference, a reference a page; what leads nowhere is null.

    ``outline`` has dest_name and dest_ref, ``named`` is (doc_id, dest_name,
    ref), ``references`` (doc_id, ref, page).
    """
    by_name = named.select("doc_id", "dest_name", F.col("ref").alias("__named"))
    out = outline.join(by_name, ["doc_id", "dest_name"], "left").withColumn("ref", F.coalesce("dest_ref", "__named"))
    return out.join(references.select("doc_id", "ref", "page"), ["doc_id", "ref"], "left").drop("ref", "__named")


def _upward(nodes: DataFrame, more: list[str], tasks: int) -> DataFrame:
    """``nodes`` (doc_id, node_id, up, lost, ...) with what stands at ``up`` beside it: ``next``, ``up_lost`` and the columns ``more`` with a mark."""
    above = nodes.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("lost").alias("up_lost"), *[F.col(c).alias(f"up_{c}") for c in more])
    return nodes.repartition(tasks, "doc_id", "up").join(above.repartition(tasks, "doc_id", "up"), ["doc_id", "up"], "left")


def _lost() -> Column:
    return F.col("lost") | (F.col("up").isNotNull() & F.coalesce("up_lost", F.lit(True)))


def flatten_outline(outline: DataFrame) -> DataFrame:
    """(doc_id, ord, title, page): the outline's nodes in pre-order, from (doc_id, node_id, parent_id, ordinal, title, page).

    By pointer doubling over the parents: each round looks twice as far up, so
    there are as many rounds as the depth has binary digits, whatever the
    number of nodes. Sizes of subtrees come first; a node then stands behind
    its parent and its earlier siblings' subtrees, and these steps are summed
    upwards. Nodes whose parent is missing, and those in or under a ring of
    parents, belong to no tree and fall away; of rows of one node the smallest
    counts, and siblings of one ordinal are ordered by their numbers.
    """
    with scratch(outline.sparkSession, "outline") as keep:
        return checkpointed(_flattened(outline, keep))


def _flattened(outline: DataFrame, keep: Scratch) -> DataFrame:
    own = F.min(F.struct("parent_id", "ordinal", "title", "page")).alias("own")
    rows = keep(outline.groupBy("doc_id", "node_id").agg(own).select("doc_id", "node_id", "own.*"), "rows")
    most, total = (x or 0 for x in rows.groupBy("doc_id").count().agg(F.max("count"), F.sum("count")).first())
    # A task's memory must not grow with the table: the number of tasks does.
    tasks, node = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // NODES)), ["doc_id", "node_id"]
    now = rows.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.lit(False).alias("lost"), F.lit(1).cast("long").alias("size"))
    for n in range(most.bit_length() + 1):
        below = now.filter("up IS NOT NULL AND NOT lost").select("doc_id", F.col("up").alias("node_id"), "size").repartition(tasks, *node).groupBy(node).agg(F.sum("size").alias("below"))
        met = _upward(now, [], tasks).withColumn("lost", _lost()).repartition(tasks, *node).join(below, node, "left")
        now = keep(met.select("doc_id", "node_id", F.when(~F.col("lost"), F.col("next")).alias("up"), "lost", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), f"size-{n}")
        if not now.filter("up IS NOT NULL").limit(1).count():
            break
    # What still has a way up after so many rounds never comes to a root.
    good = rows.drop("title", "page").repartition(tasks, *node).join(now.filter("up IS NULL AND NOT lost").select(*node, "size").repartition(tasks, *node), node)
    before = F.sum("size").over(Window.partitionBy("doc_id", "parent_id").orderBy("ordinal", "node_id").rowsBetween(Window.unboundedPreceding, -1))
    step = F.coalesce(before, F.lit(0)) + F.col("parent_id").isNotNull().cast("long")
    good = good.repartition(tasks, "doc_id", "parent_id")
    now, n = keep(good.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.lit(False).alias("lost"), step.alias("at")), "at-0"), 0
    while now.filter("up IS NOT NULL").limit(1).count():
        n += 1
        now = keep(_upward(now, ["at"], tasks).select("doc_id", "node_id", F.col("next").alias("up"), "lost", (F.col("at") + F.coalesce("up_at", F.lit(0))).alias("at")), f"at-{n}")
    return rows.repartition(tasks, *node).join(now.repartition(tasks, *node), node).select("doc_id", F.col("at").cast("int").alias("ord"), "title", "page")


def event_ranges(items: DataFrame, totals: DataFrame, only_event_titles: bool = False) -> DataFrame:
    """Events of each document from (doc_id, ord, title, page): see the columns below.

    Items without a page go, the first of each page stays, an event ends where
    the next starts or at the document's ``total`` pages.
    """
    rows = items.filter(F.col("page").isNotNull())
    if only_event_titles:
        rows = rows.filter(is_event_title(F.col("title")))
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    rows = rows.withColumn("rn", first).filter("rn = 1").join(totals, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("page")
    end = F.coalesce(F.lead("page").over(w), F.col("total"))
    rows = rows.withColumn("end_excl", end).withColumn("ord", F.row_number().over(w) - 1)
    return rows.select(
        "doc_id", "ord", "title", F.concat(sanitize_filename(F.col("title")), F.lit(".md")).alias("filename"), F.col("page").alias("start"), "end_excl",
        (F.col("page") + 1).alias("start_label"), F.col("end_excl").alias("end_label"), (F.col("end_excl") - F.col("page")).alias("page_count"),
    )


def single_events(docs: DataFrame, events: DataFrame) -> DataFrame:
    """One event over the whole of each document (doc_id, name, total) that has none."""
    lone = docs.join(events.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("title", document_title(F.col("name")))
    return lone.select(
        "doc_id", F.lit(0).alias("ord"), "title", F.concat(sanitize_filename(F.col("title")), F.lit(".md")).alias("filename"), F.lit(0).alias("start"),
        F.col("total").alias("end_excl"), F.lit(1).alias("start_label"), F.col("total").alias("end_label"), F.col("total").alias("page_count"),
    )


def event_pages(events: DataFrame) -> DataFrame:
    """(doc_id, ord, page): the pages of every event; an empty range has none."""
    return events.filter("end_excl > start").select("doc_id", "ord", F.explode(F.expr("sequence(start, end_excl - 1)")).alias("page"))


def assemble(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Events with their pages' texts in order and an OCR mark if any page was read by OCR."""
    keyed = event_pages(events).join(merged(pages), ["doc_id", "page"], "left")
    texts = keyed.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"), F.coalesce(F.bool_or("ocr"), F.lit(False)).alias("ocr"))
    return events.join(merged(texts), ["doc_id", "ord"], "left").withColumn("page_texts", F.col("pages.text")).withColumn("ocr", F.coalesce("ocr", F.lit(False))).drop("pages")


def uncovered_pages(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that are in no event: those before the first start."""
    return pages.join(event_pages(events).select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def unique_filenames(events: DataFrame) -> DataFrame:
    """``events`` with filenames told apart by _2, _3, ... in event order."""
    base = F.regexp_replace(sanitize_filename(F.col("title")), r"(?i)\.md\z", "")
    base = F.when(base == "", "evento_sem_nome").otherwise(base)
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ord"))
    return events.withColumn("base", base).withColumn("n", n).withColumn("filename", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".md"))).drop("base", "n")


def route_ocr(pages: DataFrame, enabled: bool = True, mode: str = "placeholder", engine: bool = True) -> DataFrame:
    """``pages`` with a route: text, ocr, failed, skipped or omitted, and the text that follows from it.

    With OCR off, pages that need it become empty, or null in mode ``omit``.
    """
    need = F.col("needs_ocr")
    route = F.when(~need, "text")
    if not enabled:
        route = route.otherwise("omitted" if mode == "omit" else "skipped")
    else:
        route = route.otherwise("ocr" if engine else "failed")
    text = F.when(F.col("route") == "omitted", F.lit(None).cast("string")).when(F.col("route").isin("skipped", "failed", "ocr"), "").otherwise(F.col("text"))
    return pages.withColumn("route", route).withColumn("text", text)



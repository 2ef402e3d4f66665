"""The file sink, deliveries, ingestion of arriving files, and the table function."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sigilo.operators import detect
from sigilo.plans import modes
from sigilo.sources import readers, sink

from . import pdf_maker as make


def below(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def test_files_are_written_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"d{k % 3}/f{k}.md", f"text {k}".encode() * k) for k in range(40)] + [("withheld", None), (None, b"x")], "path string, content binary").repartition(5)
    sink.write_files(df, out)
    assert below(out) == {f"d{k % 3}/f{k}.md": f"text {k}".encode() * k for k in range(40)}
    sink.write_files(spark.createDataFrame([("../up/./a.pdf", b"1")], "path string, content binary"), "file://" + out)  # appended, never above the folder
    assert below(out)["up/a.pdf"] == b"1" and len(below(out)) == 41
    sink.write_files(spark.createDataFrame([("b", b"2")], "path string, content binary"), out, overwrite=True)
    assert below(out) == {"b": b"2"}
    sink.write_files(df.limit(0), str(tmp_path / "none"))
    assert below(tmp_path / "none") == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")

    @F.udf("binary")
    def late(k):
        if k == 37:
            raise RuntimeError("lost")
        return b"x"

    df = spark.range(60).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), late("id").alias("content"))
    with pytest.raises(Exception, match="lost"):
        sink.write_files(df, out)
    assert below(out) == {} and not os.path.exists(out) or os.listdir(out) == []
    with pytest.raises(Exception, match="path and content"):
        spark.range(1).write.format("files").mode("append").option("path", out).save()


def test_an_attempt_that_is_repeated_counts_once(tmp_path):
    writer = sink.FilesWriter(str(tmp_path), False)
    rows = lambda v: iter([{"path": "a/f", "content": v}])
    writer.write(rows(b"first attempt, lost"))
    writer.commit([writer.write(rows(b"second")), None])
    assert below(tmp_path) == {"a/f": b"second"}
    other = sink.FilesWriter(str(tmp_path), False)
    other.abort([other.write(rows(b"third"))])
    other.abort([None])
    assert below(tmp_path) == {"a/f": b"second"}


def test_one_result_is_bare_and_several_are_packed(spark):
    rows = [("u1", "a.pdf", b"1"), ("u2", "b.pdf", b"2"), ("u2", "c.pdf", b"3"), ("u2", "b.pdf", b"4"), ("u3", "d.pdf", None), ("u4", "e.pdf", b"5"), ("u4", "f.pdf", None)]
    out = {r.path: bytes(r.content) for r in sink.delivered(spark.createDataFrame(rows, "user string, name string, content binary"), "user", "lote.zip").collect()}
    assert set(out) == {"u1/a.pdf", "u2/lote.zip", "u4/e.pdf"} and out["u1/a.pdf"] == b"1" and out["u4/e.pdf"] == b"5"
    packed = zipfile.ZipFile(io.BytesIO(out["u2/lote.zip"]))
    assert {n: packed.read(n) for n in packed.namelist()} == {"b.pdf": b"2", "b_2.pdf": b"4", "c.pdf": b"3"}


def test_arriving_files_run_through_a_mode_once(spark, tmp_path):
    """Stopped and started again, with a batch that fails on the way: each file's result stands once."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.mkdir(source)
    put = lambda n: open(f"{source}/{n}.pdf", "wb").write(make.document([[(f"CPF 111.444.777-35 do arquivo {n} com texto longo", 40, 700)]]))
    names = spark.createDataFrame([("zulmiro",)], "name string")
    fail = {"now": False}

    def job(batch):
        files = batch.select(F.regexp_extract("path", r"([^/]+)\.pdf\z", 1).alias("doc_id"), "path", "content")
        out = modes.redact(files, None, names).select("doc_id", "ok", "content")
        if fail["now"]:
            out = out.filter(F.raise_error(F.lit("lost")).isNull())
        return out

    def run():
        q = sink.ingest(spark, readers.stream_files(spark, source), job, target, checkpoint)
        q.awaitTermination(180)
        return q

    put("a"), put("b")
    assert run().exception() is None
    put("c")
    fail["now"] = True
    with pytest.raises(Exception, match="lost"):
        run()
    fail["now"] = False
    assert run().exception() is None and run().exception() is None  # the failed batch again, then nothing
    got = spark.read.parquet(target).collect()
    assert sorted((r.doc_id, r.ok) for r in got) == [("a", True), ("b", True), ("c", True)]
    assert all(b"111.444" not in bytes(r.content) for r in got)


def test_pairs_by_table_function(spark):
    detect.register_emit_pairs(spark)
    rows = [(1, 0, "CPF 111.444.777-35 e ana@exemplo.org"), (1, 1, "ana@exemplo.org e bia@exemplo.org"), (2, 0, "ana@exemplo.org"), (2, 1, None), (3, 0, "")]
    v = spark.createDataFrame(rows, "doc_id long, page long, text string")
    sql = "SELECT doc_id, page, o, s FROM emit_pairs(TABLE(SELECT * FROM {v}) PARTITION BY doc_id ORDER BY page)"
    got = {tuple(r) for r in spark.sql(sql, v=v).collect()}
    assert got == {(1, 0, "111.444.777-35", "***.***.***-**"), (1, 0, "ana@exemplo.org", "*" * 15), (1, 1, "bia@exemplo.org", "*" * 15), (2, 0, "ana@exemplo.org", "*" * 15)}

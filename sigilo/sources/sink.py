"""A sink of files: each row of (path, content) becomes one file below a folder, all of a job's or none.

    df.write.format("files").mode("append").option("path", "hdfs://host/out").save()

Tasks write into a folder of their own attempt; when all tasks have ended, the
driver moves the files of the attempts that count to their places, and what a
failed or repeated attempt wrote goes. A file stands at its place whole or not
at all, and a job that fails leaves nothing.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of a path and the path within it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def safe(name: str) -> str:
    """A relative path without steps upwards."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    if not parts or parts[0].startswith("_pending-"):
        raise ValueError(f"no file can be called {name!r}")
    return "/".join(parts)


@dataclass
class Attempt(WriterCommitMessage):
    """Where an attempt's files stand; their names stay in that folder."""

    folder: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        store, root = opened(self.path)
        folder = f"{root}/{self.pending}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        n = 0
        for row in iterator:
            if row["path"] is None or row["content"] is None:
                continue  # withheld
            name = safe(row["path"])
            if "/" in name:
                store.create_dir(f"{folder}/{name.rpartition('/')[0]}", recursive=True)
            content = row["content"]
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = opened(self.path)
        if self.overwrite:
            for old in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
                if not old.base_name.startswith("_pending-"):
                    store.delete_dir(old.path) if old.type == arrow_fs.FileType.Directory else store.delete_file(old.path)
        made: set[str] = set()
        for message in filter(None, messages):
            for f in store.get_file_info(arrow_fs.FileSelector(message.folder, recursive=True, allow_not_found=True)):
                if f.type == arrow_fs.FileType.File:
                    target = root + f.path[len(message.folder) :]
                    parent = target.rpartition("/")[0]
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    store.move(f.path, target)
        store.delete_dir(f"{root}/{self.pending}")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.pending}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.pending}")


class Files(DataSource):
    """The data source ``files``: option ``path``, columns ``path`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("files are written from columns path and content")
        if not self.options.get("path"):
            raise ValueError("option path must name a folder")
        return FilesWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes (path, content) as files below a folder in a store that driver and executors share."""
    df.sparkSession.dataSource.register(Files)
    df.select("path", "content").write.format("files").mode("overwrite" if overwrite else "append").option("path", path).save()


def zip_of(names: list[str], contents: list[bytes]) -> bytes:
    """A ZIP file; of equal names all but the first are told apart by _2, _3, ... before their endings."""
    buffer, seen = io.BytesIO(), set()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in zip(names, contents, strict=True):
            stem, dot, ending = name.rpartition(".")
            own, k = name, 2
            while own in seen:
                own, k = f"{stem}_{k}.{ending}" if dot else f"{name}_{k}", k + 1
            seen.add(own)
            z.writestr(zipfile.ZipInfo(own), content)
    return buffer.getvalue()


def delivered(results: DataFrame, batch: str, zip_name: Column | str) -> DataFrame:
    """(path, content) of what users get for ``results`` (name, content, and the column ``batch``).

    One result of a batch is a file as it is, several are a ZIP in the order of
    their names; results without content, which are withheld, are in neither,
    and a batch of these alone gives nothing. A batch is one user's selection;
    files stand in a folder of its name.
    """
    good = results.filter(F.col("content").isNotNull() & F.col("name").isNotNull())
    label = zip_name if isinstance(zip_name, Column) else F.lit(zip_name)
    listed = good.groupBy(F.col(batch).cast("string").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("all"), F.first(label).alias("zip"))

    @F.pandas_udf("binary")
    def packed(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([zip_of(list(n), list(c)) if len(n) > 1 else bytes(c[0]) for n, c in zip(names, contents, strict=True)], dtype=object)

    several = F.size("all") > 1
    return listed.select(F.concat("batch", F.lit("/"), F.when(several, F.col("zip")).otherwise(F.col("all")[0]["name"])).alias("path"), packed("all.name", "all.content").alias("content"))


def ingest(spark: SparkSession, arriving: DataFrame, job, target: str, checkpoint: str, trigger: dict | None = None):  # noqa: ANN001, ANN201
    """A query that runs ``job`` on every micro-batch of ``arriving`` and keeps its rows as Parquet below ``target``.

    A batch's rows stand in a folder of its number, which is replaced when the
    batch is run again after a failure: nothing is written twice. ``job`` gets
    and returns a DataFrame; ``trigger`` is Spark's, by default all that is
    there and then the end.
    """

    def keep(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Corpus pipeline: five stages over ``documents``, each by one operator of ``sigilo.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet to the shared folder and rereads as the next one's
docs. All stages but the last return the columns of ``documents``, and extra
columns of any name pass through. A row is known by its id and text, so null
ids and several texts of one id are rows like others. An empty table stays
empty throughout; whole texts are read, however long.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilo.llm import exact_dedup, language_id, packing, secrets, simhash
from sigilo.llm.common import checkpointed, fresh, place_of, removed, shared_folder

TOKENIZER = "word_bpe_49k.json"


def rows_that_stay(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose 128 hash bits of id and text are in ``stay`` (place, copies), each once."""
    mark = fresh("place", docs.columns)
    stay, keyed = checkpointed(stay), docs.withColumn(mark, place_of("doc_id", "text"))
    out = keyed.join(stay.filter("copies = 1").select(F.col("place").alias(mark)), mark, "left_semi")
    again = stay.filter("copies > 1").select(F.col("place").alias(mark))
    if again.limit(1).count():  # rows that are repeated as a whole, id and all
        out = out.unionByName(keyed.join(again, mark, "left_semi").dropDuplicates([mark]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter and those far from every language's centroids go.

    Null and empty texts have no letter and go. Repeated rows and ties get one
    judgement and so stay or go together.
    """
    model = language_id.train(docs)
    names = tuple(fresh(n, docs.columns) for n in ("lang_pred", "score", "rejected"))
    judged = language_id.predict(docs, model, names=names)
    return judged.filter(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts one row stays, the longest original, then of the smallest id.

    Null texts are equal to empty ones. A null id stays only where the longest
    originals have no other; of rows repeated as a whole one stays.
    """
    return rows_that_stay(docs, exact_dedup.survivors(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each group linked by five-word similarities of 0.8 or more the row of the smallest id stays.

    Texts without a word, null ones too, are one group. Null ids come last; of
    rows repeated as a whole one stays.
    """
    found = simhash.near_texts(docs).filter("stays")
    return rows_that_stay(docs, found.groupBy("place").agg(F.count("*").alias("copies")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: live-looking values are masked in place; documents stay.

    Null and empty texts hold no value; equal texts are masked alike, so that
    repeated rows and ties stay equal, whatever their ids.
    """
    return secrets.redact(docs, secrets.secret_scan(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of every document that is left.

    Null and empty texts are the end token alone; repeated rows and null ids
    are documents of their own; a very long text lies in several windows.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]

#: The trained, near-copy and tokenizer stages are beyond SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; a stage's rows are deleted when its successor's are written."""
    docs, place = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            removed(spark, f"{place}/{k - 1}")
    return docs

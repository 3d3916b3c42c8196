"""A corpus from raw documents to packed sequences: select, drop near copies, cut repeated passages, pack.

Stages hand each other tables with the columns of ``documents``, written as Parquet between them. The operators carry a
row's other columns along, so a null doc_id is an id like any other, and rows that share one stay apart. Every stage
gives an empty table for an empty one; null and empty texts are kept by all stages but of rows equal to each other the
second one keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm.common import stored
from coursemill.llm.jaccard_join import jaccard_join
from coursemill.llm.packing import pack
from coursemill.llm.quality import quality_sample
from coursemill.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws towards the good ones.

    Each row is drawn for itself, those with a null doc_id like others. Rows that share a doc_id share its noise.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_sample(docs, labels, carry=COLUMNS[1:]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each class of near-duplicates.

    Texts under one doc_id, or under none, are compared like any others; a null doc_id is larger than all. Of rows equal
    in doc_id and text one stays, also of those without a text.
    """
    docs = docs.withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"))
    classes = jaccard_join(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = docs.select("row", "doc_id").distinct().join(classes, "row").groupBy("class_id").agg(F.min(order).alias("first")).select("first.row")
    number = F.row_number().over(Window.partitionBy("row").orderBy("lang", "source", "n_chars"))
    return docs.join(first, "row").withColumn("number", number).where("number = 1").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that occurred earlier; a character that loses one of its bytes goes whole.

    Each row gives a row. A null doc_id is later than all others; rows that share a doc_id, null too, are not earlier
    than each other, and each keeps its own text.
    """
    kept = suffix_dedup(docs, carry=("lang", "source")).select("doc_id", "kept", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(b or b"").decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source")], names=["doc_id", "text", "lang", "source"])

    texts = kept.mapInArrow(run, "doc_id long, text string, lang string, source string")
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; rows that share a doc_id are packed each for itself."""
    return pack(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # the stages sample, hash and tokenize; tests compare them with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

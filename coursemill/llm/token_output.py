"""Token ids as Parquet list columns that can be read in part.

Rows are in ascending doc_id order within and across files. The list column of ids is dictionary coded
(a vocabulary under 2**16 needs two bytes an id), counts and ids of documents are delta coded; row groups and pages
have a set size and pages carry an index, so a reader of some documents or of the counts alone reads little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm.common import block_count, short_batches, text_bytes, work_dir
from coursemill.llm.tokens import LibraryWords, cache, default_tokenizer, encode_texts, in_steps

END_ID = 2
OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.writer.version": "v2",
    "parquet.column.index.access": "true",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write doc_id, n_tokens and ids (list of int, the end id last) of every document.

    docs: doc_id, text; more columns are ignored. Null text has the end id alone. A null doc_id comes first. Rows
    that share a doc_id are all written. An empty table writes a file without rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)
    parts = block_count(docs.sparkSession, text_bytes(docs), 32 << 20)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache(LibraryWords, tokenizer)
        for batch in batches:
            for part in in_steps(batch, encoding=True):
                ids, offsets = encode_texts(part.column("text"), words)
                n = np.diff(offsets) + 1
                out = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(out))], names=["doc_id", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The written documents, only the named columns."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(*columns)


def located(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """read_tokens with each row's file and place in it."""
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(*columns, *where)


def with_starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before a row: files' sums in order (a row a file), then sums within a file."""
    files = counts.groupBy("file").agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "file").withColumn("start", F.col("before") + inside).drop("file", "row", "before")


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, start of every document, from the counts alone (the column of ids is not read)."""
    counts = located(spark, path, ("doc_id", "n_tokens"))
    return with_starts(counts, counts)


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ids with ids_crc32: CRC-32 of the ids as little-endian unsigned 32-bit numbers; other columns stay."""
    names = [c for c in tokens.columns if c != "ids"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    return tokens.mapInArrow(check, tokens.drop("ids").withColumn("ids_crc32", F.lit(0).cast("long")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    rows = checksums(located(spark, path, ("doc_id", "n_tokens", "ids")))
    return with_starts(rows, located(spark, path, ("doc_id", "n_tokens"))).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

Every shingle (five words) whose hash lies below a fixed fraction of the hash range is kept, so a sketch grows with
its document, sketches of parts merge by union, and the share of one sketch that lies in another estimates
containment even between very unequal documents. A hash is the first 64 bits of MD5, as 16 hexadecimal digits; the
fraction is one eighth: those below "2".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm.common import block_count, text_bytes

WORDS = 5
BELOW = "2"
_LEAST = -(1 << 63)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\t-\r ]+"), lambda w: w != "")


def sketch_of(words: Column) -> Column:
    """Sorted distinct hashes below the threshold. A text of one to four words is one shingle; one of none has no sketch."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(words, i, F.lit(WORDS)), " ")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(hashes, lambda h: h < BELOW), lambda h: F.substring(h, 1, 16))))


def with_sketch(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketch of a text column. The words are a column of their own, so that they are split once a row."""
    return docs.withColumn("_words", words_of(F.col(text))).withColumn(name, sketch_of(F.col("_words"))).drop("_words")


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Jaccard estimate of two sketches; two empty ones are alike (1) if the texts are the ``same``, else 0."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both > 0, common / both).otherwise(F.when(same, F.lit(1.0)).otherwise(F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """Sketch of the union of each key's documents."""
    return sketches.select(*keys, F.explode_outer(sketch).alias("_h")).groupBy(*keys).agg(F.array_sort(F.collect_set("_h")).alias(sketch))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, sketch of every row; more columns are ignored. Rows that share a doc_id each give a row."""
    return with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch").select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with next_text and next_sketch of the next smaller doc_id; after the last comes the first.

    Rows are dealt to ranges of doc_id; each range also gets the first row of the range after it, so one
    shuffle of the texts is enough and no range needs another. Equal doc_ids are in order of their text; a
    null doc_id comes last.
    """
    spark = docs.sparkSession
    n = block_count(spark, text_bytes(docs), 16 << 20)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LEAST)).alias("key"))
    cuts = sorted(set(docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []))
    ranges = docs.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c < F.col("key"))))
    tops = ranges.groupBy("range").agg(F.max("key").alias("top"))
    order = Window.orderBy("range")
    ring = tops.select(F.col("range").alias("to"), F.coalesce(F.lag("top").over(order), F.max("top").over(Window.partitionBy())).alias("from"))
    borrowed = docs.join(F.broadcast(ring), F.col("key") == F.col("from"))  # ring: a row a range
    borrowed = borrowed.groupBy("to").agg(F.min("text").alias("text"))
    rows = ranges.select("doc_id", "text", "key", "range", F.lit(False).alias("extra"))
    rows = rows.unionAll(borrowed.select(F.lit(None).cast("long"), "text", F.lit(_LEAST), F.col("to"), F.lit(True)))
    rows = with_sketch(rows.repartition(n, "range"), "text", "sketch")
    after = Window.partitionBy("range").orderBy("extra", F.desc("key"), "text")
    return rows.withColumns({"next_text": F.lead("text").over(after), "next_sketch": F.lead("sketch").over(after)}).where("not extra").drop("extra", "range", "key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
w AS (SELECT *, list_filter(string_split_regex(text, '[\t-\r ]+'), lambda x: x <> '') AS w0, list_filter(string_split_regex(next_text, '[\t-\r ]+'), lambda x: x <> '') AS w1, list_filter(string_split_regex(edited, '[\t-\r ]+'), lambda x: x <> '') AS w2 FROM e),
s AS (SELECT *,
  list_sort(list_distinct(list_transform(list_filter(list_transform(range(1, CASE WHEN len(w0) = 0 THEN 1 ELSE greatest(len(w0) - 4, 1) + 1 END), lambda i: md5(array_to_string(w0[i : i + 4], ' '))), lambda h: h < '2'), lambda h: h[1:16]))) AS s0,
  list_sort(list_distinct(list_transform(list_filter(list_transform(range(1, CASE WHEN len(w1) = 0 THEN 1 ELSE greatest(len(w1) - 4, 1) + 1 END), lambda i: md5(array_to_string(w1[i : i + 4], ' '))), lambda h: h < '2'), lambda h: h[1:16]))) AS s1,
  list_sort(list_distinct(list_transform(list_filter(list_transform(range(1, CASE WHEN len(w2) = 0 THEN 1 ELSE greatest(len(w2) - 4, 1) + 1 END), lambda i: md5(array_to_string(w2[i : i + 4], ' '))), lambda h: h < '2'), lambda h: h[1:16]))) AS s2 FROM w),
c AS (SELECT *, len(list_intersect(s0, s2)) AS c2, len(list_intersect(s0, s1)) AS c1 FROM s)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(s0, ',') AS fingerprint, array_to_string(s2, ',') AS edited_fingerprint,
  CASE WHEN len(s0) + len(s2) - c2 > 0 THEN c2::DOUBLE / (len(s0) + len(s2) - c2) WHEN text = edited THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_edited,
  CASE WHEN len(s0) + len(s1) - c1 > 0 THEN c1::DOUBLE / (len(s0) + len(s1) - c1) WHEN text = next_text THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_next
FROM c
"""

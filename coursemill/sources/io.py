"""Readers and writers: golden sets, captions, stage output, COCO boxes, page regions, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.functions.text import caption_words, parse_timestamp
from coursemill.operators.scans import running, sliced

GOLDEN = "lecture_id string, duration_s double, questions array<struct<id: string, kind: string, question: string, answer: string, spans: array<array<string>>>>"
COCO = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, area: double>>, categories array<struct<id: int, name: string>>"
REGIONS = "pdf string, pages array<struct<page: int, regions: array<struct<label: string, box: array<double>>>>>"
CUE = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their spans in seconds."""
    q = spark.read.schema(GOLDEN).json(path, multiLine=True).select("lecture_id", "duration_s", F.explode("questions").alias("q"))
    spans = F.transform(F.coalesce("q.spans", F.array()), lambda s: F.struct(parse_timestamp(s[0]).alias("start_s"), parse_timestamp(s[1]).alias("end_s")))
    return q.select("lecture_id", "duration_s", F.col("q.id").alias("question_id"), "q.kind", "q.question", "q.answer", spans.alias("spans"))


def parse_srt(files: DataFrame) -> DataFrame:
    """(path, ord, start_s, end_s, text) of files (path, value): blocks with a time line; what follows it is the text."""
    text = F.regexp_replace("value", r"\r\n?", "\n")
    blocks = files.select("path", F.posexplode(F.split(text, r"\n\s*\n")).alias("ord", "block")).where(F.col("block").rlike(CUE))
    part = lambda i: F.regexp_extract("block", CUE, i).cast("double")
    at = lambda i: part(i) * 3600 + part(i + 1) * 60 + part(i + 2) + part(i + 3) / 1000
    after = F.regexp_extract("block", rf"(?s){CUE}[^\n]*\n?(.*)", 9)
    lines = F.array_join(F.filter(F.transform(F.split(after, "\n"), F.trim), lambda x: x != ""), " ")
    return blocks.select("path", "ord", at(1).alias("start_s"), at(5).alias("end_s"), lines.alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def timed_words(cues: DataFrame) -> DataFrame:
    """Caption words, those of a cue spread evenly over it."""
    words = cues.withColumn("words", caption_words(F.col("text")))
    each = words.select("*", F.posexplode("words").alias("i", "word"))
    return each.select("path", "ord", "i", "word", (F.col("start_s") + F.col("i") * (F.col("end_s") - F.col("start_s")) / F.size("words")).alias("at"))


def read_artifacts(spark: SparkSession, root: str, stage: str, schema: str = "key string, stage string, output string") -> DataFrame:
    return spark.read.schema(schema).json(f"{root}/artifacts/{stage}/*.json")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, label, bbox) of COCO files."""
    files = spark.read.schema(COCO).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    images = files.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name")
    names = files.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    notes = files.select("file", F.explode("annotations").alias("a")).select("file", F.col("a.image_id").alias("image_id"), "a.category_id", "a.bbox")
    return notes.join(names, ["file", "category_id"]).join(images, ["file", "image_id"]).select("image_id", "file_name", "label", "bbox")


def coco_images(boxes: DataFrame) -> DataFrame:
    """(split, file_name, image_id, before): images numbered from 1 in each split, and the boxes of those before.

    Boxes are counted by image first, so only a row an image is numbered.
    """
    images = boxes.groupBy("split", "file_name").agg(F.count("label").alias("n"))
    numbered = running(sliced(images, ["split"], ["file_name"]), ["split"], ["file_name"], {"image_id": F.lit(1), "upto": F.col("n")})
    return numbered.select("split", "file_name", F.col("image_id").cast("int").alias("image_id"), (F.col("upto") - F.col("n")).alias("before"))


def coco_annotations(boxes: DataFrame, labels: list[str]) -> DataFrame:
    """Annotation rows of boxes (split, file_name, label, x1, y1, x2, y2): ids from 1 in each split, values to a tenth.

    Category ids are the labels' places from 1. An image without boxes has one row with a null label, which gives none.
    """
    number = F.row_number().over(Window.partitionBy("split", "file_name").orderBy("label", "x1", "y1", "x2", "y2"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    tenth = lambda c: F.bround(c, 1)
    rows = boxes.where("label is not null").withColumn("n", number).join(coco_images(boxes), ["split", "file_name"])
    return rows.select("split", "file_name", (F.col("before") + F.col("n")).alias("id"), "image_id", F.array_position(F.array(*map(F.lit, labels)), F.col("label")).alias("category_id"), F.array(tenth(F.col("x1")), tenth(F.col("y1")), tenth(w), tenth(h)).alias("bbox"), tenth(w * h).alias("area"))


def write_coco(boxes: DataFrame, labels: list[str], path: str, images_per_document: int = 10_000) -> None:
    """COCO documents of boxes (also width, height) that read_coco reads: a folder a split, a file for every so many images.

    Ids are unique in a split over all its documents.
    """
    shard = F.floor((F.col("image_id") - 1) / images_per_document)
    sizes = boxes.groupBy("split", "file_name").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    images = coco_images(boxes).join(sizes, ["split", "file_name"])
    image = F.struct(F.col("image_id").cast("long").alias("id"), "file_name", "width", "height")
    note = F.struct(F.col("id").cast("long").alias("id"), F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), "bbox", "area", F.lit(0).alias("iscrowd"))
    named = images.groupBy("split", shard.alias("shard")).agg(F.array_sort(F.collect_list(image)).alias("images"))
    notes = coco_annotations(boxes, labels).groupBy("split", shard.alias("shard")).agg(F.array_sort(F.collect_list(note)).alias("annotations"))
    categories = F.array(*(F.struct(F.lit(i + 1).alias("id"), F.lit(n).alias("name"), F.lit("none").alias("supercategory")) for i, n in enumerate(labels)))
    documents = named.join(notes, ["split", "shard"], "left").select("split", "images", F.coalesce("annotations", F.array().cast(notes.schema["annotations"].dataType)).alias("annotations"), categories.alias("categories"))
    documents.write.option("maxRecordsPerFile", 1).partitionBy("split").json(path)


def read_page_regions(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(REGIONS).json(path, multiLine=True).select("pdf", F.explode("pages").alias("p"))
    return pages.select("pdf", "p.page", F.explode("p.regions").alias("r")).select("pdf", "page", "r.label", "r.box")


def append_eval_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def write_table(rows: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000) -> None:
    """Rows into a warehouse table over JDBC, in batches from every task."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch).mode(mode).save()


def read_table(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A warehouse table over JDBC, in ``bounds`` = (low, high, parts) of a numeric column."""
    options = {"url": url, "dbtable": table}
    if partition and bounds:
        options |= {"partitionColumn": partition, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": bounds[2]}
    return spark.read.format("jdbc").options(**options).load()

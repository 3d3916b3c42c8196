"""Packing documents into fixed-length sequences as a cutting-stock problem, solved by column generation.

A document is cut into full sequences and one remainder. Remainders are counted by length class (a histogram of
fixed size); a linear program over patterns (which classes share a sequence) is solved by the simplex method, a
knapsack dynamic program prices new patterns; rounded patterns are dealt to the ranked remainders of each class.
Only the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm.common import short_batches, stored
from coursemill.llm.tokens import LibraryWords, cache, default_tokenizer, encode_texts, in_steps

LENGTH = 2048
WIDTH = 8  # tokens a length class spans
RANK_SPLITS = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_pattern(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes 1..n (class c has size c) of the highest total price."""
    n = len(price)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(room, n)
        with_item = price[:k] + value[room - 1 :: -1][:k]
        c = int(np.argmax(with_item))
        value[room], choice[room] = (with_item[c], c + 1) if with_item[c] > 1e-12 else (value[room - 1], 0)
    pattern, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the relaxed program uses each; demand[c - 1] pieces of class c must be covered."""
    have = np.flatnonzero(demand)
    if not len(have):
        return []
    d = demand[have].astype(float)
    basis = np.diag((capacity // (have + 1)).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    level = inverse.diagonal() * d
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        price = np.zeros(len(demand))
        price[have] = dual
        value, pattern = best_pattern(price, capacity)
        if value <= 1 + 2e-4:  # the program is within this share of its optimum (Farley 1990)
            break
        column = pattern[have].astype(float)
        direction = (inverse * column).sum(axis=1)  # no BLAS: its threads can hang beside the JVM's
        ok = direction > 1e-9
        ratio = np.where(ok, level / np.where(ok, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        level = np.maximum((inverse * d).sum(axis=1), 0)
    use = level
    full = np.zeros((len(have), len(demand)), np.int64)
    full[:, have] = np.round(basis.T).astype(np.int64)
    return [(full[j], float(use[j])) for j in range(len(have))]


def cut_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns that together hold exactly the histogram's pieces: ({class: pieces}, times)."""
    left = np.zeros(capacity, np.int64)
    for c, n in histogram.items():
        left[c - 1] = n
    plan: list[tuple[dict[int, int], int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        at = np.flatnonzero(pattern)
        times = min(times, int((left[at] // pattern[at]).min())) if len(at) else 0
        if times > 0:
            plan.append(({int(c) + 1: int(pattern[c]) for c in at}, times))
            left = left - times * pattern

    for pattern, use in column_generation(left, capacity):
        take(pattern, int(use + 1e-9))
    while left.any():  # what rounding leaves, a few pieces a class: largest first, then the largest that fits
        pattern, room = np.zeros(capacity, np.int64), capacity
        while room > 0 and len(fit := np.flatnonzero((left - pattern)[:room] > 0)):
            pattern[fit[-1]] += 1
            room -= fit[-1] + 1
        take(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return plan


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """Each document's pieces: as many full sequences as it fills, then the remainder."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache(LibraryWords, tokenizer)
        for batch in batches:
            for part in in_steps(batch, encoding=True):
                ids, offsets = encode_texts(part.column("text"), words)
                rows: list[tuple] = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    rows += [(doc, s, min(length, len(own) - s), zlib.crc32(own[s : s + length]), len(own)) for s in range(0, len(own), length)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = 1, width: int = WIDTH) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    docs: doc_id, text; more columns are ignored. Null or empty text is the end id alone. A null doc_id stays null.
    Rows that share a doc_id are packed each for itself. An empty table gives no rows. Returns a row for each
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0, dense), offset (in the sequence).
    """
    spark = docs.sparkSession
    short_batches(spark)
    cut = stored(pieces(docs, tokenizer, length, end_id))
    capacity = length // width
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_SPLITS))
    classed = cut.withColumns({"class": F.ceil(F.col("length") / width).cast("int"), "salt": salt})
    counts = classed.groupBy("class", "salt").count()
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}  # at most length / width rows
    slots, sequence = [], 0
    taken = dict.fromkeys(histogram, 0)
    for pattern, times in cut_plan(histogram, capacity):
        slot = 0
        for c, n in sorted(pattern.items(), reverse=True):
            slots.append((c, taken[c], taken[c] + n * times, n, sequence, slot))
            taken[c] += n * times
            slot += n
        sequence += times
    ranges = spark.createDataFrame(slots, "class int, low long, high long, per long, first long, slot long").coalesce(1)
    by_class = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("class", "salt", F.coalesce(F.sum("count").over(by_class), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = classed.withColumn("within", within).join(F.broadcast(before), ["class", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    # ranges has at most (length / width)**2 rows, mostly a few hundred: its size depends on the classes alone
    r = ranges.withColumnRenamed("class", "c")
    dealt = ranked.join(F.broadcast(r), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumns({"sequence_id": F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per")), "place": F.col("slot") + F.pmod(F.col("rank") - F.col("low"), F.col("per"))})
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

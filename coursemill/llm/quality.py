"""Quality selection by importance resampling.

Texts are bags of hashed n-grams (one and two tokens). The ratio of two generative models, target (documents labelled
good) and raw (all documents), weighs each document; Gumbel noise is added to the log weights and the k largest
are the sample without replacement. Counts of the raw model cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm.common import mix64, short_batches, stored, utf8
from coursemill.llm.tokens import in_steps
from coursemill.llm.windows import gram_codes, run_codes

BUCKETS = 1 << 14
LABELS = 50_000  # at most so many labelled rows fit the target model and the share to keep
SMOOTHING = 0.5
_CLASS = np.full(256, 2, np.int8)  # 0 white space, 1 letters, digits and bytes of other alphabets, 2 punctuation
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(text: np.ndarray) -> np.ndarray:
    """Bucket of each token and of each pair of neighbouring tokens; a token is a run of letters or of punctuation."""
    kind = _CLASS[text]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True]))) if len(text) else np.zeros(1, np.int64)
    starts, ends = edge[:-1], edge[1:]
    real = kind[starts] != 0 if len(text) else np.zeros(0, bool)
    codes = run_codes(text, starts[real], ends[real])
    pairs = gram_codes(codes, 2) if len(codes) > 1 else codes[:0]
    return (mix64(np.concatenate((codes, pairs))) >> np.uint64(64 - 14)).astype(np.int64)


def ngram_counts(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents, and over those with an id in ``good`` (a bounded table)."""
    marked = docs.join(F.broadcast(good.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in in_steps(batch):
                data, offsets = utf8(part.column("text"))
                for i, good_one in enumerate(part.column("good").to_pylist()):
                    own = np.bincount(features(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS)
                    raw += own
                    if good_one:
                        target += own
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.toLocalIterator():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return share(target) - share(raw)


def weights(docs: DataFrame, ratio: np.ndarray, seed: int, text: bool = False) -> DataFrame:
    """All columns of docs with log_weight and score (log_weight plus Gumbel noise drawn from the doc_id's hash)."""
    names = [n for n in docs.columns if text or n != "text"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_steps(batch):
                data, offsets = utf8(part.column("text"))
                w = [float(ratio[features(data[a:b])].sum()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(w, pa.float64())], names=[*names, "log_weight"])

    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    weighed = docs.mapInArrow(weigh, docs.select(*names).withColumn("log_weight", F.lit(0.0)).schema)
    return weighed.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform)))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k rows of the largest score, ties by doc_id: histograms narrow the cut down, no row leaves its place for it."""
    low, high, total = scored.agg(F.min(score), F.max(score), F.count("*")).first()
    if k >= total or low is None:
        return scored
    if k <= 0:
        return scored.limit(0)
    bins, above = 4096, 0
    for _ in range(8):
        width = (high - low) / bins
        if not width or low + width == low:
            break
        bin_of = F.least(F.floor((F.col(score) - low) / width), F.lit(bins - 1))
        counts = dict(scored.where(F.col(score).between(low, high)).groupBy(bin_of.alias("b")).count().collect())  # at most bins rows
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        inside = counts[b]
        # the last bin may be cut by rounding, so its neighbours' edges are kept by comparing bins, not values
        edge = scored.withColumn("_b", bin_of)
        low, high = edge.where(F.col(score).between(low, high) & (F.col("_b") == b)).agg(F.min(score), F.max(score)).first()
        if inside <= 1000:
            break
    rank = F.row_number().over(Window.orderBy(F.desc(score), "doc_id"))
    border = scored.where(F.col(score).between(low, high)).withColumn("_rank", rank).where(F.col("_rank") <= k - above).drop("_rank")
    return scored.where(F.col(score) > high).unionAll(border)


def quality_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, margin: float = 0.01, label_limit: int = LABELS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Importance-resample ``docs`` towards the documents labelled good (labels: doc_id, quality 0 or 1).

    ``share`` of the rows is kept, rounded up; if None, the share of good ones among the labels, plus ``margin``. Of more
    than ``label_limit`` labelled ids those with the smallest hashes are used; nothing else is bounded. Returns the
    kept rows: doc_id, the columns of ``carry`` (any of docs), log_weight, score. Null labels count as not labelled and an id with
    several labels as good if any is. Null text is empty and weighs 0. A null doc_id is never labelled. Ties in
    score fall to the smaller doc_id. With no good label the ratio is 0 everywhere and the sample is uniform.
    """
    short_batches(docs.sparkSession)
    by_id = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_limit).cache()
    n, good = some.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") > 0).cast("long")), F.lit(0))).first()
    if share is None:
        share = min(1.0, (good / n if n else 1.0) + margin)
    docs = docs.select(F.col("doc_id").cast("long"), "text", *(c for c in carry if c != "text"))
    raw, target = ngram_counts(docs, some.where("quality > 0").select("doc_id"))
    ratio = log_ratio(raw, target) if target.sum() else np.zeros(BUCKETS)
    scored = stored(weights(docs, ratio, seed, "text" in carry))
    some.unpersist()
    return top_k(scored, math.ceil(share * scored.count()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_sample(read("documents"), read("labels"))

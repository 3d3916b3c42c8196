"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Vectors are projected on many random directions. In each sorted projection only the two tails are kept, where few
vectors lie; a window centred on each vector there gives collisions. A pair whose collisions reach a count, calibrated
so that pairs at the threshold are found with the target recall, is compared exactly. For Gaussian directions the two
projections of a pair are jointly normal with the pair's cosine as correlation, whatever the data; so the
calibration needs no sample. Larger groups use deeper tails and more directions: windows stay about as full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import connected, mix64, pack, stored, unpack

COSINE, RECALL, COLLISIONS, LIST = 0.93, 0.9995, 2, 64
LEAST_TAIL, MOST_TAIL = 0.002, 0.1


def calibrate(cosine: float, recall: float, collisions: int, tail: float) -> tuple[float, float, int]:
    """Tail start, window and number of directions so that a pair at ``cosine`` has ``collisions`` with ``recall``."""
    window = math.sqrt(2 - 2 * cosine)
    grid = np.linspace(-8, 8, 3201)
    density = np.exp(-(grid**2) / 2) / math.sqrt(2 * math.pi) * (grid[1] - grid[0])
    start = float(-grid[np.searchsorted(np.cumsum(density), tail / 2)])
    x = grid[grid >= start]
    spread = math.sqrt(1 - cosine * cosine)
    normal = lambda v: np.array([0.5 * (1 + math.erf(t / math.sqrt(2))) for t in v])
    low, high = np.maximum(x - window, start), x + window
    share = 2 * float((density[grid >= start] * np.maximum(normal((high - cosine * x) / spread) - normal((low - cosine * x) / spread), 0)).sum())
    n = 1
    miss = lambda n: sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(collisions))
    while miss(n) > 1 - recall:
        n = n + 1 + n // 50
    return start, window, n


@lru_cache(maxsize=2)
def directions(size: int, count: int) -> np.ndarray:
    return np.random.default_rng([7, size]).standard_normal((size, count))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def candidate_pairs(vectors: DataFrame, cosine: float, recall: float, largest: int) -> DataFrame:
    """Pairs a < b of vectors (id, grp, v array<double>) of one group and size whose collisions reach the count."""
    start, window, n = calibrate(cosine, recall, COLLISIONS, min(MOST_TAIL, max(LEAST_TAIL, LIST / max(largest, 1))))
    tasks = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, group = part.column("id").to_numpy(), part.column("grp").to_numpy()
                lists = part.column("v")
                sizes = np.diff(lists.offsets.to_numpy())
                flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    x = unit(flat[offsets[rows][:, None] + np.arange(size)]) @ directions(int(size), n)
                    i, j = np.nonzero(np.abs(x) >= start)
                    key = mix64((group[rows[i]].astype(np.int64) * 4096 + size).astype(np.uint64)) ^ (j // 8).astype(np.uint64)
                    task = (mix64(key) % np.uint64(tasks)).astype(np.int32)
                    order = np.argsort(task, kind="stable")
                    cuts = np.flatnonzero(np.concatenate(([True], np.diff(task[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
                    packed = [pack(group[rows[i[o]]].astype(np.int64), np.full(len(o), size, np.int32), j[o].astype(np.int32), x[i[o], j[o]].astype(np.float32), ids[rows[i[o]]]) for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
                    yield pa.record_batch([pa.array(task[order[cuts[:-1]]], pa.int32()), pa.array(packed, pa.binary())], names=["task", "data"])

    def collide(table: pa.Table) -> pa.Table:
        group, size, j, x, ids = (np.concatenate(c) for c in zip(*(unpack(d) for d in table["data"].to_pylist()), strict=True))
        order = np.lexsort((x, j, size, group))
        group, size, j, x, ids = group[order], size[order], j[order], x[order], ids[order]
        new = np.concatenate(([True], (np.diff(group) != 0) | (np.diff(size) != 0) | (np.diff(j) != 0)))
        line = x.astype(np.float64) + np.cumsum(new) * 1000.0  # one line for all lists
        stop = np.searchsorted(line, line + window + 1e-6, "right")
        sums: list[tuple[np.ndarray, ...]] = []
        at = 0
        reach = np.cumsum(stop - np.arange(len(stop)) - 1)
        while at < len(ids):  # bounded runs of pairs
            end = max(int(np.searchsorted(reach, (reach[at - 1] if at else 0) + 2_000_000)), at + 1)
            count = stop[at:end] - np.arange(at, end) - 1
            left = np.repeat(np.arange(at, end), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
            sums.append(_count(a, b, np.ones(len(a), np.int64)))
            at = end
        a, b, count = _count(*(np.concatenate(c) for c in zip(*sums, strict=True)))
        to = (mix64(mix64(a.astype(np.uint64)) ^ b.astype(np.uint64)) % np.uint64(tasks)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0, [True]))) if len(to) else np.zeros(1, np.int64)
        rows = [pack(a[o], b[o], count[o].astype(np.int32)) for o in (order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))]
        return pa.table({"task": pa.array(to[order[cuts[:-1]]], pa.int32()), "data": pa.array(rows, pa.binary())})

    def reached(table: pa.Table) -> pa.Table:
        a, b, count = _count(*(np.concatenate(c) for c in zip(*(unpack(d) for d in table["data"].to_pylist()), strict=True)))
        hit = count >= COLLISIONS
        return pa.table({"a": a[hit], "b": b[hit]})

    lists = vectors.select("id", "grp", "v").mapInArrow(tails, "task int, data binary")
    pairs = lists.groupBy("task").applyInArrow(collide, "task int, data binary")
    return pairs.groupBy("task").applyInArrow(reached, "a long, b long")


def _count(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0)))) if len(a) else np.zeros(0, np.int64)
    return (a[first], b[first], np.add.reduceat(n, first)) if len(a) else (a, b, n)


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Link vectors of one label whose cosine (in double precision) is at least ``cosine``.

    vectors: vec_id, embedding (list of float), label; more columns are ignored. A null label, a null vec_id, and
    vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors of
    different sizes. Equal vectors are linked to each other and compared once. Returns a row for each row: vec_id,
    n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included), kept (it
    is that smallest one). Below the threshold nothing is linked; at it ``recall`` of the links is expected to be
    found, above it more. An empty table gives no rows.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("grp"), v.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = stored(good.groupBy("grp", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    pairs = candidate_pairs(classes, cosine, recall, largest)
    one = lambda n: classes.select(F.col("id").alias(n), F.col("v").alias(f"v{n}"), F.col("copies").alias(f"n{n}"))
    links = stored(pairs.join(one("a"), "a").join(one("b"), "b").where(cosine_of(F.col("va"), F.col("vb")) >= cosine).select("a", "b", "na", "nb"))
    both = links.select(F.col("a").alias("id"), F.col("nb").alias("n")).unionAll(links.select(F.col("b").alias("id"), F.col("na").alias("n")))
    counts = both.groupBy("id").agg(F.sum("n").alias("n"))
    found = classes.join(counts, "id", "left").join(connected(links.select("a", "b")), "id", "left")
    found = found.select("grp", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(found, ["grp", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & F.coalesce(finite, F.lit(False)))).select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r AS (SELECT a AS id, a AS r FROM l UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.id),
g AS (SELECT id, min(r) AS c FROM r GROUP BY id), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN g ON g.id = vec_id LEFT JOIN k ON k.a = vec_id
"""

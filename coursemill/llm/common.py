"""What the operators of this subpackage share: the shared work folder, sizes and packed rows."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUB_SALTS = 16
CACHES: dict = {}  # what a Python worker remembers between tasks of one operator


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``.

    Only where that setting is unset (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="coursemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/coursemill-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession) -> None:
    """Send few and bounded rows to Python at once: documents are long. Settings that the session has made stay."""
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, value)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows (one cheap aggregate)."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def block_count(spark: SparkSession, size: int, per_block: int = 2 << 20) -> int:
    """Blocks so that each holds about ``per_block`` bytes, and at least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_block), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (multiply and xor-shift rounds)."""
    x = np.array(x, dtype=np.uint64, copy=True)
    for multiplier in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x ^= x >> np.uint64(32)
        x *= np.uint64(multiplier)
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value; see unpack. Bytes of like significance stand together."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind) * 16 + a.dtype.itemsize, len(a)))], np.int64)
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    raw = b"".join((head.tobytes(), *planes))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd")
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for kind, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        width = kind % 16
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind // 16)}{width}"))
        at += size * width
    return out


def forget() -> None:
    """Drop what another operator's tasks remembered in this worker: workers are reused, and all share an executor's memory."""
    if CACHES:
        CACHES.clear()
        release()


def release() -> None:
    """Give freed memory back to the system: Python workers share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def connected(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Smallest id reachable over links (a, b): columns id, component. Ids without a link are absent.

    Alternates large-star and small-star rounds (Kiveris et al. 2014); each round is written to the shared
    folder, and the rounds end when a round changes nothing. Rounds grow with the logarithm of the graph, and
    aggregation by ``min`` combines before each shuffle; a hub's neighbours are never gathered into one row or task.
    """
    edges = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        every = F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1)))  # a hub's edges are dealt over so many tasks
        joined = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).cast("int")).join(low.withColumn("salt", every), ["a", "salt"])
        kept = joined.where("b > a") if large else joined
        moved = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionAll(low.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(edges)
    while last[0]:
        edges = stored(star(star(edges, True), False))
        now = state(edges)
        if now == last:
            break
        last = now
    parts = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return parts.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""Principal components and whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Products with the centred rows are distributed: ``X v`` and ``Xᵀ u`` alternate, and each sums a vector of the dimension's
size (or of one number a step) over tasks; left vectors are as long as the table and never leave the executors. A left vector
is a combination ``X w`` of the rows, so it is kept as ``w`` and made again, block by block, where a product needs it.
Both sides are fully reorthogonalised, twice. The driver holds the small bidiagonal matrix and the right vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import pack, stored, unpack

COMPONENTS = 4
SCALE = 256  # entries count in steps of 1 / SCALE
BLOCK_ROWS = 8192
TOLERANCE = 1e-14  # residual of a singular triplet against the largest value
TINY = 1e-12  # a new direction this small against the largest value is rounding


class Components(NamedTuple):
    """What whitening needs of the fit: rows, sums a dimension, unit vectors (columns), eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float  # largest entry of the whitened fit rows' covariance minus the identity

    @property
    def transform(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the entries in steps as longs; rows without a usable vector are left out.

    A vector is usable if it is not null nor empty, holds no null and no non-finite entry, and has the length that most such
    vectors have (of equally frequent lengths the longest).
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", entry))
    lengths = usable.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    return usable.where(F.size("embedding") == (lengths.length if lengths else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_blocks(rows: DataFrame) -> DataFrame:
    """Each distinct x once, in blocks: rows n, sums (by dimension), block (packed matrix). Equal rows meet in partial sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column("x").slice(at, BLOCK_ROWS))
                yield pa.record_batch([pa.array([len(x)]), pa.array([x.sum(0).tolist()], pa.list_(pa.int64())), pa.array([pack(np.array(x.shape), x.reshape(-1))], pa.binary())], names=["n", "sums", "block"])

    return rows.select("x").distinct().mapInArrow(run, "n long, sums array<long>, block binary")


class Rows:
    """The fit rows and sums over them."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        self.n = int(blocks.agg(F.sum("n")).first()[0] or 0)
        sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
        self.sums = [int(r.s) for r in sums]
        self.mean = np.array([s / self.n for s in self.sums])

    def total(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of a vector of numbers that ``of`` gives for centred rows; each task adds its blocks up first."""
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for value in batch.column("block"):
                    shape, flat = unpack(value.as_py())
                    part = of(flat.reshape(shape) - mean)
                    found = part if found is None else found + part
            if found is not None:
                yield pa.record_batch([pa.array(np.arange(len(found))), pa.array(found)], names=["i", "value"])

        parts = self.blocks.select("block").mapInArrow(run, "i long, value double")
        got = parts.groupBy("i").agg(F.sum("value").alias("value")).orderBy("i").collect()
        return np.array([r.value for r in got])


def bidiagonalise(rows: Rows, components: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (columns) and values of the largest triplets, and the squared norm of all rows.

    Steps end when the wanted triplets have converged and a second start, orthogonal to all before, finds no larger value
    (one start alone may miss a value that occurs twice), or at the full dimension. An exhausted start is followed by another.
    """
    d, n = len(rows.mean), rows.n
    rng = np.random.default_rng(seed)
    v_all, w_all, s_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # vectors v, left vectors as X w, and Xᵀ of those
    alphas: list[float] = []
    betas: list[float] = []
    begun, confirmed = 0, False

    def fresh() -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(2):
            v -= v_all @ (v_all.T @ v)
        return v / np.linalg.norm(v)

    norm2 = float(rows.total(lambda x: np.array([np.square(x).sum()]))[0])
    scale = np.sqrt(norm2 / min(d, n))  # at most the largest value, as the squares of all sum to norm2
    v = fresh()
    while scale:
        on_left = rows.total(lambda x, v=v, w=w_all: np.append((x @ w).T @ (x @ v), 0))[:-1]  # X v against the left vectors
        w = v - w_all @ on_left

        def back(x: np.ndarray, w: np.ndarray = w, left: np.ndarray = w_all) -> np.ndarray:
            p = x @ w
            return np.concatenate((x.T @ p, [p @ p], (x @ left).T @ p))

        got = rows.total(back)
        s, size2, again = got[:d], got[d], got[d + 1 :]
        w, s, alpha = w - w_all @ again, s - s_all @ again, float(np.sqrt(max(size2 - again @ again, 0)))
        w, s, alpha = (w / alpha, s / alpha, alpha) if alpha > TINY * scale else (np.zeros(d), np.zeros(d), 0.0)
        v_all, w_all, s_all = np.column_stack((v_all, v)), np.column_stack((w_all, w)), np.column_stack((s_all, s))
        alphas.append(alpha)
        r = s.copy()
        for _ in range(2):
            r -= v_all @ (v_all.T @ r)
        beta = float(np.linalg.norm(r))
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small)
        scale = max(scale, values[0])
        k = len(alphas)
        if k >= min(d, n):
            break
        if k >= components and (beta * np.abs(left[-1, :components]) <= TOLERANCE * scale).all():
            if confirmed:
                own_left, own, _ = np.linalg.svd(small[begun:, begun:])
                if beta * abs(own_left[-1, 0]) <= 1e-3 * own[0] or own[0] <= TINY * scale:
                    break
            else:
                confirmed, begun, beta = True, k, 0.0
        if beta <= TINY * scale:
            begun = k if beta else begun
            v, beta = fresh(), 0.0
        else:
            v = r / beta
        betas.append(beta)
    if not scale:
        return np.zeros((d, 0)), np.zeros(0), norm2
    keep = int((values[:components] > TINY * scale).sum())
    return v_all @ right[:keep].T, values[:keep], norm2


def principal(rows: DataFrame, components: int = COMPONENTS) -> Components:
    """Components of the distinct x of quantised rows; at most ``components``, fewer if the rows have no more dimensions."""
    blocks = stored(fit_blocks(rows)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = Rows(blocks)
        if not fit.n:
            return Components(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
        found, values, norm2 = bidiagonalise(fit, components)
        transform, k = found * np.sqrt(fit.n) / values, len(values)
        got = fit.total(lambda x: np.append((z := x @ transform).T @ z, z.sum(0))) / fit.n
        error = np.abs(got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :]) - np.eye(k)).max(initial=0)
        return Components(fit.n, np.array(fit.sums, np.int64), found, values**2 / fit.n, norm2 / fit.n, float(error))
    finally:
        blocks.unpersist()


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates: vec_id, component, n, deviation, whitened, explained, identity_error.

    vectors: vec_id, embedding (list of numbers); more columns are ignored. A row for each usable vector (see quantised)
    and component; rows that share a vec_id, or have none, each give rows. Equal vectors count once in the fit, so copies
    do not pull components. Fewer distinct vectors or dimensions than components give fewer components, a single distinct
    vector or an empty table no rows. Components of equal eigenvalue are some orthogonal basis of theirs.
    """
    rows = quantised(vectors)
    fit = principal(rows, components)
    n, k, transform, explained = fit.n, len(fit.values), fit.transform, fit.values / (fit.trace or 1)
    mean = np.array([s / n for s in fit.sums.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column("x"))
            deviation = np.square(n * x - fit.sums).sum(1)
            columns = [batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))]
            columns += [pa.array(np.full(len(x) * k, n)), pa.array(np.repeat(deviation, k)), pa.array(((x - mean) @ transform).reshape(-1))]
            columns += [pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, fit.identity_error))]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Whitening against a dense eigenvalue decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from coursemill.llm import whitening

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string"


def plain(vectors: list[list[float]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct x, eigenvalues and vectors in falling order."""
    x = np.unique(np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64), axis=0)
    values, found = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, values[::-1], found[:, ::-1][:, :components]


def compare(rows: pd.DataFrame, vectors: dict[int, list[float]], components: int = 4) -> None:
    x, values, found = plain(list(vectors.values()), components)
    n, sums = len(x), x.sum(0)
    assert (rows.n == n).all() and rows.identity_error.max() < 1e-9
    assert rows.identity_error.nunique() == 1
    own = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in vectors.items()}
    assert sorted(rows.vec_id) == sorted(i for i in own for _ in range(components))
    assert all(r.deviation == ((n * own[r.vec_id] - sums) ** 2).sum() for r in rows.itertuples())
    for c, group in rows.groupby("component"):
        e = values[c - 1]
        assert np.allclose(group.explained, e / values.sum(), rtol=1e-10)
        want = np.array([(own[i] - sums / n) @ found[:, c - 1] / np.sqrt(e) for i in group.vec_id])
        sign = np.sign(want @ group.whitened.to_numpy())
        assert np.abs(sign * want - group.whitened.to_numpy()).max() < 1e-7


def test_query_on_the_smallest_table(spark):
    table = pd.read_parquet(f"{DIR}/embeddings.parquet")
    compare(whitening.query(spark, DIR).toPandas(), dict(zip(table.vec_id, table.embedding, strict=True)))


@pytest.mark.parametrize("d", [5, 300])
def test_few_and_many_dimensions(spark, d):
    rng = np.random.default_rng(d)
    factors = rng.standard_normal((6, d)) * np.array([9, 7, 5, 3, 0.1, 0.1])[:, None]
    vectors = {i: (rng.standard_normal(6) @ factors + 0.01 * rng.standard_normal(d)).astype(np.float32).tolist() for i in range(400)}
    rows = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], SCHEMA).repartition(3)
    compare(whitening.whiten(rows).toPandas(), vectors)


def test_unusable_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.standard_normal(8).astype(np.float32).tolist() for i in range(60)}
    good |= {100 + i: good[1] for i in range(200)}  # copies count once
    bad = [None, [], [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 3]
    rows = [(i, v, "x") for i, v in good.items()] + [(1000 + i, v, None) for i, v in enumerate(bad)] + [(1, good[1], "again"), (None, good[2], "none")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert (got.vec_id == 1).sum() == 8 and got.vec_id.isna().sum() == 4
    compare(got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"]), good)


def test_equal_eigenvalues_are_all_found(spark):
    corners = [[s * (i == j) for j in range(6)] for i in range(6) for s in (3.0, -3.0)]
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(corners)], SCHEMA)
    got = whitening.whiten(rows, 6).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5, 6] and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained, 1 / 6)
    fit = whitening.principal(whitening.quantised(rows), 4)
    assert np.allclose(fit.vectors.T @ fit.vectors, np.eye(4), atol=1e-12)


def test_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None, "x")])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")])).count() == 0
    two = whitening.whiten(frame([(1, [1.0, 2.0], "x"), (2, [1.0, 4.0], "x")])).toPandas()
    assert len(two) == 2 and set(two.component) == {1} and np.allclose(sorted(two.whitened), [-1, 1])

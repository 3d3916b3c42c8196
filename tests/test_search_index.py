"""The kept-up lexical index against fresh counts, and dense search in a grid against plain scores."""

from __future__ import annotations

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.operators import lexical_index, search
from coursemill.sources import buckets

CHUNKS = "chunk_id long, text string"


def test_counts_after_random_upserts(spark, tmp_path):
    rng, root, kept = random.Random(1), str(tmp_path / "i"), {}
    words = [f"word{i}" for i in range(30)] + ["the"]
    for step in range(5):
        new = {rng.randrange(25): " ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(10)}
        gone = [i for i in rng.sample(range(25), 4) if i not in new] if step else []
        kept = {i: t for i, t in kept.items() if i not in gone} | new
        removed = spark.createDataFrame([(i,) for i in gone], "chunk_id long") if gone else None
        assert lexical_index.upsert(root, spark.createDataFrame(list(new.items()), CHUNKS), removed, count=8) == step
        every = spark.createDataFrame(list(kept.items()), CHUNKS)
        postings = search.bm25_postings(every)
        want = {(r.term, r.df) for r in search.bm25_stats(postings, every)[0].collect()}
        assert {(r.term, r.df) for r in lexical_index.document_counts(spark, root).collect()} == want
        facts = buckets.manifest(spark, root)["facts"]
        assert facts == {"n": len(kept), "total": sum(w != "the" for t in kept.values() for w in t.split())}
    asked = spark.createDataFrame([(1, "word3 word4 the"), (2, "word5"), (3, "unknown")], "query_id long, text string")
    want = [tuple(r) for r in search.bm25_search(asked, postings, every, 5).orderBy("query_id", "rank").collect()]
    for _ in range(2):
        got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in lexical_index.search(asked, root, 5).orderBy("query_id", "rank").collect()]
        assert got == want and len(got) > 5
        before = buckets.read(spark, root, "postings").count()
        lexical_index.compact(spark, root)
        assert buckets.read(spark, root, "postings").count() == postings.count() <= before


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    root = str(tmp_path / "i")
    lexical_index.upsert(root, spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit("term"), F.col("id").cast("string")).alias("text")), stem=False, count=64)
    term = spark.createDataFrame([("term7",)], "term string")
    files = lexical_index.live_postings(spark, root, term).inputFiles()
    assert 0 < sum("/postings-" in f for f in files) < 0.1 * len(buckets.read(spark, root, "postings").inputFiles())


def test_sparse_vectors(spark):
    rows = spark.createDataFrame([(1, "Cat cat dog the"), (2, ""), (3, None), (4, "the")], CHUNKS)
    got = {r.chunk_id: r for r in search.sparse_vectors(rows, stem=False).collect()}
    assert got[1].terms == ["cat", "dog"] and got[1].doc_len == 3 and len(set(got[1].ids)) == 2
    assert got[1].weights == pytest.approx([tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / 256)) for tf in (2, 1)])
    assert [got[i].terms for i in (2, 3, 4)] == [[], [], []]


def test_dense_search_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(2)
    index = rng.integers(-3, 4, (300, 6)).astype(float)
    asked = rng.integers(-3, 4, (90, 6)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(index)] + [(999, None, 1)], "chunk_id long, dense array<float>, label int").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(asked)], "query_id long, dense array<float>, label int")
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    scores = np.round(norm(asked) @ norm(index).T, 9)

    def plain(scoped: bool) -> set[tuple]:
        out = set()
        for q in range(90):
            best = sorted((-scores[q, c], c) for c in range(300) if not scoped or q % 4 == c % 3)[:7]
            out |= {(q, c, rank) for rank, (_, c) in enumerate(best, 1)}
        return out

    for block in (1 << 22, 120):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "INDEX_BLOCK", 500)
        for scope in (None, "label"):
            got = search.dense_search(queries, rows, 7, scope=scope)
            assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == plain(bool(scope))
        assert search.dense_search(queries.limit(0), rows, 7).count() == 0
    assert not math.isnan(scores.sum())


def test_points_have_known_ids_and_chapters(spark):
    lecture = str(uuid.UUID(int=5))
    chunks = spark.createDataFrame([(lecture, "s001", 12.0, [1.0]), (lecture, "s000", 1.0, [1.0])], "lecture_id string, segment_id string, start_s double, dense array<float>")
    chapters = spark.createDataFrame([(lecture, 0, "One", 5.0), (lecture, 1, "Two", 12.0)], "lecture_id string, ord int, title string, chapter_s double")
    got = {r.segment_id: r for r in search.upsert_index(chunks.limit(0), chunks, chunks, 1, chapters).collect()}
    assert got["s001"].point_id == str(uuid.uuid5(uuid.UUID(search.NAMESPACE), f"{lecture}/s001"))
    assert (got["s000"].chapter, got["s001"].chapter) == (None, "Two")
    other = search.upsert_index(chunks.limit(0), chunks, chunks, 1, namespace="6ba7b8109dad11d180b400c04fd430c8").where("segment_id = 's000'").first()
    assert other.point_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{lecture}/s000"))


def test_an_upsert_counts_its_difference_once(spark, tmp_path, monkeypatch):
    """A change reads its rows twice, for their buckets and for what they become; terms must not be counted anew for that."""
    from coursemill.operators import lexical_index
    from coursemill.sources import buckets

    plans = []

    def change(root, changes, *args, **kwargs):
        plans.append(changes["df"].rows._jdf.queryExecution().executedPlan().toString())
        return real(root, changes, *args, **kwargs)

    real = buckets.change
    monkeypatch.setattr(buckets, "change", change)
    rows = spark.createDataFrame([(1, "graph edge edge"), (2, "edge")], "chunk_id long, text string")
    lexical_index.upsert(str(tmp_path / "index"), rows, count=2)
    assert "Exchange" not in plans[0] and "Generate" not in plans[0]
    assert {tuple(r) for r in lexical_index.document_counts(spark, str(tmp_path / "index")).collect()} == {("graph", 1), ("edge", 2)}

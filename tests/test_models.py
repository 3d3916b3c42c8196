"""Encoders, search modes, variants of models, frames and notes against plain versions: what SQL cannot say."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.operators import evals, search, slides, timeline

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "the"]


def vector(text: str) -> np.ndarray:
    out = np.zeros(64)
    for token in re.findall(r"[a-z0-9]+", text.lower()):
        out[zlib.crc32(token.encode()) % 64] += 1
    return out / (np.linalg.norm(out) or 1)


def corpus(seed: int, n: int) -> dict[int, str]:
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, weights=[1, 2, 3, 4, 1, 1, 5], k=rng.randint(1, 12))) for i in range(n)}


def ranked(scores: dict[int, float], limit: int) -> list[int]:
    return sorted(scores, key=lambda c: (-scores[c], c))[:limit]


def bm25(query: str, texts: dict[int, str]) -> dict[int, float]:
    bags = {i: Counter(w for w in t.split() if w != "the") for i, t in texts.items()}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for i, bag in bags.items():
        score = 0.0
        for term in {w for w in query.split() if w != "the"} & bag.keys():
            df, tf = sum(term in b for b in bags.values()), bag[term]
            score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
        if score:
            out[i] = round(score, 9)
    return out


def test_embeddings(spark):
    texts = corpus(1, 30) | {90: "", 91: None}
    rows = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)
    for prefix in ("", "query: "):
        got = {r.chunk_id: r.dense for r in search.embed_chunks(rows, prefix=prefix, batch=4).collect()}
        assert all(np.allclose(got[i], vector(prefix + (t or "")), atol=1e-6) for i, t in texts.items()) and len(got) == 32
    assert search.embed_chunks(rows.limit(0)).count() == 0


@pytest.mark.parametrize("mode", ["dense", "bm25", "hybrid", "rerank"])
def test_search_modes(spark, mode):
    texts, asked = corpus(2, 60), {1: "alpha gamma", 2: "the kappa omega", 3: "delta"}
    chunks = search.embed_chunks(spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(4))
    queries = search.embed_chunks(spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    got = search.search(queries, chunks, search.bm25_postings(chunks), mode, 6, 30).collect()
    for q, query in asked.items():
        dense = ranked({c: round(float(np.float32(vector(query)) @ np.float32(vector(t))), 6) for c, t in texts.items()}, 30)
        sparse = ranked(bm25(query, texts), 30)
        own = {r["rank"]: r.chunk_id for r in got if r.query_id == q}
        if mode == "dense":
            cosine = lambda c: vector(query) @ vector(texts[c])  # noqa: E731, B023
            assert np.allclose([cosine(own[i]) for i in sorted(own)], [cosine(c) for c in dense[:6]], atol=1e-5)
            continue
        dense = [r.chunk_id for r in search.dense_search(queries.where(F.col("query_id") == q), chunks, 30).orderBy("rank").collect()]
        fused: dict[int, float] = {}
        for hits in (dense, sparse):
            for rank, c in enumerate(hits, 1):
                fused[c] = fused.get(c, 0) + 1 / (60 + rank)
        fused = {c: round(s, 12) for c, s in fused.items()}
        order = ranked(fused, 30)
        words = set(query.split())
        share = {c: len(words & set(texts[c].split())) / len(words) for c in order}
        want = {"bm25": sparse[:6], "hybrid": order[:6], "rerank": sorted(order, key=lambda c: (-share[c], order.index(c)))[:6]}[mode]
        assert [own[i] for i in sorted(own)] == want


def test_unknown_mode(spark):
    none = spark.createDataFrame([], "query_id long, text string, dense array<float>, chunk_id long")
    with pytest.raises(ValueError, match="unknown mode"):
        search.search(none, none, search.bm25_postings(none), "exact")


def test_variants_of_a_model(spark):
    scored = evals.word_error_rate(spark.createDataFrame([("a", ["x", "y"], ["x"]), ("a", ["z"], ["z", "z"]), ("b", [], [])], "variant string, ref array<string>, hyp array<string>"))
    recall = spark.createDataFrame([("a", 4, 1), ("a", 2, 5)], "variant string, said long, heard long")
    runs = spark.createDataFrame([("a", 3.0, 10.0, 100, 400), ("a", 1.0, 10.0, 90, 300), ("b", 1.0, 0.0, 5, None)], "variant string, seconds double, audio_s double, mb_before long, mb_peak long")
    got = {r.variant: tuple(r)[1:] for r in evals.variant_scores(scored, recall, runs).collect()}
    assert got == {"a": (pytest.approx(2 / 3), 0.5, 0.2, 310), "b": (None, 1.0, None, None)}


def test_answer_table(spark):
    metrics = spark.createDataFrame([(7, 0.5, 1.0, 2 / 3, 0.0, 1.0)], "run_id int, correctness double, faithfulness double, citations_valid double, on_target double, declines double")
    assert [r.line for r in evals.answer_table(metrics).collect()] == ["| 7 | 0.50 | 1.00 | 0.67 | 0.00 | 1.00 |"]


def test_frame_features(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        gray = rng.integers(150 if i % 2 else 0, 256, (24, 36))
        rows.append((i, gray.reshape(-1).tolist(), 24, 36, rng.integers(0, 4, 272).tolist()))
    frame = spark.createDataFrame(rows, "id int, gray array<int>, h int, w int, thumb array<int>")
    got = {r.id: r.f for r in frame.select("id", F.pandas_udf(slides.frame_features, slides.FEATURES)("gray", "h", "w", "thumb").alias("f")).collect()}
    for i, gray, h, w, thumb in rows:
        image = np.array(gray).reshape(h, w)[3:21, 6:30]
        assert got[i].is_slide == (sum(x > 200 for x in image.reshape(-1)) >= image.size / 2)
        bits = "".join(str(int(thumb[17 * y + x + 1] > thumb[17 * y + x])) for y in range(16) for x in range(16))
        assert [got[i][f"h{k}"] % (1 << 64) for k in range(4)] == [int(bits[64 * k : 64 * k + 64], 2) for k in range(4)]


def test_concepts_of_notes(spark):
    segments = spark.createDataFrame([("L", 0, "s000", 0.0, 10.0), ("L", 1, "s001", 10.0, 20.0)], "lecture_id string, index int, segment_id string, start_s double, end_s double")
    words = spark.createDataFrame([("L", 1, i, w, 10.0 + i) for i, w in enumerate("now hash tables and a hash table".split())], "lecture_id string, segment int, pos int, word string, start_s double")
    planned = spark.createDataFrame([("L", 0, "All", "s000")], "lecture_id string, ord int, title string, first_segment string")
    items = [("L", 0, "concept", "the hash table", "short", "s001"), ("L", 1, "concept", "Hash Tables", "a longer definition", "s001"), ("L", 2, "concept", "trees", "t", "s001"), ("L", 3, "concept", "ghost", "g", "s009")]
    rows = spark.createDataFrame([(*i[:5], "", "", i[5]) for i in items], "lecture_id string, ord int, kind string, term string, definition string, latex string, question string, segment_id string")
    durations = spark.createDataFrame([("L", 25.0)], "lecture_id string, duration_s double")
    notes = timeline.assemble_notes(planned, rows, segments, words, durations)
    got = {r.term: (r.definition, r.at_s) for r in notes["concepts"].collect()}
    assert got["Hash Tables"] == ("a longer definition", 11.0) and got["trees"] == ("t", 10.0) and "ghost" not in got
    assert len(got) + len({"the hash table"} - got.keys()) == 3
    assert [r.ord for r in notes["dropped"].collect()] == [3]


def test_texts_are_encoded_only_where_vectors_are_taken(spark):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    rows = search.embed_chunks(spark.createDataFrame([(1, "graph edge")], "chunk_id long, text string"))
    assert "Arrow" not in plan(rows.select("chunk_id", "text")) and plan(rows.where("dense is not null")).count("ArrowEvalPython") == 1


def test_terms_are_sorted_once_and_lengths_need_no_postings(spark):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, "edge graph edge"), (2, ""), (3, None)], "chunk_id long, text string")
    postings = search.bm25_postings(rows)
    assert plan(postings).count("sort_array") == 1 and "array_sort" not in plan(postings)
    assert sorted(map(tuple, postings.collect())) == [(1, "edge", 3, 2), (1, "graph", 3, 1)]
    found = search.bm25_search(spark.createDataFrame([(7, "edge")], "query_id long, text string"), postings, rows)
    assert plan(found).count("zip_with") == 2 and [(r.query_id, r.chunk_id, r.rank) for r in found.collect()] == [(7, 1, 1)]

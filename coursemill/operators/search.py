"""Search: postings and BM25, dense search, rank fusion, reranking, index upkeep. Many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.text import ascii_tokens, singular
from coursemill.operators.intervals import asof_backward

# fixed values: words too common to search for
STOPWORDS = "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were what when which who will with you".split()
K1, B = 1.2, 0.75
NAMESPACE = "0d7f3a529b414c1e8f0a6e2d5c9b7a14"  # fixed value: ids of points are made in it
AVERAGE_LENGTH = 256.0  # fixed value: what sparse vectors take for the mean length of a chunk
SCORES = 1 << 22  # scores of a step: 32 MB
QUERY_BLOCK = 1 << 22  # values of a block of queries; one block is sent to all tasks, several meet the index in a grid
INDEX_BLOCK = 1 << 24  # values of a cell's share of the index


def terms_of(text: Column, stem: bool = True) -> Column:
    tokens = F.filter(ascii_tokens(text), lambda t: ~t.isin(STOPWORDS))
    return F.transform(tokens, singular) if stem else tokens


def term_counts(rows: DataFrame, terms: str = "terms") -> DataFrame:
    """rows with their column of terms as rows of (term, tf): equal ones of a row stand together when sorted, so nothing is shuffled."""
    others = [c for c in rows.columns if c != terms]
    s, at = F.col("_s"), F.col("_at")
    runs = rows.select(*others, F.sort_array(terms).alias("_s"))  # not array_sort, which compares by an interpreted function
    begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    cut = runs.select(*others, "_s", F.when(F.size(s) > 0, begins).alias("_at"))  # a filter would sort a second time
    ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
    return cut.select(*others, F.inline(F.zip_with(at, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("long").alias("tf")))))


def bm25_postings(chunks: DataFrame, key: str = "chunk_id", stem: bool = True) -> DataFrame:
    """(key, term, tf, doc_len) of every chunk, a row of ``chunks``; stopwords are left out."""
    terms = chunks.select(key, terms_of(F.col("text"), stem).alias("terms"))
    return term_counts(terms.select(key, F.size("terms").cast("long").alias("doc_len"), "terms")).select(key, "term", "doc_len", "tf")


def sparse_vectors(chunks: DataFrame, key: str = "chunk_id", stem: bool = True) -> DataFrame:
    """(key, doc_len, ids, terms, weights): a chunk's terms with their BM25 weights but for IDF, which is the collection's.

    ids are 64-bit hashes of terms, so no dictionary is kept. The mean length is a constant, so a vector depends on its
    chunk alone; a chunk without terms has an empty vector.
    """
    each = bm25_postings(chunks, key, stem).groupBy(key, "doc_len").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))  # a chunk's own terms
    rows = chunks.select(key).join(each, key, "left").select(key, F.coalesce("doc_len", F.lit(0)).alias("doc_len"), F.coalesce("terms", F.array().cast(each.schema["terms"].dataType)).alias("terms"))
    weight = lambda x: x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * F.col("doc_len") / AVERAGE_LENGTH))
    return rows.select(key, "doc_len", F.transform("terms", lambda x: F.xxhash64(x["term"])).alias("ids"), F.transform("terms", lambda x: x["term"]).alias("terms"), F.transform("terms", weight).alias("weights"))


def bm25_stats(postings: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(term, df), and one row (n, avg_len) over the whole collection."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    lengths = postings.groupBy(key).agg(F.first("doc_len").alias("len"))
    return df, chunks.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.sum("len").alias("total"))).select("n", (F.col("total") / F.col("n")).alias("avg_len"))


def top_k(hits: DataFrame, limit: int, partition: list[str] | None = None, ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The best ``limit`` hits of each query with their rank; ties in a fixed order."""
    w = Window.partitionBy(*(partition or ["query_id"])).orderBy(F.desc("score"), *ties)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def bm25_search(queries: DataFrame, postings: DataFrame, chunks: DataFrame, limit: int = 30, key: str = "chunk_id", stem: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): summed BM25 weights of the terms a query shares with a chunk (key, text).

    Postings are cut to the queries' terms before the join on them; scope (query_id, key) limits what a query sees,
    and a query without scope rows then sees nothing.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text"), stem))).alias("term"))
    df = bm25_stats(postings, chunks, key)[0]
    length = F.greatest(F.size(terms_of(F.col("text"), stem)), F.lit(0))  # as in postings, which need not be counted again
    total = chunks.agg(F.count("*").alias("n"), F.sum(length).alias("total")).select("n", (F.col("total") / F.col("n")).alias("avg_len"))
    hits = bm25_hits(wanted, postings, df, F.broadcast(total), key)  # total is one row
    if scope is not None:
        hits = hits.join(scope, ["query_id", key], "left_semi")
    return top_k(hits, limit, ties=(key,))


def bm25_hits(wanted: DataFrame, postings: DataFrame, df: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of wanted (query_id, term) over postings, with (term, df) and one row (n, avg_len)."""
    kept = postings.join(wanted.select("term").distinct(), "term", "left_semi").join(df, "term").crossJoin(total)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return wanted.join(kept.select(key, "term", weight.alias("w")), "term").groupBy("query_id", key).agg(F.round(F.sum("w"), 9).alias("score"))


def hashed_bag(texts: list[str], size: int = 64) -> np.ndarray:
    """Stand-in encoder: hashed bag of words, unit length."""
    import re
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for token in re.findall(r"[a-z0-9]+", (text or "").lower()):
            out[i, zlib.crc32(token.encode()) % size] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed_chunks(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_bag, prefix: str = "", batch: int = 8) -> DataFrame:
    """Add ``dense``, the encoder's vector of prefix + text; the encoder sees ``batch`` texts at a time.

    A column of its own, so texts are not encoded where a plan takes other columns only, and not again for a filter.
    """

    def run(column: pa.Array) -> pa.Array:
        texts = [prefix + (t or "") for t in column.to_pylist()]
        parts = [encoder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
        vectors = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, 1), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.reshape(-1)))

    return chunks.withColumn("dense", F.arrow_udf(run, "array<float>").asNondeterministic()("text"))


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as a matrix of unit rows, from the flat buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


class _Nearest:
    """A block of queries and the scores that ``limit`` chunks seen so far reach for each."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, scopes: np.ndarray | None, limit: int):
        self.ids, self.matrix, self.scopes, self.limit = ids, matrix, scopes, limit
        self.best = np.full(len(ids), -np.inf)
        self.step = max(SCORES // max(len(ids), 1), 64)

    def feed(self, rows: pa.RecordBatch | pa.Table, key: str, scope: str | None) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(query ids, chunk keys, scores) that may be among the best."""
        for at in range(0, rows.num_rows if len(self.ids) else 0, self.step):
            part = rows.slice(at, self.step)
            scores = np.round(self.matrix @ _unit_rows(part.column("dense")).T, 9)
            if self.scopes is not None:
                scores[self.scopes[:, None] != part.column(scope).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            k = min(self.limit, scores.shape[1])
            cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]  # ties at the cut all go on
            if k == self.limit:
                self.best = np.maximum(self.best, cut)
            q, c = np.nonzero((scores >= self.best[:, None]) & np.isfinite(scores))
            yield self.ids[q], part.column(key).take(pa.array(c)), scores[q, c]


def dense_search(queries: DataFrame, index: DataFrame, limit: int = 30, key: str = "chunk_id", scope: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): cosine top-k of queries (query_id, dense) over index (key, dense).

    Queries of one block (QUERY_BLOCK values) are sent to the tasks that read the index, and chunks are not shuffled. More
    blocks meet the index in a grid: a cell is a block of queries and a share of the index, both of bounded size, so
    the index is read once for any number of queries. Only what may be among a cell's best is sent on. With ``scope``, a
    column of both tables, a query sees the chunks of its own scope. Rows without a vector are left out.
    """
    names = ["dense", *([scope] if scope else [])]
    asked, chunks = queries.select("query_id", *names).where("dense is not null"), index.select(key, *names).where("dense is not null")
    first = asked.first()
    size = max(len(first["dense"]), 1) if first else 1
    blocks = -(-asked.count() * size // QUERY_BLOCK) or 1
    schema = f"query_id long, {key} {dict(index.dtypes)[key]}, score double"
    found = lambda hits: pa.record_batch([pa.array(hits[0]), hits[1].combine_chunks() if isinstance(hits[1], pa.ChunkedArray) else hits[1], pa.array(hits[2])], names=["query_id", key, "score"])

    if blocks == 1:
        rows = asked.collect()  # at most QUERY_BLOCK values
        ids, scopes = np.array([r["query_id"] for r in rows], np.int64), np.array([r[scope] for r in rows]) if scope else None
        matrix = np.array([r["dense"] for r in rows], np.float64).reshape(len(rows), size)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Nearest(ids, matrix, scopes, limit)
            for batch in batches:
                yield from map(found, block.feed(batch, key, scope))

        return top_k(chunks.mapInArrow(run, schema), limit, ties=(key,))
    shares = -(-chunks.count() * size // INDEX_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_i", every(shares))
    right = chunks.withColumn("_i", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")).withColumn("_q", every(blocks))

    def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
        scopes = asked.column(scope).to_numpy() if scope else None
        block = _Nearest(asked.column("query_id").to_numpy(), _unit_rows(asked.column("dense")) if asked.num_rows else np.zeros((0, 1)), scopes, limit)
        parts = list(map(found, block.feed(rows, key, scope)))
        kind = pa.schema([("query_id", pa.int64()), (key, rows.schema.field(key).type), ("score", pa.float64())])
        return pa.Table.from_batches(parts, kind)

    met = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(cell, schema)
    return top_k(met, limit, ties=(key,))


def rrf_fuse(lists: list[DataFrame], k: int = 60, candidates: int = 30, limit: int = 6, key: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, key, rank)."""
    rows = None
    for hits in lists:
        part = hits.where(F.col("rank") <= candidates).select("query_id", key, (1.0 / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionAll(part)
    return top_k(rows.groupBy("query_id", key).agg(F.round(F.sum("part"), 12).alias("score")), limit, ties=(key,))


def word_share(query: pd.Series, text: pd.Series) -> pd.Series:
    """Stand-in reranker: share of the query's words that the text has."""
    import re

    words = lambda s: set(re.findall(r"[a-z0-9]+", (s or "").lower()))
    return pd.Series([len(q & words(t)) / len(q) if (q := words(a)) else 0.0 for a, t in zip(query, text, strict=True)], dtype="float64")


def rerank(hits: DataFrame, limit: int = 6, scorer: Callable[[pd.Series, pd.Series], pd.Series] = word_share, key: str = "chunk_id") -> DataFrame:
    """Candidates (query_id, query, text, rank, key) by the scorer's score, fused order on a tie."""
    scored = hits.withColumn("score", F.pandas_udf(scorer, "double")("query", "text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", key, "score", "rank")


def search(queries: DataFrame, chunks: DataFrame, postings: DataFrame, mode: str = "hybrid", limit: int = 6, candidates: int = 30, key: str = "chunk_id") -> DataFrame:
    """dense, bm25, hybrid or rerank search of queries (query_id, text, dense) over chunks (key, text, dense)."""
    if mode == "dense":
        return dense_search(queries, chunks, limit, key)
    if mode == "bm25":
        return bm25_search(queries, postings, chunks, limit, key)
    both = [dense_search(queries, chunks, candidates, key), bm25_search(queries, postings, chunks, candidates, key)]
    if mode == "hybrid":
        return rrf_fuse(both, candidates=candidates, limit=limit, key=key)
    if mode != "rerank":
        raise ValueError(f"unknown mode {mode}")
    fused = rrf_fuse(both, candidates=candidates, limit=max(limit, candidates), key=key).drop("score")
    return rerank(fused.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(chunks.select(key, "text"), key), limit, key=key)


def point_id(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a string in a namespace (32 hexadecimal digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def upsert_index(index: DataFrame, chunks: DataFrame, lectures: DataFrame, size: int, chapters: DataFrame | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """The index with each given lecture's points replaced by exactly its chunks (none: cleared).

    Chunks (lecture_id, segment_id, text, dense) of another vector size than ``size`` fail the job. With chapters
    (lecture_id, ord, title, chapter_s) a point (then also start_s) has ``chapter``, the title of the one under way.
    """
    sized = chunks.withColumn("dense", F.when(F.size("dense") == size, F.col("dense")).otherwise(F.raise_error(F.lit("wrong vector size")).cast("array<float>")))
    points = sized.withColumn("point_id", point_id(F.concat_ws("/", F.col("lecture_id").cast("string"), "segment_id"), namespace))
    if chapters is not None:
        points = asof_backward(points, chapters.withColumnRenamed("title", "chapter"), ["lecture_id"], "start_s", "chapter_s", ["chapter"], "ord")
    return index.join(lectures.select("lecture_id").distinct(), "lecture_id", "left_anti").unionByName(points, allowMissingColumns=True)

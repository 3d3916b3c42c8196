"""Ranked lexical search over hashed max-sketches of documents.

A document's sketch has a power of two of cells, some four a distinct term; a term falls into the cell of its hash's low
bits, and a cell keeps the largest impact of its terms, rounded up to a byte. The impacts found in the cells of an item's
terms, times the terms' weights, sum to an upper bound of the document's score. Each task looks up a block of items in a
block of documents at once, rescores by falling bound from the documents' own term counts, and stops at an item's
threshold: the score that the fiftieth best of what it has seen, or of a first search over some of the blocks, has at least.
Impacts depend on the document alone, so one index serves any items.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm.common import pack, short_batches, stored, unpack, utf8
from coursemill.llm.tokens import in_steps, split_words

TOP = 50
CELLS = 4  # a distinct term, at least
LEVELS = 255  # steps of an impact in a cell
FULL = 1_000_000  # no impact is larger
ITEMS = 200  # in a block, about
SEED_BLOCKS = 16  # one block in so many sets the first thresholds
BROADCAST = 1_000_000  # terms of items, of 32 bytes each
CHUNK = 64  # documents rescored at once
LOWER = np.full(256, 32, np.uint8)  # byte of a term, or a space
LOWER[128:] = np.arange(128, 256)
for _first, _last, _as in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
    LOWER[ord(_first) : ord(_last) + 1] = np.arange(ord(_as), ord(_as) + ord(_last) - ord(_first) + 1)


class Terms(NamedTuple):
    """Terms of texts: distinct hashes in order, and for each text its term numbers in order with counts."""

    hashes: np.ndarray
    offsets: np.ndarray
    number: np.ndarray
    tf: np.ndarray
    n: np.ndarray


def terms_of(texts: pa.Array) -> Terms:
    """Null counts as empty."""
    data, offsets = utf8(texts)
    lowered = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data])])
    words, numbers, places = split_words(lowered)
    hashes, rank = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)), return_inverse=True)
    n = np.diff(places)
    text = np.repeat(np.arange(len(n)), n)
    keys, tf = np.unique(text * max(len(hashes), 1) + rank.reshape(-1)[numbers], return_counts=True)
    owner, number = np.divmod(keys, max(len(hashes), 1))
    return Terms(hashes, np.searchsorted(owner, np.arange(len(n) + 1)), number.astype(np.uint32), tf, n)


def corpus_totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, total = 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            inside = np.append(LOWER[data] != 32, False)
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[offsets] = inside[offsets]  # a text's first byte begins a term of its own
            before = np.concatenate(([0], np.cumsum(begins)))
            n = np.diff(before[offsets])
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.record_batch([pa.array([some]), pa.array([total])], names=["docs", "terms"])

    row = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row.docs or 0, row.terms or 0


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A term's share of the score before its weight; n: its document's terms."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // total))


def index(docs: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """Blocks of documents: their distinct terms with document counts, sketches by size, and term counts.

    docs: doc_id, text. Documents without a term are in no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_steps(batch):
                found = terms_of(part.column("text"))
                keep = np.flatnonzero(found.n)
                if not len(keep):
                    continue
                distinct = np.diff(found.offsets)
                log = np.maximum(4, np.ceil(np.log2(np.maximum(CELLS * distinct, 1)))).astype(np.uint8)
                keep = keep[np.argsort(log[keep], kind="stable")]
                cells = np.int64(1) << log[keep].astype(np.int64)
                own = np.concatenate([np.arange(a, b) for a, b in zip(found.offsets[keep], found.offsets[keep + 1], strict=True)])
                number, tf, size = found.number[own], found.tf[own], distinct[keep]
                level = -(-impacts(tf, np.repeat(found.n[keep], size), *totals) * LEVELS // FULL)
                sketch = np.zeros(int(cells.sum()), np.uint8)
                at = np.repeat(np.cumsum(cells) - cells, size) + (found.hashes[number] & np.repeat(cells - 1, size).astype(np.uint64)).astype(np.int64)
                np.maximum.at(sketch, at, level.astype(np.uint8))
                ids = part.column("doc_id").take(pa.array(keep))
                forward = pack(ids.fill_null(0).to_numpy(), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), found.n[keep], size.astype(np.int64), number, tf.astype(np.uint32))
                counts = np.bincount(number, minlength=len(found.hashes)).astype(np.int32)
                seed = zlib.crc32(b"%d" % (ids[0].as_py() or 0)) % SEED_BLOCKS == 0
                one = lambda a: pa.array([a.tolist()], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array([seed]), one(found.hashes.view(np.int64)), one(counts), pa.array([pack(log[keep], sketch)], pa.binary()), pa.array([forward], pa.binary())], names=["seed", "terms", "counts", "sketch", "forward"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "seed boolean, terms array<long>, counts array<long>, sketch binary, forward binary")


def item_terms(items: DataFrame) -> DataFrame:
    """q, term (its hash) of each item once; items: q, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = terms_of(batch.column("text"))
            of = pa.array(np.repeat(np.arange(len(found.n)), np.diff(found.offsets)))
            yield pa.record_batch([batch.column("q").take(of), pa.array(found.hashes.view(np.int64)[found.number])], names=["q", "term"])

    return items.select("q", "text").mapInArrow(run, "q long, term long")


def item_blocks(blocks: DataFrame, terms: DataFrame, docs: int) -> DataFrame:
    """Items with the weights of those of their terms that a document holds: rows part, asked (list of q, term, w).

    A part has some ITEMS items, so its row is bounded by their texts.
    """
    parts = -(-terms.agg(F.count_distinct("q")).first()[0] // ITEMS) or 1
    held = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("df"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (2 * F.col("df") + 1))).alias("w")
    asked = terms.join(df, "term").select("q", "term", weight).where("w > 0")
    return asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("q", "term", "w")).alias("asked"))


class Block:
    """A block of documents as a task sees it."""

    def __init__(self, hashes: np.ndarray, sketch: bytes, forward: bytes):
        self.hashes = hashes
        log, flat = unpack(sketch)
        self.ids, self.no_id, self.n, self.size, self.number, self.tf = unpack(forward)
        self.begin = np.cumsum(self.size) - self.size
        self.classes = []  # first document, mask of a cell, cells x documents
        firsts, at = np.flatnonzero(np.diff(log.astype(np.int64), prepend=-1)), 0
        for a, b in zip(firsts, [*firsts[1:], len(log)], strict=True):
            cells = 1 << int(log[a])
            self.classes.append((a, np.uint64(cells - 1), np.ascontiguousarray(flat[at : at + cells * (b - a)].reshape(b - a, cells).T)))
            at += cells * (b - a)

    def bounds(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """At least LEVELS / FULL of each document's score."""
        return np.concatenate([w @ cells[(terms & mask).astype(np.int64)] for _, mask, cells in self.classes])

    def scores(self, docs: np.ndarray, numbers: np.ndarray, w: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
        """Exact scores: the terms are searched in each document's own, all at once."""
        low = np.repeat(self.begin[docs][:, None], len(numbers), 1)
        high = low + self.size[docs][:, None]
        end = high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            less = (self.number[np.minimum(middle, len(self.number) - 1)] < numbers) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
        at = np.minimum(low, len(self.number) - 1)
        tf = np.where((low < end) & (self.number[at] == numbers), self.tf[at], 0).astype(np.int64)
        return (impacts(tf, self.n[docs][:, None], *totals) * w).sum(1)


class Best:
    """The best documents of an item so far: score, whether without id, id."""

    def __init__(self, least: int):
        self.least, self.rows = least, np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        rows = np.concatenate((self.rows, np.column_stack((scores, no_id, ids))[keep]))
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:TOP]]
        if len(self.rows) == TOP:
            self.least = int(self.rows[-1, 0])


def searched(blocks: DataFrame, asked: DataFrame, parts: list[int], totals: tuple[int, int], least: DataFrame | None = None) -> DataFrame:
    """q, doc_id, score: each task's best documents of each item; what scores below the item's ``least`` may be left out.

    A row of documents meets each part of the items. Parts of up to BROADCAST terms in all are broadcast; more of them are
    copied to a salt a shuffle partition instead, and rows of documents go to one of these.
    """
    if least is not None:
        each = asked.select("part", F.explode("asked").alias("a")).select("part", "a.*").join(least, "q", "left")
        asked = each.groupBy("part").agg(F.collect_list(F.struct("q", "term", "w", F.coalesce("least", F.lit(1)).cast("long").alias("least"))).alias("asked"))
    else:
        asked = asked.withColumn("asked", F.transform("asked", lambda a: F.struct(a.q, a.term, a.w, F.lit(1).cast("long").alias("least"))))
    asked = stored(asked)
    rows = blocks.withColumn("part", F.explode(F.array(*map(F.lit, parts)).cast("array<long>")))
    if asked.agg(F.sum(F.size("asked"))).first()[0] <= BROADCAST:
        met = rows.join(F.broadcast(asked), "part")
    else:
        salts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = rows.withColumn("salt", F.floor(F.rand(1) * salts).cast("int"))
        met = salted.join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["part", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column("terms").slice(i, 1).flatten().to_numpy().view(np.uint64), batch.column("sketch")[i].as_py(), batch.column("forward")[i].as_py())
                q, term, w, low = (batch.column("asked").slice(i, 1).flatten().field(k).to_numpy() for k in range(4))
                order = np.argsort(q, kind="stable")
                q, term, w, low = q[order], term[order].view(np.uint64), w[order], low[order]
                number = np.searchsorted(block.hashes, term)
                there = block.hashes[np.minimum(number, len(block.hashes) - 1)] == term  # a term that the block lacks adds nothing
                firsts = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
                for a, b in zip(firsts, [*firsts[1:], len(q)], strict=True):
                    own = np.flatnonzero(there[a:b]) + a
                    if len(own):
                        item = best.setdefault(int(q[a]), Best(int(low[a])))
                        rescore(block, item, term[own], number[own], w[own], totals)
        for q, item in best.items():
            score, no_id, ids = item.rows.T
            yield pa.record_batch([pa.array(np.full(len(ids), q)), pa.array(ids, mask=no_id.astype(bool)), pa.array(score)], names=["q", "doc_id", "score"])

    return met.select("terms", "sketch", "forward", "asked").mapInArrow(run, "q long, doc_id long, score long")


def rescore(block: Block, item: Best, terms: np.ndarray, numbers: np.ndarray, w: np.ndarray, totals: tuple[int, int]) -> None:
    """By falling bound, until no bound reaches the item's threshold."""
    bound = block.bounds(terms, w.astype(float)) * FULL
    open_ = np.flatnonzero(bound >= item.least * LEVELS)
    order = open_[np.argsort(-bound[open_], kind="stable")]
    for at in range(0, len(order), CHUNK):
        docs = order[at : at + CHUNK]
        docs = docs[bound[docs] >= item.least * LEVELS]
        if not len(docs):
            break
        item.add(block.scores(docs, numbers.astype(np.uint32), w, totals), block.no_id[docs].astype(np.int64), block.ids[docs])


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP documents of each item: item_id, rank, doc_id, score.

    docs: doc_id, text; items: item_id, text; more columns are ignored. Terms are runs of ASCII letters (lower-cased), digits
    and characters beyond ASCII in the whole text; null and empty texts have none and are never found. Equal scores rank
    by ascending doc_id, a null doc_id last. Rows that share a doc_id rank each for itself, and rows that share an
    item_id, or have none, are items each. Items without a document above zero, and empty tables, give no rows.
    Terms are told apart by 64-bit hashes.
    """
    short_batches(docs.sparkSession)
    totals = corpus_totals(docs)
    blocks = stored(index(docs, totals))
    known = stored(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"))
    asked = stored(item_blocks(blocks, stored(item_terms(known)), totals[0]))
    parts = [r.part for r in asked.select("part").collect()]  # numbers of items' blocks only
    if not parts:
        return known.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    first = searched(blocks.where("seed"), asked, parts, totals)
    least = stored(ranked(first).where(F.col("rank") == TOP).select("q", F.col("score").alias("least")))
    return ranked(searched(blocks, asked, parts, totals, least)).join(known.drop("text"), "q").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // total AS m FROM d, c),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact set comparison decides.

A tree of the forest orders all documents by a signature of DEPTH minimum hashes; in sorted order the documents under
one trie node are neighbours, and the length of the prefix that a document shares with the one before it tells
which nodes the two are under. So one sort of each tree holds its trie at every depth. The matched prefix starts at
the full depth; tree by tree it is shortened by one hash, always where the fewest new neighbours join for the recall
that is gained, until a pair at the threshold shares a matched prefix in some tree with the target recall. Texts with
equal shingle sets are one class from the start. Classes that share a matched node are chained (a node costs a link a
member, never all pairs); each chained component is compared exactly, in cells of bounded size among documents of
like set sizes, and only counts and a spanning forest of the true links leave a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import HUB_SALTS, connected, mix64, release, short_batches, stored, utf8
from coursemill.llm.tokens import in_steps
from coursemill.llm.windows import gram_codes, word_tokens

WORDS, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 7, 0.9995
CELL = 1024
CELL_BYTES = 8 << 20  # text that a task compares
SIGNED = 200_000  # signatures of a task of the sort
_MULT = np.random.default_rng(3).integers(1, 1 << 63, (TREES * DEPTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The depth at which all trees together find a pair at the threshold often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def matched_depths(joined: dict[tuple[int, int], int], trees: int, depth: int, threshold: float, recall: float) -> list[int]:
    """Matched prefix of each tree. joined: (tree, depth) -> documents that share exactly so much with the one before.

    All trees start at the full depth. Each step shortens the tree that adds the fewest neighbours for the recall gained.
    """
    floor = least_depth(trees, depth, threshold, recall)
    depths = [depth] * trees
    found = lambda d: -math.log1p(-(threshold**d)) if threshold < 1 else math.inf
    while sum(map(found, depths)) < -math.log(1 - recall) and max(depths) > floor:
        price = {t: (joined.get((t, d - 1), 0) + 1) / (found(d - 1) - found(d)) for t, d in enumerate(depths) if d > floor}
        depths[min(price, key=lambda t: (price[t], t))] -= 1
    return depths


def shingles(text: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word n-grams; a shorter text is one n-gram, an empty one has none."""
    tokens = word_tokens(text)
    if not len(tokens):
        return tokens
    return np.unique(gram_codes(tokens, min(words, len(tokens))) + np.uint64(min(words, len(tokens))))


def signature(codes: np.ndarray) -> np.ndarray:
    """TREES x 2 numbers: DEPTH minimum hashes of 16 bits each, the first one highest."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(codes), 2048):
        low = np.minimum(low, ((codes[at : at + 2048] * _MULT) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    out = np.zeros((TREES, 8), ">u2")
    out[:, :DEPTH] = (low & np.uint32(0xFFFF)).reshape(TREES, DEPTH)
    return out.view(">i8").astype(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set_a, set_b (128-bit digest of the shingle set; null for none), size (shingles), bytes, high, low (a tree)."""
    schema = "doc_id long, set_a long, set_b long, size long, bytes long, high array<long>, low array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_steps(batch):
                data, offsets = utf8(part.column("text"))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    codes = shingles(data[a:b], words)
                    if len(codes):
                        digest = [int(np.add.reduce(mix64(codes ^ np.uint64(salt))).astype(np.int64)) for salt in (0x1234567, 0x89ABCDEF)]
                        rows.append((doc, *digest, len(codes), int(b - a), *signature(codes).T))
                    else:
                        rows.append((doc, None, None, 0, int(b - a), None, None))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "set_a", "set_b", "size", "bytes", "high", "low"])

    return docs.mapInArrow(run, schema)


ENTRY = ["tree", "high", "low", "rep"]
NODES = "tree int, high long, low long, rep long, shared int, heads array<long>, border boolean"


def trie_nodes(entries: DataFrame, least: int) -> DataFrame:
    """Of entries sorted within partitions: those that share at least ``least`` hashes with the entry before.

    shared: how many; heads: the first entry of the node for each depth from ``least`` to DEPTH. The first and the last
    entry of a partition come as border rows too, since nodes can go on in the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads = None, np.zeros(DEPTH - least + 1, np.int64)

        def borders(row: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([int(row[0])], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in row[1:]), pa.array([0], pa.int32()), pa.array([[]], pa.list_(pa.int64())), pa.array([True])]
            return pa.record_batch(columns, names=[*ENTRY, "shared", "heads", "border"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ENTRY], axis=1)
            if last is None:
                yield borders(rows[0])
            before = np.concatenate(([rows[0] if last is None else last], rows[:-1]))
            hashes = lambda r: np.ascontiguousarray(r[:, 1:3]).astype(">i8").view(">u2")[:, :DEPTH]
            shared = np.cumprod(hashes(rows) == hashes(before), axis=1).sum(axis=1) * (rows[:, 0] == before[:, 0])
            if last is None:
                shared[0] = 0
            first = np.empty((len(rows), DEPTH - least + 1), np.int64)
            for k, depth in enumerate(range(least, DEPTH + 1)):
                at = np.maximum.accumulate(np.where(shared < depth, np.arange(len(rows)), -1))
                first[:, k] = np.where(at >= 0, rows[np.maximum(at, 0), 3], heads[k])
            last, heads = rows[-1], first[-1]
            hit = np.flatnonzero(shared >= least)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(first[hit].reshape(-1)), DEPTH - least + 1).cast(pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("tree").take(pa.array(hit)), *(pa.array(rows[hit, c]) for c in (1, 2, 3)), pa.array(shared[hit].astype(np.int32)), lists, pa.array(np.zeros(len(hit), bool))], names=[*ENTRY, "shared", "heads", "border"])
        if last is not None:
            yield borders(last)
        release()

    return entries.select(*ENTRY).mapInArrow(run, NODES)


def forest_links(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) of classes (rep, high, low) to the first class of each matched node."""
    spark = reps.sparkSession
    least = least_depth(TREES, DEPTH, threshold, recall)
    entries = reps.select("rep", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "s")).select("tree", "s.high", "s.low", "rep")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() * TREES // SIGNED))
    nodes = stored(trie_nodes(entries.repartitionByRange(parts, *ENTRY).sortWithinPartitions(*ENTRY), least))
    # two rows a partition: which nodes go on from one partition to the next
    over = trie_nodes(nodes.where("border").coalesce(1).sortWithinPartitions(*ENTRY), least)
    inside = nodes.where("not border").select("tree", "rep", "shared", "heads")
    joined = {(r["tree"], r["shared"]): r["n"] for r in inside.groupBy("tree", "shared").agg(F.count("*").alias("n")).collect()}  # at most TREES x DEPTH rows
    depths = matched_depths(joined, TREES, DEPTH, threshold, recall)
    depth = F.element_at(F.array(*map(F.lit, depths)), F.col("tree") + 1)
    met = inside.unionAll(over.where("not border").select("tree", "rep", "shared", "heads")).where(F.col("shared") >= depth)
    return met.select(F.col("rep").alias("a"), F.element_at("heads", depth - least + 1).alias("b")).where("a <> b").distinct()


def compare(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each document of a cell, and for linked ones the smallest id they reach here (else their own).

    across: only pairs of the two sides. Pairs whose sizes or shared shingles rule the threshold out are not formed.
    """
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
    size = np.bincount(owner, minlength=len(ids))
    shared = counts[inverse] > 1
    kept = np.bincount(owner[shared], minlength=len(ids))
    alive = np.flatnonzero(kept >= threshold * size)
    alive = alive[np.argsort(size[alive], kind="stable")]
    if len(alive) < 2:
        return links, ids[root]
    columns = inverse[shared]
    start = np.concatenate(([0], np.cumsum(kept)))
    own = [columns[start[d] : start[d + 1]] for d in alive]
    flat, lengths = np.concatenate(own), np.array([len(c) for c in own])
    begin = np.concatenate(([0], np.cumsum(lengths)))
    mark = np.zeros(len(values), np.int32)
    sizes = size[alive]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(alive) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] / threshold + 1e-9, "right"))
        if stop <= i + 1:
            continue
        mark[own[i]] = 1
        common = np.add.reduceat(mark[flat[begin[i + 1] : begin[stop]]], begin[i + 1 : stop] - begin[i + 1])
        mark[own[i]] = 0
        hit = common >= threshold * (sizes[i] + sizes[i + 1 : stop] - common) - 1e-9
        if across:
            hit &= side[alive[i + 1 : stop]] != side[alive[i]]
        partners = alive[i + 1 : stop][hit]
        if len(partners):
            links[alive[i]] += len(partners)
            links[partners] += 1
            top = min([find(int(alive[i])), *map(find, partners.tolist())], key=lambda x: ids[x])
            for x in (int(alive[i]), *partners.tolist()):
                root[find(x)] = top
    return links, ids[np.array([find(x) for x in range(len(ids))])]


def cells_of(chained: DataFrame, threshold: float) -> DataFrame:
    """doc_id, component, bytes, cells [{cell, side, across}] of chained classes (doc_id, component, size, bytes): where each is compared.

    A component of at most CELL classes is one cell. Of a larger one only classes of like set sizes can be linked: they
    are parted by steps of the threshold on the scale of sizes, and each step, in chunks of about CELL, meets itself
    and the next one.
    """
    step = F.floor(F.log(F.col("size")) / -math.log(threshold) + 1e-9).cast("int") if threshold < 1 else F.lit(0)
    rows = chained.withColumns({"step": step, "salt": F.pmod(F.xxhash64("doc_id"), F.lit(HUB_SALTS)).cast("int")})
    counts = rows.groupBy("component", "step").agg(F.count("*").alias("n"))
    chunks = F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("n") / CELL).cast("int"))))  # a few dozen steps at most
    info = counts.groupBy("component").agg(F.sum("n").alias("members"), chunks.alias("chunks"))
    every = F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1)))  # a large component is dealt over so many tasks
    placed = rows.join(info.withColumn("salt", every), ["component", "salt"])
    placed = placed.withColumns({"step": F.when(F.col("members") > CELL, F.col("step")).otherwise(0), "chunks": F.when(F.col("members") > CELL, F.col("chunks")).otherwise(F.create_map(F.lit(0), F.lit(1)))})
    of = lambda shift: F.coalesce(F.try_element_at("chunks", F.col("step") + shift), F.lit(0))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit("chunk")), of(0)).cast("int"))
    upto = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i - 1)
    cell = lambda a, i, b, j, side, across: F.struct(F.concat_ws(".", a, i, b, j).alias("cell"), side.cast("int").alias("side"), across.alias("across"))
    c, k = F.col("chunk"), F.col("step")
    own = F.transform(upto(of(0)), lambda o: cell(k, F.least(c, o), k, F.greatest(c, o), c > o, c != o))
    up = F.when(of(1) > 0, F.transform(upto(of(1)), lambda o: cell(k, c, k + 1, o, F.lit(0), F.lit(True))))
    down = F.when(of(-1) > 0, F.transform(upto(of(-1)), lambda o: cell(k - 1, o, k, c, F.lit(1), F.lit(True))))
    cells = F.concat(own, F.coalesce(up, F.slice(own, 1, 0)), F.coalesce(down, F.slice(own, 1, 0)))
    return placed.select("doc_id", "component", "bytes", cells.alias("cells"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` or more.

    docs: doc_id long, text; more columns are ignored. Returns a row for each row: doc_id, copy_of (smallest doc_id of
    the same shingle set), n_links (other such classes linked directly), class_id (smallest doc_id reachable by
    links or copies, itself included). A text of fewer words is one shingle; null or empty text links with
    nothing. A null doc_id stays null and links with nothing. Rows that share a doc_id count as one document with
    each of their texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = stored(signatures(docs, words))
    reps = stored(known.where("set_a is not null and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("size", "bytes", "high", "low"), "doc_id").alias("s")).select("set_a", "set_b", "rep", "s.*"))
    chained = connected(forest_links(reps, threshold, recall)).withColumnRenamed("id", "doc_id")
    placed = stored(cells_of(chained.join(reps.select(F.col("rep").alias("doc_id"), "size", "bytes"), "doc_id"), threshold))
    volume = placed.agg(F.sum(F.col("bytes") * F.size("cells"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // CELL_BYTES))
    candidates = docs.join(placed.drop("bytes").hint("merge"), "doc_id")  # one plan at every size: texts of all documents are dealt by id
    cells = candidates.select("doc_id", "text", "component", F.explode("cells").alias("c")).select("doc_id", "text", "component", "c.*")
    cells = cells.withColumn("task", F.pmod(F.xxhash64("component", "cell"), F.lit(tasks)))

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("cell", "ascending"), ("doc_id", "ascending")])
        data, offsets = utf8(table["text"])
        ids, side, across = (table[c].to_numpy() for c in ("doc_id", "side", "across"))
        part, cell = table["component"].to_numpy(), table["cell"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (cell[1:] != cell[:-1]), [True])))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                sets = [shingles(data[offsets[r] : offsets[r + 1]], words) for r in range(a, b)]
                links, root = compare(ids[a:b], side[a:b], sets, threshold, bool(across[a]))
                hit = links > 0
                out.append((ids[a:b][hit], links[hit], root[hit]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        release()
        return pa.table(dict(zip(("doc_id", "links", "root"), columns, strict=True)))

    found = stored(cells.groupBy("task").applyInArrow(verify, "doc_id long, links long, root long"))
    counts = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    groups = connected(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    classes = reps.select("set_a", "set_b", "rep").join(counts.withColumnRenamed("doc_id", "rep"), "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    out = known.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("rep", "doc_id"))
    return out.select("doc_id", own.alias("copy_of"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", own).alias("class_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS MATERIALIZED (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s GROUP BY s),
e AS MATERIALIZED (SELECT rep, n, md5(unnest(s)) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9 GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE k >= 0.8 * (na + nb - k) - 1e-9),
r AS (SELECT a AS id, a AS r FROM l UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.id),
g AS (SELECT id, min(r) AS class_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(c.rep, w.doc_id) AS copy_of, coalesce(k.n_links, 0) AS n_links, coalesce(g.class_id, c.rep, w.doc_id) AS class_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (s) LEFT JOIN g ON g.id = c.rep LEFT JOIN k ON k.a = c.rep
"""

"""Exact dedups and joins against brute force, with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.llm import embedding_dedup, jaccard_join, substring_dedup, suffix_dedup, windows
from coursemill.llm.common import connected, pack, unpack

SCHEMA = "doc_id long, text string, block int, bucket string, task int, component string"


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 6)))
    base = [[word() for _ in range(int(rng.integers(5, 160)))] for _ in range(30)]
    shared = [word() for _ in range(24)]
    docs: list[tuple[int | None, str | None]] = []
    for i in range(90):
        words = list(base[int(rng.integers(0, 30))])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = word()
        if i % 3 == 0:
            at = int(rng.integers(0, len(words)))
            words[at:at] = shared
        docs.append((i * 7, " ".join(words)))
    long = " ".join(word() for _ in range(2000))
    return [*docs, (1000, None), (1001, ""), (1002, "a" * 700), (1003, "a" * 300), (1004, long), (1005, long[500:] + " x"), (None, docs[3][1]), (1006, " \n\t ")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in docs], SCHEMA).repartition(3)


def brute(tokens: list, ids: list[int], k: int, within: bool) -> list[np.ndarray]:
    first: dict = {}
    cut = lambda t, p: t[p : p + k] if isinstance(t, bytes) else tuple(t[p : p + k])
    for t, i in zip(tokens, ids, strict=True):
        for p in range(len(t) - k + 1):
            first[cut(t, p)] = min(first.get(cut(t, p), (i, p)), (i, p))
    out = []
    for t, i in zip(tokens, ids, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - k + 1):
            e = first[cut(t, p)]
            if (e < (i, p)) if within else (e[0] < i):
                gone[p : p + k] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [8, 30])
def test_suffix_dedup(spark, length):
    docs = corpus(1)
    key = lambda i: windows.NO_ID if i is None else i
    docs.sort(key=lambda d: key(d[0]))
    tokens = [(t or "").encode() for _, t in docs]
    flags = brute(tokens, [key(i) for i, _ in docs], length, True)
    want = [(i, len(t), int(f.sum()), hashlib.sha256(bytes(b for b, g in zip(t, f, strict=True) if not g)).hexdigest(), int((np.diff(np.concatenate(([0], f.astype(int)))) == 1).sum())) for (i, _), t, f in zip(docs, tokens, flags, strict=True)]
    got = suffix_dedup.suffix_dedup(frame(spark, docs), length).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256, r.n_spans) for r in got) == sorted((key(w[0]), *w[1:]) for w in want)


@pytest.mark.parametrize("length", [4, 12])
def test_substring_dedup(spark, length):
    docs = corpus(2)
    key = lambda i: windows.NO_ID if i is None else i
    tokens = [(t or "").encode().split() for _, t in docs]
    flags = brute(tokens, [key(i) for i, _ in docs], length, False)
    want = [(key(i), len(t), int(f.sum()), b" ".join(w for w, g in zip(t, f, strict=True) if not g).decode()) for (i, _), t, f in zip(docs, tokens, flags, strict=True)]
    for start in (2, length // 2):  # two or three levels, or one
        got = substring_dedup.substring_dedup(frame(spark, docs), length, start).collect()
        assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)


def test_keys_travel_in_passes(spark):
    """More blocks than one task sends to: the result is that of a single pass."""
    docs = corpus(4)
    finish, schema = suffix_dedup._finish(False, False)
    kind = windows.Kind(20, windows.byte_tokens, True)
    rows = frame(spark, docs).select("doc_id", "text")
    results = [sorted(map(str, windows.repeated_windows(rows, kind, finish, schema, 1500, radix).collect())) for radix in (512, 4)]
    assert windows.Way.of(30, 4).passes == 3
    assert results[0] == results[1]


def test_fewer_buckets_than_blocks(spark, monkeypatch):
    """Large inputs have more blocks than buckets, in one pass or in several."""
    monkeypatch.setattr(windows, "LEAST_BUCKETS", 3)
    docs = corpus(4)
    finish, schema = suffix_dedup._finish(False, False)
    kind = windows.Kind(20, windows.byte_tokens, True)
    rows = frame(spark, docs).select("doc_id", "text")
    few = [sorted(map(str, windows.repeated_windows(rows, kind, finish, schema, 1500, radix).collect())) for radix in (None, 4)]
    monkeypatch.undo()
    assert few[0] == few[1] == sorted(map(str, windows.repeated_windows(rows, kind, finish, schema, 1500).collect()))


def test_one_pass_up_to_30_gb():
    ways = windows.Ways.of(30 * 1024 // 2)
    assert (ways.to.passes, ways.back.passes) == (1, 1) and ways.blocks * ways.to.n <= windows.MOST_ROWS
    assert windows.Ways.of(250) == windows.Ways(250, windows.Way(250, 250, 1), windows.Way(250, 250, 1))
    far = windows.Ways.of(1 << 20)
    assert far.to.n == 1 << 17 and (far.to.passes, far.back.passes) == (2, 3)


def test_no_level_is_sent_without_survivors():
    words = [f"w{i}" for i in range(200)]
    tokens = windows.word_tokens(np.frombuffer(" ".join(words).encode(), np.uint8))
    codes = windows.minimizers([tokens], 6, 12, None)
    assert len(codes) == len(np.unique(codes)) > 200 / 7
    assert len(windows.minimizers([tokens], 12, 24, (6, np.zeros(0, np.uint64)))) == 0
    assert set(windows.minimizers([tokens], 12, 24, (6, np.sort(codes)))) == set(windows.minimizers([tokens], 12, 24, None))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_jaccard_join(spark):
    docs = [d for d in corpus(3) if d[0] is not None]
    rows = [*docs, (2001, docs[0][1]), (2002, "one two"), (2003, "one  two\n"), (2004, docs[5][1].replace(" ", "\n"))]
    sets = {i: frozenset(tuple(w[p : p + 5]) for p in range(max(len(w) - 4, 1))) for i, t in rows if (w := (t or "").split())}
    reps: dict = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    links = {r: {q for s2, q in reps.items() if q != r and len(s & s2) >= 0.8 * len(s | s2)} for s, r in reps.items()}
    top = {r: r for r in links}
    for _ in links:
        top = {r: min([top[r], *(top[q] for q in qs)]) for r, qs in links.items()}
    want = sorted((i, reps[sets[i]], len(links[reps[sets[i]]]), top[reps[sets[i]]]) if i in sets else (i, i, 0, i) for i, _ in rows)
    got = jaccard_join.jaccard_join(frame(spark, [*rows, (None, docs[0][1])])).collect()
    assert sorted((r.doc_id, r.copy_of, r.n_links, r.class_id) for r in got if r.doc_id is not None) == want
    assert [(r.copy_of, r.n_links, r.class_id) for r in got if r.doc_id is None] == [(None, 0, None)]


def test_large_group_is_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        words[int(rng.integers(0, 60))] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[p : p + 5]) for p in range(56)} for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = jaccard_join.jaccard_join(frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.n_links for r in got] == want
    assert {r.class_id for r in got} == {0}


def test_prefixes_are_shortened_to_the_recall():
    assert jaccard_join.least_depth(24, 7, 0.8, 0.9) == 7
    assert jaccard_join.least_depth(24, 7, 0.8, 0.999) == 6
    assert jaccard_join.least_depth(24, 7, 0.8, 0.9995) == 5
    assert jaccard_join.least_depth(1, 7, 0.8, 0.9995) == 1
    joined = {(t, d): (1000 if t < 6 else 10) for t in range(24) for d in range(1, 7)}
    depths = jaccard_join.matched_depths(joined, 24, 7, 0.8, 0.9995)
    assert 1 - np.prod([1 - 0.8**d for d in depths]) >= 0.9995
    assert set(depths[:6]) == {7} and min(depths[6:]) == 5  # where shortening adds many, the prefix stays long


def test_trie_nodes_go_on_over_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(t), int(h) << 32, 0, i) for i, (t, h) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 6, 400), strict=True))]
    entries = spark.createDataFrame(rows, "tree int, high long, low long, rep long")
    nodes = jaccard_join.trie_nodes(entries.repartitionByRange(7, *jaccard_join.ENTRY).sortWithinPartitions(*jaccard_join.ENTRY), 2)
    over = jaccard_join.trie_nodes(nodes.where("border").coalesce(1).sortWithinPartitions(*jaccard_join.ENTRY), 2)
    links = nodes.unionAll(over).where("not border").select(F.col("rep").alias("a"), F.element_at("heads", jaccard_join.DEPTH - 1).alias("b"))
    keys = {r[3]: r[:3] for r in rows}
    got = dict(connected(links.where("a <> b")).collect())
    first: dict = {}
    for i in sorted(keys):
        first.setdefault(keys[i], i)
    assert {i: got.get(i, i) for i in keys} == {i: first[keys[i]] for i in keys}


def test_large_components_are_parted_by_set_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    rows = [(i, f"{' '.join(f'w{k}' for k in range(20 + i))}") for i in range(60)]  # each text is a start of the next
    sets = [{tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = jaccard_join.jaccard_join(frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.n_links for r in got] == want
    assert {r.class_id for r in got} == {0}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    v = [base[i % 40] + rng.normal(size=16) * 0.09 * (i >= 40) for i in range(160)]
    rows = [(i, [float(np.float32(x)) for x in a], i % 2) for i, a in enumerate(v)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, [0.0] * 16, 0), (203, None, 0), (204, [1.0, None], 0), (205, [float("nan")] * 16, 0), (206, [1.0] * 3, 0), (None, rows[0][1], 0)]
    good = [(i, np.array(a, np.float64), g) for i, a, g in rows if i is not None and a is not None and g is not None and i not in (202, 204, 205)]
    links = {i: {j for j, b, h in good if j != i and g == h and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93} for i, a, g in good}
    top = {i: i for i in links}
    for _ in range(len(links)):
        top = {i: min([top[i], *(top[j] for j in js)]) for i, js in links.items()}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = embedding_dedup.embedding_dedup(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == sorted((i, len(links.get(i, ())), top.get(i, i)) for i, _, _ in rows if i is not None)
    assert len(got) == len(rows)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7), (3, 3)] + [(500, j) for j in range(600, 640)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41))
    assert got[100] == got[101] == got[102] == 100
    assert {got[j] for j in range(600, 640)} == {500}


def test_pack_keeps_numbers():
    parts = [np.array([1, -5, 1 << 60], np.int64), np.zeros(0, np.uint16), np.array([3.5], np.float32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(parts, unpack(pack(*parts)), strict=True))

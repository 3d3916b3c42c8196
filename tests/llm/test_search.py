"""Ranked search against its SQL and against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from coursemill.llm import lexical_search

DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord("A") + i: ord("a") + i for i in range(26)}


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def plain(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in docs if terms(t)]
    df = Counter(t for _, c, _ in counted for t in c)
    n_docs, total = len(counted), sum(n for *_, n in counted)
    out = set()
    for item, text in items:
        found = []
        for doc, tf, n in counted:
            m = 50 + 50 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            found += [(-score, doc)] if score > 0 else []
        out |= {(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(found)[:50], 1)}
    return out


def rows(frame) -> set[tuple]:
    got = [tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got = rows(lexical_search.query(spark, DIR))
    assert got == set(con.execute(lexical_search.ORACLE).fetchall())
    docs, items = (pd.read_parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got == plain(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_lengths_and_odd_texts(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Émile", "É", "日本", "A-b_c", "x\x00y", "ﬁ", "　", "THE", "the"]
    line = lambda n: " ".join(rng.choices(words, weights=[60, *[1] * (len(words) - 1)], k=n))
    docs = [(i, rng.choice([line(rng.randint(1, 12)), line(rng.randint(1, 12)), line(900)]), "x") for i in range(500)]
    docs += [(500 + i, "same text w1 w2", "x") for i in range(130)] + [(700, None, "x"), (701, "", "x"), (702, " .,- \n", "x")]
    items = [(1, "w1 w2 w2"), (2, None), (3, ""), (4, "absent"), (5, "THE émile É 日本 ﬁ"), (6, " ".join(words)), (7, "w0")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, term string").repartition(7)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, q int, part int").repartition(3)
    assert rows(lexical_search.search(frame, asked)) == plain(docs, items)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_many_blocks_and_parts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical_search, "BROADCAST", broadcast)
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    monkeypatch.setattr(lexical_search, "SEED_BLOCKS", 2)
    rng = random.Random(5)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randint(1, 60)))) for i in range(3000)]
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 3000}" for _ in range(6))) for i in range(20)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(12), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain(docs, items)


def test_repeated_and_missing_ids(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (2, "alpha gamma"), (9, "delta"), (10, "delta"), (11, "x"), (12, "y")]
    items = [(1, "alpha"), (1, "alpha"), (None, "beta")]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted(((r.item_id is None, r.item_id, r["rank"], r.doc_id) for r in got.collect()), key=str)
    assert [f[2:] for f in found if f[1] == 1] == [(1, 2), (1, 2), (2, 3), (2, 3), (3, 3), (3, 3), (4, None), (4, None)]
    assert [f[2:] for f in found if f[0]] == [(1, 3), (2, 3), (3, None)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0

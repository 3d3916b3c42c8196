"""What is counted or met within a row's own task is not shuffled."""

from __future__ import annotations

from collections import Counter

from coursemill.operators.evals import bag, ngram_counts
from coursemill.operators.search import bm25_postings


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_postings_count_a_chunk_s_terms_without_a_shuffle(spark):
    texts = {1: "b a b c b a", 2: "", 3: None, 4: "zz", 5: " ".join(f"t{i * i % 91}" for i in range(2000))}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    made = bm25_postings(chunks, stem=False)
    assert "Exchange" not in plan(made)
    want = [(k, t, len([w for w in v.split() if w != "a"]), n) for k, v in texts.items() if v for t, n in Counter(v.split()).items() if t != "a"]
    assert sorted((r.chunk_id, r.term, r.doc_len, r.tf) for r in made.collect()) == sorted(want)


def test_ngrams_of_texts_meet_the_terms_without_a_shuffle_of_all_ngrams(spark):
    words = spark.createDataFrame([(1, "the of the of and".split())], "key long, words array<string>")
    terms = spark.createDataFrame([("the of", ["the", "of"]), ("and", ["ands"])], "term string, tokens array<string>")
    made = ngram_counts(words, terms)
    assert "SortMergeJoin" not in plan(made)
    assert sorted(tuple(r) for r in made.collect()) == [(1, "and", 1), (1, "the of", 2)]


def test_bags_of_words_are_counted_within_their_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "slide_id long, tokens array<string>")
    made = bag(rows, ["slide_id"])
    assert "Exchange" not in plan(made)
    assert sorted(tuple(r) for r in made.select("slide_id", "token", "n").collect()) == [(1, "a", 1), (1, "b", 2)]

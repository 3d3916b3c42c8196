"""Hits and terms meet the words of their lecture in one row, whether the words come one by one or a row a lecture."""

from __future__ import annotations

import re

import pytest

from coursemill.operators import intervals, timeline

SENTENCES = [(1, 0.0, "a"), (1, 1.5, "b"), (1, 1.5, "a"), (1, 3.0, "c"), (2, 7.0, "z")]


def nested(spark):
    return spark.createDataFrame([(1, [0.0, 1.5, 1.5, 3.0], ["a", "a", "b", "c"]), (2, [7.0], ["z"]), (4, [], [])], "lecture_id long, start_s array<double>, text array<string>")


@pytest.mark.parametrize("flat", [True, False])
def test_hits_find_their_sentences(spark, flat):
    said = spark.createDataFrame(SENTENCES, "lecture_id long, start_s double, text string") if flat else nested(spark)
    hits = spark.createDataFrame([(1, 0, 0.0, 1.5), (1, 1, 2.0, 3.0), (1, 2, 3.6, 9.0), (2, 0, 0.0, 90.0), (3, 0, 0.0, 9.0), (4, 0, 0.0, 9.0)], "lecture_id long, n int, start_s double, end_s double")
    got = {(r.lecture_id, r.n): "".join(s.text for s in r.sentences) for r in intervals.attach_sentences(hits, said).collect()}
    assert got == {(1, 0): "a", (1, 1): "ab", (1, 2): "", (2, 0): "z", (3, 0): "", (4, 0): ""}


def test_nearest_said_is_nearest(spark):
    points = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate((w, t) for w in "abcx" for t in range(-1, 14))] + [(9, 0, "a", 3)], "lecture_id long, i int, w string, t int")
    times = {"a": [0, 4, 5, 12], "b": [3], "c": [13, 2, 2]}
    flat = spark.createDataFrame([(1, w, t) for w, ts in times.items() for t in ts], "lecture_id long, w string, at int")
    pairs = [(w, t) for w, ts in times.items() for t in ts]
    rows = spark.createDataFrame([(1, [w for w, _ in pairs], [t for _, t in pairs])], "lecture_id long, word array<string>, at array<int>")
    want = {(r.lecture_id, r.i): r.nearest for r in intervals.nearest(points, flat, ["lecture_id", "w"], "t", "at").collect()}
    got = {(r.lecture_id, r.i): r.nearest for r in intervals.nearest_said(points, rows, "w", "t").collect()}
    assert got == want and len(got) == 61
    assert got[1, 3] == 0 and got[9, 0] is None  # a at 2: 0 and 4 are as far


def test_a_slide_of_many_passages_is_written_into_each(spark):
    sources = spark.createDataFrame([("q", r, 1, r, float(r), r + 1.0, s, "T" if s else None) for r, s in enumerate((5, 5, None, 5, 6))], "question_id string, rank int, lecture_id long, segment_id int, start_s double, end_s double, slide_id int, slide_title string")
    slides = spark.createDataFrame([(1, 5, "x<", "", "", None, ""), (2, 6, "no", "", "", None, "")], "lecture_id long, slide_id int, title string, text string, figure_description string, latex array<string>, code string")
    got = timeline.evidence(sources, nested(spark), slides).collect()[0].evidence
    assert got.count("<slide>\nTitle: x&lt;\n</slide>") == 3 and "no" not in got
    assert got.split("\n")[1:7] == ['<passage time="00:00-00:01" slide="T">', "<slide>", "Title: x&lt;", "</slide>", "[00:00] a", "</passage>"]
    assert got.count("[00:01] a\n[00:01] b") == 2 and got.count("<passage ") == 5


@pytest.mark.parametrize(("name", "most"), [("d4_attach_passages", 0), ("d13_evidence", 0), ("d8_nearest_occurrence", 1), ("f7_locate_terms", 1), ("f11_notes_concepts", 1)])
def test_no_query_shuffles_words_one_by_one(spark, name, most):
    """The view words is read for the concepts of d8, f7 and f11 alone."""
    import __spark_entry__

    made = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate posexplode\(split\(trim", plan)) == most


def test_sentences_of_a_lecture_in_one_row_are_those_of_its_words(spark):
    import random

    from coursemill.operators.timeline import sentence_rows

    rng = random.Random(3)
    flat, whole = [], [("empty", [], [], []), ("null", None, None, None)]
    for lecture in map(str, range(12)):
        segments = sorted(rng.choices(range(4), k=rng.randrange(1, 60)))
        said = [rng.choice(["a", "b.", 'c?"', "d", "e", "f!)", None, "g.h"]) for _ in segments]
        at = [3 * i for i in range(len(segments))]
        flat += [(lecture, s, i, w, t) for i, (s, w, t) in enumerate(zip(segments, said, at))]
        whole.append((lecture, segments, said, at))
    words = spark.createDataFrame(flat, "lecture_id string, segment int, pos int, word string, start_ds int")
    rows = spark.createDataFrame(whole, "lecture_id string, segment array<int>, word array<string>, start_ds array<int>")
    for longest in (1, 3, 40):
        in_rows = sentence_rows(rows, longest)
        want = sorted(map(tuple, sentence_rows(words, longest).collect()))
        assert sorted(map(tuple, in_rows.collect())) == want and len(want) > 12
        assert "Exchange" not in in_rows._jdf.queryExecution().executedPlan().toString()

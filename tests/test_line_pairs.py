"""Lines of small pages, which are compared directly, and of large ones, which meet on q-grams, against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest

from coursemill.kernels.words import closest, matched
from coursemill.operators.slides import FEW, line_pairs


@pytest.mark.parametrize("size", [5, FEW + 40])
def test_line_pairs_on_pages_of_both_sizes(spark, size):
    rng = random.Random(size)
    words = ["graph", "edge", "node", "path", "tree", "root", "leaf", "sum"]
    pages = [(1, 0, i, " ".join(rng.choices(words, k=5)), [0.0, 1.0, 2.0, 3.0]) for i in range(size)]
    lines = []
    for i, (*_, text, _) in enumerate(pages):
        at = rng.randrange(len(text))
        changed = text[:at] + rng.choice("xyz") + text[at + 1 :]
        lines.append((1, i, 0, 0, changed if i % 3 else text, [(0.0, 0.0)] * 4))
    a = spark.createDataFrame(lines, "deck_id long, slide_id int, line_no int, page int, text string, box array<struct<x: double, y: double>>")
    b = spark.createDataFrame(pages, "deck_id long, page int, line_no int, text string, box array<double>")
    found = line_pairs(a, b)
    got = {r.slide_id: (r.page_line, round(r.ratio, 9)) for r in found.collect()}
    want = {}
    for _, i, _, _, text, _ in lines:
        best = max((SequenceMatcher(None, text, t).ratio(), -n) for _, _, n, t, _ in pages)
        if best[0] >= 0.9:
            want[i] = (-best[1], round(best[0], 9))
    assert got == want and len(want) > size // 2


def test_matched_characters_are_those_of_difflib():
    rng = random.Random(5)
    for k in range(6000):
        letters = rng.choice(["ab", "abc ", "abcdefghijklmnopqrstuvwxyz   eeettth"])
        x = "".join(rng.choices(letters, k=rng.randrange(1, 60 if k % 50 else 260)))
        y = list(x if k % 3 else rng.choices(letters, k=40))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = rng.choices(letters, k=rng.randrange(3))
        y = "".join(y)
        assert matched(x, y) == sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()), (x, y)


def test_closest_line_of_a_page():
    pages = pd.Series(["one two three\nthe second line\nthe second lime", "the second line\nthe second line", "", "the second line"])
    found = closest(pd.Series(["the second line", "the second lane", "the second line", None]), pages, 0.9)
    assert found["place"].tolist()[:2] == [1, 0] and found["place"].isna().tolist() == [False, False, True, True]
    assert found["ratio"][0] == 1.0 and found["ratio"][1] == SequenceMatcher(None, "the second lane", "the second line").ratio()


def test_lines_are_compared_once_and_dealt_once(spark):
    """The filter on the ratio must not compare anew, and a page of few lines is one row."""
    a = spark.createDataFrame([(1, 0, 0, 0, "graph edge node", [(0.0, 0.0)] * 4)], "deck_id long, slide_id int, line_no int, page int, text string, box array<struct<x: double, y: double>>")
    b = spark.createDataFrame([(1, 0, 0, "graph edge node", [0.0, 1.0, 2.0, 3.0])], "deck_id long, page int, line_no int, text string, box array<double>")
    plan = line_pairs(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan ExistingRDD") == 2

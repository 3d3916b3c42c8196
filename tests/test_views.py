"""Views that are made within a row of their table."""

from __future__ import annotations

import pytest

from coursemill.plans.views import VIEWS


@pytest.mark.parametrize("name", ["speech", "lengths", "spans"])
def test_views_of_a_document_need_no_shuffle(spark, name):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(25))), (2, ""), (3, None), (4, " a\n\nb ")], "doc_id long, text string")
    made = {"documents": docs}
    for n in ("speech", "lengths", "spans"):
        needs, sql, _ = VIEWS[n]
        made[n] = spark.sql(sql, **{v: made[v] for v in needs})
    assert "Exchange" not in made[name]._jdf.queryExecution().executedPlan().toString()
    if name == "speech":
        assert sorted((r.lecture_id, r.idx, r.start_ds, r.end_ds, len(r.text.split())) for r in made[name].collect()) == [(1, 0, 0, 48, 12), (1, 1, 48, 96, 12), (1, 2, 96, 100, 1), (2, 0, 0, 4, 0), (4, 0, 0, 8, 2)]
    if name == "lengths":
        assert sorted(tuple(r) for r in made[name].collect()) == [(1, 25), (2, 1), (4, 2)]

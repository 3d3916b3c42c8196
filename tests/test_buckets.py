"""Bucketed tables: what a change writes, and what a lost writer leaves."""

from __future__ import annotations

import pytest

from coursemill.sources import buckets


def table(spark, rows):
    return spark.createDataFrame(rows, "lecture_id long, v int")


def folders(spark, root):
    return {b: tuple(p) for b, p in buckets.manifest(spark, root)["tables"]["rows"]["places"].items()}


def test_one_lecture_of_many_rewrites_one_bucket(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.replace_by_key(spark.range(5000).selectExpr("id lecture_id", "int(id) v"), root, ["lecture_id"], 1000)
    before = folders(spark, root)
    assert len(before) > 900
    assert buckets.replace_by_key(table(spark, [(7, -1), (7, -2)]), root, ["lecture_id"]) == 1
    after = folders(spark, root)
    assert sum(before.get(b) != p for b, p in after.items()) == 1 and before.keys() == after.keys()
    rows = buckets.read(spark, root).collect()
    assert len(rows) == 5001 and sorted(r.v for r in rows if r.lecture_id == 7) == [-2, -1]
    assert [r.v for r in buckets.read(spark, root, version=0).where("lecture_id = 7").collect()] == [7]


def test_a_lost_writer_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.replace_by_key(table(spark, [(1, 1), (2, 2)]), root, ["lecture_id"])

    def lost(old, rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        buckets.change(root, {"rows": buckets.Change(table(spark, [(1, 9)]), ["lecture_id"], lost)})
    (tmp_path / "t" / "manifests" / "v000000001.json").write_text('{"version": 1, "tab')  # died while it wrote this
    assert sorted(r.v for r in buckets.read(spark, root).collect()) == [1, 2]
    assert buckets.replace_by_key(table(spark, [(1, 9)]), root, ["lecture_id"]) == 2
    assert sorted(r.v for r in buckets.read(spark, root).collect()) == [2, 9]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.replace_by_key(table(spark, [(1, 1)]), root, ["lecture_id"])

    def slow(old, rows):
        buckets.replace_by_key(table(spark, [(1, 2)]), root, ["lecture_id"])
        return rows

    with pytest.raises(buckets.ConcurrentWriteError):
        buckets.change(root, {"rows": buckets.Change(table(spark, [(1, 3)]), ["lecture_id"], slow)})
    assert [r.v for r in buckets.read(spark, root).collect()] == [2]


def test_batches_null_keys_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    add = lambda rows, n: buckets.change(root, {"rows": buckets.Change(table(spark, rows), ["lecture_id"])}, batch=n)
    assert [add([(1, 1), (None, 5)], 0), add([(1, 2)], 1), add([(1, 2)], 1), add([], 2)] == [0, 1, 1, 2]
    assert sorted((r.lecture_id or 0, r.v) for r in buckets.read(spark, root).collect()) == [(0, 5), (1, 1), (1, 2)]
    with pytest.raises(ValueError, match="no table"):
        buckets.read(spark, root, "other")

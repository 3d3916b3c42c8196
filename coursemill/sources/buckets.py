"""Tables in hash buckets of their keys, changed by copy on write and committed by a manifest.

A change writes the buckets that it touches into a new folder and then one manifest, which names the folder of each bucket of
each table. A version is what its manifest says; until that is whole, readers see the version before. Manifests are
created, never overwritten, so of two writers that start from one version the second gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET = "_bucket"


class ConcurrentWriteError(RuntimeError):
    """Another writer committed the version first."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _path(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers that writers have taken, committed or not."""
    return [int(n[1:-5]) for n in _names(spark, f"{root}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """What the last version up to ``version`` holds; manifests that were not written to their end do not count."""
    for number in reversed([v for v in versions(spark, root) if version is None or v <= version]):
        files, where = _path(spark, f"{root}/manifests/v{number:09d}.json")
        stream = files.open(where)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            continue
    return None


def _commit(spark: SparkSession, root: str, content: dict) -> None:
    files, where = _path(spark, f"{root}/manifests/v{content['version']:09d}.json")
    try:
        out = files.create(where, False)
    except Exception as e:
        if files.exists(where):
            raise ConcurrentWriteError(f"version {content['version']} of {root} is another writer's") from e
        raise
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def _rows(spark: SparkSession, table: dict | None, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    places = [p for b, found in sorted((table or {"places": {}})["places"].items()) if buckets is None or int(b) in buckets for p in found]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, name: str = "rows", version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A table of the last version (or the last up to ``version``); of some buckets only if they are named."""
    table = (manifest(spark, root, version) or {"tables": {}})["tables"].get(name)
    if table is None:
        raise ValueError(f"{root} has no table {name}")
    return _rows(spark, table, T.StructType.fromJson(table["schema"]), buckets)


def bucket_of(keys: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def buckets_of(spark: SparkSession, root: str, rows: DataFrame, keys: list[str]) -> list[int]:
    """The buckets that keys of ``rows`` fall into: as many as there are buckets at most."""
    found = manifest(spark, root)
    return [r[0] for r in rows.select(bucket_of(keys, found["buckets"])).distinct().collect()] if found else []


class Change(NamedTuple):
    """What a table gets: in buckets (by ``keys``) that rows fall into, ``combine(old rows, rows)``; without combine rows are added."""

    rows: DataFrame
    keys: list[str]
    combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def change(root: str, changes: dict[str, Change], buckets: int = BUCKETS, batch: int | None = None, facts: dict | None = None) -> int:
    """Commit the next version of the changed tables together; the number of buckets is the first version's.

    ``batch``: a change of a batch that is committed already does nothing, so a stream's batch may be tried again. ``facts``
    are small values that the manifest keeps. Added rows go into a folder beside the old ones. Returns the version.
    """
    spark = next(iter(changes.values())).rows.sparkSession
    base = manifest(spark, root) or {"version": -1, "buckets": buckets, "tables": {}, "batch": None, "facts": {}}
    if batch is not None and base["batch"] is not None and batch <= base["batch"]:
        return base["version"]
    number = max([*versions(spark, root), -1]) + 1
    count, tables = base["buckets"], dict(base["tables"])
    for name, (rows, keys, combine) in changes.items():
        old = tables.get(name)
        schema, places = T.StructType.fromJson(old["schema"]) if old else rows.schema, dict(old["places"]) if old else {}
        if combine:
            touched = [r[0] for r in rows.select(bucket_of(keys, count)).distinct().collect()]
            rows = combine(_rows(spark, old, schema, touched), rows)
            places = {b: p for b, p in places.items() if int(b) not in touched}
        place = f"{root}/data/{name}-{uuid.uuid4().hex}"
        rows.select(*schema.names).withColumn(BUCKET, bucket_of(keys, count)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(place)
        for folder in _names(spark, place):
            if folder.startswith(BUCKET):
                b = folder.split("=")[1]
                places[b] = [*places.get(b, []), f"{place}/{folder}"]
        tables[name] = {"schema": schema.jsonValue(), "places": places}
    _commit(spark, root, {"version": number, "buckets": count, "tables": tables, "batch": base["batch"] if batch is None else batch, "facts": base["facts"] | (facts or {})})
    return number


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of keys that new has not, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_tables(new: dict[str, DataFrame], root: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Replace the keys' rows in several tables together: all or nothing. Only buckets of these keys are written."""
    return change(root, {name: Change(rows, keys, lambda old, new: replaced(old, new, keys)) for name, rows in new.items()}, buckets)


def replace_by_key(new: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """replace_tables of one table, called rows."""
    return replace_tables({"rows": new}, root, keys, buckets)

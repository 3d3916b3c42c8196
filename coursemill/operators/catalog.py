"""Who sees which lectures and courses, listings, link checks, upload plans, provenance keys."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SPREAD = 32  # viewers who see the same items are dealt over so many tasks


def _all_of(items: DataFrame, viewers: DataFrame) -> DataFrame:
    """Every viewer with every item, as the result asks; dealt by a salt of the viewer."""
    dealt = viewers.withColumn("_salt", F.pmod(F.xxhash64("viewer_id"), F.lit(SPREAD)))
    return dealt.join(items.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))), "_salt").select("viewer_id", *items.columns)


def readable(items: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewer_id, item columns): public items for all, own items, everything for admins.

    Three equi-joins, so no pair of a viewer and an unreadable item is formed; anonymous viewers have a null id and see
    public items. viewers: viewer_id, admin.
    """
    others = viewers.where("not admin")
    own = others.join(items.where("visibility <> 'public'"), F.col("viewer_id") == F.col("owner_id"))
    public = _all_of(items.where("visibility = 'public'"), others)
    return public.unionAll(own.select("viewer_id", *items.columns)).unionAll(_all_of(items, viewers.where("admin")))


def changeable(items: DataFrame, viewers: DataFrame) -> DataFrame:
    own = viewers.where("not admin").join(items, F.col("viewer_id") == F.col("owner_id"))
    return own.select("viewer_id", *items.columns).unionAll(_all_of(items, viewers.where("admin")))


def newest(rows: DataFrame, keys: list[str], limit: int, by: str = "created_at", id_: str = "id") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc(id_))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def list_lectures(lectures: DataFrame, viewers: DataFrame, limit: int = 50) -> DataFrame:
    """A viewer's newest lectures. Each owner's and the public newest are cut first, so few rows meet a viewer."""
    last = lambda rows: rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    public = last(lectures.where("visibility = 'public'"))
    own = newest(lectures.where("visibility <> 'public'"), ["owner_id"], limit)
    every = last(lectures)
    rows = readable(public.unionAll(own), viewers.where("not admin")).unionAll(changeable(every, viewers.where("admin")))
    return newest(rows, ["viewer_id"], limit)


def list_courses(courses: DataFrame, lectures: DataFrame, viewers: DataFrame) -> DataFrame:
    """Readable courses with the number of readable lectures in each, zero kept.

    Public lectures are counted once a course, own ones once a viewer: no row a (viewer, lecture).
    """
    seen = readable(courses, viewers).join(viewers, "viewer_id")
    of = lectures.groupBy(F.col("course_id").alias("id")).agg(F.count("*").alias("every"), F.sum((F.col("visibility") == "public").cast("long")).alias("public"))
    own = lectures.where("visibility <> 'public'").groupBy(F.col("course_id").alias("id"), F.col("owner_id").alias("viewer_id")).agg(F.count("*").alias("own"))
    rows = seen.join(of, "id", "left").join(own, ["id", "viewer_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("viewer_id", "id", "title", F.when(F.col("admin"), zero("every")).otherwise(zero("public") + zero("own")).alias("lectures"))


def number_lectures(lectures: DataFrame) -> DataFrame:
    """Number of each ready lecture in its course; unready ones count but are not returned."""
    w = Window.partitionBy("course_id").orderBy("created_at", "id")
    return lectures.withColumn("number", F.row_number().over(w)).where("status = 'ready'")


def latest_ready(lectures: DataFrame) -> DataFrame:
    return lectures.where("status = 'ready'").groupBy("content_hash").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def purge(table: DataFrame, ids: DataFrame, key: str = "lecture_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def validate_golden(golden: DataFrame) -> DataFrame:
    """(question_id, problem) of questions: question_id, answer, spans [{start_s, end_s}], duration_s."""
    golden = golden.withColumn("_n", F.count("*").over(Window.partitionBy("question_id")))
    bad = F.exists("spans", lambda s: ~((s["start_s"] >= 0) & (s["start_s"] < s["end_s"]) & (s["end_s"] <= F.col("duration_s"))))
    problems = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("answer").isNull() != (F.size("spans") == 0), "answer without spans or spans without answer"), F.when(bad, "span out of order")))
    return golden.select("question_id", F.explode(problems).alias("problem"))


def upload_gaps(uploads: DataFrame, parts: DataFrame, part_size: int = 8 << 20) -> DataFrame:
    """(upload_id, part_no, size) still to send. A sent part counts if its number and its exact size fit the plan."""
    size = F.greatest(F.lit(part_size), F.ceil(F.col("bytes") / 10000))
    plan = uploads.withColumn("_size", size).withColumn("_n", F.ceil(F.col("bytes") / F.col("_size")).cast("int"))
    rows = plan.select("upload_id", "bytes", "_size", "_n", F.explode(F.sequence(F.lit(1), "_n")).alias("part_no"))
    sized = rows.select("upload_id", "part_no", F.when(F.col("part_no") < F.col("_n"), F.col("_size")).otherwise(F.col("bytes") - (F.col("_n") - 1) * F.col("_size")).cast("long").alias("size"))
    return sized.join(parts, ["upload_id", "part_no", "size"], "left_anti")


def export_manifest(lectures: DataFrame, courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ready public lectures with the title of their course if it is public, and the courses in use."""
    public = courses.where("visibility = 'public'").select(F.col("id").alias("course_id"), F.col("title").alias("course"))
    out = lectures.where("status = 'ready' and visibility = 'public'").join(public, "course_id", "left")
    return out, public.join(out.where("course is not null"), "course_id", "left_semi")


def own_threads(threads: DataFrame, viewers: DataFrame, limit: int = 50) -> DataFrame:
    """A viewer's own threads, or everyone's for admins, newest first. Each list is cut before it meets a viewer."""
    every = threads.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
    own = newest(threads, ["owner_id"], limit, "updated_at")
    rows = changeable(own, viewers.where("not admin")).unionAll(changeable(every, viewers.where("admin")))
    return newest(rows, ["viewer_id"], limit, "updated_at")


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"} | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in "\n\r\t\b\f"}


def quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is; null stays null."""
    for raw, shown in _ESCAPES.items():
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_object(fields: dict[str, Column]) -> Column:
    """JSON object of columns that are JSON already: keys sorted, no blanks."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items()))), F.lit("}"))


def json_map(c: Column) -> Column:
    """JSON object of a map of strings, in order of its keys; an empty one for null."""
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"])))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ","), F.lit("")), F.lit("}"))


def canonical_json(text: str | None) -> str:
    """JSON with sorted keys and no blanks, {} for none; NaN and infinity are refused."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} has no place in a key")

    return "{}" if text is None else json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


def cache_keys(specs: DataFrame) -> DataFrame:
    """Add ``key``: SHA-256 of the canonical JSON {inputs, model, params, stage, version}.

    specs: stage, version (string), model (null allowed), inputs (map of role to hash or key) and, if any, params (JSON
    object as text; null and none count as empty). Keys do not depend on the order of params or inputs.
    """
    params = F.pandas_udf(canonical, "string")("params") if "params" in specs.columns else F.lit("{}")
    fields = {"inputs": json_map(F.col("inputs")), "model": F.coalesce(quoted(F.col("model")), F.lit("null")), "params": params, "stage": quoted(F.col("stage")), "version": quoted(F.col("version").cast("string"))}
    return specs.withColumn("key", F.sha2(json_object(fields), 256))


def prompt_fingerprint(name: Column, text: Column) -> Column:
    return F.concat(name, F.lit("@"), F.substring(F.sha2(text, 256), 1, 12))


@dataclass(frozen=True)
class Stage:
    """A stage of the graph; inputs maps each role to the stage it comes from, or to None for the source's hash."""

    name: str
    version: str
    inputs: dict[str, str | None]
    model: str | None = None
    params: str | None = None


def chain_keys(roots: DataFrame, stages: list[Stage]) -> DataFrame:
    """(root_id, stage, key) of every stage of each root (root_id, content_hash); stages stand behind those they need.

    A stage's key takes its parents' keys, so a change re-keys what comes after it and nothing else. All keys of a
    root are columns of one row: no join. What a stage says of itself is JSON made once, on the driver.
    """
    said = lambda x: json.dumps(x, ensure_ascii=False)
    rows = roots.select("root_id", quoted(F.col("content_hash")).alias("source"))
    for s in stages:
        parents = [x for i, (role, parent) in enumerate(sorted(s.inputs.items())) for x in (F.lit("," * (i > 0) + said(role) + ":"), F.col("source") if parent is None else F.concat(F.lit('"'), f"key_{parent}", F.lit('"')))]
        fields = {"inputs": F.concat(F.lit("{"), *parents, F.lit("}")), **{k: F.lit(said(v)) for k, v in (("model", s.model), ("stage", s.name), ("version", s.version))}, "params": F.lit(canonical_json(s.params))}
        rows = rows.withColumn(f"key_{s.name}", F.sha2(json_object(fields), 256))
    keys = F.array(*(F.struct(F.lit(s.name).alias("stage"), F.col(f"key_{s.name}").alias("key")) for s in stages))
    return rows.select("root_id", F.explode(keys).alias("k")).select("root_id", "k.stage", "k.key")


def pending_work(specs: DataFrame, artifacts: DataFrame) -> DataFrame:
    return specs.join(artifacts.select("key").distinct(), "key", "left_anti")


def content_dedupe(files: DataFrame, content: str = "content") -> DataFrame:
    """(hash, files, first id): files of equal bytes are one piece of work."""
    return files.select("id", F.sha2(content, 256).alias("hash")).groupBy("hash").agg(F.count("*").alias("files"), F.min("id").alias("first"))

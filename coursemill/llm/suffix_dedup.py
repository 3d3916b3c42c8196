"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes need to be told apart through ``length`` bytes only. The sort takes digits, most significant first: a
digit is the code of half the depth. Suffixes start at chosen places (the smallest half-depth run of each window); the
first pass deals them to buckets by their leading digit and groups them, and only those that tie there go to the
second pass, in which the next digit is taken, to the right and to the left of the tie. Groups that are equal after
the last digit are exactly the repeated strings. A digit is a code, so the order is by code and not by bytes; and not
every suffix is moved, as its leading digit and place alone would be 12 bytes for each byte of text (windows.py says
which strings are moved, and why that is exact).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.windows import Kind, Texts, byte_tokens, repeated_windows

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _finish(content: bool, carried: bool):
    schema = SCHEMA if content else pa.schema(list(SCHEMA)[:5])
    schema = schema.append(pa.field("carried", pa.string())) if carried else schema

    def finish(t: Texts, spans: list[list[tuple[int, int]]]) -> pa.Table:
        rows = []
        for doc, null, text, extra, own in zip(t.ids.tolist(), t.null, t.texts, t.extra, spans, strict=True):
            ends = [0, *(y for _, y in own)]
            kept = b"".join(text[a:b].tobytes() for a, b in zip(ends, [*(x for x, _ in own), len(text)], strict=True))
            row = {"doc_id": None if null else doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(own), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            if content:
                row |= {"kept": kept, "removed": [{"start": a, "end": b} for a, b in own]}
            if carried:
                row["carried"] = extra.decode()
            rows.append(row)
        return pa.Table.from_pylist(rows, schema)

    return finish, schema


def suffix_dedup(docs: DataFrame, length: int = 100, content: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each byte covered by a ``length``-byte string that also starts earlier is removed.

    docs: doc_id long, text string; more columns are ignored. Earlier means a smaller doc_id, or the same document
    and a smaller start; strings overlap, never cross documents, and are judged on the input. ``length`` is even.
    Null text counts as empty; a null doc_id as larger than all others; rows that share a doc_id share their starts,
    so none of them is earlier than the other. An empty table gives no rows. Returns a row for each row with doc_id,
    n_bytes, n_removed, n_spans, kept_sha256 and, with ``content``, the kept bytes and the removed spans; the columns
    of ``carry`` (of a type that JSON can hold) follow their row unchanged.
    """
    if length < 4 or length % 2:
        raise ValueError("length must be even and at least 4")
    finish, schema = _finish(content, bool(carry))
    rows = docs.select("doc_id", "text", *([F.to_json(F.struct(*carry)).alias("extra")] if carry else []))
    out = repeated_windows(rows, Kind(length, byte_tokens, True), finish, schema)
    if carry:
        names = [c for c in out.columns if c != "carried"]
        out = out.withColumn("carried", F.from_json("carried", docs.select(*carry).schema)).select(*names, "carried.*")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 100, content=False)


ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM h WHERE length(h) >= 200)),
m AS (SELECT g, min((doc_id, i)) AS first FROM g GROUP BY g),
c AS (SELECT doc_id, i FROM g JOIN m USING (g) WHERE first < (doc_id, i)),
n AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS new FROM c),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM n) GROUP BY doc_id, r),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, count(*) AS spans, sum(b - a) AS gone, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * (SELECT max(b) FROM s WHERE s.doc_id = p.doc_id) + 1)) AS kept FROM p JOIN h USING (doc_id) GROUP BY p.doc_id)
SELECT h.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)
"""

"""Exact removal of repeated word sequences by level-wise doubling.

Level by level: sequences of ``start`` words are compared first; only those that repeat at that length are extended to
twice it, and so on up to ``length``, until no candidate survives (13, 25 and 50 words, or 25 and 50). A window whose
half occurs once cannot repeat, so most of the text leaves at the first level. Below ``length`` one run stands for
all windows that it is the smallest of (windows.py says why that is exact).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from coursemill.llm.windows import Kind, Texts, repeated_windows, word_tokens

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _finish(content: bool):
    schema = SCHEMA if content else pa.schema(list(SCHEMA)[:4])

    def finish(t: Texts, spans: list[list[tuple[int, int]]]) -> pa.Table:
        rows = []
        for doc, null, text, own in zip(t.ids.tolist(), t.null, t.texts, spans, strict=True):
            words = text.tobytes().split()
            ends = [0, *(y for _, y in own)]
            left = [w for a, b in zip(ends, [*(x for x, _ in own), len(words)], strict=True) for w in words[a:b]]
            kept = b" ".join(left)
            row = {"doc_id": None if null else doc, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            rows.append(row | {"kept_text": kept.decode()} if content else row)
        return pa.Table.from_pylist(rows, schema)

    return finish, schema


def substring_dedup(docs: DataFrame, length: int = 50, start: int = 25, content: bool = True) -> DataFrame:
    """Remove each word covered by a ``length``-word window that also starts in a document with a smaller doc_id.

    docs: doc_id long, text string; more columns are ignored. Words are runs of bytes other than ASCII white space
    (space, 9 to 13). Windows lie in one document and are judged on the input. ``length`` is even; ``start`` is the least
    length compared, and does not change the result. Null text has no words; a null doc_id counts as larger than all others; rows that share a doc_id never remove each other's
    words. An empty table gives no rows. Returns a row for each row: doc_id, n_words, n_removed, kept_sha256 and,
    with ``content``, kept_text (kept words joined by one space).
    """
    if length < 4 or length % 2 or start < 2:
        raise ValueError("length must be even and at least 4, start at least 2")
    finish, schema = _finish(content)
    return repeated_windows(docs.select("doc_id", "text"), Kind(length, word_tokens, False, start), finish, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), content=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN m USING (g) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

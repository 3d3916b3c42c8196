"""Queries over scores, costs and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursemill.operators import costs as C
from coursemill.operators import evals as E
from coursemill.operators import intervals as I
from coursemill.plans.views import sql_time, view, with_views
from coursemill.streaming import jobs as J

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(views, sql)
        return f

    return keep


REL = "SELECT DISTINCT q.query_id, g.lecture_id, g.segment_id FROM grid g JOIN answer_spans q USING (lecture_id) WHERE least(g.end_s, q.end_s) - greatest(g.start_s, q.start_s) > 0 AND least(g.end_s, q.end_s) - greatest(g.start_s, q.start_s) >= least(3, (q.end_s - q.start_s) / 2)"
SCORES = f"""(SELECT query_id, mode, coalesce(CAST(first <= 5 AS INT)::DOUBLE, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) z(i) WHERE i <= n) ELSE 0 END AS ndcg FROM (
  SELECT h.query_id, h.mode, min(CASE WHEN r.query_id IS NOT NULL THEN h.rank END) AS first, coalesce(sum(CASE WHEN r.query_id IS NOT NULL THEN 1 / log2(h.rank + 1) END), 0) AS dcg, (SELECT count(*) FROM ({REL}) c WHERE c.query_id = h.query_id) AS n
  FROM hits h LEFT JOIN ({REL}) r ON r.query_id = h.query_id AND r.lecture_id = h.lecture_id AND r.segment_id = h.segment_id WHERE h.rank <= 10 GROUP BY h.query_id, h.mode))"""


def scores(spark, d):
    rel = I.relevant(view(spark, d, "grid"), view(spark, d, "answer_spans").drop("kind"))
    return E.retrieval_scores(view(spark, d, "hits"), rel)


@query("h1_retrieval_scores", f"SELECT query_id, mode, recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM {SCORES}", "hits grid answer_spans")
def retrieval(spark, d):
    return scores(spark, d).withColumns({"mrr": F.round("mrr", 6), "ndcg": F.round("ndcg", 6)})


@query("h2_retrieval_summary", f"SELECT mode, kind, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM {SCORES} JOIN answer_spans USING (query_id) WHERE kind NOT IN ('structure', 'unanswerable') GROUP BY GROUPING SETS ((mode), (mode, kind))", "hits grid answer_spans")
def summary(spark, d):
    out = E.retrieval_summary(scores(spark, d), view(spark, d, "answer_spans").select("query_id", "kind"))
    return out.select("mode", "kind", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "n")


LATENCY = "(query_id * 37 + mode * 11) % 501 / 2"


def timed_summary(spark, d):
    latencies = view(spark, d, "hits").select("query_id", "mode").distinct().withColumn("latency_ms", F.expr(LATENCY))
    return E.retrieval_summary(scores(spark, d), view(spark, d, "answer_spans").select("query_id", "kind"), latencies)


TIMED = f"SELECT mode, kind, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg, median({LATENCY}) AS latency, count(*) AS n FROM {SCORES} JOIN answer_spans USING (query_id) WHERE kind NOT IN ('structure', 'unanswerable') GROUP BY GROUPING SETS ((mode), (mode, kind))"


@query("h2_median_latency", f"SELECT mode, kind, latency AS median_latency_ms, n FROM ({TIMED})", "hits grid answer_spans")
def median_latency(spark, d):
    return timed_summary(spark, d).select("mode", "kind", "median_latency_ms", "n")


@query("a11_retrieval_report", f""", t AS MATERIALIZED ({TIMED}), k AS (SELECT DISTINCT kind FROM t WHERE kind IS NOT NULL)
  SELECT (SELECT max(n) FROM t WHERE kind IS NULL) || ' questions, 50 segments, K = 10' || chr(10) || chr(10) || '| Mode | Recall@5 | MRR@10 | nDCG@10 | Median latency |' || chr(10) || '|---|---|---|---|---|' || chr(10)
    || (SELECT string_agg('| ' || mode || printf(' | %.2f | %.2f | %.2f | %.0f ms |', recall, mrr, ndcg, latency), chr(10) ORDER BY mode) FROM t WHERE kind IS NULL) || chr(10) || chr(10) || 'Recall@5 by kind of question:' || chr(10) || chr(10)
    || '| Mode | ' || (SELECT string_agg(kind, ' | ' ORDER BY kind) FROM k) || ' |' || chr(10) || '|---|' || repeat('---|', (SELECT count(*)::INT FROM k)) || chr(10)
    || (SELECT string_agg('| ' || mode || ' | ' || cells || ' |', chr(10) ORDER BY mode) FROM (SELECT m.mode, string_agg(printf('%.2f', coalesce(t.recall, 0)), ' | ' ORDER BY k.kind) AS cells FROM (SELECT DISTINCT mode FROM t) m CROSS JOIN k LEFT JOIN t ON t.mode = m.mode AND t.kind = k.kind GROUP BY m.mode)) AS markdown""", "hits grid answer_spans")
def retrieval_report(spark, d):
    return E.retrieval_report(timed_summary(spark, d), 50)


SQL["a11_retrieval_report"] = SQL["a11_retrieval_report"].replace(") , t AS", "), t AS", 1)


@query("a11_score_tables", f"SELECT mode, '| ' || mode || ' | ' || printf('%.2f', coalesce(avg(recall) FILTER (kind = 'code'), 0)) || ' | ' || printf('%.2f', coalesce(avg(recall) FILTER (kind = 'concept'), 0)) || ' | ' || printf('%.2f', coalesce(avg(recall) FILTER (kind = 'fact'), 0)) || ' |' AS line FROM {SCORES} JOIN answer_spans USING (query_id) GROUP BY mode", "hits grid answer_spans")
def table(spark, d):
    return E.score_table(E.retrieval_summary(scores(spark, d), view(spark, d, "answer_spans").select("query_id", "kind")))


CHECKS = "SELECT l_suppkey % 25 AS run_id, CASE l_linenumber WHEN 1 THEN 'unanswerable' ELSE 'fact' END AS kind, CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'R' THEN 'partial' ELSE 'wrong' END AS verdict, l_partkey % 9 = 0 AS declined, l_partkey % 3 = 0 AS supported, l_partkey % 31 = 0 AS error, l_partkey % 4 AS n_citations, l_partkey % 4 - CASE WHEN l_partkey % 4 > 2 THEN 1 ELSE 0 END AS n_valid, l_partkey % 5 = 1 AS on_target, CAST(l_quantity * 100 AS INT) AS total_ms, l_partkey AS tokens FROM {lineitem}"


@query(
    "h3_answer_metrics",
    f"""SELECT run_id, coalesce(avg(CASE WHEN declined THEN 0 WHEN verdict = 'correct' THEN 1 WHEN verdict = 'partial' THEN 0.5 ELSE 0 END) FILTER (kind <> 'unanswerable'), 0) AS correctness,
  coalesce(avg(supported::INT) FILTER (kind <> 'unanswerable' AND NOT declined AND NOT error), 1) AS faithfulness, count(*) FILTER (kind <> 'unanswerable' AND declined) AS false_declines,
  coalesce(avg((declined AND n_valid = 0)::INT) FILTER (kind = 'unanswerable'), 1) AS declines, coalesce(sum(n_valid)::DOUBLE / sum(n_citations), 1) AS citations_valid,
  coalesce(avg(on_target::INT) FILTER (kind <> 'unanswerable' AND NOT declined AND NOT error), 0) AS on_target, count(*) FILTER (error) AS errors, quantile_disc(total_ms, 0.5) AS p50, quantile_disc(total_ms, 0.95) AS p95, avg(tokens) AS tokens FROM ({CHECKS.format(lineitem="lineitem")}) GROUP BY run_id""",
)
def answer_metrics(spark, d):
    return E.answer_metrics(spark.sql(CHECKS, lineitem=view(spark, d, "lineitem")))


def transcripts(spark, d):
    docs = view(spark, d, "documents")
    words = F.split(F.lower("text"), r"[ \n\t\r]+")
    return docs.select(F.col("doc_id").alias("key"), words.alias("ref"), F.filter(F.transform(words, lambda w, i: F.when(i % 7 == 3, F.concat(w, F.lit("x"))).when(i % 11 == 5, "").otherwise(w)), lambda w: w != "").alias("hyp"))


@query("h4_word_error_rate")
def wer(spark, d):
    return E.word_error_rate(transcripts(spark, d)).select("key", "substitutions", "deletions", "insertions", "wer")


@query("h27_variant_scores")
def variants(spark, d):
    scored = E.word_error_rate(transcripts(spark, d).withColumn("variant", F.col("key") % 3))
    ref = E.ngram_counts(said(spark, d), terms(spark))
    recall = ref.select((F.col("key") % 3).alias("variant"), F.col("n").alias("said"), (F.floor(F.col("n") / 2) + 1).alias("heard"))
    runs = view(spark, d, "documents").select((F.col("doc_id") % 3).alias("variant"), (F.col("n_chars") / 50).alias("seconds"), (F.col("n_chars") / 12).alias("audio_s"), (F.col("doc_id") % 40).alias("mb_before"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("mb_peak"))
    return E.variant_scores(scored, recall, runs)


def said(spark, d):
    docs = view(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("key"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))


def terms(spark):
    return spark.createDataFrame([("the of", ["the", "of"]), ("and", ["ands"]), ("in the", ["in", "the"])], "term string, tokens array<string>")


STEMMED = r"SELECT doc_id AS key, ' ' || array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[1 : length(t) - 1] ELSE t END), '  ') || ' ' AS s FROM documents"


@query("h5_term_counts", f"SELECT key, term, n FROM (SELECT key, term, len(regexp_extract_all(s, g)) AS n FROM ({STEMMED}), (VALUES ('the of', ' the  of '), ('and', ' and '), ('in the', ' in  the ')) v(term, g)) WHERE n > 0")
def term_counts(spark, d):
    return E.ngram_counts(said(spark, d), terms(spark))


@query("h5_term_recall", f"SELECT key, coalesce(sum(least(n, n // 2 + 1))::DOUBLE / nullif(sum(n), 0), 1) AS recall FROM (SELECT key, len(regexp_extract_all(s, g)) AS n FROM ({STEMMED}), (VALUES (' the  of '), (' and '), (' in  the ')) v(g)) GROUP BY key")
def term_recall(spark, d):
    ref = E.ngram_counts(said(spark, d), terms(spark))
    hyp = ref.withColumn("n", F.floor(F.col("n") / 2) + 1)
    return E.term_recall(ref, hyp, said(spark, d).select("key"))


@query("b24_occurrences", "SELECT lecture_id, term, start_ds AS at FROM (SELECT lecture_id, start_ds, w AS a, lead(w) OVER (PARTITION BY lecture_id ORDER BY pos) AS b FROM (SELECT lecture_id, pos, start_ds, CASE WHEN length(word) > 3 AND lower(word) LIKE '%s' AND lower(word) NOT LIKE '%ss' THEN lower(word[1 : length(word) - 1]) ELSE lower(word) END AS w FROM words)) JOIN (VALUES ('the of', 'the', 'of'), ('in the', 'in', 'the'), ('and', 'and', NULL)) v(term, x, y) ON a = x AND (y IS NULL OR b = y)", "words")
def occurrences(spark, d):
    stream = view(spark, d, "words").select("lecture_id", "pos", F.lower("word").alias("word"), F.col("start_ds").alias("at"))
    plain = spark.createDataFrame([("the of", ["the", "of"]), ("and", ["and"]), ("in the", ["in", "the"])], "term string, tokens array<string>")
    return E.occurrences(stream, plain)


BAGS = r"SELECT deck_id, slide_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM lines"
OVERLAP = f""", s AS ({BAGS}), f AS (SELECT deck_id, slide_id, slide_id % 3 = 0 AS page, tokens FROM s),
  a AS (SELECT deck_id, slide_id, token, count(*) AS n FROM (SELECT deck_id, slide_id, unnest(tokens) AS token FROM s) GROUP BY ALL), b AS (SELECT a.* FROM a WHERE slide_id % 3 = 0),
  c AS (SELECT a.deck_id, a.slide_id, b.slide_id AS page, sum(least(a.n, b.n)) AS common FROM a JOIN b USING (deck_id, token) GROUP BY ALL),
  p AS (SELECT x.deck_id, x.slide_id, y.slide_id AS page, len(x.tokens) AS na, len(y.tokens) AS nb, coalesce(c.common, 0) AS common FROM s x JOIN s y ON x.deck_id = y.deck_id AND y.slide_id % 3 = 0 LEFT JOIN c ON c.deck_id = x.deck_id AND c.slide_id = x.slide_id AND c.page = y.slide_id),
  q AS (SELECT *, CASE WHEN na + nb > 0 THEN 2.0::DOUBLE * common / (na + nb) ELSE 0 END AS f1 FROM p), o AS (SELECT deck_id, slide_id, page, CASE WHEN na > 0 THEN common::DOUBLE / na ELSE 0 END AS precision, CASE WHEN nb > 0 THEN common::DOUBLE / nb ELSE 0 END AS recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_id ORDER BY f1 DESC, page) AS n FROM q) WHERE n = 1)"""


def decks(spark, d):
    lines = view(spark, d, "lines").select("deck_id", "slide_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    return lines, lines.where("slide_id % 3 = 0").withColumnRenamed("slide_id", "page")


@query("h6_slide_overlap", OVERLAP + " SELECT deck_id, slide_id, page, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM o", "lines")
def slide_overlap(spark, d):
    out = E.slide_overlap(*decks(spark, d))
    return out.select("deck_id", "slide_id", "page", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("h7_slide_summary", OVERLAP + ", r AS (SELECT *, CASE WHEN slide_id % 2 = 0 THEN 'ocr' ELSE 'vlm' END AS reader, slide_id % 5 > 0 AS titled FROM o) SELECT reader, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, avg((reader = 'ocr')::INT) AS by_ocr, round(avg(titled::INT), 6) AS titled FROM r GROUP BY GROUPING SETS ((), (reader))", "lines")
def slide_summary(spark, d):
    rows = E.slide_overlap(*decks(spark, d)).withColumns({"reader": F.when(F.col("slide_id") % 2 == 0, "ocr").otherwise("vlm"), "title": F.when(F.col("slide_id") % 5 > 0, "t").otherwise("")})
    return E.slide_summary(rows).select("reader", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "by_ocr", F.round("titled", 6).alias("titled"))


@query("h26_worst_cases", OVERLAP + " SELECT deck_id, slide_id, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY f1, slide_id) AS n FROM o) WHERE n <= 3", "lines")
def worst(spark, d):
    return E.worst_cases(E.slide_overlap(*decks(spark, d)), "f1", ["slide_id"], 3, ["deck_id"]).select("deck_id", "slide_id", F.round("f1", 6).alias("f1"))


@query("i8_best_page", f", s AS ({BAGS}), e AS (SELECT deck_id, slide_id, list_distinct(tokens) AS t FROM s) SELECT deck_id, slide_id, page, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_id ORDER BY j DESC, page) AS n FROM (SELECT a.deck_id, a.slide_id, b.slide_id AS page, len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS j FROM e a JOIN e b ON a.deck_id = b.deck_id AND b.slide_id % 3 = 0 WHERE len(list_intersect(a.t, b.t)) > 0)) WHERE n = 1", "lines")
def best_page(spark, d):
    return E.best_page(*decks(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


for name in ("h6_slide_overlap", "h7_slide_summary", "h26_worst_cases", "i8_best_page"):
    SQL[name] = SQL[name].replace(") , s AS", "), s AS", 1)

CHAPTERS = "SELECT o_custkey AS lecture_id, o_orderkey AS ord, CAST(o_orderkey % 1000 + 10 AS DOUBLE) AS start_s, CAST(o_orderkey % 1000 + 7 + o_custkey % 97 AS DOUBLE) AS end_s FROM {orders}"
ITEMS = "SELECT o_custkey AS lecture_id, CASE l_linenumber % 3 WHEN 0 THEN 'concepts' WHEN 1 THEN 'formulas' ELSE 'quiz' END AS kind, l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey % 900 AS DOUBLE) AS at_s FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"


def notes(spark, d):
    c = spark.sql(CHAPTERS, orders=view(spark, d, "orders"))
    items = spark.sql(ITEMS, orders=view(spark, d, "orders"), lineitem=view(spark, d, "lineitem"))
    return c, items, c.select("lecture_id").distinct().where("lecture_id % 11 > 0").withColumn("duration_s", F.when(F.col("lecture_id") % 7 > 0, 800.0).otherwise(0.0))


CHECKED = f"""ch AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) - 1 AS i, lag(end_s) OVER (PARTITION BY lecture_id ORDER BY ord) AS b, CASE WHEN lecture_id % 11 > 0 THEN CASE WHEN lecture_id % 7 > 0 THEN 800.0 ELSE 0 END END AS d FROM ({CHAPTERS.format(orders="orders")})),
  ci AS (SELECT lecture_id, 'chapters[' || i || '].start' AS label, start_s AS at_s FROM ch UNION ALL SELECT lecture_id, 'chapters[' || i || '].end', end_s FROM ch UNION ALL SELECT lecture_id, kind || '[' || (row_number() OVER (PARTITION BY lecture_id, kind ORDER BY ord, at_s) - 1) || ']', at_s FROM ({ITEMS.format(orders="orders", lineitem="lineitem")})),
  cited AS (SELECT *, lecture_id % 11 > 0 AND lecture_id % 7 > 0 AND at_s > 802 AS o FROM ci)"""


@query("h8_note_issues", f"""WITH {CHECKED} SELECT lecture_id, issue FROM (SELECT lecture_id, CASE WHEN end_s <= start_s THEN 'chapters[' || i || '] ends before it starts (' || {sql_time('start_s')} || '-' || {sql_time('end_s')} || ')' END AS issue FROM ch
  UNION ALL SELECT lecture_id, CASE WHEN start_s - b > 2 THEN CAST(start_s - b AS INT) || 's gap between chapters[' || (i - 1) || '] and chapters[' || i || ']' WHEN start_s - b < -2 THEN 'chapters[' || (i - 1) || '] and chapters[' || i || '] overlap by ' || CAST(b - start_s AS INT) || 's' END FROM ch
  UNION ALL SELECT lecture_id, CASE WHEN o THEN label || ' at ' || {sql_time('at_s')} || ' is outside the video (length 13:20)' END FROM cited) WHERE issue IS NOT NULL""")
def issues(spark, d):
    return E.note_checks(*notes(spark, d))[0]


@query("h8_note_coverage", f"""WITH {CHECKED}, c AS (SELECT lecture_id, greatest(start_s, 0) AS a, least(end_s, 800) AS b FROM ch WHERE end_s > start_s AND d > 0), r AS (SELECT *, max(b) OVER (PARTITION BY lecture_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c), v AS (SELECT lecture_id, sum(greatest(b - greatest(a, coalesce(r, a)), 0)) AS v FROM r GROUP BY 1)
  SELECT lecture_id, count(*) AS timestamps, sum(o::INT) AS out_of_range, CASE WHEN lecture_id % 11 > 0 AND lecture_id % 7 > 0 THEN round(coalesce(any_value(v), 0) / 800, 6) END AS coverage FROM cited LEFT JOIN v USING (lecture_id) GROUP BY lecture_id""")
def coverage(spark, d):
    return E.note_checks(*notes(spark, d))[1].withColumn("coverage", F.round("coverage", 6))


@query("h9_concept_accuracy", "SELECT source, avg((distance IS NOT NULL)::INT) AS checkable, avg((distance <= 10)::INT) AS near, median(distance) AS median FROM (SELECT event_type AS source, CASE WHEN user_id % 5 > 0 THEN floor(value) END AS distance FROM events) GROUP BY 1")
def concepts(spark, d):
    return E.concept_accuracy(view(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("user_id") % 5 > 0, F.floor("value").cast("double")).alias("distance")), ["source"])


@query("h25_notes_comparison", "SELECT source, avg((distance IS NOT NULL)::INT) AS checkable, avg((distance <= 10)::INT) AS near, median(distance) AS median FROM (SELECT user_id % 2 AS source, CASE WHEN event_type <> 'error' THEN floor(value) END AS distance FROM events) GROUP BY 1")
def comparison(spark, d):
    return E.concept_accuracy(view(spark, d, "events").select((F.col("user_id") % 2).alias("source"), F.when(F.col("event_type") != "error", F.floor("value").cast("double")).alias("distance")), ["source"])


METRICS = "SELECT concat('suite', l_suppkey % 6) AS suite, concat('m', l_linenumber) AS metric, round(avg(l_discount), 6) AS value FROM {lineitem} WHERE l_linenumber <> 4 AND l_suppkey % 6 < 4 GROUP BY 1, 2"


@query("h10_gate", f"SELECT * FROM (SELECT t.suite, t.metric, m.value, t.min, t.max FROM (SELECT 'suite' || s AS suite, 'm' || k AS metric, CASE WHEN k % 2 = 0 THEN 0.05::DOUBLE END AS min, CASE WHEN k % 2 = 1 THEN 0.05::DOUBLE END AS max FROM range(0, 6) a(s), range(1, 6) b(k)) t LEFT JOIN ({METRICS.format(lineitem='lineitem')}) m USING (suite, metric) WHERE t.suite IN (SELECT suite FROM ({METRICS.format(lineitem='lineitem')}))) WHERE value IS NULL OR value < min OR value > max")
def gate(spark, d):
    bounds = spark.createDataFrame([(f"suite{s}", f"m{k}", 0.05 if k % 2 == 0 else None, 0.05 if k % 2 == 1 else None) for s in range(6) for k in range(1, 6)], "suite string, metric string, min double, max double")
    return E.gate(spark.sql(METRICS, lineitem=view(spark, d, "lineitem")), bounds).select("suite", "metric", "value", "min", "max")


@query("h19_routing_scores", "SELECT doc_id % 4 AS run, count(*) AS frames, sum(toxic) AS routed, count(*) FILTER (quality = toxic) AS agree, coalesce(sum(quality * toxic)::DOUBLE / nullif(sum(toxic), 0), 0) AS precision, coalesce(sum(quality * toxic)::DOUBLE / nullif(sum(quality), 0), 0) AS recall, coalesce(2.0::DOUBLE * sum(quality * toxic) / nullif(sum(toxic) + sum(quality), 0), 0) AS f1 FROM labels GROUP BY 1")
def routing(spark, d):
    frames = view(spark, d, "labels").select((F.col("doc_id") % 4).alias("run"), (F.col("quality") == 1).alias("reference"), (F.col("toxic") == 1).alias("answer"))
    return E.routing_scores(frames, ["run"])


@query("h22_vector_drift", "SELECT round(avg(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))), 6) AS cosine, count(*) AS n FROM (SELECT a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def drift(spark, d):
    v = view(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense"))
    return E.vector_drift(v, v.withColumn("vec_id", F.col("vec_id") - 1), "vec_id").withColumn("cosine", F.round("cosine", 6))


PRICED = "(SELECT s.*, (SELECT arg_max(p.input, p.ord) FROM prices p WHERE p.model = s.model AND p.since <= CAST(s.started_at AS DATE)) AS input, (SELECT arg_max(p.output, p.ord) FROM prices p WHERE p.model = s.model AND p.since <= CAST(s.started_at AS DATE)) AS output FROM stages s)"


@query("d9_price_asof", f"SELECT run_id, stage, part, model, input, output FROM {PRICED}", "stages prices")
def price(spark, d):
    return C.price_asof(view(spark, d, "stages"), view(spark, d, "prices"), "started_at").select("run_id", "stage", "part", "model", "input", "output")


@query("h12_token_cost", f"SELECT run_id, stage, part, round((input_tokens * input + output_tokens * output) / 1e6, 9) AS cost FROM {PRICED}", "stages prices")
def token_cost(spark, d):
    priced = C.price_asof(view(spark, d, "stages"), view(spark, d, "prices"), "started_at")
    return priced.select("run_id", "stage", "part", F.round(C.token_cost(F.col("input_tokens"), F.col("output_tokens")), 9).alias("cost"))


EXTRA = {"audio": "part % 700", "tools": "part % 90", "thinking": "part % 401", "input_audio": "CASE WHEN model = 'm0' THEN 0.9 END", "threshold": "CASE model WHEN 'm1' THEN 40000 WHEN 'm2' THEN 20000 END", "long_input": "CASE model WHEN 'm1' THEN 2.5 WHEN 'm2' THEN 0 END", "long_output": "CASE WHEN model = 'm1' THEN 15.0 END"}


@query("h12_request_cost", f"""SELECT run_id, stage, part, round(((input_tokens + {EXTRA['tools']}) * CASE WHEN long AND coalesce({EXTRA['long_input']}, 0) > 0 THEN {EXTRA['long_input']} ELSE input END + {EXTRA['audio']} * coalesce({EXTRA['input_audio']}, CASE WHEN long AND coalesce({EXTRA['long_input']}, 0) > 0 THEN {EXTRA['long_input']} ELSE input END)
  + (output_tokens + {EXTRA['thinking']}) * CASE WHEN long AND {EXTRA['long_output']} > 0 THEN {EXTRA['long_output']} ELSE output END) / 1e6, 9) AS cost FROM (SELECT *, coalesce(input_tokens + {EXTRA['audio']} > {EXTRA['threshold']}, false) AS long FROM {PRICED})""", "stages prices")
def request_cost(spark, d):
    """Audio, tools, thinking and long prompts."""
    priced = C.price_asof(view(spark, d, "stages"), view(spark, d, "prices"), "started_at")
    priced = priced.withColumns({n: F.expr(EXTRA[n]) for n in ("input_audio", "long_input", "long_output")} | {"long_context_threshold": F.expr(EXTRA["threshold"])})
    cost = C.token_cost(F.col("input_tokens"), F.col("output_tokens"), *(F.expr(EXTRA[n]) for n in ("audio", "tools", "thinking")))
    return priced.select("run_id", "stage", "part", F.round(cost.cast("double"), 9).alias("cost"))


@query("h11_run_cost", f"SELECT run_id, CASE WHEN max((c IS NULL AND NOT cached)::INT) = 0 THEN round(sum(CASE WHEN NOT cached THEN c ELSE 0 END), 8) END AS cost, round(sum(c), 8) AS all_in FROM (SELECT *, (input_tokens * input + output_tokens * output) / 1e6 AS c FROM {PRICED}) GROUP BY run_id", "stages prices")
def run_cost(spark, d):
    return C.run_cost(view(spark, d, "stages"), view(spark, d, "prices")).select("run_id", F.round("cost", 8).alias("cost"), F.round("all_in", 8).alias("all_in"))


@query("h13_answer_cost", f"SELECT run_id, stage, part, round(c, 9) AS shown, coalesce(round(c, 9), 0) AS charged FROM (SELECT *, (input_tokens * input + output_tokens * output) / 1e6 AS c FROM {PRICED})", "stages prices")
def answer_cost(spark, d):
    out = C.answer_cost(view(spark, d, "stages"), view(spark, d, "prices"))
    return out.select("run_id", "stage", "part", F.round("shown", 9).alias("shown"), F.round("charged", 9).alias("charged"))


@query("h14_first_uncached_stage", ", r AS (SELECT lecture_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY started_at DESC, run_id DESC) AS n FROM (SELECT DISTINCT lecture_id, run_id, started_at FROM stages)) WHERE n <= 5) SELECT lecture_id, arg_min(seconds, (started_at, run_id, part)) AS seconds FROM stages JOIN r USING (lecture_id, run_id) WHERE stage = 'stage2' AND NOT cached GROUP BY 1", "stages")
def uncached(spark, d):
    return C.first_uncached_stage(view(spark, d, "stages"), "stage2", 5)


SQL["h14_first_uncached_stage"] = SQL["h14_first_uncached_stage"].replace(") , r AS", "), r AS", 1)


@query("h14_real_time_factor", ", u AS (SELECT lecture_id, arg_min(seconds, (started_at, run_id, part)) AS seconds FROM stages JOIN (SELECT lecture_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY started_at DESC, run_id DESC) AS n FROM (SELECT DISTINCT lecture_id, run_id, started_at FROM stages)) WHERE n <= 5) r USING (lecture_id, run_id) WHERE stage = 'stage2' AND NOT cached GROUP BY 1), l AS (SELECT DISTINCT lecture_id, lecture_id % 7 * 600.0 AS duration_s FROM stages) SELECT lecture_id, u.seconds, round(CASE WHEN u.seconds <> 0 AND duration_s <> 0 THEN u.seconds / duration_s END, 9) AS real_time_factor FROM l LEFT JOIN u USING (lecture_id)", "stages")
def real_time(spark, d):
    stages = view(spark, d, "stages")
    lectures = stages.select("lecture_id").distinct().withColumn("duration_s", F.col("lecture_id") % 7 * 600.0)
    return C.real_time_factor(stages, lectures, "stage2", 5).withColumn("real_time_factor", F.round("real_time_factor", 9))


SQL["h14_real_time_factor"] = SQL["h14_real_time_factor"].replace(") , u AS", "), u AS", 1)


@query("h15_stage_stats", "SELECT stage, cached, count(*) AS runs, sum(seconds) AS seconds FROM stages GROUP BY ALL", "stages")
def stage_stats(spark, d):
    return C.stage_stats(view(spark, d, "stages"))


@query("h15_cache_hits", "SELECT stage, round(avg(cached::INT), 9) AS hits FROM stages GROUP BY 1", "stages")
def hits(spark, d):
    return C.cache_hits(view(spark, d, "stages")).withColumn("hits", F.round("hits", 9))


@query("h15_stage_histogram", "SELECT stage, len(list_filter([0.1, 0.25, 0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500], lambda b: seconds > b)) AS bucket, count(*) AS n FROM stages GROUP BY ALL", "stages")
def histogram(spark, d):
    return C.histogram(view(spark, d, "stages"), "seconds", C.STAGE_BOUNDS, ["stage"])


@query("h16_llm_usage_stats", "SELECT model, stage AS purpose, d AS direction, sum(CASE d WHEN 'input' THEN input_tokens ELSE output_tokens END) AS tokens FROM stages, (VALUES ('input'), ('output')) v(d) WHERE NOT cached GROUP BY ALL", "stages")
def usage(spark, d):
    return C.llm_usage_stats(view(spark, d, "stages").withColumnRenamed("stage", "purpose"))


@query("h16_llm_cost_stats", f"SELECT model, stage AS purpose, round(sum(coalesce((input_tokens * input + output_tokens * output) / 1e6, 0)), 9) AS cost FROM {PRICED} WHERE NOT cached GROUP BY ALL", "stages prices")
def llm_costs(spark, d):
    return C.llm_cost_stats(view(spark, d, "stages").withColumnRenamed("stage", "purpose"), view(spark, d, "prices")).withColumn("cost", F.round("cost", 9))


LATENCIES = "SELECT event_type AS scope, user_id % 2 = 0 AS ok, CASE WHEN user_id % 5 > 0 THEN value * 20 END AS first_token_ms, value * 100 AS total_ms FROM {events}"
HISTOGRAM = f"SELECT scope, ok, metric, len(list_filter([250, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 30000], lambda b: ms > b)) AS bucket, count(*) AS n FROM (SELECT scope, ok, metric, CASE metric WHEN 'total_ms' THEN total_ms ELSE first_token_ms END AS ms FROM ({LATENCIES.format(events='events')}), (VALUES ('first_token_ms'), ('total_ms')) v(metric)) WHERE ms IS NOT NULL GROUP BY ALL"


@query("h17_latency_histograms", HISTOGRAM)
def latency_histograms(spark, d):
    return C.latency_histograms(spark.sql(LATENCIES, events=view(spark, d, "events")), ["scope", "ok"])


def streamed(spark, d, name):
    """A table as a stream; the pattern lets its one file count as new."""
    return spark.readStream.schema(view(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def streamed_stages(spark, d):
    from coursemill.plans.views import VIEWS

    return spark.sql(VIEWS["stages"][1], lineitem=streamed(spark, d, "lineitem"), orders=view(spark, d, "orders"))


@query("h17_latency_histograms_stream", HISTOGRAM)
def latency_histograms_stream(spark, d):
    return J.run_to_end(C.latency_histograms(spark.sql(LATENCIES, events=streamed(spark, d, "events")), ["scope", "ok"]))


@query("h15_stage_stats_stream", "SELECT stage, cached, count(*) AS runs, sum(seconds) AS seconds FROM stages GROUP BY ALL", "stages")
def stage_stats_stream(spark, d):
    return J.run_to_end(C.stage_stats(streamed_stages(spark, d)))


@query("h16_llm_usage_stats_stream", "SELECT model, stage AS purpose, d AS direction, sum(CASE d WHEN 'input' THEN input_tokens ELSE output_tokens END) AS tokens FROM stages, (VALUES ('input'), ('output')) v(d) WHERE NOT cached GROUP BY ALL", "stages")
def usage_stream(spark, d):
    return J.run_to_end(C.llm_usage_stats(streamed_stages(spark, d).withColumnRenamed("stage", "purpose")))


@query("h24_feedback_share_stream", "SELECT count(*) AS ratings, count(*) FILTER (event_type = 'click') AS up, avg((event_type = 'click')::INT) AS helpful FROM events WHERE event_type IN ('click', 'view')")
def feedback_stream(spark, d):
    e = streamed(spark, d, "events").where("event_type in ('click', 'view')")
    return J.run_to_end(C.feedback_share(e.select(F.when(F.col("event_type") == "click", "up").otherwise("down").alias("rating"))))


@query("h26_missed_terms", f"SELECT key, term, n AS said, n // 2 AS heard FROM (SELECT key, term, len(regexp_extract_all(s, g)) AS n FROM ({STEMMED}), (VALUES ('the of', ' the  of '), ('and', ' and '), ('in the', ' in  the ')) v(term, g)) WHERE n > 0")
def missed(spark, d):
    ref = E.ngram_counts(said(spark, d), terms(spark))
    return E.missed_terms(ref, ref.withColumn("n", F.floor(F.col("n") / 2)).where("n > 0"), ["key"])


@query("h26_far_concepts", "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN floor(value) END AS distance FROM events WHERE user_id % 5 = 0 OR floor(value) > 10")
def far(spark, d):
    return E.far_concepts(view(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 > 0, F.floor("value").cast("double")).alias("distance")))


@query("h26_imperfect_answers", f"SELECT run_id, tokens, total_ms FROM ({CHECKS.format(lineitem='lineitem')}) WHERE CASE WHEN kind = 'unanswerable' THEN NOT declined ELSE declined OR verdict <> 'correct' END")
def imperfect(spark, d):
    return E.imperfect_answers(spark.sql(CHECKS, lineitem=view(spark, d, "lineitem"))).select("run_id", "tokens", "total_ms")


@query("h17_latency_stats", "SELECT event_type AS scope, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS ms FROM events) GROUP BY 1")
def latency(spark, d):
    return C.latency_stats(view(spark, d, "events").select(F.col("event_type").alias("scope"), F.floor(F.col("value") * 100).alias("ms")), ["scope"], "ms")


@query("h18_cost_per_hour", f"SELECT round(sum(c) / (sum(d) / 3600), 6) AS cost_per_hour, round(sum(s) / (sum(d) / 3600), 6) AS seconds_per_hour FROM (SELECT lecture_id, sum((input_tokens * input + output_tokens * output) / 1e6) AS c, sum(seconds) AS s, 3000.0 + lecture_id % 7 AS d FROM {PRICED} GROUP BY lecture_id)", "stages prices")
def per_hour(spark, d):
    stages = view(spark, d, "stages")
    lectures = stages.select("lecture_id").distinct().withColumn("duration_s", 3000.0 + F.col("lecture_id") % 7)
    return C.cost_per_hour(stages, view(spark, d, "prices"), lectures).select(*[F.round(c, 6).alias(c) for c in ("cost_per_hour", "seconds_per_hour")])


@query("h24_feedback_share", "SELECT count(*) AS ratings, count(*) FILTER (event_type = 'click') AS up, avg((event_type = 'click')::INT) AS helpful FROM events WHERE event_type IN ('click', 'view')")
def feedback(spark, d):
    e = view(spark, d, "events").where("event_type in ('click', 'view')")
    return C.feedback_share(e.select(F.when(F.col("event_type") == "click", "up").otherwise("down").alias("rating")))


def detections(spark, d):
    b = view(spark, d, "boxes").withColumn("image_id", F.col("deck_id"))
    truth = b.where("line_no % 2 = 0")
    moved = truth.select("image_id", "label", *[(F.col(c) + F.col("line_no")).alias(c) for c in ("x1", "y1", "x2", "y2")], "score", F.xxhash64("slide_id", "line_no", "x1", "y1").alias("det_id"))
    return E.detection_ap(truth, moved)


@query("h21_detection_ap")
def ap(spark, d):
    return detections(spark, d)


@query("h21_mean_ap")
def mean_ap(spark, d):
    return E.mean_ap(detections(spark, d))

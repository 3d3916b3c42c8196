"""Queries over search and question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursemill.operators import lexical_index as LI
from coursemill.operators import qa as A
from coursemill.operators import search as S
from coursemill.plans.views import sql_escape, sql_time, view, with_views
from coursemill.session import shared_path

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(views, sql)
        return f

    return keep


STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({STOP}))"
POSTINGS = f"SELECT doc_id AS chunk_id, term, doc_len, count(*) AS tf FROM (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM (SELECT doc_id, {TERMS} AS t FROM documents)) GROUP BY ALL"
BM25 = f"""WITH p AS MATERIALIZED ({POSTINGS}), q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS})) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(l) FROM (SELECT any_value(doc_len) AS l FROM p GROUP BY chunk_id)) AS total),
  h AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / (total / n)))), 9) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h) WHERE rank <= 30)"""


def chunks(spark, d):
    return view(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark, d):
    return view(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("e4_bm25_postings", f"SELECT * FROM ({POSTINGS})")
def postings(spark, d):
    return S.bm25_postings(chunks(spark, d), stem=False)


@query("e4_bm25_stats", f"SELECT term, count(*) AS df FROM ({POSTINGS}) GROUP BY term")
def stats(spark, d):
    return S.bm25_stats(S.bm25_postings(chunks(spark, d), stem=False), chunks(spark, d))[0]


def bm25(spark, d, limit=30):
    return S.bm25_search(questions(spark, d), S.bm25_postings(chunks(spark, d), stem=False), chunks(spark, d), limit, stem=False)


@query("e6_bm25_search", f"{BM25} SELECT query_id, chunk_id, rank FROM bm")
def bm25_search(spark, d):
    return bm25(spark, d).select("query_id", "chunk_id", "rank")


def vectors(spark, d):
    return view(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


DENSE = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label = b.label AS same, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS score FROM n a, n b WHERE a.vec_id % 20 = 0{}))"""


@query("e5_dense_search", DENSE.format("") + " SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 30")
def dense(spark, d):
    return S.dense_search(vector_queries(spark, d), vectors(spark, d), 30).select("query_id", "chunk_id", "rank")


@query("e5_dense_search_scoped", DENSE.format(" AND a.label = b.label") + " SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 10")
def dense_scoped(spark, d):
    return S.dense_search(vector_queries(spark, d), vectors(spark, d), 10, scope="label").select("query_id", "chunk_id", "rank")


@query("e7_rrf_fuse", f"{BM25}, other AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM bm), f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT * FROM other WHERE rank <= 20) GROUP BY ALL) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 6")
def fuse(spark, d):
    from pyspark.sql import Window

    bm = bm25(spark, d).select("query_id", "chunk_id", "rank")
    other = bm.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where("rank <= 20")
    return S.rrf_fuse([bm, other]).select("query_id", "chunk_id", "rank")


@query("e8_rerank", f"""{BM25}, t AS (SELECT bm.query_id, bm.chunk_id, bm.rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS t FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
  sc AS (SELECT query_id, chunk_id, rank AS r, len(list_intersect(q, t))::DOUBLE / len(q) AS score FROM t) SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM sc) WHERE rank <= 6""")
def rerank(spark, d):
    hits = bm25(spark, d).drop("score").join(questions(spark, d).withColumnRenamed("text", "query"), "query_id").join(chunks(spark, d), "chunk_id")
    return S.rerank(hits)


@query("e9_top_k", "SELECT query_id, mode, lecture_id, segment_id, score, rank FROM (SELECT query_id, mode, lecture_id, segment_id, score, row_number() OVER (PARTITION BY query_id, mode ORDER BY score DESC, CAST(lecture_id AS VARCHAR), segment_id) AS rank FROM hits) WHERE rank <= 6", "hits")
def top_k(spark, d):
    hits = view(spark, d, "hits").drop("rank").withColumn("name", F.col("lecture_id").cast("string"))
    return S.top_k(hits, 6, ["query_id", "mode"], ("name", "segment_id")).drop("name")


@query("e10_search_hybrid")
def hybrid(spark, d):
    embedded = S.embed_chunks(chunks(spark, d))
    asked = S.embed_chunks(questions(spark, d), prefix="query: ")
    return S.search(asked, embedded, S.bm25_postings(chunks(spark, d)), "hybrid").select("query_id", "chunk_id", "rank")


@query("e10_search_rerank")
def search_rerank(spark, d):
    embedded = S.embed_chunks(chunks(spark, d))
    asked = S.embed_chunks(questions(spark, d), prefix="query: ")
    return S.search(asked, embedded, S.bm25_postings(chunks(spark, d)), "rerank").select("query_id", "chunk_id", "rank")


@query("e2_embed_chunks")
def embed(spark, d):
    return S.embed_chunks(chunks(spark, d)).select("chunk_id", "dense")


@query("e2_sparse_vectors", f"SELECT chunk_id, term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / 256.0)), 9) AS weight FROM ({POSTINGS})")
def sparse(spark, d):
    rows = S.sparse_vectors(chunks(spark, d), stem=False)
    return rows.select("chunk_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("chunk_id", F.col("x.terms").alias("term"), F.round("x.weights", 9).alias("weight"))


@query("e4_index_counts", f"SELECT term, count(*) AS df FROM ({POSTINGS}) GROUP BY term")
def index_counts(spark, d):
    """Counts after three upserts: all chunks with another text, every second again, every third removed and put back."""
    return LI.document_counts(spark, upserted(spark, d)).select("term", "df")


def upserted(spark, d):
    root, every = shared_path(spark, "lexical"), chunks(spark, d)
    LI.upsert(root, every.withColumn("text", F.reverse("text")).where("chunk_id % 2 = 0").unionByName(every.where("chunk_id % 2 = 1")), stem=False)
    LI.upsert(root, every.where("chunk_id % 2 = 0"), every.where("chunk_id % 3 = 0 and chunk_id % 2 = 1"), stem=False)
    LI.upsert(root, every.where("chunk_id % 3 = 0 and chunk_id % 2 = 1"), stem=False)
    return root


@query("e6_index_search", f"{BM25} SELECT query_id, chunk_id, rank FROM bm")
def index_search(spark, d):
    return LI.search(questions(spark, d), upserted(spark, d), 30, stem=False).select("query_id", "chunk_id", "rank")


@query("e3_upsert_index", f"SELECT lecture_id, segment_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, chapter FROM (SELECT lecture_id, segment_id, 'Chapter ' || (index - index % 3) AS chapter, sha1(unhex('{S.NAMESPACE}' || hex(encode(lecture_id || '/' || segment_id)))) AS h FROM segments WHERE lecture_id % 2 = 0) UNION ALL SELECT lecture_id, segment_id, 'old', NULL FROM segments WHERE lecture_id % 2 = 1", "segments")
def upsert(spark, d):
    segments = view(spark, d, "segments")
    rows = segments.select("lecture_id", "segment_id", "start_s", F.array(F.lit(1.0).cast("float")).alias("dense"))
    old = rows.withColumns({"point_id": F.lit("old"), "chapter": F.lit(None).cast("string")})
    new = rows.where("lecture_id % 2 = 0")
    chapters = segments.where("index % 3 = 0").select("lecture_id", F.col("index").alias("ord"), F.concat(F.lit("Chapter "), F.col("index").cast("string")).alias("title"), F.col("start_s").alias("chapter_s"))
    return S.upsert_index(old, new, new, 1, chapters).select("lecture_id", "segment_id", "point_id", "chapter")


@query("g1_chat_history", """, w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN ord END IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY ord) AS q FROM messages),
  g AS (SELECT *, row_number() OVER (PARTITION BY thread_id, q ORDER BY ord) AS n FROM w WHERE role = 'assistant' AND NOT failed AND content <> '' AND q IS NOT NULL),
  b AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ord DESC) AS b FROM g WHERE n = 1)
  SELECT b.thread_id, row_number() OVER (PARTITION BY b.thread_id ORDER BY b.ord) AS turn, m.content AS question, b.content AS answer FROM b JOIN messages m ON m.thread_id = b.thread_id AND m.ord = b.q WHERE b.b <= 3""", "messages")
def history(spark, d):
    return A.chat_history(view(spark, d, "messages"))


SQL["g1_chat_history"] = SQL["g1_chat_history"].replace(") , w", "), w")


@query("b18_render_conversation", f"SELECT thread_id, '<conversation>' || chr(10) || string_agg('<turn>' || chr(10) || '<question>q' || ord || ' &lt;</question>' || chr(10) || '<answer>' || {sql_escape("CASE WHEN length(content) > 600 THEN content[1:600] || '…' ELSE content END")} || '</answer>' || chr(10) || '</turn>', chr(10) ORDER BY ord) || chr(10) || '</conversation>' AS conversation FROM messages WHERE role = 'assistant' GROUP BY thread_id", "messages")
def conversation(spark, d):
    m = view(spark, d, "messages").where("role = 'assistant'")
    return A.render_conversation(m.select("thread_id", F.col("ord").alias("turn"), F.concat(F.lit("q"), F.col("ord").cast("string"), F.lit(" <")).alias("question"), F.col("content").alias("answer")))


@query("b18_render_passages", f"""SELECT doc_id AS question_id, '<passages>' || chr(10) || string_agg('<passage' || CASE WHEN slide_id % 3 > 0 THEN ' lecture="L' || (slide_id % 3) || ': ' || CASE WHEN slide_id % 2 = 0 THEN {sql_escape('source', True)} ELSE 'Untitled' END || '"' ELSE '' END || CASE WHEN slide_id % 4 = 0 THEN ' chapter="' || {sql_escape('lang', True)} || '"' ELSE '' END || '>' || chr(10) || CASE WHEN slide_id % 5 = 0 THEN '<slide>' || chr(10) || 'Title: x' || chr(10) || '</slide>' || chr(10) ELSE '' END || '<speech>' || chr(10) || '[' || CASE WHEN slide_id % 3 > 0 THEN 'L' || (slide_id % 3) || ' ' ELSE '' END || {sql_time('slide_id * 61')} || '] ' || {sql_escape('l.text')} || chr(10) || '</speech>' || chr(10) || '</passage>', chr(10) ORDER BY slide_id) || chr(10) || '</passages>' AS context FROM lines l JOIN documents ON doc_id = deck_id GROUP BY 1""", "lines")
def passages(spark, d):
    i = F.col("slide_id")
    rows = view(spark, d, "lines").join(view(spark, d, "documents").select(F.col("doc_id").alias("deck_id"), "source", "lang"), "deck_id")
    sentence = F.array(F.struct((i * 61).alias("start_s"), "text"))
    return A.render_passages(rows.select(F.col("deck_id").alias("question_id"), i.alias("rank"), F.when(i % 3 > 0, F.concat(F.lit("L"), (i % 3).cast("string"))).alias("label"), F.when(i % 2 == 0, F.col("source")).alias("lecture_title"), F.when(i % 4 == 0, F.col("lang")).alias("chapter"), F.when(i % 5 == 0, "Title: x").alias("slide_document"), sentence.alias("sentences")))


@query("b18_render_outline", f"""SELECT deck_id AS lecture_id, '<outline>' || chr(10) || CASE WHEN deck_id % 3 > 0 THEN '<summary>' || any_value(lang) || ' &amp;</summary>' || chr(10) ELSE '' END || string_agg('[' || {sql_time('slide_id * 61')} || '] ' || {sql_escape('substr(l.text, 1, 30)')} || CASE WHEN slide_id % 2 = 0 AND l.text <> '' THEN chr(10) || {sql_escape('l.text')} ELSE '' END, chr(10) ORDER BY slide_id) || chr(10) || '</outline>' AS outline FROM lines l JOIN documents ON doc_id = deck_id GROUP BY 1""", "lines")
def outline(spark, d):
    outlines = view(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("lecture_id"), F.when(F.col("doc_id") % 3 > 0, F.concat("lang", F.lit(" &"))).alias("summary"))
    chapters = view(spark, d, "lines").select(F.col("deck_id").alias("lecture_id"), F.col("slide_id").alias("ord"), (F.col("slide_id") * 61).alias("start_s"), F.substring("text", 1, 30).alias("title"), F.when(F.col("slide_id") % 2 == 0, F.col("text")).alias("summary"))
    return A.render_outline(outlines, chapters)


CITED = "SELECT doc_id AS question_id, concat('See [', doc_id % 50, ':', lpad(CAST(n_chars % 70 AS VARCHAR(9)), 2, '0'), '] and [L', doc_id % 4, ' 01:', lpad(CAST(doc_id % 60 AS VARCHAR(9)), 2, '0'), ', 02:30; L2 1:00:05] but [', doc_id % 50, ':', lpad(CAST(n_chars % 70 AS VARCHAR(9)), 2, '0'), '] or [x].') AS content FROM documents"
CITATIONS = f""", a AS ({CITED}), b AS (SELECT question_id, unnest(x) AS inside, generate_subscripts(x, 1) AS bracket FROM (SELECT question_id, regexp_extract_all(content, '\\[((L\\d+\\s+)?\\d{{1,3}}:\\d{{2}}(:\\d{{2}})?(\\s*[,;]\\s*(L\\d+\\s+)?\\d{{1,3}}:\\d{{2}}(:\\d{{2}})?)*)\\]', 1) AS x FROM a)),
  p AS (SELECT question_id, bracket, unnest(y) AS t, generate_subscripts(y, 1) AS part FROM (SELECT question_id, bracket, string_split_regex(inside, '\\s*[,;]\\s*') AS y FROM b)),
  l AS (SELECT *, last_value(nullif(regexp_extract(t, '^(L\\d+)\\s', 1), '') IGNORE NULLS) OVER (PARTITION BY question_id, bracket ORDER BY part) AS label, string_split(regexp_replace(t, '^L\\d+\\s+', ''), ':') AS n FROM p),
  s AS (SELECT *, CASE WHEN n[-1]::INT < 60 AND (len(n) = 2 OR n[-2]::INT < 60) THEN (CASE WHEN len(n) = 3 THEN n[1]::INT ELSE 0 END) * 3600.0::DOUBLE + n[-2]::INT * 60 + n[-1]::INT END AS at_s FROM l),
  c AS (SELECT question_id, label, at_s, min(bracket * 100 + part) AS o FROM s WHERE at_s IS NOT NULL GROUP BY ALL),
  cites AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY o) - 1 AS ord, label, at_s FROM c)"""


def cited(spark, d):
    return spark.sql(CITED.replace("documents", "{documents}").replace("VARCHAR(9)", "STRING"), documents=view(spark, d, "documents"))


@query("g3_extract_citations", "WITH" + CITATIONS[1:] + " SELECT * FROM cites")
def citations(spark, d):
    return A.extract_citations(cited(spark, d))


PASSAGES = "SELECT doc_id AS question_id, r AS rank, doc_id % 7 AS lecture_id, r * 3 AS segment_id, r * 60.0 AS start_s, r * 60.0 + 50 AS end_s, concat('L', r % 4) AS label FROM {documents}{more}"
OUTLINES = "SELECT doc_id AS question_id, 99 AS lecture_id, 60.0 * (doc_id % 50) AS chapter_start_s FROM {documents}"


def grounded(spark, d):
    docs = view(spark, d, "documents")
    p = spark.sql(PASSAGES.replace("{more}", " LATERAL VIEW explode(sequence(0, 9)) t AS r"), documents=docs)
    return A.ground_citations(A.extract_citations(cited(spark, d)), p, spark.sql(OUTLINES, documents=docs))


GROUND = "WITH" + CITATIONS[1:] + f""", passages AS ({PASSAGES.replace("{documents}", "documents").replace("{more}", ", range(0, 10) z(r)")}), outlines AS ({OUTLINES.replace("{documents}", "documents")}),
  m AS (SELECT c.*, (SELECT min(rank) FROM passages p WHERE p.question_id = c.question_id AND at_s BETWEEN start_s - 1 AND end_s + 1 AND (c.label IS NULL OR c.label = p.label)) AS r FROM cites c),
  grounded AS (SELECT m.question_id, m.ord, m.label, m.at_s, coalesce(p.lecture_id, CASE WHEN m.label IS NULL THEN (SELECT min(lecture_id) FROM outlines o WHERE o.question_id = m.question_id AND abs(m.at_s - chapter_start_s) <= 1) END) AS lecture_id, p.segment_id FROM m LEFT JOIN passages p ON p.question_id = m.question_id AND p.rank = m.r)"""


@query("g4_ground_citations", GROUND + " SELECT *, lecture_id IS NOT NULL AS valid FROM grounded")
def ground(spark, d):
    return grounded(spark, d)


@query("d7_on_target", GROUND + " SELECT g.question_id, coalesce(bool_or(lecture_id IS NOT NULL AND at_s BETWEEN d.n_chars % 400 - 10 AND d.n_chars % 400 + 20), false) AS on_target FROM grounded g JOIN documents d ON d.doc_id = g.question_id GROUP BY 1")
def on_target(spark, d):
    spans = view(spark, d, "documents").select(F.col("doc_id").alias("question_id"), (F.col("n_chars") % 400).alias("start_s"), (F.col("n_chars") % 400 + 10).alias("end_s"))
    return A.on_target(grounded(spark, d), spans)


@query("g5_sources_of", "SELECT query_id, list(segment_id ORDER BY rank) AS segments FROM hits WHERE mode = 2 GROUP BY 1", "hits")
def sources(spark, d):
    h = view(spark, d, "hits").where("mode = 2")
    titles = h.select("lecture_id").distinct().withColumn("title", F.lit("t"))
    return A.sources_of(h, titles).select("query_id", F.transform("sources", lambda x: x["segment_id"]).alias("segments"))


@query("g2_label_passages", "SELECT query_id, rank, 'L' || CASE WHEN lecture_id % 2 = 0 THEN lecture_id + 1 END AS label FROM hits WHERE mode = 1", "hits")
def labels(spark, d):
    h = view(spark, d, "hits").where("mode = 1")
    numbers = h.select("lecture_id").distinct().where("lecture_id % 2 = 0").withColumn("number", F.col("lecture_id") + 1)
    return A.label_passages(h, numbers).select("query_id", "rank", "label")


RATINGS = "SELECT event_id AS id, user_id AS message_id, event_type AS rating, ts AS updated_at FROM {events} WHERE event_type IN ('view', 'click')"


@query("g6_latest_feedback", f"SELECT message_id, arg_max(rating, id) AS rating, max(updated_at) AS updated_at FROM ({RATINGS.replace('{events}', 'events')}) GROUP BY 1")
def feedback(spark, d):
    return A.latest_feedback(spark.sql(RATINGS, events=view(spark, d, "events")))


@query("d12_thread_detail", f"SELECT m.message_id, m.ord, r.rating FROM (SELECT thread_id AS message_id, ord FROM messages) m LEFT JOIN (SELECT message_id, arg_max(rating, id) AS rating FROM ({RATINGS.replace('{events}', 'events')}) GROUP BY 1) r USING (message_id)", "messages")
def detail(spark, d):
    m = view(spark, d, "messages").select(F.col("thread_id").alias("message_id"), "ord")
    return A.thread_detail(m, A.latest_feedback(spark.sql(RATINGS, events=view(spark, d, "events")))).select("message_id", "ord", "rating")


@query("g7_answer_outcomes", "SELECT CASE WHEN thread_id % 2 = 0 THEN 'lecture' ELSE 'course' END AS scope, CASE WHEN failed THEN 'error' ELSE 'done' END AS outcome, count(*) AS n FROM messages WHERE role = 'assistant' GROUP BY ALL", "messages")
def outcomes(spark, d):
    m = view(spark, d, "messages").withColumn("scope", F.when(F.col("thread_id") % 2 == 0, "lecture").otherwise("course"))
    return A.answer_outcomes(m)


@query("g7_answer_outcomes_stream", "SELECT CASE WHEN thread_id % 2 = 0 THEN 'lecture' ELSE 'course' END AS scope, CASE WHEN failed THEN 'error' ELSE 'done' END AS outcome, count(*) AS n FROM messages WHERE role = 'assistant' GROUP BY ALL", "messages")
def outcomes_stream(spark, d):
    from coursemill.plans.scores import streamed
    from coursemill.plans.views import VIEWS
    from coursemill.streaming.jobs import run_to_end

    m = spark.sql(VIEWS["messages"][1], conversations=streamed(spark, d, "conversations"))
    return run_to_end(A.answer_outcomes(m.withColumn("scope", F.when(F.col("thread_id") % 2 == 0, "lecture").otherwise("course"))))


@query("g6_latest_feedback_stream", f"SELECT message_id, arg_max(rating, id) AS rating FROM ({RATINGS.replace('{events}', 'events')}) GROUP BY 1")
def feedback_stream(spark, d):
    from coursemill.plans.scores import streamed
    from coursemill.streaming.jobs import upsert_feedback_stream

    return upsert_feedback_stream(spark.sql(RATINGS, events=streamed(spark, d, "events")), shared_path(spark, "feedback")).select("message_id", "rating")

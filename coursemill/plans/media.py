"""Queries over the catalogue, slides and frames, text kernels, provenance, the ledger and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursemill.functions import links
from coursemill.kernels import latex, words
from coursemill.operators import catalog as C
from coursemill.operators import slides as P
from coursemill.plans.views import VIEWS, view, with_views
from coursemill.session import shared_path, short_batches
from coursemill.sources import buckets, io
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


SEES = "v.admin OR l.visibility = 'public' OR l.owner_id = v.viewer_id"


@query("c1_readable", f"SELECT v.viewer_id, l.id, l.title FROM viewers v JOIN courses l ON {SEES}", "viewers courses")
def readable(spark, d):
    return C.readable(view(spark, d, "courses"), view(spark, d, "viewers")).select("viewer_id", "id", "title")


@query("c2_changeable", "SELECT v.viewer_id, l.id FROM viewers v JOIN courses l ON v.admin OR l.owner_id = v.viewer_id", "viewers courses")
def changeable(spark, d):
    return C.changeable(view(spark, d, "courses"), view(spark, d, "viewers")).select("viewer_id", "id")


@query("c3_list_lectures", f"SELECT viewer_id, id FROM (SELECT v.viewer_id, l.id, row_number() OVER (PARTITION BY v.viewer_id ORDER BY l.created_at DESC, l.id DESC) AS n FROM viewers v JOIN lectures l ON {SEES}) WHERE n <= 10", "viewers lectures")
def list_lectures(spark, d):
    return C.list_lectures(view(spark, d, "lectures"), view(spark, d, "viewers"), 10).select("viewer_id", "id")


@query("c4_list_courses", f"SELECT v.viewer_id, l.id, l.title, (SELECT count(*) FROM lectures x WHERE x.course_id = l.id AND (v.admin OR x.visibility = 'public' OR x.owner_id = v.viewer_id)) AS lectures FROM viewers v JOIN courses l ON {SEES}", "viewers courses lectures")
def list_courses(spark, d):
    return C.list_courses(view(spark, d, "courses"), view(spark, d, "lectures"), view(spark, d, "viewers"))


@query("c5_number_lectures", "SELECT id, number FROM (SELECT id, status, row_number() OVER (PARTITION BY course_id ORDER BY created_at, id) AS number FROM lectures) WHERE status = 'ready'", "lectures")
def number(spark, d):
    return C.number_lectures(view(spark, d, "lectures")).select("id", "number")


@query("c6_own_threads", "SELECT viewer_id, id FROM (SELECT v.viewer_id, t.id, row_number() OVER (PARTITION BY v.viewer_id ORDER BY t.created_at DESC, t.id DESC) AS n FROM viewers v JOIN lectures t ON v.admin OR t.owner_id = v.viewer_id) WHERE n <= 50", "viewers lectures")
def threads(spark, d):
    return C.own_threads(view(spark, d, "lectures").withColumnRenamed("created_at", "updated_at"), view(spark, d, "viewers")).select("viewer_id", "id")


@query("c7_latest_ready", "SELECT content_hash, arg_max(id, (created_at, id)) AS id FROM lectures WHERE status = 'ready' GROUP BY 1", "lectures")
def latest_ready(spark, d):
    return C.latest_ready(view(spark, d, "lectures"))


@query("c8_purge_lectures", "SELECT run_id, stage, part FROM stages WHERE lecture_id NOT IN (SELECT owner_id FROM lectures WHERE id % 3 = 0)", "stages lectures")
def purge(spark, d):
    return C.purge(view(spark, d, "stages"), view(spark, d, "lectures").where("id % 3 = 0").select(F.col("owner_id").alias("lecture_id"))).select("run_id", "stage", "part")


GOLD = "SELECT vec_id % 400 AS question_id, CASE WHEN vec_id % 7 > 0 THEN 'a' END AS answer, vec_id % 5 AS n, CAST(vec_id * 13 % 500 AS DOUBLE) AS s FROM {embeddings}"


@query("c9_validate_golden", f"SELECT question_id, problem FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS c FROM ({GOLD.format(embeddings='embeddings')})) JOIN (VALUES ('duplicate'), ('answer without spans or spans without answer'), ('span out of order')) v(problem) ON CASE problem WHEN 'duplicate' THEN c > 1 WHEN 'span out of order' THEN n > 0 AND (n = 3 OR s + 9 > 450) ELSE (answer IS NULL) <> (n = 0) END")
def golden(spark, d):
    g = spark.sql(GOLD, embeddings=view(spark, d, "embeddings"))
    span = F.struct(F.col("s").alias("start_s"), F.when(F.col("n") == 3, F.col("s")).otherwise(F.col("s") + 9).alias("end_s"))
    return C.validate_golden(g.select("question_id", "answer", F.when(F.col("n") > 0, F.array(span)).otherwise(F.array().cast("array<struct<start_s: double, end_s: double>>")).alias("spans"), F.lit(450.0).alias("duration_s")))


@query("c10_upload_gaps", "WITH u AS (SELECT o_orderkey AS upload_id, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), p AS (SELECT upload_id, k AS part_no, CASE WHEN k < ceil(bytes / 60000.0) THEN 60000 ELSE bytes - (ceil(bytes / 60000.0)::BIGINT - 1) * 60000 END AS size FROM u, range(1, 12) z(k) WHERE k <= ceil(bytes / 60000.0)) SELECT upload_id, part_no, size FROM p WHERE NOT (part_no % 2 = 0 AND size = 60000)")
def gaps(spark, d):
    uploads = view(spark, d, "orders").select(F.col("o_orderkey").alias("upload_id"), F.floor("o_totalprice").alias("bytes"))
    sent = uploads.select("upload_id", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6), F.lit(8), F.lit(10))).alias("part_no"), F.lit(60000).cast("long").alias("size"))
    return C.upload_gaps(uploads, sent, 60000)


@query("a9_export_manifest", "SELECT l.id, c.title AS course FROM lectures l LEFT JOIN courses c ON c.id = l.course_id AND c.visibility = 'public' WHERE l.status = 'ready' AND l.visibility = 'public'", "lectures courses")
def manifest(spark, d):
    return C.export_manifest(view(spark, d, "lectures"), view(spark, d, "courses"))[0].select("id", "course")


@query("k1_cache_keys", """SELECT doc_id, sha256('{"inputs":{"audio":"' || source || '","text":"' || sha256(text) || '"},"model":' || CASE WHEN doc_id % 3 > 0 THEN '"' || lang || '"' ELSE 'null' END || ',"params":' || CASE WHEN doc_id % 4 > 0 THEN '{"beam_size":' || n_chars || ',"note":"a \\"b\\" é","vad":true}' ELSE '{}' END || ',"stage":"asr","version":"' || n_chars % 5 || '"}') AS key FROM documents""")
def cache_keys(spark, d):
    docs = view(spark, d, "documents")
    params = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit('{"vad": true, "note": "a \\"b\\" é", "beam_size": '), F.col("n_chars").cast("string"), F.lit("}")))
    inputs = F.create_map(F.lit("text"), F.sha2("text", 256), F.lit("audio"), F.col("source"))
    return C.cache_keys(docs.select("doc_id", inputs.alias("inputs"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("model"), F.lit("asr").alias("stage"), (F.col("n_chars") % 5).cast("string").alias("version"), params.alias("params"))).select("doc_id", "key")


@query("k2_prompt_fingerprint", "SELECT item_id, 'p' || item_id || '@' || substr(sha256(text), 1, 12) AS f FROM benchmark")
def fingerprint(spark, d):
    return view(spark, d, "benchmark").select("item_id", C.prompt_fingerprint(F.concat(F.lit("p"), F.col("item_id").cast("string")), F.col("text")).alias("f"))


def _key(stage: str, inputs: str, version: int = 1, model: str = "null", params: str = "{}") -> str:
    return f"""sha256('{{"inputs":{{{inputs}}},"model":{model},"params":{params},"stage":"{stage}","version":"{version}"}}')"""


@query("k3_chain_keys", f"""WITH a AS (SELECT doc_id AS root_id, sha256(text) AS h FROM documents), b AS (SELECT *, {_key("audio", "\"video\":\"' || h || '\"")} AS audio, {_key("slides", "\"video\":\"' || h || '\"", 2)} AS slides FROM a),
  c AS (SELECT *, {_key("asr", "\"audio\":\"' || audio || '\"", 3, '"m"', '{"beam":5}')} AS asr FROM b), e AS (SELECT *, {_key("timeline", "\"slides\":\"' || slides || '\",\"speech\":\"' || asr || '\"")} AS timeline FROM c)
  SELECT root_id, s AS stage, CASE s WHEN 'audio' THEN audio WHEN 'slides' THEN slides WHEN 'asr' THEN asr ELSE timeline END AS key FROM e, (VALUES ('audio'), ('slides'), ('asr'), ('timeline')) v(s)""")
def chain(spark, d):
    roots = view(spark, d, "documents").select(F.col("doc_id").alias("root_id"), F.sha2("text", 256).alias("content_hash"))
    graph = [C.Stage("audio", "1", {"video": None}), C.Stage("slides", "2", {"video": None}), C.Stage("asr", "3", {"audio": "audio"}, "m", '{"beam": 5}'), C.Stage("timeline", "1", {"speech": "asr", "slides": "slides"})]
    return C.chain_keys(roots, graph)


@query("k4_content_dedupe", "SELECT sha256(text) AS hash, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY 1")
def dedupe(spark, d):
    return C.content_dedupe(view(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("d11_pending_work", "SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def pending(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return C.pending_work(docs.select("key").distinct(), docs.where("doc_id % 2 = 0"))


@query("a6_replace_by_key", "SELECT lecture_id, idx, 'new' AS text FROM speech WHERE lecture_id % 4 = 0 UNION ALL SELECT lecture_id, idx, text FROM speech WHERE lecture_id % 4 <> 0", "speech")
def replace(spark, d):
    old = view(spark, d, "speech").select("lecture_id", "idx", "text")
    root = shared_path(spark, "speech")
    buckets.replace_by_key(old, root, ["lecture_id"])
    buckets.replace_by_key(old.where("lecture_id % 4 = 0").withColumn("text", F.lit("new")), root, ["lecture_id"])
    return buckets.read(spark, root)


SRT = "SELECT CAST(doc_id AS {s}) AS path, concat('1{crlf}00:', lpad(CAST(doc_id % 60 AS {s}), 2, '0'), ':05,250 --> 00:', lpad(CAST(doc_id % 60 AS {s}), 2, '0'), ':09.500{crlf}', 'hello there{crlf}SPEAKER one{crlf}{crlf}no time here{crlf}{crlf}2{crlf}01:00:00,000 --> 01:00:02,000{crlf}bye') AS value FROM {t}"


@query("a2_read_srt", "SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS ord, doc_id % 60 * 60 + 5.25 AS start_s, doc_id % 60 * 60 + 9.5 AS end_s, 'hello there SPEAKER one' AS text FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 3600.0, 3602.0, 'bye' FROM documents")
def srt(spark, d):
    return io.parse_srt(spark.sql(SRT.replace("{crlf}", r"\r\n").replace("{s}", "STRING").replace("{t}", "{documents}"), documents=view(spark, d, "documents")))


@query("b23_timed_words", "SELECT CAST(item_id AS VARCHAR) AS path, i - 1 AS i, w[i] AS word, (i - 1) * 10.0 / len(w) AS at FROM (SELECT item_id, unnest(range(1, len(w) + 1)) AS i, w FROM (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '[a-z]+') AS w FROM benchmark))")
def timed(spark, d):
    cues = view(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.lit(0).alias("ord"), F.lit(0.0).alias("start_s"), F.lit(10.0).alias("end_s"), F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")).alias("text"))
    return io.timed_words(cues).select("path", "i", "word", "at")


@query("a4_coco_annotations", "SELECT split, row_number() OVER (PARTITION BY split ORDER BY file_name, label, x1, y1, x2, y2) AS id, dense_rank() OVER (PARTITION BY split ORDER BY file_name) AS image_id, list_position(['A', 'N', 'R'], label) AS category_id, (x2 - x1) * (y2 - y1) AS area FROM (SELECT *, deck_id % 3 AS split, slide_id AS file_name FROM boxes)", "boxes")
def coco(spark, d):
    b = view(spark, d, "boxes").withColumns({"split": F.col("deck_id") % 3, "file_name": F.col("slide_id")})
    return io.coco_annotations(b, ["A", "N", "R"]).select("split", "id", "image_id", "category_id", "area")


@query("i2_hash_distance", "SELECT frame, (bit_count(xor(h0, h1)) + bit_count(xor(h1, h0 + 5))) / 128.0 AS x FROM frames", "frames")
def distance(spark, d):
    return view(spark, d, "frames").select("frame", P.hash_distance([F.col("h0"), F.col("h1")], [F.col("h1"), F.col("h0") + 5]).alias("x"))


@query("i3_detect_slides")
def detect(spark, d):
    f = view(spark, d, "frames").select("lecture_id", "t_s", "is_slide", *[(F.col(h) % 4 * 1_000_003).alias(h) for h in ("h0", "h1")])
    return P.detect_slides(f, f.groupBy("lecture_id").agg((F.max("t_s") + 1).alias("duration_s")))


@query("i1_frame_features")
def features(spark, d):
    v = view(spark, d, "embeddings")
    gray = F.transform("embedding", lambda x: F.pmod((F.abs(x) * 100000).cast("int"), F.lit(256)))
    rows = v.select("vec_id", gray.alias("gray"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.slice(F.flatten(F.array_repeat("embedding", 5)), 1, 272).alias("thumb"))
    return rows.withColumn("f", F.pandas_udf(P.frame_features, P.FEATURES)("gray", "h", "w", "thumb")).select("vec_id", "f.*")


@query("i7_line_geometry", "SELECT slide_id, line_no, y1 AS top, x1 AS left, x2 + 1 AS right, round((sqrt(1 + h * h) + sqrt(1 + h * h)) / 2, 6) AS height, round(degrees(atan2(2.0, x2 - x1)), 6) AS angle FROM boxes", "boxes")
def geometry(spark, d):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    b = view(spark, d, "boxes").withColumn("box", F.array(pt(c("x1"), c("y1")), pt(c("x2"), c("y1") + 2), pt(c("x2") + 1, c("y1") + 2 + c("h")), pt(c("x1") + 1, c("y1") + c("h"))))
    return P.line_geometry(b).select("slide_id", "line_no", "top", "left", "right", F.round("height", 6).alias("height"), F.round("angle", 6).alias("angle"))


LEADS = ("", "• ", "\uf0a7", "●■  ", "* ", "a • ", "▪")  # in front of lines 1 to 7; the last has nothing else
CLEAN = r"trim(regexp_replace(regexp_replace(text, '^[\x{E000}-\x{F8FF}•▪◦●■□◆·*]+\s*', ''), '[\x{E000}-\x{F8FF}]', '', 'g'))"


def ocr(spark, d):
    return view(spark, d, "boxes").select("deck_id", "slide_id", "line_no", F.concat(F.element_at(F.array(*map(F.lit, LEADS)), F.col("line_no").cast("int")), F.when(F.col("line_no") == 7, "").otherwise(F.concat(F.col("label"), F.lit(" word "), F.col("line_no").cast("string")))).alias("text"), "score", (F.col("x1") / 40 - 3).alias("angle"), F.col("y1").alias("top"), F.col("x1").alias("left"), F.col("x2").alias("right"), F.col("h").alias("height"), F.lit(10.0).alias("area_top"), F.lit(280.0).alias("area_height"))


@query("i4_route_slides", """, s AS (SELECT deck_id, slide_id, max(ink) AS ink, sum((abs(x1 / 40 - 3) > 8)::INT) AS tilted, sum([3, 4, 3, 4, 4, 5, 1][line_no]) AS words, avg(score) AS score FROM boxes GROUP BY 1, 2), b AS (SELECT deck_id, quantile_cont(ink, 0.25) AS base FROM s GROUP BY 1)
  SELECT slide_id, reasons FROM (SELECT slide_id, list_filter([CASE WHEN ink - base > 0.003 THEN 'figure' END, CASE WHEN tilted >= 2 THEN 'annotations' END, CASE WHEN slide_id % 9 >= 3 AND slide_id % 2 = 0 THEN 'columns' END, CASE WHEN words < 5 THEN 'little text' WHEN score < 0.93 THEN 'low confidence' END], lambda r: r IS NOT NULL) AS reasons FROM s JOIN b USING (deck_id)) WHERE len(reasons) > 0""", "boxes")
def route(spark, d):
    slides = view(spark, d, "boxes").groupBy("deck_id", "slide_id").agg(F.max("ink").alias("ink"))
    columns = slides.where("slide_id % 2 = 0").select("deck_id", "slide_id", (F.col("slide_id") % 9).alias("rows"))
    return P.route_slides(ocr(spark, d), slides, columns).select("slide_id", "reasons")


SQL["i4_route_slides"] = SQL["i4_route_slides"].replace(") , s AS", "), s AS", 1)


@query("i5_side_by_side_rows")
def columns(spark, d):
    return P.side_by_side_rows(ocr(spark, d), ["deck_id", "slide_id"])


@query(
    "i6_reading_from_ocr",
    rf""", o AS (SELECT *, ['', '• ', chr(61607), '●■  ', '* ', 'a • ', '▪'][line_no] || CASE line_no WHEN 7 THEN '' ELSE label || ' word ' || line_no END AS text FROM boxes WHERE y1 < 10.0 + 0.92 * 280.0),
  n AS (SELECT *, row_number() OVER w AS n, max(h) OVER (PARTITION BY deck_id, slide_id) AS tall, y1 - lag(y1) OVER w < 2 * lag(h) OVER w AS follows FROM o WINDOW w AS (PARTITION BY deck_id, slide_id ORDER BY round_even(y1 / 4, 0), x1, line_no)),
  t AS (SELECT *, min((h >= 0.75 * tall AND CASE n WHEN 1 THEN y1 < 10.0 + 0.3 * 280.0 ELSE follows END)::INT) OVER (PARTITION BY deck_id, slide_id ORDER BY n) = 1 AS title, regexp_matches(text, '^[\x{{E000}}-\x{{F8FF}}•▪◦●■□◆·*]') AS bullet, {CLEAN} AS cleaned FROM n)
  SELECT deck_id, slide_id, coalesce(string_agg(cleaned, ' ' ORDER BY n) FILTER (title AND cleaned <> ''), '') AS title, coalesce(string_agg(CASE WHEN bullet THEN '- ' ELSE '' END || cleaned, chr(10) ORDER BY n) FILTER (NOT title AND cleaned <> ''), '') AS text FROM t GROUP BY 1, 2""",
    "boxes",
)
def reading(spark, d):
    return P.reading_from_ocr(ocr(spark, d), ["deck_id", "slide_id"])


SQL["i6_reading_from_ocr"] = SQL["i6_reading_from_ocr"].replace(") , o AS", "), o AS", 1)


@query("i9_line_pairs")
def pairs(spark, d):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    left, top, n = F.col("idx") % 7, 20 * (F.col("idx") % 4), F.length("text")
    lines = view(spark, d, "speech").select(F.col("lecture_id").alias("deck_id"), F.col("idx").alias("slide_id"), F.lit(0).alias("line_no"), F.floor(F.col("idx") / 4).alias("page"), "text", F.array(at(left, top), at(left + n, top + 1), at(left + n, top + 11), at(left, top + 10)).alias("box"))
    box = F.array(*((F.col("box")[i][c] / 2).alias("v") for i, c in ((0, "x"), (0, "y"), (2, "x"), (2, "y"))))
    pages = lines.select("deck_id", "page", F.col("slide_id").alias("line_no"), F.regexp_replace("text", "th", "tn").alias("text"), box.alias("box"))
    found = P.line_pairs(lines, pages).select("deck_id", "slide_id", "page_line", "ratio", F.posexplode("pairs").alias("corner", "p"))
    return found.select("deck_id", "slide_id", "page_line", "ratio", "corner", "p.*")


@query("i10_map_boxes", "SELECT * FROM (SELECT slide_id, line_no, x1, y1, greatest(least(x1 + 10, 400.0), 0.0) AS m1, greatest(least(2 * y1, 300.0), 0.0) AS n1, greatest(least(x2 + 10, 400.0), 0.0) AS m2, greatest(least(2 * y2, 300.0), 0.0) AS n2 FROM boxes) WHERE m2 - m1 >= 6 AND n2 - n1 >= 6", "boxes")
def map_boxes(spark, d):
    t = {k: F.lit(v) for k, v in zip("abcdef", (1.0, 0.0, 10.0, 0.0, 2.0, 0.0), strict=True)}
    return P.map_boxes(view(spark, d, "boxes").withColumns(t), (0.0, 0.0, 400.0, 300.0)).select("slide_id", "line_no", "x1", "y1", "m1", "n1", "m2", "n2")


@query("i11_to_page_box", "SELECT slide_id, line_no, x1, CASE WHEN least(x2 * 3, 1000) / 1000 * 595 - least(x1 * 3, 1000) / 1000 * 595 >= 3 AND least(y2, 1000) / 1000 * 842 - y1 / 1000 * 842 >= 3 THEN round(least(x2 * 3, 1000) / 1000 * 595, 6) END AS r FROM boxes", "boxes")
def page_box(spark, d):
    box = P.to_page_box(F.col("y1"), F.col("x1") * 3, F.col("y2"), F.col("x2") * 3, F.lit(595), F.lit(842))
    return view(spark, d, "boxes").select("slide_id", "line_no", "x1", F.round(box[2], 6).alias("r"))


@query("i12_sample_per_key")
def sample(spark, d):
    return P.sample_per_key(view(spark, d, "frames").withColumn("page", F.col("h0") % 7), ["lecture_id", "page"], 6, 700.0)


@query("i13_label_frames", "SELECT lecture_id, idx, kind, reason FROM (SELECT lecture_id, idx, CASE WHEN idx % 2 = 0 AND (idx % 10 >= 6 OR (idx % 10 >= 4 AND idx % 3 = idx % 4)) THEN 'slide' WHEN idx % 2 = 1 AND idx % 5 < 3 THEN 'camera' END AS kind, CASE WHEN idx % 2 = 0 AND NOT (idx % 10 >= 6 OR (idx % 10 >= 4 AND idx % 3 = idx % 4)) THEN 'no page' WHEN idx % 2 = 1 AND idx % 5 >= 3 THEN 'title band' END AS reason FROM speech)", "speech")
def label(spark, d):
    i = F.col("idx")
    f = view(spark, d, "speech").select("lecture_id", "idx", F.col("start_ds").alias("t"), (i % 2 == 0).alias("bright"), (i % 10 / 10).alias("match"), (i % 3).alias("page"), (i % 4).alias("ocr_page"), (i % 5 / 5).alias("band"))
    f = f.withColumn("match", F.when(i % 10 >= 6, 0.7).when(i % 10 >= 4, 0.4).otherwise(0.1)).withColumn("band", F.when(i % 5 < 3, 0.5).otherwise(0.9))
    spans = view(spark, d, "spans").withColumnsRenamed({"start_ds": "start", "end_ds": "end"})
    return P.label_frames(f, spans).select("lecture_id", "idx", "kind", "reason")


@query("i14_carry_regions", "SELECT f.frame, r.line_no, r.x1, CASE WHEN r.label = 'R' THEN 'figure' ELSE r.label END AS label FROM frames f JOIN boxes r ON r.deck_id = f.lecture_id AND r.slide_id % 50 = f.h0 % 50 WHERE f.value % 1 >= 0.5", "frames boxes")
def carry(spark, d):
    f = view(spark, d, "frames").select("lecture_id", "frame", (F.col("h0") % 50).alias("page"), (F.col("value") % 1).alias("visible_share"))
    r = view(spark, d, "boxes").select(F.col("deck_id").alias("lecture_id"), (F.col("slide_id") % 50).alias("page"), "line_no", "x1", F.when(F.col("label") == "R", "table").otherwise(F.col("label")).alias("label"))
    return P.carry_regions(f, r).select("frame", "line_no", "x1", "label")


@query("i15_split_counts", "SELECT split, count(DISTINCT slide_id) AS images, count(*) FILTER (label = 'A') AS A, count(*) FILTER (label = 'N') AS N, count(*) FILTER (label = 'R') AS R FROM (SELECT label, slide_id, CASE WHEN deck_id % 10 = 0 THEN 'test' WHEN x1 >= 0.8 * 500 THEN 'valid' ELSE 'train' END AS split FROM boxes) GROUP BY 1", "boxes")
def splits(spark, d):
    b = view(spark, d, "boxes").withColumn("split", P.assign_split(F.col("x1"), F.lit(500.0), F.col("deck_id") % 10 == 0)).withColumnRenamed("slide_id", "image_id")
    return P.split_counts(b, ["A", "N", "R"])


@query("h20_routed_frames", "SELECT slide_id AS image_id, bool_or(label = 'R') AS routed FROM boxes GROUP BY 1", "boxes")
def routed(spark, d):
    return P.routed_frames(view(spark, d, "boxes").select(F.col("slide_id").alias("image_id"), F.when(F.col("label") == "R", "figure").otherwise(F.col("label")).alias("label")))


@query("i16_alignment_quality", "SELECT deck_id, slide_id, avg((sqrt(pow(line_no - 3, 2) + pow(h - 9, 2)) <= 3)::INT) >= 0.5 AS fits FROM boxes GROUP BY 1, 2", "boxes")
def alignment(spark, d):
    t = {k: F.lit(v) for k, v in zip("abcdef", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), strict=True)}
    rows = view(spark, d, "boxes").withColumns(t | {"x": F.col("line_no"), "u": F.lit(3.0), "y": F.col("h"), "v": F.lit(9.0)})
    return P.alignment_quality(rows)[1]


@query("i17_deck_area", "SELECT deck_id, CAST(floor(coalesce(median(x1) FILTER (line_no = 2), median(x1))) AS INT) AS left, CAST(floor(coalesce(median(y1) FILTER (line_no = 2), median(y1))) AS INT) AS top FROM boxes GROUP BY 1", "boxes")
def area(spark, d):
    b = view(spark, d, "boxes").select("deck_id", (F.col("line_no") == 2).alias("fits"), F.col("x1").alias("left"), F.col("y1").alias("top"), F.col("x2").alias("right"), F.col("y2").alias("bottom"))
    return P.deck_area(b).select("deck_id", "left", "top")


@query("i18_match_page", "WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v) SELECT query_id, page FROM (SELECT a.vec_id AS query_id, b.vec_id AS page, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.vec_id) AS k FROM n a JOIN n b ON a.label = b.label WHERE a.vec_id % 5 > 0 AND b.vec_id % 5 = 0) WHERE k = 1")
def match_page(spark, d):
    from coursemill.operators.search import dense_search

    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("embedding")
    v = view(spark, d, "embeddings").withColumn("m", mean).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") - F.col("m")).alias("dense"))
    pages = v.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "page")
    return dense_search(v.where("vec_id % 5 > 0").withColumnRenamed("vec_id", "query_id"), pages, 1, "page", scope="label").select("query_id", "page")


@query("b5_nfkc_words", r"SELECT item_id, regexp_extract_all(lower(replace(replace(text, 'ﬁ', 'fi'), '②', '2')), '[a-z0-9]+') AS t FROM (SELECT item_id, text || ' ﬁne ②' AS text FROM benchmark)")
def nfkc(spark, d):
    from coursemill.operators.evals import nfkc_words

    b = view(spark, d, "benchmark")
    return b.select("item_id", nfkc_words(F.concat("text", F.lit(" ﬁne ②"))).alias("t"))


FORMULA = r"CASE doc_id % 4 WHEN 0 THEN concat(r'len(L) + \text{fib(n)} ', text) WHEN 1 THEN concat(r'\frac{a}{b} \alpha ', text) WHEN 2 THEN concat('O(1) + O(n) -> x ', text) ELSE text END"


def formulas(spark, d):
    short_batches(spark)
    return view(spark, d, "documents").select("doc_id", F.expr(FORMULA).alias("t"))


@query("b8_upright_names")
def upright(spark, d):
    return formulas(spark, d).select("doc_id", F.pandas_udf(latex.upright_names, "string")("t").alias("t"))


@query("b9_plain_latex")
def plain(spark, d):
    t = formulas(spark, d)
    known = t.where(F.col("t").contains("\\")).withColumn("t", F.pandas_udf(latex.plain_latex, "string")("t"))
    return t.where(~F.col("t").contains("\\")).unionAll(known)


@query("b12_place_formulas")
def placed(spark, d):
    both = F.pandas_udf(latex.place_formulas, latex.PARTS)("t", F.array(F.lit("O(1)"), F.lit("O(n)"), F.lit(r"\alpha")))
    return formulas(spark, d).withColumn("p", both).select("doc_id", "p.parts", "p.missing")


@query("b10_unique_formulas", "SELECT run_id, list_distinct_ordered AS stages FROM (SELECT run_id, list(m ORDER BY o, m) AS list_distinct_ordered FROM (SELECT run_id, model AS m, min(part * 10 + substr(stage, 6)::INT) AS o FROM stages GROUP BY 1, 2) GROUP BY 1)", "stages")
def unique(spark, d):
    from coursemill.functions.text import unique_formulas

    rows = view(spark, d, "stages").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((F.col("part") * 10 + F.substring("stage", 6, 1).cast("int")).alias("o"), F.col("model").alias("m")))).alias("a"))
    return rows.select("run_id", unique_formulas(F.transform("a", lambda x: x["m"])).alias("stages"))


@query("b11_tidy_readings", "SELECT deck_id, slide_id, CASE WHEN slide_id % 4 = 0 THEN '' ELSE 'Title of it' END AS title, CASE WHEN slide_id % 3 = 0 AND slide_id % 4 <> 0 THEN 'body O(n)' WHEN slide_id % 3 = 0 THEN 'Title' || chr(10) || 'of IT' || chr(10) || 'body O(n)' ELSE 'f(0) and 10(1) ' || slide_id END AS text FROM lines", "lines")
def tidy(spark, d):
    from coursemill.operators.tidy import tidy_readings

    i = F.col("slide_id")
    rows = view(spark, d, "lines").select("deck_id", "slide_id", F.when(i % 4 == 0, " None ").otherwise("Title\nof it").alias("title"), F.when(i % 3 == 0, "Title\nof IT\nbody 0(n)").otherwise(F.concat(F.lit("f(0) and 10(1) "), i.cast("string"))).alias("text"), F.lit("").alias("figure_description"), F.lit("n/a").alias("code"), F.array().cast("array<string>").alias("latex"), F.lit("ocr").alias("reader"))
    return tidy_readings(rows).select("deck_id", "slide_id", "title", "text")


@query("b19_valid_links", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'private' WHEN 2 THEN 'credentials' WHEN 3 THEN 'private' END AS reason FROM pages")
def link_reasons(spark, d):
    p = F.col("page_id") % 5
    url = F.when(p == 0, F.concat(F.lit("ftp://x.org/"), F.col("page_id").cast("string"))).when(p == 1, "http://10.0.0.1/a").when(p == 2, "https://me:pw@host.org/v").when(p == 3, "http://queue/x").otherwise(F.col("url"))
    return view(spark, d, "pages").select("page_id", links.refusal(url).alias("reason"))


@query("b20_excerpt")
def excerpt(spark, d):
    return view(spark, d, "documents").select("doc_id", links.excerpt(F.col("text"), F.lit("the thand erndes")).alias("excerpt"))


@query("b20_highlight_terms")
def highlight(spark, d):
    return view(spark, d, "documents").select("doc_id", links.highlights(F.col("text"), F.lit("the thand erndes")).alias("words"))


@query("b22_slugify", r"SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM benchmark")
def slug(spark, d):
    b = view(spark, d, "benchmark")
    return b.select("item_id", F.pandas_udf(words.slug, "string")("text").alias("slug"))


DAILY = "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, user_id, count(*) FILTER (kind = 'question') AS questions, count(*) FILTER (kind = 'upload') AS uploads FROM ledger WHERE user_id IS NOT NULL AND kind IN ('question', 'upload') GROUP BY ALL"


@query("j1_daily_usage", DAILY, "ledger")
def daily(spark, d):
    return J.daily_usage(view(spark, d, "ledger")).withColumn("day", F.col("day").cast("string"))


def ledger_stream(spark, d):
    schema = view(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return spark.sql(VIEWS["ledger"][1], events=stream).withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("j1_daily_usage_stream", DAILY, "ledger")
def daily_stream(spark, d):
    return J.run_to_end(J.daily_usage(ledger_stream(spark, d), "60 days")).withColumn("day", F.col("day").cast("string"))


@query("j1_daily_spend", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, round(sum(cost_usd), 6) AS spend FROM ledger GROUP BY 1", "ledger")
def spend(spark, d):
    return J.daily_spend(view(spark, d, "ledger")).withColumns({"spend": F.round("spend", 6), "day": F.col("day").cast("string")})


RATE = "SELECT id, (SELECT count(*) FROM ledger b WHERE b.kind = 'question' AND b.user_id = a.user_id AND b.created_at <= a.created_at AND b.created_at >= a.created_at - INTERVAL 1 MINUTE) AS rate FROM ledger a WHERE kind = 'question' AND user_id IS NOT NULL"


@query("j2_minute_rate", RATE, "ledger")
def rate(spark, d):
    return J.minute_rate(view(spark, d, "ledger")).select("id", "rate")


@query("j2_minute_rate_stream", RATE, "ledger")
def rate_stream(spark, d):
    """A heartbeat behind the last event moves the watermark past all questions."""
    stream = ledger_stream(spark, d).select("id", "user_id", "kind", "created_at")
    beat = stream.schema
    last = view(spark, d, "ledger").agg(F.max(F.col("created_at").cast("timestamp")).alias("t")).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("user_id"), F.lit("heartbeat").alias("kind"), F.col("t") + F.expr("INTERVAL 1 DAY"))
    path = shared_path(spark, "heartbeat")
    last.toDF(*beat.names).select(*[F.col(f.name).cast(f.dataType) for f in beat]).write.parquet(path)
    return J.run_to_end(J.minute_rate_stream(stream.unionByName(spark.readStream.schema(beat).parquet(path))), "append", own_state=True).select("id", "rate")


@query("j2_minute_windows_stream", "SELECT strftime(time_bucket(INTERVAL 10 SECOND, created_at) - k * INTERVAL 10 SECOND, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM ledger, range(0, 6) z(k) WHERE kind = 'question' AND user_id IS NOT NULL GROUP BY ALL", "ledger")
def windows_stream(spark, d):
    return J.run_to_end(J.minute_windows(ledger_stream(spark, d), "60 days")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("j3_quota_decisions", """, q AS (SELECT id, user_id, kind, user_id % 50 = 0 AS admin, created_at FROM ledger WHERE user_id IS NOT NULL AND kind <> 'llm' AND id % 3 = 0), l AS (SELECT * FROM ledger WHERE id % 3 <> 0),
  c AS (SELECT q.*, (SELECT count(*) FROM l WHERE l.user_id = q.user_id AND l.kind = q.kind AND l.created_at <= q.created_at AND l.created_at >= q.created_at - INTERVAL 60 SECOND) AS m, (SELECT count(*) FROM l WHERE l.user_id = q.user_id AND l.kind = q.kind AND l.created_at <= q.created_at AND l.created_at::DATE = q.created_at::DATE) AS t, (SELECT coalesce(sum(cost_usd), 0) FROM l WHERE l.created_at <= q.created_at AND l.created_at::DATE = q.created_at::DATE) AS s FROM q)
  SELECT id, decision, CASE WHEN decision = 'minute' THEN 60 WHEN decision <> 'ok' THEN CAST(ceil(epoch_us(created_at::DATE + INTERVAL 1 DAY) / 1e6 - epoch_us(created_at) / 1e6) AS BIGINT) END AS retry_s FROM (SELECT *, CASE WHEN admin THEN 'ok' WHEN kind = 'question' AND m >= 1 THEN 'minute' WHEN t >= CASE WHEN kind = 'upload' THEN 1 ELSE 2 END THEN 'day' WHEN s >= 2.0 THEN 'budget' ELSE 'ok' END AS decision FROM c)""", "ledger")
def decisions(spark, d):
    ledger = view(spark, d, "ledger")
    asked = ledger.where("user_id is not null and kind <> 'llm' and id % 3 = 0").withColumn("admin", F.col("user_id") % 50 == 0)
    return J.quota_decisions(asked, ledger.where("id % 3 <> 0"), {"minute": 1, "day": 2, "uploads": 1, "budget": 2.0})


SQL["j3_quota_decisions"] = SQL["j3_quota_decisions"].replace(") , q AS", "), q AS", 1)


@query("j4_usage_snapshot", f"SELECT user_id, questions, uploads, 30 AS question_limit, 5 AS minute_limit, 3 AS upload_limit, '2024-01-10 00:00:00' AS resets_at, (SELECT coalesce(sum(cost_usd), 0) FROM ledger WHERE CAST(created_at AS DATE) = '2024-01-09') >= 2 AS paused FROM ({DAILY}) WHERE day = '2024-01-09'", "ledger")
def snapshot(spark, d):
    return J.usage_snapshot(view(spark, d, "ledger"), "2024-01-09").withColumn("resets_at", F.date_format("resets_at", "yyyy-MM-dd HH:mm:ss"))


LOW = {"minute": 1, "day": 4, "uploads": 1, "budget": 2.0}  # limits that these tables reach
EVENTS = "SELECT user_id AS run_id, event_id AS ord, CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE event_type END AS payload, CASE WHEN value > 200 THEN 'done' ELSE 'running' END AS status FROM {events}"
CHANGES = f"SELECT run_id, ord, payload, status FROM (SELECT *, coalesce(max((status <> 'running')::INT) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended, lag(payload) OVER (PARTITION BY run_id ORDER BY ord) AS last FROM ({EVENTS.format(events='events')})) WHERE ended = 0 AND payload IS DISTINCT FROM last"


@query("j5_progress_changes", CHANGES)
def changes(spark, d):
    return J.progress_changes(spark.sql(EVENTS, events=view(spark, d, "events")))


@query("j5_progress_changes_stream", CHANGES)
def changes_stream(spark, d):
    stream = spark.readStream.schema(view(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    return J.run_to_end(J.progress_changes_stream(spark.sql(EVENTS, events=stream)), "append")


NAMED = "CASE WHEN stage = 'stage7' THEN 'fetch' ELSE ['probe', 'audio', 'asr', 'slides', 'ocr', 'read_slides'][substr(stage, 6)::INT] END"
PROGRESS = f"""SELECT run_id, CASE WHEN ok THEN total ELSE d END AS done, total, CASE WHEN ok THEN 100 ELSE CAST(floor(d * 100.0 / total + 0.5) AS INT) END AS percent, CASE WHEN ok OR a THEN 'done' WHEN r THEN 'running' ELSE 'pending' END AS asr, link AS fetches FROM (
  SELECT run_id, run_id % 3 = 0 AS link, 13 + (run_id % 3 = 0)::INT AS total, max((status = 'succeeded')::INT) = 1 AS ok, count(DISTINCT name) FILTER (NOT cached AND (name <> 'fetch' OR run_id % 3 = 0)) AS d, coalesce(bool_or(name = 'asr' AND NOT cached), false) AS a, coalesce(bool_or(name = 'asr' AND cached), false) AS r FROM (SELECT *, {NAMED} AS name FROM stages) GROUP BY 1)"""


def stage_events(stages):
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, J.STAGES[:6])), F.substring("stage", 6, 1).cast("int")), F.lit(J.FETCH))
    return stages.select("run_id", name.alias("stage"), (F.col("run_id") % 3 == 0).alias("from_link"), F.col("status").alias("run_status"), F.when(F.col("cached"), "running").otherwise("done").alias("status"))


@query("j6_run_progress", PROGRESS, "stages")
def progress(spark, d):
    return J.run_progress(stage_events(view(spark, d, "stages"))).select("run_id", "done", "total", "percent", F.try_element_at("states", F.lit("asr")).alias("asr"), F.map_contains_key("states", J.FETCH).alias("fetches"))


@query("j6_run_progress_stream", PROGRESS, "stages")
def progress_stream(spark, d):
    from coursemill.plans.scores import streamed_stages

    return J.run_to_end(J.run_progress(stage_events(streamed_stages(spark, d)))).select("run_id", "done", "total", "percent", F.try_element_at("states", F.lit("asr")).alias("asr"), F.map_contains_key("states", J.FETCH).alias("fetches"))


RUNS = "SELECT o_orderkey AS run_id, o_custkey AS lecture_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'done' END AS status FROM {orders}"


@query("j7_latest_runs", f"SELECT lecture_id, run_id, n FROM (SELECT lecture_id, run_id, row_number() OVER (PARTITION BY lecture_id ORDER BY started_at DESC, run_id DESC) AS n FROM ({RUNS.format(orders='orders')})) WHERE n <= 20")
def latest(spark, d):
    return J.latest_runs(spark.sql(RUNS, orders=view(spark, d, "orders"))).select("lecture_id", "run_id", "n")


@query("j7_newest_runs_stream", f"SELECT lecture_id, arg_max(run_id, (started_at, run_id)) AS run_id FROM ({RUNS.format(orders='orders')}) GROUP BY 1")
def newest_stream(spark, d):
    from coursemill.plans.scores import streamed

    return J.run_to_end(J.newest_runs(spark.sql(RUNS, orders=streamed(spark, d, "orders"))))


@query("j3_quota_replay")
def replay(spark, d):
    return J.quota_replay(view(spark, d, "ledger"), LOW)


@query("j3_quota_replay_stream")
def replay_stream(spark, d):
    return J.run_to_end(J.quota_replay(ledger_stream(spark, d), LOW), "append")


@query("j7_running_conflicts", f"SELECT lecture_id, count(*) AS n FROM ({RUNS.format(orders='orders')}) WHERE status = 'running' GROUP BY 1 HAVING count(*) > 1")
def conflicts(spark, d):
    return J.running_conflicts(spark.sql(RUNS, orders=view(spark, d, "orders")))


def frame_stream(spark, d):
    stream = spark.readStream.schema(view(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    return spark.sql(VIEWS["frames"][1], events=stream)


@query("i3_detect_slides_stream")
def detect_stream(spark, d):
    f = frame_stream(spark, d).select("lecture_id", "t_s", "is_slide", *[(F.col(h) % 4 * 1_000_003).alias(h) for h in ("h0", "h1")])
    return J.run_to_end(J.detect_slides_stream(f), "append")


@query("i12_sample_per_key_stream")
def sample_stream(spark, d):
    return J.run_to_end(J.sample_per_key_stream(frame_stream(spark, d).withColumn("page", F.col("h0") % 7), ["lecture_id", "page"], 6, 700.0), "append")

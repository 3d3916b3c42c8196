"""Conversations, answers and their time citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.text import format_timestamp, html_escape, parse_timestamp
from coursemill.operators.timeline import in_order

TOLERANCE_S = 1.0


def chat_history(messages: DataFrame, turns: int = 3) -> DataFrame:
    """(thread_id, turn, question, answer): the last pairs of a thread, oldest first.

    A pair is the latest user message before a good answer; failed and empty answers leave the question open, a newer
    question replaces it, and each question is used once.
    """
    before = Window.partitionBy("thread_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.struct("ord", "content")), ignorenulls=True).over(before)
    good = messages.withColumn("q", asked).where("role = 'assistant' and not failed and content <> '' and q is not null")
    once = good.withColumn("_n", F.row_number().over(Window.partitionBy("thread_id", "q.ord").orderBy("ord"))).where("_n = 1")
    back = once.withColumn("_b", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("ord")))).where(F.col("_b") <= turns)
    turn = F.row_number().over(Window.partitionBy("thread_id").orderBy("ord"))
    return back.select("thread_id", turn.alias("turn"), F.col("q.content").alias("question"), F.col("content").alias("answer"))


def render_conversation(history: DataFrame, limit: int = 600) -> DataFrame:
    """(thread_id, conversation): earlier turns (turn, question, answer) as one document; answers are cut at ``limit`` characters."""
    answer = F.when(F.length("answer") > limit, F.concat(F.substring("answer", 1, limit), F.lit("…"))).otherwise(F.col("answer"))
    text = F.concat(F.lit("<turn>\n<question>"), html_escape(F.col("question")), F.lit("</question>\n<answer>"), html_escape(answer), F.lit("</answer>\n</turn>"))
    return history.withColumn("text", text).groupBy("thread_id").agg(F.concat(F.lit("<conversation>\n"), in_order("turn", "text", "\n"), F.lit("\n</conversation>")).alias("conversation"))


def render_passages(passages: DataFrame) -> DataFrame:
    """(question_id, context): the passages of a question in rank order, each with its slide and its timed sentences.

    passages: question_id, rank, label, lecture_title, chapter, slide_document (see slide_documents), sentences [{start_s,
    text}]. Attributes and slide may be null; a label stands before each time too.
    """
    named = F.concat(F.col("label"), F.lit(": "), F.coalesce(F.nullif("lecture_title", F.lit("")), F.lit("Untitled")))
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), html_escape(value, True), F.lit('"'))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    head = F.concat(F.lit("<passage"), F.when(has("label"), attribute("lecture", named)).otherwise(""), F.when(has("chapter"), attribute("chapter", F.col("chapter"))).otherwise(""), F.lit(">"))
    slide = F.when(has("slide_document"), F.concat(F.lit("<slide>\n"), "slide_document", F.lit("\n</slide>")))
    prefix = F.when(has("label"), F.concat("label", F.lit(" "))).otherwise("")
    lines = F.transform("sentences", lambda s: F.concat(F.lit("["), prefix, format_timestamp(s["start_s"]), F.lit("] "), html_escape(s["text"])))
    block = F.concat_ws("\n", head, slide, F.lit("<speech>"), F.when(F.size("sentences") > 0, F.array_join(lines, "\n")), F.lit("</speech>\n</passage>"))
    return passages.withColumn("block", block).groupBy("question_id").agg(F.concat(F.lit("<passages>\n"), in_order("rank", "block", "\n"), F.lit("\n</passages>")).alias("context"))


def render_outline(outlines: DataFrame, chapters: DataFrame) -> DataFrame:
    """(lecture_id, outline): a lecture's summary (may be empty), then each chapter's start and title, its summary below."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    line = F.concat_ws("\n", F.concat(F.lit("["), format_timestamp(F.col("start_s")), F.lit("] "), html_escape(F.col("title"))), F.when(has("summary"), html_escape(F.col("summary"))))
    lines = chapters.withColumn("line", line).groupBy("lecture_id").agg(in_order("ord", "line", "\n").alias("lines"))
    summary = F.when(has("summary"), F.concat(F.lit("<summary>"), html_escape(F.col("summary")), F.lit("</summary>")))
    return outlines.join(lines, "lecture_id", "left").select("lecture_id", F.concat_ws("\n", F.lit("<outline>"), summary, "lines", F.lit("</outline>")).alias("outline"))


def label_passages(passages: DataFrame, lectures: DataFrame) -> DataFrame:
    """Label L{number} of each passage's lecture in its course (lectures: lecture_id, number)."""
    return passages.join(lectures, "lecture_id", "left").withColumn("label", F.concat(F.lit("L"), F.col("number").cast("string")))


def extract_citations(answers: DataFrame) -> DataFrame:
    """(question_id, ord, label, at_s): the times in square brackets, distinct, in order of first mention.

    A bracket may hold several, parted by , or ;. A time without a label takes the one before it in its bracket.
    Impossible times are left out.
    """
    item = r"(?:L\d+\s+)?\d{1,3}:\d{2}(?::\d{2})?"
    brackets = answers.select("question_id", F.posexplode(F.regexp_extract_all("content", F.lit(rf"\[({item}(?:\s*[,;]\s*{item})*)\]"), F.lit(1))).alias("bracket", "inside"))
    parts = brackets.select("question_id", "bracket", F.posexplode(F.split("inside", r"\s*[,;]\s*")).alias("part", "text"))
    own = F.nullif(F.regexp_extract("text", r"^(L\d+)\s", 1), F.lit(""))
    carried = F.last(own, ignorenulls=True).over(Window.partitionBy("question_id", "bracket").orderBy("part"))
    timed = parts.withColumns({"label": carried, "at_s": parse_timestamp(F.regexp_replace("text", r"^L\d+\s+", ""))}).where("at_s is not null")
    first = timed.groupBy("question_id", "label", "at_s").agg(F.min(F.struct("bracket", "part")).alias("p"))
    return first.select("question_id", (F.row_number().over(Window.partitionBy("question_id").orderBy("p")) - 1).alias("ord"), "label", "at_s")


def ground_citations(citations: DataFrame, passages: DataFrame, outlines: DataFrame) -> DataFrame:
    """Citations with the passage that holds the time (closed, one second of tolerance), first in rank order.

    A labelled citation needs its label. An unlabelled one that no passage holds may name a chapter start, which
    gives a lecture but no segment. valid tells whether either was found.
    """
    p = passages.select("question_id", "rank", "lecture_id", "segment_id", "start_s", "end_s", F.col("label").alias("p_label"))
    near = (F.col("at_s") >= F.col("start_s") - TOLERANCE_S) & (F.col("at_s") <= F.col("end_s") + TOLERANCE_S)
    ok = near & (F.col("label").isNull() | (F.col("label") == F.col("p_label")))
    w = Window.partitionBy("question_id", "ord").orderBy(F.col("rank").asc_nulls_last())
    met = citations.join(p, "question_id", "left").withColumn("rank", F.when(ok, F.col("rank"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    hit = F.col("rank").isNotNull()
    met = met.select("question_id", "ord", "label", "at_s", F.when(hit, F.col("lecture_id")).alias("lecture_id"), F.when(hit, F.col("segment_id")).alias("segment_id"))
    starts = outlines.select("question_id", F.col("lecture_id").alias("o_lecture"), "chapter_start_s")
    rest = met.where("lecture_id is null and label is null").join(starts, "question_id").where(F.abs(F.col("at_s") - F.col("chapter_start_s")) <= TOLERANCE_S)
    chapters = rest.groupBy("question_id", "ord").agg(F.min("o_lecture").alias("o_lecture"))
    out = met.join(chapters, ["question_id", "ord"], "left").withColumn("lecture_id", F.coalesce("lecture_id", "o_lecture")).drop("o_lecture")
    return out.withColumn("valid", F.col("lecture_id").isNotNull())


def sources_of(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """The retrieved list saved with an answer, in rank order."""
    rows = hits.join(titles, "lecture_id", "left")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lecture_id", "segment_id", "title"))).alias("sources"))


def latest_feedback(ratings: DataFrame) -> DataFrame:
    """The last rating of each answer."""
    return ratings.groupBy("message_id").agg(F.max_by(F.struct("rating", "updated_at"), F.struct("updated_at", "id")).alias("r")).select("message_id", "r.rating", "r.updated_at")


def thread_detail(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    return messages.join(feedback.select("message_id", "rating"), "message_id", "left")


def answer_outcomes(messages: DataFrame) -> DataFrame:
    outcome = F.when(F.col("failed"), "error").otherwise("done")
    return messages.where("role = 'assistant'").groupBy("scope", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def on_target(citations: DataFrame, spans: DataFrame, within: float = 10.0) -> DataFrame:
    """(question_id, on_target): a valid citation lies within some seconds of an answer span."""
    near = F.col("valid") & (F.col("at_s") >= F.col("start_s") - within) & (F.col("at_s") <= F.col("end_s") + within)
    return citations.join(spans, "question_id", "left").groupBy("question_id").agg(F.coalesce(F.max(near), F.lit(False)).alias("on_target"))


def mean(value: Column, empty: float | None = None) -> Column:
    return F.coalesce(F.avg(value), F.lit(empty).cast("double"))

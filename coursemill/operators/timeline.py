"""Sentences, timeline segments, chunks and notes from words, slides and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.text import ascii_tokens, format_timestamp, html_escape, singular, undouble_backslashes
from coursemill.operators.intervals import slide_at
from coursemill.operators.scans import greedy_marks, running, sliced

ENDERS = r"[.?!][\"'”’)\]]*$"
LEADING = ["a", "an", "the", "of", "for", "in", "on", "to", "and", "or", "with", "by"]


def split_sentences(words: DataFrame, keys: list[str], max_words: int = 40) -> DataFrame:
    """Words (keys, pos, word, start, end) cut after . ? ! or at the ``max_words``-th word since the last cut."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sentence = F.coalesce(F.count(F.when(F.col("word").rlike(ENDERS), 1)).over(before), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "_sentence").orderBy("pos")) - 1
    cut = words.withColumn("_sentence", sentence).withColumn("_piece", F.floor(place / max_words))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return cut.groupBy(*keys, "_sentence", "_piece").agg(F.min("pos").alias("pos"), F.min("start_ds").alias("start_ds"), text.alias("text")).drop("_sentence", "_piece")


def sentence_rows(words: DataFrame, max_words: int = 40) -> DataFrame:
    """Sentences of each segment, numbered from 0 through the lecture.

    words: as for split_sentences with lecture_id and segment; or a row a lecture with arrays segment, word and start_ds, in
    order of segment and place, whose sentences are cut and numbered within the row.
    """
    if "pos" not in words.columns:
        return _sentences_of_rows(words, max_words)
    rows = split_sentences(words, ["lecture_id", "segment"], max_words)
    order = ["segment", "pos"]
    numbered = running(sliced(rows, ["lecture_id"], order), ["lecture_id"], order, {"number": F.lit(1)})
    return numbered.select("lecture_id", (F.col("number") - 1).alias("index"), "start_ds", "text")


def _sentences_of_rows(words: DataFrame, max_words: int) -> DataFrame:
    """sentence_rows of a row a lecture: nothing is shuffled. Each list of places is a column, so it is made once."""
    said, n = F.col("word"), F.size("word")
    other = lambda i: ~F.get("segment", i).eqNullSafe(F.get("segment", i - 1))
    begins = lambda i: (i == 0) | other(i) | F.coalesce(F.get(said, i - 1).rlike(ENDERS), F.lit(False))
    until = lambda c: F.concat(F.slice(c, F.lit(2), F.size(c)), F.array(n))
    part = lambda c, a, b: F.slice(c, a + 1, b - a)
    cut = words.select("lecture_id", "segment", "word", "start_ds", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), begins)).alias("_starts"))
    cut = cut.withColumn("_begins", F.flatten(F.zip_with("_starts", until("_starts"), lambda a, b: F.sequence(a, b - 1, F.lit(max_words)))))
    rows = F.zip_with("_begins", until("_begins"), lambda a, b: F.struct(F.array_min(part("start_ds", a, b)).alias("start_ds"), F.array_join(part("word", a, b), " ").alias("text")))
    return cut.select("lecture_id", F.posexplode(rows).alias("index", "_s")).select("lecture_id", F.col("index").cast("long").alias("index"), "_s.*")


def build_timeline(speech: DataFrame, spans: DataFrame, longest: float = 900) -> DataFrame:
    """Segments of consecutive speech under one span, cut where they would be longer than ``longest``.

    Speech belongs to the first span that holds its midpoint. Spans are told apart by span_index, so a slide shown again
    starts a new segment. Where a segment is cut depends on where it began: greedy marks, over lectures of any length.
    """
    points = speech.withColumn("mid", (F.col("start_ds") + F.col("end_ds")) / 2)
    placed = slide_at(points, spans, "mid", "start_ds_span", "end_ds_span").drop("mid")
    marked = greedy_marks(placed, ["lecture_id"], ["idx"], "start_ds", "end_ds", longest, groups=["span_index"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    out = marked.groupBy("lecture_id", (F.col("number") - 1).alias("index")).agg(F.min("start_ds").alias("start_ds"), F.max("end_ds").alias("end_ds"), joined.alias("transcript"), F.first("slide_id").alias("slide_id"))
    return out.withColumn("segment_id", F.format_string("s%03d", F.col("index")))


def slide_rows(images: DataFrame, readings: DataFrame, spans: DataFrame) -> DataFrame:
    """A row a slide with its reading (empty if none) and its spans in order."""
    nested = spans.groupBy("lecture_id", "slide_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("spans"))
    rows = images.join(readings, ["lecture_id", "slide_id"], "left").join(nested, ["lecture_id", "slide_id"], "left")
    return rows.withColumns({"title": F.coalesce("title", F.lit("")), "text": F.coalesce("text", F.lit("")), "reader": F.coalesce("reader", F.lit("vlm")), "spans": F.coalesce("spans", F.array())})


def build_chunks(segments: DataFrame, slides: DataFrame) -> DataFrame:
    """One chunk a segment: slide title, slide text and transcript on lines, empty ones left out."""
    s = slides.select("lecture_id", "slide_id", F.col("title").alias("slide_title"), F.col("text").alias("slide_text"))
    titled = F.when(F.coalesce("slide_title", F.lit("")) != "", F.concat(F.lit("Slide: "), "slide_title"))
    text = F.concat_ws("\n", titled, F.nullif("slide_text", F.lit("")), F.nullif("transcript", F.lit("")))
    return segments.join(s, ["lecture_id", "slide_id"], "left").withColumn("text", text).drop("slide_text")


def resolve_citations(items: DataFrame, segments: DataFrame, take: tuple[str, ...] = ("start_s", "end_s")) -> tuple[DataFrame, DataFrame]:
    """Items with the times (or ``take``) of the segment they cite, and the items whose segment is unknown."""
    keys = ["lecture_id", "segment_id"]
    return items.join(segments.select(*keys, *take), keys), items.join(segments, keys, "left_anti")


def chapter_ranges(planned: DataFrame, segments: DataFrame) -> DataFrame:
    """Chapters (lecture_id, title, first, last) of a plan (lecture_id, ord, title, first_segment).

    A planned start counts if it is known and comes after every start before it. The first chapter starts at 0; a
    plan with no usable start is one chapter, titled as its first.
    """
    at = segments.select("lecture_id", F.col("segment_id").alias("first_segment"), F.col("index").alias("pos"))
    last = segments.groupBy("lecture_id").agg(F.max("index").alias("top"))
    known = planned.join(at, ["lecture_id", "first_segment"])
    seen = Window.partitionBy("lecture_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = known.withColumn("before", F.max("pos").over(seen)).where("before is null or pos > before")
    titles = planned.groupBy("lecture_id").agg(F.min_by("title", "ord").alias("title"))
    rest = last.join(kept, "lecture_id", "left_anti").join(titles, "lecture_id", "left").select("lecture_id", F.lit(0).alias("ord"), F.coalesce("title", F.lit("Lecture")).alias("title"), F.lit(0).alias("pos"))
    rows = kept.select("lecture_id", "ord", "title", "pos").unionAll(rest).join(last, "lecture_id")
    order = Window.partitionBy("lecture_id").orderBy("ord")
    first = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("pos"))
    return rows.select("lecture_id", "title", first.cast("int").alias("first"), F.coalesce(F.lead("pos").over(order) - 1, F.col("top")).cast("int").alias("last"))


def chapter_times(ranges: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Start of the first segment; end where the next chapter starts, or at the end of the video or speech."""
    start = segments.select("lecture_id", F.col("index").alias("first"), "start_s")
    end = segments.select("lecture_id", F.col("index").alias("last"), F.col("end_s").alias("last_end"))
    rows = ranges.join(start, ["lecture_id", "first"]).join(end, ["lecture_id", "last"]).join(durations, "lecture_id", "left")
    order = Window.partitionBy("lecture_id").orderBy("first")
    return rows.select("lecture_id", "title", "start_s", F.coalesce(F.lead("start_s").over(order), F.greatest("last_end", "duration_s")).alias("end_s"))


def term_key(term: Column) -> Column:
    return F.array_join(F.transform(ascii_tokens(term), singular), " ")


def locate_terms(concepts: DataFrame, words: DataFrame) -> DataFrame:
    """Where the longest leading part of each term is spoken in its segment, the earliest on a tie; else the segment's start.

    concepts: lecture_id, segment, ord, term, start_s; words: lecture_id, segment, pos, word, start_s, or a row a segment
    with arrays ``said`` and ``at`` of its words and their times in order. Leading stopwords are dropped, and no length of
    term or segment is bounded. A place at second 0 counts as not found, as does a first token that is not said and a term
    of stopwords only.
    """
    return located(concepts, words).select("lecture_id", "ord", "term", "at_s")


def located(concepts: DataFrame, words: DataFrame) -> DataFrame:
    """concepts with ``at_s`` of locate_terms."""
    tokens = ascii_tokens(F.col("term"))
    told = lambda i: F.exists(F.slice(tokens, F.lit(1), i + 1), lambda t: ~t.isin(LEADING))
    want = concepts.withColumn("want", F.filter(tokens, lambda _, i: told(i)))
    if "said" not in words.columns:
        in_turn = F.array_sort(F.collect_list(F.struct("pos", "start_s", "word")))
        words = words.groupBy("lecture_id", "segment").agg(in_turn.alias("w")).select("lecture_id", "segment", F.col("w.word").alias("said"), F.col("w.start_s").alias("at"))
    parts = words.select("lecture_id", "segment", "at", F.transform("said", lambda w: F.coalesce(ascii_tokens(w), F.array().cast("array<string>"))).alias("parts"))
    times = F.flatten(F.zip_with("parts", "at", lambda p, t: F.array_repeat(t, F.size(p))))
    met = want.join(parts.select("lecture_id", "segment", F.flatten("parts").alias("flat"), times.alias("times")), ["lecture_id", "segment"], "left")
    here = lambda i: F.slice("flat", i + 1, F.size("want"))
    matched = lambda i: F.aggregate(F.zip_with("want", here(i), lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), (s["n"] + (s["on"] & x).cast("int")).alias("n")))["n"]
    places = F.filter(F.transform("flat", lambda t, i: F.when(t == F.get("want", F.lit(0)), F.struct((-matched(i)).alias("n"), i.alias("i")))), lambda x: x.isNotNull())
    at = F.get("times", F.array_min(places)["i"])
    return met.withColumn("at_s", F.coalesce(F.nullif(at, F.lit(0.0)), "start_s")).drop("want", "flat", "times")


def merge_concepts(concepts: DataFrame) -> DataFrame:
    """One concept a lecture and key: the longest definition, the first on a tie."""
    w = Window.partitionBy("lecture_id", "key").orderBy(F.desc(F.length("definition")), "ord")
    return concepts.withColumn("key", term_key(F.col("term"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of_each(rows: DataFrame, keys: list[str | Column], order: str = "ord") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_questions(quiz: DataFrame) -> DataFrame:
    """The first question of each token sequence."""
    return first_of_each(quiz.withColumn("tokens", F.array_join(ascii_tokens(F.col("question")), " ")), ["lecture_id", "tokens"])


def unique_note_formulas(formulas: DataFrame) -> DataFrame:
    return first_of_each(formulas.withColumn("latex", undouble_backslashes(F.col("latex"))), ["lecture_id", "latex"])


def merge_readings(ocr: DataFrame, vision: DataFrame) -> DataFrame:
    """OCR's reading of a slide, replaced where vision read it; an untitled vision reading keeps OCR's title."""
    v = vision.select("deck_id", "slide_id", F.col("title").alias("v_title"), F.col("text").alias("v_text"))
    both = ocr.join(v, ["deck_id", "slide_id"], "left")
    read = F.col("v_text").isNotNull()
    return both.select("deck_id", "slide_id", F.when(read, F.coalesce(F.nullif("v_title", F.lit("")), "title")).otherwise(F.col("title")).alias("title"), F.coalesce("v_text", "text").alias("text"), F.when(read, "vlm").otherwise("ocr").alias("reader"))


def batch_requests(slides: DataFrame, size: int = 8) -> DataFrame:
    """Slides of a deck in batches for a model call."""
    number = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id")) - 1
    return slides.withColumn("batch", F.floor(number / size)).groupBy("deck_id", "batch").agg(F.array_sort(F.collect_list("slide_id")).alias("slides"))


def render_slide(title: Column, text: Column, figure: Column, latex: Column, code: Column) -> Column:
    """A slide's reading as labelled lines, escaped; empty fields are left out."""
    fields = {"Title": title, "Text": text, "Figure": figure, "LaTeX": F.array_join(latex, "; "), "Code": code}
    return F.concat_ws("\n", *(F.when(v != "", F.concat(F.lit(f"{name}: "), html_escape(v, True))) for name, v in fields.items()))


def slide_documents(slides: DataFrame) -> DataFrame:
    """(lecture_id, slide_id, slide_document) of readings."""
    document = render_slide(*(F.coalesce(c, F.lit("")) for c in ("title", "text", "figure_description")), F.coalesce("latex", F.array().cast("array<string>")), F.coalesce("code", F.lit("")))
    return slides.select("lecture_id", "slide_id", document.alias("slide_document"))


def shown_slides(segments: DataFrame) -> DataFrame:
    """Segments with ``shown``: whether their slide differs from the last slide shown (no slide does not reset it)."""
    before = Window.partitionBy("lecture_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("slide_id", ignorenulls=True).over(before)
    return segments.withColumn("shown", F.col("slide_id").isNotNull() & ~F.col("slide_id").eqNullSafe(last))


def span_text(start: Column, end: Column) -> Column:
    return F.concat(format_timestamp(start), F.lit("-"), format_timestamp(end))


def render_segments(segments: DataFrame, slides: DataFrame) -> DataFrame:
    """(lecture_id, document): a lecture's segments as blocks; a slide's content stands where it first shows.

    segments: index, segment_id, start_s, end_s, slide_id, transcript; slides: readings. A slide without a reading is none.
    """
    known = segments.join(slide_documents(slides), ["lecture_id", "slide_id"], "left").withColumn("slide_id", F.when(F.col("slide_document").isNotNull(), F.col("slide_id")))
    number = F.col("slide_id").cast("string")
    slide = F.when(F.col("shown"), F.concat(F.lit('<slide id="'), number, F.lit('">\n'), "slide_document", F.lit("\n</slide>")))
    slide = slide.when(F.col("slide_id").isNotNull(), F.concat(F.lit('<slide id="'), number, F.lit('">(same slide as before)</slide>')))
    head = F.concat(F.lit('<segment id="'), "segment_id", F.lit('" time="'), span_text(F.col("start_s"), F.col("end_s")), F.lit('">'))
    speech = F.concat(F.lit("<speech>"), html_escape(F.col("transcript"), True), F.lit("</speech>"))
    blocks = shown_slides(known).withColumn("block", F.concat_ws("\n", head, slide, speech, F.lit("</segment>")))
    return blocks.groupBy("lecture_id").agg(in_order("index", "block", "\n").alias("document"))


def in_order(order: str, text: str, by: str) -> Column:
    """Texts of a group joined in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def notes_markdown(summaries: DataFrame, chapters: DataFrame, concepts: DataFrame, formulas: DataFrame, quiz: DataFrame) -> DataFrame:
    """(lecture_id, markdown): the study notes of each lecture of ``summaries`` (lecture_id, title, tldr) as one document.

    chapters: ord, start_s, end_s, title, summary; concepts: ord, term, at_s, definition; formulas: ord, latex, at_s,
    meaning; quiz: ord, question, at_s, answer. Quiz questions are numbered from 1; without formulas the document says so.
    """
    at = F.concat(F.lit("["), format_timestamp(F.col("at_s")), F.lit("]"))
    number = F.row_number().over(Window.partitionBy("lecture_id").orderBy("ord"))
    parts = [
        (chapters, F.concat(F.lit("### ["), span_text(F.col("start_s"), F.col("end_s")), F.lit("] "), "title", F.lit("\n\n"), "summary", F.lit("\n\n"))),
        (concepts, F.concat(F.lit("- **"), "term", F.lit("** "), at, F.lit(": "), "definition", F.lit("\n"))),
        (formulas, F.concat(F.lit("- $$"), "latex", F.lit("$$ "), at, F.lit(": "), "meaning", F.lit("\n"))),
        (quiz, F.concat(number.cast("string"), F.lit(". "), "question", F.lit("\n   - Answer "), at, F.lit(": "), "answer", F.lit("\n"))),
    ]
    rows = None
    for i, (items, line) in enumerate(parts):
        part = items.select("lecture_id", F.lit(i).alias("part"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
        rows = part if rows is None else rows.unionAll(part)
    lines = rows.groupBy("lecture_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("lines"))
    body = lambda i: F.coalesce(F.array_join(F.transform(F.filter("lines", lambda x: x["part"] == i), lambda x: x["line"]), ""), F.lit(""))
    none = F.when(body(2) == "", "None.\n").otherwise(body(2))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "tldr", F.lit("\n\n## Chapters\n\n"), body(0), F.lit("## Key concepts\n\n"), body(1), F.lit("\n## Formulas\n\n"), none, F.lit("\n## Quiz\n\n"), body(3))
    return summaries.join(lines, "lecture_id", "left").select("lecture_id", text.alias("markdown"))


def chapter_at(points: DataFrame, chapters: DataFrame, t: str) -> DataFrame:
    """points with the title of the chapter under way: the last in list order that has started."""
    from coursemill.operators.intervals import asof_backward

    return asof_backward(points, chapters, ["lecture_id"], t, "chapter_s", ["title"], "ord")


def external_notes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Another producer's items (lecture_id, ord, kind, text, start, end) with times in seconds, and what cannot be read.

    A chapter needs both ends, any other item its start.
    """
    from coursemill.functions.text import parse_timestamp

    rows = raw.withColumns({"start_s": parse_timestamp(F.col("start")), "end_s": parse_timestamp(F.col("end"))})
    good = F.col("start_s").isNotNull() & ((F.col("kind") != "chapter") | F.col("end_s").isNotNull())
    return rows.where(good), rows.where(~good)


def assemble_notes(planned: DataFrame, items: DataFrame, segments: DataFrame, words: DataFrame, durations: DataFrame) -> dict[str, DataFrame]:
    """Study notes from a plan and cited items (lecture_id, ord, kind, term, definition, latex, question, segment_id).

    Chapters get their times, concepts the place where they are spoken and one definition, formulas and questions are
    listed once; ``dropped`` has the items that cite no segment of their lecture.
    """
    known, dropped = resolve_citations(items, segments, ("start_s", "end_s", "index"))
    known = known.withColumnRenamed("index", "segment")
    placed = located(known.where("kind = 'concept'").select("lecture_id", "segment", "ord", "term", "definition", "start_s"), words)
    return {
        "chapters": chapter_times(chapter_ranges(planned, segments), segments, durations),
        "concepts": merge_concepts(placed).select("lecture_id", "ord", "term", "definition", "at_s"),
        "formulas": unique_note_formulas(known.where("kind = 'formula'")).select("lecture_id", "ord", "latex", "start_s"),
        "quiz": unique_questions(known.where("kind = 'quiz'")).select("lecture_id", "ord", "question", "start_s"),
        "dropped": dropped.select("lecture_id", "ord", "kind", "segment_id"),
    }


def evidence(sources: DataFrame, sentences: DataFrame, slides: DataFrame) -> DataFrame:
    """(question_id, evidence): the passages an answer was given, as a judge sees them, in rank order.

    sources: question_id, rank, lecture_id, segment_id, start_s, end_s, slide_id, slide_title; sentences: lecture_id, start_s,
    text; slides: readings. A passage has its span, its slide and its sentences with their times.
    """
    from coursemill.operators.intervals import attach_sentences

    said = attach_sentences(sources, sentences)
    line = lambda s: F.concat(F.lit("["), format_timestamp(s["start_s"]), F.lit("] "), html_escape(s["text"], True))
    passages = said.withColumn("lines", F.when(F.size("sentences") > 0, F.array_join(F.transform("sentences", line), "\n")))
    parts = ("rank", "lecture_id", "slide_id", "slide_title", "start_s", "end_s", "lines")
    asked = passages.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("passages"))
    # a slide goes to a question once, however many of its passages show it
    shown = sources.select("question_id", "lecture_id", "slide_id").distinct().join(slide_documents(slides).where("slide_document <> ''"), ["lecture_id", "slide_id"])
    known = shown.groupBy("question_id").agg(F.collect_list(F.struct("lecture_id", "slide_id", "slide_document")).alias("documents"))

    def block(p: Column) -> Column:
        slide = F.when(F.coalesce(p["slide_title"], F.lit("")) != "", F.concat(F.lit(' slide="'), html_escape(p["slide_title"], True), F.lit('"')))
        head = F.concat(F.lit('<passage time="'), span_text(p["start_s"], p["end_s"]), F.lit('"'), F.coalesce(slide, F.lit("")), F.lit(">"))
        own = F.get(F.filter("documents", lambda x: (x["lecture_id"] == p["lecture_id"]) & (x["slide_id"] == p["slide_id"])), F.lit(0))["slide_document"]
        return F.concat_ws("\n", head, F.concat(F.lit("<slide>\n"), own, F.lit("\n</slide>")), p["lines"], F.lit("</passage>"))

    blocks = F.array_join(F.transform("passages", block), "\n")
    return asked.join(known, "question_id", "left").select("question_id", F.concat(F.lit("<passages>\n"), blocks, F.lit("\n</passages>")).alias("evidence"))

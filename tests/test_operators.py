"""Operators on hand-made inputs."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.functions import links
from coursemill.functions import text as T
from coursemill.kernels import latex, words

from coursemill.operators import costs, evals, qa, slides, timeline
from coursemill.sources import buckets, io


def test_timestamps(spark):
    values = ["01:30", "[1:00:05]", "99:59", "1:60:00", "01:60", "x", "", None, "00:05.5"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(T.parse_timestamp(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [90.0, 3605.0, 5999.0, None, None, None, None, None, 5.5]


@pytest.mark.parametrize(
    ("tex", "want"),
    [
        (r"\pi_{\theta}", "π_θ"),
        (r"\frac{a}{bc}", "a/(bc)"),
        (r"\hat{y} \in \mathbb{R}", "ŷ ∈ ℝ"),
        (r"\sqrt{n} 5\%", "√n 5%"),
        (r"\begin{cases} x \le 1 \end{cases}", " x ≤ 1"),
        ("a {b} 5%", "a {b} 5%"),
        (r"\unknown x", r"\unknown x"),
    ],
)
def test_readable(tex, want):
    assert latex.readable(tex) == want


def test_upright():
    assert latex.upright(r"len(L) + \text{fib(n)} + aT(n)") == r"\operatorname{len}(L) + \text{fib(n)} + aT(n)"


def test_place():
    parts, missing = latex.place("It is O(n log n), then O(1) + O(n) -> len.", ["O(n)", "O(1)", "n", "x^2"])
    assert parts == [("It is O(n log n), then ", False), (r"O(1) + O(n)", True), (" -> len.", False)]
    assert missing == ["n", "x^2"]


def test_links(spark):
    bad = {"ftp://a.org": "scheme", "http://10.0.0.1": "private", "https://u:p@a.org": "credentials", "http://host/x": "private", "http://a.org:x/": "invalid", "http://a.org:70000/": "invalid", "http://[::ffff:127.0.0.1]/": "private", "http://[2001:4860:4860::8888]/": None, "http://8.8.8.8:80/": None, "http://[::1": "invalid", "https://": "no host", "https://a.local./": "private", "nothing": "scheme", "https://a.org/" + "x" * 2100: "too long", " https://a.org/v ": None, "https://@a.org/": None}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*bad, None])], "i int, u string").select("i", links.refusal(F.col("u")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [*bad.values(), "scheme"]


def test_excerpts_and_highlights(spark):
    far = "aa " * 40 + "Näh-Wörter of wörtlich, the word"
    cases = [(far, "the Wört?"), ("short wört", "wört"), ("x" * 99 + ".wört", "wört"), (far, "the of"), (None, "wört"), ("\U0001f600 " * 50 + "wört", "wört")]
    rows = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(cases)], "i int, t string, q string")
    got = rows.select("i", links.excerpt(F.col("t"), F.col("q")).alias("e"), links.highlights(F.col("t"), F.col("q")).alias("h")).orderBy("i").collect()
    assert got[0].e == "…" + ("aa " * 40 + "Näh-Wörter")[66:] + " of wörtlich, the word" and got[0].h == ["Wörter", "wörtlich"]
    assert [r.e for r in got[1:]] == ["short wört", "…wört", far, "", "…" + "\U0001f600 " * 29 + "wört"]
    assert [r.h for r in got[1:]] == [["wört"], ["wört"], [], [], ["wört"]]


def test_latex_groups():
    cases = {r"\frac{\alpha}{\sqrt{xy}}": "α/(√(xy))", r"x_{\text{ab}} \foo{\beta}": "x_{ab} \\foo{β}", r"\frac{x_{ab}}{c}": r"\frac{x_{ab}}{c}", r"\{a\} \unclosed{": r"{a} \unclosed{", r"\mathbf {v}^{2}  \vec{}": "v^2 \\vec{}", r"\\alpha": r"\\alpha", r"\\beta x": "β x"}
    assert {k: latex.readable(k) for k in cases} == {k: (v if k != r"\\alpha" else "α") for k, v in cases.items()}


def test_edit_operations_match_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 9)).astype(str).tolist() for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i - 1, j] + 1, d[i, j - 1] + 1)
        s, dl, ins = words.edit_operations(a, b)
        assert s + dl + ins == d[-1, -1]
        assert len(a) - dl + ins == len(b)
    assert words.edit_operations(["a"] * 70_000, ["b"] * 3) == (3, 69_997, 0)  # no length is too long


def test_slide_machine(spark):
    a, built, b, camera = [0, 0, 0, 0], [1, 0, 0, 0], [-1, -1, -1, -1], None
    shots = [camera, camera, a, a, built, camera, b, b, b, built, built, built]
    rows = [("L", float(t), s is not None, *(s or [7, 7, 7, 7])) for t, s in enumerate(shots)]
    frames = spark.createDataFrame(rows, "lecture_id string, t_s double, is_slide boolean, h0 long, h1 long, h2 long, h3 long")
    got = slides.detect_slides(frames, spark.createDataFrame([("L", 12.0)], "lecture_id string, duration_s double")).orderBy("span_index").collect()
    assert [(r.slide_id, r.start_s, r.end_s) for r in got] == [(0, 2.0, 6.0), (1, 6.0, 9.0), (0, 9.0, 12.0)]
    assert got[0].slide_share == 9 / 12


def fold_by_hand(shots: list[tuple[float, np.ndarray]]) -> list[tuple[int, float]]:
    """The rule of detect_slides, a sample at a time."""
    far = lambda a, b: sum(bin(int(x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True)) / (64 * len(a))
    known: list[np.ndarray] = []
    at, spans, waiting = None, [], []
    for t, h in shots:
        if at is not None and far(h, known[at]) < slides.SAME:
            known[at], waiting = h, []
            continue
        waiting = [*waiting, (t, h)] if waiting and far(h, waiting[-1][1]) < slides.SAME else [(t, h)]
        if len(waiting) >= slides.STABLE:
            at = next((i for i, k in enumerate(known) if far(k, h) < slides.REVISIT), len(known))
            known[at : at + 1] = [h]
            spans.append((at, waiting[0][0]))
            waiting = []
    return spans


def test_deck_in_one_batch_and_in_many():
    rng = np.random.default_rng(8)
    for _ in range(30):
        base = rng.integers(-(2**62), 2**62, (5, 4))
        shots = []
        for t in range(int(rng.integers(1, 120))):
            h = base[int(rng.integers(0, 5)) if rng.random() < 0.4 or not shots else last].copy()
            last = int(np.flatnonzero((base == h).all(axis=1))[0])
            for _ in range(int(rng.integers(0, 20))):
                h[int(rng.integers(0, 4))] ^= np.int64(1 << int(rng.integers(0, 62)))
            shots.append((float(t), h))
        t, h = np.array([s[0] for s in shots]), np.array([s[1] for s in shots])
        for step in (1, 7, 500):
            deck = slides.Deck(4)
            deck.LOOK = 16
            for i in range(0, len(t), step):
                deck.feed(t[i : i + step], h[i : i + step])
            assert deck.spans == fold_by_hand(shots)


def test_sample_per_key_counts_from_the_last_one_kept(spark):
    frames = spark.createDataFrame([("k", float(t), t) for t in (0, 4, 9, 10, 19, 20, 31)], "page string, t_s double, frame long")
    assert [r.frame for r in slides.sample_per_key(frames, ["page"], 3, 10.0).orderBy("t_s").collect()] == [0, 10, 20]


def test_chat_history(spark):
    m = [(1, 0, "user", "q0", False), (1, 1, "assistant", "bad", True), (1, 2, "user", "q2", False), (1, 3, "assistant", "a3", False), (1, 4, "assistant", "again", False), (1, 5, "user", "q5", False), (1, 6, "assistant", "", False), (1, 7, "assistant", "a7", False)]
    rows = qa.chat_history(spark.createDataFrame(m, "thread_id long, ord long, role string, content string, failed boolean"))
    assert [(r.question, r.answer) for r in rows.orderBy("turn").collect()] == [("q2", "a3"), ("q5", "a7")]


def test_citations(spark):
    a = spark.createDataFrame([(1, "x [01:30, L2 02:00; 02:10] [05:00] [99:99] [01:30] [1:00:00]")], "question_id long, content string")
    c = qa.extract_citations(a)
    assert [(r.label, r.at_s) for r in c.orderBy("ord").collect()] == [(None, 90.0), ("L2", 120.0), ("L2", 130.0), (None, 300.0), (None, 3600.0)]
    p = spark.createDataFrame([(1, 0, "a", "s1", 90.4, 150.0, "L2"), (1, 1, "b", "s9", 3600.0, 3660.0, "L1")], "question_id long, rank int, lecture_id string, segment_id string, start_s double, end_s double, label string")
    o = spark.createDataFrame([(1, "a", 299.5)], "question_id long, lecture_id string, chapter_start_s double")
    got = {(r.label, r.at_s): (r.segment_id, r.lecture_id, r.valid) for r in qa.ground_citations(c, p, o).collect()}
    assert got[(None, 90.0)] == ("s1", "a", True)
    assert got[("L2", 130.0)] == ("s1", "a", True)
    assert got[(None, 300.0)] == (None, "a", True)
    assert got[(None, 3600.0)] == ("s9", "b", True)


def test_located_terms(spark):
    c = spark.createDataFrame([("L", 0, 0, "the binary searches", 5.0), ("L", 0, 1, "heap sort", 5.0)], "lecture_id string, segment int, ord int, term string, start_s double")
    said = "so binary trees and binary search, ok".split()
    w = spark.createDataFrame([("L", 0, i, x, 5.0 + i) for i, x in enumerate(said)], "lecture_id string, segment int, pos int, word string, start_s double")
    assert [r.at_s for r in timeline.locate_terms(c, w).orderBy("ord").collect()] == [6.0, 5.0]


def test_locate_long_terms_and_all_leading_stopwords(spark):
    long = [f"t{i}" for i in range(120)]
    said = [*long[:9], "x", *long[:110], "y", *long, "root", "or"]
    terms = [" ".join(long), "of the " + " ".join(long[:12]), "on to the root", "of the", "roots"]
    c = spark.createDataFrame([("L", 0, k, t, 5.0) for k, t in enumerate(terms)], "lecture_id string, segment int, ord int, term string, start_s double")
    w = spark.createDataFrame([("L", 0, i, x, 10.0 + i) for i, x in enumerate(said)], "lecture_id string, segment int, pos int, word string, start_s double")
    assert [r.at_s for r in timeline.locate_terms(c, w).orderBy("ord").collect()] == [131.0, 20.0, 251.0, 5.0, 5.0]


def test_golden_and_replace(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"lecture_id": "L", "duration_s": 99, "questions": [{"id": "q1", "kind": "fact", "question": "?", "answer": "a", "spans": [["00:10", "01:05"]]}, {"id": "q2", "kind": "unanswerable", "question": "?"}]}')
    rows = {r.question_id: [(s.start_s, s.end_s) for s in r.spans] for r in io.read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert rows == {"q1": [(10.0, 65.0)], "q2": []}
    new = spark.createDataFrame([("a", 1), ("b", 2)], "lecture_id string, v int")
    buckets.replace_by_key(new, str(tmp_path / "t"), ["lecture_id"])
    buckets.replace_by_key(spark.createDataFrame([("a", 9)], "lecture_id string, v int"), str(tmp_path / "t"), ["lecture_id"])
    assert sorted(map(tuple, buckets.read(spark, str(tmp_path / "t")).collect())) == [("a", 9), ("b", 2)]


def test_regions_and_coco(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"pdf": "x.pdf", "pages": [{"page": 3, "regions": [{"label": "figure", "box": [1, 2, 3, 4]}]}]}')
    assert [tuple(r) for r in io.read_page_regions(spark, str(tmp_path / "r.json")).collect()] == [("x.pdf", 3, "figure", [1.0, 2.0, 3.0, 4.0])]
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "f.png", "width": 9, "height": 9}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [0, 0, 4, 5], "area": 20}], "categories": [{"id": 2, "name": "slide"}]}')
    assert [tuple(r) for r in io.read_coco(spark, str(tmp_path / "c.json")).collect()] == [(1, "f.png", "slide", [0.0, 0.0, 4.0, 5.0])]
    (tmp_path / "artifacts" / "asr").mkdir(parents=True)
    (tmp_path / "artifacts" / "asr" / "k.json").write_text('{"key": "k", "stage": "asr", "output": "{}"}')
    assert io.read_artifacts(spark, str(tmp_path), "asr").first().key == "k"
    io.append_eval_runs(spark.createDataFrame([("asr", 1.0)], "suite string, value double"), str(tmp_path / "runs"))
    io.append_eval_runs(spark.createDataFrame([("asr", 2.0)], "suite string, value double"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_tidy_readings(spark):
    from coursemill.operators.tidy import tidy_readings

    rows = [("LINEAR\nSEARCH", "linear search\nis 0(n)", "None", ["\\\\frac{a}{b}", "\\frac{a}{b}"], "''", "ocr"), ("A", "A B", "", [], "", "vlm")]
    got = tidy_readings(spark.createDataFrame(rows, "title string, text string, figure_description string, latex array<string>, code string, reader string")).orderBy(F.desc("reader")).collect()
    assert (got[1].title, got[1].text, got[1].figure_description, got[1].code, got[1].latex) == ("LINEAR SEARCH", "is O(n)", "", "", ["\\frac{a}{b}"])
    assert got[0].text == "A B"


def test_feedback_stream(spark, tmp_path):
    from coursemill.streaming.jobs import upsert_feedback_stream

    schema = "id long, message_id long, rating string, updated_at timestamp"
    for i, rows in enumerate(([(1, 1, "up", datetime(2024, 1, 1))], [(2, 1, "down", datetime(2024, 1, 2)), (3, 2, "up", datetime(2024, 1, 2))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = upsert_feedback_stream(stream, str(tmp_path / "out"))
    assert sorted((r.message_id, r.rating) for r in got.collect()) == [(1, "down"), (2, "up")]


def test_coco_documents_are_read_back(spark, tmp_path):
    rows = [("train", f"f{i:02d}", "slide" if i % 2 else None, 1.0 * i, 2.0, 10.0 * i, 9.5, 640, 360) for i in range(9)] + [("train", "f01", "figure", 0.0, 0.0, 5.0, 5.0, 640, 360), ("test", "g", "figure", 1.0, 1.0, 4.0, 3.0, 640, 360)]
    boxes = spark.createDataFrame(rows, "split string, file_name string, label string, x1 double, y1 double, x2 double, y2 double, width int, height int")
    io.write_coco(boxes, ["slide", "figure"], str(tmp_path / "coco"), images_per_document=4)
    got = io.read_coco(spark, str(tmp_path / "coco" / "split=train")).collect()
    assert sorted((r.file_name, r.label, r.bbox) for r in got) == sorted((f, k, [a, b, c - a, d - b]) for s, f, k, a, b, c, d, _, _ in rows if s == "train" and k)
    assert len({r.image_id for r in got}) == 4


def test_tables_are_replaced_together(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "lecture_id string, v int")
    root = str(tmp_path / "w")
    buckets.replace_tables({"a": table([("x", 1), ("y", 2)]), "b": table([("x", 3)])}, root, ["lecture_id"])
    assert buckets.replace_tables({"a": table([("x", 9)]), "b": table([("y", 4)])}, root, ["lecture_id"]) == 1
    assert sorted(map(tuple, buckets.read(spark, root, "a").collect())) == [("x", 9), ("y", 2)]
    assert sorted(map(tuple, buckets.read(spark, root, "b").collect())) == [("x", 3), ("y", 4)]


def test_note_checks_number_items_of_equal_order_by_time(spark):
    chapters = spark.createDataFrame([(1, 0, 0.0, 100.0)], "lecture_id long, ord long, start_s double, end_s double")
    durations = spark.createDataFrame([(1, 100.0)], "lecture_id long, duration_s double")
    items = [(1, "quiz", 5, at) for at in (300.0, 50.0, 200.0)] + [(1, "quiz", 4, 70.0)]
    want = {"quiz[2] at 03:20 is outside the video (length 01:40)", "quiz[3] at 05:00 is outside the video (length 01:40)"}
    for given in (items, items[::-1]):
        rows = spark.createDataFrame(given, "lecture_id long, kind string, ord long, at_s double")
        issues, counts = evals.note_checks(chapters, rows, durations)
        assert {r.issue for r in issues.collect()} == want
        assert counts.first()[1:3] == (6, 2)


def test_warehouse_tables_over_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/warehouse;create=true"
    rows = spark.range(50).selectExpr("id", "id * 2 as twice")
    io.write_table(rows, url, "runs", batch=7)
    io.write_table(rows.where("id < 5"), url, "runs")
    got = io.read_table(spark, url, "runs", "ID", (0, 50, 4))
    assert got.rdd.getNumPartitions() == 4 and got.count() == 55
    assert io.read_table(spark, url, "runs").where("ID = 3").count() == 2


def test_cost_of_a_request(spark):
    price = {"input": 2.0, "output": 12.0, "input_audio": None, "long_context_threshold": 200_000, "long_input": 4.0, "long_output": 18.0}
    rows = [(1, 1000, 100, 0, 0, 0), (2, 200_000, 100, 0, 50, 7), (3, 200_000, 100, 1, 50, 7)]
    columns = spark.createDataFrame(rows, "id int, i int, o int, a int, u int, t int").withColumns({n: F.lit(v).cast("double") for n, v in price.items()})
    got = {r.id: r.c for r in columns.select("id", costs.token_cost(*map(F.col, "ioaut")).alias("c")).collect()}
    assert got == {1: 0.0032, 2: pytest.approx((200_050 * 2 + 107 * 12) / 1e6), 3: pytest.approx((200_051 * 4 + 107 * 18) / 1e6)}
    other = columns.withColumns({"input_audio": F.lit(1.0), "long_context_threshold": F.lit(None).cast("double"), "long_input": F.lit(0.0)})
    assert other.where("id = 3").select(costs.token_cost(*map(F.col, "ioaut")).alias("c")).first().c == pytest.approx((200_050 * 2 + 1 + 107 * 12) / 1e6)

"""Tokens, packing, fingerprints, quality, pages and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import tempfile
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coursemill.llm import bpe, fingerprints, html_extraction, packing, quality, queries, token_output
from coursemill.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, class int, file int, host string"
TEXTS = ["Hello, WORLD! it's we'll 'quoted' 3.14", None, "", "foo<|endoftext|>bar <|startoftext|>", "İstanbul ΣΑΣ ﬁ é x́ 日本語 \U0001f600", "a" * 5000, "\x01 a\x01b \x1c c\x1cd", "ñandú naïve tab\tnew\nline " * 300, "Hello, WORLD! it's we'll 'quoted' 3.14"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def frame(spark):
    return spark.createDataFrame([(i if i != 5 else None, t, "x", 1, 2, "h") for i, t in enumerate(TEXTS)], SCHEMA).repartition(2)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe(spark, library):
    encoded = bpe.encode(frame(spark)).collect()
    want = {(i if i != 5 else None): ids_of(library, t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.ids for r in encoded} == want
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark))).collect()}
    assert texts == {i: library.decode(v, skip_special_tokens=False) if v else "" for i, v in want.items()}


def test_bpe_query_on_the_smallest_table(spark, library):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: r for r in bpe.query(spark, DIR).collect()}
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = ids_of(library, text)
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, library, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(frame(spark), path)
    rows = token_output.read_tokens(spark, path).collect()
    assert {r.doc_id: r.ids for r in rows} == {(i if i != 5 else None): [*ids_of(library, t), 2] for i, t in enumerate(TEXTS)}
    starts = {r.doc_id: r.start for r in token_output.token_starts(spark, path).collect()}
    at = 0
    for doc in [None, 0, 1, 2, 3, 4, 6, 7, 8]:
        assert starts[doc] == at
        at += len(ids_of(library, TEXTS[5 if doc is None else doc])) + 1
    plan = token_output.read_tokens(spark, path, ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    assert token_output.read_tokens(spark, path, ("doc_id", "n_tokens")).where("doc_id = 3").first().n_tokens == len(ids_of(library, TEXTS[3])) + 1


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, library, length):
    rows = packing.pack(frame(spark), length=length).collect()
    want = {(i if i != 5 else None): [*ids_of(library, t), 1] for i, t in enumerate(TEXTS)}
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4"))
    for doc, own in pieces.items():
        assert [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) == len(want[doc])
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True))
        assert own[-1][0] + own[-1][1] <= length


def test_cut_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    histogram = dict(zip(*np.unique(rng.integers(1, 257, 5000), return_counts=True), strict=True))
    histogram = {int(c): int(n) for c, n in histogram.items()}
    plan = packing.cut_plan(histogram, 256)
    used: dict = {}
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 256
        for c, n in pattern.items():
            used[c] = used.get(c, 0) + n * times
    assert used == histogram
    demand = np.array([histogram.get(c, 0) for c in range(1, 257)])
    relaxed = sum(use for _, use in packing.column_generation(demand, 256))
    assert relaxed >= sum(c * n for c, n in histogram.items()) / 256 - 1e-6
    assert sum(t for _, t in plan) <= 1.01 * relaxed + 64


def test_fingerprints_edges(spark):
    docs = frame(spark)
    rows = {r.doc_id: r for r in fingerprints.sketches(docs).collect()}
    assert rows[0].sketch == rows[8].sketch
    assert rows[1].sketch == rows[2].sketch == []
    nexts = {r.doc_id: r.next_text for r in fingerprints.with_next(docs).collect()}
    assert nexts[8] == TEXTS[7] and nexts[0] == TEXTS[5] and nexts[None] == TEXTS[8]
    assert fingerprints.with_next(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name]).fetchdf()
    got = queries.QUERIES[name](spark, DIR).toPandas()[list(want.columns)]
    key = list(want.columns[:2])
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_quality_against_a_plain_sample(spark):
    """Counts, ratio, noise and the cut by loops; only the hashes of tokens and of ids are the operator's."""
    import math
    import re
    from collections import Counter
    from functools import lru_cache

    docs, labels = pd.read_parquet(f"{DIR}/documents.parquet"), pd.read_parquet(f"{DIR}/labels.parquet")
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+")
    bucket = lru_cache(None)(lambda text, i: int(quality.features(np.frombuffer(text, np.uint8))[i]))

    def bag(text: str | None) -> Counter:
        words = token.findall((text or "").encode())
        return Counter([bucket(w, 0) for w in words] + [bucket(a + b" " + b, 2) for a, b in zip(words[:-1], words[1:], strict=True)])

    bags = {d: bag(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    good = set(labels[labels.quality == 1].doc_id)
    raw, target = Counter(), Counter()
    for d, own in bags.items():
        raw.update(own)
        if d in good:
            target.update(own)
    size = {id(c): sum(c.values()) + 0.5 * (1 << 14) for c in (raw, target)}
    ratio = lambda b: math.log((target[b] + 0.5) / size[id(target)]) - math.log((raw[b] + 0.5) / size[id(raw)])
    hashes = {r.id: r.h for r in spark.createDataFrame([(int(d),) for d in docs.doc_id], "id long").select("id", F.xxhash64("id", F.lit(1)).alias("h")).collect()}
    weight = {d: sum(n * ratio(b) for b, n in own.items()) for d, own in bags.items()}
    score = {d: w - math.log(-math.log((((hashes[d] % (1 << 64)) >> 11) + 0.5) / (1 << 53))) for d, w in weight.items()}
    share = len(good) / labels[labels.quality.notna()].doc_id.nunique() + 0.01
    want = sorted(score, key=lambda d: (-score[d], d))[: math.ceil(share * len(docs))]
    got = {r.doc_id: r for r in quality.query(spark, DIR).collect()}
    assert set(got) == set(want)
    assert all(got[d].log_weight == pytest.approx(weight[d], abs=1e-6) and got[d].score == pytest.approx(score[d], abs=1e-6) for d in want)


def test_quality_held_out(spark):
    docs, labels = pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    seen, held = labels[labels.doc_id % 2 == 0], labels[labels.doc_id % 2 == 1]
    kept = {r.doc_id for r in quality.quality_sample(spark.createDataFrame(docs), spark.createDataFrame(seen)).collect()}
    good, bad = held[held.quality == 1].doc_id, held[held.quality == 0].doc_id
    assert np.mean([d in kept for d in good]) > 0.95
    assert np.mean([d in kept for d in bad]) < 0.2


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.quality_sample(frame(spark), labels, share=1.0).count() == len(TEXTS)
    assert quality.quality_sample(frame(spark), labels, share=0.5).count() == 5
    assert quality.quality_sample(frame(spark), labels.limit(0)).count() == len(TEXTS)
    assert quality.quality_sample(frame(spark).limit(0), labels).count() == 0


def test_top_k(spark):
    values = np.random.default_rng(1).normal(size=5000).round(1)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "doc_id long, score double")
    for k in (0, 1, 777, 4999, 6000):
        want = {i for i, _ in sorted(enumerate(values), key=lambda x: (-x[1], x[0]))[:k]}
        assert {r.doc_id for r in quality.top_k(rows, k).collect()} == want


PAGE = """<!DOCTYPE html><html><head><title>t{i}</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home {i}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post"><h1>Head {i} &amp; more</h1><p>First <b>bold</b>
 text {i}.<p>Second &lt;x&gt; {i}<div class="ad">buy</div><form><input value="z">mail</form><p>Subscribe now</p></article><section class="comments"><p>comment {i}</p></section></main><aside>side</aside><footer>foot</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(i=i), "x", 1) for i in range(8)] + [(9, None, None, "x", 1), (10, "http://one.org/", "<p>Only <p>this&nbsp;page <!-- cut", "x", 1), (3, "http://h.org/3", PAGE.format(i=3), "x", 1), (11, "http://h.org/11", "", "x", 1)]
    frame = spark.createDataFrame(rows[:9] + rows[9:11], "page_id long, url string, html string, slot string, texts int")
    got = html_extraction.extract(frame).collect()
    assert len(got) == 11
    by = {r.page_id: r for r in got}
    for i in range(8):
        assert by[i].text == f"Head {i} & more\nFirst bold text {i}.\nSecond <x> {i}"  # "Subscribe now" stands on every page
        assert by[i].n_chars == len(by[i].text)
    assert by[9].text == "" and by[10].text == "Only\nthis page"
    assert html_extraction.extract(frame.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


SHARED = "<html><body><div><p>Menu of the site</p></div><div><div><h2>Head {i}</h2><p>Words of page {i}.</p>{box}<p>Thanks to all readers</p></div></div></body></html>"
BOX = "<section><h4>Sign up here</h4><ul><li>Leave an address</li></ul></section>"


def test_html_template_survives_empty_and_cut_pages(spark):
    pages = [(i, f"http://h.org/{i}", SHARED.format(i=i, box=BOX if i % 3 == 0 else "")) for i in range(30)]
    cut = SHARED.format(i=32, box="").split("<h2>")[0]
    rows = [*pages, (30, "http://h.org/30", ""), (31, "http://h.org/31", None), (32, "http://h.org/32", cut), pages[3]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extraction.extract(frame).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i in range(30):
        assert by[i] == f"Head {i}\nWords of page {i}."
    assert by[30] == by[31] == ""


def test_html_classes_are_grouped_by_vector(spark):
    pages = [(i, "h", SHARED.format(i=i, box=BOX if i % 3 == 0 else "")) for i in range(30)]
    rows = spark.createDataFrame(pages, "page_key long, host string, html string")
    sizes = rows.groupBy("host").count().withColumnRenamed("count", "of")
    classes = html_extraction.equivalence_classes(html_extraction.occurrences(html_extraction.tokens(rows)), sizes).collect()
    nested = [{m.token.rpartition(">")[2] for m in c.members if not m.token.startswith("#")} for c in classes if not c.root]
    assert nested == [{"section", "h4", "ul", "li"}]


@pytest.mark.parametrize(
    "page",
    [
        '<html><body class="has-sidebar"><div id="page" class="no-sidebar"><p>Kept words {i}.</p></div></body></html>',
        '<body><main class="related-layout"><article class="post comments-open"><p>Kept words {i}.</p></article><div class="related">More {i}</div></main></body>',
        '<body><div class="social-layout"><article><p>Kept words {i}.</p><div class="share">Share {i}</div></article></div></body>',
    ],
)
def test_html_noise_words_above_the_article(spark, page):
    rows = [(i, f"http://h{i * (n == 1)}.org/{i}", page.format(i=i)) for n in (1, 8) for i in range(n)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(i, f"Kept words {i}.") for i in range(8)}
    assert html_extraction.main_text(page.format(i=1), None, set()) == "Kept words 1."


def test_html_a_noise_word_on_one_page_is_no_template(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><article><p>Words {i}.</p>{'<div class=\"notice\">An own notice.</div>' if i == 3 else ''}</article></body>") for i in range(9)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got}[3] == "Words 3.\nAn own notice."


@pytest.mark.parametrize("name", ["social-science", "comment-thread-analysis", "ad-free", "no-sidebar", "share-price-table", "notice", "header", "post-header", "widget"])
@pytest.mark.parametrize("pages", [1, 2, 8])
def test_html_parts_of_an_article_stay_whatever_their_name(spark, name, pages):
    page = "<body><nav>Site</nav><article><h1>Head {i}</h1><section class='{name}'><p>An own paragraph, {i} of all.</p></section><p>End {i}.</p></article></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i=i, name=name)) for i in range(pages)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Head {i}\nAn own paragraph, {i} of all.\nEnd {i}." for i in range(pages)}


@pytest.mark.parametrize("pages", [4, 5])
def test_html_lines_that_every_page_repeats_go_alike_on_small_hosts(spark, pages):
    page = "<body><article><h1>Head {i}</h1><p>Own words {i}.</p><p>We thank all readers.</p><div class='notice-box'>Mind the gap</div><div class='comments'>Said {i}</div></article></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i=i)) for i in range(pages)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Head {i}\nOwn words {i}." for i in range(pages)}


def test_html_generated_templates(spark):
    """Pages made from drawn templates, whose main text is known."""
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words, n))
    rows, want = [], {}
    for host in range(12):
        wrap = rng.choice(["<article>{}</article>", "<main><div class='text'>{}</div></main>", "<div id='page'><div class='story'>{}</div></div>"])
        menu, foot, notice = line(5), line(9), line(7)
        for i in range(int(rng.integers(4, 30))):
            key = host * 100 + i
            blocks = [f"Title {key}", *(line(int(rng.integers(8, 40))) + f" {key}" for _ in range(int(rng.integers(2, 6))))]
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
            body += f"<div class='notice'>{notice}</div><div class='comment-list'><p>{line(6)}</p></div><script>x</script>"
            rows.append((key, f"https://h{host}.net/{i}", f"<html><head><title>t</title></head><body><div class='menu'>{menu}</div>{wrap.format(body)}<footer>{foot}</footer></body></html>"))
            want[key] = "\n".join(blocks)
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_html_paragraphs_beside_the_longest_stay():
    assert html_extraction.main_text(f"<p>Short one.<p>{'long ' * 99}", None, set()).startswith("Short one.\nlong")


def test_pipeline_null_and_repeated_ids(spark):
    import corpus_pipeline

    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (8, words(5)), (8, words(5)), (9, words(3) + " end"), (None, words(4)), (None, None)]
    docs = spark.createDataFrame([(i, t, f"l{k}", "s", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = lambda df: sorted([(r.doc_id, r.text, r.lang) for r in df.collect()], key=str)
    want = sorted([(i, t, f"l{k}") for k, (i, t) in enumerate(rows)], key=str)

    everything = spark.createDataFrame([(8, 1)], "doc_id long, quality int")  # all labels are good, so all rows are drawn
    everything.write.mode("overwrite").parquet(path := f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/labels.parquet")
    assert seen(corpus_pipeline.select_quality(spark, docs, path.rpartition("/")[0])) == want
    assert seen(corpus_pipeline.drop_near_copies(spark, docs, "")) == [w for w in want if w[2] in ("l0", "l1", "l2", "l3", "l4", "l8")]
    cut = corpus_pipeline.cut_repeats(spark, docs, "").collect()
    assert sorted(r.lang for r in cut) == sorted(w[2] for w in want)
    texts = {r.lang: r.text for r in cut}
    assert all(texts[f"l{k}"] == rows[k][1] for k in range(6))
    assert texts["l7"] == "" and texts["l8"] == "" and len(texts["l6"]) < len(rows[6][1])


def test_sketches_merge_and_estimate_containment(spark):

    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:400]), "b"), (2, " ".join(words[:400]), "b"), (3, "", "b"), (4, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    sketches = fingerprints.with_sketch(docs, "text", "sketch")
    by = {r.part: r.sketch for r in fingerprints.merged(sketches, ["part"]).collect()}
    one = {r.doc_id: r.sketch for r in sketches.collect()}
    assert by == {"a": one[1], "b": one[2], "c": []}
    pair = spark.createDataFrame([(one[2], one[1]), ([], one[1])], "a array<string>, b array<string>")
    assert [r.c for r in pair.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, None]
    assert 0.05 < len(one[2]) / len(one[1]) < 0.15  # a tenth of the shingles

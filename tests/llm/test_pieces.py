"""SentencePiece encoding, its spans and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece

from coursemill.llm import sentence_pieces
from coursemill.llm.sentence_pieces import Model, Normalizer, Pieces, default_model, encode_texts, fields
from coursemill.llm.tokens import Remembered

DIR = "/root/testdata/sf0.001"
ALPHABET = [*"abcdefgh the  \n\t,.0123AB", "é", "ﬁ", "日", "\U0001f600", "\0", "\x01", "ñ", "  ", "<s>", "<0x0A>", "<unk>", "́", "ß", "Ω"]
FIXED = [None, "", " ", "   ", "▁", "a" * 5000, "  " * 400, "the quick brown fox", "x ▁ y", "the quick brown fox", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def drawn(seed: int, n: int, alphabet: list[str], size: int = 80) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", [ALPHABET, [*ALPHABET, "▁"]], ids=["plain", "with the space symbol"])
def test_ids_and_spans(library, alphabet):
    texts = [*(t for t in FIXED if "▁" in alphabet or "▁" not in (t or "")), *drawn(1, 600, alphabet)]
    memory = Remembered(Pieces(default_model()))
    found = encode_texts(pa.array(texts), memory)
    for text, a, b in zip(texts, found.offsets[:-1], found.offsets[1:], strict=True):
        want = library.encode_as_proto(text or "").pieces
        assert found.ids[a:b].tolist() == [p.id for p in want]
        assert list(zip(found.starts[a:b].tolist(), found.ends[a:b].tolist(), strict=True)) == [(p.begin, p.end) for p in want]


def test_scan_and_heap_merge_alike():
    pieces = Pieces(default_model())
    for text in drawn(2, 300, [*"aabbcdet  th"], 60):
        assert pieces.scan(list(text)) == pieces.queue(list(text))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    charsmap = dict(fields(dict(fields(library.serialized_model_proto()))[3]))[2]
    normalizer = Normalizer(Model([], charsmap, True, squeeze))
    for text in drawn(3, 1500, [*"ab  \n\tAB", "ﬁ", "①", "Å", "ｶﾞ", "㍿", "Ａ", "　", "▁", "日", "ﷺ", "​", "\x01"], 14):
        want, places = library.normalize(text, with_offsets=True)
        raw, align = normalizer(text.encode())
        assert raw.decode().replace(" ", "▁") == want
        at = [i for i, byte in enumerate(raw) if byte & 0xC0 != 0x80] + [len(raw)]
        if raw:
            assert [len(text.encode()[: align[i]].decode()) for i in at] == list(places)


def test_spans_through_a_character_map():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    charsmap = dict(fields(dict(fields(library.serialized_model_proto()))[3]))[2]
    model = Model.read(default_model())._replace(charsmap=charsmap)
    text = "Ａ ﬁne ㍿."
    found = encode_texts(pa.array([text, None, text]), Remembered(Pieces(model)))
    raw = text.encode()
    covered = [raw[a:b].decode() for a, b in zip(found.starts, found.ends, strict=True)]
    assert "".join(model.pieces[i][0] for i in found.ids[: found.offsets[1]]).startswith("▁A▁fine▁")
    assert covered[0] == "Ａ" and set("".join(covered)) <= set(text)
    assert found.ids[: found.offsets[1]].tolist() == found.ids[found.offsets[2] :].tolist()


def test_decoding_any_ids(library):
    pieces, rng = Pieces(default_model()), random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(262), rng.randrange(32000), rng.choice([0, 1, 2, 259, 29871, 35])]) for _ in range(rng.randint(0, 8))]
        assert pieces.text(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_tables(spark, library):
    rows = [(i if i != 5 else None, t, "x", 1) for i, t in enumerate(FIXED)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, starts int").repartition(2)
    encoded = sentence_pieces.encode(docs)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {r[0]: library.encode(r[1] or "") for r in rows}
    assert {r.doc_id: r.text for r in sentence_pieces.decode(encoded).collect()} == {r[0]: library.decode(library.encode(r[1] or "")) for r in rows}
    assert sentence_pieces.encode(docs.limit(0)).count() == 0
    assert sentence_pieces.encode(docs.select("text", "doc_id").unionAll(docs.select("text", "doc_id"))).count() == 2 * len(rows)
    nothing = encoded.selectExpr("doc_id", "cast(null as array<int>) ids").limit(1)
    assert [r.text for r in sentence_pieces.decode(nothing).collect()] == [""]


def test_query_on_the_smallest_table(spark, library):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: r for r in sentence_pieces.query(spark, DIR).collect()}
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text or "")
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte"):
        Model.parse(b"\x12\x02\x18\x01")

"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation goes through the model's compiled character map: at each place the longest prefix in its trie is replaced,
other characters stay, and every byte of the result remembers the source byte at which its character began. Pieces are
found on the normalised text and projected through that alignment, so each has its span of bytes in the original text.

Pieces are merged within *units* only: two bytes that stand side by side in no piece of the vocabulary never merge,
so a text falls apart between them. Each distinct unit is merged once and remembered; texts are put together by array lookups.
The space symbol is held as one space byte.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import short_batches, utf8
from coursemill.llm.tokens import CACHE_PARTS, Remembered, cache, gather, in_steps

SYMBOL = "▁"  # stands for a space in pieces
MARK, SPACE = SYMBOL.encode(), 32
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces, as the model file numbers them
SHORT = 24  # symbols up to which a unit is merged by scanning


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at : at + size]
        at += size


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]  # text, score, kind
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool  # white space at the ends goes, and runs of it become one

    @staticmethod
    def read(path: str) -> Model:
        with open(path, "rb") as f:
            return Model.parse(f.read())

    @staticmethod
    def parse(message: bytes) -> Model:
        """Byte-pair models with byte fallback; others raise ValueError."""
        pieces, trainer, normal = [], {}, {}
        for field, value in fields(message):
            if field == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(fields(value))
            elif field == 3:
                normal = dict(fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not {k for _, _, k in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with byte fallback, prefix spaces and no user-defined pieces are known here")
        return Model(pieces, normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)))


class CharacterMap:
    """The compiled map: a double-array trie of sources and, by offset, their replacements ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.first = np.array([bool(self.find(bytes([b]), 0)[1]) for b in range(256)])  # bytes that may begin a source

    def find(self, text: bytes, at: int) -> tuple[tuple[int, bytes] | None, int]:
        """Length and replacement of the longest source at a place, and the number of bytes followed in the trie."""
        if not self.trie:
            return None, 0
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found, depth = step(self.trie[0]), None, 0
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.trie[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= step(unit)
            depth += 1
            if unit & 256:
                begin = self.trie[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[begin : self.texts.index(b"\0", begin)]
        return found, depth


class Normalizer:
    """Normalised bytes (a space for the space symbol) and, for each of them and the end, the source byte it comes from."""

    def __init__(self, model: Model):
        self.map, self.prefix, self.squeeze = CharacterMap(model.charsmap), model.dummy_prefix, model.squeeze
        self.odd = self.map.first.copy()  # bytes that may begin what the plain way can't do
        self.odd[0xE2] = True  # the space symbol itself

    def plain(self, data: np.ndarray) -> bool:
        """Whether nothing in these bytes is replaced."""
        return not self.squeeze and not (self.odd[data].any() and (self.map.first[data].any() or MARK in data.tobytes()))

    def step(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes taken at a place, and what they become."""
        found = self.map.find(text, at)[0] if self.map.first[text[at]] else None
        if found:
            return found
        size = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
        return size, text[at : at + size]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at = bytearray(), [], 0
        while self.squeeze and at < len(text) and (found := self.step(text, at))[1] == b" ":
            at += found[0]
        if at < len(text) and self.prefix:
            out.append(SPACE)
            align.append(at)
        spaces = self.squeeze  # spaces go here
        while at < len(text):
            size, new = self.step(text, at)
            new = new.lstrip(b" ") if spaces else new
            if new:
                spaces = self.squeeze and new.endswith(b" ")
            new = new.replace(MARK, b" ")
            out += new
            align += [at] * len(new)
            at += size
        align.append(at)
        keep = len(out.rstrip(b" ")) if self.squeeze else len(out)
        return bytes(out[:keep]), np.array(align[: keep + 1], np.int64)


class Pieces:
    """Ids of units; bytes and widths of pieces."""

    def __init__(self, path: str | Model):
        self.model = path if isinstance(path, Model) else Model.read(path)
        self.normalizer = Normalizer(self.model)
        self.known = {text.replace(SYMBOL, " "): (-score, i) for i, (text, score, kind) in enumerate(self.model.pieces) if kind == NORMAL}
        self.byte = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece
        for piece in self.known:
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        shown = [self.shown(text, kind) for text, _, kind in self.model.pieces]
        self.kind = np.array([kind for _, _, kind in self.model.pieces], np.uint8)
        self.size = np.array([len(b) for b in shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        digits = [b"%d," % i for i in range(len(shown))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8), np.cumsum([0, *map(len, digits[:-1])]), np.array([len(d) for d in digits], np.int64)

    @staticmethod
    def shown(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, text.replace(SYMBOL, " ").encode())

    def parts(self, units: list[str]) -> list[bytes]:
        return [array("I", self.unit(u)).tobytes() for u in units]

    def unit(self, unit: str) -> list[int]:
        if unit in self.known and len(unit) == 1:
            return [self.known[unit][1]]
        symbols = self.scan(list(unit)) if len(unit) <= SHORT else self.queue(list(unit))
        return [i for s in symbols for i in ([self.known[s][1]] if s in self.known else map(self.byte.__getitem__, s.encode()))]

    def scan(self, symbols: list[str]) -> list[str]:
        """Merge the best pair, the leftmost of equals, until none is a piece."""
        none = (float("inf"), 0)
        costs = [self.known.get(a + b, none)[0] for a, b in zip(symbols[:-1], symbols[1:], strict=True)]
        while costs and (best := min(costs)) < none[0]:
            i = costs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del costs[i]
            for j in (i - 1, i):
                if 0 <= j < len(costs):
                    costs[j] = self.known.get(symbols[j] + symbols[j + 1], none)[0]
        return symbols

    def queue(self, symbols: list[str]) -> list[str]:
        """As scan, with the pairs in a heap: for long units."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (both := symbols[i] + symbols[j]) in self.known:
                heapq.heappush(heap, (self.known[both][0], i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [s for s in symbols if s]

    def text(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded ids; bytes that are no character become U+FFFD each."""
        raw, kinds = gather(self.flat, self.start[ids], self.size[ids]).tobytes(), self.kind[ids]
        try:
            raw.decode()
            whole = not (kinds == CONTROL).any()  # which parts runs of bytes
        except UnicodeDecodeError:
            whole = False
        if not whole:
            is_byte = kinds == BYTE
            runs = np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1
            raw = b"".join(one_by_one(part) if is_byte[at] else part for at, part in ((at, gather(self.flat, self.start[own], self.size[own]).tobytes()) for at, own in zip([0, *runs.tolist()], np.split(ids, runs), strict=True)))
        seen = np.flatnonzero(kinds != CONTROL)
        dropped = len(seen) and kinds[seen[0]] == NORMAL and (self.model.dummy_prefix or self.model.squeeze) and raw[:1] == b" "
        return raw[1:] if dropped else raw


def one_by_one(run: bytes) -> bytes:
    """Characters of a run of bytes; a byte that begins none is U+FFFD."""
    out, at = [], 0
    while at < len(run):
        size = next((n for n in (1, 2, 3, 4) if is_character(run[at : at + n], n)), 0)
        out.append(run[at : at + size] if size else b"\xef\xbf\xbd")
        at += size or 1
    return b"".join(out)


def is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


class Encoded(NamedTuple):
    """Ids of texts one after the other, their spans of source bytes, and each text's offsets into these."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def encode_texts(texts: pa.Array, memory: Remembered) -> Encoded:
    """Null counts as empty."""
    pieces: Pieces = memory.encoder
    if len(memory.slot) > CACHE_PARTS:
        memory.clear()
    data, offsets = utf8(texts)
    sizes = np.diff(offsets)
    if pieces.normalizer.plain(data):
        lead = ((sizes > 0) & pieces.normalizer.prefix).astype(np.int64)
        normal = np.insert(data, offsets[:-1][lead > 0], SPACE)
        bounds = np.concatenate(([0], np.cumsum(sizes + lead)))
        align, at = None, None
    else:
        each = [pieces.normalizer(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        normal = np.frombuffer(b"".join(n for n, _ in each), np.uint8)
        bounds = np.cumsum([0, *(len(n) for n, _ in each)])
        align = np.concatenate([a for _, a in each]) if each else np.zeros(0, np.int64)
    if not len(normal):
        none = np.zeros(0, np.int64)
        return Encoded(np.zeros(0, np.uint32), none, none, np.zeros(len(sizes) + 1, np.int64))
    inside = (normal & 0xC0) == 0x80  # bytes within a character
    cut = np.ones(len(normal) + 1, bool)
    cut[1:-1] = ~pieces.joined[normal[:-1], normal[1:]] & ~inside[1:]
    cut[bounds] = True
    edges = np.flatnonzero(cut)
    units = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(normal)]).dictionary_encode()
    slots = memory.slots(units.dictionary.to_pylist(), pieces.parts)[units.indices.to_numpy()]
    length = memory.length[slots].astype(np.int64)
    ids = gather(memory.flat, memory.start[slots], length)
    before = np.concatenate(([0], np.cumsum(length)))
    places = before[np.searchsorted(edges, bounds)]
    ends = np.cumsum(pieces.size[ids])
    starts = ends - pieces.size[ids]
    fallback = np.flatnonzero(pieces.kind[ids] == BYTE)
    if len(fallback):  # a character's last byte has its whole span, those before it an empty one at its start
        first = np.flatnonzero(~inside)
        starts[fallback] = first[np.searchsorted(first, starts[fallback], side="right") - 1]
        more = np.append(inside, False)[ends[fallback]]
        ends[fallback[more]] = starts[fallback[more]]
    text = np.repeat(np.arange(len(sizes)), np.diff(places))
    if align is None:
        base = bounds[text] + lead[text]
        starts, ends = np.maximum(starts - base, 0), np.maximum(ends - base, 0)
    else:
        starts, ends = align[starts + text], align[ends + text]  # a text has an entry more than bytes
    return Encoded(ids, starts, ends, places)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends (lists) of every row: token ids and the bytes of the text each stands for.

    Spans are half open and count bytes of the UTF-8 text. A character without a piece is spelled by byte tokens, of which
    the last has its span. Null text counts as empty and has no ids. Texts are never cut. Rows that share a doc_id, or have
    none, each give a row; an empty table gives none; more columns are ignored.
    """
    model = model or default_model()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = cache(Pieces, model)
        for batch in batches:
            for part in in_steps(batch, encoding=True):
                found = encode_texts(part.column("text"), memory)
                at = pa.array(found.offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(a.astype(np.int32))) for a in found[:3]]
                yield pa.record_batch([part.column("doc_id"), *lists], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids; null ids count as none."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cache(Pieces, model).encoder
        for batch in batches:
            texts = [pieces.text(np.asarray(i, np.int64)).decode() if i is not None else "" for i in batch.column("ids").to_numpy(zero_copy_only=False)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions in one pass; only digests leave the workers. spans_crc32 is that of all starts, then all ends, as 32-bit numbers."""
    model = default_model()
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = cache(Pieces, model)
        pieces: Pieces = memory.encoder
        digits, at, size = pieces.digits
        for batch in batches:
            for part in in_steps(batch, encoding=True):
                found = encode_texts(part.column("text"), memory)
                rows = []
                for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True):
                    ids = found.ids[a:b]
                    spelled = gather(digits, at[ids], size[ids])[:-1]
                    spans = np.concatenate((found.starts[a:b], found.ends[a:b])).astype("<u4")
                    rows.append((hashlib.sha256(spelled).hexdigest(), hashlib.sha256(pieces.text(ids)).hexdigest(), zlib.crc32(spans)))
                ids_hash, text_hash, spans_crc = zip(*rows, strict=True)
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(found.offsets)), pa.array(ids_hash), pa.array(text_hash), pa.array(spans_crc, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")

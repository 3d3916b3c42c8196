"""BPE encoding by a depth-first walk of a trie of distinct words, and decoding.

The encoding of a string ends in the one token whose removal leaves a string with a last token that may stand
before it: two tokens may be neighbours if encoding the two together gives these two back. So a trie node needs
only the last token of its path's encoding, found from the states above it, and words that share a prefix share the
work. The distinct words in sorted order are the trie's depth-first order; the states of the path are a stack.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import short_batches
from coursemill.llm.tokens import byte_level, cache, default_tokenizer, encode_texts, gather, in_steps


class TrieWords:
    """Ids of words; normalising and splitting are the tokenizers library's, the merging is the trie's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"]
        self.rank = {tuple(pair): i for i, pair in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spelling = byte_level(self.library)
        self.fits: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        return list(body) if body == token else [*body[:-1], body[-1] + self.end]

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of the lowest rank first, leftmost on a tie."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, 1 << 60) for pair in zip(symbols[:-1], symbols[1:], strict=True)]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def neighbours(self, left: str, right: str) -> bool:
        key = (left, right)
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            fit = self.fits[key] = self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
        return fit

    def last_token(self, word: str, depth: int, states: list[str], end: str) -> str:
        """Last token of the encoding of word[:depth] + end; states[i] is that of word[:i]."""
        for start in range(max(0, depth - self.longest), depth):
            token = word[start:depth] + end
            if token in self.vocab and (start == 0 or self.neighbours(states[start], token)):
                return token
        raise ValueError(f"no token ends {word[:depth]!r}")

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """Ids of sorted distinct words."""
        states, before, known = [""], "", {}
        for word in words:
            shared, limit = 0, min(len(before), len(word), len(states) - 1)
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for depth in range(shared + 1, len(word)):
                states.append(self.last_token(word, depth, states, ""))
            token, depth, ids = self.last_token(word, len(word), states, self.end), len(word), []
            while True:
                ids.append(self.vocab[token])
                depth -= len(token.removesuffix(self.end))
                if depth == 0:
                    break
                token = states[depth]
            known[word] = array("I", ids[::-1]).tobytes()
            before = word
        return known

    def parts(self, parts: list[str]) -> list[bytes]:
        spelled = [p if p.isascii() else p.translate(self.spelling) for p in parts]
        known = self.walk(sorted(spelled))
        return [known[p] for p in spelled]

    def words(self, words: list[str]) -> list[bytes]:
        normal, pre = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        pieces: list[list[str | int]] = []
        for word in words:
            own: list[str | int] = []
            for part in self.split.split(word) if self.split and "<" in word else (word,):
                if part in self.special:
                    own.append(self.special[part])
                elif part:
                    own += [token for token, _ in pre(normal(part))]
            pieces.append(own)
        known = self.walk(sorted({p for own in pieces for p in own if isinstance(p, str)}))
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else known[p] for p in own) for own in pieces]


class TokenText:
    """Texts of ids: tokens joined by one space, as the library does for a model without a decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = [b" "] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            texts[i] = token.encode() + b" "
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.start[ids], self.length[ids])[:-1].tobytes()


_texts: dict[str, TokenText] = {}


def decoder(path: str) -> TokenText:
    if path not in _texts:
        _texts[path] = TokenText(path)
    return _texts[path]


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (list of int) of every row; more columns are ignored.

    Null text counts as empty and has no ids. Texts are never cut. Rows that share a doc_id, or have none, each
    give a row; an empty table gives none.
    """
    tokenizer = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache(TrieWords, tokenizer)
        for batch in batches:
            for part in in_steps(batch, encoding=True):
                ids, offsets = encode_texts(part.column("text"), words)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids; null ids count as none. Special tokens are kept."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(tokenizer)
        for batch in batches:
            texts = [text(np.asarray(i, np.int64)).decode() if i is not None and len(i) else "" for i in batch.column("ids").to_numpy(zero_copy_only=False)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions in one pass over the documents; only digests leave the workers."""
    tokenizer = default_tokenizer()
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, text = cache(TrieWords, tokenizer), decoder(tokenizer)
        for batch in batches:
            for part in in_steps(batch, encoding=True):
                ids, offsets = encode_texts(part.column("text"), words)
                own = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                hashes = [hashlib.sha256(i.astype("<u4")).hexdigest() for i in own]
                texts = [hashlib.sha256(text(i)).hexdigest() for i in own]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token ids of whole texts through the distinct parts of a batch's words.

The word vocabulary drops white space and its patterns never cross it, so a text's ids are the ids of its words
(runs without ASCII white space) one after the other. A plain word is letters of ASCII and Latin-1, then ASCII
punctuation: the vocabulary parts the two, so its ids are those of the letters in lower case and of the punctuation.
Words are parted for a whole batch by Arrow; each distinct part, or other word, is encoded once and remembered, and
texts are put together by array lookups.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from coursemill.llm.common import CACHES, forget, release

BATCH_BYTES = 4 << 20
CACHE_PARTS = 300_000
_MARK = "\x01"  # one token of its own between words that are encoded together
_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"  # no apostrophe: it may start a token of its own


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_level(library) -> dict[int, str]:
    """How the library spells each Latin-1 letter to its model: a character for each byte."""
    return {ord(c): library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(c))[0][0] for c in _LATIN}


class LibraryWords:
    """Ids of parts by the model of the tokenizers library, and of other words by the library's whole way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.spelling = byte_level(self.library)
        (self.mark,) = self.library.encode(_MARK, add_special_tokens=False).ids

    def parts(self, parts: list[str]) -> list[bytes]:
        tokenize, spelling = self.library.model.tokenize, self.spelling
        return [array("I", [t.id for t in tokenize(p if p.isascii() else p.translate(spelling))]).tobytes() for p in parts]

    def words(self, words: list[str]) -> list[bytes]:
        encode = lambda text: np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        out = [encode(w).tobytes() if _MARK in w else b"" for w in words]
        rest = [i for i, w in enumerate(words) if _MARK not in w]
        for at in range(0, len(rest), 256):
            group = rest[at : at + 256]
            ids = encode(f" {_MARK} ".join(words[i] for i in group))
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            for i, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                out[i] = ids[a + 1 : b].tobytes()
        return out


class Remembered:
    """Ids of parts and words as one flat array, by slot; slot 0 is the empty part. Forgets all beyond CACHE_PARTS."""

    def __init__(self, encoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.start, self.length, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def slots(self, strings: list[str], encode: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """Slot of each of the distinct strings."""
        known = self.slot
        new = [s for s in strings if s not in known]
        if new:
            ids, n = encode(new), len(known)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
            total = int(lengths.sum())
            while len(self.start) < n + len(new):
                self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
            while len(self.flat) < self.used + total:
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.start[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.length[n : n + len(new)] = lengths
            self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
            self.used += total
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, strings), np.int32, len(strings))


def cache(kind: Callable[[str], object], path: str) -> Remembered:
    """One memory a Python worker, kept between tasks that encode; other operators drop it (see forget)."""
    if (kind, path) not in CACHES:
        CACHES[kind, path] = Remembered(kind(path))
    return CACHES[kind, path]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], joined."""
    length = length.astype(np.int64)
    at = np.repeat(start - (np.cumsum(length) - length), length)
    at += np.arange(len(at))
    return flat[at]


def in_steps(batch: pa.RecordBatch, column: str = "text", size: int = BATCH_BYTES, encoding: bool = False) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, a row at least. Only tasks that are ``encoding`` keep a memory of parts."""
    if not encoding:
        forget()
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
    release()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of every word in order, and each text's offsets into that."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep.to_numpy(zero_copy_only=False)).astype(np.int64)))
    words = words.filter(keep).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), kept[offsets - offsets[0]]


def encode_texts(texts: pa.Array, memory: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """All ids and each text's offsets into them; null counts as empty."""
    if len(memory.slot) > CACHE_PARTS:
        memory.clear()
    distinct, numbers, offsets = split_words(texts)
    pair = np.zeros((len(distinct), 2), np.int32)  # slots of a word's letters and punctuation, or of the word
    found = pc.extract_regex(distinct, _PLAIN)
    plain = found.is_valid()
    is_plain = plain.to_numpy(zero_copy_only=False)
    for column, part in enumerate((pc.utf8_lower(found.field("letters")), found.field("marks"))):
        parts = part.filter(plain).dictionary_encode()
        slots = memory.slots(parts.dictionary.to_pylist(), memory.encoder.parts)
        pair[is_plain, column] = slots[parts.indices.to_numpy()] if len(slots) else 0
    pair[~is_plain, 0] = memory.slots(distinct.filter(pc.invert(plain)).to_pylist(), memory.encoder.words)
    slot = pair[numbers].reshape(-1)
    length = memory.length[slot]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(length, dtype=np.int64)))
    return gather(memory.flat, memory.start[slot], length), ends[2 * offsets]

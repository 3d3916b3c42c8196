"""Word-level kernels with NumPy: edit distance with its operations, similarity of lines, NFKC."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd


def edit_operations(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a shortest word alignment; of these one with the fewest deletions.

    An alignment with no more errors than the bags of words ask for is told in one reading (see _bound_met). Else only a
    band of diagonals around the two corners is filled, row by row; it doubles until it must hold every shortest alignment,
    so the time is about the words times the errors. What the texts begin and end with alike is left out first.
    """
    common = _bound_met(reference, hypothesis) if len(reference) >= len(hypothesis) else _bound_met(hypothesis, reference)
    if common is not None:
        spare = len(reference) - len(hypothesis)
        return min(len(reference), len(hypothesis)) - common, max(spare, 0), max(-spare, 0)
    names = {w: i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    ref = np.array([names[w] for w in reference], np.int64)
    hyp = np.array([names[w] for w in hypothesis], np.int64)
    for _ in range(2):  # the common beginning, then the common end
        least = min(len(ref), len(hyp))
        differ = np.flatnonzero(ref[:least] != hyp[:least])
        same = int(differ[0]) if len(differ) else least
        ref, hyp = ref[same:][::-1], hyp[same:][::-1]
    m, n = len(ref), len(hyp)
    if not m or not n:
        return 0, m, n
    bags = np.bincount(ref, minlength=len(names)), np.bincount(hyp, minlength=len(names))
    fewest = max(m, n) - int(np.minimum(*bags).sum())
    side = min(128, max(m, n))  # wider rows take little longer
    while True:
        cost, deletions = _banded(ref, hyp, side)
        # an alignment that leaves the band has side + 1 steps too many one way, which the others undo or come on top of the fewest
        needed = min((cost - abs(n - m)) // 2, cost - fewest)
        if needed <= side:
            insertions = deletions + n - m
            return cost - deletions - insertions, deletions, insertions
        side = min(2 * side, needed)


def _bound_met(longer: list[str], shorter: list[str]) -> int | None:
    """Words in common if an alignment has just as many errors as the longer text has other words; None if not found.

    No alignment has fewer errors, and one that has no more only leaves out words of the longer text: as the others of it are
    all substituted or left out, nothing is left for words put in, so its operations are known. Words that the longer text
    holds often enough must all be met there, and the earliest places serve if any do; words that it lacks take one place.
    """
    have = Counter(longer)
    common = 0
    for word, n in Counter(shorter).items():
        if n > have[word] > 0:  # which of them are met is open
            return None
        common += n if have[word] else 0
    at = 0
    try:
        for word in shorter:
            at = longer.index(word, at) + 1 if have[word] else at + 1
    except ValueError:
        return None
    return common if at <= len(longer) else None


def _banded(ref: np.ndarray, hyp: np.ndarray, side: int) -> tuple[int, int]:
    """Cost and deletions of the best alignment between the diagonals ``side`` beyond the corners'.

    A value is the cost above the deletions in its bits, less the cost of its column's insertions: those are then a
    running minimum along the row. Entry d of a row stands for column row + low + d; places outside the table are dear.
    """
    m, n = len(ref), len(hyp)
    low, high = min(0, n - m) - side, max(0, n - m) + side
    bits = m.bit_length()
    kind = np.int32 if bits + (m + 2 * n + 4 * side).bit_length() < 30 else np.int64
    one, dear = kind(1 << bits), np.iinfo(kind).max // 2
    delete = one + kind(1)
    order = np.argsort(hyp, kind="stable")  # columns by word: few of a row's places match
    begin = np.searchsorted(hyp[order], np.arange(max(int(ref.max()), int(hyp.max())) + 2)).tolist()
    columns, place = order + 1, (order + 1).tolist()
    width = high - low + 1
    row = np.full(width, dear, kind)
    row[-low : min(width, n - low + 1)] = 0
    lower, left, right = np.empty(width - 1, kind), row[:-1], row[1:]
    for i, word in enumerate(ref.tolist(), 1):
        np.add(right, delete, out=lower)
        x = bisect_left(place, i + low, begin[word], begin[word + 1])
        y = bisect_left(place, i + low + width, x, begin[word + 1])
        if x < y:
            row[columns[x:y] - (i + low)] -= one
        np.minimum(left, lower, out=left)
        start = -low - i  # entry of column 0
        if start >= 0:
            row[:start] = dear
        np.minimum.accumulate(row, out=row)
    value = int(row[n - m - low]) + n * int(one)
    return value >> bits, value & (int(one) - 1)


def edit_table(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = [edit_operations(list(r if r is not None else []), list(h if h is not None else [])) for r, h in zip(reference, hypothesis, strict=True)]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])


def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# fixed values: bullets of slides, those of symbol fonts (private use) among them
BULLETS = re.compile("^[\ue000-\uf8ff•▪◦●■□◆·*]+\\s*")
PRIVATE_USE = re.compile("[\ue000-\uf8ff]")


def clean_lines(text: pd.Series) -> pd.DataFrame:
    """Whether each line begins with a bullet, and its NFKC text without bullets and private characters."""
    plain = [unicodedata.normalize("NFKC", t or "").strip() for t in text]
    return pd.DataFrame({"bullet": [bool(BULLETS.match(t)) for t in plain], "text": [PRIVATE_USE.sub("", BULLETS.sub("", t)).strip() for t in plain]})


def slug(title: pd.Series) -> pd.Series:
    """Lower-case ASCII words joined by hyphens; "lecture" if none is left."""
    def one(t: str | None) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower()
        return re.sub(r"[^a-z0-9]+", "-", bare).strip("-") or "lecture"

    return title.map(one)


AUTOJUNK = 200  # from this length on SequenceMatcher passes over common characters of the second text
DIFFERS = bytes([0] + [1] * 255)


def _longest(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Places and length of the longest common substring, the first in x, then in y.

    Lines that are compared in full are much alike, so a run at equal places, from the start or from the end, is mostly as long
    as any. A substring as long holds one of the blocks of half that size that x is cut into, so others are found by these.
    """
    n, m = len(x), len(y)
    low = min(n, m)
    best = (0, 0, 0)
    for i, j in {(0, 0), (n - low, m - low)}:
        both = int.from_bytes(x[i : i + low], "big") ^ int.from_bytes(y[j : j + low], "big")
        differ = both.to_bytes(low, "big").translate(DIFFERS)
        size = max(map(len, differ.split(b"\1")))
        at = differ.find(bytes(size))
        best = max(best, (size, -i - at, -j - at))
    step = max((best[0] + 1) // 2, 1)
    for i in range(0, n - step + 1, step):
        block = x[i : i + step]
        j = y.find(block)
        while j >= 0:
            if j - i != 0 and j - i != m - n:
                a, b, c, d = i, j, i + step, j + step
                while a and b and x[a - 1] == y[b - 1]:
                    a, b = a - 1, b - 1
                while c < n and d < m and x[c] == y[d]:
                    c, d = c + 1, d + 1
                best = max(best, (c - a, -a, -b))
            j = y.find(block, j + 1)
    return -best[1], -best[2], best[0]


def matched(x: str, y: str) -> int:
    """Characters in the matching blocks of SequenceMatcher(None, x, y)."""
    if len(y) >= AUTOJUNK or not (x.isascii() and y.isascii()):
        return sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())
    total, left = 0, [(x.encode(), y.encode())]
    while left:
        a, b = left.pop()
        if not a or not b:
            continue
        if len(a) == 1 or len(b) == 1:  # one character at most
            total += a in b or b in a
            continue
        i, j, size = _longest(a, b)
        if size:
            total += size
            left += [(a[:i], b[:j]), (a[i + size :], b[j + size :])]
    return total


def ratio(a: pd.Series, b: pd.Series, least: float = 0.0) -> pd.Series:
    """Similarity of two lines: twice the matched characters over all; 0 where a bound by the characters of both is below ``least``."""

    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if least and SequenceMatcher(None, x, y).quick_ratio() < least:
            return 0.0
        return 2.0 * matched(x, y) / (len(x) + len(y))

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


SYMBOLS = np.full(256, 37, np.int64)  # of words in lower case; all others count as one
SYMBOLS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789 ", np.uint8)] = range(37)
PAIRS = 1 << 13  # pairs of lines whose bounds are taken at once


def _bags(texts: list[str]) -> np.ndarray:
    """A row a text: how often it has each symbol."""
    data = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * 38 + SYMBOLS[data], minlength=38 * len(texts)).reshape(-1, 38)


def closest(texts: pd.Series, pages: pd.Series, least: float) -> pd.DataFrame:
    """Place (from 0) and ratio of the line most like each text among its page's lines, joined by line breaks: the first on a
    tie, null below ``least`` and for a null. Only lines whose characters allow a ratio as good as any yet are compared in full."""
    out: list[tuple[int | None, float | None]] = []
    todo: list[tuple[str, list[str]]] = []
    split = {p: p.split("\n") for p in set(pages)}

    def flush() -> None:
        of = {id(lines): lines for _, lines in todo if lines}
        start = dict(zip(of, np.cumsum([0, *map(len, of.values())]).tolist(), strict=False))
        flat = [t for lines in of.values() for t in lines]
        a, b = _bags([t for t, _ in todo]), _bags(flat)
        at = np.repeat(np.arange(len(todo)), [len(lines) for _, lines in todo])
        to = np.concatenate([np.arange(start[id(lines)], start[id(lines)] + len(lines)) for _, lines in todo if lines] or [at])
        both = a.sum(axis=1)[at] + b.sum(axis=1)[to]
        bound = 2.0 * np.minimum(a[at], b[to]).sum(axis=1) / np.maximum(both, 1)
        kept = np.flatnonzero(bound >= least)
        kept = kept[np.lexsort((to[kept], -bound[kept], at[kept]))]
        best: list[tuple[float, int] | None] = [None] * len(todo)
        for row, other, most in zip(at[kept].tolist(), to[kept].tolist(), bound[kept].tolist(), strict=True):
            had = best[row]
            if had and (most, -other) < had:
                continue
            x, y = todo[row][0], flat[other]
            now = (1.0 if x == y else 2.0 * matched(x, y) / (len(x) + len(y)), -other)
            if now[0] >= least and (not had or now > had):
                best[row] = now
        out.extend((None, None) if b is None else (-b[1] - start[id(lines)], b[0]) for b, (_, lines) in zip(best, todo, strict=True))
        todo.clear()

    n = 0
    for text, page in zip(texts, pages, strict=True):
        lines = split[page] if text is not None else []
        todo.append((text or "", lines))
        n += len(lines)
        if n >= PAIRS:
            flush()
            n = 0
    if todo:
        flush()
    return pd.DataFrame({"place": pd.array([i for i, _ in out], dtype="Int32"), "ratio": pd.array([r for _, r in out], dtype="Float64")})


def gram_size(least: float) -> int:
    """Pairs of characters where a ratio of ``least`` implies that some are shared in texts of six or more, else characters."""
    return 2 if least_shared(pd.Series(range(6, 200)), 2, least).min() >= 1 else 1


def least_shared(n: pd.Series, q: int, least: float) -> pd.Series:
    """Grams (see numbered_grams) that a text of n characters shares with any text of a ratio of ``least`` or more to it.

    With m characters there, at least ``least * (n + m) / 2`` are matched, and m lies between n * least / (2 - least) and
    n * (2 - least) / least. All matched characters are shared. Of pairs, each character that is not matched, on either
    side, breaks two at most.
    """
    if q == 1:
        return np.ceil(n * least / (2 - least) - 1e-9).astype("int32")
    longest = np.floor(n * (2 - least) / least + 1e-9)
    return (n - 1 - 2 * np.floor((1 - least) * (n + longest) + 1e-9)).astype("int32")


def numbered_grams(texts: pd.Series, q: int) -> pd.Series:
    """The substrings of q characters of each text; the k-th of equal ones carries its number."""

    def one(text: str | None) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for i in range(len(text or "") - q + 1):
            gram = text[i : i + q]
            seen[gram] = seen.get(gram, 0) + 1
            out.append(f"{gram}{seen[gram]}")
        return out

    return texts.map(one)

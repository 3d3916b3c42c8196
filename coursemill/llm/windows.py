"""Repeated fixed-length windows over blocks of documents: the core of the two exact substring dedups.

A window is ``k`` consecutive tokens of one document (bytes or words). Lengths double level by level, from ``start`` to
``k``. At each level only some runs are moved to be compared, so that less than the input travels:

* Levels below ``k``: of the runs in each window of the next level's length the one with the smallest code (its
  minimizer) is compared. A window can repeat only if its minimizer does; only windows whose minimizer was found
  twice are extended to the next level, all others leave. With no survivor no later level sends anything.
* Level ``k``: a surviving window is *sampled* if the smallest half-window code in it stands first or last (a closed
  syncmer): the repeated half is extended to the right or to the left. Equal windows are all sampled or none is.
  Neighbouring sampled windows are at most ``k / 2`` apart, so two repeated neighbours cover what lies between them.
* Windows between two sampled ones (a *gap*) all share one smallest half-window, their *anchor*. What is left are
  gaps at the ends of copied passages. Their windows are moved one by one in a last round, except where the round
  before settles them: both neighbours occur at one earlier place at the right distance, or all gaps with that
  anchor stand between these two neighbours (the sets of places are compared by a shifted sum).

Blocks combine equal windows before each shuffle, so a passage in a third of all documents costs one entry a block.
Blocks and buckets grow in number with the input, buckets more slowly (see Ways). While their rows to each other stay few
enough, keys go in one pass; beyond, in passes over radix digits of the destination, so that n senders send about
n ** (1 + 1 / h) rows in h passes (see travel). Nothing is capped or sampled away. All
steps are exact up to collisions of 80-bit window codes; 48-bit anchor and minimizer codes can only add
candidates, and the sums, compared by 32 bits, settle a gap wrongly with probability 2 ** -32.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.common import block_count, forget, mix64, pack, release, short_batches, text_bytes, unpack, utf8

PIECE = 1 << 17
NO_ID = np.iinfo(np.int64).max
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (_rng.integers(1, 1 << 61, 64, dtype=np.uint64) * np.uint64(4)) + np.uint64(3)
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(base: int, bits: int = 12) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(1 << bits)], np.uint64)


_LOW, _MID, _TOP = (_powers(pow(int(_BASE), 1 << shift, 1 << 64)) for shift in (0, 12, 24))
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_ILOW, _IMID, _ITOP = (_powers(pow(_INVERSE, 1 << shift, 1 << 64)) for shift in (0, 12, 24))


def power(n: np.ndarray) -> np.ndarray:
    """_BASE to the n-th, modulo 2**64."""
    n = n.astype(np.int64)
    return _LOW[n & 4095] * _MID[(n >> 12) & 4095] * _TOP[n >> 24]


def place(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number for an occurrence; adding g to pos multiplies it by power(g)."""
    return mix64(doc.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03)) * power(pos)  # no small id maps to 0


STRETCH = 1 << 15  # results made at once: what they need stays in a core's cache


def in_stretches(of: Callable[[np.ndarray, int], np.ndarray]) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function of all runs of ``length`` values, applied to stretches that overlap by a run less one."""

    def run(values: np.ndarray, length: int) -> np.ndarray:
        n = len(values) - length + 1
        if n <= 2 * STRETCH:
            return of(values, length)
        out = np.empty(n, values.dtype)
        for at in range(0, n, STRETCH):
            out[at : at + STRETCH] = of(values[at : at + STRETCH + length - 1], length)
        return out

    return run


@in_stretches
def gram_codes(tokens: np.ndarray, length: int) -> np.ndarray:
    """64-bit codes of all runs of ``length`` tokens, from codes of half the length, doubling."""
    h, n, step = tokens, 1, 0
    while n < length:
        shift = min(n, length - n)
        longer = h[:-shift] * _STEP[step]
        longer += h[shift:]
        if n == 8 or n + shift == length:
            longer ^= longer >> np.uint64(31)
        h, n, step = longer, n + shift, step + 1
    return h * _STEP[step]


@in_stretches
def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n < width:
        shift = min(n, width - n)
        x = np.minimum(x[:-shift], x[shift:])
        n += shift
    return x


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~x, width)


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_tokens(data: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word, of all its bytes."""
    return run_codes(data, *word_bounds(data))


def run_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each run of bytes; runs are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, cut = [], 0
    while cut < len(starts):  # in steps of whole words, to bound memory
        stop = max(int(np.searchsorted(starts, starts[cut] + (1 << 21))), cut + 1)
        lo, hi = starts[cut], ends[stop - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data[lo:hi]] * power(np.arange(hi - lo)), dtype=np.uint64)))
        code = (sums[ends[cut:stop] - lo] - sums[starts[cut:stop] - lo]) * _inverse(starts[cut:stop] - lo)
        out.append(mix64(code + (ends[cut:stop] - starts[cut:stop]).astype(np.uint64)))
        cut = stop
    return np.concatenate(out)


def _inverse(n: np.ndarray) -> np.ndarray:
    return _ILOW[n & 4095] * _IMID[(n >> 12) & 4095] * _ITOP[n >> 24]


@dataclass
class Kind:
    """What a token is, and which occurrences count as earlier."""

    k: int
    tokens: Callable[[np.ndarray], np.ndarray]
    within: bool  # an earlier start in the same document counts too
    start: int = 0  # least length that is compared; half of k if 0

    def levels(self) -> list[int]:
        """Lengths below k in rising order: half of k, half of that and so on down to the start."""
        out = [self.k // 2]
        while self.start and (half := -(-out[0] // 2)) >= self.start and half < out[0]:
            out.insert(0, half)
        return out


@dataclass
class Piece:
    """Some documents' tokens in one array; windows never cross documents."""

    tokens: np.ndarray
    start: np.ndarray  # of each document's part in tokens
    doc: np.ndarray
    base: np.ndarray  # position of the part in its document
    valid: np.ndarray

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and position of places in tokens."""
        i = np.searchsorted(self.start, at, "right") - 1
        return self.doc[i], at - self.start[i] + self.base[i]


def pieces(docs: list[np.ndarray], k: int) -> Iterator[Piece]:
    """Documents joined up to PIECE tokens; longer ones in parts that overlap by k - 1."""
    group: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def joined() -> Piece:
        n = np.array([len(t) for _, _, t in group])
        end = np.cumsum(n)
        valid = np.ones(end[-1], bool)
        for e in end:
            valid[e - k + 1 : e] = False
        return Piece(np.concatenate([t for _, _, t in group]), end - n, np.array([d for d, _, _ in group]), np.array([p for _, p, _ in group]), valid)

    for d, tokens in enumerate(docs):
        for at in range(0, max(len(tokens) - k + 1, 0), PIECE):
            part = tokens[at : at + PIECE + k - 1]
            group.append((d, at, part))
            size += len(part)
            if size >= PIECE:
                yield joined()
                group, size = [], 0
    if group:
        yield joined()


@dataclass
class Scan:
    """Sampled windows and gaps of a block, in order of document and position."""

    doc: np.ndarray  # sampled windows
    pos: np.ndarray
    code: np.ndarray
    more: np.ndarray
    gap_doc: np.ndarray
    gap_from: np.ndarray
    gap_to: np.ndarray
    gap_code: np.ndarray
    left: np.ndarray  # index of the sampled window beside a gap, or -1
    right: np.ndarray


def window_code(h: np.ndarray, at: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """The two digits of windows, 40 bits each, as 64 + 16 bits."""
    first, second = mix64(h[at]) >> np.uint64(24), mix64(h[at + s]) >> np.uint64(24)
    return (first << np.uint64(24)) | (second >> np.uint64(16)), (second & np.uint64(0xFFFF)).astype(np.uint16)


ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF0000)


def anchor_code(h: np.ndarray) -> np.ndarray:
    return mix64(h) & ANCHOR_BITS


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each code is in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def minimizers(docs: list[np.ndarray], length: int, wide: int, before: tuple[int, np.ndarray] | None) -> np.ndarray:
    """Codes of the runs of ``length`` that are the smallest in a window of ``wide``, one for each place.

    before: the length of the level below and its repeated codes; runs whose own minimizer is not among them leave.
    """
    out = [np.zeros(0, np.uint64)]
    for p in pieces(docs, wide):
        h = gram_codes(p.tokens, length)
        width = wide - length + 1
        low = np.where(p.valid[: len(h) - width + 1], sliding_min(h, width), np.uint64(0))
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(sliding_max(np.concatenate((edge, low, edge)), width) == h)
        if before and len(at):
            inner = sliding_min(gram_codes(p.tokens, before[0]), length - before[0] + 1)
            at = at[among(anchor_code(inner[at]), before[1])]
        out.append(anchor_code(h[at]))
    return np.concatenate(out)


def scan(docs: list[np.ndarray], k: int, known: np.ndarray) -> Scan:
    """Sampled windows and gaps whose smallest half-window is among the ``known`` codes."""
    s = k // 2
    rows: list[list[np.ndarray]] = []
    found = 0
    for p in pieces(docs, k):
        h = gram_codes(p.tokens, s)
        low = sliding_min(h, k - s + 1)
        n = len(low)
        valid = p.valid[:n]
        sampled = valid & ((h[:n] == low) | (h[k - s :] == low))
        at = np.flatnonzero(sampled)
        at = at[among(anchor_code(low[at]), known)]
        code, more = window_code(h, at, s)
        edge = np.diff(np.concatenate(([False], valid & ~sampled, [False])).astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        gap_code = anchor_code(low[lo])
        alive = among(gap_code, known)
        lo, hi, gap_code = lo[alive], hi[alive], gap_code[alive]
        kept = np.zeros(n + 1, bool)  # one place more, for the gap at the end
        kept[at] = True
        doc, pos = p.where(at)
        gap_doc, gap_from = p.where(lo)
        # the sampled window before a gap starts one token earlier, in the same part; the one after, one token later
        left = np.searchsorted(at, lo) - 1
        has_left, has_right = (lo > 0) & kept[lo - 1], kept[hi + 1]
        rows.append([doc, pos, code, more, gap_doc, gap_from, gap_from + hi - lo, gap_code, np.where(has_left, left + found, -1), np.where(has_right, left + 1 + found, -1)])
        found += len(at)
    if not rows:
        empty = np.zeros(0, np.int64)
        return Scan(empty, empty, empty.astype(np.uint64), empty.astype(np.uint16), empty, empty, empty, empty.astype(np.uint64), empty, empty)
    return Scan(*(np.concatenate(c) for c in zip(*rows, strict=True)))


@dataclass
class Groups:
    """Distinct keys with their earliest place, number of places and sum of places; slot: key of each row."""

    code: np.ndarray
    more: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    count: np.ndarray
    total: np.ndarray
    slot: np.ndarray


def digit_groups(code: np.ndarray, more: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray, total: np.ndarray) -> Groups:
    """Group by radix passes, most significant digit first: only runs that tie on the first digits are ordered by the rest."""
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    tie = np.zeros(len(order), bool)
    if len(order) > 1:
        same = sorted_code[1:] == sorted_code[:-1]
        tie[1:] |= same
        tie[:-1] |= same
    at = np.flatnonzero(tie)
    if len(at):
        sub = order[at]
        order[at] = sub[np.lexsort((pos[sub], doc[sub], more[sub], code[sub]))]
    code, more = code[order], more[order]
    new = np.ones(len(order), bool)
    new[1:] = (code[1:] != code[:-1]) | (more[1:] != more[:-1])
    first = np.flatnonzero(new)
    slot = np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new) - 1
    if not len(first):
        return Groups(code, more, doc, pos, count, total, slot)
    return Groups(code[first], more[first], doc[order][first], pos[order][first], np.add.reduceat(count[order], first), np.add.reduceat(total[order], first), slot)


def own_groups(code: np.ndarray, more: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Groups:
    return digit_groups(code, more, doc, pos, np.ones(len(code), np.int64), place(doc, pos))


ROWS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
DDL = "a int, b int, kind int, block int, data binary"
LEVEL, SAMPLED, ANCHOR, WINDOW, STATE = 0, 1, 2, 3, 4
RADIX = 512  # destinations that one task sends to where one pass would have more than MOST_ROWS rows
MOST_ROWS = 1 << 25  # from all blocks to all buckets in one pass: blocks of 2 MB reach it at 32 GB
LEAST_BUCKETS, BLOCKS_A_BUCKET = 512, 8
KEPT_BYTES = 200 << 20  # of a Python worker between tasks
RESIDENT_PAGE = os.sysconf("SC_PAGE_SIZE")


@dataclass
class Way:
    """Passes between n senders and n receivers: a pass tells apart ``radix`` values of the next digit of the receiver."""

    n: int
    radix: int
    passes: int

    @staticmethod
    def of(n: int, most: int) -> Way:
        passes = 1
        while most**passes < n:
            passes += 1
        radix = 1
        while radix**passes < n:
            radix += 1
        return Way(n, radix, passes)

    def prefix(self, index: np.ndarray, digits: int) -> np.ndarray:
        """The first digits of a receiver's number."""
        return index // self.radix ** (self.passes - digits)

    def bucket(self, code: np.ndarray) -> np.ndarray:
        return (((code >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Ways:
    """From blocks to buckets, and back. A bucket takes the keys of its share of codes from some blocks' worth of text."""

    blocks: int
    to: Way
    back: Way

    @staticmethod
    def of(blocks: int, radix: int | None = None) -> Ways:
        buckets = min(blocks, max(LEAST_BUCKETS, blocks // BLOCKS_A_BUCKET))
        one_pass = radix is None and blocks * buckets <= MOST_ROWS
        return Ways(blocks, *(Way.of(n, n if one_pass else radix or RADIX) for n in (buckets, blocks)))

    def way(self, back: bool) -> Way:
        return self.back if back else self.to

    def of_block(self, block: np.ndarray, back: bool) -> np.ndarray:
        """Where a block's note to itself goes: to one of the buckets, and back."""
        return block if back else block * self.to.n // self.blocks


def put(kind: int, back: bool, columns: list[np.ndarray]) -> bytes:
    """Keys of a kind as one value, on their way to a bucket or back. The first columns are the key's block and code."""
    if back or kind == LEVEL:
        return pack(*columns)
    order = np.lexsort((columns[4], columns[3]))
    block, code, more, doc, pos, count, total = (c[order] for c in columns)
    many = np.flatnonzero(count > 1)
    return pack(block, code, more, np.diff(doc, prepend=doc.dtype.type(0)), pos.astype(np.uint32), many.astype(np.uint32), count[many], total[many])


def get(kind: int, back: bool, values: list[bytes]) -> list[np.ndarray]:
    """Columns of all keys of some values: block, code and, for LEVEL to a bucket, count; else more, doc, pos, count, total."""
    parts = []
    for value in values:
        columns = unpack(value)
        if not back and kind != LEVEL:
            block, code, more, doc, pos, many, count, total = columns
            doc, pos = np.cumsum(doc), pos.astype(np.int64)
            counts, totals = np.ones(len(code), np.int64), place(doc, pos)
            counts[many], totals[many] = count, total
            columns = [block, code, more, doc, pos, counts, totals]
        parts.append(columns)
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def addressed(kind: int, back: bool, columns: list[np.ndarray], ways: Ways, digits: int, sender: int, out: dict[str, list]) -> None:
    """A row for each value of the receivers' first ``digits`` digits."""
    way = ways.way(back)
    to = way.prefix(columns[0] if back else way.bucket(columns[1]), digits)
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
        for name, value in zip(ROWS.names, (int(to[part[0]]), sender // way.radix, kind, -1, put(kind, back, [c[part] for c in columns])), strict=True):
            out[name].append(value)


def passed_on(table: pa.Table, back: bool, ways: Ways, digits: int) -> pa.Table:
    """One pass: keys of one prefix from ``radix`` senders, told apart by one digit more."""
    way = ways.way(back)
    out: dict[str, list] = {n: [] for n in ROWS.names}
    group = int(table["b"][0].as_py())
    kinds = table["kind"].to_numpy()
    for kind in np.unique(kinds):
        sub = table.filter(pa.array(kinds == kind))
        if kind == STATE:
            to = ways.of_block(sub["block"].to_numpy().astype(np.int64), back)
            for values in zip(way.prefix(to, digits).tolist(), [group // way.radix] * len(to), *(sub[c].to_pylist() for c in ROWS.names[2:]), strict=True):
                for name, value in zip(ROWS.names, values, strict=True):
                    out[name].append(value)
        else:
            addressed(int(kind), back, get(int(kind), back, sub["data"].to_pylist()), ways, digits, group, out)
    return pa.table(out, schema=ROWS)


def travel(rows: DataFrame, back: bool, ways: Ways) -> DataFrame:
    """Rows to their receivers, whose number is then in column a."""
    way = ways.way(back)

    def one(digits: int) -> Callable:
        return lambda t: freed(passed_on(t, back, ways, digits))

    for digits in range(2, way.passes + 1):
        rows = rows.repartition(way.n, "a", "b").groupBy("a", "b").applyInArrow(one(digits), DDL)
    return rows.repartition(way.n, "a")


def freed(out: pa.Table) -> pa.Table:
    """A task's end: a worker that has grown gives its memory back; one that has not keeps it, so that the next task need not ask anew."""
    forget()
    resident = KEPT_BYTES + 1
    with contextlib.suppress(OSError), open("/proc/self/statm") as f:  # not on every system
        resident = int(f.read().split()[1]) * RESIDENT_PAGE
    if resident > KEPT_BYTES:
        release()
    return out


def send(groups: Groups, kind: int, block: int, ways: Ways, out: dict[str, list]) -> None:
    owner = np.full(len(groups.code), block, np.int32)
    addressed(kind, False, [owner, groups.code, groups.more, groups.doc, groups.pos, groups.count, groups.total], ways, 1, block, out)


def note(block: int, data: bytes, ways: Ways, out: dict[str, list], back: bool = False) -> None:
    """A block's word to itself: it goes by a bucket, and back."""
    way = ways.way(back)
    for name, value in zip(ROWS.names, (int(way.prefix(ways.of_block(np.int64(block), back), 1)), block // way.radix, STATE, block, data), strict=True):
        out[name].append(value)


def answer(table: pa.Table, ways: Ways) -> pa.Table:
    """In a bucket: for keys that occur again, tell each block that has them; the earliest place and the sum over all blocks."""
    out: dict[str, list] = {n: [] for n in ROWS.names}
    bucket = int(table["a"][0].as_py())
    kinds = table["kind"].to_numpy()
    for kind in map(int, np.unique(kinds)):
        sub = table.filter(pa.array(kinds == kind))
        values = sub["data"].to_pylist()
        if kind == STATE:
            for block, data in zip(sub["block"].to_pylist(), values, strict=True):
                note(block, data, ways, out, back=True)
            continue
        columns = get(kind, False, values)
        if kind == LEVEL:
            block, code, count = columns
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
            sizes = np.diff(np.concatenate((first, [len(order)])))
            again = np.repeat(np.add.reduceat(count[order].astype(np.int64), first) > 1, sizes)
            addressed(kind, True, [c[order[again]] for c in (block, code)], ways, 1, bucket, out)
            continue
        block, code, more, doc, pos, count, total = columns
        g = digit_groups(code, more, doc, pos, count, total)
        wanted = np.bincount(g.slot)[g.slot] > 1
        if kind == WINDOW:  # only who has a later place than the earliest needs to know
            wanted &= (g.doc[g.slot] != doc) | (g.pos[g.slot] != pos)
        shared = np.flatnonzero(wanted)
        shared = shared[np.argsort(g.slot[shared], kind="stable")]
        j = g.slot[shared]
        # an anchor's place and a window's sum are not used; that a key is shared says that it occurs again
        doc, pos = (0 * g.doc[j], 0 * g.pos[j]) if kind == ANCHOR else (g.doc[j], g.pos[j])
        total = 0 * g.total[j] if kind == WINDOW else g.total[j]
        addressed(kind, True, [block[shared], g.code[j], g.more[j], doc, pos.astype(np.uint32), total.astype(np.uint32)], ways, 1, bucket, out)
    return pa.table(out, schema=ROWS)


def told(answers: pa.Table, kind: int) -> list[bytes]:
    return [d for d, k in zip(answers["data"].to_pylist(), answers["kind"].to_pylist(), strict=True) if k == kind]


def repeated_codes(answers: pa.Table) -> np.ndarray:
    """Sorted codes of a block's minimizers that occur again."""
    values = told(answers, LEVEL)
    return np.sort(get(LEVEL, True, values)[1]) if values else np.zeros(0, np.uint64)


def merged(groups: Groups, answers: pa.Table, kind: int) -> Groups:
    """The block's keys with what the answers say; a key without an answer occurs in this block only."""
    values = told(answers, kind)
    if values:
        _, code, more, doc, pos, total = get(kind, True, values)
        order = np.lexsort((more, code))
        both = np.concatenate((groups.code, code[order])), np.concatenate((groups.more, more[order]))
        rank = np.lexsort((np.arange(len(both[0])), both[1], both[0]))  # a key, then its answer
        is_answer = rank >= len(groups.code)
        at = np.flatnonzero(is_answer)
        own, ans = rank[at - 1], order[rank[at] - len(groups.code)]
        groups.doc[own], groups.pos[own], groups.count[own], groups.total[own] = doc[ans], pos[ans].astype(np.int64), 2, total[ans]
    groups.total &= np.uint64(0xFFFFFFFF)  # sums are compared by their low half
    return groups


@dataclass
class Block:
    ids: np.ndarray
    docs: list[np.ndarray]
    scan: Scan
    sampled: Groups
    anchors: Groups


def gathered(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.Table]:
    """Batches joined up to about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text, extra) as one compressed row for each block and about 16 MB of input."""
    forget()
    for table in gathered(batches):
        if not table.num_rows:
            continue
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        block, table = block[order], table.take(pa.array(order))
        ids, (data, offsets), (more, ends) = table["doc_id"].combine_chunks(), utf8(table["text"]), utf8(table["extra"])
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(NO_ID).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        rows = [pack(ids[a:b], null[a:b].astype(np.uint8), np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]], np.diff(ends[a : b + 1]), more[ends[a] : ends[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([pa.array(block[cuts[:-1]], pa.int32()), pa.array(rows, pa.binary())], names=["block", "data"])
    release()


@dataclass
class Texts:
    """A block's documents in order of their ids (null last)."""

    ids: np.ndarray
    null: np.ndarray
    texts: list[np.ndarray]
    extra: list[bytes]  # what else is carried with each


def read_texts(table: pa.Table) -> Texts:
    ids, null, texts, extra = [], [], [], []
    for data in table["data"].to_pylist():
        own, missing, lengths, raw, sizes, more = unpack(data)
        ids.append(own)
        null.append(missing)
        texts += np.split(raw, np.cumsum(lengths)[:-1])
        extra += [e.tobytes() for e in np.split(more, np.cumsum(sizes)[:-1])]
    all_ids = np.concatenate(ids)
    order = np.argsort(all_ids, kind="stable")
    return Texts(all_ids[order], np.concatenate(null)[order].astype(bool), [texts[i] for i in order], [extra[i] for i in order])


def level_round(table: pa.Table, answers: pa.Table | None, kind: Kind, ways: Ways, level: int) -> pa.Table:
    """Send the minimizers of a level whose own minimizers, one level below, are known to repeat."""
    lengths = [*kind.levels(), kind.k]
    out: dict[str, list] = {n: [] for n in ROWS.names}
    if table.num_rows:
        block = int(table["block"][0].as_py())
        known = None if answers is None else repeated_codes(answers)
        docs = [] if known is not None and not len(known) else [t for t in map(kind.tokens, read_texts(table).texts) if len(t) >= kind.k]
        codes, counts = np.unique(minimizers(docs, lengths[level], lengths[level + 1], None if known is None else (lengths[level - 1], known)), return_counts=True)
        addressed(LEVEL, False, [np.full(len(codes), block, np.int32), codes, np.minimum(counts, 2).astype(np.uint8)], ways, 1, block, out)
    return pa.table(out, schema=ROWS)


def read_block(table: pa.Table, kind: Kind, known: np.ndarray) -> Block:
    t = read_texts(table)
    docs = [kind.tokens(text) if len(text) >= kind.k else np.zeros(0, np.uint64) for text in t.texts]
    found = scan(docs if len(known) else [], kind.k, known)
    none = np.zeros(len(found.gap_code), np.uint16)
    return Block(t.ids, docs, found, own_groups(found.code, found.more, t.ids[found.doc], found.pos), own_groups(found.gap_code, none, t.ids[found.gap_doc], found.gap_from))


def first_round(table: pa.Table, answers: pa.Table, kind: Kind, ways: Ways) -> pa.Table:
    """Send the surviving sampled windows and anchors, and a note of the surviving codes."""
    out: dict[str, list] = {n: [] for n in ROWS.names}
    if table.num_rows:
        block, known = int(table["block"][0].as_py()), repeated_codes(answers)
        b = read_block(table, kind, known)
        send(b.sampled, SAMPLED, block, ways, out)
        send(b.anchors, ANCHOR, block, ways, out)
        note(block, pack(known), ways, out)
    return pa.table(out, schema=ROWS)


def earlier(doc: np.ndarray, pos: np.ndarray, own_doc: np.ndarray, own_pos: np.ndarray, within: bool) -> np.ndarray:
    return (doc < own_doc) | (within & (doc == own_doc) & (pos < own_pos))


def open_gaps(b: Block, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled windows that occur earlier; gaps that this covers whole; gaps whose windows must be compared."""
    f, s, a = b.scan, b.sampled, b.anchors
    hit = earlier(s.doc[s.slot], s.pos[s.slot], b.ids[f.doc], f.pos, kind.within)
    has = (f.left >= 0) & (f.right >= 0)
    l, r = np.maximum(f.left, 0), np.maximum(f.right, 0)
    if not len(f.doc):
        return hit, np.zeros(len(f.gap_doc), bool), a.count[a.slot] > 1
    both = has & hit[l] & hit[r]
    sl, sr, sa = s.slot[l], s.slot[r], a.slot
    one_place = both & (s.doc[sl] == s.doc[sr]) & (s.pos[sr] - s.pos[sl] == f.pos[r] - f.pos[l])
    low = np.uint64(0xFFFFFFFF)
    together = has & ((s.total[sl] * power(np.ones(1))) & low == a.total[sa]) & ((a.total[sa] * power(f.gap_to - f.gap_from + 1)) & low == s.total[sr])
    return hit, both, (a.count[sa] > 1) & ~one_place & ~together


def gap_windows(docs: list[np.ndarray], gap_doc: np.ndarray, gap_from: np.ndarray, gap_to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, position and code of every window of the given gaps."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16))]
    for start in range(0, len(gap_doc), 4096):
        i = slice(start, start + 4096)
        n = gap_to[i] - gap_from[i] + 1
        parts = [docs[d][x : y + k] for d, x, y in zip(gap_doc[i], gap_from[i], gap_to[i], strict=True)]
        size = n + k - 1
        base = np.repeat(np.cumsum(size) - size, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code, more = window_code(gram_codes(np.concatenate(parts), k // 2), base + inside, k // 2)
        out.append((np.repeat(gap_doc[i], n), np.repeat(gap_from[i], n) + inside, code, more))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def union_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, merged where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = np.int64(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * wide)
    first = np.flatnonzero(np.concatenate(([True], (start + doc * wide)[1:] > reach[:-1])))
    return doc[first], start[first], (reach - doc * wide)[np.concatenate((first[1:] - 1, [len(doc) - 1]))]


def second_round(table: pa.Table, answers: pa.Table, kind: Kind, ways: Ways) -> pa.Table:
    """Send the windows of open gaps, and a note of what is covered so far and which gaps are open."""
    out: dict[str, list] = {n: [] for n in ROWS.names}
    if not table.num_rows:
        return pa.table(out, schema=ROWS)
    block = int(table["block"][0].as_py())
    b = read_block(table, kind, unpack(told(answers, STATE)[0])[0])
    merged(b.sampled, answers, SAMPLED), merged(b.anchors, answers, ANCHOR)
    hit, both, open_ = open_gaps(b, kind)
    f = b.scan
    gaps = f.gap_doc[open_], f.gap_from[open_], f.gap_to[open_]
    doc, pos, code, more = gap_windows(b.docs, *gaps, kind.k)
    send(own_groups(code, more, b.ids[doc], pos), WINDOW, block, ways, out)
    spans = union_spans(np.concatenate((f.doc[hit], f.gap_doc[both])), np.concatenate((f.pos[hit], f.gap_from[both])), np.concatenate((f.pos[hit] + kind.k, f.gap_to[both] + kind.k)))
    note(block, pack(*(x.astype(np.uint32) for x in (*gaps, *spans))), ways, out)
    return pa.table(out, schema=ROWS)


def covered(table: pa.Table, answers: pa.Table, kind: Kind) -> tuple[Texts, list[np.ndarray]]:
    """The block's documents with a flag for each token that a repeated window covers."""
    t = read_texts(table)
    gap_doc, gap_from, gap_to, doc, start, end = (x.astype(np.int64) for x in unpack(told(answers, STATE)[0]))
    wanted = set(gap_doc.tolist())
    tokens = [kind.tokens(text) if i in wanted else text for i, text in enumerate(t.texts)]
    at_doc, pos, code, more = gap_windows(tokens, gap_doc, gap_from, gap_to, kind.k)
    g = merged(own_groups(code, more, t.ids[at_doc], pos), answers, WINDOW)
    late = earlier(g.doc[g.slot], g.pos[g.slot], t.ids[at_doc], pos, kind.within)
    doc, start, end = union_spans(np.concatenate((doc, at_doc[late])), np.concatenate((start, pos[late])), np.concatenate((end, pos[late] + kind.k)))
    spans: dict[int, list[tuple[int, int]]] = {}
    for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        spans.setdefault(d, []).append((x, y))
    return t, [spans.get(i, []) for i in range(len(t.texts))]


def repeated_windows(docs: DataFrame, kind: Kind, finish: Callable[[Texts, list], pa.Table], schema: pa.Schema, block_bytes: int = 2 << 20, radix: int | None = None) -> DataFrame:
    """Run all levels over docs (doc_id, text and, if any, extra string) and apply ``finish`` to each block's texts and covered token spans.

    The documents are shuffled once by block, compressed; Spark reuses that exchange for all readings.
    ``block_bytes`` of text make a block; a larger cluster takes larger blocks (and fewer rows between them). ``radix``
    forces passes (see Ways).
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    short_batches(docs.sparkSession)
    n = block_count(docs.sparkSession, text_bytes(docs), block_bytes)
    ways = Ways.of(n, radix)
    extra = F.col("extra") if "extra" in docs.columns else F.lit("")
    blocks = docs.select(F.col("doc_id").cast("long"), "text", extra.alias("extra"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int").alias("block"))
    blocks = blocks.mapInArrow(pack_blocks, "block int, data binary").repartition(n, "block")

    def answered(rows: DataFrame) -> DataFrame:
        return travel(travel(rows, False, ways).groupBy("a").applyInArrow(lambda t: freed(answer(t, ways)), DDL), True, ways)

    def with_answers(answers: DataFrame, step: Callable) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("a")).applyInArrow(lambda t, a: freed(step(t, a)), DDL)

    answers = answered(blocks.groupBy("block").applyInArrow(lambda t: freed(level_round(t, None, kind, ways, 0)), DDL))

    def next_level(level: int) -> Callable:
        return lambda t, a: level_round(t, a, kind, ways, level)

    for level in range(1, len(kind.levels())):
        answers = answered(with_answers(answers, next_level(level)))
    answers = answered(with_answers(answers, lambda t, a: first_round(t, a, kind, ways)))
    answers = answered(with_answers(answers, lambda t, a: second_round(t, a, kind, ways)))

    def last(t: pa.Table, a: pa.Table) -> pa.Table:
        return freed(finish(*covered(t, a, kind))) if t.num_rows else schema.empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("a")).applyInArrow(last, from_arrow_schema(schema))

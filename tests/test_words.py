"""Word alignment against the full table."""

from __future__ import annotations

import random
import time

from coursemill.kernels.words import edit_operations


def table(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Least cost, then fewest deletions, by the whole table."""
    row = [(j, 0) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        new = [(i, i)]
        for j, h in enumerate(hyp, 1):
            step = row[j - 1] if r == h else (row[j - 1][0] + 1, row[j - 1][1])
            new.append(min(step, (row[j][0] + 1, row[j][1] + 1), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    cost, deletions = row[-1]
    insertions = deletions + len(hyp) - len(ref)
    return cost - deletions - insertions, deletions, insertions


def edited(rng: random.Random, ref: list[str], rate: float, words: int) -> list[str]:
    out = []
    for w in ref:
        kind = rng.random() / rate
        out += [] if kind < 0.3 else [str(rng.randrange(words))] if kind < 0.6 else [w, str(rng.randrange(words))] if kind < 1 else [w]
    return out


def test_random_pairs_and_ties():
    rng = random.Random(1)
    for _ in range(1500):
        words = rng.choice([1, 2, 3, 30])
        ref = [str(rng.randrange(words)) for _ in range(rng.randint(0, 40))]
        hyp = edited(rng, ref, rng.choice([0.05, 0.3, 0.9]), words) if rng.random() < 0.6 else [str(rng.randrange(words)) for _ in range(rng.randint(0, 40))]
        assert edit_operations(ref, hyp) == table(ref, hyp)


def test_far_apart_lengths_and_moved_blocks():
    a, b = [str(i) for i in range(300)], [str(i) for i in range(300, 420)]
    for ref, hyp in ((a, a[200:] + a[:200]), (a + b, b), (b, a + b), (a, b), ([], a), (a, []), (a, a)):
        assert edit_operations(ref, hyp) == table(ref, hyp)


def test_long_texts_take_time_by_their_errors():
    rng = random.Random(2)
    ref = [str(rng.randrange(3000)) for _ in range(16000)]
    hyp = edited(rng, ref, 0.02, 3000)
    start = time.process_time()
    found = edit_operations(ref, hyp)
    assert time.process_time() - start < 1
    assert 200 < sum(found) < 400


def test_an_alignment_as_short_as_the_bags_allow_fills_no_table(monkeypatch):
    """Substituted and left-out words of long texts are told without the table; what the bags leave open still uses it."""
    import random

    from coursemill.kernels import words as W

    rng = random.Random(5)

    def plain(ref, hyp):
        row = [(j, 0) for j in range(len(hyp) + 1)]
        for i, r in enumerate(ref, 1):
            new = [(i, i)]
            for j, h in enumerate(hyp, 1):
                new.append(min((row[j - 1][0] + (r != h), row[j - 1][1]), (row[j][0] + 1, row[j][1] + 1), (new[j - 1][0] + 1, new[j - 1][1])))
            row = new
        cost, deletions = row[-1]
        insertions = deletions + len(hyp) - len(ref)
        return cost - deletions - insertions, deletions, insertions

    for _ in range(1500):
        ref = [rng.choice("abcdefg") for _ in range(rng.randrange(12))]
        hyp = [w if rng.random() < 0.7 else rng.choice(["x", "y", "a", w + "x"]) for w in ref if rng.random() < 0.8] + [rng.choice("abz") for _ in range(rng.randrange(3))]
        for a, b in ((ref, hyp), (hyp, ref)):
            assert W.edit_operations(a, b) == plain(a, b)
    for small in (1, 2):  # narrow bands: the test of leaving them holds
        monkeypatch.setattr(W, "min", lambda *a, **k: min(*a, **k) if a[0] != 128 else min(small, a[1]), raising=False)
        for _ in range(400):
            ref = [rng.choice("abcd") for _ in range(rng.randrange(30))]
            hyp = [rng.choice("abce") for _ in range(rng.randrange(30))]
            assert W.edit_operations(ref, hyp) == plain(ref, hyp)
    monkeypatch.undo()
    monkeypatch.setattr(W, "_banded", None)
    ref = [f"w{rng.randrange(300)}" for _ in range(20_000)]
    hyp = [w + "?" if i % 7 == 3 else w for i, w in enumerate(ref) if i % 11 != 5]
    left = sum(i % 11 == 5 for i in range(20_000))
    changed = sum(w.endswith("?") for w in hyp)
    assert W.edit_operations(ref, hyp) == (changed, left, 0)
    assert W.edit_operations(hyp, ref) == (changed, 0, left)

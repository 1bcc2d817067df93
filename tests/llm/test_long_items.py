"""Benchmark items of few and of many words, edited as far as a match allows."""

import numpy as np
import pytest

from kinecohort.llm import decontamination
from tests.llm.test_methods import plain_distance, plain_nearest


def edited(rng, words, kind, k):
    words = list(words)
    for n in range(k):
        at = int(rng.integers(0, len(words)))
        if kind == "deletions":
            words.pop(at)
        elif kind == "insertions":
            words.insert(at, f"added{n}")
        elif kind == "substitutions":
            words[at] = f"other{n}"
        else:
            words = edited(rng, words, ["deletions", "insertions", "substitutions"][n % 3], 1)
    return words


def found(items, text):
    hashes = decontamination.words_of(text.encode())
    return decontamination.matches(items, hashes, np.array([0, len(hashes)]))


@pytest.mark.parametrize("kind", ["deletions", "insertions", "substitutions", "mixed"])
@pytest.mark.parametrize("length", [5, 7, 9, 12, 16, 24, 40, 59, 120, 121, 200, 400, 1000, 2000])
def test_items_are_found_up_to_the_greatest_distance(length, kind):
    rng = np.random.default_rng(length)
    hits, total = 0, 0
    for turn in range(60 if length <= 120 else 12 if length <= 400 else 4):
        item = [f"w{x}" for x in rng.integers(0, 4000, length)]
        items = decontamination.prepare([9], [" ".join(item).encode()])
        k = decontamination.edits(length)
        around = [f"v{x}" for x in rng.integers(0, 4000, 2 * length)]
        # In the middle of a text, at its end, and at its start.
        before, after = [(around[:length], around[length:]), (around, []), ([], around)][turn % 3]
        text = " ".join([*before, *edited(rng, item, kind, k), *after])
        got = found(items, text)
        assert all(d <= k for _, _, d, _, _ in got)
        hits, total = hits + bool(got), total + 1
    assert hits >= 0.95 * total


def test_one_edit_too_many_is_none():
    for length in (5, 24, 130, 400):
        item = [f"w{x}" for x in range(length)]
        items = decontamination.prepare([9], [" ".join(item).encode()])
        k = decontamination.edits(length)
        for drop in (k, k + 1):
            kept = [w for n, w in enumerate(item) if n % 2 == 0 or n // 2 >= drop]
            assert bool(found(items, " ".join(["a"] * 50 + kept + ["b"] * 50))) == (drop == k)


@pytest.mark.parametrize("length", [12, 40, 130, 250])
def test_the_nearest_passage(length):
    rng = np.random.default_rng(length)
    for turn in range(12):
        item = [f"w{x}" for x in rng.integers(0, 60, length)]
        around = [f"w{x}" for x in rng.integers(0, 60, length + 30)]
        text = around[:length] + edited(rng, item, "mixed", turn * length // 45) + around[length:]
        best = plain_nearest(item, text)
        got = found(decontamination.prepare([9], [" ".join(item).encode()]), " ".join(text))
        assert [g[:3] for g in got] == ([(0, 0, best)] if best <= decontamination.edits(length) else [])
        for _, _, d, first, n in got:
            assert plain_distance(item, text[first : first + n]) == d

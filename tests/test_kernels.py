"""Alignment kernels against plain dynamic programming and fixed examples."""

import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.config import PROSE, VERSE
from textloom.operators import kernels as k


def plain(a, b, s=PROSE):
    """Textbook alignment with the same preferences."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                d[i][j] = max(d[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch), d[i - 1][j] + s.gap, d[i][j - 1] + s.gap)
            else:
                d[i][j] = (i + j) * s.gap
    ops, i, j = [], len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch):
            i, j = i - 1, j - 1
            ops.append(("match" if a[i] == b[j] else "substitute", i, j))
        elif i and d[i][j] == d[i - 1][j] + s.gap:
            i -= 1
            ops.append(("delete", i, -1))
        else:
            j -= 1
            ops.append(("insert", -1, j))
    return ops[::-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.sampled_from([PROSE, VERSE]))
def test_alignment_takes_the_textbook_path(a, b, scores):
    assert k.needleman_wunsch(a, b, scores) == plain(a, b, scores)


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30), st.integers(1, 200))
def test_blocks_filled_again_give_the_same_path(a, b, cells):
    held, k.LIMITS = k.LIMITS, replace(k.LIMITS, short_cells=0, held_cells=cells)
    try:
        assert k.needleman_wunsch(a, b) == plain(a, b)
    finally:
        k.LIMITS = held


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_wide_band_is_exact(a, b):
    assert k.banded(a, b, 20)[0] == plain(a, b)


def test_small_cases():
    assert [o for o, *_ in k.needleman_wunsch("a b c".split(), "a x c".split())] == ["match", "substitute", "match"]
    assert [o for o, *_ in k.needleman_wunsch("the cat".split(), "the black cat".split())] == ["match", "insert", "match"]
    a, b = "k a b c k".split(), "k x y z k".split()
    assert sum(o == "substitute" for o, *_ in k.needleman_wunsch(a, b)) == 3
    assert sum(o in ("insert", "delete") for o, *_ in k.needleman_wunsch(a, b, VERSE)) == 6


def test_band_widens_until_it_holds_the_path():
    a = [f"t{i}" for i in range(400)]
    b = a[:10] + ["pad"] * 30 + a[10:]
    ops, touched = k.banded(a, b, 64)
    assert not touched and ops == k.needleman_wunsch(a, b)


def test_low_diversity_stays_bounded():
    r = random.Random(1)
    a = [r.choice("abcdef") for _ in range(4000)]
    b = a[:2000] + ["z"] + a[2001:]
    assert sum(o == "match" for o, *_ in k.bounded(a, b)) >= 3990


def test_chains():
    assert k.longest_increasing([0, 3, 1, 2, 4]) == [0, 2, 3, 4]
    assert k.heaviest_increasing([5, 1, 2], [5, 1, 1]) == [0]
    assert k.heaviest_increasing([1, 1], [1, 1]) == [0]
    assert k.heaviest_increasing([], []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 2)), max_size=12))
def test_heaviest_chain_matches_the_quadratic_rule(pins):
    values, weights = [v for v, _ in pins], [w for _, w in pins]
    best, back = list(weights), [-1] * len(pins)
    for i in range(len(pins)):
        for j in range(i):
            if values[j] < values[i] and best[j] + weights[i] > best[i]:
                best[i], back[i] = best[j] + weights[i], j
    end = max(range(len(pins)), key=lambda i: (best[i], -i), default=-1)
    chain = []
    while end >= 0:
        chain.append(end)
        end = back[end]
    assert k.heaviest_increasing(values, weights) == chain[::-1]


@pytest.mark.parametrize("length, reach", [(100, 200), (100_000, 3000), (10_000_000, 6000)])
def test_move_tolerance(length, reach):
    assert k.move_tolerance(length, length) == reach


def test_deviation_rounds_half_up():
    assert k.diagonal_deviation(1, 1, 2, 3) == 1
    assert k.diagonal_deviation(5, 9, 0, 3) == 0


def test_swapped_clauses_are_one_move():
    a = "first distinctive clause here second separate clause now".split()
    b = "second separate clause now first distinctive clause here".split()
    moves = [s.move for s in k.align(a, b) if s.move]
    assert len(moves) == 1


def test_far_coincidence_is_no_move():
    a = ["rareword", "pair"] + ["paddinga"] * 1200
    b = ["paddingb"] * 1200 + ["rareword", "pair"]
    assert not [s for s in k.align(a, b) if s.move]

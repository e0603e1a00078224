"""Shared spans against brute force over all substrings."""

import random

import numpy as np
import pytest

from textloom.llm import spans as S

SCHEMA = "rid long, field int, id long, grp long, value string"


def brute(rows, span):
    pairs = set()
    grams = {r[0]: {r[4][i : i + span] for i in range(len(r[4]) - span + 1)} for r in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[3] != b[3] and grams[a[0]] & grams[b[0]]:
                pairs.add((a[0], b[0]))
    return pairs


def found(spark, rows, span=S.SPAN):
    return {tuple(r) for r in S.pairs(S.stretches(spark.createDataFrame(rows, SCHEMA), span)).collect()}


def text(r, n, alphabet="abcdefgh éж\n"):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_planted_spans_of_every_length(spark, seed):
    r = random.Random(seed)
    rows, shared = [], [text(r, n) for n in (149, 150, 151, 160, 300)]
    for i in range(40):
        value = text(r, r.randrange(0, 200)) + r.choice(shared) + text(r, r.randrange(0, 200))
        rows.append((i * 2 + i % 2, i % 2, i, r.randrange(12), value))
    assert found(spark, rows) == brute(rows, S.SPAN)


def test_runs_periods_edges_and_copies(spark):
    r = random.Random(9)
    tail = text(r, 120)
    values = [" " * 149, " " * 150, " " * 400, "ab" * 75, "ab" * 300, "x" + "ab" * 74, " " * 90 + tail, " " * 60 + tail, "y" * 5 + " " * 31 + tail, tail + "é" * 40, tail + "é" * 70, "same " * 60, "same " * 60]
    rows = [(2 * i, 0, i, i, v) for i, v in enumerate(values)]
    assert found(spark, rows) == brute(rows, S.SPAN)


def test_groups_fields_repeats(spark):
    v = text(random.Random(3), 200)
    rows = [(2, 0, 1, 7, v), (4, 0, 2, 7, v), (6, 0, 3, 8, v), (6, 0, 3, 8, v), (7, 1, 3, 9, v)]
    assert found(spark, rows) == {(2, 6), (4, 6)}


def test_a_hot_stretch_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "PER_TASK", 4)
    v = text(random.Random(4), 160)
    rows = [(2 * i, 0, i, i, chr(97 + i % 5) + v) for i in range(20)]
    assert found(spark, rows) == {(2 * i, 2 * j) for i in range(20) for j in range(i + 1, 20)}


def test_empty(spark):
    assert found(spark, []) == set()


def test_names_are_the_same_inside_equal_spans():
    r = random.Random(5)
    core = text(r, 400)
    (n1, s1, e1, _), (n2, s2, e2, _) = S.recompress(["q" * 3 + core]), S.recompress(["uvw xyz" + core + "tail"])
    at = lambda n, s, e, shift: {(a - shift, b - shift, x) for x, a, b in zip(n.tolist(), s.tolist(), e.tolist()) if a - shift >= S.MARGIN and b - shift <= 400 - S.MARGIN}
    assert at(n1, s1, e1, 3) == at(n2, s2, e2, 7) != set()
    assert max(e1 - s1) <= S.LONGEST


def test_least_of_ranges():
    r = np.random.default_rng(1)
    v = r.integers(0, 50, 200).astype(np.uint64)
    stop = np.minimum(np.arange(200) + r.integers(1, 9, 200), 200)
    stop = np.maximum.accumulate(stop)
    expected = {int(i + np.argmin(v[i : stop[i]])) for i in range(200)}
    assert set(S._least(v, stop).tolist()) == expected

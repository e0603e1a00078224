"""Leak search against brute force over all windows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import leak as L


def edit(p, t):
    """Least distance of p to a stretch of t, by the textbook."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=10), st.text("abc", max_size=15))
def test_bit_parallel_distance(p, t):
    assert L.myers(list(p), list(t)) == edit(p, t)


def test_words():
    assert L.words("L’Été—No_1: naïve!") == ["l", "ete", "no", "1", "naive"] and L.words(None) == []


@pytest.mark.parametrize("seed", range(4))
def test_exact_windows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 60)))) for i in range(15)]
    matcher = L.Matcher(items, L.RUN, L.BUDGET)
    for _ in range(40):
        _, t = r.choice(items)
        w = t.split()
        a = r.randrange(len(w))
        doc = " ".join(r.choice(vocabulary) for _ in range(20)) + " " + ", ".join(w[a : a + r.randrange(8, 20)]).upper() + " " + " ".join(r.choice(vocabulary) for _ in range(20))
        d = L.words(doc)
        grams = {tuple(d[i : i + 12]) for i in range(len(d) - 11)}
        expected = {i for i, x in items if any(tuple(x.split()[k : k + 12]) in grams for k in range(len(x.split()) - 11))}
        assert {i for i, (dist, *_) in matcher.search(doc).items() if dist == 0} == expected


def test_one_word_may_differ():
    item = " ".join(f"w{i}" for i in range(12))
    matcher = L.Matcher([(1, item)], 12, 1)
    assert matcher.search(item.replace("w3 ", "other "))[1][0] == 1
    assert matcher.search(item.replace("w3 ", ""))[1][0] == 1
    assert matcher.search(item.replace("w3 ", "x ").replace("w9", "y")) == {}


@pytest.mark.parametrize("seed", range(4))
def test_altered_windows_start_anywhere(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, [r.choice(vocabulary) for _ in range(r.randrange(13, 40))]) for i in range(6)]
    matcher = L.Matcher([(i, " ".join(w)) for i, w in items], L.RUN, L.BUDGET)
    for _ in range(40):
        _, w = r.choice(items)
        a = r.randrange(len(w) - 11)
        part = w[a : a + r.randrange(11, 15)]
        at = r.randrange(len(part))
        part[at : at + 1] = r.choice([[], ["x"], ["x", part[at]], [part[at]]])
        doc = [r.choice(vocabulary) for _ in range(8)] + part + [r.choice(vocabulary) for _ in range(8)]
        best = {i: min(edit(x[k : k + 12], doc) for k in range(len(x) - 11)) for i, x in items}
        assert {i: d for i, (d, *_) in matcher.search(" ".join(doc)).items()} == {i: d for i, d in best.items() if d <= 1}


def test_table_blocks_nulls_repeats(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + passage, 0), (2, None, 0), (3, "", 0), (4, passage[:60], 0), (1, "x " + passage, 0)], "doc_id long, text string, distance int")
    items = spark.createDataFrame([(10, passage), (11, passage), (12, None), (13, "too short"), (10, passage)], "item_id long, item_text string")
    for block in (10, 1_000_000):
        rows = L.leaks(docs, items, block_chars=block).where("distance = 0").select("doc_id", "item_id").distinct().collect()
        assert sorted(map(tuple, rows)) == [(1, 10), (1, 11)]
    assert L.leaks(docs.limit(0), items).collect() == [] and L.leaks(docs, items.limit(0)).collect() == []

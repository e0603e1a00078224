"""Packing: capacity, wholeness, waste, ranks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import pack as P


@pytest.mark.parametrize("seed", range(5))
def test_histogram(seed):
    r = random.Random(seed)
    lengths = Counter(min(2048, int(r.expovariate(1 / 250)) + 1) for _ in range(20_000))
    patterns = P.pack_histogram(lengths)
    used: Counter = Counter()
    for count, content in patterns:
        assert sum(length * c for length, c in content) <= 2048
        for length, c in content:
            used[length] += count * c
    assert used == lengths
    packs, total = sum(c for c, _ in patterns), sum(k * v for k, v in lengths.items())
    assert packs <= -(-total // 2048) * 1.02 + 1


def test_equal_lengths_share():
    assert P.pack_histogram({1000: 7}) == [(3, ((1000, 2),)), (1, ((1000, 1),))]
    assert P.pack_histogram({}) == [] and P.pack_histogram({2048: 3, 0: 5}) == [(3, ((2048, 1),))]


def test_ranks_are_a_permutation(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7 + 2).alias("g"))
    rows = P.ranked(df, "g", ["id"], salts=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 2000


def test_documents(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("alpha beta gamma rivière дом".split()) for _ in range(r.choice([1, 5, 80, 300]))) for _ in range(120)]
    texts += ["слово " * 3000, "", None, texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, container int")
    rows = P.pack_documents(df).collect()
    assert {x.doc_id for x in rows} == {i for i, t in enumerate(texts) if t is not None}
    fill: Counter = Counter()
    for x in rows:
        fill[x.container] += x.n_tokens
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 2
    long = sorted((x for x in rows if x.doc_id == 120), key=lambda x: x.piece)
    assert len(long) > 1 and "".join(texts[120][x.char_from : x.char_to] for x in long) == texts[120]
    assert all(x.piece == 0 for x in rows if x.doc_id != 120)
    assert P.pack_documents(df.limit(0)).collect() == []

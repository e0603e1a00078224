"""Pieces tile the text, stay under the limit and end at natural boundaries."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import split as S


def check(text, limit, overlap):
    cuts = S.pieces(text, limit, overlap)
    assert "".join(text[own:to] for own, to, _ in cuts) == text
    for k, (own, to, start) in enumerate(cuts):
        assert to - start <= limit and own - start <= overlap and (k or start == own)
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab. \n!é")), max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_tiling(text, limit, overlap):
    check(text, limit, overlap)


def test_prefers_strong_boundaries():
    text = ("word " * 20).strip() + ".\n\n" + ("other " * 20).strip() + ". " + ("last " * 10).strip()
    assert text[: check(text, 180, 20)[0][1]].endswith(".\n\n")


def test_within_the_limit_and_unbroken():
    assert check("x" * 3000, 3000, 200) == [(0, 3000, 0)]
    assert len(check("x" * 10_000, 3000, 200)) == 4
    assert S.pieces("") == [(0, 0, 0)]


def test_overlap_begins_at_a_word():
    text = "alpha beta gamma " * 400
    for own, _, start in check(text, 3000, 200)[1:]:
        assert 0 < own - start <= 200 and text[start - 1] == " "


def test_very_long_text():
    check("one two three. " * 60_000, 3000, 200)


def test_table(spark):
    df = spark.createDataFrame([(1, "a " * 2000, 5), (1, "a " * 2000, 5), (2, None, 5), (3, "", 5)], "witness_id long, text string, piece_no int")
    rows = S.split_text(df, "witness_id").distinct().orderBy("witness_id", "piece_no").collect()
    assert [(r.witness_id, r.piece_no, r.n_pieces) for r in rows] == [(1, 0, 2), (1, 1, 2), (3, 0, 1)]
    assert S.split_text(df.limit(0), "witness_id").collect() == []

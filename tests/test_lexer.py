"""Tokens, pages, lines, words and offsets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import witnesses
from textloom.config import DIPLOMATIC, GB_US, SUBSTANTIVE, THROUGH_NUMBERED, Pagination
from textloom.operators.lexer import tokens


def lex(spark, text, normalizer=SUBSTANTIVE, pagination=Pagination()):
    return tokens(witnesses(spark, text), normalizer, pagination).orderBy("tok").collect()


def test_words_and_punctuation_are_kept_apart(spark):
    found = lex(spark, "Ships; gulls?", DIPLOMATIC)
    assert [(t.surface, t.is_word) for t in found] == [("Ships", True), (";", False), ("gulls", True), ("?", False)]


def test_substantive_forms(spark):
    found = lex(spark, "Her Old; LANTERN shone. Œuvré")
    assert [t.normalized for t in found if t.cidx is not None] == ["her", "old", "lantern", "shone", "œuvre"]
    assert [t.cidx for t in found if t.cidx is not None] == [0, 1, 2, 3, 4]


def test_spelling_table(spark):
    assert [t.normalized for t in lex(spark, "grey Harbour", GB_US)] == ["gray", "harbor"]


def test_paragraphs(spark):
    found = lex(spark, "salt and rope\n\ntar and oak")
    assert [t.paragraph for t in found] == [0, 0, 0, 1, 1, 1]


def test_pages_begin_at_markers_that_emit_nothing(spark):
    found = lex(spark, "leaf alpha\n\f\nleaf beta\n\n<!-- page break -->\nleaf gamma\n\n---\r\nleaf delta")
    assert [t.page for t in found if t.surface == "leaf"] == [0, 1, 2, 3]
    assert {t.surface for t in found} == {"leaf", "alpha", "beta", "gamma", "delta"}


def test_rule_inside_a_line_is_a_word(spark):
    assert [t.page for t in lex(spark, "a --- b")] == [0, 0, 0]


@pytest.mark.parametrize(
    "text, words",
    [
        ("a sister-in-arms", ["a", "sister", "in", "arms"]),
        ("-dash", ["-dash"]),
        ("can't half-light", ["can't", "half", "light"]),
    ],
)
def test_hyphens_split_inside_words_only(spark, text, words):
    assert [t.surface for t in lex(spark, text) if t.is_word] == words


def test_diplomatic_keeps_hyphens(spark):
    assert [t.surface for t in lex(spark, "can't half-light", DIPLOMATIC)] == ["can't", "half-light"]


@pytest.mark.parametrize("close", ["\n-->\nhail snow", "\n<!-- /no_collate -->\nhail snow"])
def test_excluded_regions(spark, close):
    found = lex(spark, f"rain wind\n<!-- no_collate\nleave ALL of this{close}")
    assert [t.surface for t in found] == ["rain", "wind", "hail", "snow"]


def test_unclosed_region_runs_to_the_end(spark):
    assert [t.surface for t in lex(spark, "only these words\n<!-- no_collate\nindex\nplates")] == ["only", "these", "words"]


def test_lines_per_page(spark):
    found = lex(spark, "v1 ash\nv2 elm\nv3 fir\nv4 yew\nv5 oak", pagination=Pagination(lines_per_page=2))
    assert [(t.page, t.line) for t in found if t.surface.startswith("v")] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_through_numbering(spark):
    found = lex(spark, "ash\nelm\n\f\nfir\nyew\noak", pagination=THROUGH_NUMBERED)
    assert [t.line for t in found] == [0, 1, 2, 3, 4]


def test_explicit_offsets(spark):
    text = "north south east west"
    found = lex(spark, text, pagination=Pagination(offsets=(0, text.index("east"))))
    assert [(t.page, t.line) for t in found] == [(0, 0), (0, 0), (1, 0), (1, 0)]


def test_word_index_and_line_restart(spark):
    found = {t.surface: t for t in lex(spark, "red blue\ngreen gold\n\n<!-- page break -->\n\ngrey white")}
    assert (found["gold"].page, found["gold"].line, found["gold"].word_index) == (0, 1, 1)
    assert (found["grey"].page, found["grey"].line, found["grey"].word_index) == (1, 0, 0)


def test_offsets_are_utf16_and_count_carriage_returns(spark):
    text = "a𠀀b c\r\nd"
    found = lex(spark, text)
    units = text.encode("utf-16-le")
    for t in found:
        assert units[2 * t.char_from : 2 * t.char_to].decode("utf-16-le") == t.surface
    assert [t.surface for t in found] == ["a𠀀b", "c", "d"]


def test_marks_are_signs_where_pages_are_counted(spark):
    found = lex(spark, "ash\n---\nelm <!-- page break --> fir\n\fyew", pagination=Pagination(lines_per_page=9))
    assert {t.page for t in found} == {0} and "---" in {t.surface for t in found} and "page" in {t.surface for t in found}


def test_null_blank_and_extra_columns(spark):
    rows = spark.createDataFrame([("w", "A", 0, None, "x"), ("w", "B", 1, "", "y"), ("w", "C", 2, "  \n\t ", "z"), ("w", "D", 3, "ok", "q")], "work_id string, siglum string, ordinal int, text string, piece string")
    assert [t.surface for t in tokens(rows).collect()] == ["ok"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab-' .,\n\r\f\té’§")), max_size=30), min_size=1, max_size=6))
def test_every_token_stands_at_its_offsets(spark, texts):
    rows = spark.createDataFrame([(str(i), "A", 0, t) for i, t in enumerate(texts)], "work_id string, siglum string, ordinal int, text string")
    for t in tokens(rows, DIPLOMATIC).collect():
        assert texts[int(t.work_id)][t.char_from : t.char_to] == t.surface

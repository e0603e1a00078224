"""Unification against a rule per case."""

import pytest

from textloom.llm import unify as U

CASES = [
    ("plain text", "plain text", False),
    ("ａｌｌ ＴＨＡＴ！", "all THAT!", True),
    ("ﬁsh öﬀnete", "fish öffnete", True),
    ("était", "était", True),
    ("fe­ared t​he ﻿cup", "feared the cup", True),
    ("a b c d", "a b c d", True),
    ("thе hіddеn tree", "the hidden tree", True),
    ("the аnd а word", "the and a word", True),
    ("Οrsane Τhe", "Orsane The", True),
    ("разpyшил дом", "разрушил дом", True),
    ("légеrе", "légere", True),
    ("а о с у в сад", "а о с у в сад", False),
    ("Рукопись из Зарандела, a title", "Рукопись из Зарандела, a title", False),
    ("Αἴολος ὁ γραφεύς", "Αἴολος ὁ γραφεύς", False),
    ("ſo ½ № “q” – — … †", "ſo ½ № “q” – — … †", False),
    ("thin space　wide", "thin space　wide", False),
    ("tab\tand\r\nline\x0c", "tab\tand\r\nline\x0c", False),
    ("", "", False),
    (None, None, None),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [("text", i, v, "x") for i, (v, _, _) in enumerate(CASES)]
    return {r.record_id: r for r in U.unify(spark.createDataFrame(rows, "field string, record_id long, value string, unified string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(result, i):
    _, expected, case = CASES[i]
    assert (result[i].unified, result[i].is_case) == (expected, case)


def test_unified_form_is_stable(spark, result):
    again = U.unify(spark.createDataFrame([("text", k, r.unified) for k, r in result.items()], "field string, record_id long, value string")).collect()
    assert all(not r.is_case for r in again if r.unified is not None) and all(r.unified == result[r.record_id].unified for r in again)


def test_long_and_empty(spark):
    df = spark.createDataFrame([("text", 1, "thе " * 50_000)], "field string, record_id long, value string")
    assert U.unify(df).first().unified == "the " * 50_000
    assert U.unify(df.limit(0)).collect() == []

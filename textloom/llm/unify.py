"""Problem 5: one consistent form for text that looks the same.

Method: DuckDB runs inside Arrow partitions. One embedded SQL statement removes invisible characters, maps full-width
forms, ligature signs and no-break spaces with ``translate`` and ``replace``, composes with ``nfc_normalize`` and
replaces look-alike letters word by word: letters of another script in a word that otherwise fits one script, and whole
words of look-alikes that stand between words of the other script. The same SQL runs on whole tables in DuckDB, which
is how the queries are checked.

Defined results: null stays null and is no case; the empty text stays empty; a value counts once per id however often
it was delivered; texts of any length are taken whole; words that no single script explains stay as they are (genuine
words of another script, long s, fractions, number signs, quotes and dashes are untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from textloom.llm.common import read_table, spread

# Characters and what they look like.
INVISIBLE = "­؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿"
NO_BREAK = "   "
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "｟｠￠￡￢￣￤￥￦"
FULL_WIDTH_AS = "".join(map(chr, range(0x21, 0x7F))) + "⦅⦆¢£¬¯¦¥₩"
CYRILLIC = "АВЕЅІЈКМНОРСТУХЁЇӒӦаеѕіјорсухһёїѐӓӧԁԛԝӀӏҮүԚԜ"
CYRILLIC_AS = "ABESIJKMHOPCTYXËÏÄÖaesijopcyxhëïèäödqwIlYyQW"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧιονυραϹϲϳͿ"
GREEK_AS = "ABEZHIKMNOPTYXiovupaCcjJ"
DISTANT = "ՕօՍսհոցԼՏᎪᎠᎡᎢᎬᎳᎷᎻᎫᏃᏚᏞᏟᏢᏦᏴⲞⲟⲢⲣⲤⲥ"  # Armenian, Cherokee, Coptic
DISTANT_AS = "OoUuhngLSADRTEWMHJZSLCPKBOoPpCc"
TO_CYRILLIC_FROM = "ABESIJKMHOPCTYXËÏaesijopcyxhëï"
TO_CYRILLIC = "АВЕЅІЈКМНОРСТУХЁЇаеѕіјорсухһёї"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def unify_sql(source: str, extra: str = "field, record_id") -> str:
    """Over ``source(field, record_id, value)``: unified and one flag per kind of case."""
    to_latin = f"translate(w, {_literal(CYRILLIC + GREEK + DISTANT)}, {_literal(CYRILLIC_AS + GREEK_AS + DISTANT_AS)})"
    to_cyrillic = f"translate(w, {_literal(TO_CYRILLIC_FROM)}, {_literal(TO_CYRILLIC)})"
    other = r"'[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}]'"
    ligatures = "b"
    for sign, plain in LIGATURES.items():
        ligatures = f"replace({ligatures}, {_literal(sign)}, {_literal(plain)})"
    return rf"""
WITH a AS (
  SELECT {extra}, value,
    regexp_replace(value, '[{INVISIBLE}]', '', 'g') AS visible,
    regexp_matches(value, '[\x{{FF01}}-\x{{FF60}}\x{{FFE0}}-\x{{FFE6}}]') AS has_full_width,
    regexp_matches(value, '[\x{{FB00}}-\x{{FB06}}]') AS has_ligature,
    nfc_normalize(value) <> value AS has_uncomposed,
    regexp_matches(value, '[{INVISIBLE}]') AS has_invisible,
    regexp_matches(value, '[{NO_BREAK}]') AS has_no_break
  FROM {source}
), b AS (
  SELECT *, translate(translate(visible, {_literal(FULL_WIDTH)}, {_literal(FULL_WIDTH_AS)}), {_literal(NO_BREAK)}, '{' ' * len(NO_BREAK)}') AS b FROM a
), c AS (
  SELECT *, nfc_normalize({ligatures}) AS plain FROM b
), d AS (
  SELECT *,
    CASE WHEN regexp_matches(plain, {other}) AND regexp_matches(plain, '\p{{Latin}}')
      THEN regexp_extract_all(plain, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+') END AS parts
  FROM c
), e AS (
  SELECT *,
    list_transform(parts, lambda w: CASE
      WHEN NOT regexp_matches(w, '\p{{L}}') THEN ''
      WHEN regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, {other}) THEN
        CASE WHEN NOT regexp_matches({to_latin}, {other}) THEN 'l' WHEN NOT regexp_matches({to_cyrillic}, '\p{{Latin}}') THEN 'c' ELSE 'm' END
      WHEN regexp_matches(w, '\p{{Latin}}') THEN CASE WHEN NOT regexp_matches({to_cyrillic}, '\p{{Latin}}') THEN 'La' ELSE 'L' END
      WHEN regexp_matches(w, {other}) THEN CASE WHEN NOT regexp_matches({to_latin}, {other}) THEN 'Oa' ELSE 'O' END
      ELSE '' END) AS kinds
  FROM d
), f AS (
  SELECT *,
    CASE WHEN parts IS NOT NULL THEN array_to_string(list_transform(parts, lambda w, i: CASE
      WHEN kinds[i] = 'l' THEN {to_latin}
      WHEN kinds[i] = 'c' THEN {to_cyrillic}
      WHEN kinds[i] = 'Oa' AND coalesce(kinds[i - 2], 'l') IN ('L', 'La', 'l', '') AND coalesce(kinds[i + 2], 'l') IN ('L', 'La', 'l', '')
        AND (coalesce(kinds[i - 2], '') <> '' OR coalesce(kinds[i + 2], '') <> '') THEN {to_latin}
      WHEN kinds[i] = 'La' AND kinds[i - 2] IN ('O', 'c') AND kinds[i + 2] IN ('O', 'c') THEN {to_cyrillic}
      ELSE w END), '') ELSE plain END AS relettered
  FROM e
), g AS (
  SELECT *, CASE WHEN relettered <> plain THEN nfc_normalize(relettered) ELSE plain END AS unified FROM f
)
SELECT {extra}, unified, has_full_width, has_ligature, has_uncomposed, has_invisible, has_no_break, unified <> plain AS has_look_alike,
  has_full_width OR has_ligature OR has_uncomposed OR has_invisible OR has_no_break OR unified <> plain AS is_case
FROM g"""


SCHEMA = "field string, record_id long, unified string, has_full_width boolean, has_ligature boolean, has_uncomposed boolean, has_invisible boolean, has_no_break boolean, has_look_alike boolean, is_case boolean"


def unify(values: DataFrame) -> DataFrame:
    """``values(field, record_id, value)`` in one consistent form, with a flag for each kind of difference found."""
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    query = unify_sql("batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                con.register("batch", pa.Table.from_batches([b.slice(lo, 2048)]))
                table = con.sql(query).to_arrow_table()
                con.unregister("batch")
                yield from table.select(schema.names).cast(schema).to_batches()

    return spread(values.select("field", F.col("record_id").cast("long").alias("record_id"), "value")).mapInArrow(run, SCHEMA)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    witness = read_table(spark, sf_dir, "witness").select(F.lit("text").alias("field"), F.col("witness_id").alias("record_id"), F.col("text").alias("value"))
    variation = read_table(spark, sf_dir, "variation").select(F.lit("compared_reading").alias("field"), F.col("variation_id").alias("record_id"), F.col("compared_reading").alias("value"))
    return witness.union(variation)


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(values(spark, sf_dir)).select("field", "record_id", "unified").dropDuplicates(["field", "record_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(values(spark, sf_dir)).where("is_case").select("field", "record_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_unified": p5_unified}
_VALUES = "(SELECT DISTINCT 'text' AS field, witness_id AS record_id, text AS value FROM witness UNION ALL SELECT DISTINCT 'compared_reading', variation_id, compared_reading FROM variation)"
SQL = {
    "p5_found": f"SELECT field, record_id FROM ({unify_sql(_VALUES)}) WHERE is_case",
    "p5_unified": f"SELECT field, record_id, unified FROM ({unify_sql(_VALUES)})",
}

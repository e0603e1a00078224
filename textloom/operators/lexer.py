"""Tokens with citations, as rows.

The text is read where it lies: one Arrow stage, no exchange and no sorting, since lines, pages and words are counted
along the way (``scan``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from textloom.arrow import rows_of
from textloom.config import SUBSTANTIVE, Normalizer, Pagination, normalizer as named
from textloom.operators.scan import Tokens, scan
from textloom.session import find_package, spread

SETTINGS = ("normalizer", "lines_per_page", "continuous")
SCHEMA = "work_id {kind}, siglum string, ordinal int, tok int, cidx int, surface string, normalized string, is_word boolean, char_from int, char_to int, line int, paragraph int, page int, word_index int"
FLUSH = 20_000  # tokens of an Arrow batch


def read(row: dict, text: str | None, normalizer: Normalizer, pagination: Pagination, by_row: bool) -> Tokens:
    """The tokens of a text by the settings of its row, or by those given."""
    if by_row:
        normalizer = named(row["normalizer"])
        pagination = Pagination(row["lines_per_page"], None, bool(row["continuous"]))
    return scan(text, normalizer, pagination)


def tokens(witness: DataFrame, normalizer: Normalizer = SUBSTANTIVE, pagination: Pagination = Pagination(), by_row: bool = False) -> DataFrame:
    """Tokens of ``witness(work_id, siglum, ordinal, text)``, in order ``tok`` per witness.

    ``char_from`` and ``char_to`` count UTF-16 units of the text as it stands; ``cidx`` numbers the comparable tokens
    (those with a non-empty normal form) and is null on the others. Null and blank texts have no tokens; a byte order
    mark at the start is skipped. Repeated rows give repeated tokens; extra columns are dropped.

    With ``by_row`` the columns ``normalizer`` (a preset's name), ``lines_per_page`` (or null) and ``continuous`` of each
    witness take the place of the arguments.
    """
    find_package(witness.sparkSession)
    schema = SCHEMA.format(kind=witness.schema["work_id"].dataType.simpleString())
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in arrow]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for r in rows_of(batches):
            t = read(r, r["text"], normalizer, pagination, by_row)
            n, k = len(t), 0
            cidx: list[int | None] = []
            for form in t.normalized:
                cidx.append(k if form else None)
                k += bool(form)
            told = ([r["work_id"]] * n, [r["siglum"]] * n, [r["ordinal"]] * n, range(n), cidx, t.surface, t.normalized, t.is_word, t.char_from, t.char_to, t.line, t.paragraph, t.page, t.word_index)
            for column, values in zip(columns, told):
                column += values
            if len(columns[0]) >= FLUSH:
                yield batch()
                columns = [[] for _ in arrow]
        if columns[0]:
            yield batch()

    held = witness.where(F.col("text").isNotNull()).select("work_id", "siglum", F.col("ordinal").cast("int").alias("ordinal"), "text", *(SETTINGS if by_row else ()))
    return spread(held).mapInArrow(run, schema)

"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from textloom.session import cut, discard, keep, read_table, spread

__all__ = ["arrow_rows", "cut", "discard", "keep", "read_table", "spread"]


def arrow_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], schema: str, flush: int = 4096) -> DataFrame:
    """Run ``rows`` once per partition over all its rows, as dicts; its tuples leave in Arrow batches of ``flush`` rows.

    ``rows`` is called with an iterator, so set-up (a model, a compressor, an automaton) is paid once per partition.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[dict]:
            for b in batches:
                names = b.schema.names
                for lo in range(0, b.num_rows, 512):  # Python objects of few rows at a time
                    for values in zip(*(c.to_pylist() for c in b.slice(lo, 512).columns)):
                        yield dict(zip(names, values))

        held: list[tuple] = []
        for row in rows(source()):
            held.append(row)
            if len(held) >= flush:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

"""Arrow stages: rows of a batch in, tuples out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

Rows = Callable[[Iterator[dict]], Iterable[tuple]]


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[dict]:
    """Rows as dicts; of few rows at a time there are Python objects."""
    for b in batches:
        names = b.schema.names
        for lo in range(0, b.num_rows, at_once):
            for values in zip(*(c.to_pylist() for c in b.slice(lo, at_once).columns)):
                yield dict(zip(names, values))


def arrow_rows(df: DataFrame, rows: Rows, schema: str, flush: int = 4096) -> DataFrame:
    """Run ``rows`` once per partition over all its rows, as dicts; its tuples leave in Arrow batches of ``flush`` rows."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(rows_of(batches)):
            held.append(row)
            if len(held) >= flush:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

"""Table functions for Spark SQL: ``SELECT * FROM pairs, LATERAL nw_align(a, b)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textloom.config import PROSE, VERSE
from textloom.operators import kernels
from textloom.session import find_package


@udtf(returnType="op_no int, op string, a int, b int")
class NwAlign:
    """Alignment operations of two arrays of strings; the optional third argument is ``prose`` or ``verse``."""

    def eval(self, a: list[str], b: list[str], scores: str = "prose") -> Iterator[tuple]:
        found = kernels.needleman_wunsch(a or [], b or [], VERSE if scores == "verse" else PROSE)
        for n, (op, i, j) in enumerate(found):
            yield n, op, i if i >= 0 else None, j if j >= 0 else None


@udtf(returnType="seg int, is_move boolean, op_no int, op string, a int, b int")
class AlignMoves:
    """Operations of two arrays of keys with moved blocks found; moves come first."""

    def eval(self, a: list[str], b: list[str]) -> Iterator[tuple]:
        for k, s in enumerate(kernels.align(a or [], b or [])):
            for n, (op, i, j) in enumerate(s.ops):
                yield k, s.move is not None, n, op, i if i >= 0 else None, j if j >= 0 else None


def register(spark: SparkSession) -> None:
    find_package(spark)
    spark.udtf.register("nw_align", NwAlign)
    spark.udtf.register("align_moves", AlignMoves)

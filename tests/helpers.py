"""Small builders used by the tests."""

from __future__ import annotations


def witnesses(spark, *texts, work="w", sigla="ABCDEFGH"):
    return spark.createDataFrame([(work, sigla[i], i, t) for i, t in enumerate(texts)], "work_id string, siglum string, ordinal int, text string")


def write(path, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")

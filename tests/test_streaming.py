"""Streams give what a batch over the same rows gives; table functions work from SQL."""

from datetime import datetime

from textloom.functions import udtf
from textloom.streaming import arrivals as A

SCHEMA = "witness_id long, case_id long, ordinal int, siglum string, text string, lang string, origin string, received_at timestamp"


def rows(spark, *items):
    return spark.createDataFrame([(i, c, o, s, t, "EN ", None, datetime(2024, 1, 1, h)) for i, c, o, s, t, h in items], SCHEMA)


def test_arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, (1, 7, 0, "A", "the cat sat", 1), (2, 7, 1, "B", "the black cat sat", 1), (1, 7, 0, "A", "the cat sat", 3)).write.parquet(folder)
    stream = A.arrivals(spark, folder, spark.read.parquet(folder).schema)
    query = A.collate_arrivals(A.delivered_once(stream), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()
    assert [(v.variation_type, v.compared_reading) for v in found] == [("insertion", "black")]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, (1, 7, 0, "A", "abc", 1), (2, 7, 1, "B", None, 1), (3, 8, 0, "A", "x", 2)).write.parquet(folder)
    stream = A.per_window(A.arrivals(spark, folder, spark.read.parquet(folder).schema))
    query = stream.writeStream.format("memory").queryName("per_window_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("per_window_test").orderBy("window").collect()
    assert [(r.lang, r.witnesses, r.chars) for r in found] == [("en", 2, 3), ("en", 1, 1)]


def test_table_functions(spark):
    udtf.register(spark)
    found = spark.sql("SELECT op FROM VALUES (array('a','b'), array('a','x','b')) AS t(a, b), LATERAL nw_align(a, b) ORDER BY op_no").collect()
    assert [r.op for r in found] == ["match", "insert", "match"]

"""Witnesses that arrive over time: each once, counted in event time, and collated with the works they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.config import Config
from textloom.operators import collate
from textloom.sources import witnesses


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the ``witness`` table's Parquet files as they appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def delivered_once(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Without repeated deliveries that come within ``delay``; state older than that is dropped by the watermark."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["witness_id"])


def per_window(stream: DataFrame, window: str = "1 hour", delay: str = "7 days") -> DataFrame:
    """(window, lang, witnesses, chars): what arrived in each window; late rows count until the watermark passes."""
    held = stream.withWatermark("received_at", delay)
    lang = F.lower(F.trim(F.coalesce("lang", F.lit("und"))))
    return held.groupBy(F.window("received_at", window), lang.alias("lang")).agg(F.count(F.lit(1)).alias("witnesses"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"))


def collate_arrivals(stream: DataFrame, store: str, out: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Keep arriving witnesses in ``store`` and write the variations of every work a batch touches to ``out/batch=<n>``.

    A batch that is repeated after a failure overwrites its own folders, so results stay exact.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = rows.select("case_id").distinct()
        known = spark.read.option("basePath", store).parquet(f"{store}/batch=*").drop("batch")
        works = witnesses.from_table(known.join(touched, "case_id", "left_semi"))
        collate.variations(works, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

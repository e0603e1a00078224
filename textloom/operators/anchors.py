"""Landmarks shared by two witnesses, as joins: n-grams that occur once on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import LIMITS

SEP = "\x1f"


def grams(keys: DataFrame, n: int) -> DataFrame:
    """(work_id, siglum, gram, pos) of every run of ``n`` comparable tokens in ``keys(work_id, siglum, cidx, key, page)``."""
    w = Window.partitionBy("work_id", "siglum").orderBy("cidx")
    parts = [F.lead("key", k).over(w) if k else F.col("key") for k in range(n)]
    return keys.withColumn("_last", parts[-1]).withColumn("gram", F.concat_ws(SEP, *parts)).where("_last IS NOT NULL").select("work_id", "siglum", "gram", F.col("cidx").alias("pos"), "page")


def unique_grams(keys: DataFrame, n: int) -> DataFrame:
    """Grams that occur exactly once in their witness. Frequent grams end in the map-side aggregate, before any join."""
    return grams(keys, n).groupBy("work_id", "siglum", "gram").agg(F.count(F.lit(1)).alias("times"), F.min("pos").alias("pos"), F.min("page").alias("page")).where("times = 1").drop("times")


def pins(unique: DataFrame, pairs: DataFrame) -> DataFrame:
    """(work_id, base, compared, gram, a_start, b_start, weight): landmarks of every pair, page-stable ones weigh 2."""
    a = unique.select("work_id", F.col("siglum").alias("base"), "gram", F.col("pos").alias("a_start"), F.col("page").alias("a_page"))
    b = unique.select("work_id", F.col("siglum").alias("compared"), "gram", F.col("pos").alias("b_start"), F.col("page").alias("b_page"))
    return pairs.select("work_id", "base", "compared").join(a, ["work_id", "base"]).join(b, ["work_id", "compared", "gram"]).select("work_id", "base", "compared", "gram", "a_start", "b_start", F.when(F.col("a_page") == F.col("b_page"), 2).otherwise(1).alias("weight"))


def plausible(pin: DataFrame) -> DataFrame:
    """Pins near the diagonal; needs ``len_a`` and ``len_b``."""
    expected = F.floor(F.col("a_start") * F.col("len_b") / F.col("len_a") + 0.5)
    reach = F.least(F.lit(LIMITS.max_move), F.greatest(F.lit(LIMITS.min_move), F.floor(F.greatest("len_a", "len_b") * LIMITS.move_fraction)))
    return pin.withColumn("deviation", F.abs(F.col("b_start") - expected).cast("int")).where(F.col("deviation") <= reach)


def density(keys: DataFrame) -> DataFrame:
    """(work_id, siglum, tokens, unique_tokens, density): share of comparable tokens whose key occurs once."""
    per_key = keys.groupBy("work_id", "siglum", "key").agg(F.count(F.lit(1)).alias("n"))
    sums = per_key.groupBy("work_id", "siglum").agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("unique_tokens"))
    return sums.withColumn("density", F.round(F.col("unique_tokens") / F.col("tokens"), 6))

"""What the variations of a pair amount to: counts, extent, clusters, quality, and the data behind each view.

All operators take *facts*: (pair, v_no, variation_type, base_reading, compared_reading, b_from, b_to, c_from, c_to,
base_len, compared_len, crosses_page, confidence), character offsets and lengths in UTF-16 units, and group by ``pair``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import insertion_key
from textloom.operators.collate import DELETION, INSERTION, MOVE, SPELLING, SUBSTITUTION, TYPES

# Parts of a work by name, types in plain words, and the views' numbers of buckets.
THIRDS = ("the opening third", "the middle third", "the final third")
PLAIN = {SUBSTITUTION: "substitution", INSERTION: "insertion", DELETION: "deletion", MOVE: "transposition (a moved passage)", SPELLING: "accidental (spelling/case)"}
HISTOGRAM, HEAT, HEAT_INSERTION, STORY, EXAMPLES = 80, 160, 6, 12, 6
DRIFT, MONOTONIC = 8.0, 98.0


def tallies(facts: DataFrame) -> DataFrame:
    """(pair, n_<type>…, n_variants): counts of each type, zeros included."""
    return facts.groupBy("pair").agg(*[F.count_if(F.col("variation_type") == t).alias("n_variant_spelling" if t == SPELLING else f"n_{t}") for t in TYPES], F.count(F.lit(1)).alias("n_variants"))


def dominant(facts: DataFrame) -> DataFrame:
    """(pair, dominant_type, dominant_n): the most frequent type; of equals the first of substitution, deletion, insertion, move."""
    order = F.create_map(*[F.lit(x) for pair in ((SUBSTITUTION, 0), (DELETION, 1), (INSERTION, 2), (MOVE, 3)) for x in pair])
    per = facts.where(F.col("variation_type") != SPELLING).groupBy("pair", "variation_type").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("pair").agg(F.max_by("variation_type", F.struct("n", -order[F.col("variation_type")])).alias("dominant_type"), F.max("n").alias("dominant_n"))


def extent(facts: DataFrame) -> DataFrame:
    """(pair, changed_chars, base_len, changed_pct): characters of the base under a reading; insertions have none."""
    chars = F.coalesce(F.sum(F.when(F.col("variation_type") != INSERTION, F.greatest(F.lit(0), F.col("b_to") - F.col("b_from")))), F.lit(0))
    return facts.groupBy("pair").agg(chars.alias("changed_chars"), F.max("base_len").alias("base_len")).withColumn("changed_pct", F.round(F.when(F.col("base_len") > 0, F.col("changed_chars") / F.col("base_len") * 100).otherwise(0.0), 6))


def thirds(facts: DataFrame) -> DataFrame:
    """(pair, first_third, middle_third, final_third, clustering): where the changed characters fall, by midpoints."""
    placed = facts.where((F.col("variation_type") != INSERTION) & F.col("b_from").isNotNull() & (F.col("base_len") > 0))
    part = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.floor((F.col("b_from") + F.col("b_to")) / 2) * 3 / F.col("base_len")))).cast("int")
    width = F.greatest(F.lit(1), F.col("b_to") - F.col("b_from"))
    names = ("first_third", "middle_third", "final_third")
    sums = placed.withColumn("part", part).withColumn("width", width).groupBy("pair").agg(*[F.sum(F.when(F.col("part") == k, F.col("width")).otherwise(0)).alias(n) for k, n in enumerate(names)])
    total = sum((F.col(n) for n in names), F.lit(0))
    shares = [F.col(n) / total for n in names]
    even = (F.least(*shares) > 0.25) & (F.greatest(*shares) < 0.42)
    best = F.greatest(*[F.struct(F.col(n).alias("n"), F.lit(-k).alias("k")) for k, n in enumerate(names)])
    return sums.withColumn("clustering", F.when(even, "even").when(best["n"] / total > 0.5, F.concat(F.lit("concentrated: "), F.element_at(F.array(*map(F.lit, names)), 1 - best["k"]))).otherwise("mostly two"))


def quality(facts: DataFrame) -> DataFrame:
    """(pair, points, drift_pct, monotonic_pct, sound): how evenly both texts run, over places known on both sides.

    Pairs with fewer than two such places have no verdict and no row.
    """
    point = facts.where("b_from IS NOT NULL AND c_from IS NOT NULL AND base_len > 0 AND compared_len > 0")
    w = Window.partitionBy("pair").orderBy("b_from", "v_no")
    off = F.abs(F.col("c_from") - F.col("b_from") / F.col("base_len") * F.col("compared_len")) / F.col("compared_len")
    each = point.withColumn("off", off).withColumn("in_step", F.col("c_from") >= F.lag("c_from").over(w))
    result = each.groupBy("pair").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("off") * 100, 6).alias("drift_pct"), F.round(F.count_if("in_step") / (F.count(F.lit(1)) - 1) * 100, 6).alias("monotonic_pct"))
    return result.where("points > 1").withColumn("sound", (F.col("drift_pct") <= DRIFT) & (F.col("monotonic_pct") >= MONOTONIC))


def _bucket(at: Column, buckets: int) -> Column:
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(at * buckets / F.col("base_len")))).cast("int")


def histogram(facts: DataFrame, buckets: int = HISTOGRAM) -> DataFrame:
    """(pair, bucket, variation_type, n): changes per equal stretch of the base."""
    return facts.where("b_from IS NOT NULL AND base_len > 0").groupBy("pair", _bucket(F.col("b_from"), buckets).alias("bucket"), "variation_type").agg(F.count(F.lit(1)).alias("n"))


def heat(facts: DataFrame, buckets: int = HEAT) -> DataFrame:
    """(pair, bucket, heat): changes weighted by their width over all stretches they touch; insertions weigh a constant."""
    held = facts.where("b_from IS NOT NULL AND base_len > 0")
    spread = held.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("b_from"), buckets), _bucket(F.greatest(F.col("b_from"), F.col("b_to") - 1), buckets))))
    weight = F.when(F.col("variation_type") == INSERTION, F.lit(HEAT_INSERTION)).otherwise(F.greatest(F.lit(1), F.col("b_to") - F.col("b_from")))
    return spread.groupBy("pair", "bucket").agg(F.sum(weight).alias("heat"))


def story(facts: DataFrame, segments: int = STORY, examples: int = EXAMPLES) -> DataFrame:
    """(pair, segment, n, example_no, v_no): counts per stretch of the base and its first ``examples`` changes."""
    held = facts.where("b_from IS NOT NULL AND base_len > 0").withColumn("segment", _bucket(F.col("b_from"), segments))
    each = Window.partitionBy("pair", "segment")
    return held.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("example_no", F.row_number().over(each.orderBy("b_from", "v_no"))).where(F.col("example_no") <= examples).select("pair", "segment", "n", "example_no", "v_no")


def redline(facts: DataFrame) -> DataFrame:
    """(pair, v_no): changes in reading order, without those that begin inside an earlier one."""
    held = facts.where("b_from IS NOT NULL")
    w = Window.partitionBy("pair").orderBy("b_from", "b_to", "v_no").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("cursor", F.coalesce(F.max("b_to").over(w), F.lit(-1))).where("b_from >= cursor").select("pair", "v_no")


def spans(facts: DataFrame) -> DataFrame:
    """(pair, at, to, v_no): the base cut at all bounds, each piece with the narrowest change that covers it.

    A change finds its first and last piece by its own bounds and is spread over the pieces between, no others.
    """
    held = facts.where("b_from IS NOT NULL AND b_to > b_from").select("pair", "v_no", "b_from", "b_to")
    bounds = held.select("pair", F.explode(F.array("b_from", "b_to")).alias("at")).distinct()
    line = Window.partitionBy("pair").orderBy("at")
    piece = bounds.select("pair", "at", F.lead("at").over(line).alias("to"), F.row_number().over(line).alias("n"))
    ends = [piece.select("pair", F.col("at").alias(c), F.col("n").alias(n)) for c, n in (("b_from", "lo"), ("b_to", "hi"))]
    cover = held.join(ends[0], ["pair", "b_from"]).join(ends[1], ["pair", "b_to"]).withColumn("n", F.explode(F.sequence("lo", F.col("hi") - 1)))
    narrowest = cover.groupBy("pair", "n").agg(F.min_by("v_no", F.struct(F.col("b_to") - F.col("b_from"), "v_no")).alias("v_no"))
    return narrowest.join(piece, ["pair", "n"]).select("pair", "at", "to", "v_no")


def moved_deviation(facts: DataFrame) -> DataFrame:
    """(pair, v_no, deviation): how far off the diagonal moves went, measured in characters."""
    held = facts.where((F.col("variation_type") == MOVE) & F.col("b_from").isNotNull() & F.col("c_from").isNotNull() & (F.col("base_len") > 0))
    expected = F.floor(F.col("b_from") * F.col("compared_len") / F.col("base_len") + 0.5)
    return held.select("pair", "v_no", F.abs(F.col("c_from") - expected).cast("int").alias("deviation"))


def displaced(variation: DataFrame) -> DataFrame:
    """(pair_id, word, deleted_in, inserted_in): words deleted once and inserted once in a pair, candidates of moves."""
    v = variation.where("NOT within_transposition")
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))
    gone = v.where(F.col("variation_type") == DELETION).select("pair_id", "variation_id", words(F.col("base_reading")).alias("word"))
    come = v.where(F.col("variation_type") == INSERTION).select("pair_id", "variation_id", words(F.col("compared_reading")).alias("word"))
    once = lambda x, name: x.groupBy("pair_id", "word").agg(F.count(F.lit(1)).alias("n"), F.max("variation_id").alias(name)).where("n = 1").drop("n")
    return once(gone, "deleted_in").join(once(come, "inserted_in"), ["pair_id", "word"])


def shared_insertions(variation: DataFrame) -> DataFrame:
    """(case_id, reading, pairs, n): insertions that read alike within a case, with the pairs that hold them."""
    v = variation.where((F.col("variation_type") == INSERTION) & F.col("compared_reading").isNotNull())
    return v.groupBy("case_id", insertion_key(F.col("compared_reading")).alias("reading")).agg(F.array_sort(F.collect_set("pair_id")).alias("pairs"), F.count(F.lit(1)).alias("n"))


def cross_page(variation: DataFrame) -> DataFrame:
    """Variations whose sides stand on different pages."""
    return variation.where("base_location.page <> compared_location.page").select("variation_id", F.col("base_location.page").alias("base_page"), F.col("compared_location.page").alias("compared_page"))


def perspective(variation: DataFrame) -> DataFrame:
    """(case_id, siglum, variation_type, n): variations that each witness takes part in, per type."""
    seen = variation.select("case_id", F.explode(F.array("base", "compared")).alias("siglum"), "variation_type")
    return seen.groupBy("case_id", "siglum", "variation_type").agg(F.count(F.lit(1)).alias("n"))

"""The data behind a viewer of a collation: what was found, sizes, the graph in compact form, and its lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import SUBSTANTIVE, Normalizer, Pagination
from textloom.functions.text import utf16_len
from textloom.operators.collate import INSERTION, SPELLING, TYPES, first_witness
from textloom.operators.lexer import tokens


STRETCH = 256  # characters of the base in which places and changes meet


def type_counts(witness: DataFrame, variation: DataFrame) -> DataFrame:
    """(work_id, witnesses, chars, n_<type>…): witnesses and changes of every work, types that weren't found included."""
    size = witness.groupBy("work_id").agg(F.count(F.lit(1)).alias("witnesses"), F.sum(F.coalesce(utf16_len(F.col("text")), F.lit(0))).cast("long").alias("chars"))
    counts = variation.groupBy("work_id").agg(*[F.count_if(F.col("variation_type") == t).alias("n_variant_spelling" if t == SPELLING else f"n_{t}") for t in TYPES])
    return size.join(counts, "work_id", "left").na.fill(0)


def sizes(witness: DataFrame, normalizer: Normalizer = SUBSTANTIVE, pagination: Pagination = Pagination()) -> DataFrame:
    """(work_id, siglum, chars, tokens): UTF-16 length and comparable tokens of every witness, null texts counting 0."""
    counted = tokens(witness, normalizer, pagination).groupBy("work_id", "siglum").agg(F.count("cidx").alias("tokens"))
    held = witness.select("work_id", "siglum", F.coalesce(utf16_len(F.col("text")), F.lit(0)).cast("int").alias("chars"))
    return held.join(counted, ["work_id", "siglum"], "left").na.fill(0, ["tokens"])


def graph_counts(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """(work_id, spine_length, variant_nodes, inserted_nodes, move_edges)."""
    shape = nodes.groupBy("work_id").agg(F.count_if(F.col("base_position") >= 0).alias("spine_length"), F.count_if(F.size("readings") > 1).alias("variant_nodes"), F.count_if(F.col("base_position") < 0).alias("inserted_nodes"))
    return shape.join(moves.groupBy("work_id").agg(F.count(F.lit(1)).alias("move_edges")), "work_id", "left").na.fill(0, ["move_edges"])


def compact(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(work_id, id, is_inserted, inserted_after_col, from, to, agree, readings): a node as a viewer draws it.

    Where all agree one surface stands for all readings. ``places`` is (work_id, base_position, char_from, char_to) of the
    base's tokens. An inserted node tells the column of the spine that it follows, -1 before all.
    """
    inserted = F.col("base_position") < 0
    column = nodes.where("base_position >= 0").select("work_id", F.col("base_position").alias("inserted_after"), F.col("node_id").alias("_col"))  # nodes of the spine are numbered by column
    surfaces = F.array_sort(F.array_distinct(F.transform("readings", lambda r: r["surface"])))
    carriers = lambda s: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("readings", lambda r: r["surface"] == s), lambda r: r["sigla"]))))
    alone = ~inserted & (F.size("readings") == 1)
    told = nodes.join(column, ["work_id", "inserted_after"], "left").join(places, ["work_id", "base_position"], "left")
    return told.select(
        "work_id", F.col("node_id").alias("id"), inserted.alias("is_inserted"), F.when(inserted, F.coalesce("_col", F.lit(-1))).alias("inserted_after_col"), F.col("char_from").alias("from"), F.col("char_to").alias("to"),
        F.when(alone, F.col("readings")[0]["surface"]).alias("agree"), F.when(~alone, F.transform(surfaces, lambda s: F.struct(s.alias("reading"), carriers(s).alias("sigla")))).alias("readings"),
    )


def asked(facts: DataFrame) -> DataFrame:
    """(pair, place, lo, hi): the places in the base that changes stand at."""
    return facts.where("b_from IS NOT NULL").select("pair", F.col("v_no").alias("place"), F.col("b_from").alias("lo"), F.coalesce("b_to", "b_from").alias("hi"))


def covering(places: DataFrame, facts: DataFrame) -> DataFrame:
    """(pair, place, v_no): of every place the first change that covers it and has a side in the compared text.

    Changes and places meet in stretches of ``STRETCH`` characters of the base, a place in the one where it begins and a
    change in all that it touches, so no pair multiplies all of its places with all of its changes.
    """
    held = facts.where("b_from IS NOT NULL AND c_from IS NOT NULL").select("pair", "v_no", "b_from", F.coalesce("b_to", "b_from").alias("b_to"))
    stretch = lambda c: F.floor(c / STRETCH)
    spread = held.withColumn("_s", F.explode(F.sequence(stretch(F.col("b_from")), F.greatest(stretch(F.col("b_from")), stretch(F.col("b_to"))))))
    met = places.withColumn("_s", stretch(F.col("lo"))).join(spread, ["pair", "_s"]).where("b_from <= lo AND hi <= b_to")
    return met.groupBy("pair", "place").agg(F.min("v_no").alias("v_no"))


def insertion_mates(nodes: DataFrame, annotation: DataFrame) -> DataFrame:
    """(work_id, node, v_no, by_reading): the first insertion by one of a node's witnesses that reads as the node does.

    Without one, the first insertion by any of them. ``nodes`` is (work_id, node, sigla, surfaces), ``annotation`` is
    (work_id, v_no, witness, variation_type, reading).
    """
    held = annotation.where(F.col("variation_type") == INSERTION)
    carried = nodes.select("work_id", "node", F.explode("sigla").alias("witness"), "surfaces")
    read = carried.withColumn("reading", F.explode("surfaces")).join(held.groupBy("work_id", "witness", "reading").agg(F.min("v_no").alias("v_no")), ["work_id", "witness", "reading"])
    own = read.groupBy("work_id", "node").agg(F.min("v_no").alias("own"))
    some = carried.join(held.groupBy("work_id", "witness").agg(F.min("v_no").alias("v_no")), ["work_id", "witness"]).groupBy("work_id", "node").agg(F.min("v_no").alias("other"))
    return some.join(own, ["work_id", "node"], "left").select("work_id", "node", F.coalesce("own", "other").alias("v_no"), F.col("own").isNotNull().alias("by_reading"))


def apparatus_places(entries: DataFrame, places: DataFrame) -> DataFrame:
    """Apparatus entries with the characters of the base that they stand at, null for those before all text."""
    return entries.join(places.withColumnsRenamed({"base_position": "position", "char_from": "from", "char_to": "to"}), ["work_id", "position"], "left")


def annotations(variation: DataFrame, places: DataFrame) -> DataFrame:
    """Changes against the base as a viewer marks them; an insertion tells the character of the base that it follows."""
    side = lambda name: F.struct(F.col(f"{name}_location.char_from").alias("from"), F.col(f"{name}_location.char_to").alias("to"), F.col(f"{name}_location.cite").alias("cite"), F.col(f"{name}_reading").alias("reading"))
    anchor = F.when(F.col("variation_type") == INSERTION, F.when(F.col("insertion_anchor") < 0, 0).otherwise(F.col("char_to")))
    told = variation.join(places.withColumnRenamed("base_position", "insertion_anchor"), ["work_id", "insertion_anchor"], "left")
    return told.select("work_id", F.col("compared").alias("witness"), "v_no", F.col("variation_type").alias("type"), "confidence", F.col("within_transposition").alias("withinMove"), side("base").alias("base"), side("compared").alias("comp"), anchor.alias("baseAnchor"))


def base_places(witness: DataFrame, normalizer: Normalizer = SUBSTANTIVE, pagination: Pagination = Pagination()) -> DataFrame:
    """(work_id, base_position, char_from, char_to) of all tokens of each work's base."""
    first = Window.partitionBy("work_id").orderBy("ordinal", "siglum")
    base = witness.join(first_witness(witness).withColumnRenamed("base", "siglum"), ["work_id", "siglum"], "left_semi")
    return tokens(base, normalizer, pagination).select("work_id", F.col("tok").alias("base_position"), "char_from", "char_to")

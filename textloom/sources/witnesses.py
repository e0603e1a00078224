"""Where witnesses and lexicons come from: folders, files, tables, and the checks made on them."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.config import Config, Pagination, normalizer, strategy

SCHEMA = "work_id string, siglum string, ordinal int, text string"


class WitnessError(ValueError):
    """The witnesses asked for can't be collated."""


class LexiconError(ValueError):
    """A lexicon says nothing."""


def from_memory(spark: SparkSession, witnesses: Sequence[tuple[str, str]], work_id: str = "work") -> DataFrame:
    return spark.createDataFrame([(work_id, s, i, t) for i, (s, t) in enumerate(witnesses)], SCHEMA)


def from_files(spark: SparkSession, paths: Sequence[str], work_id: str = "work") -> DataFrame:
    """Files in the order given, the first the base; siglum = name without extension; line ends stay as they are."""
    paths = [os.path.expanduser(p) for p in paths]
    rank = spark.createDataFrame([(os.path.basename(p), i) for i, p in enumerate(paths)], "name string, ordinal int")
    return _read(spark, paths, work_id).join(F.broadcast(rank), "name").select("work_id", "siglum", "ordinal", "text")  # as many rows as paths given


def from_directory(spark: SparkSession, path: str, work_id: str = "work") -> DataFrame:
    """The .txt and .md files of a folder (not below it), by name."""
    order = Window.partitionBy("work_id").orderBy("name")
    return _read(spark, [os.path.expanduser(path)], work_id).where(F.lower("name").rlike(r"\.(txt|md)$")).withColumn("ordinal", (F.row_number().over(order) - 1)).select("work_id", "siglum", "ordinal", "text")


def _read(spark: SparkSession, paths: Sequence[str], work_id: str) -> DataFrame:
    read = spark.read.format("binaryFile").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    text = F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "name")))
    return read.select(F.lit(work_id).alias("work_id"), F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("name"), F.regexp_replace(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "").alias("siglum"), text.alias("text"))


def ordered(witness: DataFrame, sigla: Sequence[str]) -> DataFrame:
    """Only these sigla, in this order; a siglum that doesn't exist is an error."""
    rank = witness.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sigla)], "siglum string, _rank int")
    missing = [r["siglum"] for r in rank.join(witness, "siglum", "left_anti").collect()]  # at most as many as asked for
    if missing:
        raise WitnessError(f"unknown witness: {', '.join(sorted(missing))}")
    return witness.join(F.broadcast(rank), "siglum").select("work_id", "siglum", F.col("_rank").alias("ordinal"), "text")


def promoted(witness: DataFrame, base: str) -> DataFrame:
    """``base`` first, the others as they were."""
    order = Window.partitionBy("work_id").orderBy(F.when(F.col("siglum") == base, 0).otherwise(1), "ordinal", "siglum")
    return witness.withColumn("ordinal", F.row_number().over(order) - 1)


def checked(witness: DataFrame) -> DataFrame:
    """Raises for works with fewer than two witnesses or with one siglum twice."""
    bad = witness.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("siglum").alias("d")).where("n < 2 OR d < n").limit(1).collect()
    if bad:
        raise WitnessError(f"work {bad[0]['work_id']}: needs two witnesses or more, each with its own siglum")
    return witness


def from_table(witness: DataFrame, monolingual: DataFrame | None = None) -> DataFrame:
    """(work_id, siglum, ordinal, text) from the ``witness`` table, each witness once, works being cases.

    A siglum used twice in a case keeps the earlier witness; ``monolingual(case_id)`` restricts the cases.
    """
    held = witness.where("case_id IS NOT NULL AND siglum IS NOT NULL").select("case_id", "siglum", "ordinal", "witness_id", "text")
    held = held if monolingual is None else held.join(monolingual, "case_id", "left_semi")
    first = held.groupBy("case_id", "siglum").agg(F.min(F.struct("ordinal", "witness_id", "text")).alias("w"))
    return first.select(F.col("case_id").alias("work_id"), "siglum", F.col("w.ordinal").alias("ordinal"), F.col("w.text").alias("text"))


def from_case(spark: SparkSession, folder: str) -> tuple[DataFrame, Config, DataFrame | None]:
    """(witnesses, settings, lexicon) of a case folder: ``meta.json`` and a text file per siglum of its ``witnessOrder``."""
    meta = json.loads(Path(folder, "meta.json").read_text(encoding="utf-8"))
    told = meta.get("pagination", "default")
    pages = Pagination(lines_per_page=told["linesPerPage"]) if isinstance(told, dict) else Pagination(continuous=told == "throughNumbered")
    config = Config(normalizer(meta.get("normalizer")), pages, record_accidentals=bool(meta.get("recordAccidentals")), record_punctuation=bool(meta.get("recordPunctuation")), strategy=strategy(meta.get("strategy")))
    groups = [(n, form) for n, forms in enumerate(meta.get("lexicon") or ()) for form in forms]
    texts = [(s, Path(folder, f"{s}.txt").read_bytes().decode("utf-8")) for s in meta["witnessOrder"]]
    return from_memory(spark, texts, Path(folder).name), config, lexicon(spark.createDataFrame(groups, "grp int, form string")) if groups else None


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon of a file; unreadable files and files without any group of two forms are errors."""
    path = os.path.expanduser(path)
    if not os.path.isfile(path):
        raise OSError(f"cannot read the lexicon {path}")
    table = lexicon(lexicon_lines(spark, path))
    if table.isEmpty():
        raise LexiconError(f"{path} holds no groups (one group per line, forms separated by commas)")
    return table


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    """(grp, form): one group per line, comma-separated, ``#`` begins a comment."""
    lines = spark.read.text(os.path.expanduser(path)).withColumn("line", F.regexp_replace(F.element_at(F.split("value", "#"), 1), "\r", "")).withColumn("forms", F.split("line", ","))
    grouped = lines.select(F.xxhash64("forms").alias("grp"), "forms").distinct()  # equal lines are one group
    return grouped.select("grp", F.explode("forms").alias("form"))


def lexicon(groups: DataFrame) -> DataFrame:
    """(form, pivot) from (grp, form): forms trimmed, in lower case; groups of one form are dropped; pivot = least form.

    A form of several groups belongs to the one whose pivot is least.
    """
    forms = groups.where("form IS NOT NULL").select("grp", F.lower(F.trim("form")).alias("form")).where("form <> ''").distinct()
    pivots = forms.groupBy("grp").agg(F.min("form").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "pivot")
    return forms.join(pivots, "grp").groupBy("form").agg(F.min("pivot").alias("pivot"))


def parse_selection(text: str, count: int) -> list[int]:
    """"all", or one-based numbers in any order; those out of range are ignored."""
    if text.strip().lower() == "all":
        return list(range(count))
    found = [int(x) - 1 for x in text.replace(",", " ").split() if x.isdigit()]
    return [x for x in dict.fromkeys(found) if 0 <= x < count]

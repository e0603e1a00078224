"""Pairwise collation: witnesses to located variations.

The witnesses of a work stream through a task in their order, and one Arrow stage makes located variations of them: it
reads each text once, aligns it with the one before it (or with the base), classifies what differs and recovers displaced
words (``pairing``). Texts are exchanged once, tokens never. Works of many witnesses are dealt over several tasks; the
witness that two tasks need is sent to both.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.arrow import arrow_rows
from textloom.config import Config
from textloom.operators import pairing
from textloom.operators.lexer import SETTINGS, read, tokens
from textloom.operators.pairing import DELETION, INSERTION, MOVE, SPELLING, SUBSTITUTION, TYPES
from textloom.session import cut, dealt, find_package

__all__ = ["DELETION", "INSERTION", "MOVE", "SPELLING", "SUBSTITUTION", "TYPES"]

BY = ["work_id", "base", "compared"]
PER_TASK = 1000  # witnesses of a work in one task
STEP = 1000  # ordinals of a work whose order is found in one task
SENT_WORKS = 100_000  # works of more witnesses that are told to every task; a longer list is joined
FORMS = 1_000_000  # rows of a lexicon that is sent to every task; a larger one is joined
RANGE = "struct<tok_from:int,tok_to:int>"
PLACE = "struct<page:int,line:int,end_line:int,first_word:int,last_word:int,char_from:int,char_to:int,cite:string>"
PUT = "array<struct<pos:int,normalized:string,surface:string>>"
SCHEMA = (
    "work_id {kind}, base string, compared string, v_no int, variation_type string, base_reading string, compared_reading string, "
    f"base_tokens {RANGE}, compared_tokens {RANGE}, base_location {PLACE}, compared_location {PLACE}, "
    "crosses_page boolean, within_transposition boolean, confidence string, insertion_anchor int"
)


def pivoted(token: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Tokens with the ``key`` they are compared by: the pivot of a translation group, else the normal form."""
    if lexicon is None:
        return token.withColumn("key", F.col("normalized"))
    table = lexicon.select(F.col("form").alias("_form"), F.col("pivot").alias("_pivot"))
    return token.join(table, F.lower("normalized") == F.col("_form"), "left").withColumn("key", F.coalesce("_pivot", "normalized")).drop("_form", "_pivot")


def successive_pairs(witness: DataFrame) -> DataFrame:
    """(work_id, base, compared): every witness with the one before it in the work's order.

    The order is found within stretches of ``STEP`` ordinals, and the first of a stretch follows the last of the stretch
    before, so that a work of very many witnesses isn't ordered in one task.
    """
    held = witness.select("work_id", "siglum", "ordinal", F.floor(F.coalesce("ordinal", F.lit(-STEP)) / STEP).alias("_step"))
    within = Window.partitionBy("work_id", "_step").orderBy("ordinal", "siglum")
    over = Window.partitionBy("work_id").orderBy("_step")
    ends = held.groupBy("work_id", "_step").agg(F.max_by("siglum", F.struct("ordinal", "siglum")).alias("_last"))
    ends = ends.select("work_id", "_step", F.lag("_last").over(over).alias("_before"))
    pairs = held.withColumn("base", F.lag("siglum").over(within)).join(ends, ["work_id", "_step"])
    return pairs.select("work_id", F.coalesce("base", "_before").alias("base"), F.col("siglum").alias("compared")).where("base IS NOT NULL")


def first_witness(witness: DataFrame) -> DataFrame:
    """(work_id, base): the first witness of each work."""
    return witness.groupBy("work_id").agg(F.min(F.struct("ordinal", "siglum")).alias("_first")).select("work_id", F.col("_first.siglum").alias("base"))


def base_pairs(witness: DataFrame) -> DataFrame:
    """(work_id, base, compared): every further witness with the first of its work."""
    return witness.select("work_id", F.col("siglum").alias("compared")).join(first_witness(witness), "work_id").where("base <> compared").select(*BY)


PREVIOUS, BASE = "previous", "base"


def streams(witness: DataFrame, against: str, *more: str, per_task: int = PER_TASK) -> DataFrame:
    """Witnesses as tasks take them: (work_id, part, repeated, siglum, text, …), parts together and in the work's order.

    A work of at most ``per_task`` witnesses is one part. Larger works are dealt over parts, by stretches of ordinals
    where each witness follows the one before, by hash where all follow the base; the witness that a part begins with
    is ``repeated`` in it.
    """
    held = witness.select("work_id", "siglum", "ordinal", "text", *more)
    large = cut(witness.groupBy("work_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("ordinal", "siglum"))["siglum"].alias("_base")).where(F.col("_n") > per_task))
    works = large.count()
    none = F.lit(False)
    if not works:
        told = held.withColumns({"part": F.lit(0).cast("long"), "repeated": none})
    else:
        known = F.broadcast(large) if works <= SENT_WORKS else large
        rows = held.join(known, "work_id", "left")
        if against == BASE:
            parts = F.ceil(F.col("_n") / per_task)
            own = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("siglum"), parts)).cast("long")
            first = F.coalesce(F.col("siglum") == F.col("_base"), none)
            every = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(p.alias("part"), (p > 0).alias("repeated")))
            placed = F.when(first, every).otherwise(F.array(F.struct(own.alias("part"), none.alias("repeated"))))
            told = rows.withColumn("_p", F.explode(placed)).withColumns({"part": F.col("_p.part"), "repeated": F.col("_p.repeated")})
        else:
            step = F.floor(F.coalesce("ordinal", F.lit(-1)) / per_task)
            told = rows.withColumns({"part": F.when(F.col("_n").isNull(), F.lit(0)).otherwise(step).cast("long"), "repeated": none})
            ends = told.where("_n IS NOT NULL").groupBy("work_id", "part").agg(F.max_by("siglum", F.struct("ordinal", "siglum")).alias("siglum"))
            ends = ends.select("work_id", "siglum", F.lead("part").over(Window.partitionBy("work_id").orderBy("part")).alias("part")).where("part IS NOT NULL")
            again = held.join(ends, ["work_id", "siglum"]).withColumns({"repeated": F.lit(True)})
            told = told.unionByName(again, allowMissingColumns=True)
    columns = ["work_id", "part", "repeated", "siglum", "ordinal", "text", *more]
    return dealt(told.select(*columns), "work_id", "part").sortWithinPartitions("work_id", "part", F.desc("repeated"), "ordinal", "siglum").drop("ordinal")


def sent_pivots(witness: DataFrame, lexicon: DataFrame | None, config: Config) -> tuple[dict[str, str] | None, DataFrame]:
    """(pivots to send, witnesses): a lexicon of at most ``FORMS`` rows is sent to every task.

    Of a larger one every witness gets the entries of its own words by a join, in the column ``pivots``.
    """
    if lexicon is None:
        return {}, witness
    rows = lexicon.select("form", "pivot").limit(FORMS + 1).collect()
    if len(rows) <= FORMS:
        return {r["form"]: r["pivot"] for r in rows}, witness
    word = tokens(witness, config.normalizer, config.pagination).where("cidx IS NOT NULL").select("work_id", "siglum", F.lower("normalized").alias("form")).distinct()
    own = word.join(lexicon, "form").groupBy("work_id", "siglum").agg(F.map_from_entries(F.collect_list(F.struct("form", "pivot"))).alias("pivots"))
    return None, witness.join(own, ["work_id", "siglum"], "left")


def variations(witness: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None, against: str = PREVIOUS, by_row: bool = False, put: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """Located variations of every witness and the one before it, or the base of its work, numbered ``v_no`` in their order.

    ``witness`` is (work_id, siglum, ordinal, text), (work_id, siglum) unique. Null texts count as empty; an empty
    witness gives one insertion or deletion of the other's whole text; equal witnesses give no row; of equal ordinals
    the lesser siglum comes first. ``by_row`` takes the settings from columns (``by_case``). ``put`` adds the tokens that
    a substitution puts in place, and a row without a type for each base, with its comparable tokens. Extra columns are
    dropped.
    """
    find_package(witness.sparkSession)
    pivots, witness = sent_pivots(witness, lexicon, config)
    more = [*(["pivots"] if pivots is None else []), *([*SETTINGS, "record_accidentals", "record_punctuation"] if by_row else [])]
    sent = witness.sparkSession.sparkContext.broadcast(pivots)  # at most FORMS rows

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        place, before, x = None, None, None
        for r in rows:
            y = read(r, r["text"], config.normalizer, config.pagination, by_row)
            if place != (r["work_id"], r["part"]):
                place, before, x = (r["work_id"], r["part"]), r, y
                if put and not r["repeated"]:
                    at = pairing.comparable(y)
                    yield (*[r["work_id"], r["siglum"]], *[None] * 13, list(zip(at, [y.normalized[i] for i in at], [y.surface[i] for i in at])))
                continue
            known = sent.value if sent.value is not None else dict([*(before["pivots"] or ()), *(r["pivots"] or ())])
            flag = lambda name, own: bool(before[name] or r[name]) if by_row else own
            found = pairing.variations(x, y, config, known, flag("record_accidentals", config.record_accidentals), flag("record_punctuation", config.record_punctuation))
            for n, v in enumerate(found, 1):
                a, b = pairing.place(x, v.a_lo, v.a_hi), pairing.place(y, v.b_lo, v.b_hi)
                reads = v.shown or (" ".join(x.surface[v.a_lo : v.a_hi]) if a else "", " ".join(y.surface[v.b_lo : v.b_hi]) if b else "")
                told = (
                    r["work_id"], before["siglum"], r["siglum"], n, v.kind, *reads, (v.a_lo, v.a_hi) if a else None, (v.b_lo, v.b_hi) if b else None, a, b,
                    bool(a and b and a[0] != b[0]), v.within, "certain" if v.certain else "likely", v.anchor,
                )
                if put:
                    span = range(v.b_lo, v.b_hi) if v.kind == SUBSTITUTION else ()
                    told = (*told, list(zip(span, (y.normalized[i] for i in span), (y.surface[i] for i in span))))
                yield told
            if against == PREVIOUS:
                before, x = r, y

    schema = SCHEMA.format(kind=witness.schema["work_id"].dataType.simpleString()) + (f", put {PUT}" if put else "")
    return arrow_rows(streams(witness, against, *more, per_task=per_task), run, schema)


def by_case(witness: DataFrame) -> DataFrame:
    """Variations of successive witnesses, every work by its own settings.

    ``witness`` has, besides the usual columns, ``normalizer``, ``lines_per_page``, ``continuous``,
    ``record_accidentals`` and ``record_punctuation``; the same for all witnesses of a work, nulls standing for defaults.
    """
    return variations(witness, by_row=True)


def tallies(pairs: DataFrame, variation: DataFrame) -> DataFrame:
    """Counts of each type for every pair, pairs without variations included."""
    counts = variation.groupBy(*BY).agg(*[F.count_if(F.col("variation_type") == t).alias(f"n_{_snake(t)}") for t in TYPES])
    return pairs.select(*BY).join(counts, BY, "left").na.fill(0)


def _snake(name: str) -> str:
    return "variant_spelling" if name == SPELLING else name

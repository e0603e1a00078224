"""Apparatus, synopsis, report, narrative and interchange, rendered by expressions over the results."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import OMITTED, csv_quote, percent, shown
from textloom.operators import metrics
from textloom.operators.collate import DELETION, INSERTION, MOVE, SPELLING, SUBSTITUTION, first_witness, successive_pairs

# How reports name the types, and the columns of the CSV form.
LABELS = {INSERTION: "INSERTION", DELETION: "DELETION", SUBSTITUTION: "SUBSTITUTION", MOVE: "TRANSPOSITION (moved)", SPELLING: "ACCIDENTAL (spelling/case)"}
CSV = ("pair_base", "pair_compared", "type", "confidence", "base_reading", "compared_reading", "base_cite", "compared_cite", "crosses_page")


def _named(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def pairwise_apparatus(variation: DataFrame) -> DataFrame:
    """(…, position, base_position, lemma, type, reading, sigla): one entry per variation.

    ``position`` is the base's first token, else the compared one's, else 0; ``base_position`` is null where the base
    has nothing.
    """
    position = F.coalesce("base_tokens.tok_from", "compared_tokens.tok_from", F.lit(0))
    return variation.select("work_id", "base", "compared", "v_no", position.alias("position"), F.col("base_tokens.tok_from").alias("base_position"), shown(F.col("base_reading")).alias("lemma"), F.col("variation_type").alias("type"), shown(F.col("compared_reading")).alias("reading"), F.array("compared").alias("sigla"))


def apparatus(graph: DataFrame, base: DataFrame) -> DataFrame:
    """(work_id, node_no, position, lemma, type, variants): variant nodes of ``graph`` with the base's reading as lemma."""
    joined = graph.where("is_variant").join(base, "work_id")
    own = F.get(F.filter("readings", lambda r: F.array_contains(r["witnesses"], F.col("base"))), F.lit(0))["reading"]
    most = F.get(F.sort_array(F.transform("readings", lambda r: F.struct(-F.size(r["witnesses"]), r["reading"].alias("reading")))), F.lit(0))["reading"]
    inserted = F.col("inserted_after").isNotNull()
    lemma = F.coalesce(own, F.when(inserted, OMITTED).otherwise(most))
    rows = joined.withColumn("lemma", lemma)
    return rows.select("work_id", "node_no", F.coalesce("inserted_after", "base_position").alias("position"), "lemma", F.when(inserted, INSERTION).otherwise(SUBSTITUTION).alias("type"), F.filter("readings", lambda r: r["reading"] != F.col("lemma")).alias("variants"))


def apparatus_text(entries: DataFrame) -> DataFrame:
    """(work_id, line_no, line): ``<position> <lemma>] <reading> <sigla>; …``."""
    right = F.array_join(F.transform("variants", lambda r: F.trim(F.concat_ws(" ", r["reading"], F.array_join(r["witnesses"], " ")))), "; ")
    order = Window.partitionBy("work_id").orderBy("position", "node_no")
    return entries.select("work_id", F.row_number().over(order).alias("line_no"), F.concat(F.col("position").cast("string"), F.lit(" "), "lemma", F.lit("] "), right).alias("line"))


def synopsis(graph: DataFrame, order: DataFrame) -> DataFrame:
    """(work_id, node_no, position, cells): what every witness of ``order(work_id, sigla)`` reads, omissions filled in."""
    joined = graph.join(order, "work_id")
    read = lambda w: F.get(F.filter("readings", lambda r: F.array_contains(r["witnesses"], w)), F.lit(0))["reading"]
    cells = F.transform("sigla", lambda w: F.struct(w.alias("siglum"), F.coalesce(read(w), F.lit(OMITTED)).alias("reading")))
    return joined.select("work_id", "node_no", F.coalesce("inserted_after", "base_position").alias("position"), cells.alias("cells"))


def synopsis_text(table: DataFrame, width: int = 14) -> DataFrame:
    """(work_id, node_no, line): cells cut or padded to ``width``, joined by bars."""
    cell = lambda s: F.rpad(F.when(F.char_length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s), width, " ")
    return table.select("work_id", "node_no", F.array_join(F.transform("cells", lambda c: cell(c["reading"])), "| ").alias("line"))


def report(variation: DataFrame) -> DataFrame:
    """(…, v_no, text): located entries as a scholar reads them."""
    tags = F.concat(
        F.when(F.col("crosses_page"), "  (ACROSS PAGES)").otherwise(""),
        F.when(F.col("within_transposition"), "  (within a moved passage)").otherwise(""),
        F.when((F.col("variation_type") == MOVE) & (F.col("confidence") == "likely"), "  (POSSIBLE move)").otherwise(""),
    )
    quoted = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "∅ (omitted)").otherwise(F.concat(F.lit("“"), c, F.lit("”")))
    place = lambda c: F.coalesce(c["cite"], F.lit("—"))
    line = lambda who, text, where: F.concat(F.lit("\n      "), who, F.lit(": "), quoted(text), F.lit(" @ "), place(where))
    head = F.concat(F.lit("  ["), F.col("v_no").cast("string"), F.lit("] "), _named(LABELS, F.col("variation_type")), tags)
    return variation.select("work_id", "base", "compared", "v_no", F.concat(head, line(F.col("base"), F.col("base_reading"), F.col("base_location")), line(F.col("compared"), F.col("compared_reading"), F.col("compared_location"))).alias("text"))


def csv_rows(variation: DataFrame) -> DataFrame:
    """The CSV form, one row per variation; write it with ``.write.csv(header=True)``."""
    return variation.select(
        F.col("base").alias("pair_base"), F.col("compared").alias("pair_compared"), F.col("variation_type").alias("type"), "confidence", "base_reading", "compared_reading",
        F.coalesce("base_location.cite", F.lit("")).alias("base_cite"), F.coalesce("compared_location.cite", F.lit("")).alias("compared_cite"), F.col("crosses_page").cast("string").alias("crosses_page"),
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_quote(F.col(c)) for c in CSV]).alias("line"))


def interchange(witness: DataFrame, variation: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """(work_id, json): successive pairs with counts and variations, and the graph, as sorted JSON without null fields.

    Pairs stand in the order of their witnesses; a pair without variations has an empty list.
    """
    span = lambda c: F.when(c.isNotNull(), F.struct(c["tok_from"].alias("from"), c["tok_to"].alias("to")))
    place = lambda c: F.when(c.isNotNull(), F.struct(c["char_from"].alias("charFrom"), c["char_to"].alias("charTo"), c["cite"].alias("cite"), c["end_line"].alias("endLine"), c["first_word"].alias("firstWord"), c["last_word"].alias("lastWord"), c["line"].alias("line"), c["page"].alias("page")))
    each = F.struct(
        place(F.col("base_location")).alias("baseLocation"), F.col("base_reading").alias("baseReading"), span(F.col("base_tokens")).alias("baseTokens"),
        place(F.col("compared_location")).alias("comparedLocation"), F.col("compared_reading").alias("comparedReading"), span(F.col("compared_tokens")).alias("comparedTokens"),
        F.col("confidence").alias("confidence"), F.col("crosses_page").alias("crossesPage"), F.col("variation_type").alias("type"), F.col("within_transposition").alias("withinTransposition"),
    )
    by = ["work_id", "base", "compared"]
    counts = [F.count_if(F.col("variation_type") == t).alias(t) for t in (DELETION, INSERTION, SUBSTITUTION, MOVE, SPELLING)]
    told = variation.groupBy(*by).agg(F.struct(*counts).alias("counts"), F.transform(F.array_sort(F.collect_list(F.struct("v_no", each.alias("v")))), lambda x: x["v"]).alias("variations"))
    none = F.struct(*[F.lit(0).cast("long").alias(t) for t in (DELETION, INSERTION, SUBSTITUTION, MOVE, SPELLING)])
    rank = witness.select("work_id", F.col("siglum").alias("compared"), "ordinal")
    every = successive_pairs(witness).join(rank, ["work_id", "compared"]).join(told, by, "left").withColumn("counts", F.coalesce("counts", none))
    pair = F.struct(F.col("base"), F.col("compared"), F.col("counts"), F.lit(3).alias("schemaVersion"), F.coalesce("variations", F.array().cast(told.schema["variations"].dataType)).alias("variations"))
    result = every.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "compared", pair.alias("p")))).alias("ps")).select("work_id", F.transform("ps", lambda x: x["p"]).alias("pairs"))
    if graph is None:
        return result.select("work_id", F.to_json(F.struct("pairs")).alias("json"))
    node = F.struct(F.col("base_position").alias("basePosition"), F.col("inserted_after").alias("insertedAfter"), F.col("is_variant").alias("isVariant"), F.col("readings"))
    nodes = graph.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_no", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    whole = F.struct(F.struct(F.col("base").alias("baseID"), F.col("nodes"), F.lit(3).alias("schemaVersion")).alias("graph"), F.col("pairs"))
    return result.join(nodes, "work_id").join(first_witness(witness), "work_id").select("work_id", F.to_json(whole).alias("json"))


def pretty(text: str) -> str:
    """JSON indented, keys sorted, a blank before colons, ``/`` escaped: the form in which runs are kept and compared."""
    laid = json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, indent=2, separators=(",", " : "))
    return re.sub(r"(?m)(^ *(?:\"[^\"]+\" : )?)\[\]", lambda m: f"{m[1]}[\n\n{' ' * (len(m[1]) - len(m[1].lstrip()))}]", laid).replace("/", "\\/")


def narrative(facts: DataFrame) -> DataFrame:
    """(pair, text): a summary of every pair with variations; numbers grouped as in English."""
    all_ = metrics.tallies(facts)
    for part in (metrics.dominant(facts), metrics.extent(facts), metrics.thirds(facts), metrics.quality(facts)):
        all_ = all_.join(part, "pair", "left")
    moves = facts.where(F.col("variation_type") == MOVE).groupBy("pair").agg(F.count_if("crosses_page").alias("across"), F.count_if(F.col("confidence") == "likely").alias("likely"))
    all_ = all_.join(moves, "pair", "left").join(facts.groupBy("pair").agg(F.max("compared_len").alias("compared_len")), "pair")
    number = lambda c: F.format_number(c, 0)
    many = lambda c, one, more: F.concat(number(c), F.lit(" "), F.when(c == 1, one).otherwise(more))
    share = lambda c: F.concat(F.floor(c / F.col("n_variants") * 100 + 0.5).cast("string"), F.lit("%"))
    n = F.col("n_variants")
    head = F.concat(F.lit("The compared text differs at "), many(n, "point", "points"), F.when(F.col("changed_pct") >= 0.05, F.concat(F.lit(", touching about "), percent(F.col("changed_pct")), F.lit(" of the base text."))).otherwise("."))
    parts = F.filter(
        F.array(
            F.when(F.col("n_substitution") > 0, F.concat(many(F.col("n_substitution"), "substitution", "substitutions"), F.lit(" ("), share(F.col("n_substitution")), F.lit(")"))),
            F.when(F.col("n_deletion") > 0, many(F.col("n_deletion"), "deletion", "deletions")),
            F.when(F.col("n_insertion") > 0, many(F.col("n_insertion"), "insertion", "insertions")),
            F.when(F.col("n_transposition") > 0, many(F.col("n_transposition"), "moved passage", "moved passages")),
        ),
        lambda x: x.isNotNull(),
    )
    size = F.size(parts)
    listed = F.when(size == 1, F.get(parts, F.lit(0))).when(size == 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "), F.lit(", and "), F.get(parts, size - 1)))
    make_up = F.when(size > 0, F.concat(F.lit("The dominant kind is "), _named(metrics.PLAIN, F.col("dominant_type")), F.lit(" ("), share(F.col("dominant_n")), F.lit("). In all: "), listed, F.lit(".")))
    moved = F.when(F.col("n_transposition") > 0, F.concat(number(F.col("n_transposition")), F.when(F.col("n_transposition") == 1, " passage was").otherwise(" passages were"), F.lit(" relocated"), F.when(F.col("across") > 0, F.concat(F.lit(" ("), number(F.col("across")), F.lit(" across a page boundary)"))).otherwise(""), F.when(F.col("likely") > 0, F.concat(F.lit("; "), number(F.col("likely")), F.lit(" of these are *possible* moves"))).otherwise(""), F.lit(".")))
    spelled = F.when(F.col("n_variant_spelling") > 0, F.concat(many(F.col("n_variant_spelling"), "accidental difference was", "accidental differences were"), F.lit(" also recorded.")))
    where = F.when(F.col("clustering") == "even", "The changes are spread fairly evenly across the whole work.").when(F.col("clustering").startswith("concentrated"), F.concat(F.lit("The changes concentrate in the "), F.regexp_replace(F.substring("clustering", 15, 40), "_", " "), F.lit(" of the work."))).when(F.col("clustering").isNotNull(), "The changes fall mostly in two thirds of the work.")
    trust = F.when(F.col("sound"), F.concat(F.lit("The alignment is sound: shared points stay within "), percent(F.col("drift_pct")), F.lit(" of the ideal diagonal and "), percent(F.col("monotonic_pct")), F.lit(" advance in step."))).when(~F.col("sound"), F.concat(F.lit("The alignment is worth checking: shared points lie up to "), percent(F.col("drift_pct")), F.lit(" off the ideal diagonal; "), percent(F.col("monotonic_pct")), F.lit(" monotonic.")))
    return all_.select("pair", F.concat_ws(" ", head, make_up, where, moved, spelled, trust).alias("text"))

"""The query registry of the core package: (session, data folder) -> DataFrame, and SQL for what SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import BASE_ANCHORED, DIPLOMATIC, GB_US, PEER_MSA, Config
from textloom.functions import text as T
from textloom.operators import anchors, collate, graph, lexer, metrics, render, viewer
from textloom.plans import sql
from textloom.session import cut, read_table
from textloom.sources import witnesses

Query = Callable[[SparkSession, str], DataFrame]


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses of the monolingual cases, each once; a table, as collation reads them more than once."""
    return cut(_cases(spark, d))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    mono = read_table(spark, d, "case_meta").where("lexicon_name IS NULL").select("case_id").distinct()
    return witnesses.from_table(read_table(spark, d, "witness"), mono)


def bilingual(spark: SparkSession, d: str) -> DataFrame:
    both = read_table(spark, d, "case_meta").where("lexicon_name IS NOT NULL").select("case_id").distinct()
    return cut(witnesses.from_table(read_table(spark, d, "witness"), both))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as witnesses of works of their own."""
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), F.lit("A").alias("siglum"), F.lit(0).alias("ordinal"), "text")


def keys(spark: SparkSession, d: str) -> DataFrame:
    return lexer.tokens(_cases(spark, d)).where("cidx IS NOT NULL").select("work_id", "siglum", "cidx", F.col("normalized").alias("key"), "page")


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    groups = read_table(spark, d, "lexicon").select(F.concat_ws("/", "lexicon_name", F.col("group_no").cast("string")).alias("grp"), "form")
    return witnesses.lexicon(groups)


def recorded(spark: SparkSession, d: str) -> DataFrame:
    """The variation table, each row once."""
    return read_table(spark, d, "variation").drop("ingested_at").dropDuplicates(["variation_id"])


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Recorded variations as the metrics take them; lengths come from the pair's witnesses."""
    length = witnesses.from_table(read_table(spark, d, "witness")).select(F.col("work_id").alias("case_id"), "siglum", T.utf16_len(F.col("text")).alias("len"))
    pair = read_table(spark, d, "pairwise").select("pair_id", "case_id", "base", "compared").dropDuplicates(["pair_id"])
    pair = pair.join(length.withColumnsRenamed({"siglum": "base", "len": "base_len"}), ["case_id", "base"], "left").join(length.withColumnsRenamed({"siglum": "compared", "len": "compared_len"}), ["case_id", "compared"], "left")
    v = recorded(spark, d).select(
        F.col("pair_id").alias("pair"), F.col("variation_id").alias("v_no"), "variation_type", "base_reading", "compared_reading", F.col("base_location.char_from").alias("b_from"), F.col("base_location.char_to").alias("b_to"),
        F.col("compared_location.char_from").alias("c_from"), F.col("compared_location.char_to").alias("c_to"), "crosses_page", "confidence",
    )
    return v.join(pair.select(F.col("pair_id").alias("pair"), "base_len", "compared_len"), "pair")


def as_results(spark: SparkSession, d: str) -> DataFrame:
    """Recorded variations in the shape of collation results, for the renderers."""
    pair = read_table(spark, d, "pairwise").select("pair_id", "base", "compared").dropDuplicates(["pair_id"])
    return recorded(spark, d).drop("work_id").join(pair, "pair_id").withColumnRenamed("pair_id", "work_id").withColumn("v_no", F.col("variation_id"))


# Lexing and normal forms


def token_words(spark: SparkSession, d: str) -> DataFrame:
    t = lexer.tokens(documents(spark, d), DIPLOMATIC).where("is_word")
    return t.groupBy(F.col("work_id").alias("doc_id"), "surface").agg(F.count(F.lit(1)).alias("n"))


def token_places(spark: SparkSession, d: str) -> DataFrame:
    t = lexer.tokens(documents(spark, d), DIPLOMATIC)
    return t.select(F.col("work_id").alias("doc_id"), "page", "line", "word_index", "surface")


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = lexer.tokens(documents(spark, d), DIPLOMATIC)
    return t.groupBy(F.col("work_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("char_to") - F.col("char_from")).cast("long").alias("chars"))


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    t = lexer.tokens(documents(spark, d), collate.Config().normalizer).where("is_word")
    return t.groupBy("surface", "normalized").agg(F.count(F.lit(1)).alias("n"))


def spelling_folds(spark: SparkSession, d: str) -> DataFrame:
    t = lexer.tokens(documents(spark, d), GB_US).where("is_word")
    return t.where(F.col("normalized") != T.strip_accents(F.lower("surface"))).groupBy(F.lower("surface").alias("surface"), "normalized").agg(F.count(F.lit(1)).alias("n"))


def comparable_tokens(spark: SparkSession, d: str) -> DataFrame:
    return lexer.tokens(documents(spark, d)).groupBy(F.col("work_id").alias("doc_id")).agg(F.count("cidx").alias("comparable"))


def key_frequency(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d).groupBy("work_id", "siglum", "key").agg(F.count(F.lit(1)).alias("n"))


# Pairs, landmarks, lexicons


def successive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return collate.successive_pairs(_cases(spark, d))


def base_pairs(spark: SparkSession, d: str) -> DataFrame:
    return collate.base_pairs(_cases(spark, d))


def promoted_order(spark: SparkSession, d: str) -> DataFrame:
    return witnesses.promoted(_cases(spark, d), "MS").select("work_id", "siglum", "ordinal")


def unique_grams(n: int) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return anchors.unique_grams(keys(spark, d), n).groupBy("work_id", "siglum").agg(F.count(F.lit(1)).alias("grams"), F.sum("pos").cast("long").alias("positions"))

    return query


def anchor_pins(spark: SparkSession, d: str) -> DataFrame:
    return anchors.pins(anchors.unique_grams(keys(spark, d), 3), collate.successive_pairs(_cases(spark, d))).select("work_id", "base", "compared", "a_start", "b_start", "weight")


def plausible_pins(spark: SparkSession, d: str) -> DataFrame:
    k = cut(keys(spark, d))
    sizes = k.groupBy("work_id", "siglum").agg(F.count(F.lit(1)).alias("n"))
    pin = anchors.pins(anchors.unique_grams(k, 3), collate.successive_pairs(_cases(spark, d)))
    pin = pin.join(sizes.withColumnsRenamed({"siglum": "base", "n": "len_a"}), ["work_id", "base"]).join(sizes.withColumnsRenamed({"siglum": "compared", "n": "len_b"}), ["work_id", "compared"])
    return anchors.plausible(pin).select("work_id", "base", "compared", "a_start", "b_start", "deviation")


def anchor_density(spark: SparkSession, d: str) -> DataFrame:
    return anchors.density(keys(spark, d))


def lexicon_pivots(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(spark, d)


def pivoted_keys(spark: SparkSession, d: str) -> DataFrame:
    t = collate.pivoted(lexer.tokens(bilingual(spark, d)).where("cidx IS NOT NULL"), lexicon(spark, d))
    return t.where("key <> normalized").groupBy("work_id", "siglum", "normalized", "key").agg(F.count(F.lit(1)).alias("n"))


# Recorded variations: counts, metrics, renderings


def of_facts(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: operator(facts(spark, d))


def pair_check(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose stored counts differ from the recorded variations."""
    names = ["insertion", "deletion", "substitution", "transposition", "variant_spelling"]
    stored = read_table(spark, d, "pairwise").dropDuplicates(["pair_id"]).select("pair_id", *[F.col(f"n_{n}").alias(f"stored_{n}") for n in names])
    counted = metrics.tallies(recorded(spark, d).withColumnRenamed("pair_id", "pair")).withColumnRenamed("pair", "pair_id").drop("n_variants")
    both = stored.join(counted, "pair_id", "left").na.fill(0, [f"n_{n}" for n in names])
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(f"stored_{n}") != F.col(f"n_{n}"))
    return both.where(differs)


def of_recorded(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: operator(recorded(spark, d))


def cites(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("base_location")
    made = T.cite(at["page"], at["line"], at["end_line"], at["first_word"], at["last_word"])
    return recorded(spark, d).where("base_location IS NOT NULL").select("variation_id", made.alias("cite"))


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.csv_rows(as_results(spark, d))


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.csv_lines(render.csv_rows(as_results(spark, d)).na.fill(""))


def pairwise_apparatus(spark: SparkSession, d: str) -> DataFrame:
    return render.pairwise_apparatus(as_results(spark, d)).select(F.col("v_no").alias("variation_id"), "position", "base_position", "lemma", "type", "reading")


def report_entries(spark: SparkSession, d: str) -> DataFrame:
    return render.report(as_results(spark, d)).select(F.col("v_no").alias("variation_id"), "text")


def narratives(spark: SparkSession, d: str) -> DataFrame:
    return render.narrative(cut(facts(spark, d)))


def perspective(spark: SparkSession, d: str) -> DataFrame:
    return metrics.perspective(as_results(spark, d))


def escaped(spark: SparkSession, d: str) -> DataFrame:
    return recorded(spark, d).where("base_reading IS NOT NULL").select("variation_id", T.escape_html(F.col("base_reading")).alias("html"))


# Collation of the witness table itself


def collate_variations(spark: SparkSession, d: str) -> DataFrame:
    return collate.variations(cases(spark, d))


def collate_cases(spark: SparkSession, d: str) -> DataFrame:
    """The monolingual cases, each by the settings that its row in ``case_meta`` names."""
    meta = read_table(spark, d, "case_meta").groupBy(F.col("case_id").alias("work_id")).agg(*[F.max(c).alias(c) for c in ("normalizer", "pagination", "record_accidentals", "record_punctuation")])
    lines = F.try_element_at(F.split("pagination", ":"), F.lit(2)).cast("int")
    settings = meta.select("work_id", "normalizer", "record_accidentals", "record_punctuation", F.when(F.col("pagination").startswith("linesPerPage"), lines).alias("lines_per_page"), (F.col("pagination") == "throughNumbered").alias("continuous"))
    return collate.by_case(cases(spark, d).join(settings, "work_id"))


def collate_accidentals(spark: SparkSession, d: str) -> DataFrame:
    return collate.variations(cases(spark, d), Config(record_accidentals=True, record_punctuation=True))


def collate_bilingual(spark: SparkSession, d: str) -> DataFrame:
    return collate.variations(bilingual(spark, d), Config(), lexicon(spark, d))


def collate_tallies(spark: SparkSession, d: str) -> DataFrame:
    w = cases(spark, d)
    return collate.tallies(collate.successive_pairs(w), collate.variations(w))


def variant_graph(strategy: str) -> Query:
    return lambda spark, d: graph.variant_graph(cases(spark, d), Config(strategy=strategy))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.base_edges(cases(spark, d))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = cases(spark, d)
    return w, cut(graph.variant_graph(w))


def apparatus_lines(spark: SparkSession, d: str) -> DataFrame:
    w, g = _graph(spark, d)
    return render.apparatus_text(render.apparatus(g, collate.first_witness(w)))


def synopsis_rows(spark: SparkSession, d: str) -> DataFrame:
    w, g = _graph(spark, d)
    order = w.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "siglum"))), lambda x: x["siglum"]).alias("sigla"))
    return render.synopsis_text(render.synopsis(g, order))


def interchange(spark: SparkSession, d: str) -> DataFrame:
    w, g = _graph(spark, d)
    return render.interchange(w, collate.variations(w), g)


def ordered_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """The witnesses with these sigla alone, in this order."""
    return witnesses.ordered(_cases(spark, d), ["TS", "MS"]).select("work_id", "siglum", "ordinal")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the recorded variations and the witnesses of each case amount to."""
    v = as_results(spark, d).drop("work_id").withColumnRenamed("case_id", "work_id")
    return viewer.type_counts(witnesses.from_table(read_table(spark, d, "witness")), v)


def witness_sizes(spark: SparkSession, d: str) -> DataFrame:
    return viewer.sizes(_cases(spark, d))


def covering_changes(spark: SparkSession, d: str) -> DataFrame:
    """Of every recorded change, the first one of its pair that covers its place in the base and has another side."""
    return viewer.covering(viewer.asked(facts(spark, d)), facts(spark, d))


def insertion_mates(spark: SparkSession, d: str) -> DataFrame:
    """For what is inserted alike in a case: the insertion that a viewer leads to, by its reading or else by its witness."""
    v = recorded(spark, d).where("case_id IS NOT NULL")
    pair = read_table(spark, d, "pairwise").select("pair_id", F.col("compared").alias("witness")).dropDuplicates(["pair_id"])
    annotation = v.join(pair, "pair_id").select(F.col("case_id").alias("work_id"), F.col("variation_id").alias("v_no"), "witness", "variation_type", F.coalesce("compared_reading", F.lit("")).alias("reading"))
    nodes = annotation.where("variation_type = 'insertion'").groupBy("work_id", T.insertion_key(F.col("reading")).alias("node")).agg(F.array_sort(F.collect_set("witness")).alias("sigla"))
    return viewer.insertion_mates(nodes.withColumn("surfaces", F.array("node")), annotation)


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    w = cases(spark, d)
    nodes, moves = graph.base_anchored(w)
    return viewer.graph_counts(cut(nodes), moves)


def self_collation(spark: SparkSession, d: str) -> DataFrame:
    """Every document collated with itself: no row is the right result."""
    one = documents(spark, d)
    return collate.variations(one.union(one.withColumn("siglum", F.lit("B")).withColumn("ordinal", F.lit(1))))


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {f.__name__: f for f in (
        ordered_witnesses, run_summary, witness_sizes, covering_changes, insertion_mates, graph_summary, token_words, token_places, token_offsets, normal_forms, spelling_folds, comparable_tokens, key_frequency, successive_pairs, base_pairs, promoted_order, anchor_pins, plausible_pins, anchor_density,
        lexicon_pivots, pivoted_keys, pair_check, cites, csv_rows, csv_lines, pairwise_apparatus, report_entries, narratives, perspective, escaped,
        collate_variations, collate_cases, collate_accidentals, collate_bilingual, collate_tallies, graph_edges, apparatus_lines, synopsis_rows, interchange, self_collation,
    )}
    named |= {f"unique_{name}": unique_grams(n) for n, name in ((2, "bigrams"), (3, "trigrams"))}
    named |= {name: of_facts(op) for name, op in (
        ("pair_tallies", metrics.tallies), ("dominant_kind", metrics.dominant), ("extent_metrics", metrics.extent), ("thirds_cluster", metrics.thirds), ("alignment_quality", metrics.quality),
        ("change_histogram", metrics.histogram), ("heat_strip", metrics.heat), ("story_segments", metrics.story), ("redline", metrics.redline), ("span_slices", metrics.spans), ("moved_deviation", metrics.moved_deviation),
    )}
    named |= {name: of_recorded(op) for name, op in (("displaced_words", metrics.displaced), ("shared_insertions", metrics.shared_insertions), ("cross_page", metrics.cross_page))}
    return named | {"variant_graph": variant_graph(BASE_ANCHORED), "peer_graph": variant_graph(PEER_MSA)}


def oracle_sql() -> dict[str, str]:
    return sql.QUERIES

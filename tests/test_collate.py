"""Pairwise collation and graphs on small texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import witnesses
from textloom.config import DIPLOMATIC, GB_US, PEER_MSA, Config
from textloom.operators import collate, graph, render, viewer
from textloom.sources import witnesses as sources

CASES = [
    ("a gull cried", "a white gull cried", Config(), [("insertion", "", "white")]),
    ("he felt rather cold today", "he felt almost frozen today", Config(), [("substitution", "rather cold", "almost frozen")]),
    ("ash elm fir oak", "ash oak", Config(), [("deletion", "elm fir", "")]),
    ("a Harbour!", "a harbour", Config(), []),
    ("that Hour of rest", "that hour of rest", Config(normalizer=DIPLOMATIC), [("substitution", "Hour", "hour")]),
    ("that Hour of rest", "that hour of rest", Config(record_accidentals=True), [("variantSpelling", "Hour", "hour")]),
    ("a pale green door", "a pale-green door", Config(), []),
    ("the grey harbour", "the gray harbor", Config(normalizer=GB_US), []),
    ("they reached our island by dusk", "by dusk they reached our island", Config(), [("transposition", "by dusk", "by dusk")]),
    ("her sea-worn captain", "her captain seemed sea worn", Config(), [("insertion", "", "seemed"), ("transposition", "captain", "captain")]),
    ("he sailed early, yet late", "he sailed early yet late", Config(record_punctuation=True), [("variantSpelling", ",", "∅")]),
    ("no wind came: sails hung", "no wind came; sails hung", Config(record_punctuation=True), [("variantSpelling", ":", ";")]),
    ("le bon été", "le bon e\u0301te\u0301", Config(normalizer=DIPLOMATIC), []),
    ("", "all of it", Config(), [("insertion", "", "all of it")]),
    ("all of it", None, Config(), [("deletion", "all of it", "")]),
]


@pytest.mark.parametrize("config", sorted({c[2] for c in CASES}, key=repr), ids=lambda c: "")
def test_pairs(spark, config):
    picked = [(i, c) for i, c in enumerate(CASES) if c[2] == config]
    rows = [(str(i), s, n, t) for i, c in picked for n, (s, t) in enumerate((("A", c[0]), ("B", c[1])))]
    found = collate.variations(spark.createDataFrame(rows, sources.SCHEMA), config).orderBy("work_id", "v_no").collect()
    for i, c in picked:
        mine = [(v.variation_type, v.base_reading, v.compared_reading) for v in found if v.work_id == str(i)]
        assert sorted(mine) == sorted(c[3]), c


def test_places_confidence_and_anchor(spark):
    w = witnesses(spark, "her own dark boat came slowly near", "her new boat came quite slowly over near")
    v = collate.variations(w).orderBy("v_no").collect()
    assert [(x.variation_type, x.insertion_anchor) for x in v] == [("substitution", None), ("insertion", 4), ("insertion", 5)]
    assert v[0].base_location.cite == "p.1 · line 1 · words 2–3" and (v[0].base_location.char_from, v[0].base_location.char_to) == (4, 12)
    assert {x.confidence for x in v} == {"certain"} and not any(x.crosses_page for x in v)


def test_edit_inside_a_move_is_marked(spark):
    a = "we felt ragged because our march from camp took days. some boys sang loudly beneath that tower near noon."
    b = "some boys sang loudly beneath that tower near noon. we felt worn because our march from camp took days."
    v = collate.variations(witnesses(spark, a, b)).collect()
    assert sorted((x.variation_type, x.within_transposition) for x in v) == [("substitution", True), ("transposition", False)]


def test_recurring_word_is_only_likely(spark):
    v = collate.variations(witnesses(spark, "her captain steered north and her captain grew silent then", "her steered north captain and her captain grew silent then")).collect()
    assert [(x.variation_type, x.base_reading, x.confidence) for x in v] == [("transposition", "captain", "likely")]


def test_lexicon_pairs_translations(spark):
    groups = spark.createDataFrame([(1, "Mer "), (1, "sea"), (2, "regarda"), (2, "watched"), (3, "alone"), (4, "mer"), (4, "zee")], "grp int, form string")
    lexicon = sources.lexicon(groups)
    assert {tuple(r) for r in lexicon.collect()} == {("mer", "mer"), ("sea", "mer"), ("regarda", "regarda"), ("watched", "regarda"), ("zee", "mer")}
    v = collate.variations(witnesses(spark, "regarda mer", "watched sea"), Config(), lexicon).collect()
    assert v == []


def test_each_case_by_its_own_settings(spark):
    schema = sources.SCHEMA + ", normalizer string, lines_per_page int, continuous boolean, record_accidentals boolean, record_punctuation boolean"
    settings = {"plain": (" Substantive", None, None, None, False), "exact": ("diplomatic", None, False, False, False), "gb": ("gbUS", 1, False, False, None), "case": (None, None, True, True, False)}
    texts = {"plain": ("The grey\nEnd, now", "the gray\nend now"), "exact": ("the End", "the end"), "gb": ("a b\nthe grey end", "a b\nthe gray last"), "case": ("a\n\f\nthe End", "a\n\f\nthe end")}
    rows = [(w, "AB"[i], i, t, *settings[w]) for w, ts in texts.items() for i, t in enumerate(ts)]
    found = sorted((v.work_id, v.variation_type, v.base_reading, v.base_location.page, v.base_location.line) for v in collate.by_case(spark.createDataFrame(rows, schema)).collect())
    assert found == [("case", "variantSpelling", "End", 1, 1), ("exact", "substitution", "End", 0, 0), ("gb", "substitution", "end", 1, 0), ("plain", "substitution", "grey", 0, 0)]


def test_tallies_keep_equal_pairs(spark):
    w = witnesses(spark, "same text", "same text", "other text")
    rows = {r.compared: r for r in collate.tallies(collate.successive_pairs(w), collate.variations(w)).collect()}
    assert rows["B"].n_substitution == 0 and rows["C"].n_substitution == 1


@pytest.fixture(scope="module")
def merged(spark):
    texts = {
        "shared": ["the edge of that reef", "the rim of that reef", "the rim of that reef"],
        "added": ["rope sail", "rope new sail", "rope sail"],
        "peer": ["we met sailor", "we met that wet sailor", "we met one wet sailor"],
        "moved": ["they reached our island by dusk", "by dusk they reached our island"],
    }
    w = spark.createDataFrame([(k, "ABC"[i], i, t) for k, ts in texts.items() for i, t in enumerate(ts)], sources.SCHEMA)
    return w, graph.base_anchored(w), graph.peer(w, Config(strategy=PEER_MSA))


def _variants(readings, work):
    return [(n.base_position, n.inserted_after, {r.reading: "".join(r.witnesses) for r in n.readings}) for n in graph.project(readings).where("is_variant").orderBy("node_no").collect() if n.work_id == work]


def test_base_anchored_graph(merged):
    _, (readings, moves), _ = merged
    assert _variants(readings, "shared") == [(1, None, {"edge": "A", "rim": "BC"})]
    assert _variants(readings, "added") == [(-1, 0, {"new": "B", "∅": "AC"})]
    assert _variants(readings, "moved") == []
    assert [(m.src, m.dst, m.siglum, m.confidence) for m in moves.collect() if m.work_id == "moved"] == [(3, None, "B", "certain")]


def test_peer_graph(merged):
    _, _, (readings, moves) = merged
    assert _variants(readings, "shared") == [(1, None, {"edge": "A", "rim": "BC"})]
    assert _variants(readings, "peer") == [(-1, 1, {"one": "C", "that": "B", "∅": "A"}), (-1, 1, {"wet": "BC", "∅": "A"})]
    assert [(m.siglum, m.confidence) for m in moves.collect() if m.work_id == "moved"] == [("B", "certain")]


def test_apparatus_and_synopsis(merged):
    w, (readings, _), _ = merged
    g = graph.project(readings)
    lines = {r.work_id: r.line for r in render.apparatus_text(render.apparatus(g, graph._base(w).select("work_id", "base"))).where("work_id <> 'peer'").collect()}
    assert lines == {"shared": "1 edge] rim B C", "added": "0 ∅] new B"}
    order = w.groupBy("work_id").agg({"siglum": "collect_list"}).withColumnRenamed("collect_list(siglum)", "sigla").selectExpr("work_id", "array_sort(sigla) AS sigla")
    cells = [[c.reading for c in r.cells] for r in render.synopsis(g, order).where("work_id = 'added'").orderBy("node_no").collect()]
    assert cells == [["rope"] * 3, ["∅", "new", "∅"], ["sail"] * 3]


def test_works_dealt_over_tasks_give_the_same(spark):
    texts = [f"the {w} ship came home at dusk" for w in "old new red tall slow lost grey lame".split()]
    w = spark.createDataFrame([(k, f"S{i}", i if k == "large" else i % 3, t) for k, n in (("large", 8), ("ties", 5), ("small", 2), ("one", 1)) for i, t in enumerate(texts[:n])], sources.SCHEMA)
    for against in (collate.PREVIOUS, collate.BASE):
        whole, dealt = (sorted(map(repr, collate.variations(w, against=against, per_task=n).collect())) for n in (1000, 2))
        assert whole == dealt and len(whole) == 7 + 4 + 1
    nodes = lambda n: sorted(map(repr, graph.base_anchored(w, variation=collate.variations(w, against=collate.BASE, put=True, per_task=n))[0].collect()))
    assert nodes(1000) == nodes(3)


def test_pairs_of_a_long_order(spark, monkeypatch):
    monkeypatch.setattr(collate, "STEP", 2)
    w = spark.createDataFrame([("w", f"S{i:02}", i, "x") for i in (0, 1, 2, 5, 6, 11, 12, 13)] + [("v", "A", None, "x"), ("v", "B", 0, "x")], sources.SCHEMA)
    found = sorted((r.work_id, r.base, r.compared) for r in collate.successive_pairs(w).collect())
    assert found == [("v", "A", "B")] + [("w", f"S{a:02}", f"S{b:02}") for a, b in ((0, 1), (1, 2), (2, 5), (5, 6), (6, 11), (11, 12), (12, 13))]


def test_large_lexicon_is_joined(spark, monkeypatch):
    lexicon = spark.createDataFrame([("mer", "mer"), ("sea", "mer")], "form string, pivot string")
    w = witnesses(spark, "regarda mer", "regarda sea")
    monkeypatch.setattr(collate, "FORMS", 1)
    assert collate.variations(w, Config(), lexicon).collect() == []


def test_empty_table(spark):
    none = spark.createDataFrame([], sources.SCHEMA)
    assert collate.variations(none).collect() == [] and graph.variant_graph(none).collect() == []


def test_graph_summary_counts_spine_variants_insertions_and_moves(merged):
    nodes, moves = merged[1]
    told = {r.work_id: tuple(r)[1:] for r in viewer.graph_counts(nodes, moves).collect()}
    moved = Counter(r.work_id for r in moves.collect())
    by_work = {}
    for n in nodes.collect():
        spine, variant, inserted = by_work.get(n.work_id, (0, 0, 0))
        by_work[n.work_id] = spine + (n.base_position >= 0), variant + (len(n.readings) > 1), inserted + (n.base_position < 0)
    assert told == {work: (*x, moved[work]) for work, x in by_work.items()}
    assert sum(x[2] for x in told.values()) > 0 and all(x[0] > 0 for x in told.values())


def test_edges_of_bases_are_those_of_their_nodes_and_are_not_exchanged(spark):
    w = witnesses(spark, "The old man sat by the sea, and sang of ships.", "By the sea the old man sat and sang of grey ships.", "The old man sat, and of ships sang by the sea.")
    w = w.union(witnesses(spark, "one", "one two three", work="v")).union(witnesses(spark, "", "some words", work="u")).union(witnesses(spark, "alpha beta gamma delta epsilon zeta", "gamma delta epsilon zeta alpha beta", "zeta alpha beta gamma delta epsilon", work="t"))
    variation = graph.cut(graph.variations(w, against=graph.BASE, put=True))
    made = graph.base_edges(w, variation=variation)
    nodes, moves = graph.base_anchored(w, variation=variation)
    key = lambda rows: sorted(map(str, rows))
    assert key(made.collect()) == key(graph.edges(nodes, moves, w).collect()) and made.where("is_move").count() > 1
    assert made.dtypes == graph.edges(nodes, moves, w).dtypes
    at = {(n.work_id, n.base_position): n.node_id for n in nodes.where("base_position >= 0").collect()}
    asked = variation.where(F.col("variation_type") == graph.MOVE).select("work_id", "base_tokens").collect()
    near = lambda work, lo, hi: [n for (x, p), n in at.items() if x == work and lo <= p < hi]
    expected = [(m.work_id, max(near(m.work_id, 0, m.base_tokens.tok_from), default=-1), min(near(m.work_id, m.base_tokens.tok_to, 10**6), default=None)) for m in asked]
    assert key(expected) == key((m.work_id, m.src, m.dst) for m in moves.collect())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate explode") < plan.index("Join")

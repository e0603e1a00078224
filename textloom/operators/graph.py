"""All witnesses of a work in one variant graph.

Base-anchored: every witness is folded onto the base's tokens; what the pairs change is grouped by place and reading, and
whoever changes nothing at a place reads with the base, so all witnesses and works fold at once and agreement is never
spelt out. Peer: witnesses join a growing consensus one after the other, which is sequential within a work and parallel
over works; they stream through a task in order, and only the consensus is held.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.arrow import arrow_rows
from textloom.config import LIMITS, PEER_MSA, Config
from textloom.functions.text import OMITTED, insertion_key
from textloom.operators import kernels
from textloom.operators.collate import BASE, DELETION, INSERTION, MOVE, SUBSTITUTION, sent_pivots, variations
from textloom.operators.pairing import comparable, keys_of
from textloom.operators.scan import Tokens, scan
from textloom.session import cut, dealt, find_package

READING = "array<struct<normalized:string,surface:string,sigla:array<string>>>"


def _base(witness: DataFrame) -> DataFrame:
    """(work_id, base, ids): the first witness of each work and all its sigla."""
    return witness.groupBy("work_id").agg(F.min_by("siglum", F.struct("ordinal", "siglum")).alias("base"), F.array_sort(F.collect_list("siglum")).alias("ids"))


def spine(variation: DataFrame) -> DataFrame:
    """(work_id, pos, node_id, normalized, surface): the comparable tokens of each work's base."""
    token = variation.where("variation_type IS NULL").select("work_id", F.posexplode("put").alias("node_id", "t"))
    return token.select("work_id", F.col("t.pos").alias("pos"), "node_id", F.col("t.normalized").alias("normalized"), F.col("t.surface").alias("surface"))


def changes(variation: DataFrame) -> DataFrame:
    """(work_id, pos, normalized, surface, siglum): what a witness reads where it differs from the base.

    A deletion reads the omission sign; the k-th token of a substituted stretch reads the k-th token put for it, the last
    one from there on. ``variation`` has the column ``put``.
    """
    held = variation.where(F.col("variation_type").isin(DELETION, SUBSTITUTION))
    each = held.select("work_id", F.col("compared").alias("siglum"), "put", F.posexplode(F.sequence(F.col("base_tokens.tok_from"), F.col("base_tokens.tok_to") - 1)).alias("k", "pos"))
    read = F.get(F.col("put"), F.least(F.col("k"), F.size("put") - 1))
    return each.select("work_id", "pos", F.coalesce(read["normalized"], F.lit(OMITTED)).alias("normalized"), F.coalesce(read["surface"], F.lit(OMITTED)).alias("surface"), "siglum")


def base_anchored(witness: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None, variation: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, moves). nodes: work_id, node_id, base_position, inserted_after, readings (normalized, surface, sigla).

    ``variation`` may hold what ``variations`` found against the bases before, with ``put``.
    """
    variation = cut(variations(witness, config, lexicon, BASE, put=True)) if variation is None else variation
    base = _base(witness)
    rank = witness.select("work_id", "siglum", F.col("ordinal").alias("rank"))
    read = changes(variation).join(rank, ["work_id", "siglum"]).groupBy("work_id", "pos", "normalized").agg(F.min_by("surface", "rank").alias("surface"), F.array_sort(F.collect_set("siglum")).alias("sigla"))
    at = read.groupBy("work_id", "pos").agg(F.array_sort(F.collect_list(F.struct("normalized", "surface", "sigla"))).alias("others"))
    told = spine(variation).join(at, ["work_id", "pos"], "left").join(base, "work_id")
    unlike = F.filter("others", lambda o: o["normalized"] != F.col("normalized"))
    agree = F.array_except("ids", F.flatten(F.transform(unlike, lambda o: o["sigla"])))
    own = lambda sigla: F.array(F.struct("normalized", "surface", sigla.alias("sigla")))
    readings = F.when(F.col("others").isNull(), own(F.col("ids"))).otherwise(F.concat(own(agree), unlike))
    on_base = told.select("work_id", "node_id", F.col("pos").alias("base_position"), F.lit(None).cast("int").alias("inserted_after"), readings.cast(READING).alias("readings"))
    added = (
        variation.where((F.col("variation_type") == INSERTION) & ~F.col("within_transposition") & F.col("insertion_anchor").isNotNull())
        .join(rank.withColumnRenamed("siglum", "compared"), ["work_id", "compared"])
        .withColumn("normalized", insertion_key(F.col("compared_reading")))
        .groupBy("work_id", F.col("insertion_anchor").alias("inserted_after"), "normalized")
        .agg(F.min_by("compared_reading", F.struct("rank", "v_no")).alias("surface"), F.array_sort(F.collect_set("compared")).alias("sigla"))
        .join(base, "work_id")
    )
    rest = F.array_except("ids", "sigla")
    absent = F.array(F.struct(F.lit(OMITTED).alias("normalized"), F.lit(OMITTED).alias("surface"), rest.alias("sigla")))
    both = F.array(F.struct("normalized", "surface", "sigla"))
    sizes = variation.where("variation_type IS NULL").select("work_id", F.size("put").alias("first"))
    order = Window.partitionBy("work_id").orderBy("inserted_after", "normalized")
    number = F.coalesce("first", F.lit(0)) + F.row_number().over(order) - 1
    inserted = added.join(sizes, "work_id", "left").select("work_id", number.alias("node_id"), F.lit(-1).alias("base_position"), "inserted_after", F.when(F.size(rest) > 0, F.concat(both, absent)).otherwise(both).cast(READING).alias("readings"))
    nodes = on_base.union(inserted)
    return nodes, _move_edges(variation)


def _places(variation: DataFrame) -> DataFrame:
    """(work_id, at): where the nodes of each work's base stand, in their order; the node's number is its index."""
    return variation.where("variation_type IS NULL").select("work_id", F.transform("put", lambda t: t["pos"]).alias("at"))


def _move_edges(variation: DataFrame) -> DataFrame:
    """(work_id, src, dst, siglum, confidence): from the node before a moved block to the one after it.

    A block at the start leaves from -1; one at the end goes to null. A work's nodes are one row here, never exchanged each.
    """
    moved = variation.where(F.col("variation_type") == MOVE).select(F.col("work_id").alias("_w"), F.col("compared").alias("siglum"), "confidence", F.col("base_tokens.tok_from").alias("lo"), F.col("base_tokens.tok_to").alias("hi"))
    found = moved.join(_places(variation), F.col("_w").eqNullSafe(F.col("work_id")), "left")
    before = lambda place: F.size(F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda x: x < F.col(place)))
    dst = F.when(before("hi") < F.size("at"), before("hi"))
    return found.select(F.col("_w").alias("work_id"), (before("lo") - 1).alias("src"), dst.alias("dst"), "siglum", "confidence")


def base_edges(witness: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None, variation: DataFrame | None = None) -> DataFrame:
    """What ``edges`` gives of ``base_anchored``, from the works' bases: an edge is made where it is written, and never exchanged or sorted."""
    variation = cut(variations(witness, config, lexicon, BASE, put=True)) if variation is None else variation
    line = _places(variation).where(F.size("at") > 1).join(_base(witness), "work_id")
    spine = line.select("work_id", F.explode(F.sequence(F.lit(0), F.size("at") - 2)).alias("src"), "ids")
    kept = spine.select("work_id", "src", (F.col("src") + 1).alias("dst"), F.lit(False).alias("is_move"), F.lit("certain").alias("confidence"), F.col("ids").alias("sigla"))
    return kept.union(_moved(_move_edges(variation)))


class Slot:
    """A place of the growing consensus: reading -> (surface, sigla), the page, the base position or None."""

    __slots__ = ("readings", "page", "base", "created")

    def __init__(self, key: str, surface: str, siglum: str, page: int, base: int | None):
        self.readings: dict[str, tuple[str, set[str]]] = {key: (surface, {siglum})}
        self.page, self.base, self.created = page, base, key

    def read(self, key: str, surface: str, sigla: set[str]) -> None:
        held = self.readings.get(key)
        self.readings[key] = (surface, set(sigla)) if held is None else (held[0], held[1] | sigla)

    def consensus(self) -> str:
        """The reading of most witnesses; among equals the first one given here, else the least."""
        counts = {k: len(s) for k, (_, s) in self.readings.items() if k != OMITTED}
        if not counts:
            return OMITTED
        top = max(counts.values())
        leaders = [k for k, c in counts.items() if c == top]
        return self.created if self.created in leaders else min(leaders)


def _joined(a: Slot, b: Slot) -> dict | None:
    """Readings of two neighbouring insertions as one, if the same witnesses stand together in both."""
    if len(a.readings) != len(b.readings):
        return None
    by_sigla = {frozenset(s): (k, t) for k, (t, s) in b.readings.items()}
    result: dict[str, tuple[str, set[str]]] = {}
    for k, (t, s) in a.readings.items():
        if frozenset(s) not in by_sigla:
            return None
        other, text = by_sigla[frozenset(s)]
        if (k == OMITTED) != (other == OMITTED):
            return None
        result[k if k == OMITTED else f"{k} {other}"] = (t if k == OMITTED else f"{t} {text}", set(s))
    return result if len(result) == len(a.readings) else None


class Consensus:
    """Witnesses merged one after the other: the first seeds, each further one is aligned with what the others agree on."""

    def __init__(self, siglum: str, t: Tokens, config: Config, pivots: dict[str, str]):
        self.config, self.pivots, self.everyone = config, pivots, {siglum}
        self.spine = [Slot(t.normalized[i], t.surface[i], siglum, t.page[i], i) for i in comparable(t)]
        self.moves: list[tuple[str, Slot | None, Slot | None]] = []

    def _edge(self, siglum: str, lo: int, hi: int) -> None:
        self.moves.append((siglum, self.spine[lo - 1] if lo > 0 else None, self.spine[hi] if hi < len(self.spine) else None))

    def add(self, siglum: str, t: Tokens) -> None:
        spine, at = self.spine, comparable(t)
        self.everyone.add(siglum)
        keys = [self.pivots.get(c.lower(), c) if self.pivots else c for c in (s.consensus() for s in spine)]
        theirs = keys_of(t, at, self.pivots)
        segments = kernels.align(keys, theirs, self.config.anchor_length, self.config.scores, [s.page for s in spine], [t.page[i] for i in at])
        reads: dict[int, int | None] = {}  # slot -> token, None where it is left out
        inserts: list[tuple[int, int]] = []  # (slot before, token)
        last = -1
        for op, i, j in (o for s in segments if s.move is None for o in s.ops):
            if op == "insert":
                inserts.append((last, j))
            else:
                reads[i], last = (None if op == "delete" else j), i
        gone, come = defaultdict(list), defaultdict(list)
        for i, j in reads.items():
            if j is None:
                gone[keys[i]].append(i)
        for n, (_, j) in enumerate(inserts):
            come[theirs[j]].append(n)
        paired = sorted((gone[k][0], come[k][0]) for k in gone if len(gone[k]) == 1 == len(come.get(k, ())) and abs(inserts[come[k][0]][0] - gone[k][0]) <= LIMITS.peer_window)
        used = {n for _, n in paired}
        placed = {i: inserts[n][1] for i, n in paired}
        run: list[int] = []
        for i in sorted(placed) + [None]:
            if run and not (i is not None and i == run[-1] + 1 and placed[i] == placed[run[-1]] + 1):
                self._edge(siglum, run[0], run[-1] + 1)
                run = []
            if i is not None:
                run.append(i)
        for s in segments:
            if s.move is not None:
                for op, i, j in s.ops:
                    if op != "insert":
                        reads[i] = None if op == "delete" else j
                self._edge(siglum, s.move[0], s.move[1])
        for i, j in reads.items():
            j = placed.get(i) if j is None else j
            if j is None:
                spine[i].read(OMITTED, OMITTED, {siglum})
            else:
                spine[i].read(t.normalized[at[j]], t.surface[at[j]], {siglum})
        after: dict[int, list[int]] = defaultdict(list)
        for n, (i, j) in enumerate(inserts):
            if n not in used:
                after[i].append(at[j])
        if after:
            grown: list[Slot] = []
            for i in range(-1, len(spine)):
                if i >= 0:
                    grown.append(spine[i])
                grown += [Slot(t.normalized[j], t.surface[j], siglum, t.page[j], None) for j in after.get(i, ())]
            self.spine = grown

    def result(self) -> tuple[list[tuple], list[tuple]]:
        """Nodes (node, base position or -1, inserted after or None, readings) and move edges."""
        for s in self.spine:
            missing = self.everyone - set().union(*(x for _, x in s.readings.values()))
            if missing:
                s.read(OMITTED, OMITTED, missing)
        merged: list[Slot] = []
        for s in self.spine:
            both = _joined(merged[-1], s) if merged and s.base is None and merged[-1].base is None else None
            if both is not None:
                merged[-1].readings = both
            else:
                merged.append(s)
        ids = {id(s): n for n, s in enumerate([s for s in merged if s.base is not None] + [s for s in merged if s.base is None])}
        nodes, before = [], -1
        for s in merged:
            before = s.base if s.base is not None else before
            nodes.append((ids[id(s)], -1 if s.base is None else s.base, before if s.base is None else None, [(k, t, sorted(sigla)) for k, (t, sigla) in s.readings.items()]))
        edges = [(ids.get(id(a), -1) if a else -1, ids.get(id(b)) if b else None, w, "certain") for w, a, b in self.moves]
        return nodes, edges


def peer(witness: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, moves) of the peer merge; see ``base_anchored`` for the columns.

    The first witness of a work seeds, the others join in the order of their sigla.
    """
    find_package(witness.sparkSession)
    pivots, witness = sent_pivots(witness, lexicon, config)
    sent = witness.sparkSession.sparkContext.broadcast(pivots)  # bounded, see there
    first = witness.groupBy("work_id").agg(F.min(F.struct("ordinal", "siglum")).alias("_f")).select("work_id", F.col("_f.siglum").alias("siglum"), F.lit(0).alias("_place"))
    held = witness.join(first, ["work_id", "siglum"], "left").select("work_id", "siglum", F.coalesce("_place", F.lit(1)).alias("place"), "text", *(["pivots"] if pivots is None else []))
    kind = witness.schema["work_id"].dataType.simpleString()

    def told(work, consensus: Consensus) -> Iterator[tuple]:
        nodes, edges = consensus.result()
        for n in nodes:
            yield (work, *n, None, None, None, None)
        for e in edges:
            yield (work, None, None, None, None, *e)

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        work = consensus = None
        for r in rows:
            t = scan(r["text"], config.normalizer, config.pagination)
            if consensus is None or r["work_id"] != work:
                if consensus is not None:
                    yield from told(work, consensus)
                work, consensus = r["work_id"], Consensus(r["siglum"], t, config, dict(sent.value or {}))
                consensus.pivots |= dict(r.get("pivots") or ())
            else:
                consensus.pivots |= dict(r.get("pivots") or ())
                consensus.add(r["siglum"], t)
        if consensus is not None:
            yield from told(work, consensus)

    streamed = dealt(held, "work_id").sortWithinPartitions("work_id", "place", "siglum")
    merged = arrow_rows(streamed, run, f"work_id {kind}, node_id int, base_position int, inserted_after int, readings {READING}, src int, dst int, siglum string, confidence string")
    nodes = merged.where("node_id IS NOT NULL").select("work_id", "node_id", "base_position", "inserted_after", "readings")
    return nodes, merged.where("node_id IS NULL").select("work_id", "src", "dst", "siglum", "confidence")


def merge(witness: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return (peer if config.strategy == PEER_MSA else base_anchored)(witness, config, lexicon)


def project(nodes: DataFrame) -> DataFrame:
    """(work_id, node_no, node_id, base_position, inserted_after, is_variant, readings): nodes in text order.

    Readings that look the same are one; readings and sigla are sorted.
    """
    surfaces = F.array_sort(F.array_distinct(F.transform("readings", lambda r: r["surface"])))
    carriers = lambda s: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("readings", lambda r: r["surface"] == s), lambda r: r["sigla"]))))
    only = F.col("readings")[0]
    shown = F.when(F.size("readings") == 1, F.array(F.struct(only["surface"].alias("reading"), only["sigla"].alias("witnesses")))).otherwise(F.transform(surfaces, lambda s: F.struct(s.alias("reading"), carriers(s).alias("witnesses"))))
    node = nodes.select("work_id", "node_id", "base_position", "inserted_after", shown.alias("readings"))
    least = F.when(F.size("readings") == 1, F.col("readings")[0]["reading"]).otherwise(F.array_min(F.filter(F.transform("readings", lambda r: r["reading"]), lambda r: r != OMITTED)))
    order = Window.partitionBy("work_id").orderBy(F.coalesce("inserted_after", "base_position"), F.col("inserted_after").isNotNull(), F.coalesce(F.nullif(least, F.lit(OMITTED)), F.lit("")), "node_id")
    return node.select("work_id", (F.row_number().over(order) - 1).alias("node_no"), "node_id", "base_position", "inserted_after", (F.size("readings") > 1).alias("is_variant"), "readings")


def variant_graph(witness: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None) -> DataFrame:
    """The variant graph of every work; ``base_position`` is -1 and ``inserted_after`` set on inserted nodes."""
    return project(merge(witness, config, lexicon)[0])


def edges(nodes: DataFrame, moves: DataFrame, witness: DataFrame) -> DataFrame:
    """(work_id, src, dst, is_move, confidence, sigla): the spine in order with all sigla, then the moves."""
    nodes = nodes.where("base_position >= 0").select("work_id", "node_id", "base_position")
    line = Window.partitionBy("work_id").orderBy("base_position")
    spine = nodes.select("work_id", F.col("node_id").alias("src"), F.lead("node_id").over(line).alias("dst")).where("dst IS NOT NULL").join(_base(witness), "work_id")
    kept = spine.select("work_id", "src", "dst", F.lit(False).alias("is_move"), F.lit("certain").alias("confidence"), F.col("ids").alias("sigla"))
    return kept.union(_moved(moves))


def _moved(moves: DataFrame) -> DataFrame:
    return moves.select("work_id", "src", "dst", F.lit(True), "confidence", F.array("siglum"))

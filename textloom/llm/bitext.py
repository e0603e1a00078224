"""Problem 4: sentence alignment in bilingual documents.

Method: a hidden Markov model. The target's sentences (English) are emissions of source states: one source sentence, a
span of two or three consecutive ones (a merge), or null (an addition). A state emits the words of a target sentence
through a word translation table mixed with the background frequency of the word; jumps between states follow a
distribution that prefers the next sentence, allows to stay (a split) and keeps a floor for moved passages. Viterbi
decoding gives the states; within a span only source sentences that the target words need are kept.

The translation table starts from co-occurrence near the diagonal over all bilingual pairs and is re-estimated from the
alignments (``ROUNDS`` times). Forms of one lexicon group and equal forms (names, numbers) translate each other anyway.
The tables are counted first: up to ``SENT_ROWS`` rows are sent to every task; beyond that each pair of documents
receives just the entries of its own words by joins.

Defined results: witnesses without sentences align with nothing; equal scores keep the earlier source sentence; a
repeated delivery or lexicon row counts once; several witnesses of a language align each with each of the other;
lexicon forms are compared without case, accents and outer blanks, groups of one form say nothing; extra columns are
dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, cut, read_table, spread
from textloom.llm.encoding import as_seen
from textloom.llm.leak import words

ROUNDS = 2
BAND = 0.2  # of the text's length around the diagonal, for the first counts
SENT_ROWS = 300_000  # of all tables together; some 30 MB
WHOLE_CELLS = 2_000_000  # of a matrix of all words, 16 MB a task; of larger tables each pair looks up its own words
PARTNERS = 24  # translations kept of a word
LEXICON = 0.5  # translation probability within a lexicon group
SAME = 0.7  # of a form by itself
BACKGROUND = 0.15  # share of a word's emission that needs no source word
SPANS = 3
SPAN_PRICE = 2.0
NULL = 4.0  # log odds that a sentence needs over the background to be no addition
NEED = 1.5  # log odds that a sentence must add to a span to stay in it
JUMPS = {1: -0.4, 0: -3.5, 2: -2.2, 3: -3.2, -1: -3.5}
JUMP_FLOOR = -5.0
REACH = 50  # sentences, from which on jumps cost the same

_END = regex.compile(r"[.!?](?=\s|$)")


def sentences(text: str | None) -> list[str]:
    """Stretches that end at ``.``, ``!`` or ``?`` before whitespace or the end; a rest with a sign in it is one too."""
    result, lo = [], 0
    for m in _END.finditer(text or ""):
        result.append(text[lo : m.end()])
        lo = m.end()
    if text and text[lo:].strip():
        result.append(text[lo:])
    return result


def sentence_words(text: str | None, restorer=None) -> list[list[str]]:
    result = []
    for s in sentences(text):
        if not s.isascii():
            if restorer is not None:
                s = restorer.restore(s)[0]
            s = " ".join(as_seen(w) if not w.isascii() else w for w in s.split())
        result.append([w for w in words(s) if len(w) > 1])
    return result


def _as_lines(column: str) -> Column:
    """The words of sentences as one string, a line for each sentence, which costs a task less to read than nested lists."""
    return F.array_join(F.transform(column, lambda s: F.concat(F.array_join(s, " "), F.lit("\n"))), "").alias(column)


def _of_lines(text: str) -> list[list[str]]:
    return [s.split(" ") if s else [] for s in text.split("\n")[:-1]]


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, a, b, fr, en): every French and English witness of a bilingual case, as words of sentences."""
    from textloom.llm.encoding import dictionaries

    witness = read_table(spark, sf_dir, "witness")
    cases = read_table(spark, sf_dir, "case_meta").where("lexicon_name IS NOT NULL").select("case_id").distinct()
    held = witness.where("text IS NOT NULL AND (siglum LIKE 'fr-%' OR siglum LIKE 'en-%')").select("case_id", "witness_id", "siglum", "text").join(cases, "case_id", "left_semi")
    trained = spark.sparkContext.broadcast(dictionaries(witness, "witness_id"))  # bounded, see there

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        from textloom.llm.encoding import restorer_of

        restorer = restorer_of(trained.value)
        for r in rows:
            yield r["case_id"], r["witness_id"], r["siglum"][:2], sentence_words(r["text"], restorer)

    told = arrow_rows(held, run, "case_id long, id long, lang string, sents array<array<string>>", flush=256).dropDuplicates(["id"])
    fr = told.where("lang = 'fr'").select("case_id", F.col("id").alias("fr_id"), F.col("sents").alias("fr"))
    en = told.where("lang = 'en'").select("case_id", F.col("id").alias("en_id"), F.col("sents").alias("en"))
    return fr.join(en, "case_id").select(F.xxhash64("fr_id", "en_id").alias("pid"), "fr_id", "en_id", "fr", "en")


class Sums:
    """Sums per word pair in a dense matrix over the words seen so far; passed on when the vocabulary gets large."""

    def __init__(self, most: int = 2000, least: float = 0.01):
        self.most, self.least = most, least
        self.f: dict[str | None, int] = {}
        self.e: dict[str | None, int] = {}
        self.sums = np.zeros((256, 256))

    def add(self, f: list, e: list, n: np.ndarray) -> Iterator[tuple]:
        at = [self.f.setdefault(w, len(self.f)) for w in f]
        to = [self.e.setdefault(w, len(self.e)) for w in e]
        grown = tuple(max(s, 2 * len(d) if len(d) > s else s) for s, d in zip(self.sums.shape, (self.f, self.e)))
        if grown != self.sums.shape:
            sums = np.zeros(grown)
            sums[: self.sums.shape[0], : self.sums.shape[1]] = self.sums
            self.sums = sums
        self.sums[np.ix_(at, to)] += n
        if max(len(self.f), len(self.e)) > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        f, e = list(self.f), list(self.e)
        i, j = np.nonzero(self.sums > self.least)
        yield from zip(map(f.__getitem__, i.tolist()), map(e.__getitem__, j.tolist()), self.sums[i, j].tolist())
        self.__init__(self.most, self.least)


def first_counts(pairs: DataFrame) -> DataFrame:
    """(f, e, n): how often two words meet near the diagonal; f null: how often e stands at all, e null: f likewise."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        held = Sums()
        for r in rows:
            fr, en = _of_lines(r["fr"]), _of_lines(r["en"])
            if not fr or not en:
                continue
            f = {w: k for k, w in enumerate(dict.fromkeys(w for s in fr for w in s))}
            e = {w: k for k, w in enumerate(dict.fromkeys(w for s in en for w in s))}
            if not f or not e:
                continue
            x = (np.arange(len(fr)) + 0.5) / len(fr)
            y = (np.arange(len(en)) + 0.5) / len(en)
            near = (np.abs(x[:, None] - y[None, :]) <= BAND + 0.5 / len(en)).astype(float)
            spread_over = near / np.maximum(near.sum(1, keepdims=True), 1.0)
            in_f, in_e = _indicator(fr, f), _indicator(en, e)
            n = np.zeros((len(f) + 1, len(e) + 1))
            n[:-1, :-1] = in_f.T @ spread_over @ in_e
            n[:-1, -1] = in_f.sum(0)
            n[-1, :-1] = spread_over.sum(0) @ in_e
            yield from held.add([*f, None], [*e, None], n)
        yield from held.flush()

    return _summed(arrow_rows(pairs.select(_as_lines("fr"), _as_lines("en")), run, "f string, e string, n double"))


def _summed(counts: DataFrame) -> DataFrame:
    return cut(counts.groupBy("f", "e").agg(F.sum("n").alias("n")))


def table(counts: DataFrame, excess: bool) -> DataFrame:
    """(f, e, t): translation probabilities from counts, the ``PARTNERS`` best of each word.

    ``excess`` counts only what exceeds chance, for the first counts, which hold many accidental neighbours.
    """
    both = counts.where("f IS NOT NULL AND e IS NOT NULL")
    if excess:
        of_f = counts.where("e IS NULL").select("f", F.col("n").alias("nf"))
        of_e = counts.where("f IS NULL").select("e", F.col("n").alias("ne"))
        total = F.broadcast(of_f.agg(F.sum("nf").alias("total")))  # one row
        both = both.join(of_f, "f").join(of_e, "e").crossJoin(total)
        expected = F.col("nf") * F.col("ne") / F.col("total")
        both = both.withColumn("n", F.col("n") - expected - F.sqrt(expected)).where("n > 0")
    w = Window.partitionBy("f").orderBy(F.desc("n"), "e")  # a word's partners are bounded by the vocabulary
    kept = both.select("f", "e", "n").withColumn("k", F.row_number().over(w)).where(F.col("k") <= PARTNERS)
    return kept.select("f", "e", (F.col("n") / (F.sum("n").over(Window.partitionBy("f")) + 1.0)).alias("t"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, grp) of groups of at least two forms, forms as the sentences' words are written."""
    plain = F.udf(lambda x: " ".join(words(x)), "string")
    rows = read_table(spark, sf_dir, "lexicon").where("form IS NOT NULL").select(F.xxhash64("lexicon_name", "group_no").alias("grp"), plain("form").alias("form")).distinct()
    single = rows.where("form <> '' AND NOT form LIKE '% %'")
    return single.join(single.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "grp", "left_semi")


def with_tables(pairs: DataFrame, t: DataFrame, background: DataFrame, lex: DataFrame) -> DataFrame:
    """Each pair of documents with the translations, background frequencies and lexicon rows of its own words.

    The way for tables too large to send to every task.
    """
    distinct = lambda c: F.array_distinct(F.flatten(c))
    of_f = pairs.select("pid", F.explode(distinct("fr")).alias("f"))
    of_e = pairs.select("pid", F.explode(distinct("en")).alias("e"))
    own = of_f.join(t, "f").join(of_e, ["pid", "e"]).groupBy("pid").agg(F.collect_list(F.struct("f", "e", "t")).alias("translations"))
    forms = of_f.select("pid", F.col("f").alias("form")).union(of_e.select("pid", F.col("e").alias("form"))).distinct()
    listed = forms.join(lex, "form").groupBy("pid").agg(F.collect_list(F.struct("form", "grp")).alias("lexicon"))
    p = of_e.join(background, "e").groupBy("pid").agg(F.collect_list(F.struct("e", "p")).alias("background"))
    return pairs.join(own, "pid", "left").join(listed, "pid", "left").join(p, "pid", "left")


def over_pairs(pairs: DataFrame, t: DataFrame, background: DataFrame, lex: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows, odds)`` over the pairs, where ``odds(row)`` knows the tables.

    Tables of at most ``SENT_ROWS`` rows together (counted first) are sent to every task; larger ones are joined.
    """
    tables = (t.select("f", "e", "t"), lex.select("form", "grp"), background.select("e", "p"))
    least = background.agg(F.min("p")).first()[0] or 1e-4  # of a word that the background doesn't know, on either way
    if sum(x.count() for x in tables) <= SENT_ROWS:
        sent = pairs.sparkSession.sparkContext.broadcast([[tuple(r) for r in x.collect()] for x in tables])

        def run(rows: Iterator[dict]) -> Iterator[tuple]:
            return work(rows, Local(*sent.value, least, Whole).odds)

        return arrow_rows(pairs.select("fr_id", "en_id", _as_lines("fr"), _as_lines("en")), run, schema)

    def run_joined(rows: Iterator[dict]) -> Iterator[tuple]:
        return work(rows, lambda r: Local(*[[tuple(x.values()) for x in r[c] or ()] for c in ("translations", "lexicon", "background")], least).odds(r))

    return arrow_rows(with_tables(pairs, *(tables[0], tables[2], tables[1])).select("fr_id", "en_id", _as_lines("fr"), _as_lines("en"), "translations", "lexicon", "background"), run_joined, schema)


class Whole:
    """A translation table as one matrix, from which a pair of documents takes the rows and columns of its words."""

    def __init__(self, table: dict):
        self.f = {w: k for k, w in enumerate(table)}
        self.e = {w: k for k, w in enumerate(dict.fromkeys(v for row in table.values() for v in row))}
        self.t = np.zeros((len(self.e) + 1, len(self.f) + 1))  # the last row and column stand for words without an entry
        for w, k in self.f.items():
            for v, x in table[w].items():
                self.t[self.e[v], k] = x

    @classmethod
    def fits(cls, table: dict) -> bool:
        return (len(table) + 1) * (len({v for row in table.values() for v in row}) + 1) <= WHOLE_CELLS

    def of(self, f: dict, e: dict) -> np.ndarray:
        return self.t[np.ix_([self.e.get(w, -1) for w in e], [self.f.get(w, -1) for w in f])]


class Odds:
    """The vocabulary of one pair of documents with its translations, and what follows for its sentences."""

    def __init__(self, fr: list[list[str]], en: list[list[str]], table: dict, groups: dict, background: dict, least: float, whole: Whole | None = None):
        self.f = {w: k for k, w in enumerate(dict.fromkeys(w for s in fr for w in s))}
        self.e = {w: k for k, w in enumerate(dict.fromkeys(w for s in en for w in s))}
        self.t = np.zeros((len(self.e), len(self.f))) if whole is None else whole.of(self.f, self.e)
        for w, k in self.f.items():
            for v, x in table.get(w, {}).items() if whole is None else ():
                if v in self.e:
                    self.t[self.e[v], k] = x
            for g in groups.get(w, ()):
                for v in groups.get(g, ()):
                    if v in self.e:
                        self.t[self.e[v], k] = max(self.t[self.e[v], k], LEXICON)
            if w in self.e:
                self.t[self.e[w], k] = max(self.t[self.e[w], k], SAME)
        self.in_f = _indicator(fr, self.f)
        self.in_e = _indicator(en, self.e)
        self.p = np.array([background.get(w, least) for w in self.e]).reshape(-1, 1)
        self.n, self.m = len(fr), len(en)
        self.size = np.array([max(1, len(s)) for s in fr], float)

    def emissions(self) -> np.ndarray:
        """Log odds over the background of every target sentence under every source span: [span length - 1, start, target]."""
        out = np.zeros((SPANS, self.n, self.m))
        mass = self.t @ self.in_f.T
        total, size = mass, self.size
        for k in range(min(SPANS, self.n)):
            if k:
                total, size = total[:, :-1] + mass[:, k:], size[:-1] + self.size[k:]
            odds = np.log(BACKGROUND + (1 - BACKGROUND) * np.minimum(total, 1.0) / size / self.p)
            out[k, : self.n - k] = (self.in_e @ odds).T
        return out


def _indicator(sents: list[list[str]], ids: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(sents), len(ids)))
    out[np.repeat(np.arange(len(sents)), [len(s) for s in sents]), [ids[w] for s in sents for w in s]] = 1.0
    return out


@lru_cache(1)
def _window() -> list[tuple[int, float]]:
    """(step, log odds) of going on ``step`` sentences from where one stands; farther steps cost as much as the farthest here."""
    return [(d, JUMPS.get(d + 1, JUMP_FLOOR - 0.02 * abs(d))) for d in range(-REACH, REACH + 1)]


def _reached(best: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The best log odds of standing before each source sentence, and where one came from (of equals the earliest).

    ``REACH`` steps are looked at one by one, all that is farther through one maximum over all places, since it costs the
    same from anywhere; so a row takes time in proportion to its length.
    """
    far = int(best.argmax())
    into, came = np.full(n, best[far] + JUMP_FLOOR - 0.02 * REACH), np.full(n, far, np.int32)
    for d, odds in _window():
        lo, hi = max(0, d), min(n, n + 1 + d)  # place lo - d -> sentence lo
        if lo >= hi:
            continue
        value = best[lo - d : hi - d] + odds
        place = np.arange(lo - d, hi - d, dtype=np.int32)
        better = (value > into[lo:hi]) | ((value == into[lo:hi]) & (place < came[lo:hi]))
        into[lo:hi] = np.where(better, value, into[lo:hi])
        came[lo:hi] = np.where(better, place, came[lo:hi])
    return into, came


@lru_cache(64)
def _jumps(n: int) -> np.ndarray:
    """The same log odds for short texts, as a table: [place, sentence]."""
    step = np.arange(n)[None, :] - np.arange(n + 1)[:, None]
    table = JUMP_FLOOR - 0.02 * np.minimum(REACH, np.abs(step))
    for d, odds in JUMPS.items():
        table[step == d - 1] = odds
    return table


def decode(score: np.ndarray, n: int, m: int) -> list[tuple[int, int] | None]:
    """Viterbi: the source span (first, last) of each target sentence, or None for an addition."""
    jump = _jumps(n) if n <= 2 * REACH else None
    cols = np.arange(n)
    best = np.full(n + 1, -np.inf)
    best[0] = 0.0
    trail = []
    spans = min(SPANS, n)
    price = SPAN_PRICE * np.arange(spans)[:, None]
    from_ = np.arange(n + 1)[None, :] - np.arange(1, spans + 1)[:, None]  # [span length - 1, place behind it] -> its first sentence
    inside = from_ >= 0
    gains = np.where(inside[:, :, None], score[np.arange(spans)[:, None], from_], -np.inf).transpose(2, 0, 1).copy()
    options = np.empty((spans + 1, n + 1))  # null keeps the place, and comes first
    for j in range(m):
        if jump is None:
            into, came = _reached(best, n)
        else:
            reach = best[:, None] + jump
            came = reach.argmax(0)
            into = reach[came, cols]
        options[0] = best
        options[1:] = into[from_] + gains[j] - NULL - price
        length = options.argmax(0).astype(np.int8)  # of equals the first
        best = options.max(0)
        trail.append((length, came))
    at = int(best.argmax())
    result: list[tuple[int, int] | None] = [None] * m
    for j in range(m - 1, -1, -1):
        length, came = trail[j]
        if length[at]:
            lo = at - int(length[at])
            result[j] = (lo, at - 1)
            at = int(came[lo])
    return result


def align_pair(odds: Odds) -> list[tuple[int, int]]:
    """(source sentence, target sentence) pairs."""
    if not odds.n or not odds.m or not odds.f or not odds.e:
        return []
    score = odds.emissions()
    result = []
    for j, span in enumerate(decode(score, odds.n, odds.m)):
        if span is None:
            continue
        lo, hi = span
        whole = score[hi - lo, lo, j]
        for i in range(lo, hi + 1):
            if lo == hi:
                rest = -np.inf
            elif i == lo:
                rest = score[hi - lo - 1, lo + 1, j]
            elif i == hi:
                rest = score[hi - lo - 1, lo, j]
            else:
                rest = max(score[0, lo, j], score[0, hi, j])
            if whole - rest >= NEED:
                result.append((i, j))
    return result


class Local:
    """What a task needs to know of the tables; filled from a broadcast, or per pair of documents from joined columns."""

    def __init__(self, table: list, lexicon: list, background: list, least: float, whole: type[Whole] | None = None):
        self.table: dict = defaultdict(dict)
        for f, e, x in table:
            self.table[f][e] = x
        self.groups: dict = defaultdict(list)
        for form, grp in lexicon:
            self.groups[form].append(grp)
            self.groups[grp].append(form)
        self.background = dict(background)
        self.least = least
        self.whole = whole(self.table) if whole and whole.fits(self.table) else None  # else word by word, with the same results

    def odds(self, r: dict) -> Odds:
        return Odds(_of_lines(r["fr"]), _of_lines(r["en"]), self.table, self.groups, self.background, self.least, self.whole)


def expected_counts(pairs: DataFrame, t: DataFrame, background: DataFrame, lex: DataFrame) -> DataFrame:
    """(f, e, n): shares of the target words among the source words they are aligned with."""

    def work(rows: Iterator[dict], odds_of) -> Iterator[tuple]:
        held = Sums()
        for r in rows:
            odds = odds_of(r)
            linked = align_pair(odds)
            if not linked:
                continue
            link = np.zeros((odds.m, odds.n))
            for i, j in linked:
                link[j, i] = 1.0
            source = np.minimum(link @ odds.in_f, 1.0)  # words of the source sentences of each target sentence
            weight = odds.t + 0.002
            share = odds.in_e / np.maximum(source @ weight.T, 1e-12)
            yield from held.add(list(odds.f), list(odds.e), weight.T * (source.T @ share))
        yield from held.flush()

    return _summed(over_pairs(pairs, t, background, lex, work, "f string, e string, n double"))


def align(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> DataFrame:
    """(fr_id, fr_sentence, en_id, en_sentence)."""
    pairs = cut(document_pairs(spark, sf_dir))
    counts = first_counts(pairs)
    lex = cut(lexicon(spark, sf_dir))
    singles = counts.where("f IS NULL").select("e", "n")
    total = F.broadcast(singles.agg(F.sum("n").alias("total")))  # one row
    background = cut(singles.crossJoin(total).select("e", (F.col("n") / F.col("total")).alias("p")))
    t = cut(table(counts, excess=True))
    for _ in range(rounds):
        t = cut(table(expected_counts(pairs, t, background, lex), excess=False))

    def work(rows: Iterator[dict], odds_of) -> Iterator[tuple]:
        for r in rows:
            for i, j in align_pair(odds_of(r)):
                yield r["fr_id"], i, r["en_id"], j

    return over_pairs(pairs, t, background, lex, work, "fr_id long, fr_sentence int, en_id long, en_sentence int")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("fr_id") < F.col("en_id")
    return align(spark, sf_dir).select(
        F.least("fr_id", "en_id").alias("witness_a"),
        F.when(first, F.col("fr_sentence")).otherwise(F.col("en_sentence")).alias("sentence_a"),
        F.greatest("fr_id", "en_id").alias("witness_b"),
        F.when(first, F.col("en_sentence")).otherwise(F.col("fr_sentence")).alias("sentence_b"),
    )


QUERIES = {"p4_found": p4_found}

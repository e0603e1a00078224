"""Problem 7: held-out evaluation passages inside a training corpus.

Method: pigeonhole edit matching. An item is a sequence of normalised words; each window of ``run`` words may differ
in ``budget`` words, so it is laid over consecutive pieces of ``run / (budget + 1)`` words, one of which must occur
unchanged. Windows start at any word, and so do pieces. All pieces stand in one Aho-Corasick automaton that reads each
document once; every hit is verified with Myers' bit-parallel distance, over words as symbols, between the item's windows
of which it is a piece and the stretch of the document around the hit. ``p7_found`` keeps the windows of distance 0. An
item of fewer words than ``run``, but of ``SHORTEST`` at least, is one window of its own length.

Items are dealt by hash into blocks whose pieces have about ``block_chars`` characters. The driver holds one block at a
time, each is one pass over the documents, and the automaton never grows with the evaluation set.

Defined results: null or empty texts match nothing; an item of fewer than ``SHORTEST`` words has no window; equal items
each report; a document or item given twice counts once; extra columns are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, cut, read_table, spread

RUN = 12
BUDGET = 1
SHORTEST = 6  # words of an item that is looked for whole
BLOCK_CHARS = 4_000_000

_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_MARK = regex.compile(r"\p{Mn}+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case and accents."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_MARK.sub("", unicodedata.normalize("NFD", text)).lower())


def myers(pattern: list, text: list) -> int:
    """Least edit distance between ``pattern`` and any stretch of ``text`` (bit-parallel; words are symbols)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    ones, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & ones), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & ones, (mh << 1) & ones
        pv, mv = mh | (~(xv | ph) & ones), ph & xv
        best = min(best, score)
    return best


class Matcher:
    """The automaton of one block of items, and the search in one document."""

    def __init__(self, items: list[tuple[int, str]], run: int, budget: int, shortest: int | None = None):
        import ahocorasick

        self.run, self.budget = run, budget
        self.items = {item: w for item, t in items if len(w := words(t)) >= min(run, shortest or run)}
        self.shortest_piece = min((self.piece(w) for w in self.items.values()), default=0)
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, w in self.items.items():
            piece = self.piece(w)
            for k in range(len(w) - piece + 1):
                at[" " + " ".join(w[k : k + piece]) + " "].append((item, k))
        self.automaton = None
        if at:
            self.automaton = ahocorasick.Automaton()
            for text, places in at.items():
                self.automaton.add_word(text, (len(text) - 1, places))
            self.automaton.make_automaton()

    def piece(self, w: list[str]) -> int:
        """Words of a piece of this item."""
        return max(1, min(self.run, len(w)) // (self.budget + 1))

    def search(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """item -> (least distance of a window, its place in the item, its place in the document)."""
        found: dict[int, tuple[int, int, int]] = {}
        w = words(text)
        if self.automaton is None or len(w) < self.shortest_piece:
            return found
        line = " " + " ".join(w) + " "
        starts = None
        seen: set[tuple[int, int, int]] = set()
        for end, (length, places) in self.automaton.iter(line):
            if starts is None:
                starts, p = {}, 0
                for i, x in enumerate(w):
                    starts[p] = i
                    p += len(x) + 1
            here = starts[end - length]
            for item, k in places:
                if found.get(item, (1,))[0] == 0:
                    continue
                iw = self.items[item]
                run, piece = min(self.run, len(iw)), self.piece(iw)
                for before in range(0, (self.budget + 1) * piece, piece):  # words of the window before the piece
                    lo, doc_lo = k - before, here - before
                    if not 0 <= lo <= len(iw) - run or (item, lo, doc_lo) in seen:
                        continue
                    seen.add((item, lo, doc_lo))
                    stretch = w[max(0, doc_lo - self.budget) : max(0, doc_lo + run + self.budget)]
                    d = myers(iw[lo : lo + run], stretch)
                    if d <= self.budget and (item not in found or d < found[item][0]):
                        found[item] = (d, lo, max(0, doc_lo))
                        if d == 0:
                            break
        return found


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, budget: int = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_word, doc_word, item_words): items of which a window stands in a document, and the best one."""
    source = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text"))
    schema = "doc_id long, item_id long, distance int, item_word int, doc_word int, item_words int"
    held = items.where(F.col("item_text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "item_text").distinct()
    pieces = run // (budget + 1)  # each word stands in so many
    chars = held.agg(F.coalesce(F.sum(F.char_length("item_text").cast("long")), F.lit(0))).first()[0] * pieces
    blocks = max(1, -(-chars // block_chars))

    def search(number: int) -> DataFrame:
        own = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        sent = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["item_text"]) for r in own.collect()])  # about block_chars / pieces characters

        def run_partition(rows: Iterator[dict]) -> Iterator[tuple]:
            matcher = Matcher(sent.value, run, budget, SHORTEST)
            for r in rows:
                for item, (d, lo, at) in matcher.search(r["text"]).items():
                    yield r["doc_id"], item, d, lo, at, len(matcher.items[item])

        return arrow_rows(source, run_partition, schema)

    return reduce(DataFrame.union, [search(b) if blocks == 1 else cut(search(b)) for b in range(blocks)])


def leaks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_item"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and altered leaks, one row per document and item with the least distance."""
    return leaks_of(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with a window of ``RUN`` words at distance 0."""
    return leaks_of(spark, sf_dir).where(f"distance = 0 AND item_words >= {RUN}").select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
_GRAMS = """
SELECT {id} AS id, list_aggregate(w[i:i+11], 'string_agg', ' ') AS gram
FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i
      FROM (SELECT DISTINCT {id}, regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM {table}))
"""
SQL = {
    "p7_found": f"WITH d AS ({_GRAMS.format(id='doc_id', text='text', table='documents')}), e AS ({_GRAMS.format(id='item_id', text='item_text', table='eval_item')}) SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d JOIN e USING (gram)"
}

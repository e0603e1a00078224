"""Problem 3: cutting oversized items at natural boundaries.

Method: agglomerative merging. The text is first cut at every boundary there is, down to words (and inside a word only
where it is longer than a piece may be). Adjacent segments then stand in a heap under the strength of the boundary
between them; the weakest boundary is merged away first as long as the merged segment and the overlap put before it
fit the limit. What is left are pieces separated by the strongest boundaries that the limit allows.

Defined results: null text gives no piece; a text within the limit (the empty one too) gives one piece; lengths are
code points; equal boundaries merge the smaller neighbours first, then the earlier ones; repeated rows give repeated
pieces (``p3_pieces`` counts a repeated delivery once); extra columns are dropped.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, read_table, spread

LIMIT = 3000
OVERLAP = 200

WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+\Z")
_NEWLINE = re.compile(r"\r\n|\r|\n|\f| | ")


def _strength(atom: str) -> int:
    """Of the boundary after ``atom``, whose trailing blanks belong to it."""
    blanks = atom[len(atom.rstrip()) :]
    breaks = len(_NEWLINE.findall(blanks))
    if breaks > 1 or "\f" in blanks:
        return PARAGRAPH
    if breaks:
        return LINE
    return SENTENCE if _SENTENCE_END.search(atom) else WORD


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments and the strength of the boundary before each (0: inside a word)."""
    starts, strengths, before = [], [], PARAGRAPH
    for m in re.finditer(r"\S+\s*|\s+", text):
        lo, hi = m.span()
        for k in range(lo, hi, most):
            starts.append(k)
            strengths.append(before if k == lo else 0)
        before = _strength(text[lo:hi])
    return starts, strengths


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(own_from, own_to, from)`` of each piece: it covers [own_from, own_to) and repeats [from, own_from).

    The own parts tile the text; ``own_to - from`` is at most ``limit`` and ``own_from - from`` at most ``overlap``.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    overlap = max(0, min(overlap, limit // 2))
    most = limit - overlap
    starts, strengths = _atoms(text, most)
    count = len(starts)
    ends = starts[1:] + [n]
    following, previous = list(range(1, count + 1)), list(range(-1, count - 1))
    alive = [True] * count
    heap = [(strengths[i], ends[i] - starts[i - 1], i) for i in range(1, count)]
    heapq.heapify(heap)
    while heap:
        strength, size, right = heapq.heappop(heap)
        if not alive[right]:
            continue
        left = previous[right]
        now = ends[right] - starts[left]
        if now + (overlap if starts[left] else 0) > limit:
            continue  # segments only grow, so this boundary stays
        if now != size:
            heapq.heappush(heap, (strength, now, right))
            continue
        ends[left], alive[right] = ends[right], False
        following[left] = following[right]
        if following[right] < count:
            previous[following[right]] = left
    result, i = [], 0
    while i < count:
        lo = starts[i]
        result.append((lo, ends[i], _overlap_start(text, lo, overlap)))
        i = following[i]
    return result


def _overlap_start(text: str, lo: int, overlap: int) -> int:
    """The first natural boundary within ``overlap`` characters before ``lo``: a word start, else a bare cut."""
    if not lo or not overlap:
        return lo
    first = max(0, lo - overlap)
    if first == 0 or text[first - 1].isspace():
        return first
    m = re.compile(r"\s\S").search(text, first, lo)
    return m.start() + 1 if m else first


def split_text(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every value of ``text``: key, piece_no, n_pieces, char_from, char_to, overlap_chars, piece_text."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            t = r["t"]
            if t is None:
                continue
            cuts = pieces(t, limit, overlap)
            for no, (own, to, start) in enumerate(cuts):
                yield r["k"], no, len(cuts), start, to, own - start, t[start:to]

    source = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = df.schema[key].dataType.simpleString()
    return arrow_rows(source, run, f"{key} {kind}, piece_no int, n_pieces int, char_from int, char_to int, overlap_chars int, piece_text string", flush=256)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_text(read_table(spark, sf_dir, "witness"), "witness_id").dropDuplicates(["witness_id", "piece_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses that the operator had to cut."""
    cuts = split_text(read_table(spark, sf_dir, "witness"), "witness_id")
    return cuts.where("n_pieces > 1").select("witness_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {"p3_found": "SELECT DISTINCT witness_id FROM witness WHERE length(text) > 3000"}

"""From the tokens of two witnesses to the variations between them, as plain functions; no Spark in here."""

from __future__ import annotations

from collections import Counter
from unicodedata import normalize

from textloom.config import LIMITS, Config
from textloom.functions.text import OMITTED
from textloom.operators import kernels
from textloom.operators.scan import Tokens

INSERTION, DELETION, SUBSTITUTION, MOVE, SPELLING = "insertion", "deletion", "substitution", "transposition", "variantSpelling"
TYPES = (INSERTION, DELETION, SUBSTITUTION, MOVE, SPELLING)


class Variation:
    """One variation: token ranges [a_lo, a_hi) and [b_lo, b_hi), None on the side that has nothing."""

    __slots__ = ("kind", "a_lo", "a_hi", "b_lo", "b_hi", "within", "anchor", "certain", "shown")

    def __init__(self, kind, a_lo=None, a_hi=None, b_lo=None, b_hi=None, within=False, anchor=None, certain=True, shown=None):
        self.kind, self.a_lo, self.a_hi, self.b_lo, self.b_hi = kind, a_lo, a_hi, b_lo, b_hi
        self.within, self.anchor, self.certain, self.shown = within, anchor, certain, shown


def comparable(t: Tokens) -> list[int]:
    return [i for i, x in enumerate(t.normalized) if x]


def keys_of(t: Tokens, at: list[int], pivots: dict[str, str]) -> list[str]:
    """What the tokens ``at`` are compared by: the pivot of a translation group, else the normal form, in composed form."""
    forms = [t.normalized[i] for i in at]
    if pivots:
        forms = [pivots.get(x.lower(), x) for x in forms]
    return [x if x.isascii() else normalize("NFC", x) for x in forms]


def _span(indices: list[int]) -> tuple[int | None, int | None]:
    return (min(indices), max(indices) + 1) if indices else (None, None)


def classified(segments: list[kernels.Segment], at: list[int], bt: list[int], overlay=None) -> list[Variation]:
    """Runs of operations that aren't matches, whole moves before what changed inside them, and what ``overlay`` adds.

    The place of an insertion is the last match before it in its part of the text; the count starts anew after a move.
    """
    longest = max(len(at), len(bt))
    result: list[Variation] = []
    last_a = last_b = None
    for s in segments:
        moved = s.move is not None
        if moved:
            a = [at[i] for _, i, _ in s.ops if i >= 0]
            b = [bt[j] for _, _, j in s.ops if j >= 0]
            certain = len(a) > LIMITS.free_length or longest <= LIMITS.confident_witness
            result.append(Variation(MOVE, *_span(a), *_span(b), certain=certain))
        gone: list[int] = []
        come: list[int] = []
        for op, i, j in [*s.ops, (None, -1, -1)]:
            if op is None or op == "match":
                if gone or come:
                    kind = SUBSTITUTION if gone and come else INSERTION if come else DELETION
                    anchor = None if gone else -1 if last_a is None else last_a
                    result.append(Variation(kind, *_span(gone), *_span(come), within=moved, anchor=anchor))
                    gone, come = [], []
                if op is not None:
                    if overlay is not None:
                        result += overlay(at[i], bt[j], last_a, last_b, moved)
                    last_a, last_b = at[i], bt[j]
                continue
            if i >= 0:
                gone.append(at[i])
            if j >= 0:
                come.append(bt[j])
        if moved:
            last_a = last_b = None
    return result


def overlays(x: Tokens, y: Tokens, forms: bool, signs: bool):
    """What differs at and before two matched words without being a variation: punctuation first, then spelling or case."""

    def between(t: Tokens, lo: int, hi: int) -> list[str]:
        return [t.surface[k] for k in range(lo + 1, hi) if not t.is_word[k]]

    def found(a: int, b: int, last_a: int | None, last_b: int | None, moved: bool) -> list[Variation]:
        result = []
        if signs and last_a is not None and last_b is not None:
            p, q = between(x, last_a, a), between(y, last_b, b)
            if "".join(p) != "".join(q):
                result.append((" ".join(p) or OMITTED, " ".join(q) or OMITTED))
        if forms and x.normalized[a] == y.normalized[b] and x.surface[a] != y.surface[b]:
            result.append((x.surface[a], y.surface[b]))
        return [Variation(SPELLING, a, a + 1, b, b + 1, moved, shown=shown) for shown in result]

    return found


def recovered(found: list[Variation], x: Tokens, y: Tokens, pivots: dict[str, str]) -> list[Variation]:
    """Turn words deleted in one place and inserted in another, once each, into moves; the rest of both stays.

    Words pair if their key is unmatched just once on either side; neighbours in both texts form a block; a block
    stands if its words are unique in both witnesses, if it has several words, or if it moved little. What is left of a
    deletion or insertion spans its outermost words; the move follows what is left of its deletion.
    """
    key = lambda t, i: pivots.get(t.normalized[i].lower(), t.normalized[i]).lower()
    gone: dict[str, list[tuple[int, int]]] = {}
    come: dict[str, list[tuple[int, int]]] = {}
    for n, v in enumerate(found):
        if v.within or v.kind not in (DELETION, INSERTION):
            continue
        side, t, lo, hi = (gone, x, v.a_lo, v.a_hi) if v.kind == DELETION else (come, y, v.b_lo, v.b_hi)
        for i in range(lo, hi):
            if t.is_word[i] and t.normalized[i]:
                side.setdefault(key(t, i), []).append((i, n))
    nx, ny = len(x), len(y)
    single = []
    for k, places in gone.items():
        other = come.get(k, ())
        if len(places) == 1 == len(other):
            off = kernels.diagonal_deviation(places[0][0], other[0][0], nx, ny)
            if off <= LIMITS.max_move:
                single.append((*places[0], *other[0], off, k))
    if not single:
        return found
    asked = {s[5] for s in single}
    times = [Counter(k for i in range(len(t)) if t.is_word[i] and t.normalized[i] and (k := key(t, i)) in asked) for t in (x, y)]
    near = kernels.move_tolerance(nx, ny)
    blocks: list[list[tuple]] = []
    for di, dv, si, sv, off, k in sorted(single):
        unique = times[0][k] == 1 == times[1][k]
        last = blocks[-1][-1] if blocks else None
        if last and (di, dv, si, sv) == (last[0] + 1, last[1], last[2] + 1, last[3]):
            blocks[-1].append((di, dv, si, sv, off, unique))
        else:
            blocks.append([(di, dv, si, sv, off, unique)])
    out: dict[int, set[int]] = {}
    moves: dict[int, list[Variation]] = {}
    for block in blocks:
        unique = all(w[5] for w in block)
        if not (unique or len(block) > 1 or max(w[4] for w in block) <= LIMITS.local_move):
            continue
        first, last = block[0], block[-1]
        out.setdefault(first[1], set()).update(w[0] for w in block)
        out.setdefault(first[3], set()).update(w[2] for w in block)
        certain = unique and all(w[4] <= near for w in block)
        moves.setdefault(first[1], []).append(Variation(MOVE, first[0], last[0] + 1, first[2], last[2] + 1, certain=certain))
    result = []
    for n, v in enumerate(found):
        if n in out:
            deleted = v.kind == DELETION
            left = [i for i in range(*((v.a_lo, v.a_hi) if deleted else (v.b_lo, v.b_hi))) if i not in out[n]]
            if left and deleted:
                v.a_lo, v.a_hi = _span(left)
            elif left:
                v.b_lo, v.b_hi = _span(left)
            if left:
                result.append(v)
        else:
            result.append(v)
        result += moves.get(n, ())
    return result


def variations(x: Tokens, y: Tokens, config: Config, pivots: dict[str, str], accidentals: bool, punctuation: bool) -> list[Variation]:
    """The variations between two witnesses, in their order."""
    at, bt = comparable(x), comparable(y)
    a, b = keys_of(x, at, pivots), keys_of(y, bt, pivots)
    overlay = overlays(x, y, accidentals, punctuation) if accidentals or punctuation else None
    if a == b and overlay is None:
        return []
    segments = kernels.align(a, b, config.anchor_length, config.scores, [x.page[i] for i in at], [y.page[i] for i in bt])
    return recovered(classified(segments, at, bt, overlay), x, y, pivots)


def place(t: Tokens, lo: int | None, hi: int | None) -> tuple | None:
    """(page, line, end_line, first_word, last_word, char_from, char_to, cite) of the tokens [lo, hi)."""
    if lo is None:
        return None
    last = hi - 1
    page, line, end, first_word, last_word = t.page[lo], t.line[lo], t.line[last], t.word_index[lo], t.word_index[last]
    return page, line, end, first_word, last_word, min(t.char_from[lo], t.char_from[last]), max(t.char_to[lo], t.char_to[last]), cited(page, line, end, first_word, last_word)


def cited(page: int, line: int, end: int, first_word: int, last_word: int) -> str:
    """The citation that ``functions.text.cite`` makes of the same places."""
    if line != end:
        return f"p.{page + 1} · lines {line + 1}–{end + 1} · words {first_word + 1}…{last_word + 1}"
    words = f"word {first_word + 1}" if first_word == last_word else f"words {first_word + 1}–{last_word + 1}"
    return f"p.{page + 1} · line {line + 1} · {words}"

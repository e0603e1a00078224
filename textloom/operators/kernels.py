"""The sequential steps of alignment, as plain functions over lists; no Spark in here.

Short stretches are aligned in plain Python; for longer ones keys are interned to integers, rows of the score matrix are
filled by numpy, and the direction of each cell is kept in one byte. At most ``LIMITS.held_cells`` directions are held at
a time: beyond that the rows where each block of rows begins are kept, and a block is filled again when the way back
reaches it, which gives the same alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

from textloom.config import LIMITS, PROSE, Scores

Op = tuple[str, int, int]  # (match | substitute | delete | insert, index in a or -1, index in b or -1)


def intern(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    ids: dict = {}
    number = lambda seq: np.fromiter((ids.setdefault(x, len(ids)) for x in seq), np.int64, len(seq))
    return number(a), number(b)


def needleman_wunsch(a: Sequence, b: Sequence, scores: Scores = PROSE) -> list[Op]:
    """Global alignment; of equal paths the one that is diagonal, else deletes, else inserts, read from the end."""
    n, m = len(a), len(b)
    if not n:
        return [("insert", -1, j) for j in range(m)]
    if not m:
        return [("delete", i, -1) for i in range(n)]
    if n == m and scores.match > max(0, scores.mismatch) and scores.gap < 0 and list(a) == list(b):
        return [("match", i, i) for i in range(n)]
    return _short(a, b, scores) if n * m <= LIMITS.short_cells else _align(*intern(a, b), scores)


def _short(a: Sequence, b: Sequence, s: Scores) -> list[Op]:
    gap, m = s.gap, len(b)
    above = [j * gap for j in range(m + 1)]
    ways = [b""]
    for i, key in enumerate(a):
        left = (i + 1) * gap
        row, way = [left], bytearray(m + 1)
        for j, other in enumerate(b):
            diagonal = above[j] + (s.match if key == other else s.mismatch)
            up, left = above[j + 1] + gap, left + gap
            best = max(diagonal, up, left)
            if best != diagonal:
                way[j + 1] = 1 if best == up else 2
            row.append(best)
            left = best
        ways.append(way)
        above = row
    return _back(len(a), m, lambda i, j: ways[i][j], lambda i, j: a[i] == b[j])


def _back(n: int, m: int, way, same) -> list[Op]:
    """The operations on the way back from the far corner: 0 diagonal, 1 up, 2 left."""
    ops: list[Op] = []
    i, j = n, m
    while i or j:
        step = way(i, j) if i and j else (1 if i else 2)
        if step == 0:
            i, j = i - 1, j - 1
            ops.append(("match" if same(i, j) else "substitute", i, j))
        elif step == 1:
            i -= 1
            ops.append(("delete", i, -1))
        else:
            j -= 1
            ops.append(("insert", -1, j))
    ops.reverse()
    return ops


def _align(x: np.ndarray, y: np.ndarray, s: Scores) -> list[Op]:
    n, m = len(x), len(y)
    ramp = np.arange(m + 1, dtype=np.int64) * s.gap

    def fill(above: np.ndarray, lo: int, hi: int, way: np.ndarray | None) -> np.ndarray:
        """The scores of row ``hi`` from those of row ``lo``, and the directions of the rows after ``lo``."""
        for i in range(lo + 1, hi + 1):
            diagonal = above[:-1] + np.where(y == x[i - 1], s.match, s.mismatch)
            up = above[1:] + s.gap
            best = np.empty(m + 1, np.int64)
            best[0] = i * s.gap
            best[1:] = np.maximum(diagonal, up)
            row = np.maximum.accumulate(best - ramp) + ramp  # a run of insertions costs the same per step
            if way is not None:
                way[i - lo, 1:] = np.where(row[1:] == diagonal, 0, np.where(row[1:] == up, 1, 2))
            above = row
        return above

    step = max(1, min(n, LIMITS.held_cells // (m + 1)))  # rows of a block
    begins = [ramp.copy()]
    for lo in range(0, n - step, step):
        begins.append(fill(begins[-1], lo, lo + step, None))
    held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def way(i: int, j: int) -> int:
        nonlocal held
        block = (i - 1) // step
        if held[0] != block:
            rows = np.zeros((step + 1, m + 1), np.int8)
            fill(begins[block], block * step, min(n, (block + 1) * step), rows)
            held = block, rows
        return held[1][i - block * step, j]

    return _back(n, m, way, lambda i, j: x[i] == y[j])


def banded(a: Sequence, b: Sequence, band: int, scores: Scores = PROSE) -> tuple[list[Op], bool]:
    """Alignment within ``band`` cells of the diagonal to the far corner, and whether an inner row touched the edge."""
    x, y = intern(a, b)
    n, m = len(x), len(y)
    if not n or not m:
        return needleman_wunsch(a, b, scores), False
    w = max(band, abs(n - m) + 1)
    lows = [max(0, i * m // n - w) for i in range(n + 1)]
    highs = [min(m, i * m // n + w) for i in range(n + 1)]
    least = np.int64(-(1 << 60))
    above = np.arange(lows[0], highs[0] + 1, dtype=np.int64) * scores.gap
    ways: list[np.ndarray] = [np.full(len(above), 2, np.int8)]
    for i in range(1, n + 1):
        lo, hi, plo, phi = lows[i], highs[i], lows[i - 1], highs[i - 1]
        width = hi - lo + 1
        cols = np.arange(lo, hi + 1)

        def shifted(back: int) -> np.ndarray:
            out = np.full(width, least)
            c = cols - back
            ok = (c >= plo) & (c <= phi)
            out[ok] = above[c[ok] - plo]
            return out

        equal = np.zeros(width, bool)
        inner = cols >= 1
        equal[inner] = y[cols[inner] - 1] == x[i - 1]
        diagonal = shifted(1) + np.where(equal, scores.match, scores.mismatch)
        diagonal[~inner] = least
        up = shifted(0) + scores.gap
        best = np.maximum(diagonal, up)
        if lo == 0:
            best[0] = i * scores.gap
        ramp = cols * scores.gap
        row = np.maximum.accumulate(best - ramp) + ramp
        ways.append(np.where(row == diagonal, 0, np.where(row == up, 1, 2)).astype(np.int8))
        above = row
    touched = False

    def way(i: int, j: int) -> int:
        nonlocal touched
        touched = touched or (i < n and (j <= lows[i] or j >= highs[i]))
        return ways[i][j - lows[i]]

    ops = _back(n, m, way, lambda i, j: x[i] == y[j])
    return ops, touched or (n > 1 and ops[0][0] == "delete")  # that path runs along the first column


def bounded(a: Sequence, b: Sequence, scores: Scores = PROSE) -> list[Op]:
    """Exact below ``LIMITS.full_cells`` cells; above, a band that doubles while the path rides its edge."""
    if len(a) * len(b) <= LIMITS.full_cells:
        return needleman_wunsch(a, b, scores)
    band = LIMITS.initial_band
    while True:
        ops, touched = banded(a, b, band, scores)
        if not touched or band >= LIMITS.max_band:
            return ops
        band = min(2 * band, LIMITS.max_band)


def unique_grams(keys: Sequence, n: int) -> dict:
    """n-gram -> its only position, for grams that occur once."""
    seen: dict = {}
    for i in range(len(keys) - n + 1):
        g = tuple(keys[i : i + n])
        seen[g] = -1 if g in seen else i
    return {g: i for g, i in seen.items() if i >= 0}


def anchors(a: Sequence, b: Sequence, n: int) -> list[tuple[int, int]]:
    """Positions of the n-grams that occur once in either sequence; of those that overlap in ``a`` the first."""
    if n <= 0 or len(a) < n or len(b) < n:
        return []
    other = unique_grams(b, n)
    result, free = [], 0
    for g, i in sorted(unique_grams(a, n).items(), key=lambda x: x[1]):
        if i >= free and g in other:
            result.append((i, other[g]))
            free = i + n
    return result


def adaptive_anchors(a: Sequence, b: Sequence, start: int = 3) -> tuple[int, list[tuple[int, int]]]:
    """(n, anchors) of the greatest n with enough anchors, else of the densest set."""
    wanted = max(1, min(max(1, min(len(a), len(b))) // 50, 8))
    best: tuple[int, list[tuple[int, int]]] = (start, [])
    for n in range(max(LIMITS.min_anchor_length, start), LIMITS.min_anchor_length - 1, -1):
        found = anchors(a, b, n)
        if len(found) >= wanted:
            return n, found
        if len(found) > len(best[1]):
            best = n, found
    return best


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    return _walk(back, piles[-1] if piles else -1)


def _walk(back: Sequence[int], i: int) -> list[int]:
    result = []
    while i >= 0:
        result.append(i)
        i = back[i]
    return result[::-1]


def heaviest_increasing(values: Sequence[int], weights: Sequence[int]) -> list[int]:
    """Indices of a strictly increasing subsequence of greatest weight, in O(n log n).

    A prefix-maximum tree over ranks holds (weight, -index), so equal weights keep the earliest predecessor, and the
    chain that ends first wins.
    """
    order = {v: r + 1 for r, v in enumerate(sorted(set(values)))}
    size = len(order)
    tree: list[tuple[int, int]] = [(0, 1)] * (size + 1)
    back: list[int] = []
    best, end = 0, -1
    for i, (v, w) in enumerate(zip(values, weights)):
        k, top = order[v] - 1, (0, 1)
        while k:
            top = max(top, tree[k])
            k -= k & -k
        back.append(-top[1] if top[0] else -1)
        total = top[0] + w
        if total > best:
            best, end = total, i
        k = order[v]
        while k <= size:
            tree[k] = max(tree[k], (total, -i))
            k += k & -k
    return _walk(back, end)


def diagonal_deviation(a: int, b: int, len_a: int, len_b: int) -> int:
    """Distance of ``b`` from where ``a`` would stand if both texts ran evenly (halves away from zero)."""
    return abs(b - int(a * len_b / len_a + 0.5)) if len_a > 0 and len_b > 0 else 0


def move_tolerance(len_a: int, len_b: int) -> int:
    return min(LIMITS.max_move, max(LIMITS.min_move, int(LIMITS.move_fraction * max(len_a, len_b))))


def block_tolerance(length: int) -> int:
    return LIMITS.block_tolerance + LIMITS.per_token * max(0, length - LIMITS.free_length)


def move_is_certain(length: int, len_a: int, len_b: int) -> bool:
    return length > LIMITS.free_length or max(len_a, len_b) <= LIMITS.confident_witness


def _resync(a: Sequence, b: Sequence, i: int, j: int, step: int, on_a: Sequence, on_b: Sequence) -> tuple[int, int] | None:
    """The nearest equal pair at most ``bridge_gap`` steps from (i, j) on either side, not across the spine."""
    reach_b = []
    for d in range(LIMITS.bridge_gap + 1):
        k = j + step * d
        if not 0 <= k < len(b) or on_b[k]:
            break
        reach_b.append(k)
    best = None
    for d in range(LIMITS.bridge_gap + 1):
        k = i + step * d
        if not 0 <= k < len(a) or on_a[k]:
            break
        for e, q in enumerate(reach_b):
            if a[k] == b[q] and (best is None or d + e + abs(d - e) < best[0]):
                best = d + e + abs(d - e), k, q
    return best and (best[1], best[2])


def _grow(a: Sequence, b: Sequence, block: list[int], on_a: Sequence, on_b: Sequence) -> None:
    """Widen ``block`` = [a_lo, a_hi, b_lo, b_hi] over equal neighbours and bridged edits, never onto the spine."""
    for step in (-1, 1):
        while True:
            i, j = (block[0] - 1, block[2] - 1) if step < 0 else (block[1], block[3])
            if not (0 <= i < len(a) and 0 <= j < len(b)) or on_a[i] or on_b[j]:
                break
            to = (i, j) if a[i] == b[j] else _resync(a, b, i, j, step, on_a, on_b)
            if to is None:
                break
            if step < 0:
                block[0], block[2] = to
            else:
                block[1], block[3] = to[0] + 1, to[1] + 1


class Segment:
    """A stretch of the alignment: ``move`` is None or (a_lo, a_hi, b_lo, b_hi); ``ops`` point into whole sequences."""

    __slots__ = ("move", "ops")

    def __init__(self, ops: list[Op], move: tuple[int, int, int, int] | None = None):
        self.ops, self.move = ops, move


def _placed(ops: list[Op], at: Sequence[int], bt: Sequence[int]) -> list[Op]:
    return [(o, at[i] if i >= 0 else -1, bt[j] if j >= 0 else -1) for o, i, j in ops]


def align(a: Sequence, b: Sequence, anchor_length: int = 3, scores: Scores = PROSE, a_pages: Sequence[int] | None = None, b_pages: Sequence[int] | None = None) -> list[Segment]:
    """Alignment with moves: moved blocks first, in the order of ``a``, then the regions in order.

    Anchors on the heaviest increasing chain (same page counts double) form the spine; others near the diagonal are
    joined, grown and kept as moves if their length allows how far they moved. Gaps between spine anchors are aligned
    without the moved tokens.
    """
    len_a, len_b = len(a), len(b)
    n, pins = adaptive_anchors(a, b, anchor_length)
    if not pins:
        return [Segment(bounded(a, b, scores))]
    weights = [2 if a_pages is not None and b_pages is not None and a_pages[i] == b_pages[j] else 1 for i, j in pins]
    chain = heaviest_increasing([j for _, j in pins], weights)
    on_spine = set(chain)
    reach = move_tolerance(len_a, len_b)
    blocks: list[list[int]] = []
    for k, (i, j) in enumerate(pins):
        if k in on_spine or diagonal_deviation(i, j, len_a, len_b) > reach:
            continue
        last = blocks[-1] if blocks else None
        if last and i <= last[1] and last[2] <= j <= last[3]:
            last[1], last[3] = max(last[1], i + n), max(last[3], j + n)
        else:
            blocks.append([i, i + n, j, j + n])
    on_a, on_b = bytearray(len_a), bytearray(len_b)
    for k in chain:
        i, j = pins[k]
        on_a[i : i + n] = on_b[j : j + n] = b"\1" * n
    for block in blocks:
        _grow(a, b, block, on_a, on_b)
    kept = [x for x in blocks if diagonal_deviation(x[0], x[2], len_a, len_b) <= block_tolerance(x[1] - x[0])]
    gone_a, gone_b = bytearray(len_a), bytearray(len_b)
    result = []
    for lo_a, hi_a, lo_b, hi_b in kept:
        gone_a[lo_a:hi_a] = b"\1" * (hi_a - lo_a)
        gone_b[lo_b:hi_b] = b"\1" * (hi_b - lo_b)
        inner = needleman_wunsch(a[lo_a:hi_a], b[lo_b:hi_b], scores)
        result.append(Segment(_placed(inner, range(lo_a, hi_a), range(lo_b, hi_b)), (lo_a, hi_a, lo_b, hi_b)))
    end_a = end_b = 0
    for i, j in [pins[k] for k in chain] + [(len_a, len_b)]:
        at = [k for k in range(end_a, i) if not gone_a[k]]
        bt = [k for k in range(end_b, j) if not gone_b[k]]
        if at or bt:
            result.append(Segment(_placed(needleman_wunsch([a[k] for k in at], [b[k] for k in bt], scores), at, bt)))
        if i < len_a or j < len_b:
            result.append(Segment([("match", i + k, j + k) for k in range(n)]))
        end_a, end_b = i + n, j + n
    return result

"""Problem 8: text cut off by field limits or broken transfers.

Method. (1) Near-copies: every text is cut into blocks at content-defined places, the five-word shingles of each block
are min-hashed, and blocks meet in bands. The end of a text that ends open, its last ``CLOSE`` words, is looked for in every
holder of one of its bands that can go on longer and whose sketch, a bit for each hash of a shingle, lacks no more than
a copy may, once for all texts with that end; a copy that holds none of its shingles doesn't tell where the text ends. Where one is found that goes on in the same sentence, the two texts are
aligned and the copy is verified at 0.8 of the text's shingles. Equal texts are one text in this search.
(2) Texts without such a copy are scored by closing-word terminality: how often the last word closes a sentence
anywhere in the corpus, whether it is a word of the corpus at all, whether the closing line has a shape that closes
texts as a rule (signatures, shelf marks, lists of sigla, end marks), whether the source cuts at this length, and
whether a trace stands at the cut. All statistics cover all texts; only sums per word, shape and length are exchanged.

Defined results: null and blank texts aren't truncated; padding and blank lines at the end are ignored; equal scores
keep the text as complete; copies of a cut text are judged by their own end, so they are cases too; a null source is a
source of its own; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import accumulate, islice, repeat
from math import ceil

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, cut, discard, read_table, spread
from textloom.llm.leak import words

SHINGLE = 5
SIMILAR = 0.8
BLOCK = 16  # mean words that a block goes on after its least, a power of two
LEAST = 5  # words of a block
CLOSE = 12  # words at the end of a text that are looked for in its copies
SENT_IDS = 200_000  # texts that are picked out of the table without exchanging it; more are joined
REMEMBER = 200_000  # texts of a task that are known to have been seen
REMEMBER_CHARS = 1_000_000  # of texts of a task whose words are kept
REMEMBER_CLOSES = 50_000  # of a task whose words are kept
REMEMBER_BYTES = 64  # of a chunk that is remembered; longer ones are read each time
COUNTED_CHARS = 30_000_000  # of texts whose words a task counts before it tells the counts
BATCH_CHARS = 65_536  # of texts whose bands are made at once
HASHES = 4  # two bands of two rows
SKETCH = 1024  # bits for the shingles of a text
TILE = 4000  # ends, and texts, of a band that meet in one place
PASS = 3  # holders of bands, for each text, whose sketches are exchanged at once
TERMINAL = 0.02  # least share of closing uses of a word that may end a text without a stop
TAIL = 400  # characters in which a trace or closing marks at the end are looked for
SHORT_END = 6  # characters of an abbreviation of four letters, its stop and what is before it
KNOWN = 2  # least number of other uses of a word of the corpus
SHAPE_SHARE = 0.004  # least share of texts that close with the same shape
MARK_SHARE = 0.0005  # least share of texts, of different lengths, that close with the same short line
SPIKE = 8.0  # how much more frequent than its neighbours a cutting length is

_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
_WORD = regex.compile(r"[\p{L}\p{M}]")
_TRACE = regex.compile(r"(?:\s*(?:…|\.\.\.+|\[(?:…|\.\.\.|\p{L}*trunc\p{L}*)\]|\((?:…|\.\.\.)\)|<\p{L}*trunc\p{L}*>))$", regex.I)
_TRACE_ENDS = ("…", "...", "]", ")", ">")  # a full stop alone, as most texts have it, is none
_CLOSED = regex.compile(r"[.!?][\"'”’“»)\]]*(?:\s*[”“»])?$")
_CLOSERS = tuple("\"'”’“»)]")
_SENTENCE = regex.compile(r"(?<=[.!?][\"'”’“»)\]]{0,3})\s+(?=\S)")
_SHORT = regex.compile(r"(?:^|[^\p{L}\p{M}])([\p{L}\p{M}]{1,4})\.$")
_LETTER = re.compile(r"[^\W\d_]")
_STOP = re.compile("[.!?]")
_OPENING = "“„«([‘'\""
_PLAIN = re.compile(r"[^\W_]+")
# ASCII that words can't hold, read as blanks: what stands between blanks is a chunk, and has its words whatever is around it
_GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TOKEN_GAPS = bytes(c if c >= 128 or chr(c).isalnum() or chr(c) in "_-'" else 32 for c in range(256))


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _decoded(chunk: bytes) -> str:
    return chunk.decode("utf-8", "surrogatepass")


class _Remembered(dict):
    """What ``of`` says of chunks, computed once while they are remembered."""

    def __init__(self, of: Callable[[str], object]):
        super().__init__()
        self.of = of

    def __missing__(self, chunk: bytes) -> object:
        value = self.of(_decoded(chunk))
        if len(chunk) <= REMEMBER_BYTES:
            if len(self) >= REMEMBER:
                self.clear()
            self[chunk] = value
        return value


def _hashed(found: list[str]) -> bytes:
    import xxhash

    return b"".join(xxhash.xxh3_64_intdigest(w).to_bytes(8, sys.byteorder) for w in found)


_plain = _Remembered(lambda chunk: _hashed(_PLAIN.findall(chunk)))
_folded = _Remembered(lambda chunk: "".join(f"{w} " for w in words(chunk)))
_worded = _Remembered(lambda chunk: _hashed(words(chunk)))
_folded_hashes = _Remembered(lambda word: _hashed([word]))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def shape(line: str) -> str:
    """Classes of the tokens of a line, repeated ones once: U capitals and digits, T title case, l small, n number."""
    result: list[str] = []
    for t in tokens(line):
        if not _WORD.search(t):
            c = "n" if t[0].isnumeric() else t
        elif t.isupper():
            c = "U"
        elif t[0].isupper():
            c = "T"
        else:
            c = "l"
        if not result or result[-1] != c:
            result.append(c)
    return " ".join(result)


def trace(body: str):
    """The match of a trace of a cut at the end of ``body``, which has no blanks there."""
    return _TRACE.search(body) if body.endswith(_TRACE_ENDS) else None


def is_closed(body: str) -> bool:
    """Whether ``body``, which has no blanks at its end, ends with a stop and closing marks; most end with the stop."""
    return body.endswith((".", "!", "?")) or body.endswith(_CLOSERS) and bool(_CLOSED.search(body[-TAIL:]))


def is_verse(lines: list[str]) -> bool:
    """Several short lines that all begin with a capital."""
    lines = [x.strip() for x in lines if x.strip()]
    if len(lines) < 2 or max(map(len, lines)) > 75:
        return False
    opening = [m.group() for x in lines if (m := _LETTER.search(x))]
    inner = lines[:-1]
    return len(opening) > 1 and all(c.isupper() for c in opening) and sum(map(is_closed, inner)) < 0.9 * len(inner) + 0.5


def ending(text: str | None) -> tuple:
    """(chars, bytes, open, traced, attached, verse, last word, last two, last mark, shape, closing line, bracketed) of a text's end."""
    if text is None or not text.strip():
        return 0, 0, False, False, False, False, None, None, None, None, None, False
    body = text.rstrip()
    m = trace(body[-TAIL:])
    traced = bool(m)
    attached = traced and not m.group()[0].isspace()
    if traced:
        body = body[: len(body) - len(m.group())].rstrip()
    held = text.rstrip()  # a fixed-width field may be padded
    chars, size = len(held), len(held) if held.isascii() else len(held.encode("utf-8", "surrogatepass"))
    closed = is_closed(body)
    if closed and not traced and not _SHORT.search(body[-SHORT_END:]):
        return chars, size, False, False, False, False, None, None, None, None, None, False
    last_line = body[body.rfind("\n") + 1 :]
    closing_line = last_line.strip() if "\n" in body and len(last_line) <= 40 else None
    sentence = _SENTENCE.split(last_line)[-1]
    found = tokens(sentence)
    last = found[-1] if found else ""
    word = last.lower() if last and _WORD.search(last) else None
    if closed and last == "." and (m := _SHORT.search(body[-SHORT_END:])):
        word = m.group(1).lower() + "."
    opened = last_line.count("(") > last_line.count(")") or last_line.count("“") > last_line.count("”") + last_line.count("„")
    before = found[-2].lower() if word and len(found) > 1 and _WORD.search(found[-2]) else None
    pair = f"{before} {word}" if before and not word.endswith(".") else None
    return chars, size, not closed, traced, attached, is_verse(body.split("\n")), word, pair, last, shape(sentence), closing_line, opened


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, closing): uses of each word but the last of a text, and how many of them close a sentence.

    Two words that close a sentence together are counted as such (``n`` is null), and so is a word with a full stop
    (``l.``), which closes unless a number or small letter follows. A chunk is counted as it stands, and its words once
    for all its uses; ASCII marks aren't counted.
    """

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        chunks: Counter = Counter()
        uses: Counter = Counter()
        closing: Counter = Counter()
        chars = 0
        for r in rows:
            text = r["text"]
            lower = text.lower()
            chunks.update(_encoded(lower).translate(_TOKEN_GAPS).split())
            for t in _TOKEN.findall("".join(lower.rsplit(None, 1)[-1:]))[-1:]:
                uses[t] -= 1
            chars += len(text)
            closed: list[str] = []
            for i in [m.start() for m in _STOP.finditer(text)]:
                back = 80
                parts = text[max(0, i - back) : i].rsplit(None, 2)
                while len(parts) < 3 and back < i:  # words longer than that
                    back *= 4
                    parts = text[max(0, i - back) : i].rsplit(None, 2)
                if not parts or not parts[-1][-1].isalnum():
                    continue
                last = parts[-1].lstrip(_OPENING).lower()
                closed.append(last)
                if len(parts) > 1 and parts[-2][-1].isalnum():
                    closed.append(f"{parts[-2].lstrip(_OPENING).lower()} {last}")
                if text[i] == "." and len(last) <= 4 and (after := text[i + 1 : i + 4].lstrip()[:1]):
                    uses[last + "."] += 1
                    if not (after.isnumeric() or after.islower()):
                        closed.append(last + ".")
            closing.update(closed)
            if len(chunks) + len(uses) + len(closing) > 300_000 or chars > COUNTED_CHARS:
                yield from _both(chunks, uses, closing)
                chars = 0
        yield from _both(chunks, uses, closing)

    counted = arrow_rows(spread(docs.select("text")), run, "word string, n long, closing long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("closing").alias("closing"))


def _both(chunks: Counter, uses: Counter, closing: Counter) -> Iterator[tuple]:
    for chunk, n in chunks.items():
        for t in _TOKEN.findall(_decoded(chunk)):
            uses[t] += n
    chunks.clear()
    for w, n in uses.items():
        if n > 0:
            yield w, n, closing.pop(w, 0)
    for w, c in closing.items():
        yield w, None, c
    uses.clear()
    closing.clear()


def endings(docs: DataFrame) -> DataFrame:
    """How every text ends, the last words of open ones, its bands and sketch; a text met again in a task has these once."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        seen: set[int] = set()
        held: list[tuple] = []
        texts: list[str] = []
        chars = 0
        for r in rows:
            end = ending(r["text"])
            new = r["h"] not in seen
            if new:
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(r["h"])
                texts.append(r["text"])
                chars += len(r["text"])
            held.append((new, (r["doc_id"], r["source"], r["doc_kind"], r["h"], *end), closing_words(r["text"]) if new and end[2] else None))
            if chars > BATCH_CHARS or len(held) >= 4096:
                yield from banded(held, texts)
                held, texts, chars = [], [], 0
        yield from banded(held, texts)

    def banded(held: list[tuple], texts: list[str]) -> Iterator[tuple]:
        found = zip(_bands(texts), _sketches(texts, [close is not None for new, _, close in held if new]))
        for new, row, close in held:
            bands, sketch = next(found) if new else ((None, None), (None, None, None))
            yield *row, *bands, close, *sketch

    return arrow_rows(
        spread(docs.select("doc_id", "source", "doc_kind", F.xxhash64("text").alias("h"), "text")),
        run,
        "doc_id long, source string, doc_kind string, h long, chars int, bytes int, open boolean, traced boolean, attached boolean, verse boolean, word string, pair string, mark string, shape string, closing_line string, opened boolean, bands array<long>, tails array<int>, close string, sketch array<long>, own_sketch array<long>, lacks int",
    )


def closing_words(text: str) -> str:
    """The last words before a trace of a cut, in a line."""
    body = text.rstrip()
    m = trace(body[-TAIL:])
    if m:
        body = body[: len(body) - len(m.group())]
    back = 150
    while True:
        found = words(body[-back:])
        if len(found) > CLOSE or back >= len(body):
            return " ".join(found[-CLOSE:])
        back *= 4


def limits(ends: DataFrame, unit: str) -> DataFrame:
    """(source, unit, cuts): lengths at which a source's open texts pile up.

    A length is a cutting length if it holds ``SPIKE`` times the texts that a length of this source holds on average
    and most of them end open, or somewhat more than the average and all end open; in different words, so that copies
    of one text make no limit.
    """
    filled = ends.where("chars > 0")
    per = filled.groupBy("source", unit).agg(F.count(F.lit(1)).alias("held"), F.count_if("open").alias("open_held"), F.approx_count_distinct(F.when(F.col("open"), F.col("word"))).alias("ends"))
    mean = per.groupBy(F.col("source").alias("limit_source")).agg(F.avg("held").alias("mean_held"))
    spike = (F.col("held") >= SPIKE * F.col("mean_held")) & (F.col("open_held") * 2 >= F.col("held"))
    small = (F.col("open_held") == F.col("held")) & (F.col("held") >= 2.5 * F.col("mean_held"))
    return per.join(mean, F.col("source").eqNullSafe(F.col("limit_source"))).where((F.col("ends") >= 3) & (spike | small)).select("limit_source", F.col(unit).alias(f"limit_{unit}"))


_SEEDS = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "little") | 1 for i in range(HASHES + SHINGLE)], np.uint64)


def block_bands(text: str) -> list[tuple[int, int]]:
    """(band, words after the block): two bands of two min-hash rows of each block."""
    bands, tails = _bands([text])[0]
    return [(int(b), int(tails[k // 2])) for k, b in enumerate(bands)]


def _words_mixed(w: np.ndarray) -> np.ndarray:
    """A hash of each shingle of the words with the hashes ``w``, and a 0 behind them."""
    h = np.zeros(max(0, len(w) - SHINGLE + 1) + 1, np.uint64)
    for k in range(SHINGLE):
        h[:-1] += w[k : len(h) - 1 + k] * _SEEDS[HASHES + k]
    h ^= h >> np.uint64(29)
    return h


def _bands(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bands of each text's blocks, two of each, and how many words follow each block.

    A block ends after a word whose hash is 0 modulo ``BLOCK``, once it has ``LEAST`` words.
    """
    data = [b"".join(map(_plain.__getitem__, _encoded(t.lower()).translate(_GAPS).split())) for t in texts]
    w = np.frombuffer(b"".join(data), np.uint64) if any(data) else np.empty(0, np.uint64)
    at: list[int] = []  # from a block's first shingle to before its first that leaves it; blocks don't go over texts
    tails: list[int] = []
    of_text = [0]  # number of blocks up to each text
    to, places = 0, np.flatnonzero((w & np.uint64(BLOCK - 1)) == 0)
    first = 0
    for last in np.searchsorted(places, np.cumsum([len(d) // 8 for d in data])).tolist():
        lo, to = to, to + len(data[len(of_text) - 1]) // 8
        for i in [*places[first:last].tolist(), to - 1]:
            if i + 1 - lo >= LEAST:
                at += lo, i + 2 - SHINGLE
                tails.append(to - i - 1)
                lo = i + 1
        of_text.append(len(tails))
        first = last
    if not at:
        return [(np.empty(0, np.int64), np.empty(0, np.int32)) for _ in texts]
    x = _words_mixed(w) * _SEEDS[:HASHES, None]
    x ^= x >> np.uint64(31)
    rows = np.minimum.reduceat(x, at, axis=1)[:, ::2]
    values = rows[0::2] * np.uint64(0x9E3779B97F4A7C15) + rows[1::2] + np.arange(0, HASHES, 2, dtype=np.uint64)[:, None]
    bands, follow = (values.T.ravel() ^ np.uint64(1 << 63)).view(np.int64), np.array(tails, np.int32)
    return [(bands[2 * a : 2 * b], follow[a:b]) for a, b in zip(of_text, of_text[1:])]


def words_line(text: str) -> str:
    """The words of a text, as ``words`` finds them, in a line."""
    if "Σ" in text:  # its small letter depends on what is around it
        return " ".join(words(text))
    return "".join(map(_folded.__getitem__, _encoded(text).translate(_GAPS).split()))[:-1]


def prepared(text: str) -> tuple[str, int]:
    """(the words of a text in a line, how many of them stand before a trace of a cut)."""
    line = words_line(text)
    body = text.rstrip()
    m = trace(body)
    return line, len(words(body[: m.start()])) if m else line.count(" ") + bool(line)


def goes_on(text: str, other: str) -> bool:
    """Whether ``other`` is a near-copy of ``text`` that continues, within the sentence, where ``text`` ends."""
    line = words_line(other)
    return _goes_on(*_own(text), line, set(shingles(line.split())), other)


def shingles(found: list[str]) -> list[tuple]:
    return list(zip(*(found[k:] for k in range(SHINGLE))))


def _own(text: str) -> tuple[list[str], list[tuple]]:
    """The words of a text before a trace of a cut, and their shingles."""
    line, own = prepared(text)
    a = line.split()[:own]
    return a, shingles(a)


def _goes_on(a: list[str], grams: list[tuple], other_line: str, held: set[tuple], other: str) -> bool:
    if len(a) <= SHINGLE or sum(map(held.__contains__, grams)) < SIMILAR * len(grams):
        return False
    found = ahead(a[-CLOSE:], other_line)
    return found is not None and (found[0] or _continues(other, found[1]))


def _shingle_hashes(lines: list[str]) -> list[list[int]]:
    """Hashes of the shingles of each line's words, in order: equal shingles have equal hashes."""
    data = [b"".join(map(_folded_hashes.__getitem__, _encoded(line).split())) for line in lines]
    each = _words_mixed(np.frombuffer(b"".join(data), np.uint64)).tolist() if any(data) else []
    starts = accumulate((len(d) // 8 for d in data), initial=0)
    return [each[lo : max(lo, lo + len(d) // 8 - SHINGLE + 1)] for lo, d in zip(starts, data)]


def _sketches(texts: list[str], opens: list[bool]) -> list[tuple[np.ndarray, np.ndarray | None, int | None]]:
    """Of each text the bits that its shingles set and, if it ends open, those of its words before a trace and how many of these a copy may lack.

    Each of these bits that a copy's shingles don't set tells of another shingle that the copy doesn't hold.
    """
    data = [_hashed(words(t)) if "Σ" in t else b"".join(map(_worded.__getitem__, _encoded(t).translate(_GAPS).split())) for t in texts]
    at = _words_mixed(np.frombuffer(b"".join(data), np.uint64)) & np.uint64(SKETCH - 1)
    bits = np.zeros((2 * len(texts), SKETCH), np.uint8)
    lacks: list[int | None] = []
    lo = 0
    for k, (text, d, is_open) in enumerate(zip(texts, data, opens)):
        n = own = len(d) // 8
        bits[2 * k, at[lo : max(lo, lo + n - SHINGLE + 1)]] = 1
        if is_open:
            body = text.rstrip()
            m = trace(body)
            own = len(words(body[: m.start()])) if m else n
            bits[2 * k + 1, at[lo : max(lo, lo + own - SHINGLE + 1)]] = 1
        grams = own - SHINGLE + 1
        lacks.append((grams - ceil(SIMILAR * grams) if own > SHINGLE else -1) if is_open else None)
        lo += n
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return [(packed[2 * k], packed[2 * k + 1] if is_open else None, lacks[k]) for k, is_open in enumerate(opens)]


class _Closes(dict):
    """By the last words of a text, in a line: these words, their shingles' hashes in order and as a set."""

    def read(self, closes: set[str]) -> None:
        """Learn the lines ``closes``."""
        if len(self) + len(closes) > REMEMBER_CLOSES:
            self.clear()
        new = [c for c in closes if c not in self]
        self.update((c, (c.split(), grams, frozenset(grams))) for c, grams in zip(new, _shingle_hashes(new)))


def ahead(close: list[str], other_line: str, most: int | None = None) -> tuple[bool, int] | None:
    """What follows in a copy where a text ends with the words ``close``: whether it completes the last word, and its number there.

    None if the copy ends there too, or holds no shingle of these words, or reads otherwise after the last one it holds.
    ``most`` is the number of a shingle after which the copy is known to hold none.
    """
    b = f" {other_line} "
    for i in range(len(close) - SHINGLE if most is None else most, -1, -1):
        gram = f" {' '.join(close[i : i + SHINGLE])} "
        at = b.rfind(gram)
        if at >= 0:
            break
    else:
        return None
    rest_a = close[i + SHINGLE :]
    rest_b = b[at + len(gram) :].split(None, len(rest_a) + 8)[: len(rest_a) + 8]
    if not rest_b:
        return None
    if rest_a and not any(w.startswith(rest_a[-1]) for w in rest_b):  # its last word is neither there nor completed
        return None
    blocks = SequenceMatcher(None, rest_a, rest_b, False).get_matching_blocks() if rest_a else []
    done_a = max((m.a + m.size for m in blocks if m.size), default=0)
    done_b = max((m.b + m.size for m in blocks if m.size), default=0)
    completes = done_a == len(rest_a) - 1 and done_b < len(rest_b) and rest_b[done_b].startswith(rest_a[-1]) and rest_b[done_b] != rest_a[-1]
    if not completes and (done_a < len(rest_a) or done_b >= len(rest_b)):
        return None
    return completes, b[:at].count(" ") + SHINGLE + done_b


def _continues(text: str, index: int) -> bool:
    """Whether the word number ``index`` of ``text`` goes on with the sentence of the word before it."""
    text, index = _around(text, index)
    plain = text if text.isascii() else regex.sub(r"\p{Mn}+", "", unicodedata.normalize("NFD", text))
    found = list(islice(regex.finditer(r"[\p{L}\p{Nd}]+", plain), max(0, index - 1), index + 1))
    if len(found) < 2:
        return False
    between = plain[found[0].end() : found[1].start()]
    return not any(x in between for x in ".!?") and "\n" not in between.strip(" ")


def _around(text: str, index: int) -> tuple[str, int]:
    """The chunks of ``text`` from that of the word before number ``index`` to that of this word, and its number there."""
    data = _encoded(text)
    chunks = data.translate(_GAPS).split(b" ")
    held = list(accumulate(map(str.count, map(_folded.__getitem__, chunks), repeat(" "))))  # words up to each chunk
    first, last = bisect_right(held, max(0, index - 1)), bisect_right(held, index)
    start = sum(map(len, chunks[:first])) + first
    size = sum(map(len, chunks[first : last + 1])) + last - first
    return _decoded(data[start : start + size]), index - (held[first - 1] if first else 0)


def shared_bands(ends: DataFrame) -> DataFrame:
    """(band, h, tail, asks): the bands that an open text has and another text too, with all their holders.

    One exchange of numbers; a band that one text holds ends here.
    """
    each = ends.where("bands IS NOT NULL").select("h", F.col("close").isNotNull().alias("asks"), "tails", F.posexplode("bands").alias("k", "band"))
    held = each.select("band", "h", F.get("tails", F.expr("k DIV 2")).alias("tail"), "asks")
    of_band = Window.partitionBy("band")
    met = held.withColumn("_lo", F.min("h").over(of_band)).withColumn("_hi", F.max("h").over(of_band)).withColumn("_asked", F.max("asks").over(of_band))
    return met.where("_asked AND _lo <> _hi").select("band", "h", "tail", "asks")


def copies(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(h): open texts, by their hash, of which a verified near-copy goes on where they end."""
    closing = ends.where("close IS NOT NULL").select("h", "close").distinct()
    pairs = _candidates(ends)
    closes = closing.select(F.xxhash64("close").alias("c"), "close").distinct()
    met = cut(pairs.join(closes, "c").groupBy("other").agg(F.collect_set("close").alias("closes")))
    discard(pairs)

    def look(rows: Iterator[dict]) -> Iterator[tuple]:
        known = _Closes()
        batch: list[tuple] = []
        chars = 0
        for r in rows:
            batch.append((r["h"], r["text"], r["closes"].split("\n")))
            chars += len(r["text"]) + len(r["closes"])
            if chars > BATCH_CHARS:
                yield from looked(batch, known)
                batch, chars = [], 0
        yield from looked(batch, known)

    def looked(batch: list[tuple], known: _Closes) -> Iterator[tuple]:
        known.read({c for _, _, closes in batch for c in closes})
        lines = [words_line(text) for _, text, _ in batch]
        for (h, text, closes), line, hashes in zip(batch, lines, _shingle_hashes(lines)):
            held = set(hashes)
            for close in closes:
                a, grams, each = known[close]
                if held.isdisjoint(each) or line.endswith(close):  # of another text, or ends there too
                    continue
                found = ahead(a, line, max(k for k, x in enumerate(grams) if x in held))
                if found is not None and (found[0] or _continues(text, found[1])):
                    yield close, h

    lines = met.select(F.col("other").alias("h"), F.concat_ws("\n", "closes").alias("closes"))  # Python reads one string sooner than many
    held = _picked(docs, met.select(F.col("other").alias("h"))).join(lines, "h")
    inside = cut(arrow_rows(held.select("h", "text", "closes"), look, "close string, other long"))
    discard(met)
    wanted = cut(closing.join(inside, "close").where("h <> other").select("h", "other").distinct())
    discard(inside)
    text = cut(_picked(docs, wanted.select("h").union(wanted.select("other")).distinct()))
    both = wanted.join(text, "h").join(text.select(F.col("h").alias("other"), F.col("text").alias("other_text")), "other")

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        done: set[int] = set()
        own: dict[int, tuple] = {}
        kept, last, line, held = 0, None, "", set()
        for r in rows:
            if r["h"] in done:
                continue
            if r["other"] != last:  # rows of one copy come one after the other
                last, line = r["other"], words_line(r["other_text"])
                held = set(shingles(line.split()))
            if r["h"] not in own:
                kept += len(r["text"])
                if kept > REMEMBER_CHARS:
                    own.clear()
                    kept = len(r["text"])
                own[r["h"]] = _own(r["text"])
            if _goes_on(*own[r["h"]], line, held, r["other_text"]):
                done.add(r["h"])
                yield (r["h"],)

    found = cut(arrow_rows(both.select("h", "text", "other", "other_text"), run, "h long").distinct())
    discard(wanted)
    discard(text)
    return found


def _candidates(ends: DataFrame) -> DataFrame:
    """(c, other): the hash of each end and the texts it is looked for in, as a table.

    They share a band, the text goes on longer, and its sketch lacks no more bits than a copy may of the bits that all
    texts with that end set. Bands, sketches and numbers meet; no end is written for a pair that a sketch tells apart, so what is written
    doesn't grow with the holders of a band times its ends. These are dealt over a grid, ``TILE`` a side, and over passes.
    """
    of_band = Window.partitionBy("band")
    each = shared_bands(ends).groupBy("band", "h").agg(F.min("tail").alias("tail"), F.max("tail").alias("other_tail"), F.max("asks").alias("asks"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    band = cut(each.withColumn("asked_tiles", tiles(F.count_if("asks").over(of_band))).withColumn("held_tiles", tiles(F.count(F.lit(1)).over(of_band))))
    texts = cut(ends.where("sketch IS NOT NULL").select("h", "sketch").dropDuplicates(["h"]))
    words_of = range(SKETCH // 64)
    bits = lambda column, name: [F.coalesce(F.get(column, F.lit(k)), F.lit(0)).alias(f"{name}{k}") for k in words_of]
    own = ends.where("own_sketch IS NOT NULL").select("h", F.xxhash64("close").alias("c"), "lacks", *bits("own_sketch", "a"))
    of_close = own.groupBy("c").agg(F.max("lacks").alias("lacks"), *[F.bit_and(f"a{k}").alias(f"a{k}") for k in words_of])
    asked = cut(own.select("h", "c").distinct().join(of_close, "c"))
    numbers = lambda tiles: F.explode(F.sequence(F.lit(0), tiles - 1))
    place = ["band", "asked_tile", "held_tile"]
    longer = F.col("other_tail") > F.col("tail") * SIMILAR  # what was left out of the copy may be made up for by what follows
    another = (F.col("lo") != F.col("other")) | (F.col("hi") != F.col("other"))
    missing = sum((F.bit_count(F.col(f"a{k}").bitwiseAND(F.bitwise_not(f"b{k}"))) for k in words_of), F.lit(0))
    passes = max(1, ceil(band.count() / max(1, PASS * texts.count())))
    found = []
    for p in range(passes):
        some = band.where(F.pmod(F.xxhash64("band"), F.lit(passes)) == p)
        asking = some.where("asks").join(asked, "h").withColumn("asked_tile", F.pmod("c", "asked_tiles")).withColumn("held_tile", numbers(F.col("held_tiles")))
        first = [F.first("lacks").alias("lacks"), *[F.coalesce(F.first(f"a{k}"), F.lit(0)).alias(f"a{k}") for k in words_of]]
        asking = asking.repartition(*place).groupBy(*place, "c").agg(F.min("tail").alias("tail"), F.min("h").alias("lo"), F.max("h").alias("hi"), *first)
        holding = some.join(texts, "h").select("band", F.col("h").alias("other"), "other_tail", F.pmod("h", "held_tiles").alias("held_tile"), numbers(F.col("asked_tiles")).alias("asked_tile"), *bits("sketch", "b"))
        found.append(cut(asking.join(holding.hint("merge"), place).where(longer & another & (missing <= F.col("lacks"))).select("c", "other").distinct()))
    for table in (band, texts, asked):
        discard(table)
    if passes == 1:
        return found[0]
    pairs = cut(reduce(DataFrame.union, found).distinct())
    for table in found:
        discard(table)
    return pairs


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, text) of the texts ``ids(h)``, each once; up to ``SENT_IDS`` are told to every task, more are joined."""
    ids = cut(ids)
    text = docs.select(F.xxhash64("text").alias("h"), "text")
    found = text.join(F.broadcast(ids), "h", "left_semi") if ids.count() <= SENT_IDS else text.join(ids.hint("shuffle_merge"), "h", "left_semi")
    return found.dropDuplicates(["h"])


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, source, truncated, reason) of every document."""
    docs = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ends = cut(endings(docs))
    total = F.broadcast(ends.where("chars > 0").agg(F.count(F.lit(1)).alias("texts")))  # one row
    counts = cut(word_counts(docs))  # joined by the last word and by the last two
    shapes = ends.where("open AND NOT traced").groupBy("shape").agg(F.count(F.lit(1)).alias("shape_n"))
    marks = ends.where("open AND closing_line IS NOT NULL").groupBy("closing_line").agg(F.count(F.lit(1)).alias("mark_n"), F.approx_count_distinct("chars").alias("mark_lengths"))
    least = F.greatest(F.lit(3.0), F.col("texts") * MARK_SHARE)  # at most 1 / MARK_SHARE shapes or lines are as frequent
    shapes = F.broadcast(shapes.crossJoin(total).where(F.col("shape_n") >= least).drop("texts"))
    marks = F.broadcast(marks.crossJoin(total).where(F.least("mark_n", "mark_lengths") >= least).drop("texts"))
    by_chars, by_bytes = limits(ends, "chars"), limits(ends, "bytes")
    open_ends = (
        ends.where("open OR traced OR word LIKE '%.'")
        .drop("bands", "tails", "close")
        .join(counts.withColumnRenamed("n", "uses").hint("shuffle_merge"), "word", "left")  # tables that grow with the corpus are never sent
        .join(counts.select(F.col("word").alias("pair"), F.col("closing").alias("pair_closing")).hint("shuffle_merge"), "pair", "left")
        .join(marks, "closing_line", "left")
        .join(shapes, "shape", "left")
        .join(copies(docs, ends).withColumn("copied", F.lit(True)), "h", "left")
        .crossJoin(total)
        .join(by_chars, F.col("source").eqNullSafe(F.col("limit_source")) & (F.col("chars") == F.col("limit_chars")), "left")
        .drop("limit_source")
        .join(by_bytes, F.col("source").eqNullSafe(F.col("limit_source")) & (F.col("bytes") == F.col("limit_bytes")), "left")
    )
    uses = F.coalesce("uses", F.lit(0))
    closing = F.greatest((F.coalesce("closing", F.lit(0)) + 0.1) / (uses + 2.0), F.when(F.col("pair_closing") >= 2, 1.0))
    limited = F.col("limit_chars").isNotNull() | F.col("limit_bytes").isNotNull()
    wordy = F.col("word").isNotNull()
    usual = F.coalesce("shape_n", F.lit(0)) >= F.greatest(F.lit(3.0), F.col("texts") * SHAPE_SHARE)
    verse = F.col("verse") | (F.col("doc_kind") == "verse")
    structured = usual & F.col("shape").contains(" ") & F.col("shape").rlike(r"[^Tl ,;\"'“”„«»’‘?!.]")
    set_off = F.col("shape").rlike(r"[—\])*]$") & (F.col("shape_n") >= F.greatest(F.lit(3.0), F.col("texts") * MARK_SHARE))
    marked = F.least("mark_n", "mark_lengths") >= F.greatest(F.lit(3.0), F.col("texts") * MARK_SHARE)
    reason = (
        F.when(~F.col("open") & F.col("word").endswith(".") & (uses >= 5) & (closing < 0.3), "abbreviation")
        .when(~F.col("open"), None)
        .when((marked & (F.length("closing_line") > 1)) | set_off, None)
        .when(F.col("traced") & F.col("attached"), "trace")
        .when(F.col("copied"), "copy")
        .when(wordy & (uses < KNOWN) & ~F.col("mark").rlike(r"\d"), "word")
        .when(F.col("traced"), "trace")
        .when(structured & ~F.col("shape").endswith("l"), None)
        .when(verse & wordy & ~limited & ~F.col("opened") & (closing >= TERMINAL), None)
        .when(limited, "limit")
        .otherwise("sentence")
    )
    judged = open_ends.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")
    return ends.select("doc_id", "source").join(judged, "doc_id", "left").select("doc_id", "source", F.col("reason").isNotNull().alias("truncated"), "reason")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).where("truncated").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    rates = judge(read_table(spark, sf_dir, "documents")).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated_texts"))
    return rates.withColumn("rate", F.round(F.col("truncated_texts") / F.col("texts"), 6))


QUERIES = {"p8_found": p8_found, "p8_rates": p8_rates}

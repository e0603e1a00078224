"""The lexer as a plain function of one text; no Spark in here.

A text is read once, left to right, by one pattern whose alternatives say what stands at a place. Lines, pages, words and
paragraphs are counted along the way, so a text costs about a microsecond per token and no sorting.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from functools import lru_cache

from textloom.config import Normalizer, Pagination

REMEMBER = 200_000  # normal forms kept per process and normalizer


@lru_cache(None)
def _ranges(kinds: str, last: int = 0xFFFF) -> str:
    """The characters of these general categories up to ``last``, as ranges of a character class."""
    found, lo = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code))[0] in kinds
        if inside and lo is None:
            lo = code
        elif not inside and lo is not None:
            found.append(f"\\U{lo:08x}-\\U{code - 1:08x}")
            lo = None
    return "".join(found)


@lru_cache(None)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """What ends a line in texts with page marks, and what does so where these are ordinary signs."""
    region = r"(?P<r><!--\s*[nN][oO][_-][cC][oO][lL][lL][aA][tT][eE]\b(?s:.*?)(?:-->|\Z))"
    mark = r"(?P<b>\f|<!--\s*page\s*break\s*-->|(?:\A|(?<=\n))[ \t]*---[ \t]*\r?(?=\n|\Z))"
    ends = r"(?P<p>\n(?=[ \t\r]*\n))|(?P<n>\n)"
    return re.compile(f"{mark}|{ends}|{region}"), re.compile(f"{ends}|{region}")


@lru_cache(None)
def runs(astral: bool) -> re.Pattern:
    """The runs of a line; the class of letters beyond the basic plane is slow, and few texts need it."""
    inner = _ranges("LMN", sys.maxunicode if astral else 0xFFFF) + "'’-"
    blank = "\\t\\n\\x0b\\f\\r\\x85" + _ranges("Z")
    return re.compile(f"([{inner}]+)|[^{blank}{inner}]+")


_UNITS = re.compile(r"(?:^-+)?[^-]+(?:-$)?|-+")
_INTERIOR = re.compile(r".-+[^-]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def units(run: str) -> list[str]:
    """A word run cut at its inner hyphens; hyphens at its edges stay with their words."""
    return _UNITS.findall(run) if _INTERIOR.search(run) else [run]


class Folding(dict):
    """What words and runs of signs are compared by under a normalizer, worked out once each; ``""`` isn't compared."""

    def __init__(self, n: Normalizer):
        super().__init__()
        self.n = n
        self.is_word = Words()

    def __missing__(self, run: str) -> str:
        if not self.is_word[run]:
            return "" if self.n.drop_punctuation else run
        form = run.lower() if self.n.lowercase else run
        if self.n.strip_accents and not form.isascii():
            form = form.translate(_BASES)
        form = self.n.spelling.get(form, form)
        if len(self) >= REMEMBER:
            self.clear()
        self[run] = form
        return form


class Bases(dict):
    """Code point -> its letter without diacritics, "" for a mark by itself; worked out once each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") if kind[0] == "L" and not 0xAC00 <= code <= 0xD7A3 else c
        self[code] = found = "" if kind == "Mn" else base if len(base) == 1 else c
        return found


_BASES = Bases()


class Words(dict):
    """Whether a run is a word; a lone hyphen isn't."""

    def __missing__(self, run: str) -> bool:
        found = run != "-" and (run[0] in "-'’" or unicodedata.category(run[0])[0] in "LMN")
        if len(self) >= REMEMBER:
            self.clear()
        self[run] = found
        return found


folding = lru_cache(16)(Folding)


class Tokens:
    """The tokens of a text as parallel lists; offsets count UTF-16 units."""

    __slots__ = ("surface", "normalized", "is_word", "char_from", "char_to", "line", "paragraph", "page", "word_index")

    def __init__(self) -> None:
        for name in self.__slots__:
            setattr(self, name, [])

    def __len__(self) -> int:
        return len(self.surface)


def scan(text: str | None, normalizer: Normalizer, pagination: Pagination = Pagination()) -> Tokens:
    """Tokens of ``text``. Null and blank texts have none; a byte order mark at the start is skipped.

    Pages begin at marks, after so many text lines, or at offsets; an offset inside a run of letters applies after it.
    Lines are counted where they bear text only.
    """
    t = Tokens()
    if not text:
        return t
    if text[0] == "\ufeff":
        text = " " + text[1:]
    marked, plain = patterns()
    per_page = None if pagination.lines_per_page is None else max(1, pagination.lines_per_page)
    starts = sorted(o for o in pagination.offsets or () if o > 0)[::-1]
    astral = None if text.isascii() else [m.start() for m in _ASTRAL.finditer(text)] or None
    run_of = runs(astral is not None)
    split = normalizer.split_hyphens
    page = paragraph = on_page = lo = 0
    line = -1

    def turn() -> None:
        nonlocal page, line, on_page
        page, on_page = page + 1, 0
        if not pagination.continuous:
            line = -1

    def placed(surface: list[str], char_from: list[int]) -> None:
        """A text line, or the part of one that stands on a page."""
        nonlocal line, on_page
        if per_page is not None and on_page >= per_page:
            turn()
        line, on_page, n = line + 1, on_page + 1, len(surface)
        t.surface += surface
        t.char_from += char_from
        t.line += [line] * n
        t.paragraph += [paragraph] * n
        t.page += [page] * n
        t.word_index += range(n)

    def read(lo: int, hi: int) -> bool:
        """The runs of the stretch between two ends of lines, and whether there are any."""
        found = [m.span() for m in run_of.finditer(text, lo, hi)]
        if not found:
            return False
        surface = [text[a:b] for a, b in found]
        char_from = [a for a, _ in found]
        if split and text.find("-", lo, hi) >= 0:
            told, surface, char_from = zip(surface, char_from), [], []
            for run, at in told:
                for unit in units(run) if "-" in run and len(run) > 2 and run_of.match(run)[1] else (run,):
                    surface.append(unit)
                    char_from.append(at)
                    at += len(unit)
        if astral is not None:
            char_from = [a + bisect_left(astral, a) for a in char_from]
        if starts and starts[-1] <= char_from[-1]:
            first = [a + bisect_left(astral or (), a) for a, _ in found]  # pages begin at runs, not within them
            while starts and (k := bisect_left(first, starts[-1])) < len(first):
                k = bisect_left(char_from, first[k])
                if k:
                    placed(surface[:k], char_from[:k])
                    surface, char_from = surface[k:], char_from[k:]
                starts.pop()
                turn()
        placed(surface, char_from)
        return True

    for m in (marked if pagination.lines_per_page is None and pagination.offsets is None else plain).finditer(text):
        at = m.start()
        held = at > lo and read(lo, at)
        lo = m.end()
        if m.lastgroup == "b":
            turn()
        elif held and m.lastgroup == "p":
            paragraph += 1
    if lo < len(text):
        read(lo, len(text))
    normal = folding(normalizer)
    t.normalized = [normal[x] for x in t.surface]
    is_word = normal.is_word
    t.is_word = [is_word[x] for x in t.surface]
    width = len if astral is None else lambda x: len(x.encode("utf-16-le", "surrogatepass")) // 2
    t.char_to = [a + width(x) for a, x in zip(t.char_from, t.surface)]
    return t

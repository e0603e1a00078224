"""Problem 1: text decoded with the wrong character encoding.

Method: minimum description length with per-language zstandard dictionaries. A *chain* is one or two steps "encode with
A, decode with B" that undo a wrong decoding. Every candidate decoding of every word outside ASCII is compressed with
the dictionary of each language, and signs unknown to that language cost extra. Dynamic programming over the words of a text
chooses a chain for each stretch so that compressed size plus the price of entering chains is least; where no chain
pays, the words stay as they are. Replacement signs and C1 controls are garbled whatever the outcome, as their own
signs can be lost.

The dictionaries hold the words that stand in the most clean texts, counted over all texts of every language label with a
share of ``LEAST_SHARE`` of the clean ones, most frequent last, as many as ``DICTIONARY_BYTES`` hold; nothing is sampled. A word that stands in a dictionary as it is costs one match, so its other decodings needn't be tried unless a
neighbour's pay.

Defined results: null and empty texts are never garbled; a repeated delivery counts once; equal costs keep the text
unchanged; a table without clean texts has empty dictionaries and still works; extra columns are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, cut, read_table, spread
from textloom.llm.unify import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, INVISIBLE, TO_CYRILLIC, TO_CYRILLIC_FROM

SENT_WORDS = 200_000  # damaged words, or repeated keys, that are told to every task; more are joined
LEAST_SHARE = 0.002  # of the clean texts that a language label needs for a dictionary of its own
DICTIONARY_BYTES = 220_000

ENTER_UTF8 = 10  # bits: a byte string that is valid UTF-8 by chance is rare
ENTER_BYTE = 26  # bits: any byte string is valid in a single-byte encoding
ENTER_SECOND = 8
LEAVE = 2
UNDECODABLE = 12
SWITCH = 10  # bits for another language
ALIEN = 16  # bits for a sign that the language's texts don't hold
MIXED = 20  # bits for a word in two scripts
NEVER = 1 << 20
FAR = 10  # times as frequent as a word is the word that it was before its damage
CONTROL = 24  # bits for a sign that no text holds
DISGUISED = 6  # bits for a word whose signs only look like the ones that belong there

_READ_AS = ("western", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866")
_REMAPS = (
    ("western", "cp1252"),
    ("western", "cp1251"),
    ("western", "koi8_r"),
    ("western", "mac_roman"),
    ("western", "cp850"),
    ("mac_roman", "cp1252"),
    ("mac_roman", "cp1251"),
    ("cp850", "cp1252"),
    ("cp437", "cp1252"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("cp1251", "cp1252"),
)

_OUTSIDE = re.compile(r"[^\x00-\x7f]")
_HARD = re.compile(r"[\x80-\x84\x86-\x9f�]")
_MIXED = re.compile(r"[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]")
_LATIN, _OTHER, _GREEK = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ͱ-ӿ]"), re.compile(r"[Ͱ-Ͽ]")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_INNER = re.compile("[-'’‘“”„«»…—]+")
_SPACE = re.compile(r"([ \n\r\t\f]+)")


def _split(text: str) -> list[str]:
    """The words of a text in their order, and empty ones where blanks follow each other."""
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").replace("\f", " ").split(" ")


@lru_cache(None)
def _decoder(codec: str) -> tuple[str, ...]:
    """The character of each byte; bytes that the code page leaves free stand for themselves."""
    return tuple(bytes([b]).decode("cp1252" if codec == "western" else codec, "ignore") or chr(b) for b in range(256))


@lru_cache(None)
def _encoder(codec: str) -> dict[int, str]:
    """Code point -> the character of its byte, for ``str.translate``; ``western`` takes Latin-1 and its relative alike."""
    table = {ord(c): chr(b) for b, c in enumerate(_decoder(codec))}
    if codec == "western":
        table |= {b: chr(b) for b in range(128, 256)}
    if codec == "cp1251":
        table[0xFFFD] = chr(0x98)  # the one byte it leaves free
    return table


def undo(text: str, read_as: str, was: str) -> str | None:
    """``text`` encoded with ``read_as`` and decoded with ``was``; None where that is impossible or changes nothing."""
    raw = text.translate(_encoder(read_as))
    try:
        data = raw.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if was == "utf-8":
        try:
            result = data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    else:
        result = "".join(map(_decoder(was).__getitem__, data))
    return None if result == text else result


def candidates(word: str) -> dict[tuple, str]:
    """Chain -> what ``word`` was before its UTF-8 was read as something else, up to three times."""
    found: dict[tuple, str] = {}
    for a in _READ_AS:
        first = undo(word, a, "utf-8")
        if first is None and word[-1] in "ÃÂ" and a == "western":
            first = undo(word + "\xa0", a, "utf-8")  # its last byte, a no-break space, became a plain blank
        if first is None:
            continue
        found[(a, "utf-8"),] = first
        if _OUTSIDE.search(first):
            for b in _READ_AS:
                second = undo(first, b, "utf-8")
                if second is not None:
                    found[(a, "utf-8"), (b, "utf-8")] = second
                    third = undo(second, b, "utf-8") if a == b else None
                    if third is not None:
                        found[(a, "utf-8"), (b, "utf-8"), (b, "utf-8")] = third
    return found


def remaps(word: str) -> dict[tuple, str]:
    """The same for damage between single-byte encodings, which any bytes allow."""
    found: dict[tuple, str] = {}
    for a, was in _REMAPS:
        first = undo(word, a, was)
        if first is not None:
            found[(a, was),] = first
    return found


_TO_LATIN = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
_TO_CYRILLIC = str.maketrans(TO_CYRILLIC_FROM, TO_CYRILLIC)
_UNSEEN = re.compile(f"[{INVISIBLE}]")


def as_seen(word: str) -> str:
    """``word`` without invisible signs, compatibility forms and letters of another script, where one script explains it."""
    word = unicodedata.normalize("NFKC", _UNSEEN.sub("", word)) if not _HARD.search(word) else word
    if _MIXED.search(word) or _GREEK.search(word):
        latin = word.translate(_TO_LATIN)
        if not _OTHER.search(latin):
            return latin
        cyrillic = word.translate(_TO_CYRILLIC)
        if not _LATIN.search(cyrillic):
            return cyrillic
    return word


def enter(chain: tuple) -> int:
    return (ENTER_UTF8 if chain[0][1] == "utf-8" else ENTER_BYTE) + ENTER_SECOND * (len(chain) - 1)


class Restorer:
    """Holds one compressor per language; ``restore`` gives the text, the chains used and whether it was garbled."""

    def __init__(self, dictionaries: list[bytes], remember: int = 100_000):
        import zstandard

        frame = dict(write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.languages = []
        for d in dictionaries or [b""]:
            parameters = zstandard.ZstdCompressionParameters.from_level(19, **frame)
            known = set(d.decode("utf-16-le")) | set(map(chr, range(128)))
            if len(d) >= 8:
                prepared = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                prepared.precompute_compress(compression_params=parameters)
                self.languages.append((zstandard.ZstdCompressor(dict_data=prepared, compression_params=parameters), known))
            else:
                self.languages.append((zstandard.ZstdCompressor(compression_params=parameters), known))
        self.options = lru_cache(remember)(self._options)
        self.size = lru_cache(remember)(self._size)  # damage of many kinds leads back to the same words
        self.vocabulary = {x.lower() for d in dictionaries for w in d.decode("utf-16-le").split(" ") for x in _INNER.split(w.strip(_EDGES)) if x.isalpha()} | {""}
        self.plain: set[str] = set()
        self.remember = remember

    def bits(self, word: str, most: int = NEVER) -> tuple[int, ...]:
        """Cost of ``word`` in each language: compressed size, and more for signs the language doesn't know.

        Where the latter alone cost more than ``most``, compression is spared and the cost is ``NEVER``.
        """
        mixed = MIXED if _MIXED.search(word) else 0
        outside = _OUTSIDE.findall(word)
        mixed += CONTROL * len(_HARD.findall(word))
        result = []
        for k, (_, known) in enumerate(self.languages):
            extra = mixed + ALIEN * sum(x not in known for x in outside)
            result.append(extra + 4 * self.size(k, word) if extra <= most else NEVER)
        return tuple(result)

    def _size(self, k: int, word: str) -> int:
        return len(self.languages[k][0].compress(f" {word} ".encode("utf-16-le", "surrogatepass")))  # every sign of the same width

    def _options(self, word: str) -> tuple[tuple[int, ...], dict[tuple, tuple[tuple[int, ...], str]]]:
        """Costs of the word as it stands, and for each chain its costs and result (only chains that may pay)."""
        own = self.bits(word)
        seen = as_seen(word)
        if seen != word:  # disguised, which isn't this problem's damage
            own = tuple(min(a, b + DISGUISED) for a, b in zip(own, self.bits(seen)))
        scored = {}
        for chain, text in candidates(word).items():
            cost = self.bits(text, min(own) + UNDECODABLE)
            if min(cost) <= min(own) + UNDECODABLE:
                scored[chain] = (cost, text)
        if any(min(cost) < min(own) and any(known.issuperset(t) for _, known in self.languages) for cost, t in scored.values()):
            return own, scored  # bytes that are sensible UTF-8 by chance are rarer than any damage
        letters = any(map(str.isalpha, word))
        for chain, text in remaps(word).items():
            cost = self.bits(text, min(own) + UNDECODABLE)
            if min(cost) <= min(own) + UNDECODABLE:  # signs without a letter speak neither for nor against
                scored[chain] = (cost if letters else tuple(max(a, b) for a, b in zip(cost, own)), text)
        return own, scored

    def _pass(self, word: str) -> None:
        """Remember that ``word`` says nothing about damage, wherever it stands."""
        if len(self.plain) >= self.remember:
            self.plain.clear()
        self.plain.add(word)

    def restore(self, text: str | None) -> tuple[str | None, list[str], bool]:
        if not text or text.isascii():
            return text, [], False
        hard = False
        gain: Counter = Counter()  # the most that a chain could save in this text
        for word in filterfalse(self.plain.__contains__, _split(text)):
            if word.isascii():
                self._pass(word)
                continue
            spoilt = bool(_HARD.search(word))
            hard |= spoilt
            core = word.strip(_EDGES)
            if all(x.lower() in self.vocabulary for x in _INNER.split(core)):  # matches in a dictionary, the least that any decoding could cost
                self._pass(word)
                continue
            own, scored = self.options(core)
            if not scored and not spoilt:
                self._pass(word)
            least = min(own)
            for c, (cost, _) in scored.items():
                gain[c] += max(0, max(o - x for o, x in zip(own, cost)), least - min(cost))
        chains = sorted(c for c, g in gain.items() if g > enter(c))
        if not chains:
            return text, [], hard
        parts = _SPACE.split(text)
        at = [i for i in range(0, len(parts), 2) if not parts[i].isascii()]
        options = []
        for i in at:
            core = parts[i].strip(_EDGES)
            lo = parts[i].index(core)
            own, scored = self.options(core)
            options.append((own, {c: (cost, parts[i][:lo] + t + parts[i][lo + len(core) :]) for c, (cost, t) in scored.items()}))
        n = len(self.languages)
        chains = self._undominated(chains, options)
        every = (None, *chains)  # state number i * n + k: chain i, language k
        price = [SWITCH + (LEAVE if c is None else enter(c)) for c in every]
        costs = [[0 if c is None else enter(c)] * n for c in every]
        trail: list[list[int]] = []
        for own, scored in options:
            least = [min(row) for row in costs]
            base = min(least)
            overall = least.index(base)  # of equals the first, so words stay as they are
            overall = overall * n + costs[overall].index(base)
            undecodable = [x + UNDECODABLE for x in own]
            now, came = [], []
            for i, c in enumerate(every):
                row = costs[i]
                other, at_other = least[i] + SWITCH, i * n + row.index(least[i])
                if base + price[i] < other:
                    other, at_other = base + price[i], overall
                cost = own if c is None else scored[c][0] if c in scored else undecodable
                now.append([(other if other < x else x) + y for x, y in zip(row, cost)])
                came.extend([at_other if other < x else i * n + k for k, x in enumerate(row)])
            costs = now
            trail.append(came)
        flat = [x for row in costs for x in row]
        state = flat.index(min(flat))
        used: Counter = Counter()
        for k in range(len(at) - 1, -1, -1):
            chain = every[state // n]
            if chain is not None and chain in options[k][1]:
                parts[at[k]] = options[k][1][chain][1]
                used[chain] += 1
            state = trail[k][state]
        return "".join(parts), [" + ".join(f"{was} read as {a}" for a, was in reversed(c)) for c, _ in used.most_common()], hard or bool(used)

    def _undominated(self, chains: list[tuple], options: list) -> list[tuple]:
        """Without the chains that another one beats or equals on every word in every language, at no higher price."""
        n = len(self.languages)
        table = np.array([[scored[c][0] if c in scored else [x + UNDECODABLE for x in own] for own, scored in options] for c in chains]).reshape(len(chains), -1, n)
        kept: list[int] = []
        for i in sorted(range(len(chains)), key=lambda i: (enter(chains[i]), table[i].sum(), chains[i])):
            if not any((table[j] <= table[i]).all() for j in kept):
                kept.append(i)
        return sorted(chains[i] for i in kept)


_DAMAGED = tuple(  # one after the other, each by its first sign, which is faster than all as one
    re.compile(x) for x in ("[\x80-\x9f�√≈∂∆∏∫◊─-▟]", "[A-ZÀ-ÖØ-ÞА-ЯЁ](?<=[a-zß-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ])", "[ÂÃÐÑ][^\\w\\s'’-]", "[à-ÿÀ-ß]{3}", "[РС][^\\w\\s.,!?;:»”“…)—-]")
)


def _once(texts: DataFrame, key: str) -> DataFrame:
    """(k, lang, text) of every text, repeated deliveries once; only those that are repeated are exchanged."""
    held = texts.where(F.col("text").isNotNull()).select(F.coalesce(F.col(key), F.xxhash64("text")).alias("k"), F.lower(F.trim("lang")).alias("lang"), "text")
    again = cut(held.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    again = F.broadcast(again) if again.count() <= SENT_WORDS else again.hint("shuffle_merge")
    repeated = held.join(again, "k", "left_semi").groupBy("k").agg(F.min(F.struct("lang", "text")).alias("t")).select("k", "t.lang", "t.text")
    return held.join(again, "k", "left_anti").union(repeated).where("lang <> '' AND lang <> 'und'")


class _Cores(dict):
    """Words without their edges, None for one that looks damaged; made once while they are remembered."""

    def __missing__(self, word: str) -> str | None:
        if len(self) >= 100_000:
            self.clear()
        self[word] = core = None if any(x.search(word) for x in _DAMAGED) else word.strip(_EDGES)
        return core


_cores = _Cores()


def _words(text: str) -> set[str] | None:
    """The words of a text without their edges; None if it looks damaged, which a word alone tells, as no sign of damage holds a blank."""
    held = set(map(_cores.__getitem__, set(_split(text))))
    return None if None in held else held


def _counted(texts: DataFrame, told: Callable[[dict], set[str] | None]) -> DataFrame:
    """(lang, w, n): in how many texts of a language a word stands, w null: how many texts; ``told`` gives a text's words, None for a text that doesn't count."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for i, r in enumerate(rows):
            held = told(r)
            if held is not None:
                counts[r["lang"]].update(held)
                counts[r["lang"]][None] += 1
            if i % 512 == 511 and sum(map(len, counts.values())) > 300_000:
                yield from ((lang, w, n) for lang, c in counts.items() for w, n in c.items())
                counts.clear()
        yield from ((lang, w, n) for lang, c in counts.items() for w, n in c.items())

    return arrow_rows(texts, run, "lang string, w string, n long")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "w").agg(F.sum("n").alias("n")).where("n > 0")


def _damaged(counts: DataFrame) -> DataFrame:
    """(lang, w): words of which one step makes a word of three letters that is ``FAR`` times as frequent."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            found = {t.strip(_EDGES) for options in (candidates(r["w"]), remaps(r["w"])) for chain, t in options.items() if len(chain) == 1}
            yield from ((r["lang"], r["w"], r["n"], t) for t in found if sum(map(str.isalpha, t)) >= 3)

    outside = arrow_rows(counts.where(F.col("w").rlike(r"[^\x00-\x7f]")), run, "lang string, w string, n long, t string")
    frequent = counts.where(F.col("n") >= FAR).select("lang", F.col("w").alias("t"), F.col("n").alias("far"))
    return outside.join(frequent, ["lang", "t"]).where(F.col("far") >= FAR * F.col("n")).select("lang", "w").distinct()


def clean_counts(texts: DataFrame, key: str) -> DataFrame:
    """(lang, w, n) over all clean texts: those that don't look damaged, without a word that decodes to a far more frequent one.

    All texts that don't look damaged are counted, then those with such a word are taken off. Up to ``SENT_WORDS`` such
    words are sent to every task, more are joined.
    """
    source = spread(_once(texts, key))
    first = cut(_summed(_counted(source, lambda r: _words(r["text"]))))
    damaged = cut(_damaged(first))
    if damaged.count() <= SENT_WORDS:
        by_lang: dict[str, set[str]] = defaultdict(set)
        for r in damaged.collect():
            by_lang[r["lang"]].add(r["w"])
        sent = texts.sparkSession.sparkContext.broadcast(dict(by_lang))

        def told(r: dict) -> set[str] | None:
            text, listed = r["text"], sent.value.get(r["lang"])
            if not listed or text.isascii():
                return None
            held = _words(text)
            return None if held is None or listed.isdisjoint(held) else held

        spoilt = _counted(source, told)
    else:

        def outside(rows: Iterator[dict]) -> Iterator[tuple]:
            for r in rows:
                if not r["text"].isascii():
                    yield from ((r["k"], r["lang"], w) for w in _words(r["text"]) or () if not w.isascii())

        keys = arrow_rows(source, outside, "k long, lang string, w string").join(damaged.hint("shuffle_merge"), ["lang", "w"]).select("k").distinct()
        spoilt = _counted(source.join(keys.hint("shuffle_merge"), "k", "left_semi"), lambda r: _words(r["text"]))
    return cut(_summed(first.union(spoilt.select("lang", "w", -F.col("n")))))


def dictionaries(texts: DataFrame, key: str) -> list[bytes]:
    """One raw-content dictionary for each language label that holds ``LEAST_SHARE`` of the clean texts, from the counts of all of them.

    Texts that look damaged (signs no language uses
    inside words, capitals after small letters) aren't used, nor are those with a word that decodes to a far more
    frequent one.
    """
    counts = clean_counts(texts, key)
    number = counts.where("w IS NULL")
    least = LEAST_SHARE * (number.agg(F.sum("n")).first()[0] or 0)
    labels = [r["lang"] for r in number.where(F.col("n") >= least).orderBy(F.desc("n"), "lang").collect()]  # at most 1 / LEAST_SHARE
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    most = DICTIONARY_BYTES // 4  # words that a dictionary can hold, a sign and a blank each
    listed = counts.where(F.col("w").isNotNull() & (F.col("w") != "") & (F.col("n") >= 2) & F.col("lang").isin(labels))
    listed = cut(listed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most))
    result = []
    for label in labels:
        kept, size = [], 0
        for r in listed.where(F.col("lang") == label).orderBy("at").collect():
            b = f" {r['w']}".encode("utf-16-le", "surrogatepass")
            if size + len(b) <= DICTIONARY_BYTES:
                kept.append(b)
                size += len(b)
        result.append(b"".join(reversed(kept)) + b" \0")
    return result


@lru_cache(1)
def _restorer(dictionaries: tuple[bytes, ...]) -> Restorer:
    return Restorer(list(dictionaries))


def restorer_of(dictionaries: list[bytes]) -> Restorer:
    """The process's restorer for these dictionaries; what it has learnt about words serves all tasks of a worker."""
    return _restorer(tuple(dictionaries))


def restore(df: DataFrame, key: str = "witness_id", every: bool = True) -> DataFrame:
    """(key, garbled, restored, chains) of every row with a text, or only of the garbled ones."""
    trained = df.sparkSession.sparkContext.broadcast(dictionaries(df, key))  # at most DICTIONARY_BYTES / LEAST_SHARE, some 100 MB; four languages take less than 1 MB

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        restorer = restorer_of(trained.value)
        for r in rows:
            text, chains, garbled = restorer.restore(r["t"])
            if every or garbled:
                yield r["k"], garbled, text, chains

    source = spread(df.where(F.col("text").isNotNull()).select(F.col(key).alias("k"), F.col("text").alias("t")))
    return arrow_rows(source, run, f"{key} long, garbled boolean, restored string, chains array<string>", flush=512)


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected witnesses with the text they had before."""
    return restore(read_table(spark, sf_dir, "witness"), every=False).select("witness_id", "restored", "chains").dropDuplicates(["witness_id"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(read_table(spark, sf_dir, "witness"), every=False).select("witness_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}

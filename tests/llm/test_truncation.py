"""Truncation: endings, cutting lengths, near-copies and whole tables."""

import random
from collections import Counter

import pytest

from textloom.llm import truncation as T
from textloom.llm.leak import words

NOUNS = "stone river castle garden bell market anchor forest palace window".split()
VERBS = "watched crossed guarded reached praised".split()
SCHEMA = "doc_id long, text string, source string, doc_kind string, word string"


def sentence(r):
    return f"The {r.choice(['old', 'grey', 'humble', 'bitter'])} {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} near the {r.choice(NOUNS)}."


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        rows.append((i, " ".join(sentence(r) for _ in range(r.randrange(8, 14))), "plain", "prose", "x"))
    for i in range(300, 340):
        t = " ".join(sentence(r) for _ in range(20))
        rows.append((i, t[:400] if not t[:400].rstrip().endswith(".") else t[:398], "cutter", "prose", "x"))
    for i in range(340, 350):
        rows.append((i, " ".join(sentence(r) for _ in range(4)) + "\n\nFinis", "plain", "prose", "x"))
    for i in range(350, 360):
        lines = [sentence(r)[:-1] for _ in range(5 + i % 4)]
        rows.append((i, "\n".join(lines), "plain", "verse", "x"))
    whole = " ".join(sentence(r) for _ in range(14))
    extra = [
        (400, whole, "plain", "prose"), (401, whole[: len(whole) * 2 // 3].rsplit(" ", 1)[0] + " ca", "mail", "prose"), (402, whole[: len(whole) * 2 // 3].rsplit(" ", 1)[0] + " ca", "mail", "prose"),
        (403, sentence(r) + " The old stone wat…", "feed", "note"), (404, sentence(r) + " …", "feed", "note"), (405, None, "plain", None), (406, "   ", None, None), (407, sentence(r) + "   \n\n", "plain", "prose"),
        (408, sentence(r) + " The grey", "mail", "letter"), (409, "— Anna Berg, Rom", "plain", "letter"),
    ]
    rows += [(*x, "x") for x in extra]
    return spark.createDataFrame(rows, SCHEMA)


def test_table(corpus):
    rows = {r.doc_id: r for r in T.judge(corpus).collect()}
    assert all(not rows[i].truncated for i in range(300)), [i for i in range(300) if rows[i].truncated]
    assert all(rows[i].truncated for i in range(300, 340))
    assert all(not rows[i].truncated for i in range(340, 360))
    assert {i: rows[i].truncated for i in range(400, 409) if i in rows} == {400: False, 401: True, 402: True, 403: True, 404: False, 406: False, 407: False, 408: True}
    assert 405 not in rows


def test_near_copy_that_goes_on():
    r = random.Random(3)
    whole = " ".join(sentence(r) for _ in range(10))
    cut = whole[: whole.rindex("near")]
    assert T.goes_on(cut + "ne", whole) and T.goes_on(cut, whole)
    assert not T.goes_on(whole, cut) and not T.goes_on(whole, whole) and not T.goes_on("other words entirely here and there", whole)
    assert not T.goes_on(whole[: whole.index(".") + 1] + " " + whole[whole.index(".") + 2 :].split(".")[0] + ".", whole)


def test_every_holder_of_a_band_is_compared(spark):
    r = random.Random(5)
    verse = "\n".join(sentence(r)[:-1] for _ in range(6))
    whole = verse + " while the bell rang over all the quiet hills"
    rows = [(1, verse, "a", "verse", "x"), (2, whole, "a", "verse", "x")]
    rows += [(10 + i, " ".join(sentence(r) for _ in range(20)) + " " + verse + " and then " + " ".join(sentence(r) for _ in range(30 + i)), "a", "prose", "x") for i in range(3)]
    short = "Seven lanterns burned beside the frozen harbour gate"
    rows += [(20, short, "a", "verse", "x"), (21, short + " until morning came with snow", "a", "verse", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {x.doc_id for x in T.copies(docs, T.endings(docs)).join(docs.selectExpr("doc_id", "xxhash64(text) AS h"), "h").collect()}
    assert 1 in found and 2 not in found and all(T.block_bands(t) for t in (short, verse))


def test_large_groups_and_the_joined_way(spark, monkeypatch):
    monkeypatch.setattr(T, "SENT_IDS", 0)
    r = random.Random(9)
    verse = "\n".join(sentence(r)[:-1] for _ in range(6))
    rows = [(i, verse, "a", "verse", "x") for i in range(5)]
    rows += [(100 + i, " ".join(sentence(r) for _ in range(12)) + " " + verse + " and so " + " ".join(sentence(r) for _ in range(12)), "a", "prose", "x") for i in range(40)]
    rows.append((200, verse + " until the ships came home", "a", "verse", "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {x.doc_id for x in T.copies(docs, T.endings(docs)).join(docs.selectExpr("doc_id", "xxhash64(text) AS h"), "h").collect()}
    assert {0, 1, 2, 3, 4} <= found and 200 not in found


def test_bands_meet_for_copies():
    r = random.Random(4)
    t = " ".join(sentence(r) for _ in range(30))
    a = {b for b, *_ in T.block_bands(t)}
    b = {b for b, *_ in T.block_bands(t[: len(t) // 2] + " The")}
    assert a & b and T.block_bands("too short") == []


def test_empty(spark):
    assert T.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_of_one_text_end_early_and_numbers_stay(spark):
    r = random.Random(12)
    verse = "\n".join(sentence(r)[:-1] for _ in range(6))
    alone = "Nine copper kettles whistled while tired sailors counted every broken lantern beside that frozen northern harbour gate"
    rows = [(1, verse, "a", "verse", "x"), (2, verse, "b", "verse", "x"), (3, verse + " until the ships came home", "a", "verse", "x"), (4, alone, "a", "prose", "x"), (5, alone, "b", "prose", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    h = {x.h: x.doc_id for x in docs.selectExpr("doc_id", "xxhash64(text) AS h").where("doc_id NOT IN (2, 5)").collect()}
    held = T.shared_bands(T.endings(docs)).collect()
    assert {h[x.h] for x in held} == {1, 3} and {h[x.h] for x in held if x.asks} == {1, 3} and all(x.tail >= 0 for x in held)
    assert {x.h for x in T.copies(docs, T.endings(docs)).collect()} == {k for k, v in h.items() if v == 1}


def test_a_full_stop_alone_is_not_looked_at_as_a_trace(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def search(self, body):
            self.calls += 1
            return self.pattern.search(body)

    counted = Counted(T._TRACE)
    monkeypatch.setattr(T, "_TRACE", counted)
    assert all(T.trace(x) is None for x in ("the end.", "", "the end", "the end..", "."))
    assert counted.calls == 0
    assert [T.trace(x).group() for x in ("the …", "the ....", "the [...]", "the (…)", "the <truncated>", "the [trunc]")] == [" …", " ....", " [...]", " (…)", " <truncated>", " [trunc]"]


ODD = "aB Σσς'.’-_é́̈İẞﬁ½²Ⅷ٣你。 \n\t\x1c!?:·Ⓐ가[]…0—"


def odd_texts(n):
    r = random.Random(7)
    return ["", " ", "ΟΔΟΣ'Α ΟΔΟΣ", "the end—and\u00a0the"] + ["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(n)]


def test_words_are_read_once_for_all_their_uses(monkeypatch):
    read = []
    monkeypatch.setattr(T, "words", lambda text: read.append(text) or words(text))
    monkeypatch.setattr(T, "_folded", T._Remembered(lambda chunk: "".join(f"{w} " for w in T.words(chunk))))
    text = "L’été, the stone bridge; " * 500
    assert T.prepared(text) == (" ".join(words(text)), 2500)
    assert sorted(read) == ["L’été", "bridge", "stone", "the"]


def test_words_by_chunks_are_the_words_of_the_text():
    for t in odd_texts(3000):
        assert T.words_line(t) == " ".join(words(t)), t
        plain = T._PLAIN.findall(t.lower())
        assert b"".join(map(T._plain.__getitem__, T._encoded(t.lower()).translate(T._GAPS).split())) == T._hashed(plain), t


def test_bands_of_many_texts_at_once_are_those_of_each():
    r = random.Random(8)
    texts = ["", "too short", *(" ".join(sentence(r) for _ in range(r.randrange(1, 30))) for _ in range(40)), *odd_texts(40)]
    together = T._bands(texts)
    assert len(together) == len(texts) and T._bands([]) == [] and any(len(b) for b, _ in together)
    for t, (bands, tails) in zip(texts, together):
        alone, follow = T._bands([t])[0]
        assert bands.tolist() == alone.tolist() and tails.tolist() == follow.tolist() and len(bands) == 2 * len(tails)


def test_an_end_is_found_by_hashes_where_its_words_are():
    r = random.Random(10)
    known = T._Closes()
    for _ in range(2000):
        base = [r.choice("the old man sat in ca cab cabin by the sea and sang".split()) for _ in range(30)]
        close = base[8:20]
        for _ in range(r.randrange(3)):
            close[r.randrange(12)] = r.choice(base)
        known.read({" ".join(close), ""})
        a, grams, each = known[" ".join(close)]
        held = set(T._shingle_hashes(["too short", " ".join(base), "", "other words that come after these"])[1])
        assert {k for k, x in enumerate(grams) if x in held} == {k for k, x in enumerate(T.shingles(a)) if x in set(T.shingles(base))}
        if not held.isdisjoint(each):
            assert T.ahead(a, " ".join(base), max(k for k, x in enumerate(grams) if x in held)) == T.ahead(a, " ".join(base))
    assert known[""] == ([], [], frozenset()) and T._shingle_hashes([]) == [] and T._shingle_hashes(["", "a b"]) == [[], []]


def test_ends_with_a_stop_are_closed():
    r = random.Random(11)
    for _ in range(5000):
        t = "".join(r.choice("ab É.!?\"'”’“»)] \n…") for _ in range(r.randrange(12))).rstrip()
        assert T.is_closed(t) == bool(T._CLOSED.search(t)), t
        assert bool(T._SHORT.search(t[-T.SHORT_END :])) == bool(T._SHORT.search(t)), t


def test_the_word_after_is_looked_at_in_its_chunks():
    text = "One (two) three. Four\nfive, l’été six — seven" + " and so on" * 50
    goes_on = [T._continues(text, i) for i in range(12)]
    assert goes_on == [False, True, True, False, False, True, True, True, True, True, True, True]
    assert len(T._around(text, 100)[0]) < 10 and not T._continues(text, 1000)


def test_counts_of_words(spark):
    texts = [t for t in odd_texts(300) if t.strip()] + ["the l’été; the porte-plume d'or the", "end_of the"]
    counts = Counter()
    for t in texts:
        counts.update(T._TOKEN.findall(t.lower())[:-1])
    rows = T.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    found = {x.word: x.n for x in rows if x.n}
    assert {w: n for w, n in found.items() if not w.endswith(".")} == {w: n for w, n in counts.items() if T._encoded(w).translate(T._TOKEN_GAPS).strip()}


def test_sketches_lack_no_more_than_a_copy_may():
    r = random.Random(13)
    told = 0
    for k in range(400):
        base = [r.choice("the old man sat in ca cab cabin by sea and sang loud while ship came home".split()) + str(r.randrange(9)) for _ in range(r.randrange(3, 120))]
        other = list(base)
        for _ in range(r.randrange(6)):
            other[r.randrange(len(other))] = r.choice(base)
        text, copy = " ".join(base) + r.choice(["", " …", " <truncated>", " ΟΔΟΣ"]), " ".join(["so", "it", "is", *other, "and", "on"])
        (_, own, lacks), (held, _, none) = T._sketches([text, copy], [True, False])
        a, grams = T._own(text)
        missing = sum(int(x & ~y).bit_count() for x, y in zip(own.view("uint64").tolist(), held.view("uint64").tolist()))
        holds = sum(map(set(T.shingles(words(copy))).__contains__, grams))
        assert none is None and len(own) == T.SKETCH // 64
        if len(a) > T.SHINGLE and holds >= T.SIMILAR * len(grams):
            assert missing <= lacks
            told += 1
    assert told > 50 and T._sketches([], []) == []


def test_pairs_of_a_hot_band_are_told_apart_before_they_are_written(spark, monkeypatch):
    r = random.Random(14)
    verse = "\n".join(sentence(r)[:-1] for _ in range(8))
    rows = [(i, " ".join(sentence(r) for _ in range(12)) + " " + verse + " " + " ".join(sentence(r) for _ in range(6)) + " The grey", "a", "prose", "x") for i in range(30)]
    whole = " ".join(sentence(r) for _ in range(8)) + " " + verse + " " + " ".join(sentence(r) for _ in range(6))
    rows += [(100, whole + " The grey castle", "a", "prose", "x"), (101, whole + " The grey castle guarded the old bell", "a", "prose", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    h = {x.h: x.doc_id for x in docs.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    ends = T.endings(docs)
    band = T.shared_bands(ends)
    met = band.where("asks").select("band", "h").join(band.select("band", band.h.alias("other")), "band").where("h <> other").select("h", "other").distinct().count()
    ask = {x.c: h[x.h] for x in ends.where("close IS NOT NULL").selectExpr("h", "xxhash64(close) AS c").collect()}
    once = {(x.c, x.other) for x in T._candidates(ends).collect()}
    assert met >= 30 * 29 and len(once) < 30 and (100, 101) in {(ask[c], h[o]) for c, o in once}
    monkeypatch.setattr(T, "TILE", 3)
    monkeypatch.setattr(T, "PASS", 1)
    assert {(x.c, x.other) for x in T._candidates(ends).collect()} == once
    assert 100 in {h[x.h] for x in T.copies(docs, ends).collect()}

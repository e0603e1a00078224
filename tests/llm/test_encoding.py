"""Encoding repair: round trips of known damage, clean texts, edge cases."""

import time

import pytest

from textloom.llm import encoding as E

CLEAN = {
    "fr": "À la forêt, l’étranger fidèle regarda la mer dorée ; Mérovaux brisa l’épée près du château oublié. « Où est la clé ? » demanda Sévrinne",
    "de": "Der müde Wächter prüfte die Brücke, während der König süße Träume vergaß. „Wer trug das Gefängnis?“, fragte Quentrain über die Straße",
    "ru": "Молодой учитель купил старый корабль, когда последний писец зажёг тёмный костёр в седьмой год до полуночи",
    "en": "It was Sévrinne’s custom — a naïve one — to keep the café near the façade of Fennistère; nobody in Rûneval didn’t mind",
}


@pytest.fixture(scope="module")
def rows(spark):
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate((k, v) for _ in range(6) for k, v in CLEAN.items())]
    return rows


@pytest.fixture(scope="module")
def restorer(spark, rows):
    df = spark.createDataFrame(rows, "witness_id long, text string, lang string, extra string")
    return E.Restorer(E.dictionaries(df, "witness_id"))


def broken(text, was, read_as):
    return "".join(E._decoder(read_as)[b] for b in text.encode(was))


@pytest.mark.parametrize("lang, was, read_as", [(lang, "utf-8", a) for lang in CLEAN for a in ("western", "mac_roman", "cp850", "cp1251")] + [("ru", "cp1251", "western"), ("ru", "koi8_r", "cp1251"), ("fr", "cp1252", "mac_roman"), ("de", "cp1252", "mac_roman")])
def test_round_trip(restorer, lang, was, read_as):
    damaged = broken(CLEAN[lang], was, read_as)
    text, chains, garbled = restorer.restore(damaged)
    assert garbled and chains and text == CLEAN[lang]


def test_double_damage_and_part_of_a_text(restorer):
    twice = broken(broken(CLEAN["fr"], "utf-8", "western"), "utf-8", "western")
    assert restorer.restore(twice)[0] == CLEAN["fr"]
    half = CLEAN["ru"][:40] + " " + broken(CLEAN["ru"], "utf-8", "western")
    assert restorer.restore(half)[0] == CLEAN["ru"][:40] + " " + CLEAN["ru"]


def test_clean_and_foreign_texts_stay(restorer):
    for text in [*CLEAN.values(), "À BOIRE, ÎLE D’ÉLONCOURT", "Ångelholt, färdväg", "Maçãs e romãs, MANHÃ CLARA", "Ðornel ok Þrúdvar", "Αἴολος ὁ γραφεύς", "§ 4 © ½ ¶", "Thе hіdden", "", None, "plain"]:
        assert restorer.restore(text) == (text, [], False)


def test_lost_signs_are_found(restorer):
    assert restorer.restore("Fennist�re")[2] and restorer.restore("l\x92arbre")[0] == "l’arbre"


def test_long_text(restorer):
    text = " ".join([CLEAN["fr"]] * 400)
    assert restorer.restore(broken(text, "utf-8", "western"))[0] == text


def test_damaged_words_stay_out_of_the_dictionary(spark, rows):
    damaged = "Der w‰hrend T¸r gr¸ne Maﬂ fehlt"
    clean = [(i, "Der während Tür grüne Maß fehlt", "de", "x") for i in range(100, 160)]
    few = [(200, damaged, "de", "x"), (201, damaged + " noch", "de", "x"), (202, "Der Türﬂügel fehlt", "de", "x"), (202, "Der Türﬂügel fehlt", "de", "x")]
    df = spark.createDataFrame([*rows, *clean, *few], "witness_id long, text string, lang string, extra string")
    dictionaries = E.dictionaries(df, "witness_id")
    held = {w for d in dictionaries for w in d.decode("utf-16-le").split(" ")}
    assert {"während", "Tür", "grüne", "Maß"} <= held and held.isdisjoint({"w‰hrend", "T¸r", "gr¸ne", "Maﬂ", "noch", "Türﬂügel"})
    restorer = E.Restorer(dictionaries)
    assert restorer.restore(damaged)[::2] == ("Der während Tür grüne Maß fehlt", True)


def test_dictionaries_count_every_text(spark, rows, monkeypatch):
    long = " ".join(["Fennistère garda la clé"] * 30_000)  # more characters than a sample would take of one text
    spoilt = [(i, "Der Tür fehlt", "de", "x") for i in range(300, 340)] + [(400, "Der T¸r fehlt", "de", "x"), (401, "Der T¸r fehlt", " DE ", "x"), (401, "Der T¸r fehlt", " DE ", "x")]
    df = spark.createDataFrame([*rows, (200, long, "fr", "x"), (201, long, "fr", "x"), (201, long, "fr", "x"), (500, None, "fr", "x"), (None, "Der Tür", "de", "x"), *spoilt], "witness_id long, text string, lang string, extra string")
    held = {w for d in E.dictionaries(df, "witness_id") for w in d.decode("utf-16-le").split(" ")}
    assert "Fennistère" in held and "T¸r" not in held
    sent = {tuple(r) for r in E.clean_counts(df, "witness_id").collect()}
    assert ("fr", "Fennistère", 2) in sent and ("de", "Tür", 41) in sent and ("de", None, 41 + 6) in sent and ("fr", None, 2 + 6) in sent
    monkeypatch.setattr(E, "SENT_WORDS", 0)
    assert sent == {tuple(r) for r in E.clean_counts(df, "witness_id").collect()}


def test_table(spark, rows):
    bad = broken(CLEAN["fr"], "utf-8", "western")
    df = spark.createDataFrame([*rows, (100, bad, None, "x"), (100, bad, None, "x"), (101, None, "fr", None), (102, "", "und", None)], "witness_id long, text string, lang string, chains string")
    found = E.restore(df).where("garbled").dropDuplicates(["witness_id"]).collect()
    assert [(r.witness_id, r.restored) for r in found] == [(100, CLEAN["fr"])]


def test_empty_table(spark):
    df = spark.createDataFrame([], "witness_id long, text string, lang string")
    assert E.restore(df).collect() == []


def test_long_words_take_time_in_proportion_to_their_length():
    text = "a" * 60_000 + " cafÃ© cafÃ© déjà cafÃ©\r\n\n" + "b" * 60_000
    restorer = E.Restorer(["café déjà vu ".encode("utf-16-le") * 20])
    began = time.process_time()
    restored, _, garbled = restorer.restore(text)
    assert time.process_time() - began < 2
    assert (restored, garbled) == (text.replace("Ã©", "é"), True)


def test_signs_of_damage_are_looked_for_once_a_word():
    assert E._words("(the end),\n\n the\tgrey\rend") == {"", "the", "end", "grey"}  # blanks aren't words
    for word in ("a\x92b", "grEy", "Ã© ", "naÃïë", "Р°"):
        assert E._words(f"the {word} end") is None


def test_hard_signs_make_a_text_garbled_each_time():
    restorer = E.Restorer([])
    assert [restorer.restore(f"the grey\x81 end {i}")[2] for i in range(3)] == [True] * 3
    assert not restorer.restore("the grey é end")[2]


def test_words_are_judged_alike_when_few_are_remembered():
    texts = [f"le cafÃ© numéro {i} déjà vu à la cafÃ© fidÃ¨le étrangère" for i in range(20)]
    d = ["café déjà fidèle étrangère à numéro ".encode("utf-16-le") * 20]
    few, many = E.Restorer(d, remember=3), E.Restorer(d)
    assert [few.restore(x) for x in texts] == [many.restore(x) for x in texts]
    assert len(few.plain) <= 3

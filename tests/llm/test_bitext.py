"""Bilingual alignment: sentences, decoding, and a small table with known pairs."""

import random

import numpy as np
import pytest

from tests.helpers import write
from textloom.llm import bitext as B

PAIRS = {f"mot{chr(97 + i // 10)}{chr(97 + i % 10)}": f"word{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(80)}
PAIRS |= dict(zip("chat chien maison".split(), "cat dog house".split()))


def test_sentences():
    assert [s.strip() for s in B.sentences("One. Two? “Why?” he said! rest")] == ["One.", "Two?", "“Why?” he said!", "rest"]
    assert B.sentences(None) == [] and B.sentences("  ") == [] and B.sentences("3.5 m. x") == ["3.5 m.", " x"]


def test_decoding_follows_the_scores():
    score = np.full((B.SPANS, 3, 3), -20.0)
    score[0, 0, 0] = score[0, 2, 1] = score[0, 1, 2] = 20.0
    assert B.decode(score, 3, 3) == [(0, 0), (2, 2), (1, 1)]
    score[:, :, 1] = -20.0
    assert B.decode(score, 3, 3)[1] is None


def make(seed):
    """French sentences, English ones, and which render which: some left out, some merged or split, two swapped."""
    r = random.Random(seed)
    fr = [[r.choice(list(PAIRS)) for _ in range(5)] + [f"Nom{seed}{i}"] for i in range(12)]
    order = list(range(12))
    order[4], order[5] = order[5], order[4]
    order.remove(8)
    en, truth, i = [], set(), 0
    while i < len(order):
        take = [order[i], order[i + 1]] if i == 1 else [order[i]]
        for f in take:
            truth.add((f, len(en)))
        en.append(" and ".join(" ".join(PAIRS.get(w, w) for w in fr[f]) for f in take) + ".")
        i += len(take)
    return " ".join(" ".join(s) + "." for s in fr), "\n".join(en), truth


def test_table(spark, tmp_path):
    rows, truth = [], set()
    for c in range(40):
        fr, en, links = make(c)
        rows += [(2 * c + 1, c, 0, f"fr-{c}", fr, "fr"), (2 * c + 2, c, 1, f"en-{c}", en, "en")]
        truth |= {(2 * c + 1, f, 2 * c + 2, e) for f, e in links}
    rows += [rows[0], (900, 0, 2, "en-null", None, "en"), (901, 0, 3, "en-empty", "", "en"), (902, 99, 0, "fr-alone", "Un chat.", "fr")]
    write(tmp_path, spark, "witness", rows, "witness_id long, case_id long, ordinal int, siglum string, text string, lang string")
    write(tmp_path, spark, "case_meta", [(c, "general") for c in range(40)] + [(0, "general"), (99, None)], "case_id long, lexicon_name string")
    write(tmp_path, spark, "lexicon", [("general", 1, " Chat ", "cat", None), ("general", 1, "cat", "cat", None), ("general", 2, "alone", "alone", None), ("general", 3, None, None, None)], "lexicon_name string, group_no int, form string, pivot_form string, lang string")
    found = {tuple(r) for r in B.p4_found(spark, str(tmp_path)).collect()}
    hit = len(found & truth)
    assert hit / len(truth) > 0.93 and hit / len(found) > 0.93, (hit, len(truth), len(found))
    assert not any(902 in (r[0], r[2]) for r in found)


def test_both_ways_to_the_tables_agree(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 1, 2, [["chat", "vieux"], ["pont", "mer"]], [["old", "cat"], ["bridge", "sea"]])], "pid long, fr_id long, en_id long, fr array<array<string>>, en array<array<string>>")
    t = spark.createDataFrame([("chat", "cat", 0.9), ("vieux", "old", 0.9), ("pont", "bridge", 0.9), ("mer", "sea", 0.9)], "f string, e string, t double")
    p = spark.createDataFrame([(w, 0.01) for w in ("old", "cat", "bridge", "sea")], "e string, p double")
    lex = spark.createDataFrame([], "grp long, form string")

    def work(rows, odds_of):
        for r in rows:
            for i, j in B.align_pair(odds_of(r)):
                yield i, j

    sent = sorted(map(tuple, B.over_pairs(pairs, t, p, lex, work, "i int, j int").collect()))
    monkeypatch.setattr(B, "SENT_ROWS", 0)
    assert sent == sorted(map(tuple, B.over_pairs(pairs, t, p, lex, work, "i int, j int").collect())) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("n", [3, 60, 130, 200])
def test_window_gives_what_the_table_gives(n):
    r = np.random.default_rng(n)
    best = r.integers(-400, 0, n + 1) / 4
    reach = best[:, None] + B._jumps(n)
    into, came = B._reached(best, n)
    assert np.allclose(into, reach.max(0)) and np.allclose(reach[came, np.arange(n)], reach.max(0))


def test_long_documents_take_the_diagonal():
    n = 400
    score = np.full((B.SPANS, n, n), -20.0)
    score[0][np.arange(n), np.arange(n)] = 12.0
    assert B.decode(score, n, n) == [(i, i) for i in range(n)]


def test_damaged_words_are_read_with_the_words_of_all_texts(spark, tmp_path):
    plain = "Fennistère fidèlement préféra l’étrangère mystérieusement"
    damaged = "".join(chr(b) if b < 128 else bytes([b]).decode("mac_roman") for b in plain.encode("cp1252"))
    rows = [(i, 50, i, f"x{i}", " ".join([plain] * 12_000), "fr") for i in (10, 11)]  # more characters than a sample would take of one text
    rows += [(1, 1, 0, "fr-1", damaged + ".", "fr"), (2, 1, 1, "en-1", "A cat.", "en")]
    write(tmp_path, spark, "witness", rows, "witness_id long, case_id long, ordinal int, siglum string, text string, lang string")
    write(tmp_path, spark, "case_meta", [(1, "general"), (50, None)], "case_id long, lexicon_name string")
    found = B.document_pairs(spark, str(tmp_path)).collect()
    assert [r.fr for r in found] == [B.sentence_words(plain + ".")]


def test_sentences_keep_their_words_as_lines(spark):
    sents = [[], ["le", "soir"], [], ["l", "été"], []]
    row = spark.createDataFrame([(sents, []), ([[]], sents)], "fr array<array<string>>, en array<array<string>>").select(B._as_lines("fr"), B._as_lines("en")).collect()
    assert [[B._of_lines(x) for x in r] for r in row] == [[sents, []], [[[]], sents]]


def test_tables_as_a_whole_give_the_odds_of_single_words():
    fr, en = [["le", "soir", "anna"], ["la", "mer"], []], [["the", "evening", "anna"], ["sea", "zzz"]]
    table = [("le", "the", 0.6), ("soir", "evening", 0.8), ("soir", "the", 0.1), ("mer", "ocean", 0.4), ("autre", "sea", 0.9)]
    lexicon, background = [("mer", 1), ("sea", 1), ("soir", 2), ("evening", 2)], [("the", 0.2), ("evening", 0.01)]
    row = dict(zip(("fr", "en"), ("".join(" ".join(s) + "\n" for s in x) for x in (fr, en))))
    single, whole = (B.Local(table, lexicon, background, 1e-4, kind).odds(row) for kind in (None, B.Whole))
    assert (single.t == whole.t).all() and single.t[1, 1] == 0.8 and single.t[3, 4] == B.LEXICON and single.t[2, 2] == B.SAME
    assert B.align_pair(single) == B.align_pair(whole) == [(0, 0), (1, 1)]


def test_decoding_takes_the_first_of_equal_spans():
    r = np.random.default_rng(1)
    for n, m in ((1, 4), (2, 3), (7, 9), (130, 12)):
        score = r.integers(0, 4, (B.SPANS, n, m)) * 4.0
        jump, best, trail = B._jumps(n), np.full(n + 1, -np.inf), []
        best[0] = 0.0
        for j in range(m):
            reach = best[:, None] + jump
            came = reach.argmax(0)
            now, length = list(best), [0] * (n + 1)
            for at in range(1, n + 1):
                for k in range(min(B.SPANS, at)):
                    gain = reach[came[at - k - 1], at - k - 1] + score[k, at - k - 1, j] - B.NULL - B.SPAN_PRICE * k
                    if gain > now[at]:
                        now[at], length[at] = gain, k + 1
            best = np.array(now)
            trail.append((length, came))
        at, expected = int(best.argmax()), [None] * m
        for j in range(m - 1, -1, -1):
            length, came = trail[j]
            if length[at]:
                lo = at - length[at]
                expected[j], at = (lo, at - 1), int(came[lo])
        assert B.decode(score, n, m) == expected

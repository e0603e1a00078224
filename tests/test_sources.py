"""Reading and checking witnesses; cleaning; functions; metrics against SQL."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import witnesses
from textloom import config
from textloom.functions import text as T
from textloom.sources import text as texts
from textloom.sources import witnesses as sources


def test_folder(spark, tmp_path):
    for name, body in (("b.txt", "two\r\nlines"), ("a.MD", "one"), ("c.html", "no")):
        (tmp_path / name).write_bytes(body.encode())
    (tmp_path / "below").mkdir()
    found = sources.from_directory(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.siglum, r.text) for r in found] == [("a", "one"), ("b", "two\r\nlines")]


def test_files_keep_their_order(spark, tmp_path):
    for name in "xy":
        (tmp_path / f"{name}.txt").write_text(name)
    found = sources.from_files(spark, [str(tmp_path / "y.txt"), str(tmp_path / "x.txt")]).orderBy("ordinal").collect()
    assert [r.siglum for r in found] == ["y", "x"]


def test_order_promotion_and_checks(spark):
    w = witnesses(spark, "a", "b", "c")
    assert [r.siglum for r in sources.ordered(w, ["C", "A"]).orderBy("ordinal").collect()] == ["C", "A"]
    with pytest.raises(sources.WitnessError):
        sources.ordered(w, ["A", "Z"])
    assert [r.siglum for r in sources.promoted(w, "B").orderBy("ordinal").collect()] == ["B", "A", "C"]
    sources.checked(w)
    with pytest.raises(sources.WitnessError):
        sources.checked(witnesses(spark, "a"))
    with pytest.raises(sources.WitnessError):
        sources.checked(witnesses(spark, "a", "b", sigla="AA"))


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("# all comment\nmer, sea, ocean # end\r\nlone\nFin , end\r\n")
    found = sources.lexicon(sources.lexicon_lines(spark, str(tmp_path / "lex.txt")))
    assert {tuple(r) for r in found.collect()} == {("mer", "mer"), ("sea", "mer"), ("ocean", "mer"), ("fin", "end"), ("end", "end")}


def test_selection_and_strategy():
    assert sources.parse_selection("all", 3) == [0, 1, 2]
    assert sources.parse_selection("3, 1 9 3", 3) == [2, 0]
    assert config.strategy("Peer") == config.PEER_MSA and config.strategy(None) == config.BASE_ANCHORED and config.strategy("", False) == config.PEER_MSA
    with pytest.raises(ValueError):
        config.strategy("other")


def test_cleaning_and_marks(spark):
    raw = "x\n*** START OF THE EBOOK ***\nProduced by N\nOne\n\n\n\nTwo\n*** END OF THE EBOOK ***\nlicence"
    row = spark.createDataFrame([(raw, "l0\nl1\nl2")], "a string, b string").select(
        texts.cleaned(F.col("a")).alias("clean"),
        texts.marked(F.col("b"), F.array(F.struct(F.lit(1).alias("at"), F.lit("<!-- page break -->").alias("mark")))).alias("marked"),
        texts.between(F.col("b"), "l1", "\nl2").alias("between"),
        texts.excluded_front(F.col("b"), "l1").alias("front"),
    )
    r = row.first()
    assert r.clean == "One\n\nTwo" and r.marked == "l0\n<!-- page break -->\nl1\nl2" and r.between == "l1"
    assert r.front == "<!-- no_collate\nl0\n\n-->\nl1\nl2"


def test_functions(spark):
    r = spark.createDataFrame([('a "b", c', "<a&b>", " Two  Words ", "a𠀀")], "q string, h string, k string, u string").select(T.csv_quote(F.col("q")), T.escape_html(F.col("h")), T.insertion_key(F.col("k")), T.utf16_len(F.col("u")), T.strip_accents(F.lit("Éàñøй")), T.percent(F.lit(12.0)), T.percent(F.lit(3.14))).first()
    assert list(r) == ['"a ""b"", c"', "&lt;a&amp;b&gt;", "two words", 3, "Eanøи", "12%", "3.1%"]


def test_synthetic_pairs(spark):
    w = texts.synthetic(spark, 2, 50, 0.5, 0.2).collect()
    assert len(w) == 4 and all(len(r.text.split()) == 50 for r in w)


def test_what_was_exchanged_for_a_table_is_removed_with_it(spark):
    from textloom.session import cut, discard

    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    table = cut(spark.range(1000).repartition(3, "id").groupBy("id").count())
    assert not files() - before and table.count() == 1000
    discard(table)

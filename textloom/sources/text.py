"""Preparing raw editions, and making synthetic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lines that enclose the text of a public-domain file, and lines its producers added.
START = r"(?s)^.*?\*\*\* ?START OF TH(?:E|IS) [^\n]*\*\*\*[^\n]*\n"
END = r"(?s)\n[^\n]*\*\*\* ?END OF TH(?:E|IS) .*$"
PRODUCED = r"(?mi)^(?:produced by|e-text prepared by|transcribed by)[^\n]*\n"


def cleaned(text: Column) -> Column:
    """Without file boundaries and producers' lines, blank lines collapsed to one."""
    for pattern in (START, END, PRODUCED):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n{3,}", "\n\n"))


def between(text: Column, first: str, last: str | None = None) -> Column:
    """From the first match of ``first`` up to the next of ``last``; null where the former is missing."""
    return F.nullif(F.regexp_extract(text, f"(?s)({first}.*?){f'(?={last})' if last else chr(92) + 'z'}", 1), F.lit(""))


def excluded_front(text: Column, first: str) -> Column:
    """All before the first match of ``first`` put into an excluded region."""
    at = F.regexp_instr(text, F.lit(first))
    front = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 1, F.concat(F.lit("<!-- no_collate\n"), front, F.lit("\n-->\n"), F.substring(text, at, F.char_length(text)))).otherwise(text)


def marked(text: Column, marks: Column) -> Column:
    """Lines of ``text`` with the lines of ``marks`` (array of structs at, mark) put before the line numbers ``at``."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("k"), x.alias("line")))
    added = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), F.lit(0).alias("k"), m["mark"].alias("line")))
    return F.array_join(F.transform(F.array_sort(F.concat(lines, added)), lambda x: x["line"]), "\n")


def synthetic(spark: SparkSession, works: int, words: int, diversity: float, edit_rate: float = 0.05, seed: int = 0, page: int = 200) -> DataFrame:
    """Pairs of generated witnesses: a share ``diversity`` of words is distinctive, ``edit_rate`` of these is changed."""
    pick = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_000)) / 1_000_000
    common = F.array(*map(F.lit, "the of and to in that was his with for had not".split()))
    word = F.when(pick("work", "i", F.lit(1)) < diversity, F.concat(F.lit("tok"), F.col("i").cast("string"))).otherwise(F.element_at(common, 1 + F.pmod(F.xxhash64(F.lit(seed), "work", "i", F.lit(2)), F.lit(12)).cast("int")))
    told = spark.range(works).withColumnRenamed("id", "work").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(words - 1)))).withColumn("word", word)
    told = told.withColumn("word", F.when((F.col("i") > 0) & (F.col("i") % page == 0), F.concat(F.lit("\n\f\n"), "word")).otherwise(F.col("word")))
    edited = F.when(F.col("word").startswith("tok") & (pick("work", "i", F.lit(3)) < edit_rate), F.concat(F.lit("edit"), F.col("i").cast("string"))).otherwise(F.col("word"))
    texts = told.groupBy("work").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", w.alias("w")))), lambda x: x["w"]), " ").alias(n) for n, w in (("a", F.col("word")), ("b", edited))])
    return texts.select(F.col("work").alias("work_id"), F.explode(F.array(F.struct(F.lit("A").alias("siglum"), F.lit(0).alias("ordinal"), F.col("a").alias("text")), F.struct(F.lit("B").alias("siglum"), F.lit(1).alias("ordinal"), F.col("b").alias("text")))).alias("w")).select("work_id", "w.*")

"""Problem 2: long exact spans shared between records.

Method: recompression. Rounds name runs and pairs of symbols, starting from characters: a pair is named where its left
symbol falls into the left half and its right symbol into the right half of this round's division of all names. A name
is a 64-bit hash of what it stands for, so every executor gives equal content the same name and the rounds need no
exchange; they run over Arrow batches of many texts at once. Symbols above a round's cap rest, so after ``CAPS`` no
symbol is longer than ``LONGEST`` and a round can change at most one symbol at either end of a shared span. Two equal
spans of ``span`` characters therefore have equal interior symbols for at least ``span - 2 * MARGIN`` characters, and
share windows of consecutive symbols that cover at least ``WINDOW`` characters; of neighbouring windows only the least
by hash is kept, such that one stays in common.

Windows that occur in more than one group (case) mark the places where a long repeat can be. There, and only there,
every stretch of ``span`` characters is named by a 64-bit hash; stretches found in more than one group are the repeats (two
different ones share a name with a chance of 2^-64 per pair of distinct stretches that are marked; ``verified`` compares
the texts of found pairs where that is too much).
Record pairs are made only at the left end of a repeat (the characters before differ, or a text begins), so a shared
span of any length gives its pair once, and a stretch that stands in many records gives no pairs but those asked for.
Stretches held by many records are dealt over a grid of tasks, both sides in parts of ``PER_TASK``.

Defined results: values shorter than ``span`` and null values or groups share nothing; equal values share their whole
text; a record delivered repeatedly counts once; overlapping and periodic repeats count; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from textloom.llm.common import arrow_rows, cut, discard, read_table, spread

SPAN = 150
CAPS = (1, 1, 1, 2, 2, 4)
LONGEST = 8
WINDOW = 60
SHORT_RUN = 4
MARGIN = sum(CAPS) + SHORT_RUN
PER_TASK = 1000
SENT_ROWS = 500_000  # left ends of repeats; some 12 MB

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def reach(span: int) -> int:
    """Characters over which windows can be thinned out such that equal spans still keep one in common.

    Equal spans have ``span - 2 * MARGIN`` equal characters in whole symbols; a window takes ``WINDOW + LONGEST - 1`` of
    them at most, so of the windows that begin within the rest the least by hash is the same in both.
    """
    r = span - 2 * MARGIN - (WINDOW + LONGEST - 1)
    if r < 0:
        raise ValueError(f"spans below {2 * MARGIN + WINDOW + LONGEST - 1} characters need smaller windows")
    return r


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + _mix(b) + np.uint64(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def recompress(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends (within the concatenation) of the last round's symbols, and each symbol's text.

    Between texts stands a symbol too long to be named into any other.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends_of = np.cumsum(lengths + 1) - 1
    names = _mix(codes + np.uint64(1))
    size = np.ones(len(codes), np.int64)
    size[ends_of] = 1 << 20
    start = np.arange(len(codes), dtype=np.int64)

    fresh = np.ones(len(names), bool)  # runs of one character, up to SHORT_RUN
    fresh[1:] = (names[1:] != names[:-1]) | (size[1:] > 1) | (size[:-1] > 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(names)))
    merge = (count > 1) & (count <= SHORT_RUN)
    names[first[merge]] = _pair(names[first[merge]], count[merge].astype(np.uint64))
    size[first[merge]] = count[merge]
    keep = fresh | ~np.repeat(merge, count)
    names, size, start = names[keep], size[keep], start[keep]

    for r, cap in enumerate(CAPS):
        small = size <= cap
        right = (_mix(names ^ np.uint64((r + 1) * 0x2545F4914F6CDD1D % (1 << 64))) & np.uint64(1)).astype(bool)
        can = small[:-1] & small[1:] & ~right[:-1] & right[1:]
        left = np.flatnonzero(can)
        names[left] = _pair(names[left], names[left + 1])
        size[left] += size[left + 1]
        keep = np.ones(len(names), bool)
        keep[left + 1] = False
        names, size, start = names[keep], size[keep], start[keep]
    real = size < (1 << 20)
    names, size, start = names[real], size[real], start[real]
    return names, start, start + size, np.searchsorted(ends_of, start)


def windows(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first character (within the text) of the kept windows of consecutive symbols."""
    names, start, end, text = recompress(texts)
    n = len(names)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, none
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    last = np.searchsorted(end, start + WINDOW)
    ok = np.flatnonzero(last < n)
    ok = ok[text[last[ok]] == text[ok]]
    if not len(ok):
        return np.zeros(0, np.uint64), none, none
    stop = last[ok]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(names) * _powers(_INVERSE, n), dtype=np.uint64)])
    value = _mix((sums[stop + 1] - sums[ok]) * _powers(_BASE, n)[ok] + (stop - ok).astype(np.uint64))
    at, first = text[ok], start[ok]
    kept = _least(value, np.minimum(np.searchsorted(first, first + reach(span), "right"), np.searchsorted(at, at, "right")))
    return value[kept], at[kept], first[kept] - offset[at[kept]]


def _least(value: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Indices that hold the least value of some range [i, stop[i]) (the first of equals), by doubling tables."""
    n = len(value)
    table = [np.arange(n)]
    while (1 << len(table)) <= int((stop - np.arange(n)).max()):
        prior, step = table[-1], 1 << (len(table) - 1)
        other = prior[np.minimum(np.arange(n) + step, n - 1)]
        table.append(np.where(value[other] < value[prior], other, prior))
    length = stop - np.arange(n)
    level = np.log2(length).astype(np.int64)
    stacked = np.stack(table)
    a = stacked[level, np.arange(n)]
    b = stacked[level, stop - (1 << level)]
    return np.unique(np.where(value[b] < value[a], b, a))


def marked(records: DataFrame, span: int = SPAN, chars: int = 300_000) -> DataFrame:
    """(h, rid, grp, lo): the kept symbol windows of every record and where each begins."""
    schema = "h long, rid long, grp long, lo int"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field, rid, grp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("field", "rid", "grp"))
            ends = np.cumsum(pc.utf8_length(b.column("value")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars, "right")))
                value, at, first = windows(b.column("value").slice(lo, hi - lo).to_pylist(), span)
                at += lo
                h = (value ^ _mix(field[at].astype(np.uint64) + np.uint64(77))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rid[at]), pa.array(grp[at]), pa.array(first.astype(np.int32))], schema=arrow)
                lo = hi

    return spread(records.select("field", "rid", "grp", "value")).mapInArrow(run, schema)


def stretches(records: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, rid, grp, pos, prev): every stretch of ``span`` characters at ``pos`` that holds a window shared by two groups.

    ``prev`` is the character before it; a text's beginning has a negative number that tells records apart.
    """
    marks = cut(marked(records, span))
    shared = marks.groupBy("h").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("h")
    places = marks.join(shared, "h").groupBy("rid").agg(F.collect_list("lo").alias("places"))  # bounded by the text

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        import xxhash

        for r in rows:
            text, n = r["value"], len(r["value"])
            data = memoryview(text.encode("utf-32-le", "surrogatepass"))
            done = 0
            for lo in sorted(r["places"]):
                first, last = max(done, lo + WINDOW - span, 0), min(lo, n - span)
                for pos in range(first, last + 1):
                    h = xxhash.xxh3_64_intdigest(data[4 * pos : 4 * (pos + span)], seed=r["field"])
                    yield h - (1 << 63), r["rid"], r["grp"], pos, ord(text[pos - 1]) if pos else -1 - r["rid"]
                done = max(done, last + 1)

    result = cut(arrow_rows(records.join(places, "rid"), run, "k long, rid long, grp long, pos int, prev long", flush=20_000))
    discard(marks)
    return result


def pairs(stretch: DataFrame) -> DataFrame:
    """(a, b), a < b: records of different groups that share a stretch; made at the left ends of the shared spans."""
    ends = cut(stretch.groupBy("k").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min("prev").alias("p0"), F.max("prev").alias("p1")).where("g0 <> g1 AND p0 <> p1").select("k"))
    if ends.count() <= SENT_ROWS:  # else both sides are exchanged
        ends = F.broadcast(ends)
    held = cut(stretch.join(ends, "k"))
    parts = held.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("parts"))
    held = held.join(parts, "k").withColumn("own", F.pmod(F.xxhash64("rid", "pos"), F.col("parts")).cast("int")).withColumn("every", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = held.select("k", F.col("own").alias("x"), F.col("every").alias("y"), F.col("rid").alias("a"), F.col("grp").alias("ga"), F.col("prev").alias("pa"))
    right = held.select("k", F.col("every").alias("x"), F.col("own").alias("y"), F.col("rid").alias("b"), F.col("grp").alias("gb"), F.col("prev").alias("pb"))
    return left.join(right, ["k", "x", "y"]).where("a < b AND ga <> gb AND pa <> pb").select("a", "b").distinct()


def verified(found: DataFrame, records: DataFrame, span: int = SPAN) -> DataFrame:
    """Of ``found(a, b)`` the pairs whose texts do share ``span`` characters."""
    text = records.select("rid", "value").dropDuplicates(["rid"])
    both = found.join(text.select(F.col("rid").alias("a"), F.col("value").alias("x")), "a").join(text.select(F.col("rid").alias("b"), F.col("value").alias("y")), "b")

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            x, y = sorted((r["x"], r["y"]), key=len)
            held = {x[i : i + span] for i in range(len(x) - span + 1)}
            if any(y[i : i + span] in held for i in range(len(y) - span + 1)):
                yield r["a"], r["b"]

    return arrow_rows(both.select("a", "b", "x", "y"), run, "a long, b long")


def classes(stretch: DataFrame) -> DataFrame:
    """(rid, class_id, members): for every repeat, at its left ends, the records that hold it; no pairs are made.

    ``members`` is the number of records of the class. A record stands in as many classes as it holds repeats.
    """
    ends = stretch.groupBy("k").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min("prev").alias("p0"), F.max("prev").alias("p1")).where("g0 <> g1 AND p0 <> p1").select("k")
    held = cut(stretch.join(ends, "k").select("k", "rid").distinct())
    return held.join(held.groupBy("k").agg(F.count(F.lit(1)).alias("members")), "k").select("rid", F.col("k").alias("class_id"), "members")


FIELDS = ("text", "base_reading")


def _name(code: Column) -> Column:
    return F.when(code == 0, FIELDS[0]).otherwise(FIELDS[1])


def records(spark: SparkSession, sf_dir: str, span: int = SPAN) -> DataFrame:
    """(rid, field, id, grp, value): witness texts and base readings of at least ``span`` characters.

    A record delivered repeatedly stands here repeatedly; that adds no pair.
    """
    witness = read_table(spark, sf_dir, "witness").select(F.lit(0).alias("field"), F.col("witness_id").alias("id"), F.col("case_id").alias("grp"), F.col("text").alias("value"))
    variation = read_table(spark, sf_dir, "variation").select(F.lit(1).alias("field"), F.col("variation_id").alias("id"), F.col("case_id").alias("grp"), F.col("base_reading").alias("value"))
    both = witness.union(variation).where((F.char_length("value") >= span) & F.col("id").isNotNull() & F.col("grp").isNotNull())
    return both.withColumn("rid", F.col("id") * 2 + F.col("field"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs(stretches(records(spark, sf_dir)))
    code = F.pmod("a", F.lit(2))
    return found.select(_name(code).alias("field"), F.floor(F.col("a") / 2).cast("long").alias("id_a"), F.floor(F.col("b") / 2).cast("long").alias("id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeats themselves: which records hold each, and how many they are."""
    return classes(stretches(records(spark, sf_dir))).select(_name(F.pmod("rid", F.lit(2))).alias("field"), F.floor(F.col("rid") / 2).cast("long").alias("record_id"), "class_id", "members")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record, how many of its characters stand in a span shared with another case, and their share.

    Records too short to share a span, and empty ones, have the share 0; null values have no row.
    """
    rec = records(spark, sf_dir)
    stretch = stretches(rec)
    common = stretch.groupBy("k").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("k")
    at = F.col("starts")
    covered = F.aggregate(
        F.array_sort(at),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["sum"] + p + SPAN - F.greatest(p, acc["end"])).alias("sum"), (p + SPAN).alias("end")),
        lambda acc: acc["sum"],
    )
    sums = stretch.join(common, "k").groupBy("rid").agg(F.collect_set("pos").alias("starts")).select("rid", covered.alias("shared_chars"))
    chars = records(spark, sf_dir, 0).select("rid", "field", "id", F.char_length("value").alias("chars")).distinct()
    shared = F.coalesce(F.col("shared_chars"), F.lit(0))
    return chars.join(sums, "rid", "left").select(_name(F.col("field")).alias("field"), F.col("id").alias("record_id"), "chars", shared.alias("shared_chars"), F.round(shared / F.greatest(F.col("chars"), F.lit(1)), 6).alias("share"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_shares": p2_shares}
_SPANS = f"""
  SELECT field, id, case_id, substr(value, i, {SPAN}) AS s
  FROM (SELECT field, id, case_id, value, unnest(range(1, length(value) - {SPAN - 2})) AS i FROM (
    SELECT DISTINCT 'text' AS field, witness_id AS id, case_id, text AS value FROM witness WHERE length(text) >= {SPAN}
    UNION ALL SELECT DISTINCT 'base_reading', variation_id, case_id, base_reading FROM variation WHERE length(base_reading) >= {SPAN}))
"""
SQL = {
    "p2_found": f"""
WITH s AS (SELECT DISTINCT field, id, case_id, md5_number_lower(s) AS k, md5_number_upper(s) AS l FROM ({_SPANS})),
m AS (SELECT k, l FROM s GROUP BY k, l HAVING min(case_id) <> max(case_id)),
h AS (SELECT * FROM s JOIN m USING (k, l))
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM h a JOIN h b ON a.k = b.k AND a.l = b.l AND a.field = b.field AND a.id < b.id AND a.case_id <> b.case_id"""
}

"""Problem 6: filling fixed-capacity containers with whole documents.

Method: shortest-pack-first over the length histogram. Documents are measured in tokens of a public tokenizer; the
histogram has at most ``capacity`` bins whatever the corpus size, so the packing itself runs on the driver over
counts. Lengths are placed longest first, each into the pack with the most room left; equal packs are one *pattern*
with a count, and a placement only splits or moves such counts. Patterns are joined back to the documents by their
rank within a length; the rank is taken in two phases over salted groups, so a length that a third of all documents
share isn't ranked in one task.

Defined results: null text is left out; a text without tokens takes no space and stands in container 0; a text above
the capacity is cut into pieces of ``capacity`` tokens and a rest, and only such a one; repeated ids are distinct rows
with distinct places; extra columns are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, cut, read_table, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SALTED = 50_000  # documents of one length that are ranked in one task


def token_pieces(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece, tok_from, tok_to, char_from, char_to, n_tokens) of every document, cut only above ``capacity``."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for group in _groups(rows):
            for r, e in zip(group, model.encode_batch_fast([r["t"] for r in group], add_special_tokens=False)):
                n = len(e)
                if n <= capacity:
                    yield r["k"], 0, 0, n, 0, len(r["t"]), n
                    continue
                offsets = model.encode(r["t"], add_special_tokens=False).offsets
                lo = no = 0
                while lo < n:
                    hi = min(n, lo + capacity)
                    while lo + 1 < hi < n and offsets[hi][0] < offsets[hi - 1][1]:  # not inside a character
                        hi -= 1
                    yield r["k"], no, lo, hi, offsets[lo][0], offsets[hi][0] if hi < n else len(r["t"]), hi - lo
                    lo, no = hi, no + 1

    source = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = df.schema[key].dataType.simpleString()
    return arrow_rows(source, run, f"{key} {kind}, piece int, tok_from int, tok_to int, char_from int, char_to int, n_tokens int")


def _groups(rows: Iterator[dict], chars: int = 400_000) -> Iterator[list[dict]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["t"])
        if size >= chars or len(held) >= 256:
            yield held
            held, size = [], 0
    if held:
        yield held


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(count, ((length, copies), ...))``: how many containers hold just these lengths."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # room left -> [count, {length: copies}]
    done: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def put(count: int, content: dict[int, int], room: int) -> None:
        if room:
            open_packs[room].append([count, content])
        else:
            done.append((count, tuple(content.items())))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_packs if r >= length), default=0)
            if not room:
                copies = capacity // length
                full, rest = divmod(left, copies)
                if full:
                    put(full, {length: copies}, capacity - copies * length)
                if rest:
                    put(1, {length: rest}, capacity - rest * length)
                break
            group = open_packs[room]
            count, content = group.pop()
            if not group:
                del open_packs[room]
            used = min(count, left)
            if used < count:
                put(count - used, content, room)
            put(used, content | {length: content.get(length, 0) + 1}, room - length)
            left -= used
    for room in open_packs:
        done += [(count, tuple(content.items())) for count, content in open_packs[room]]
    return done


def segments(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, copies, first container): which ranks of a length each pattern takes."""
    taken: dict[int, int] = defaultdict(int)
    first, result = 0, []
    for count, content in patterns:
        for length, copies in content:
            lo = taken[length]
            taken[length] = lo + count * copies
            result.append((length, lo, taken[length], copies, first))
        first += count
    return result


def ranked(df: DataFrame, group: str, order: list[str], salts: int = 64) -> DataFrame:
    """``rank`` (from 0) of each row within ``group``, with no group in a single task.

    Rows of a group are dealt over ``salts`` hash classes; a class starts after the counts of the classes before it.
    The table of counts has at most distinct(group) x salts rows.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = dealt.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_salt").orderBy(*order)
    return dealt.withColumn("_row", F.row_number().over(own) - 1).join(starts, [group, "_salt"]).withColumn("rank", F.col("_start") + F.col("_row")).drop("_salt", "_start", "_row")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece, tok_from, tok_to, char_from, char_to, n_tokens, container), one row per document or piece."""
    spark = df.sparkSession
    lengths = cut(token_pieces(df, key, text, capacity, tokenizer))
    histogram = {r["n_tokens"]: r["n"] for r in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    parts = segments(pack_histogram(histogram, capacity)) + ([(0, 0, histogram[0], histogram[0], 0)] if histogram.get(0) else [])
    plan = spark.createDataFrame(parts, "n_tokens int, rank_from long, rank_to long, copies long, first_container long")
    salts = 1 + max(histogram.values(), default=0) // SALTED
    placed = ranked(lengths, "n_tokens", [key, "piece", "tok_from"], salts).alias("d").join(
        F.broadcast(plan.alias("p")),  # its size depends on the capacity alone
        (F.col("d.n_tokens") == F.col("p.n_tokens")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    at = (F.col("first_container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("copies"))).cast("long")
    return placed.select("d." + key, "piece", "tok_from", "tok_to", "char_from", "char_to", "d.n_tokens", at.alias("container"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"p6_packing": p6_packing}

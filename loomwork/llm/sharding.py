"""Sharding by sampled splitters, with built-in functions only.

Rows are put in the order of (hash of the text, doc_id), so equal texts stand together. A size-weighted
sample of these keys gives quantile boundaries; rows are range-partitioned by them, exact sizes of the ranges
are counted, and overfull ranges are divided by a denser sample of their own. Running sums within ranges,
shifted by the sums of the ranges before, then give every row its exact place in the order, and the places
are cut into shards of equal size. What the splitters are changes the partitioning, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import read, stored, utf8_bytes

Splitter = tuple[int, int]
LOW = -(1 << 63)


def below(splitters: list[Splitter], key: Column, second: Column) -> Column:
    """How many splitters are at or below (key, second): a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k, s = splitters[mid]
        return F.when((key < k) | ((key == k) & (second < s)), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splitters))


def draw(rows: DataFrame, weight_of_one: float, seed: int) -> DataFrame:
    """A sample in which a row's chance is its size over ``weight_of_one``, the same in every run."""
    even = F.pmod(F.xxhash64(F.lit(seed), "key", "second"), F.lit(1 << 52)) / float(1 << 52)
    return rows.where(even * weight_of_one < F.col("size"))


def quantiles(rows: DataFrame, n: int, most: int) -> list[Splitter]:
    """``n`` - 1 splitters at even steps through a sample of at most about ``most`` keys."""
    keys = [(r.key, r.second) for r in rows.select("key", "second").limit(4 * most).collect()]
    keys.sort()
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def shard(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 8, rows_a_range: int = 4_000_000, sampled: int = 64, most_rounds: int = 3) -> DataFrame:
    """Put ``docs(doc_id, text, ...)`` into shards 0 to ``shards`` - 1 of near equal size (law ``bytes``).

    A row's size is the UTF-8 bytes of its text plus 8. With T bytes in all, the row whose middle byte is at m in
    the order of (text hash, doc_id) goes to shard floor(shards * m / T): sizes differ from T / shards by less than
    the largest row, and a group of equal texts is cut only where a shard ends. ``slot`` counts from 0 in each shard.

    At most ``sampled`` keys a range reach the driver (a bound that doesn't depend on the input); ranges that turn
    out twice their share are divided again, up to ``most_rounds`` times. A null text has no bytes (its crc is that of
    the empty text), a null doc_id sorts first, rows that repeat are each placed, empty tables give no rows, and other
    columns are ignored.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (utf8_bytes("text") + 8).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("second"),
        )
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    n = shards * max(ranges_per_shard, min(4096 // shards, count // (shards * rows_a_range)))
    splitters = quantiles(draw(rows, total / (n * sampled) if total else 1.0, 0), n, n * sampled)
    sizes: list = []
    for attempt in range(most_rounds + 1):
        placed = rows.withColumn("range", below(splitters, F.col("key"), F.col("second")))
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row a range
        full = [r for r in sizes if r.bytes * n > 2 * total and r.n > 1]
        if attempt == most_rounds or not full:
            break
        more = placed.where(F.col("range").isin([r.range for r in full]))
        share = total / (n * sampled)
        pieces = sum(-(-r.bytes * n // total) for r in full)
        fresh = quantiles(draw(more, share, attempt + 1), pieces, pieces * sampled)
        if not set(fresh) - set(splitters):
            break
        splitters = sorted({*splitters, *fresh})
    sizes.sort(key=lambda r: r.range)
    start, bytes_before, rows_before = {}, 0, 0
    for r in sizes:
        start[r.range] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + r.bytes, rows_before + r.n
    if not start:
        start = {0: (0, 0)}
    offset = F.create_map(*[x for k, (b, c) in start.items() for x in (F.lit(k), F.struct(F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("n")))])
    order = Window.partitionBy("range").orderBy("key", "second")
    running = placed.select(
        "doc_id", "size", "text_crc32", "range",
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.row_number().over(order).alias("nth"),
    )
    at = F.element_at(offset, F.col("range"))
    middle = at["b"] + F.col("upto") - (F.col("size") / 2).cast("long") - 1
    whole = running.select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int").alias("shard"),
        (at["n"] + F.col("nth") - 1).alias("place"),
    )
    whole = stored(whole)
    first = {r.shard: r.place for r in whole.groupBy("shard").agg(F.min("place").alias("place")).collect()} or {0: 0}  # a row a shard
    begin = F.create_map(*[x for k, v in first.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return whole.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.element_at(begin, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))

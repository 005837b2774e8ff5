"""Operator 1: sharding by jump consistent hashing, in built-in column functions only.

A key seeds a 64-bit linear congruential generator; the key jumps to bucket
j = floor((b + 1) * 2**31 / (top 31 bits + 1)) until j reaches the shard count, and
its shard is the last bucket below it. No ring table exists, and a further shard
takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import load, long_key, written

# Fixed value: multiplier of the generator, in 16-bit limbs.
_MUL = 2862933555777941757
_M0, _M1, _MLO, _MHI = _MUL & 0xFFFF, (_MUL >> 16) & 0xFFFF, _MUL & 0xFFFFFFFF, _MUL >> 32
_LOW32 = 0xFFFFFFFF
ROWS_PER_BUCKET = 20_000     # rows numbered in one window group


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * multiplier + 1 mod 2**64 on 32-bit halves; no step exceeds 63 bits."""
    p0, p1 = lo * F.lit(_M0), lo * F.lit(_M1)
    s = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(p1, 16)

    def low_product(x: Column, c: int) -> Column:        # x * c mod 2**32
        return (x * F.lit(c & 0xFFFF) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)) \
            .bitwiseAND(F.lit(_LOW32))

    high = carry + low_product(hi, _MLO) + low_product(lo, _MHI)
    return high.bitwiseAND(F.lit(_LOW32)), s.bitwiseAND(F.lit(_LOW32))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard): the bucket of a BIGINT key among ``shards`` and ``shards + 1``.
    A null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def field(hi, lo, b, j, shard, grown):
        return F.struct(hi.alias("hi"), lo.alias("lo"), j.alias("j"), shard.alias("shard"), grown.alias("grown"))

    zero = F.lit(0).cast("long")
    start = field(F.shiftrightunsigned(k, 32), k.bitwiseAND(F.lit(_LOW32)), zero, zero, zero, zero)

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next_state(acc["hi"], acc["lo"])
        b = acc["j"]
        live = b <= F.lit(shards)                        # still below shards + 1
        top = F.shiftright(hi, 1) + F.lit(1)
        nxt = F.floor((b + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / top.cast("double"))).cast("long")
        return field(F.when(live, hi).otherwise(acc["hi"]), F.when(live, lo).otherwise(acc["lo"]), b,
                     F.when(live, nxt).otherwise(b),
                     F.when(b < F.lit(shards), b).otherwise(acc["shard"]),
                     F.when(live, b).otherwise(acc["grown"]))

    # every step raises j by one at least, so shards + 2 steps always end
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), start, step,
                       lambda acc: F.struct(acc["shard"].cast("int").alias("shard"),
                                            acc["grown"].cast("int").alias("grown_shard")))


def assign_shards(df: DataFrame, key: Column, shards: int, shard_col: str = "shard",
                  grown_col: str = "grown_shard") -> DataFrame:
    """All rows and columns of ``df`` plus the two shard columns; a projection, no shuffle.
    Integer keys count as they are, keys of other types through xxhash64, null keys as 0.
    Raises ValueError if ``df`` already has a column of either name."""
    clash = {shard_col, grown_col} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
                      jump_shards(long_key(df, key), shards).alias("__s"))
            .select("__row.*", F.col("__s.shard").alias(shard_col), F.col("__s.grown_shard").alias(grown_col)))


def number_slots(rows: DataFrame, shard_col: str = "shard", slot_col: str = "slot",
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Gapless numbers from 0 within each shard, for a table of scalar columns.

    Equal rows are counted first (map-side, so a row repeated without bound is one group), groups are
    spread over hash buckets of about ``rows_per_bucket`` rows, buckets get their offsets from a prefix
    sum over bucket totals only, and repeats are expanded last. Nothing is ever sorted by shard as a whole.
    """
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    spread = max(1, -(-total // rows_per_bucket))
    counted = counted.withColumn("__b", F.pmod(F.xxhash64(*cols), F.lit(spread)))
    sums = counted.groupBy(shard_col, "__b").agg(F.sum("__n").alias("__t"))
    before = F.coalesce(F.sum("__t").over(W.partitionBy(shard_col).orderBy("__b")
                                          .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = sums.select(F.col(shard_col).alias("__s"), F.col("__b").alias("__ob"), before.alias("__off"))
    inside = F.coalesce(F.sum("__n").over(W.partitionBy(shard_col, "__b").orderBy(*cols)
                                          .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = counted.withColumn("__in", inside)
    joined = numbered.join(offset, (F.col(shard_col) == F.col("__s")) & (F.col("__b") == F.col("__ob")))
    first = F.col("__off") + F.col("__in")
    return joined.select(*cols, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(slot_col))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One digest row per row of ``docs``: id, size (UTF-8 bytes + 1; null text: 1), unsigned CRC-32 of
    the text (null: that of no bytes, 0), law ``key``, shard, slot and the shard under one more shard.
    Equal texts under different ids may part; equal rows get different slots of one shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = written(assign_shards(narrow, F.col("doc_id"), shards), "shards")
    return number_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"),
                                       "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op1(spark, sf_dir):
    return shard_documents(load(spark, sf_dir, "documents"))

"""Variable-length columns as offsets plus payload, and back.

The logical layout is N+1 offsets (the first 0) and the concatenated bytes.
Long columns are split into segments by position, so that neither the running
sum nor the payload of a whole table meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode_blocks(df: DataFrame, block: str, key: str, value: str) -> DataFrame:
    """(block, keys, encoded): the values of each block in the order of their keys, as struct(offsets, payload).

    Strings or binaries; a null counts as empty, as the layout has no nulls.
    Offsets are a running sum, so a block costs n log n in its values, and the
    sum and the grouping share one shuffle by block.
    """
    rows = df.select(block, key, F.coalesce(F.col(value).cast("binary"), F.lit(b"")).alias("v"))
    ends = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.octet_length("v").cast("bigint")).over(ends))
    grouped = rows.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(key, "end", "v"))).alias("r"))
    offsets = F.concat(F.array(F.lit(0).cast("bigint")), F.col("r.end"))
    payload = F.array_join(F.transform("r", lambda x: x["v"].cast("string")), "").cast("binary")
    return grouped.select(block, F.col(f"r.{key}").alias("keys"), F.struct(offsets.alias("offsets"), payload.alias("payload")).alias("encoded"))


def decode_array(encoded: Column) -> Column:
    """The array of binaries that encode_blocks stored."""
    offsets, payload = encoded["offsets"], encoded["payload"]
    ends = F.slice(offsets, F.lit(2), F.size(offsets) - 1)
    starts = F.slice(offsets, F.lit(1), F.size(offsets) - 1)
    pairs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.transform(pairs, lambda p: F.substring(payload, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))


def running_offsets(df: DataFrame, key: str, value: str, segment: int = 4096) -> DataFrame:
    """(key, off, n): bytes of all values with a smaller key, of a dense integer key from 0 on.

    Sums of segments, sums of segments of segments and so on, until one
    segment is left: no window sees more than `segment` rows.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint").alias("n"))
    last = rows.agg(F.max("k")).first()[0]
    return _before(rows, last or 0, segment).select(F.col("k").alias(key), F.col("base").alias("off"), "n")


def _before(rows: DataFrame, last: int, segment: int) -> DataFrame:
    """(k, n, base) of rows (k, n) with keys from 0 to last: the sum of n over all smaller keys."""
    rows = rows.withColumn("seg", F.expr(f"k div {segment}L"))
    inside = Window.partitionBy("seg").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0).cast("bigint")))
    if last < segment:
        return rows.select("k", "n", "base")
    totals = rows.groupBy("seg").agg(F.sum("n").alias("n")).select(F.col("seg").alias("k"), "n")
    above = _before(totals, last // segment, segment).select(F.col("k").alias("seg"), F.col("base").alias("above"))
    return rows.join(above, "seg").select("k", "n", (F.col("above") + F.col("base")).alias("base"))

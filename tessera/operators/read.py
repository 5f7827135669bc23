"""Region reads: prune chunks on the driver, resolve the newest of each, fill the rest, and cut the region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.functions.dtypes import DType


#: Chunks up to which the winners are broadcast, 24 bytes each.
BROADCAST_ROWS = 500_000


def newest_chunks(data: DataFrame, index: DataFrame | None, chunks: int | None = None) -> DataFrame:
    """The newest row of each chunk; `chunks` is how many there can be, counted if it is not known.

    The winners come from the narrow index, a hash aggregate that never
    carries values; the join back is then on the unique (array, chunk, write),
    and moves values only where there are too many winners to broadcast.  With
    a single part there is nothing to resolve.
    """
    if index is None:
        return data
    winners = index.groupBy("array_id", "chunk_ord").agg(F.max("wseq").alias("wseq"))
    if (winners.count() if chunks is None else chunks) <= BROADCAST_ROWS:
        winners = F.broadcast(winners)
    return data.join(winners, ["array_id", "chunk_ord", "wseq"], "left_semi")


def dense_chunks(spark: SparkSession, chunks: DataFrame | None, index: DataFrame | None, shape: Sequence[int], chunk: Sequence[int], axes: Sequence[range], t: DType, fill: Column) -> DataFrame:
    """(chunk_ord, vals) of every chunk in the ranges; chunks that nobody wrote hold the fill value.

    Which ones those are is told by the index alone, so written values stay in
    the task that reads them.
    """
    count = 1
    for r in axes:
        count *= len(r)
    ords = spark.range(count).select(F.expr(grid.ordinal_of_rank_sql(shape, chunk, axes)).alias("chunk_ord"))
    length = F.expr(grid.chunk_len_sql(shape, chunk)).cast("int")
    blank = F.array_repeat(fill, length)
    if chunks is None:
        return ords.select("chunk_ord", blank.alias("vals"))
    written = index.select("chunk_ord").distinct()
    missing = ords.join(F.broadcast(written) if count <= BROADCAST_ROWS else written, "chunk_ord", "left_anti")
    return chunks.select("chunk_ord", "vals").unionByName(missing.select("chunk_ord", blank.alias("vals")))


def cells(chunks: DataFrame, shape: Sequence[int], chunk: Sequence[int], start: Sequence[int], stop: Sequence[int]) -> DataFrame:
    """(d0, ..., v) of the cells of dense chunks that lie in the region."""
    flat = chunks.select("chunk_ord", F.posexplode("vals").alias("p", "v")).withColumn("pos", F.col("p").cast("bigint"))
    out = flat.select(*[F.expr(sql).alias(f"d{k}") for k, sql in enumerate(grid.cell_coords_sql(shape, chunk))], "v")
    for k, (a, b, s) in enumerate(zip(start, stop, shape, strict=True)):
        if a > 0 or b < s:
            out = out.filter((F.col(f"d{k}") >= a) & (F.col(f"d{k}") < b))
    return out

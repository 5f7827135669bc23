"""Region writes: cells grouped into chunk rows, with read-modify-write only where a chunk is not covered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import grid


def cells_to_chunks(cells: DataFrame, shape: Sequence[int], chunk: Sequence[int], spark_type: str) -> DataFrame:
    """(chunk_ord, vals, pv, n, bad, lo0, hi0, ..., twice, covered): the values of each chunk that the cells cover, or positions and values where they don't, with their number, null coordinates, bounds and whether a position is repeated."""
    dims = [f"d{k}" for k in range(len(shape))]
    ord_sql, pos_sql = grid.cell_to_chunk_sql(shape, chunk, dims)
    placed = cells.select(F.expr(ord_sql).cast("bigint").alias("chunk_ord"), F.expr(pos_sql).try_cast("int").alias("pos"), F.col("v").cast(spark_type).alias("v"), *dims)
    bounds = [f(d).alias(f"{m}{k}") for k, d in enumerate(dims) for m, f in (("lo", F.min), ("hi", F.max))]
    bad = F.count_if(reduce(lambda x, y: x | y, [F.col(d).isNull() for d in dims], F.lit(False))).alias("bad")
    # by ranges, so that files hold neighbouring chunks and prune; the grouping needs no second shuffle
    grouped = placed.repartitionByRange("chunk_ord").groupBy("chunk_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("pv"), F.count("*").alias("n"), bad, *bounds)
    marked = grouped.withColumn("twice", F.size(F.array_distinct(F.transform("pv", lambda x: x["pos"]))) < F.size("pv"))
    marked = marked.withColumn("covered", ~F.col("twice") & (F.col("n") == F.expr(grid.chunk_len_sql(shape, chunk))))
    return marked.withColumn("vals", F.when(F.col("covered"), F.transform("pv", lambda x: x["v"]))).withColumn("pv", F.when(~F.col("covered"), F.col("pv")))


def covered(patches: DataFrame) -> DataFrame:
    return patches.filter("covered").select("chunk_ord", "vals")


def patched(patches: DataFrame, old: DataFrame | None, shape: Sequence[int], chunk: Sequence[int], fill: Column) -> DataFrame:
    """Chunks that are covered in part, over their old values, or the fill value where they were not written.

    Old and new cells are sorted together by position, new ones first, and the
    first of each position stays: n log n in the cells of a chunk, without
    exploding and regrouping them.
    """
    parts = patches.filter("not covered").select("chunk_ord", "pv")
    blank = F.array_repeat(fill, F.expr(grid.chunk_len_sql(shape, chunk)).cast("int"))
    joined = parts.withColumn("vals", blank) if old is None else parts.join(old.select("chunk_ord", "vals"), "chunk_ord", "left").withColumn("vals", F.coalesce("vals", blank))
    cell = lambda pos, old, v: F.struct(pos.cast("int").alias("pos"), F.lit(old).alias("old"), v.alias("v"))
    both = F.concat(F.transform("vals", lambda x, i: cell(i, True, x)), F.transform("pv", lambda y: cell(y["pos"], False, y["v"])))
    merged = joined.select("chunk_ord", F.sort_array(both).alias("m"))
    first = F.filter("m", lambda x, i: (i == 0) | (F.get("m", i - 1)["pos"] != x["pos"]))
    return merged.select("chunk_ord", F.transform(first, lambda x: x["v"]).alias("vals"))

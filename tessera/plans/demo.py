"""Stores built from the driver's tables, one per topic, session and input path.

Shapes come from the tables, never from constants; every store is written,
flushed and read from disk, so a query exercises the real path.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import Attr, Fill
from tessera.store import ArrayStore

_built: dict[tuple[str, str, str], ArrayStore] = {}
_topics: dict[str, Callable[[SparkSession, str, ArrayStore], None]] = {}


def topic(f):
    _topics[f.__name__] = f
    return f


def store(spark: SparkSession, sf_dir: str, name: str, **options) -> ArrayStore:
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}{sorted(options.items())}")
    if key not in _built:
        built = ArrayStore.in_memory(spark, **options)
        _topics[name](spark, sf_dir, built)
        _built[key] = built
    return _built[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extent(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


@topic
def events(spark, sf_dir, s):
    """value: even chunks of 1000, then a patch over a tenth of the extent, from a quarter on; whole: written once."""
    ev = table(spark, sf_dir, "events")
    n = extent(ev, "event_id")
    s.define_array("value", "float64", [n], [1000], ["event_id"], Fill("Float", -999.0))
    s.define_array("whole", "float64", [n], [4096], ["event_id"])
    s.define_array("user", "uint32", [n], [1024], ["event_id"], Fill("UInt", 7))
    cells = ev.select(F.col("event_id").alias("d0"), F.col("value").alias("v"))
    s.write_cells("value", cells.filter("(d0 div 1000) % 2 = 0"))
    s.write_cells("whole", cells)
    s.write_cells("user", ev.select(F.col("event_id").alias("d0"), F.col("user_id").alias("v")))
    s.flush()
    s.write_cells("value", cells.filter((F.col("d0") >= n // 4) & (F.col("d0") < n * 7 // 20)).withColumn("v", F.col("v") * 10))
    s.flush()


@topic
def pending(spark, sf_dir, s):
    """The lower half, flushed, and the middle half over it, not flushed."""
    ev = table(spark, sf_dir, "events")
    n = extent(ev, "event_id")
    cells = ev.select(F.col("event_id").alias("d0"), F.col("value").alias("v"))
    s.define_array("value", "float64", [n], [1000], fill=Fill("Float", -1.0))
    s.write_cells("value", cells.filter(F.col("d0") < n // 2))
    s.flush()
    s.write_cells("value", cells.filter((F.col("d0") >= n // 4) & (F.col("d0") < n * 3 // 4)).withColumn("v", -F.col("v")))


@topic
def patched(spark, sf_dir, s):
    """Whole tables, then patches whose extent grows with the table's: rmw, cross, apart and full of events, row and inner of embeddings."""
    ev, em = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    n, rows = extent(ev, "event_id"), extent(em, "vec_id")
    cells = ev.select(F.col("event_id").alias("d0"), F.col("value").alias("v"))
    matrix = em.select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("p", "v")).select("d0", F.col("p").cast("bigint").alias("d1"), "v")
    for name in ("rmw", "cross", "apart", "full"):
        s.define_array(name, "float64", [n], [1000], fill=Fill("Float", -999.0))
        s.write_cells(name, cells.filter("(d0 div 1000) % 2 = 0") if name == "rmw" else cells)
    for name in ("row", "inner"):
        s.define_array(name, "float32", [rows, 64], [128, 16])
        s.write_cells(name, matrix)
    s.flush()
    s.write_cells("rmw", cells.filter((F.col("d0") >= n // 4) & (F.col("d0") < n * 3 // 4)).withColumn("v", F.col("v") * 10))
    s.write_cells("full", cells.filter("(d0 div 1000) % 2 = 1").withColumn("v", -F.col("v")))
    s.write_cells("cross", cells.filter((F.col("d0") >= n // 10) & (F.col("d0") < n * 9 // 10)).withColumn("v", F.lit(1.0)))
    s.write_cells("cross", cells.filter((F.col("d0") >= n // 3) & (F.col("d0") < n * 2 // 3)).withColumn("v", F.lit(2.0)))
    s.write_cells("apart", cells.filter("(d0 div 1000) % 3 = 1 and d0 % 1000 between 200 and 799").withColumn("v", -F.col("v")))
    s.write_cells("row", matrix.filter("d0 % 50 = 2").withColumn("v", F.lit(7.0).cast("float")))
    s.write_cells("inner", matrix.filter((F.col("d0") >= rows // 4) & (F.col("d0") < rows * 3 // 4) & F.col("d1").between(14, 49)).withColumn("v", F.lit(5.0).cast("float")))
    s.flush()


@topic
def vectors(spark, sf_dir, s):
    """embeddings as a matrix with ragged last row chunks; then a row and an inner patch."""
    em = table(spark, sf_dir, "embeddings")
    cells = em.select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("p", "v")).select("d0", F.col("p").cast("bigint").alias("d1"), "v")
    shape = [extent(em, "vec_id"), 64]
    for name in ("m", "patched"):
        s.define_array(name, "float32", shape, [128, 16], ["vec", "dim"])
        s.write_cells(name, cells)
    s.flush()
    s.write_array("patched", [2, 0], np.full((1, 64), 7, dtype="float32"))
    s.write_array("patched", [shape[0] // 4, 14], np.full((16, 4), 5, dtype="float32"))
    s.flush()


@topic
def cube(spark, sf_dir, s):
    """quantity by supplier, line number and ship year: rank 3, sparse, chunks that do not divide the shape."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.year("l_shipdate").alias("y"), "l_quantity")
    cells = li.groupBy(F.col("l_suppkey").alias("d0"), (F.col("l_linenumber") - 1).cast("bigint").alias("d1"), (F.col("y") - 1995).cast("bigint").alias("d2")).agg(F.sum("l_quantity").alias("v"))
    s.define_array("q", "float64", [extent(li, "l_suppkey"), 7, 7], [16, 3, 2], ["supp", "line", "year"], Fill("Float", 0.0))
    s.write_cells("q", cells)
    s.flush()


@topic
def dialog(spark, sf_dir, s):
    """Text length of conversations by (conversation, turn): sparse rank 2 with a fill value."""
    c = table(spark, sf_dir, "conversations")
    s.define_array("len", "int32", [extent(c, "conv_id"), extent(c, "turn")], [64, 4], fill=Fill("Int", -1))
    s.write_cells("len", c.select(F.col("conv_id").alias("d0"), F.col("turn").alias("d1"), F.length("text").alias("v")))
    s.flush()


@topic
def orders(spark, sf_dir, s):
    """o_totalprice written in two appended layers, then overwritten in part twice in one layer."""
    o = table(spark, sf_dir, "orders")
    n = extent(o, "o_orderkey")
    cells = o.select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("v"))
    s.define_array("price", "float64", [n], [256])
    s.write_cells("price", cells.filter(F.col("d0") < n // 2))
    s.flush()
    s.write_cells("price", cells.filter(F.col("d0") >= n // 2))
    s.flush()
    s.write_cells("price", cells.filter((F.col("d0") >= n // 10) & (F.col("d0") < n * 9 // 10)).withColumn("v", F.lit(1.0)))
    s.write_cells("price", cells.filter((F.col("d0") >= n // 3) & (F.col("d0") < n * 2 // 3)).withColumn("v", F.lit(2.0)))
    s.flush()


@topic
def typed(spark, sf_dir, s):
    """One array of each kind of statistics, some with fill values that occur among the values."""
    p, ev, d, o = (table(spark, sf_dir, t) for t in ("part", "events", "documents", "orders"))
    np_, ne, nd, no = extent(p, "p_partkey"), extent(ev, "event_id"), extent(d, "doc_id"), extent(o, "o_orderkey")
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    for name, kind, n, fill, df in (
        ("int", "int32", np_, Fill("Int", 1), p.select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("v"))),
        ("plain", "int32", np_, None, p.select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("v"))),
        ("half", "int32", np_ + 7, Fill("Int", 25), p.select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("v"))),
        ("byte", "uint8", np_, Fill("UInt", 50), p.select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("v"))),
        ("big", "uint64", np_, None, p.select(F.col("p_partkey").alias("d0"), (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("p_partkey")).cast("decimal(20,0)").alias("v"))),
        ("float", "float64", ne, None, ev.select(F.col("event_id").alias("d0"), (F.col("value") + F.lit(0.0)).alias("v"))),
        ("nan", "float64", ne, Fill("Float", float("nan")), ev.select(F.col("event_id").alias("d0"), F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value") + F.lit(0.0)).alias("v"))),
        ("text", "string", ne, Fill("String", "click"), ev.select(F.col("event_id").alias("d0"), F.col("event_type").alias("v"))),
        ("lang", "string", nd + 10, Fill("String", "xx"), d.select(F.col("doc_id").alias("d0"), F.col("lang").alias("v"))),
        ("bytes", "binary", ne, None, ev.select(F.col("event_id").alias("d0"), F.unhex(F.lpad(F.hex(F.col("event_id") % 256), 2, "0")).alias("v"))),
        ("time", "timestamp_ns", no + 5, Fill("TimestampNs", 1_000_000_000), o.select(F.col("o_orderkey").alias("d0"), ns.alias("v"))),
        ("float_fill", "int32", np_ + 3, Fill("Float", 1.0), p.select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("v"))),
        ("zero", "float64", ne + 4, None, ev.select(F.col("event_id").alias("d0"), (F.col("value") + F.lit(0.0)).alias("v"))),
    ):
        s.define_array(name, kind, [n], [1000], fill=fill)
        s.write_cells(name, df)
    s.flush()


@topic
def catalog(spark, sf_dir, s):
    """Small arrays for lifecycle and attributes: a deleted one, one defined again, scalars, store metadata."""
    for name, kind, shape, chunk in (("a", "int32", [10], [4]), ("b", "float32", [4, 6], [2, 3]), ("c", "string", [4], None), ("gone", "int8", [2], None), ("again", "int64", [6], [2])):
        s.define_array(name, kind, shape, chunk, fill=Fill("Int", 9) if name == "again" else None)
    s.write_array("a", [0], np.arange(10, dtype="int32"))
    s.write_array("c", [0], ["north", "east", "south", "west"])
    s.write_array("gone", [0], np.array([1, 2], dtype="int8"))
    s.write_array("again", [0], np.arange(6, dtype="int64"))
    s.set_attribute("a", "units", "mm")
    s.set_attribute("b", "units", "cm")
    s.set_attribute("a", "level", Attr("Int32", 3))
    s.flush()
    s.delete("gone")
    s.delete("again")
    s.define_array("again", "int64", [6], [2], fill=Fill("Int", 9))
    s.write_array("again", [2], np.array([42, 43], dtype="int64"))
    s.set_attribute("b", "units", "m")
    s.set_attribute("b", "level", Attr("Int32", 8))
    s.define_array("answer", "int32", [], fill=Fill("Int", 42))
    s.define_array("orders", "int64", [])
    s.write_array("orders", [], np.array(table(spark, sf_dir, "orders").count(), dtype="int64"))
    s.set_file_metadata("title", "demo")
    s.set_file_metadata("schema_version", Attr("Int32", 3))
    s.flush()


@topic
def compacted(spark, sf_dir, s):
    events(spark, sf_dir, s)
    s.define_array("dropped", "int8", [4])
    s.write_array("dropped", [0], np.arange(4, dtype="int8"))
    s.flush()
    s.delete("dropped")
    s.flush()
    s.compact()


@topic
def many(spark, sf_dir, s):
    """One array per part: shipped quantities in order line, position within the part."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    arrays = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q")).select("l_partkey", "l_suppkey", "q")
    from pyspark.sql import Window

    label = F.format_string("part_%07d", "l_partkey").alias("name")
    s.define_many(arrays.groupBy("l_partkey").agg(F.count("*").alias("length")).select(label, "length"), "float64")
    rows = arrays.select(label, (F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey")) - 1).cast("bigint").alias("pos"), "q")
    s.write_many(rows, "name", "pos", "q")
    s.flush()

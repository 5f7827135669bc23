"""The registered queries of the store and, for each, SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid, offsets
from tessera.functions.dtypes import DTYPES
from tessera.plans.demo import extent, store, table
from tessera.store import ArrayStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _read(topic: str, array: str, **options) -> Query:
    return lambda spark, d: store(spark, d, topic, **options).read_cells(array)


def _region(topic: str, array: str, region: Callable[[list[int]], tuple[list[int], list[int]]]) -> Query:
    """A region (start, shape) that follows the array's shape."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = store(spark, d, topic)
        return s.read_cells(array, *region(s.get_array(array).shape))

    return run


def _add(name: str, f: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


# -- region reads ------------------------------------------------------------

N = "(SELECT max(event_id) + 1 FROM events)"
ROWS = "(SELECT max(vec_id) + 1 FROM embeddings)"
ORDERS = "(SELECT max(o_orderkey) + 1 FROM orders)"
#: What the store of topic events holds in `value`: even chunks of 1000, then a patch of a tenth of the extent.
VALUE = f"CASE WHEN event_id >= {N} // 4 AND event_id < {N} * 7 // 20 THEN value * 10 WHEN (event_id // 1000) % 2 = 0 THEN value ELSE -999.0 END"
CELL2 = "SELECT CAST(vec_id AS BIGINT) AS d0, CAST(i AS BIGINT) AS d1, embedding[i + 1] AS v FROM embeddings, range(64) t(i)"
_add("full_read_1d", _read("events", "value"), f"SELECT event_id AS d0, {VALUE} AS v FROM events")
_add("subregion_1d", _region("events", "value", lambda s: ([s[0] * 3 // 20], [s[0] * 9 // 20 - s[0] * 3 // 20])), f"SELECT event_id AS d0, {VALUE} AS v FROM events WHERE event_id >= {N} * 3 // 20 AND event_id < {N} * 9 // 20")
_add("read_clamped", _region("events", "value", lambda s: ([s[0] // 11], [10**9])), f"SELECT event_id AS d0, {VALUE} AS v FROM events WHERE event_id >= {N} // 11")
_add("read_rank_default", _region("events", "whole", lambda s: ([1, 2], [3, 4, 5])), "SELECT event_id AS d0, value AS v FROM events")
_add("full_read_2d", _read("vectors", "m"), CELL2)
_add("subregion_2d_multi_chunk", _region("vectors", "m", lambda s: ([s[0] // 5, 10], [s[0] // 2 - s[0] // 5, 10])), f"SELECT * FROM ({CELL2}) c WHERE d0 >= {ROWS} // 5 AND d0 < {ROWS} // 2 AND d1 BETWEEN 10 AND 19")
_add("edge_chunk_read", _region("vectors", "m", lambda s: ([s[0] * 3 // 4, 40], [10**6, 24])), f"SELECT * FROM ({CELL2}) c WHERE d0 >= {ROWS} * 3 // 4 AND d1 >= 40")
CUBE = "SELECT l_suppkey AS s, l_linenumber - 1 AS l, year(l_shipdate) - 1995 AS y, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"
_add(
    "subregion_3d",
    _region("cube", "q", lambda s: ([3, 1, 2], [6, 5, 4])),
    f"SELECT CAST(g.s AS BIGINT) AS d0, CAST(h.l AS BIGINT) AS d1, CAST(k.y AS BIGINT) AS d2, coalesce(c.q, 0.0) AS v FROM range(3, 9) g(s), range(1, 6) h(l), range(2, 6) k(y) LEFT JOIN ({CUBE}) c ON c.s = g.s AND c.l = h.l AND c.y = k.y",
)
_add(
    "sparse_read_2d",
    _read("dialog", "len"),
    "SELECT CAST(a.i AS BIGINT) AS d0, CAST(b.i AS BIGINT) AS d1, CAST(coalesce(length(c.text), -1) AS INTEGER) AS v FROM (SELECT unnest(range(max(conv_id) + 1)) AS i FROM conversations) a CROSS JOIN (SELECT unnest(range(max(turn) + 1)) AS i FROM conversations) b LEFT JOIN conversations c ON c.conv_id = a.i AND c.turn = b.i",
)


@query("SELECT CAST(42 AS INTEGER) AS answer, count(*) AS orders FROM orders")
def scalar_read(spark, d):
    s = store(spark, d, "catalog")
    return s.read_cells("answer").select(F.col("v").alias("answer")).crossJoin(s.read_cells("orders").select(F.col("v").alias("orders")))


# -- fill values ---------------------------------------------------------------

_add("fill_numeric", _read("typed", "float_fill"), "SELECT p_partkey AS d0, p_size AS v FROM part UNION ALL SELECT CAST(m + i AS BIGINT), CAST(1 AS INTEGER) FROM (SELECT max(p_partkey) + 1 AS m FROM part) x, range(3) t(i)")
_add("fill_default_zero", _read("typed", "zero"), "SELECT event_id AS d0, value + 0.0 AS v FROM events UNION ALL SELECT CAST(m + i AS BIGINT), 0.0 FROM (SELECT max(event_id) + 1 AS m FROM events) x, range(4) t(i)")
_add("fill_string_ignored", _read("typed", "lang"), "SELECT doc_id AS d0, lang AS v FROM documents UNION ALL SELECT CAST(m + i AS BIGINT), '' FROM (SELECT max(doc_id) + 1 AS m FROM documents) x, range(10) t(i)")
_add("fill_string_honoured", _read("typed", "lang", honour_string_fill=True), "SELECT doc_id AS d0, lang AS v FROM documents UNION ALL SELECT CAST(m + i AS BIGINT), 'xx' FROM (SELECT max(doc_id) + 1 AS m FROM documents) x, range(10) t(i)")
_add("fill_timestamp", _read("typed", "time"), "SELECT o_orderkey AS d0, CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS v FROM orders UNION ALL SELECT CAST(m + i AS BIGINT), CAST(1000000000 AS BIGINT) FROM (SELECT max(o_orderkey) + 1 AS m FROM orders) x, range(5) t(i)")


# -- writes ----------------------------------------------------------------------

# whole arrays are read, so damage outside a patch is seen; patches grow with the extent
PRICE = f"CASE WHEN o_orderkey >= {ORDERS} // 3 AND o_orderkey < {ORDERS} * 2 // 3 THEN 2.0 WHEN o_orderkey >= {ORDERS} // 10 AND o_orderkey < {ORDERS} * 9 // 10 THEN 1.0 ELSE o_totalprice END"
RMW = f"CASE WHEN event_id >= {N} // 4 AND event_id < {N} * 3 // 4 THEN value * 10 WHEN (event_id // 1000) % 2 = 0 THEN value ELSE -999.0 END"
PATCHED = f"SELECT d0, d1, CASE WHEN d0 >= {ROWS} // 4 AND d0 < {ROWS} // 4 + 16 AND d1 BETWEEN 14 AND 17 THEN CAST(5 AS FLOAT) WHEN d0 = 2 THEN CAST(7 AS FLOAT) ELSE v END AS v FROM ({CELL2}) c"
_add("write_full_chunks", _read("patched", "full"), "SELECT event_id AS d0, CASE WHEN (event_id // 1000) % 2 = 1 THEN -value ELSE value END AS v FROM events")
_add("write_partial_rmw", _read("patched", "rmw"), f"SELECT event_id AS d0, {RMW} AS v FROM events")
_add("write_cross_chunk", _read("patched", "cross"), f"SELECT event_id AS d0, CASE WHEN event_id >= {N} // 3 AND event_id < {N} * 2 // 3 THEN 2.0 WHEN event_id >= {N} // 10 AND event_id < {N} * 9 // 10 THEN 1.0 ELSE value END AS v FROM events")
_add("write_non_adjacent", _read("patched", "apart"), "SELECT event_id AS d0, CASE WHEN (event_id // 1000) % 3 = 1 AND event_id % 1000 BETWEEN 200 AND 799 THEN -value ELSE value END AS v FROM events")
_add("write_row_2d", _read("patched", "row"), f"SELECT d0, d1, CASE WHEN d0 % 50 = 2 THEN CAST(7 AS FLOAT) ELSE v END AS v FROM ({CELL2}) c")
_add("write_inner_patch_2d", _read("patched", "inner"), f"SELECT d0, d1, CASE WHEN d0 >= {ROWS} // 4 AND d0 < {ROWS} * 3 // 4 AND d1 BETWEEN 14 AND 49 THEN CAST(5 AS FLOAT) ELSE v END AS v FROM ({CELL2}) c")
_add("write_arrays_of_driver", _read("vectors", "patched"), PATCHED)
_add("latest_write_wins", _read("orders", "price"), f"SELECT o_orderkey AS d0, {PRICE} AS v FROM orders")
_add("layered_append_array", _region("orders", "price", lambda s: ([s[0] // 2], [10**12])), f"SELECT o_orderkey AS d0, {PRICE} AS v FROM orders WHERE o_orderkey >= {ORDERS} // 2")
_add("pending_read_your_writes", _read("pending", "value"), f"SELECT event_id AS d0, CASE WHEN event_id >= {N} // 4 AND event_id < {N} * 3 // 4 THEN -value WHEN event_id < {N} // 2 THEN value ELSE -1.0 END AS v FROM events")


@query("SELECT o_custkey AS d0, max_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey <= (SELECT max(o_custkey) FROM orders)")
def write_repeated_coordinates(spark, d):
    """Cells given more than once, of which the largest order column wins."""
    o = table(spark, d, "orders")
    s = ArrayStore.in_memory(spark)
    s.define_array("last", "float64", [extent(o, "o_custkey")], [512])
    s.write_cells("last", o.select(F.col("o_custkey").alias("d0"), F.col("o_totalprice").alias("v"), "o_orderkey"), order_by="o_orderkey")
    return s.read_cells("last")


# -- catalog -----------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('a', 'int32', '10', '4', 'dim0'), ('b', 'float32', '4,6', '2,3', 'dim0,dim1'), ('c', 'string', '4', '4', 'dim0'), ('again', 'int64', '6', '2', 'dim0'), ('answer', 'int32', '', '', ''), ('orders', 'int64', '', '', ''), ('__file__', 'uint8', '', '', '')) t(name, dtype, shape, chunk_shape, dims)")
def list_arrays(spark, d):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return store(spark, d, "catalog").list_arrays().select("name", "dtype", joined("shape"), joined("chunk_shape"), joined("dims"))


@query("SELECT 0 AS found")
def delete_hides_array(spark, d):
    return store(spark, d, "catalog").list_arrays().agg(F.count_if(F.col("name") == "gone").cast("int").alias("found"))


_add("delete_then_redefine", _read("catalog", "again"), "SELECT CAST(d0 AS BIGINT) AS d0, CAST(v AS BIGINT) AS v FROM (VALUES (0, 9), (1, 9), (2, 42), (3, 43), (4, 9), (5, 9)) t(d0, v)")


@query("SELECT CAST(0 AS BIGINT) AS topic, CAST(3 AS BIGINT) AS layers UNION ALL SELECT 1, 1")
def num_layers(spark, d):
    return spark.createDataFrame([(0, store(spark, d, "events").num_layers()), (1, store(spark, d, "compacted").num_layers())], "topic bigint, layers bigint")


@query("SELECT a.i * 24 + b.i * 4 + c.i AS chunk_ord, CAST(least(3, 16 - 3 * a.i) * least(5, 28 - 5 * b.i) * least(2, 7 - 2 * c.i) AS BIGINT) AS n FROM range(6) a(i), range(6) b(i), range(4) c(i)")
def chunk_grid(spark, d):
    shape, chunk = [16, 28, 7], [3, 5, 2]
    axes = [range(g) for g in grid.grid_of(shape, chunk)]
    return spark.range(144).select(F.expr(grid.ordinal_of_rank_sql(shape, chunk, axes)).alias("chunk_ord")).select("chunk_ord", F.expr(grid.chunk_len_sql(shape, chunk)).cast("bigint").alias("n"))


#: Chunks of `value` that are written: even ones, and those that the patch meets.
WRITTEN = f"(i % 2 = 0 OR (i >= {N} // 4 // 1000 AND i <= ({N} * 7 // 20 - 1) // 1000))"


@query(f"SELECT CAST(i AS BIGINT) AS chunk_ord FROM (SELECT DISTINCT event_id // 1000 AS i FROM events) t WHERE i >= {N} * 3 // 20 // 1000 AND i <= ({N} * 17 // 20 - 1) // 1000 AND {WRITTEN}")
def chunk_overlap_prune(spark, d):
    """Written chunks of a region: pruned on the driver, found in the index alone."""
    a = store(spark, d, "events").get_array("value")
    axes, _ = grid.overlapping(a.shape, a.chunk, [a.shape[0] * 3 // 20], [a.shape[0] * 17 // 20])
    return store(spark, d, "events").chunk_index("value").filter(grid.ordinal_filter(a.shape, a.chunk, axes)).select("chunk_ord")


@query("SELECT 'm' AS name, CAST(max(vec_id) + 1 AS BIGINT) AS rows, CAST(64 AS BIGINT) AS cols, CAST(((max(vec_id) + 128) // 128) * 4 AS BIGINT) AS chunks FROM embeddings")
def array_shape_meta(spark, d):
    s = store(spark, d, "vectors")
    a = s.get_array("m")
    return s.chunk_index("m").agg(F.lit("m").alias("name"), F.lit(a.shape[0]).cast("bigint").alias("rows"), F.lit(a.shape[1]).cast("bigint").alias("cols"), F.count("*").alias("chunks"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', {t.size if t.size is not None else 'CAST(NULL AS INTEGER)'}, {str(t.variable).lower()})" for t in DTYPES.values()) + ") t(name, size, variable)")
def dtype_sizes(spark, d):
    return spark.createDataFrame([(t.name, t.size, t.variable) for t in DTYPES.values()], "name string, size int, variable boolean")


# -- compaction -------------------------------------------------------------------

_add("compact_equivalence", _read("compacted", "value"), f"SELECT event_id AS d0, {VALUE} AS v FROM events")


@query("SELECT unnest(['value', 'whole', 'user']) AS name")
def compact_drops_deleted(spark, d):
    return store(spark, d, "compacted").list_arrays().select("name")


@query(f"SELECT count(*) AS n, CAST(count_if(({VALUE}) = -999.0) AS BIGINT) AS blank FROM events")
def reopen_roundtrip(spark, d):
    again = ArrayStore.open(spark, store(spark, d, "events").root)
    return again.read_cells("value").agg(F.count("*").alias("n"), F.count_if(F.col("v") == -999.0).alias("blank"))


_add("in_memory_roundtrip", _read("events", "user"), "SELECT event_id AS d0, CAST(user_id AS BIGINT) AS v FROM events")


# -- attributes ---------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('a', 'mm'), ('b', 'm'), ('c', NULL), ('again', NULL), ('answer', NULL), ('orders', NULL), ('__file__', NULL)) t(name, units)")
def attr_index(spark, d):
    return store(spark, d, "catalog").attribute_index("units").select("name", F.col("value.s").alias("units"))


@query("SELECT 'a' AS name, 'Int32' AS kind, CAST(3 AS BIGINT) AS level")
def attr_get(spark, d):
    x = store(spark, d, "catalog").get_attribute("a", "level")
    return spark.createDataFrame([("a", x.kind, x.value)], "name string, kind string, level bigint")


@query("SELECT 'm' AS units")
def attr_overwrite(spark, d):
    return store(spark, d, "catalog").attribute_index("units").filter("name = 'b'").select(F.col("value.s").alias("units"))


@query("SELECT CAST(i AS BIGINT) AS d0, CAST(0 AS FLOAT) AS v FROM range(6) t(i)")
def attr_prune(spark, d):
    """Read only the arrays whose attribute passes a test: here the first row of the one with a level over 5."""
    s = store(spark, d, "catalog")
    name = s.attribute_index("level").filter("value.i > 5").first()["name"]
    return s.read_cells(name, [0, 0], [1, 6]).select(F.col("d1").alias("d0"), "v")


@query("SELECT 'title' AS key, 'demo' AS s, CAST(NULL AS BIGINT) AS i UNION ALL SELECT 'schema_version', NULL, 3")
def file_metadata(spark, d):
    s = store(spark, d, "catalog")
    one = lambda k: s.attribute_index(k).filter("name = '__file__'").select(F.lit(k).alias("key"), F.col("value.s").alias("s"), F.col("value.i").alias("i"))
    return one("title").unionByName(one("schema_version"))


# -- statistics ----------------------------------------------------------------------


def _stat(name: str, array: str, field: str, sql: str, topic: str = "typed") -> None:
    cast = {"i": "decimal(20,0)", "f": "double", "b": "string"}[field]
    pick = lambda c: F.hex(c) if field == "b" else F.col(c).cast("string" if field == "i" else cast)
    QUERIES[name] = lambda spark, d: store(spark, d, topic).stats().filter(F.col("name") == array).select("kind", pick(f"min_{field}").alias("low"), pick(f"max_{field}").alias("high"), "null_count", "row_count")
    SQL[name] = sql


_stat("stats_int", "int", "i", "SELECT 'Int' AS kind, CAST(min(p_size) FILTER (p_size <> 1) AS VARCHAR) AS low, CAST(max(p_size) FILTER (p_size <> 1) AS VARCHAR) AS high, CAST(count_if(p_size = 1) AS BIGINT) AS null_count, count(*) AS row_count FROM part")
_stat("stats_uint", "byte", "i", "SELECT 'UInt' AS kind, CAST(min(p_size) FILTER (p_size <> 50) AS VARCHAR) AS low, CAST(max(p_size) FILTER (p_size <> 50) AS VARCHAR) AS high, CAST(count_if(p_size = 50) AS BIGINT) AS null_count, count(*) AS row_count FROM part")
_stat("stats_uint64", "big", "i", "SELECT 'UInt' AS kind, CAST(18446744073709551615 - max(p_partkey) AS VARCHAR) AS low, CAST(18446744073709551615 - min(p_partkey) AS VARCHAR) AS high, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM part")
_stat("stats_float", "float", "f", "SELECT 'Float' AS kind, min(value + 0.0) AS low, max(value + 0.0) AS high, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM events")
_stat("stats_nan_fill", "nan", "f", "SELECT 'Float' AS kind, min(value + 0.0) FILTER (event_id % 10 <> 0) AS low, max(value + 0.0) FILTER (event_id % 10 <> 0) AS high, CAST(count_if(event_id % 10 = 0) AS BIGINT) AS null_count, count(*) AS row_count FROM events")
_stat("stats_string", "text", "b", "SELECT 'Bytes' AS kind, hex(min(event_type) FILTER (event_type <> 'click')) AS low, hex(max(event_type) FILTER (event_type <> 'click')) AS high, CAST(count_if(event_type = 'click') AS BIGINT) AS null_count, count(*) AS row_count FROM events")
_stat("stats_binary", "bytes", "b", "SELECT 'Bytes' AS kind, '00' AS low, 'FF' AS high, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM events")
_stat("stats_timestamp", "time", "i", "SELECT 'TimestampNs' AS kind, CAST(min(epoch_us(o_orderdate)) * 1000 AS VARCHAR) AS low, CAST(max(epoch_us(o_orderdate)) * 1000 AS VARCHAR) AS high, CAST(5 AS BIGINT) AS null_count, count(*) + 5 AS row_count FROM orders")
_stat("stats_unwritten_null", "value", "f", f"SELECT 'Float' AS kind, min(v) FILTER (v <> -999.0) AS low, max(v) FILTER (v <> -999.0) AS high, CAST(count_if(v = -999.0) AS BIGINT) AS null_count, count(*) AS row_count FROM (SELECT {VALUE} AS v FROM events) t", "events")
_stat("stats_after_overwrite", "price", "f", f"SELECT 'Float' AS kind, min(v) AS low, max(v) AS high, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM (SELECT {PRICE} AS v FROM orders) t", "orders")
_stat("stats_survive_compact", "value", "f", SQL["stats_unwritten_null"], "compacted")
# written cells that equal the fill value and cells that nobody wrote are null alike
_stat("stats_fill_as_null", "half", "i", "SELECT 'Int' AS kind, CAST(min(p_size) FILTER (p_size <> 25) AS VARCHAR) AS low, CAST(max(p_size) FILTER (p_size <> 25) AS VARCHAR) AS high, CAST(count_if(p_size = 25) + 7 AS BIGINT) AS null_count, count(*) + 7 AS row_count FROM part")
# an array without a fill value beside arrays of its type that have one
_stat("stats_mixed_fills", "plain", "i", "SELECT 'Int' AS kind, CAST(min(p_size) AS VARCHAR) AS low, CAST(max(p_size) AS VARCHAR) AS high, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM part")
# a float fill value is read where nobody wrote, but marks no written integer, nor those that fill up a chunk that is written in part
_stat("stats_fill_kind_mismatch", "float_fill", "i", "SELECT 'Int' AS kind, CAST(min(p_size) AS VARCHAR) AS low, CAST(max(p_size) AS VARCHAR) AS high, CAST(count(*) + 3 - least(count(*) + 3, (count(*) + 999) // 1000 * 1000) AS BIGINT) AS null_count, count(*) + 3 AS row_count FROM part")


@query("SELECT CAST(0 AS BIGINT) AS entries")
def stats_after_delete(spark, d):
    return store(spark, d, "catalog").stats().filter("name = 'gone'").agg(F.count("*").alias("entries"))


@query("SELECT unnest(['a', 'c', 'again', 'orders']) AS name")
def stats_entries(spark, d):
    return store(spark, d, "catalog").stats().select("name")


@query(f"SELECT event_id // 1000 AS chunk_ord, count(*) AS n, CAST(count_if(v <> -999.0) AS BIGINT) AS nn, min(v) FILTER (v <> -999.0) AS min_f, max(v) FILTER (v <> -999.0) AS max_f FROM (SELECT event_id, {VALUE} AS v FROM events) t WHERE {WRITTEN.replace('i ', 'event_id // 1000 ')} GROUP BY 1")
def stats_chunk_partials(spark, d):
    return store(spark, d, "events").chunk_stats("value").select("chunk_ord", "n", "nn", "min_f", "max_f")


@query("SELECT min(p_size) FILTER (p_size <> 1) AS low, max(p_size) FILTER (p_size <> 1) AS high, CAST(count_if(p_size <> 1) AS BIGINT) AS nn FROM part")
def stats_merge(spark, d):
    return store(spark, d, "typed").chunk_stats("int").agg(F.min("min_i").cast("int").alias("low"), F.max("max_i").cast("int").alias("high"), F.sum("nn").alias("nn"))


@query("SELECT event_id AS d0, value AS v FROM events WHERE value > (SELECT 0.9 * max(value) FROM events)")
def stats_prune(spark, d):
    """A value filter answered from the chunks whose maximum admits it."""
    s = store(spark, d, "events")
    bar = 0.9 * s.array_stats("whole")["max"]
    a = s.get_array("whole")
    hits = s.chunk_stats("whole").filter(F.col("max_f") > bar).select("chunk_ord")
    axes, _ = grid.overlapping(a.shape, a.chunk, [0], a.shape)
    dense = s._dense(a, axes).join(hits, "chunk_ord", "left_semi")
    from tessera.operators.read import cells

    return cells(dense, a.shape, a.chunk, [0], a.shape).filter(F.col("v") > bar)


# -- encodings and codecs -----------------------------------------------------------


@query("SELECT event_id, CAST(coalesce(sum(octet_length(encode(event_type))) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM events")
def encode_offsets(spark, d):
    return offsets.running_offsets(table(spark, d, "events"), "event_id", "event_type").select("event_id", "off")


@query("SELECT event_id, event_type AS v FROM events")
def decode_offsets(spark, d):
    """Encode blocks of 500 values, decode them again."""
    coded = offsets.encode_blocks(table(spark, d, "events").withColumn("b", F.expr("event_id div 500L")), "b", "event_id", "event_type")
    return coded.select(F.explode(F.arrays_zip("keys", offsets.decode_array(F.col("encoded")).alias("v"))).alias("x")).select(F.col("x.keys").alias("event_id"), F.col("x.v").cast("string").alias("v"))


for _codec in ("none", "zstd", "lz4"):
    _add(f"codec_roundtrip_{_codec}", _read("vectors", "m", codec=_codec), CELL2)


@query("SELECT l_partkey, count(*) AS n, round(sum(q), 4) AS total FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) t GROUP BY 1")
def many_arrays_read(spark, d):
    found = store(spark, d, "many").read_many()
    return found.select(F.expr("substring(name, 6)").cast("bigint").alias("l_partkey"), F.size("vals").cast("bigint").alias("n"), F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"SELECT 'rmw' AS name, count(*) AS n, CAST(count_if(({RMW}) = -999.0) AS BIGINT) AS blank FROM events UNION ALL SELECT 'apart', count(*), 0 FROM events")
def many_arrays_filled(spark, d):
    """All chunks of several arrays, those that nobody wrote too."""
    found = store(spark, d, "patched").read_many(["rmw", "apart"], fill=True)
    blank = F.size(F.filter("vals", lambda x: x == -999.0))
    return found.groupBy("name").agg(F.sum(F.size("vals")).alias("n"), F.sum(blank).alias("blank"))

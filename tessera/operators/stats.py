"""Per-chunk statistics, and their merge into one row per array.

Partials are computed once, when chunk rows are written, from the arrays
themselves (no explode); array statistics merge the partials of the newest
chunks and never read data again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dtypes import DTYPES, DType

#: Typed fields of the smallest and largest value: integers of any kind, floats, bytes.
INDEX_SCHEMA = "array_id bigint, chunk_ord bigint, wseq bigint, n bigint, nn bigint, min_i decimal(20,0), max_i decimal(20,0), min_f double, max_f double, min_b binary, max_b binary"

#: Arrays with a null marker up to which the table of markers is broadcast.
BROADCAST_ROWS = 200_000


def value_column(t: DType) -> str:
    return {"Float": "f", "Bytes": "b"}.get(t.stat, "i")


def partials(chunks: DataFrame, t: DType, fills: dict[int, object], spans: Sequence[tuple[int, int, object]] = ()) -> DataFrame:
    """Index rows of chunk rows (array_id, chunk_ord, wseq, vals); fills: the null marker, or None, of each array in the part; spans: (first id, last id, marker) of bulks.

    A marker counts for its own array only.  One array's is a literal; those of
    many arrays are a small table, of which only the arrays that have one are
    rows.
    """
    held = {k: x for k, x in fills.items() if x is not None}
    if not held or (len(fills) == 1 and not spans):
        marker = literal(t, next(iter(held.values()), None))
    else:
        rows = chunks.sparkSession.createDataFrame([(k, _cell(t, x)) for k, x in held.items()], f"of bigint, marker {t.spark}")
        chunks = chunks.join(F.broadcast(rows) if len(held) <= BROADCAST_ROWS else rows, F.col("array_id") == F.col("of"), "left")
        marker = F.col("marker")
    for first, last, x in spans:
        marker = F.when(F.col("array_id").between(first, last), literal(t, x)).otherwise(marker)
    v = F.filter("vals", lambda x: x.isNotNull() & ~x.eqNullSafe(marker)) if held or spans else F.filter("vals", lambda x: x.isNotNull())
    low, high = F.array_min("v"), F.array_max("v")
    own = value_column(t)
    kind = {"i": "decimal(20,0)", "f": "double", "b": "binary"}
    cast = lambda c: c.cast("int").cast(kind["i"]) if t.name == "bool" else c.cast(kind[own])
    cols = [(cast(low if m == "min" else high) if c == own else F.lit(None).cast(kind[c])).alias(f"{m}_{c}") for c in "ifb" for m in ("min", "max")]
    return chunks.select("array_id", "chunk_ord", "wseq", F.size("vals").cast("bigint").alias("n"), v.alias("v")).select("array_id", "chunk_ord", "wseq", "n", F.size("v").cast("bigint").alias("nn"), *cols)


def _cell(t: DType, x):
    return None if x is None else Decimal(x) if t.name == "uint64" else bytearray(x) if t.name == "binary" else x


def literal(t: DType, x) -> Column:
    return F.lit(_cell(t, x)).cast(t.spark)


def newest(index: DataFrame) -> DataFrame:
    """The winning index row of each chunk: the one written last."""
    last = index.groupBy("array_id", "chunk_ord").agg(F.max("wseq").alias("wseq"))
    return index.join(last, ["array_id", "chunk_ord", "wseq"], "left_semi")


def merge(index: DataFrame) -> DataFrame:
    """(array_id, nn, typed min and max) over the partials of the given chunks."""
    return index.groupBy("array_id").agg(F.sum("nn").alias("nn"), *[f(f"{m}_{c}").alias(f"{m}_{c}") for c in "ifb" for m, f in (("min", F.min), ("max", F.max))])


def entries(arrays: DataFrame, merged: DataFrame, t: DType, all_arrays: bool) -> DataFrame:
    """Rows of STATS_SCHEMA for arrays (array_id, name, length), as to_entry makes them; those without partials only if all are wanted."""
    found = arrays.join(merged, "array_id", "left" if all_arrays else "inner")
    return found.select("name", F.lit(t.stat).alias("kind"), *[f"{m}_{c}" for c in "ifb" for m in ("min", "max")], (F.col("length") - F.coalesce("nn", F.lit(0))).alias("null_count"), F.col("length").alias("row_count"))


def to_entry(row, t: DType, cells: int) -> dict:
    """A statistics entry; cells that were never written count as null."""
    def value(x):
        if x is None:
            return None
        return bytes(x).hex() if t.stat == "Bytes" else float(x) if t.stat == "Float" else int(x)

    own = value_column(t)
    seen = int(row["nn"]) if row is not None else 0
    low, high = (value(row[f"{m}_{own}"]) if row is not None else None for m in ("min", "max"))
    return {"kind": t.stat, "min": repr(low) if t.stat == "Float" and low is not None else low, "max": repr(high) if t.stat == "Float" and high is not None else high, "null_count": cells - seen, "row_count": cells}


def decode_entry(entry: dict | None) -> dict | None:
    if entry is None:
        return None
    one = lambda x: None if x is None else float(x) if entry["kind"] == "Float" else bytes.fromhex(x) if entry["kind"] == "Bytes" else x
    return entry | {"min": one(entry["min"]), "max": one(entry["max"])}


STATS_SCHEMA = "name string, kind string, min_i decimal(20,0), max_i decimal(20,0), min_f double, max_f double, min_b binary, max_b binary, null_count bigint, row_count bigint"


def entry_rows(entries: Iterable[tuple[str, str, dict]]) -> list[tuple]:
    """Rows of STATS_SCHEMA for (name, dtype, entry)."""
    rows = []
    for name, dtype, entry in entries:
        e, own = decode_entry(entry), value_column(DTYPES[dtype])
        conv = {"i": lambda x: Decimal(x), "f": float, "b": bytearray}[own]
        vals = [conv(e[m]) if c == own and e[m] is not None else None for c in "ifb" for m in ("min", "max")]
        rows.append((name, e["kind"], *vals, e["null_count"], e["row_count"]))
    return rows

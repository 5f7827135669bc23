"""ArrayStore: the user-facing handle of a dataset of named n-dimensional arrays.

Writes go to Parquet parts at once and become part of the state with flush();
until then only this handle sees them.  Every definition of an array has its
own id, so a name that is deleted and defined again never shows old chunks.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Sequence
from copy import deepcopy
from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ArrayAlreadyExists, ArrayNotFound, CodecError, DTypeMismatch, StoreError, StoreFormatError
from tessera.functions import grid
from tessera.functions.dtypes import ATTR_SCHEMA, DTYPES, Attr, DType, Fill, read_fill, stat_fill
from tessera.operators import read as R
from tessera.operators import stats as S
from tessera.operators import write as W
from tessera.sources import manifest as M
from tessera.sources.fs import HadoopFs
from tessera.sources.scratch import scratch_dir

#: Codec names, what Spark's Parquet writer calls them, and further options of the writer.
CODECS: dict[str, tuple[str, dict[str, str]]] = {"none": ("uncompressed", {}), "zstd": ("zstd", {}), "lz4": ("lz4_raw", {})}


def register_codec(name: str, parquet: str, **options: str) -> None:
    """Make a codec of the Parquet writer, with its options, known under a name.  Files tell their codec, so readers need not know it."""
    CODECS[name] = (parquet, {k: str(v) for k, v in options.items()})


BULK_SCHEMA = "array_id bigint, name string, length bigint, chunk bigint"
ARRAYS_SCHEMA = "name string, dtype string, shape array<bigint>, chunk_shape array<bigint>, dims array<string>, seq bigint"


class ArrayStore:
    def __init__(self, spark: SparkSession, root: str, state: M.State, codec: str = "zstd", codec_level: int | None = None, block_bytes: int | None = None, honour_string_fill: bool = False):
        if codec not in CODECS:
            raise CodecError(f"unknown codec {codec!r}")
        self.spark, self.root, self.codec, self.codec_level, self.block_bytes = spark, root.rstrip("/"), codec, codec_level, block_bytes
        self.honour_string_fill = honour_string_fill
        self._state = state
        self._pending: list[M.Part] | None = None
        self._dirty: set[int] = set()

    # -- lifecycle ---------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, overwrite: bool = False, **options) -> "ArrayStore":
        fs = HadoopFs(spark, root)
        if M.latest(fs, root) is not None:
            if not overwrite:
                raise StoreError(f"a store exists at {root}")
            fs.delete(root)
        store = cls(spark, root, M.State(), **options)
        M.commit(fs, store.root, store._state)
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> "ArrayStore":
        return cls(spark, root, M.load(spark, root.rstrip("/")), **options)

    @classmethod
    def in_memory(cls, spark: SparkSession, **options) -> "ArrayStore":
        """A store in the session's scratch folder, which nobody else opens."""
        return cls.create(spark, scratch_dir(spark, "store"), **options)

    def num_layers(self) -> int:
        return len(self._state.layers)

    def flush(self) -> None:
        """Commit what is pending as one layer; without anything pending, do nothing."""
        if self._pending is None:
            return
        state = deepcopy(self._state)
        state.number += 1
        state.layers.append(M.Layer(len(state.layers), self._pending))
        live = {a.array_id: a for a in state.arrays.values()}
        dirty = [live[i] for i in sorted(self._dirty) if i in live]
        self._fill_stats(state, dirty)
        M.commit(HadoopFs(self.spark, self.root), self.root, state)
        self._state, self._pending, self._dirty = state, None, set()

    def compact(self) -> None:
        """Flush, then merge all layers into one new generation and drop the old one.

        The new generation is written beside the old, the manifest swapped,
        and only then the old files deleted: no path is used twice.
        """
        self.flush()
        old, state = self._state, deepcopy(self._state)
        state.number, state.generation = old.number + 1, old.generation + 1
        base = M.Layer(0)
        for name in sorted({p.dtype for p in self._parts()}):
            arrays = [a for a in state.arrays.values() if a.dtype == name and a.written]
            bulks = [b for b in state.bulks if b.dtype == name and b.written]
            if arrays or bulks:
                base.parts.append(self._write_part(DTYPES[name], self._newest(name, [a.array_id for a in arrays], bulks=bulks), arrays, state.generation, clustered=True, bulks=bulks))
        state.layers = [base]
        for b in state.bulks:
            b.entries = True
        self._fill_stats(state, list(state.arrays.values()), state)
        fs = HadoopFs(self.spark, self.root)
        M.commit(fs, self.root, state)
        self._state = state
        fs.delete(f"{self.root}/gen={old.generation}")

    # -- catalog -----------------------------------------------------------

    def define_array(self, name: str, dtype: str, shape: Sequence[int], chunk_shape: Sequence[int] | None = None, dims: Sequence[str] | None = None, fill: Fill | None = None) -> None:
        if name in self._state.arrays or self._find([name]):
            raise ArrayAlreadyExists(name)
        if dtype not in DTYPES or not DTYPES[dtype].defined:
            raise StoreError(f"arrays of {dtype!r} cannot be defined")
        shape, chunk = [int(s) for s in shape], [int(c) for c in (shape if chunk_shape is None else chunk_shape)]
        if any(s < 0 for s in shape) or len(chunk) != len(shape) or any(c < 1 and s > 0 for c, s in zip(chunk, shape, strict=True)):
            raise StoreFormatError(f"chunk shape {chunk} does not fit shape {shape}")
        names = list(dims) if dims is not None and len(dims) == len(shape) else [f"dim{k}" for k in range(len(shape))]
        self._touch()
        seq = self._next()
        self._state.arrays[name] = M.ArrayMeta(seq, name, dtype, shape, chunk, names, None if fill is None else [fill.kind, fill.value], seq)

    def define_many(self, arrays: DataFrame, dtype: str, chunk: int | None = None, fill: Fill | None = None) -> None:
        """Define one-dimensional arrays of one type, a row (name, length) each, in chunks of `chunk` cells or else whole.

        Their catalog is a table beside the data: the driver holds none of
        them, but those that are later written, deleted or given attributes
        by name.
        """
        if dtype not in DTYPES or not DTYPES[dtype].defined:
            raise StoreError(f"arrays of {dtype!r} cannot be defined")
        if chunk is not None and chunk < 1:
            raise StoreFormatError(f"chunk length {chunk}")
        path, first = f"catalog/{uuid.uuid4().hex}", self._state.next_seq + 1
        size = F.col("length") if chunk is None else F.lit(int(chunk)).cast("bigint")
        rows = arrays.select(F.col("name").cast("string"), F.col("length").cast("bigint")).repartitionByRange("name").sortWithinPartitions("name")
        rows.select((F.monotonically_increasing_id() + first).alias("array_id"), "name", "length", size.alias("chunk")).write.parquet(f"{self.root}/{path}")
        bulk = M.Bulk(dtype, path, first, first, None if fill is None else [fill.kind, fill.value])
        made = self.spark.read.schema(BULK_SCHEMA).parquet(f"{self.root}/{path}")
        bulk.last, bad = made.agg(F.max("array_id"), F.count_if(F.expr("name is null or length is null or length < 0"))).first()
        if bad:
            raise StoreFormatError(f"{bad} arrays without a name or a length from 0 on")
        names = made.select("name")
        known = reduce(DataFrame.union, [x.select("name") for x in self._known(self._state.arrays.values(), self._state.bulks)], names)
        twice = known.groupBy("name").count().filter("count > 1").first()
        if twice:
            raise ArrayAlreadyExists(twice["name"])
        if bulk.last is None:
            return
        self._touch()
        self._state.next_seq = bulk.last
        self._state.bulks.append(bulk)

    def delete(self, name: str) -> None:
        self._meta(name)
        self._touch()
        self._own(name)
        del self._state.arrays[name]

    def get_array(self, name: str) -> M.ArrayMeta:
        return deepcopy(self._meta(name))

    def list_arrays(self) -> DataFrame:
        """One row per visible array, in order of definition."""
        rows = [(a.name, a.dtype, a.shape, a.chunk, a.dims, a.seq) for a in sorted(self._state.arrays.values(), key=lambda a: a.seq)]
        own = self.spark.createDataFrame(rows, ARRAYS_SCHEMA)
        if not self._state.bulks:
            return own
        many = [self._rows(b).select("name", F.lit(b.dtype), F.array("length"), F.array("chunk"), F.array(F.lit("dim0")), F.col("array_id")) for b in self._state.bulks]
        return reduce(DataFrame.union, many, own).orderBy("seq")

    def chunk_index(self, name: str) -> DataFrame:
        """The newest index row of each chunk of an array that has been written."""
        a = self._meta(name)
        index = self._index(a.dtype, [a.array_id])
        return S.newest(index) if index is not None else self.spark.createDataFrame([], S.INDEX_SCHEMA)

    # -- attributes --------------------------------------------------------

    def set_attribute(self, name: str, key: str, value: Attr | object) -> None:
        self._meta(name)
        self._touch()
        self._own(name).attrs[key] = Attr.of(value).to_json()

    def get_attribute(self, name: str, key: str) -> Attr | None:
        x = self._meta(name).attrs.get(key)
        return None if x is None else Attr.from_json(x)

    def attribute_index(self, key: str) -> DataFrame:
        """(name, value) over all visible arrays; value is null where the array lacks the key."""
        schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T._parse_datatype_string(ATTR_SCHEMA))])
        rows = [(a.name, Attr.from_json(a.attrs[key]).to_row() if key in a.attrs else None) for a in sorted(self._state.arrays.values(), key=lambda a: a.seq)]
        return reduce(DataFrame.union, [self._rows(b).select("name", F.lit(None)) for b in self._state.bulks], self.spark.createDataFrame(rows, schema))

    def set_file_metadata(self, key: str, value: Attr | object) -> None:
        """Metadata of the store itself, kept on a reserved scalar array."""
        if "__file__" not in self._state.arrays:
            self.define_array("__file__", "uint8", [])
        self.set_attribute("__file__", key, value)

    # -- statistics --------------------------------------------------------

    def array_stats(self, name: str) -> dict | None:
        a = self._state.arrays.get(name) or next(iter(self._find([name])), None)
        return S.decode_entry(a.stats if name in self._state.arrays else self._bulk_entry(a)) if a else None

    def stats(self) -> DataFrame:
        """One row per array that has statistics; those of bulks are merged here, from the partials of what is flushed."""
        rows = S.entry_rows((a.name, a.dtype, a.stats) for a in sorted(self._state.arrays.values(), key=lambda a: a.seq) if a.stats)
        many = []
        for b in self._state.bulks:
            index = self._index(b.dtype, [], paths=self._flushed(), bulks=[b])
            index = self.spark.createDataFrame([], S.INDEX_SCHEMA) if index is None else S.newest(index)
            many.append(S.entries(self._rows(b), S.merge(index), DTYPES[b.dtype], b.entries))
        return reduce(DataFrame.union, many, self.spark.createDataFrame(rows, S.STATS_SCHEMA))

    def chunk_stats(self, name: str) -> DataFrame:
        return self.chunk_index(name).select("chunk_ord", "n", "nn", "min_i", "max_i", "min_f", "max_f", "min_b", "max_b")

    # -- reading -----------------------------------------------------------

    def read_cells(self, name: str, start: Sequence[int] = (), shape: Sequence[int] = (), dtype: str | None = None) -> DataFrame:
        """Cells (d0, ..., v) of a region.  Ranges are clamped; a start or shape of another rank means the default."""
        a, first, stop, axes = self._region(name, start, shape, dtype)
        return R.cells(self._dense(a, axes), a.shape, a.chunk, first, stop)

    def read_array(self, name: str, start: Sequence[int] = (), shape: Sequence[int] = (), dtype: str | None = None) -> np.ndarray:
        """A region as an ndarray on the driver."""
        a, first, stop, axes = self._region(name, start, shape, dtype)
        t = DTYPES[a.dtype]
        out = np.empty([b - s for s, b in zip(first, stop, strict=True)], dtype=t.numpy)
        g, st = grid.grid_of(a.shape, a.chunk), grid.strides(grid.grid_of(a.shape, a.chunk))
        if out.size == 0:
            return out
        for o, vals in self._dense(a, axes).collect():
            coord = [(o // s) % n for s, n in zip(st, g, strict=True)]
            lo = [c * k for c, k in zip(coord, a.chunk, strict=True)]
            ext = [min(k, s - x) for k, s, x in zip(a.chunk, a.shape, lo, strict=True)]
            block = to_numpy(vals, t).reshape(ext)
            src = tuple(slice(max(f - x, 0), min(b - x, e)) for f, b, x, e in zip(first, stop, lo, ext, strict=True))
            dst = tuple(slice(max(x - f, 0), min(x + e, b) - f) for f, b, x, e in zip(first, stop, lo, ext, strict=True))
            out[dst] = block[src]
        return out

    def read_many(self, names: Sequence[str] | None = None, fill: bool = False) -> DataFrame:
        """(name, chunk_ord, vals) of the chunks of many arrays of one element type, in one job: the written ones, or with `fill` all."""
        if names is None:
            metas, bulks = [a for a in self._state.arrays.values() if a.written], [b for b in self._state.bulks if b.written]
        else:
            metas, bulks = self._metas(names), []
        kinds = {a.dtype for a in [*metas, *bulks]}
        if len(kinds) != 1:
            raise StoreError(f"read_many takes arrays of one element type, not {sorted(kinds)}")
        t, ids = DTYPES[kinds.pop()], [a.array_id for a in metas]
        by_id = reduce(DataFrame.union, [x.select("array_id", "name") for x in self._known(metas, bulks)])
        found = self._newest(t.name, ids, bulks=bulks)
        out = self.spark.createDataFrame([], f"array_id bigint, chunk_ord bigint, vals array<{t.spark}>") if found is None else found.select("array_id", "chunk_ord", "vals")
        if fill:
            rows = []
            for a in metas:
                g = grid.grid_of(a.shape, a.chunk)
                rows.append((a.array_id, a.shape, a.chunk, g, grid.strides(g), math.prod(g), to_cell(read_fill(t, self._fill_of(a), self.honour_string_fill), t)))
            every = self.spark.createDataFrame(rows, f"array_id bigint, shape array<bigint>, chunk array<bigint>, grid array<bigint>, strides array<bigint>, chunks bigint, fill {t.spark}")
            for b in bulks:
                g = F.expr("(length + greatest(chunk, 1L) - 1L) div greatest(chunk, 1L)")
                value = F.lit(to_cell(read_fill(t, self._fill_of(b), self.honour_string_fill), t)).cast(t.spark)
                every = every.union(self._rows(b).select("array_id", F.array("length"), F.array("chunk"), F.array(g), F.array(F.lit(1).cast("bigint")), g, value))
            every = every.filter("chunks > 0").withColumn("chunk_ord", F.expr("explode(sequence(0L, chunks - 1L))"))
            if found is not None:
                every = every.join(self._index(t.name, ids, bulks=bulks).select("array_id", "chunk_ord").distinct(), ["array_id", "chunk_ord"], "left_anti")
            length = F.expr("aggregate(arrays_zip(shape, chunk, grid, strides), 1L, (a, x) -> a * least(x.chunk, x.shape - ((chunk_ord div x.strides) % x.grid) * x.chunk))")
            out = out.unionByName(every.select("array_id", "chunk_ord", F.array_repeat("fill", length.cast("int")).alias("vals")))
        return out.join(by_id, "array_id").select("name", "chunk_ord", "vals")

    # -- writing -----------------------------------------------------------

    def write_array(self, name: str, start: Sequence[int], values) -> None:
        """Write an ndarray held by the driver.  Partly covered chunks are read, patched and written whole."""
        a = self._meta(name)
        t = DTYPES[a.dtype]
        block = np.asarray(values, dtype=None if t.numpy != "object" else object)
        if t.numpy != "object" and block.dtype != np.dtype(t.numpy) and block.size:
            cast = block.astype(t.numpy)
            if not np.array_equal(cast, block, equal_nan=block.dtype.kind == "f"):
                raise DTypeMismatch(name, a.dtype, str(block.dtype))
            block = cast
        start = [int(s) for s in start] if len(a.shape) or start else []
        self._bounds(a, start, block.shape)
        if block.size == 0:
            return
        stop = [s + n for s, n in zip(start, block.shape, strict=True)]
        axes, _ = grid.overlapping(a.shape, a.chunk, start, stop)
        st = grid.strides(grid.grid_of(a.shape, a.chunk))
        full, part = {}, {}
        for coord in np.ndindex(*[len(r) for r in axes]):
            c = [r[i] for r, i in zip(axes, coord, strict=True)]
            lo = [x * k for x, k in zip(c, a.chunk, strict=True)]
            ext = [min(k, s - x) for k, s, x in zip(a.chunk, a.shape, lo, strict=True)]
            src = tuple(slice(max(x - s, 0), min(x + e, b) - s) for s, b, x, e in zip(start, stop, lo, ext, strict=True))
            dst = tuple(slice(max(s - x, 0), min(b - x, e)) for s, b, x, e in zip(start, stop, lo, ext, strict=True))
            whole = all(d.start == 0 and d.stop == e for d, e in zip(dst, ext, strict=True))
            (full if whole else part)[sum(x * s for x, s in zip(c, st, strict=True))] = (ext, src, dst)
        rows = [(o, to_spark(np.asarray(block[src], block.dtype).reshape(-1), t)) for o, (_, src, _) in full.items()]
        if part:
            old = self._dense(a, axes).filter(F.col("chunk_ord").isin(list(part)))
            for o, vals in old.collect():
                ext, src, dst = part[o]
                patched = to_numpy(vals, t).reshape(ext).copy()
                patched[dst] = block[src]
                rows.append((o, to_spark(patched.reshape(-1), t)))
        schema = T.StructType([T.StructField("chunk_ord", T.LongType()), T.StructField("vals", T._parse_datatype_string(f"array<{t.spark}>"))])
        self._append(a, self.spark.createDataFrame(rows, schema))

    def write_cells(self, name: str, cells: DataFrame, order_by: str | None = None) -> None:
        """Write cells (d0, ..., v) from a DataFrame.  Repeated coordinates need an order column, whose largest value wins."""
        a = self._meta(name)
        dims = [f"d{k}" for k in range(len(a.shape))]
        if order_by:
            cells = cells.groupBy(*dims).agg(F.max_by("v", order_by).alias("v"))
        cells = cells.select(*[F.col(d).cast("bigint").alias(d) for d in dims], "v")
        t = DTYPES[a.dtype]
        # grouped once and kept, so that checks, covered and patched chunks all see one evaluation of the source
        staged = scratch_dir(self.spark, "patches")
        found = W.cells_to_chunks(cells, a.shape, a.chunk, t.spark)
        found.write.parquet(staged)
        patches = self.spark.read.schema(found.schema).parquet(staged)
        coords = [F.when(~F.col("covered"), F.expr(c)) for c in grid.chunk_coord_sql(a.shape, a.chunk)]
        ends = [f(c).alias(f"{m}c{k}") for k, c in enumerate(coords) for m, f in (("lo", F.min), ("hi", F.max))]
        seen = patches.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.count_if("twice").alias("twice"), F.count_if(~F.col("covered")).alias("part"), *ends, *[f(f"{m}{k}").alias(f"{m}{k}") for k in range(len(dims)) for m, f in (("lo", F.min), ("hi", F.max))]).first()
        if seen["n"]:
            if seen["bad"]:
                raise StoreFormatError(f"array {name!r}: a coordinate is null")
            first = [seen[f"lo{k}"] for k in range(len(dims))]
            self._bounds(a, first, [seen[f"hi{k}"] - f + 1 for k, f in enumerate(first)])
            if seen["twice"]:
                raise StoreFormatError(f"array {name!r}: repeated coordinates")
            chunks = W.covered(patches)
            if seen["part"]:
                # only chunks that are covered in part look for old values: by name if they are few, else in the range where they are
                axes = [range(seen[f"loc{k}"], seen[f"hic{k}"] + 1) for k in range(len(dims))]
                where = grid.ordinal_filter(a.shape, a.chunk, axes)
                if seen["part"] <= 256:
                    where = f"chunk_ord in ({', '.join(f'{r[0]}L' for r in patches.filter('not covered').select('chunk_ord').collect())})"
                old = self._newest(a.dtype, [a.array_id], where, math.prod(len(r) for r in axes)) if a.written else None
                fill = F.lit(to_cell(read_fill(t, self._fill_of(a), self.honour_string_fill), t)).cast(t.spark)
                over = W.patched(patches, old, a.shape, a.chunk, fill)
                chunks = chunks.unionByName(over) if seen["part"] < seen["n"] else over
            self._append(a, chunks)
        HadoopFs(self.spark, staged).delete(staged)

    def write_many(self, rows: DataFrame, name: str, pos: str, value: str) -> None:
        """Fill many one-dimensional arrays of one type in one job; every cell of a touched chunk must be present."""
        metas, bulks = [a for a in self._state.arrays.values() if len(a.shape) == 1], self._state.bulks
        kinds = {x.dtype for x in [*metas, *bulks]}
        if len(kinds) > 1:
            typed = [x.select("name", "dtype") for x in self._known(metas, bulks)]
            kinds = {r[0] for r in rows.select(F.col(name).alias("name")).distinct().join(reduce(DataFrame.union, typed), "name").select("dtype").distinct().collect()}
        if len(kinds) != 1:
            raise StoreError(f"write_many takes one-dimensional arrays of one element type, not {sorted(kinds)}")
        t = DTYPES[kinds.pop()]
        metas, bulks = [a for a in metas if a.dtype == t.name], [b for b in bulks if b.dtype == t.name]
        ids = reduce(DataFrame.union, self._known(metas, bulks)).select(F.col("name").alias(name), "array_id", F.col("chunk").alias("c"), F.col("length").alias("s"))
        unknown = F.raise_error(F.concat(F.lit("write_many: no array <"), F.coalesce(F.col(name), F.lit("null")), F.lit(">")))
        placed = rows.join(ids, name, "left").select(F.coalesce("array_id", unknown.cast("bigint")).alias("array_id"), "c", "s", F.expr(f"`{pos}` div c").alias("chunk_ord"), F.expr(f"`{pos}` % c").alias("p"), F.col(value).cast(t.spark).alias("v"))
        grouped = placed.groupBy("array_id", "c", "s", "chunk_ord").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("pv"))
        short = F.size("pv") != F.expr("least(c, s - chunk_ord * c)")
        vals = F.when(short, F.raise_error(F.lit("write_many: a chunk is covered in part"))).otherwise(F.transform("pv", lambda x: x["v"]))
        self._touch()
        seq = self._next()
        try:
            part = self._write_part(t, grouped.select("array_id", "chunk_ord", F.lit(seq).cast("bigint").alias("wseq"), vals.alias("vals")), metas, self._state.generation, clustered=True, bulks=bulks)
        except Exception as e:
            if found := re.search("write_many: no array <(.*?)>", str(e)):
                raise ArrayNotFound(found[1]) from e
            raise
        self._pending.append(part)
        # the arrays that were written: bulks as their number below zero, so that the driver gets no row for each of their arrays
        bulks = [b for b in self._state.bulks if b.dtype == t.name]
        which = reduce(lambda x, k: F.when(F.col("array_id").between(bulks[k].first, bulks[k].last) & ~F.col("array_id").isin(self._state.taken), F.lit(-1 - k)).otherwise(x), range(len(bulks)), F.col("array_id"))
        written = {r[0] for r in self._index(t.name, None, paths=[part]).select(which).distinct().collect()}
        for a in self._state.arrays.values():
            if a.array_id in written:
                a.written = True
                self._dirty.add(a.array_id)
        for k, b in enumerate(bulks):
            b.written |= -1 - k in written

    # -- inside ------------------------------------------------------------

    def _touch(self) -> None:
        if self._pending is None:
            self._pending, self._state = [], deepcopy(self._state)

    def _next(self) -> int:
        self._state.next_seq += 1
        return self._state.next_seq

    def _meta(self, name: str) -> M.ArrayMeta:
        return self._metas([name])[0]

    def _metas(self, names: Sequence[str]) -> list[M.ArrayMeta]:
        known = self._state.arrays
        found = {a.name: a for a in self._find([n for n in names if n not in known])}
        for n in names:
            if n not in known and n not in found:
                raise ArrayNotFound(n)
        return [known.get(n) or found[n] for n in names]

    def _own(self, name: str) -> M.ArrayMeta:
        """The entry of an array that is about to change; one of a bulk gets its own from now on."""
        if name not in self._state.arrays:
            a = self._meta(name)
            a.stats = self._bulk_entry(a)
            self._state.arrays[name] = a
            self._state.taken.append(a.array_id)
        return self._state.arrays[name]

    def _find(self, names: Sequence[str]) -> list[M.ArrayMeta]:
        """Those of the names that are arrays of bulks."""
        out = []
        for b in self._state.bulks if names else []:
            rows = self._rows(b)
            wanted = rows.filter(F.col("name").isin(list(names))) if len(names) <= 256 else rows.join(self.spark.createDataFrame([(n,) for n in set(names)], "name string"), "name", "left_semi")
            out += [M.ArrayMeta(r["array_id"], r["name"], b.dtype, [r["length"]], [r["chunk"]], ["dim0"], b.fill, r["array_id"], written=b.written) for r in wanted.collect()]
        return out

    def _rows(self, b: M.Bulk) -> DataFrame:
        """(array_id, name, length, chunk) of a bulk's arrays, but those that are taken."""
        return self._untaken(self.spark.read.schema(BULK_SCHEMA).parquet(f"{self.root}/{b.path}"))

    def _untaken(self, df: DataFrame) -> DataFrame:
        taken = self._state.taken
        if len(taken) <= 256:
            return df.filter(~F.col("array_id").isin(taken)) if taken else df
        return df.join(F.broadcast(self.spark.createDataFrame([(i,) for i in taken], "array_id bigint")), "array_id", "left_anti")

    def _known(self, metas, bulks: Sequence[M.Bulk]) -> list[DataFrame]:
        """Tables (array_id, name, length, chunk, dtype) of arrays with entries of their own and of bulks; one of no rows if there are none."""
        rows = [(a.array_id, a.name, a.shape[0] if a.shape else None, a.chunk[0] if a.shape else None, a.dtype) for a in metas]
        own = [self.spark.createDataFrame(rows, BULK_SCHEMA + ", dtype string")] if rows or not bulks else []
        return own + [self._rows(b).withColumn("dtype", F.lit(b.dtype)) for b in bulks]

    def _bulk_entry(self, a: M.ArrayMeta) -> dict | None:
        """The statistics of an array of a bulk, merged from what is flushed."""
        index = self._index(a.dtype, [a.array_id], paths=self._flushed())
        row = S.merge(S.newest(index)).first() if index is not None else None
        every = any(b.first <= a.array_id <= b.last and b.entries for b in self._state.bulks)
        return S.to_entry(row, DTYPES[a.dtype], math.prod(a.shape)) if row is not None or every else None

    @staticmethod
    def _fill_of(a: M.ArrayMeta | M.Bulk) -> Fill | None:
        return Fill(*a.fill) if a.fill is not None else None

    def _bounds(self, a: M.ArrayMeta, start: Sequence[int], extent: Sequence[int]) -> None:
        if len(start) != len(a.shape) or len(extent) != len(a.shape):
            raise StoreFormatError(f"array {a.name!r} has rank {len(a.shape)}")
        if any(s < 0 or s + n > m for s, n, m in zip(start, extent, a.shape, strict=True)):
            raise StoreFormatError(f"array {a.name!r}: write outside shape {a.shape}")

    def _region(self, name, start, shape, dtype):
        a = self._meta(name)
        if dtype is not None and dtype != a.dtype:
            raise DTypeMismatch(name, a.dtype, dtype)
        first = list(start) if len(start) == len(a.shape) else [0] * len(a.shape)
        extent = list(shape) if len(shape) == len(a.shape) else list(a.shape)
        first = [min(max(0, int(f)), s) for f, s in zip(first, a.shape, strict=True)]
        stop = [min(f + max(0, int(e)), s) for f, e, s in zip(first, extent, a.shape, strict=True)]
        axes, _ = grid.overlapping(a.shape, a.chunk, first, stop)
        return a, first, stop, axes

    def _parts(self) -> list[M.Part]:
        return [p for layer in self._state.layers for p in layer.parts] + (self._pending or [])

    def _flushed(self) -> list[M.Part]:
        return [p for layer in self._state.layers for p in layer.parts]

    def _index(self, dtype: str, ids: Sequence[int] | None, where: str = "true", paths: Sequence[M.Part] | None = None, bulks: Sequence[M.Bulk] = ()) -> DataFrame | None:
        parts = [p for p in (self._parts() if paths is None else paths) if p.dtype == dtype]
        if not parts:
            return None
        index = self.spark.read.schema(S.INDEX_SCHEMA).parquet(*[f"{self.root}/{p.index}" for p in parts])
        return self._of(index, ids, bulks).filter(where)

    def _of(self, df: DataFrame, ids: Sequence[int] | None, bulks: Sequence[M.Bulk] = ()) -> DataFrame:
        """The rows of arrays: those with the given ids, and those of bulks, which are ranges that Parquet prunes on."""
        if ids is None:
            return df
        if bulks:
            many = self._untaken(df.filter(reduce(lambda x, y: x | y, [F.col("array_id").between(b.first, b.last) for b in bulks])))
            return many.unionByName(self._of(df, ids)) if ids else many
        if len(ids) <= 256:
            return df.filter(F.col("array_id").isin([int(i) for i in ids]))
        wanted = self.spark.createDataFrame([(int(i),) for i in ids], "array_id bigint")
        return df.filter(F.col("array_id").between(int(min(ids)), int(max(ids)))).join(wanted, "array_id", "left_semi")

    def _newest(self, dtype: str, ids: Sequence[int], where: str = "true", chunks: int | None = None, bulks: Sequence[M.Bulk] = ()) -> DataFrame | None:
        parts = [p for p in self._parts() if p.dtype == dtype]
        if not parts:
            return None
        t = DTYPES[dtype]
        data = self.spark.read.schema(f"array_id bigint, chunk_ord bigint, wseq bigint, vals array<{t.spark}>").parquet(*[f"{self.root}/{p.data}" for p in parts])
        data = self._of(data, ids, bulks).filter(where)
        return R.newest_chunks(data, self._index(dtype, ids, where, bulks=bulks) if len(parts) > 1 else None, chunks)

    def _dense(self, a: M.ArrayMeta, axes) -> DataFrame:
        t = DTYPES[a.dtype]
        fill = read_fill(t, self._fill_of(a), self.honour_string_fill)
        where = grid.ordinal_filter(a.shape, a.chunk, axes)
        chunks = self._newest(a.dtype, [a.array_id], where, math.prod(len(r) for r in axes)) if a.written else None
        index = self._index(a.dtype, [a.array_id], where) if chunks is not None else None
        return R.dense_chunks(self.spark, chunks, index, a.shape, a.chunk, axes, t, F.lit(to_cell(fill, t)).cast(t.spark))

    def _append(self, a: M.ArrayMeta, chunks: DataFrame) -> None:
        self._touch()
        a = self._own(a.name)
        seq = self._next()
        rows = chunks.select(F.lit(a.array_id).cast("bigint").alias("array_id"), "chunk_ord", F.lit(seq).cast("bigint").alias("wseq"), "vals")
        self._pending.append(self._write_part(DTYPES[a.dtype], rows, [a], self._state.generation))
        a.written = True
        self._dirty.add(a.array_id)

    def _write_part(self, t: DType, rows: DataFrame, arrays: Sequence[M.ArrayMeta], generation: int, clustered: bool = False, bulks: Sequence[M.Bulk] = ()) -> M.Part:
        """Write chunk rows of some arrays, then their index from what was written, so that sources are computed once."""
        tag = uuid.uuid4().hex
        part = M.Part(t.name, f"gen={generation}/data/dtype={t.name}/{tag}", f"gen={generation}/index/dtype={t.name}/{tag}")
        options = {"compression": CODECS[self.codec][0]} | CODECS[self.codec][1]
        if self.codec == "zstd" and self.codec_level is not None:
            options["parquet.compression.codec.zstd.level"] = str(self.codec_level)
        if self.block_bytes:
            options["parquet.block.size"] = str(self.block_bytes)
        if clustered:  # chunks of an array side by side, so that row groups prune on array_id and chunk_ord
            rows = rows.repartitionByRange("array_id", "chunk_ord")
        rows.sortWithinPartitions("array_id", "chunk_ord").write.options(**options).parquet(f"{self.root}/{part.data}")
        data = self.spark.read.schema(f"array_id bigint, chunk_ord bigint, wseq bigint, vals array<{t.spark}>").parquet(f"{self.root}/{part.data}")
        S.partials(data, t, {a.array_id: stat_fill(t, self._fill_of(a)) for a in arrays}, [(b.first, b.last, x) for b in bulks if (x := stat_fill(t, self._fill_of(b))) is not None]).write.parquet(f"{self.root}/{part.index}")
        return part

    def _fill_stats(self, state: M.State, arrays: list[M.ArrayMeta], source: M.State | None = None) -> None:
        """Recompute the entries of the given arrays from the partials of their newest chunks."""
        parts = [p for layer in (source or state).layers for p in layer.parts]
        for name in sorted({a.dtype for a in arrays}):
            t, own = DTYPES[name], [a for a in arrays if a.dtype == name]
            index = self._index(name, [a.array_id for a in own], paths=parts)
            rows = {r["array_id"]: r for r in S.merge(S.newest(index)).collect()} if index is not None else {}
            for a in own:
                a.stats = S.to_entry(rows.get(a.array_id), t, math.prod(a.shape))


def to_numpy(vals, t: DType) -> np.ndarray:
    if t.numpy == "object":
        out = np.empty(len(vals), dtype=object)
        out[:] = [bytes(v) if t.name == "binary" else v for v in vals]
        return out
    return np.array([int(v) for v in vals] if t.name == "uint64" else vals, dtype=t.numpy)


def to_cell(value, t: DType):
    """One value as Spark takes it."""
    return Decimal(value) if t.name == "uint64" else bytearray(value) if t.name == "binary" else value


def to_spark(flat: np.ndarray, t: DType) -> list:
    if t.name == "uint64":
        return [Decimal(int(v)) for v in flat]
    if t.name == "binary":
        return [bytearray(v) for v in flat]
    return [str(v) for v in flat] if t.name == "string" else flat.tolist()

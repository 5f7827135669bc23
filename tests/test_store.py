"""End-to-end cases: values that region reads, writes, layers, attributes and statistics must give."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import ArrayAlreadyExists, ArrayNotFound, ArrayStore, Attr, CodecError, DTypeMismatch, Fill, StoreError, StoreFormatError
from tessera.errors import CommitConflict
from tessera.functions.dtypes import DTYPES, fixed_size_list_size, read_fill, stat_fill


@pytest.fixture
def store(spark):
    return ArrayStore.in_memory(spark)


def test_fill_and_partial_writes(store):
    rng = np.random.default_rng(3)
    model = {}
    for name, n, chunk, fill in (("whole_then_blank", 11, 4, 17), ("patched_inside", 13, 5, -6)):
        store.define_array(name, "int32", [n], [chunk], fill=Fill("Int", fill))
        model[name] = np.full(n, fill)
    for name, at, size in (("whole_then_blank", 0, 4), ("patched_inside", 0, 5), ("patched_inside", 7, 2)):
        values = rng.integers(100, 200, size)
        store.write_array(name, [at], values)
        model[name][at : at + size] = values
    for _ in range(2):
        for name, want in model.items():
            assert store.read_array(name).tolist() == want.tolist()
            assert store.read_array(name, [3], [7]).tolist() == want[3:10].tolist()
        store.flush()


def test_patch_over_chunks_2d(store):
    store.define_array("g", "float32", [4, 4], [2, 2], dims=["lat", "lon"])
    store.write_array("g", [0, 0], np.zeros((4, 4), "float32"))
    store.flush()
    store.write_array("g", [1, 1], np.full((2, 2), 5, "float32"))
    store.flush()
    want = np.zeros((4, 4))
    want[1:3, 1:3] = 5
    assert np.array_equal(store.read_array("g"), want)
    assert store.num_layers() == 3


def test_scalar_and_strings(store):
    for name, kind, fill, value in (("ratio", "float32", None, 0.375), ("blank", "int16", Fill("Int", -31), None), ("title", "string", None, "Übergröße"), ("raw", "binary", None, b"\x00\xff")):
        store.define_array(name, kind, [], fill=fill)
        if value is not None:
            store.write_array(name, [], np.array(value, dtype="float32" if kind == "float32" else object))
    store.flush()
    assert [store.read_array(n)[()] for n in ("ratio", "blank", "title", "raw")] == [0.375, -31, "Übergröße", b"\x00\xff"]


def entry_of(values, marker, written):
    """What the statistics of one array must say."""
    held = [int(v) for v, w in zip(values.tolist(), written.tolist()) if w and v != marker]
    return {"kind": "Int", "min": min(held, default=None), "max": max(held, default=None), "null_count": values.size - len(held), "row_count": values.size}


def test_stats_life_cycle(store):
    rng = np.random.default_rng(12)
    store.define_array("depth", "int32", [14], [5], fill=Fill("Int", 3))
    model, written = np.full(14, 3), np.zeros(14, bool)
    assert store.array_stats("depth") is None
    for at, size in ((5, 5), (0, 4), (10, 4), (2, 9)):
        values = rng.integers(0, 6, size)
        store.write_array("depth", [at], values)
        model[at : at + size], written[at // 5 * 5 : -(-(at + size) // 5) * 5] = values, True
        store.flush()
        assert store.array_stats("depth") == entry_of(model, 3, written)
    store.compact()
    assert store.array_stats("depth") == entry_of(model, 3, written)
    store.delete("depth")
    assert store.array_stats("depth") is None


def test_stats_are_by_array(spark):
    """Random fills, of several kinds or none, over arrays of one type: a marker counts for its own array only."""
    rng = np.random.default_rng(5)
    for trial in range(2):
        store, model = ArrayStore.in_memory(spark), {}
        for k in range(6):
            fill = [None, Fill("Int", int(rng.integers(0, 4))), Fill("Float", 2.0)][k % 3]
            store.define_array(f"a{k}", "int32", [10], [4], fill=fill)
            model[f"a{k}"] = (np.full(10, 0 if fill is None else int(fill.value)), np.zeros(10, bool), fill.value if fill and fill.kind == "Int" else None)
        if trial:  # all in one part
            rows = [(name, i, int(rng.integers(0, 4))) for name in model for i in range(8)]
            store.write_many(spark.createDataFrame(rows, "name string, pos bigint, v int"), "name", "pos", "v")
            for name, i, v in rows:
                model[name][0][i], model[name][1][i] = v, True
        else:
            for name, (values, written, _) in model.items():
                values[2:7] = rng.integers(0, 4, 5)
                written[:8] = True
                store.write_array(name, [2], values[2:7])
        store.flush()
        for step in range(2):
            for name, (values, written, marker) in model.items():
                assert store.array_stats(name) == entry_of(values, marker, written), (trial, step, name)
            store.compact()


def test_stats_kinds(store):
    store.define_array("t", "timestamp_ns", [5], fill=Fill("TimestampNs", 10**9))
    store.write_array("t", [0], np.array([0, 10**9, 2 * 10**9, -500, 10**9]))
    store.define_array("s", "string", [4], fill=Fill("String", ""))
    store.write_array("s", [0], ["b", "", "a", ""])
    store.define_array("u", "uint64", [2])
    store.write_array("u", [0], np.array([0, 2**64 - 1], dtype="uint64"))
    store.define_array("b", "binary", [2])
    store.write_array("b", [0], np.array([b"\x80", b"\x7f"], dtype=object))
    store.flush()
    pick = lambda n: tuple(store.array_stats(n)[k] for k in ("min", "max", "null_count", "row_count"))
    assert pick("t") == (-500, 2 * 10**9, 2, 5)
    assert pick("s") == (b"a", b"b", 2, 4)
    assert pick("u") == (0, 2**64 - 1, 0, 2)
    assert pick("b") == (b"\x7f", b"\x80", 0, 2)
    assert store.read_array("u").tolist() == [0, 2**64 - 1]


def test_delete_redefine_and_reopen(spark, store):
    store.define_array("x", "int32", [4], [2])
    store.write_array("x", [0], np.arange(4))
    store.set_attribute("x", "units", "m")
    store.flush()
    store.delete("x")
    store.define_array("x", "int32", [4], [2], fill=Fill("Int", 7))
    store.flush()
    again = ArrayStore.open(spark, store.root)
    assert again.read_array("x").tolist() == [7, 7, 7, 7] and again.get_attribute("x", "units") is None
    with pytest.raises(CommitConflict):
        again.define_array("y", "int8", [1])
        store.define_array("z", "int8", [1])
        store.flush()
        again.flush()


def test_attributes(store):
    store.define_array("a", "int8", [1])
    store.define_array("b", "int8", [1])
    store.set_attribute("a", "tags", Attr("StringList", ["x", "y"]))
    store.set_attribute("a", "sum", Attr("Binary", b"\xde\xad"))
    store.flush()
    store.set_attribute("a", "tags", Attr("Float64List", [0.1, float("nan")]))
    store.flush()
    store.compact()
    assert store.get_attribute("a", "tags") == Attr("Float64List", [0.1, float("nan")])
    assert store.get_attribute("a", "sum") == Attr("Binary", b"\xde\xad")
    assert {r["name"]: r["value"] is None for r in store.attribute_index("tags").collect()} == {"a": False, "b": True}
    assert Attr("Float64", 0.0) != Attr("Float64", -0.0) and Attr("Int32List", [1]) != Attr("Int64List", [1])
    with pytest.raises(ArrayNotFound):
        store.set_attribute("no", "k", 1)


def test_errors(spark, store):
    store.define_array("a", "int32", [4], [2])
    with pytest.raises(ArrayAlreadyExists):
        store.define_array("a", "int8", [1])
    with pytest.raises(StoreFormatError):
        store.write_array("a", [3], np.arange(2))
    with pytest.raises(StoreFormatError):
        store.write_array("a", [0, 0], np.zeros((1, 1), "int32"))
    with pytest.raises(DTypeMismatch):
        store.write_array("a", [0], np.array([0.5]))
    with pytest.raises(DTypeMismatch):
        store.read_array("a", dtype="int8")
    with pytest.raises(StoreError):
        store.define_array("n", "bool", [1])
    with pytest.raises(StoreFormatError):
        store.define_array("n", "int8", [4], [2, 2])
    with pytest.raises(CodecError):
        ArrayStore.open(spark, store.root, codec="brotli9")
    with pytest.raises(Exception, match="repeated coordinates"):
        store.write_cells("a", spark.createDataFrame([(0, 1), (0, 2)], "d0 bigint, v int"))
    store.define_array("empty", "int32", [0, 3])
    store.write_array("empty", [0, 0], np.zeros((0, 3), "int32"))
    assert store.read_array("empty").shape == (0, 3) and store.read_cells("empty").count() == 0


def test_clamped_and_default_reads(store):
    store.define_array("a", "int16", [5], [2])
    store.write_array("a", [0], np.arange(5))
    assert store.read_array("a", [3], [9]).tolist() == [3, 4]
    assert store.read_array("a", [9], [9]).tolist() == []
    assert store.read_array("a", [1, 1], [2]).tolist() == [0, 1]


def test_reads_do_not_shuffle_values(spark, store):
    """Two layers, unwritten chunks, joins by broadcast off but for counted sides: no exchange between the scan of the values and their use."""
    store.define_array("q", "int32", [400], [10], fill=Fill("Int", 5))
    cells = spark.range(400).selectExpr("id as d0", "cast(id as int) as v")
    store.write_cells("q", cells.filter("d0 < 200"))
    store.flush()
    store.write_cells("q", cells.filter("d0 between 95 and 104").selectExpr("d0", "-v as v"))
    store.flush()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.read_cells("q")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["d0"]: r["v"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: (-i if 95 <= i <= 104 else i) if i < 200 else 5 for i in range(400)}
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines = plan.split("\n")
    for k, line in enumerate(lines):
        if "FileScan" in line and "vals" in line:
            level, above = depth(line), []
            for x in reversed(lines[:k]):
                if depth(x) < level:
                    level = depth(x)
                    above.append(x)
            assert not any("Exchange" in x for x in above), plan


def test_write_cells_sees_one_evaluation(spark, store):
    store.define_array("r", "float64", [40, 6], [7, 4], fill=Fill("Float", -1.0))
    store.write_cells("r", spark.range(200).selectExpr("id div 5 as d0", "id % 5 as d1", "rand() as v"))
    got = store.read_array("r")
    assert (got[:, :5] >= 0).all() and (got[:, 5] == -1).all()
    for bad in ("d0 = 40", "d0 = -1", "d0 = null"):
        value = bad.split(" = ")[1]
        with pytest.raises(StoreFormatError):
            store.write_cells("r", spark.sql(f"select cast({value} as bigint) as d0, 0L as d1, 1.0D as v"))
    store.write_cells("r", spark.range(0).selectExpr("id as d0", "id as d1", "0.0D as v"))
    assert np.array_equal(store.read_array("r"), got)


def test_write_cells_reads_only_what_it_patches(spark, store, monkeypatch):
    """Covered chunks ask for no old values, others for their own alone."""
    store.define_array("w", "int32", [1000], [10], fill=Fill("Int", -1))
    model, asked, newest = np.full(1000, -1), [], ArrayStore._newest
    monkeypatch.setattr(ArrayStore, "_newest", lambda self, dtype, ids, where="true", *more, **named: asked.append(where) or newest(self, dtype, ids, where, *more, **named))
    for low, high, want in ((0, 499, []), (505, 507, [50]), (205, 394, [20, 39])):
        store.write_cells("w", spark.range(low, high + 1).selectExpr("id as d0", f"cast(id + {low} as int) as v"))
        model[low : high + 1] = np.arange(low, high + 1) + low
        assert len(asked) == bool(want) and sorted(int(x) for w in asked for x in w.split("(")[1].replace("L", "").rstrip(")").split(",")) == want
        asked.clear()
    assert store.read_array("w").tolist() == model.tolist()


def test_offsets(spark):
    from tessera.functions import offsets

    values = [None if i % 7 == 3 else "é" * (i % 4) for i in range(700)]
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, v string")
    at, want = 0, []
    for i, v in enumerate(values):
        want.append((i, at))
        at += len((v or "").encode())
    for segment in (4, 64, 4096):
        assert sorted((r["k"], r["off"]) for r in offsets.running_offsets(df, "k", "v", segment).collect()) == want
    coded = offsets.encode_blocks(df.withColumn("b", F.expr("k div 100")), "b", "k", "v")
    for r in coded.select("keys", "encoded", offsets.decode_array(F.col("encoded")).alias("d")).collect():
        mine = [(values[k] or "").encode() for k in r["keys"]]
        assert [bytes(x) for x in r["d"]] == mine and bytes(r["encoded"]["payload"]) == b"".join(mine)
        assert r["encoded"]["offsets"] == np.cumsum([0, *map(len, mine)]).tolist()


def test_codecs_in_footers_and_damaged_manifests(spark, tmp_path):
    import pyarrow.parquet as pq

    from tessera.store import register_codec

    register_codec("quick", "snappy")
    for name, want in (("none", "UNCOMPRESSED"), ("zstd", "ZSTD"), ("lz4", "LZ4"), ("quick", "SNAPPY")):
        root = str(tmp_path / name)
        s = ArrayStore.create(spark, root, codec=name, codec_level=5 if name == "zstd" else None)
        s.define_array("x", "int32", [100], [10])
        s.write_array("x", [0], np.arange(100))
        s.flush()
        files = glob.glob(f"{root}/gen=0/data/**/*.parquet", recursive=True)
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {want}
        assert ArrayStore.open(spark, root).read_array("x").tolist() == list(range(100))
    manifest = max(p for p in glob.glob(f"{root}/manifests/*") if not p.endswith(".crc"))
    text = open(manifest).read()
    state = json.loads(text)
    for broken in (text[: len(text) // 2], "{}", json.dumps(state | {"format": "other"}), json.dumps(state | {"version": 99})):
        for p in glob.glob(f"{root}/manifests/.*.crc"):
            os.remove(p)
        with open(manifest, "w") as f:
            f.write(broken)
        with pytest.raises(StoreFormatError):
            ArrayStore.open(spark, root)


def test_many_arrays_with_fill(store):
    rng, shapes = np.random.default_rng(1), {"p": ([5, 7], [2, 3]), "q": ([], []), "r": ([9], [4]), "s": ([0, 3], [1, 1])}
    for k, (name, (shape, chunk)) in enumerate(shapes.items()):
        store.define_array(name, "int32", shape, chunk, fill=Fill("Int", -k - 1))
    for name in shapes:  # nothing is written yet
        assert sum(len(r["vals"]) for r in store.read_many([name], fill=True).collect()) == store.read_array(name).size
    store.write_array("p", [1, 2], rng.integers(0, 9, (2, 2)))
    store.write_array("r", [8], np.array([3]))
    store.flush()
    found = {}
    for r in store.read_many(list(shapes), fill=True).collect():
        assert (r["name"], r["chunk_ord"]) not in found
        found[r["name"], r["chunk_ord"]] = r["vals"]
    for name in shapes:
        assert sorted(v for (n, _), vals in found.items() if n == name for v in vals) == sorted(store.read_array(name).reshape(-1).tolist())
    assert {r["name"] for r in store.read_many().collect()} == {"p", "r"}


def test_arrays_defined_at_once(spark, tmp_path):
    """A bulk's arrays are no part of the manifest, but read, written, deleted and measured as any others."""
    root = str(tmp_path / "s")
    s = ArrayStore.create(spark, root)
    s.define_array("own", "int32", [3], [2], fill=Fill("Int", 5))
    s.define_many(spark.range(300).selectExpr("format_string('n%03d', id) as name", "id % 6 as length"), "int32", chunk=2, fill=Fill("Int", 1))
    model = {f"n{k:03d}": np.full(k % 6, 1) for k in range(300)}
    assert s.list_arrays().count() == 301 and s.read_array("n005").tolist() == [1] * 5
    rows = [(n, i, (i * 3 + int(n[1:])) % 4) for n in model if int(n[1:]) % 7 for i in range(len(model[n]))] + [("own", 0, 5), ("own", 1, 1)]
    s.write_many(spark.createDataFrame(rows, "name string, pos bigint, v int"), "name", "pos", "v")
    for n, i, v in rows[:-2]:
        model[n][i] = v
    s.flush()
    text = open(max(p for p in glob.glob(f"{root}/manifests/*") if not p.endswith(".crc"))).read()
    assert "n005" not in text and len(text) < 2000
    for bad, error in (([("n005", 1)], ArrayAlreadyExists), ([("own", 1)], ArrayAlreadyExists), ([("x", 1), ("x", 2)], ArrayAlreadyExists), ([("x", -1)], StoreFormatError), ([(None, 1)], StoreFormatError)):
        with pytest.raises(error):
            s.define_many(spark.createDataFrame(bad, "name string, length bigint"), "int32")
    with pytest.raises(ArrayAlreadyExists):
        s.define_array("n005", "int8", [1])
    with pytest.raises(ArrayNotFound):
        s.write_many(spark.createDataFrame([("none", 0, 1)], "name string, pos bigint, v int"), "name", "pos", "v")
    s.delete("n010")
    s.set_attribute("n011", "units", "m")
    s.write_array("n017", [3], np.array([8, 9]))
    s.flush()
    del model["n010"]
    model["n017"][3:] = 8, 9
    for step in range(2):
        s = ArrayStore.open(spark, root)
        found = {n: {} for n in model}
        for r in s.read_many(list(model) if step else None, fill=True).collect():
            if r["name"] != "own":
                found[r["name"]][r["chunk_ord"]] = r["vals"]
        assert {n: [v for k in sorted(x) for v in x[k]] for n, x in found.items()} == {n: x.tolist() for n, x in model.items()}
        entries = {r["name"]: r for r in s.stats().collect()}
        for n, x in model.items():
            held = [v for v in x.tolist() if v != 1]
            if step or (int(n[1:]) % 7 and len(x)):
                assert (entries[n]["min_i"], entries[n]["max_i"], entries[n]["null_count"], entries[n]["row_count"]) == (min(held, default=None), max(held, default=None), len(x) - len(held), len(x)), n
            else:
                assert n not in entries
        assert s.array_stats("n017")["max"] == 9 and s.array_stats("n016") == {"kind": "Int", "min": 0, "max": 3, "null_count": model["n016"].tolist().count(1), "row_count": 4}
        assert s.array_stats("own") == {"kind": "Int", "min": 1, "max": 1, "null_count": 2, "row_count": 3}
        assert {r["name"] for r in s.attribute_index("units").filter("value is not null").collect()} == {"n011"}
        with pytest.raises(ArrayNotFound):
            s.read_array("n010")
        s.compact()


def test_type_tables():
    t = DTYPES
    assert read_fill(t["int8"], Fill("Int", 300)) == 44 and read_fill(t["uint8"], Fill("Int", -1)) == 255
    assert read_fill(t["int32"], Fill("Float", 1e20)) == 2**31 - 1 and read_fill(t["int32"], Fill("Float", float("nan"))) == 0
    assert read_fill(t["int32"], Fill("Bool", True)) == 0 and read_fill(t["uint16"], Fill("Bool", True)) == 1
    assert read_fill(t["string"], Fill("String", "x")) == "" and stat_fill(t["string"], Fill("String", "x")) == "x"
    assert stat_fill(t["int32"], Fill("Float", 1.0)) is None and stat_fill(t["timestamp_ns"], Fill("Int", 7)) == 7
    assert fixed_size_list_size(fixed_size_list_size(4, 3), 2) == 24 and fixed_size_list_size(None, 3) is None


def test_random_against_a_model(spark):
    """Random writes, deletes, flushes and compactions against plain arrays."""
    rng, store, model = np.random.default_rng(7), ArrayStore.in_memory(spark, codec="none"), {}
    for step in range(24):
        name = f"n{rng.integers(0, 2)}"
        if name not in model:
            shape = rng.integers(1, 6, rng.integers(0, 4)).tolist()
            store.define_array(name, "int64", shape, [int(rng.integers(1, s + 1)) for s in shape], fill=Fill("Int", -step))
            model[name] = np.full(shape, -step, dtype="int64")
        if rng.random() < 0.08:
            store.delete(name)
            del model[name]
            continue
        a = [int(rng.integers(0, s)) for s in model[name].shape]
        n = [int(rng.integers(1, s - x + 1)) for s, x in zip(model[name].shape, a, strict=True)]
        v = rng.integers(0, 99, n)
        store.write_array(name, a, v)
        model[name][tuple(slice(x, x + y) for x, y in zip(a, n, strict=True))] = v
        if rng.random() < 0.3:
            store.flush()
        if rng.random() < 0.1:
            store.compact()
    store.compact()
    again = ArrayStore.open(spark, store.root)
    assert {r["name"] for r in again.list_arrays().collect()} == set(model)
    for name, want in model.items():
        assert np.array_equal(again.read_array(name), want)
        assert again.array_stats(name)["row_count"] == want.size


def test_stream_ingest(spark, store, tmp_path):
    from tessera.streaming.ingest import ingest

    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id as d0", "cast(id * 2 as int) as v").write.parquet(src)
    store.define_array("s", "int32", [12], [4])
    ingest(spark.readStream.schema("d0 bigint, v int").parquet(src), store, "s", str(tmp_path / "ck")).awaitTermination()
    assert store.read_array("s").tolist() == [*range(0, 20, 2), 0, 0]


def test_region_filter_reaches_parquet(store):
    store.define_array("p", "int32", [1000], [10])
    store.write_array("p", [0], np.arange(1000))
    store.flush()
    plan = store.read_cells("p", [200], [20])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(chunk_ord, [20,21])" in plan.replace("20, 21", "20,21")
    assert store.read_cells("p", [200], [20]).agg(F.sum("v")).first()[0] == sum(range(200, 220))

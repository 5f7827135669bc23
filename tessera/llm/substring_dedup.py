"""Operator 10: removal of passages that an earlier document holds, with a count-min prefilter.

A passage is a window of 50 words.  Counting every window would shuffle one
row a word, so a first pass only takes anchors: the smallest hash among the
25-word runs of a window, the same for equal windows.  The distinct anchors of
each document are written, counted, and dealt by hash to as many shards as
keep the load of a shard's count-min sketch low, however large the input.  A
sketch overestimates in how many documents an anchor is, and so in how many a
window is; the anchors that may be in two go into the shard's part of a
filter.  A second pass groups exactly the windows whose anchor is in the
filter.  No repeated window is lost; a filter that is too full only lets more
windows through.

Texts that repeat as a whole are told by their hashes first: only the first of
them counts and is grouped, and the later ones go whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_i64, batch, bounded, mix, rolling, saved, slices, unused, word_hashes

WINDOW = 50
RUN = 25
DEPTH = 3
#: log2 of counters in a row of a shard's sketch: from the number of anchors, between these bounds.  There are shards enough for LOAD counters an anchor.
WIDTH_BITS = (12, 20)
LOAD = 4
#: Bytes of the filter that a pass over the texts holds; beyond that (some 30 GB of input) there are more passes, each for a range of shards.
FILTER_BYTES = 64 << 20
#: Anchors that a task holds before it writes them.
HELD = 1 << 18
#: Marked documents up to which the marks are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes up to which the ranges that go are broadcast.
BROADCAST_BYTES = 48 << 20
#: The mark of a text that repeats as a whole.
WHOLE = bytearray(b"*")
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """Anchor of each window, as a hash that is uniform (minima are not)."""
    run = min(RUN, window)
    return mix(sliding_min(rolling(words, run, BASES[0]), window - run + 1) ^ np.uint64(BASES[1]))


def shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (((anchor >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def cells(anchor: np.ndarray, bits: int, first: int = 0) -> list[np.ndarray]:
    """Place of an anchor in each of DEPTH rows of a sketch, or with hashes of its own in a filter."""
    return [(mix(anchor + np.uint64(first + r + 1)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(DEPTH)]


def sketch(docs: DataFrame, window: int) -> tuple[DataFrame, int, int]:
    """(k, f), the filter of each shard k that has anchors, as a table; the number of shards; log2 of the bits of a filter.

    A filter holds the anchors that are in two documents or more by the
    shard's count-min sketch.
    """

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            # documents count one by one, and beyond two they all count as two
            x, n = np.unique(np.concatenate(held), return_counts=True)
            x = np.concatenate([x, x[n > 1]])
            return pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "a": pa.array([x.tobytes()], pa.binary())})

        for b in slices(batches):
            for text in b.column(0).cast(pa.binary()).to_pylist():
                words = word_hashes(text or b"")
                if len(words) >= window:
                    held.append(np.unique(anchors(words, window)))
            if sum(map(len, held)) >= HELD:
                yield packed()
                held.clear()
        if held:
            yield packed()

    own = saved(docs.select("text").transform(bounded).mapInArrow(distinct, "n bigint, a binary"), "anchors")
    total = own.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total * LOAD / (1 << WIDTH_BITS[1])))
    bits = min(WIDTH_BITS[1], max(WIDTH_BITS[0], math.ceil(math.log2(max(2, total * LOAD / shards)))))
    filter_bits = max(3, bits - 2)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in b.column(0).to_pylist():
                x = np.sort(np.frombuffer(a, np.uint64))
                k = shard(x, shards)
                cuts = np.flatnonzero(np.diff(k)) + 1
                parts = np.split(x, cuts)
                yield pa.RecordBatch.from_pydict({"k": pa.array(k[np.append(0, cuts)], pa.int64()), "a": pa.array([p.tobytes() for p in parts], pa.binary())})

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.frombuffer(a, np.uint64) for b in batches for a in b.column(b.schema.get_field_index("a")).to_pylist()])
        many = np.minimum.reduce([np.bincount(at, minlength=1 << bits)[at] for at in cells(x, bits)]) >= 2
        f = np.zeros(1 << filter_bits, bool)
        for at in cells(x[many], filter_bits, DEPTH):
            f[at] = True
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int64()), "f": pa.array([np.packbits(f, bitorder="little").tobytes()], pa.binary())})

    dealt = own.select("a").transform(bounded).mapInArrow(deal, "k bigint, a binary")
    return saved(dealt.groupBy("k").applyInArrow(count, "k bigint, f binary"), "filters"), shards, filter_bits


WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("pos", pa.int32())])


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, t) of the rows whose whole text also is that of a smaller doc_id, as a table."""
    keyed = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"))
    first = keyed.groupBy("t", "u").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("t", "u", "first")
    return saved(keyed.join(small(saved(first, "first")), ["t", "u"]).filter("doc_id > first").select("doc_id", "t").distinct(), "copies")


def small(df: DataFrame) -> DataFrame:
    """A table of narrow rows, to be broadcast if it has BROADCAST_ROWS at most, else to be joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, t, pos) of the windows of (doc_id, t, text) that may be in two documents."""
    filters, shards, bits = sketch(docs, window)
    size = 1 << (bits - 3)
    step = max(1, FILTER_BYTES // size)

    def passing(low: int) -> DataFrame:
        """The windows of which the anchor is in one of the shards from `low` on that a pass holds."""
        high = min(shards, low + step)
        held = np.zeros((high - low) * size, np.uint8)
        for r in filters.filter(F.col("k").between(low, high - 1)).toLocalIterator():
            at = (r["k"] - low) * size
            held[at : at + size] = np.frombuffer(bytes(r["f"]), np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in slices(batches):
                out: list[tuple] = []
                for key, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                    h = word_hashes(text)
                    if len(h) < window:
                        continue
                    distinct, at = np.unique(anchors(h, window), return_inverse=True)
                    k = shard(distinct, shards)
                    many = (k >= low) & (k < high)
                    base = np.where(many, k - low, 0) << bits
                    for c in cells(distinct, bits, DEPTH):
                        c += base
                        many &= own[c >> 3] >> (c & 7).astype(np.uint8) & 1 > 0
                    pos = np.flatnonzero(many[at])
                    if len(pos):
                        out.append((rolling(h, window, BASES[0])[pos], rolling(mix(h), window, BASES[1])[pos], np.full(len(pos), key, np.int64), np.full(len(pos), t, np.int64), pos.astype(np.int32)))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out)]
                    yield batch(WINDOWS, [as_i64(cols[0]), as_i64(cols[1]), *map(pa.array, cols[2:])])

        return docs.transform(bounded).mapInArrow(candidates, "h1 bigint, h2 bigint, doc_id bigint, t bigint, pos int")

    return reduce(DataFrame.unionByName, [passing(low) for low in range(0, shards, step)])


def repeated(docs: DataFrame, later: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, pos): the windows that also start in a document with a smaller doc_id, of all rows but the `later` copies.

    t tells rows with one doc_id apart.
    """
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), "text").join(small(later), ["doc_id", "t"], "left_anti")
    found = saved(windows(keyed, window), "windows")
    # the first document of a window: sums in each task first, so a passage in very many documents is no hot spot
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h1", "h2", "first")
    # as a table, so that AQE can split the rows of a hot window
    return found.join(small(saved(first, "first")), ["h1", "h2"]).filter("doc_id > first").select("doc_id", "t", "pos")


RANGES = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("gone", pa.binary())])


def _marked(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """The documents and the name of a column with the ranges of words that go (pairs of 32-bit starts and ends), null where all stay."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for starts in b.column(2):
                at = np.sort(starts.values.to_numpy(zero_copy_only=False))
                new = np.append(True, at[1:] > at[:-1] + window)
                out.append(np.stack([at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + window], axis=1).astype("<i4").tobytes())
            yield batch(RANGES, [b.column(0), b.column(1), out])

    later = copies(docs)
    starts = repeated(docs, later, window).groupBy("doc_id", "t").agg(F.collect_list("pos").alias("p"))
    ranges = starts.transform(bounded).mapInArrow(merge, "doc_id bigint, t bigint, gone binary")
    whole = later.select("doc_id", "t", F.lit(WHOLE).alias("gone"))
    own = unused(docs.columns)
    marks = saved(ranges.unionByName(whole), "ranges")
    size = marks.agg(F.sum(F.octet_length("gone") + 24)).first()[0] or 0  # ranges grow with the texts
    marks = marks.withColumnsRenamed({c: own + c for c in marks.columns})
    marks = F.broadcast(marks) if size <= BROADCAST_BYTES else marks
    return docs.join(marks, (F.col("doc_id") == F.col(own + "doc_id")) & (F.xxhash64("text") == F.col(own + "t")), "left").drop(own + "doc_id", own + "t"), own + "gone"


def _gone(n: int, ranges: bytes, window: int) -> np.ndarray:
    """Which of n words go; a copy of a whole text goes if it has a window."""
    out = np.zeros(n, bool)
    if ranges == bytes(WHOLE):
        out[:] = n >= window
    else:
        for a, b in np.frombuffer(ranges, "<i4").reshape(-1, 2).tolist():
            out[a:b] = True
    return out


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A null or empty text has no words.  Rows with one doc_id never remove
    from each other; a row with a null doc_id is kept whole and removes
    nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for key, text, ranges in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = (text or b"").split()
                removed = 0
                n = len(words)
                if ranges is not None:
                    gone = _gone(n, ranges, window)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((key, n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield batch(DIGESTS, [list(c) for c in zip(*rows)])

    joined, gone = _marked(docs, window)
    return joined.select("doc_id", "text", gone).transform(bounded).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, without the passages; what stays keeps its white space.

    n_chars, where there is such a column, follows the text.  Documents of
    which nothing is left go; documents that were empty before stay.
    """
    columns = [f"`{c}`" for c in docs.columns]

    @F.pandas_udf("string")
    def cut(texts, marks):
        def one(text, at):
            if at is None or text is None:
                return text
            raw = text.encode()
            spans = [m.span() for m in WORD.finditer(raw)]
            gone = _gone(len(spans), bytes(at), window).tolist()
            kept, last = [], 0
            for (a, b), g in zip(spans, gone):
                if g:
                    kept.append(raw[last:a])
                    last = b
            kept.append(raw[last:])
            out = b"".join(kept)
            return out.decode() if out.strip() else None

        return type(texts)([one(t, s) for t, s in zip(texts, marks)], index=texts.index, dtype=object)

    joined, ranges = _marked(docs, window)
    touched = F.col(ranges).isNotNull()
    # only the documents with repeated windows go through Python
    out = joined.filter(~touched).select(*columns).unionByName(joined.filter(touched).withColumn("text", cut("text", ranges)).filter(F.col("text").isNotNull()).select(*columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

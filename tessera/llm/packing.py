"""Operator 5: packing token sequences by best-fit decreasing.

Documents longer than a sequence are first cut into full windows; what is left
over, one piece a document, is dealt by hash to groups of bounded size, and
each group packs its pieces by decreasing length, each into the open window
whose remaining capacity is the tightest.  A segment tree over capacities
finds it in O(log sequence length).  A window whose fill is a power of two
ends there; any other is padded to the sequence length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded, saved, slices
from tessera.llm.tokens import DEFAULT_VOCABULARY, encoder, runs

#: Pieces in a packing group: padding is at most a few windows a group, memory a few megabytes.
GROUP = 100_000
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is at least a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window that holds the length, removed from the tree."""
        count, i = self.count, length + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length; lengths come in decreasing order, none over the capacity."""
    tree, windows, out = CapacityTree(capacity), 0, []
    for n in lengths:
        found = tree.take(n)
        left, window = found if found else (capacity, windows)
        windows += found is None
        out.append((window, capacity - left))
        if left > n:
            tree.add(left - n, window)
    return out


def pieces(docs: DataFrame, size: int = 4096, end_id: int = 2, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Full windows and the rest of every document's ids, each with its checksum; a null text is the end id alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in slices(batches):
            ids, cuts = enc.encode(b.column(1))
            flat = memoryview(np.insert(ids, cuts[1:], end_id).astype("<u4")).cast("B")
            tokens = np.diff(cuts) + 1
            count = -(-tokens // size)
            doc = np.repeat(np.arange(len(tokens)), count)
            start = runs(np.zeros(len(tokens), np.int64), count) * size
            length, at = np.minimum(size, tokens[doc] - start), (cuts[:-1] + np.arange(len(tokens)))[doc] + start
            crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist())]
            yield batch(PIECES, [b.column(0).take(pa.array(doc)), start, length, crc, tokens[doc]])

    return docs.select("doc_id", "text").transform(bounded).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, size: int = 4096, vocabulary: str = DEFAULT_VOCABULARY, group: int = GROUP) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence.

    Each id of each document is in exactly one piece; a sequence is filled
    from offset 0 without gaps.  Repeated rows are packed each by itself; a
    null doc_id is kept.  An empty table gives no rows.
    """
    cut = saved(pieces(docs, size, vocabulary=vocabulary), "pieces")
    groups = max(1, -(-cut.count() // group))

    def run(table: pa.Table) -> pa.Table:
        number = table.column("g")[0].as_py()
        table = table.drop_columns(["g"]).combine_chunks()
        cols = [table.column(n).to_pylist() for n in PIECES.names]
        length = cols[2]
        order = sorted(range(len(length)), key=lambda i: (-length[i], cols[0][i] is not None, cols[0][i], cols[1][i], cols[3][i]))
        placed = best_fit_decreasing([length[i] for i in order], size)
        by = table.take(pa.array(order))
        columns = [*by.columns, pa.array([(number << 32) + w for w, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
        return pa.Table.from_arrays(columns, schema=PACKED)

    # by row of the table, not by value: repeated rows are dealt apart
    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint")

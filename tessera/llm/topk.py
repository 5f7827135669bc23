"""Operator 9: exact top-k search by columnar branch and bound.

Vectors are held in columns, one for each dimension.  For a query, inner
products are accumulated block of dimensions by block; what the dimensions to
come can still add is at most the product of the remaining norms, so
candidates whose best case is below the k-th worst case are dropped and the
rest compacted, and only survivors see the last block.

Queries and candidates are dealt to blocks; every pair of blocks is one task
of bounded size, and keeps k rows a query, so that merging is small.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded, saved

CANDIDATES = 8192
QUERIES = 1024
BLOCK = 16
SCALE = 64
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(query: np.ndarray, columns: np.ndarray, mass: np.ndarray, ids: np.ndarray, k: int, skip: int | None, block: int = BLOCK) -> list[tuple[int, int]]:
    """(vec_id, score) of the k largest inner products, ties to the smaller id.

    columns: dimensions by candidates; mass[b]: each candidate's norm over the
    dimensions from block b on.
    """
    own = np.sqrt(np.cumsum((query.astype(np.float64) ** 2)[::-1])[::-1])
    alive = np.arange(len(ids)) if skip is None else np.flatnonzero(ids != skip)
    part = np.zeros(len(alive), columns.dtype)
    for b in range(0, len(query), block):
        rows = columns[b : b + block]
        part = part + query[b : b + block] @ (rows if len(alive) == rows.shape[1] else rows[:, alive])
        left = b + block
        if left < len(query) and len(alive) > k:
            slack = own[left] * mass[left // block][alive] * (1 + 1e-9) + 1
            bar = np.partition(part - slack, len(alive) - k)[len(alive) - k]
            keep = part + slack >= bar
            alive, part = alive[keep], part[keep]
    order = np.lexsort((ids[alive], -part))[:k]
    return [(int(ids[alive[i]]), int(part[i])) for i in order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components as little-endian doubles; null vectors and those with null or non-finite components go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key is None or v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    ids.append(key)
                    rows.append(x.astype("<f8").tobytes())
            yield batch(pa.schema([("vec_id", pa.int64()), ("v", pa.binary())]), [ids, rows])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").transform(bounded).mapInArrow(run, "vec_id bigint, v binary")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width))
    for row, p in zip(out, packed):
        row[: len(p) // 8] = np.frombuffer(p, "<f8")
    return out


def _large(xs: np.ndarray, qs: np.ndarray, ids: np.ndarray, keys: list[int], k: int) -> list[tuple[int, int, int]]:
    """As top_k() for all queries of a block whose scores may not fit 64 bits: exact integers, cut to 64 bits at the end, no pruning."""
    whole = lambda m: [[math.floor(Fraction(v) * SCALE) for v in row] for row in m.tolist()]
    rows, out = whole(xs), []
    for key, q in zip(keys, whole(qs)):
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(map(mul, q, row)))), i) for i, row in zip(ids.tolist(), rows) if i != key]
        out += [(key, i, -s) for s, i in heapq.nsmallest(k, scores)]
    return out


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for each vector whose id is divisible by `every`, against all others.

    Fewer than k candidates give fewer rows.  Vectors of unequal length are
    filled up with zeros.  Rows that repeat a vec_id are candidates each by
    itself, none of them for a query with that id; the query is one of them.
    A score beyond 64 bits is cut to the largest or smallest 64-bit number.
    """
    all_rows = saved(usable(vectors), "vectors")
    queries = all_rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_c = max(1, -(-all_rows.count() // CANDIDATES))
    n_q = max(1, -(-queries.count() // QUERIES))
    # by row, not by value: repeated rows are dealt apart
    h = F.xxhash64(F.monotonically_increasing_id())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = all_rows.withColumn("c", F.pmod(h, F.lit(n_c)).cast("int")).withColumn("q", each(n_q))
    ask = queries.withColumn("q", F.pmod(h, F.lit(n_q)).cast("int")).withColumn("c", each(n_c))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        x, q = left.column("v").to_pylist(), right.column("v").to_pylist()
        width = max(map(len, [*x, *q])) // 8
        xs, qs, ids = _matrix(x, width), _matrix(q, width), left.column("vec_id").to_numpy()
        keys = right.column("vec_id").to_pylist()
        largest = (SCALE * float(np.abs(xs).max(initial=1)) + 1) * (SCALE * float(np.abs(qs).max(initial=1)) + 1) * max(1, width)
        if not largest < 2**62:
            rows = _large(xs, qs, ids, keys, k)
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], schema=FOUND)
        xs, qs = np.floor(SCALE * xs), np.floor(SCALE * qs)
        spread = np.argsort(-(xs.astype(np.float64) ** 2).sum(0), kind="stable")  # heavy dimensions first
        kind = np.float64 if largest < 2**52 else np.int64  # sums of integers are exact in doubles up to 2^53
        columns = np.ascontiguousarray(xs[:, spread].T.astype(kind))
        square = np.cumsum((xs[:, spread].T.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        mass = [np.sqrt(square[b]) for b in range(0, width, BLOCK)]
        rows = [(key, v, s) for key, vec in zip(keys, qs[:, spread].astype(kind)) for v, s in top_k(vec, columns, mass, ids, k, key)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], schema=FOUND)

    local = cand.groupBy("c", "q").cogroup(ask.groupBy("c", "q")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH g AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM g),
v AS (SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

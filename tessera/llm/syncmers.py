"""Operator 8: document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest of its inner s-mers
is the first or the last one: a choice that looks at nothing outside the
k-mer, so an edit moves no anchor elsewhere.  A fingerprint keeps the anchors
with the smallest hashes and their places, a fixed share of all and some more
of a short text; two fingerprints are as alike as the share of their joint
anchors that both have in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded, mix, partitions, rolling, slices
from tessera.llm.substring_dedup import sliding_min

K = 16
S = 8
#: Anchors in a fingerprint: those with hashes up to SHARE, a sixteenth of all, so their number grows with the text, and the smallest KEEP at least.
KEEP = 64
SHARE = (1 << 60) - 1
#: Bytes of text in a range of documents.
RANGE_BYTES = 64 << 20
BASE = 0xA0761D6478BD642F
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
Anchors = tuple[list[int], list[int]]


def anchors(text: str) -> Anchors:
    """(hashes ascending, places) of the kept anchors; a text without syncmers is one anchor, an empty one none."""
    if not text:
        return [], []
    points = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    whole = rolling(points, len(points), BASE).tolist(), [0]
    if len(points) < K:
        return whole
    inner = rolling(points, S, BASE)
    span = K - S + 1
    least = sliding_min(inner, span)
    places = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
    if not len(places):
        return whole
    hashes = rolling(points, K, BASE)[places]
    few = hashes <= np.uint64(SHARE)
    found, at = _first(hashes[few], places[few]) if few.any() else (hashes[few], places[few])
    if len(found) < KEEP:
        found, at = _first(hashes, places)
        found, at = found[:KEEP], at[:KEEP]
    return found.tolist(), at.tolist()


def reach(a: Anchors) -> int:
    """The hash up to which a fingerprint holds all anchors of its text."""
    return max(a[0][-1], SHARE) if len(a[0]) >= KEEP else 1 << 64


def _first(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes ascending, each with its smallest place."""
    order = np.lexsort((places, hashes))
    h, p = hashes[order], places[order]
    new = np.append(True, h[1:] != h[:-1])
    return h[new], p[new]


def as_text(a: Anchors) -> str:
    return ";".join(f"{h:016x}@{p:x}" for h, p in zip(*a))


def from_text(fingerprint: str) -> Anchors:
    parts = [x.split("@") for x in fingerprint.split(";")] if fingerprint else []
    return [int(h, 16) for h, _ in parts], [int(p, 16) for _, p in parts]


def likeness(a: Anchors, b: Anchors) -> float:
    """0 to 1: share of the anchors of either, up to where both fingerprints reach, that both have in one order; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    top = min(reach(a), reach(b))
    union = {h for x in (a, b) for h in x[0] if h <= top}
    where = dict(zip(*b))
    both = sorted((p, where[h]) for h, p in zip(*a) if h <= top and h in where)
    chain: list[int] = []  # longest chain that ascends in both texts
    for _, q in both:
        i = bisect_left(chain, q)
        chain[i : i + 1] = [q]
    return len(chain) / len(union)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text's fingerprint) of every document; a null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
        for b in slices(batches):
            yield batch(schema, [b.column(0), [as_text(anchors(t or "")) for t in b.column(1).to_pylist()]])

    return docs.select("doc_id", "text").transform(bounded).mapInArrow(run, "doc_id bigint, fingerprint string")


#: What stands for a null doc_id in the order of documents: such rows come first.
FIRST = -(1 << 63)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness, and that to the next document.

    Edited: the last quarter of the code points is replaced by as many of the
    next document in ascending doc_id, after the last one the first.  Rows
    with one doc_id follow each other in the order of their texts; those
    without one come first, null texts count as empty.

    Texts are shuffled once, by ranges of doc_id.  The rows at which ranges
    begin are real doc_ids, one a range, so the row that the last document of
    a range needs is known beforehand and sent to both.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(2 * partitions(spark), -(-size // RANGE_BYTES))  # tasks stay of one size however large the corpus
    bounds = rows.agg(F.min("key"), F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()
    if bounds[0] is None:
        return docs.select("doc_id", "text").limit(0).transform(bounded).mapInArrow(lambda batches: iter(()), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    starts = sorted({bounds[0], *bounds[1]})
    literal = F.array(*[F.lit(s).cast("bigint") for s in starts])
    own = F.size(F.filter(literal, lambda s: s <= F.col("key"))) - 1
    # a row that begins a range also follows the last one of the range before; the very first follows the very last
    begins = F.element_at(literal, (own + 1).cast("int")) == F.col("key")
    before = F.when(begins, F.array(F.struct(F.pmod(own - 1, F.lit(len(starts))).alias("range"), F.lit(1).alias("after")))).otherwise(F.array().cast("array<struct<range:int,after:int>>"))
    dealt = rows.withColumn("to", F.explode(F.concat(F.array(F.struct(own.alias("range"), F.lit(0).alias("after"))), before))).select("to.*", "key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # range, after, key, text, anchors of the row whose next one is awaited
        for b in slices(batches):
            out = []
            for at, after, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0] == at and held[1] and after:
                    continue  # more rows that begin the next range
                mine = anchors(text)
                if held and held[0] == at and not held[1]:
                    old, n = held[3], len(held[3])
                    new = old[: n - n // 4] + text[: n // 4]
                    marks = anchors(new)
                    out.append((None if held[2] == FIRST else held[2], n, hashlib.sha256(new.encode()).hexdigest(), as_text(held[4]), as_text(marks), likeness(held[4], marks), likeness(held[4], mine)))
                held = [at, after, key, text, mine]
            if out:
                yield batch(OUT, [list(c) for c in zip(*out)])

    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "after", "key", "text")
    return ordered.transform(bounded).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

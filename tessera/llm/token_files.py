"""Operator 4: token ids as coded binary segments, written in ascending doc_id order and read back.

A file of the table is one range of doc_ids; its rows are segments (see
range_coder), in order.  A segment holds whole documents, about SEGMENT ids of
them, and stands alone: it is coded, checked and decoded without any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded, partitions, slices
from tessera.llm.range_coder import BLOCK, pack_segment, unpack_segment
from tessera.llm.tokens import DEFAULT_VOCABULARY, encoder
from tessera.sources.scratch import scratch_dir

#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT = 8 << 20
#: Words that a worker remembers, some 60 MB.
MEMORY = 1_200_000
SEGMENTS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.large_binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: What stands for a null doc_id in a file; such rows sort first.
NULL_ID = -(1 << 63)


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str = DEFAULT_VOCABULARY, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Encode the documents, append the end id to each, and write them below `path`.

    A null or empty text is the end id alone; rows with a null doc_id come
    first, rows with one doc_id stand in the order of their texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(vocabulary, memory=MEMORY), TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held
            data = pack_segment(np.concatenate(keys), np.concatenate(counts), np.concatenate(rows), block)
            out = batch(SEGMENTS, [[part], [seq], [before], [held], pa.array([data], pa.large_binary())])
            keys.clear(), counts.clear(), rows.clear()
            seq, before, held = seq + 1, before + held, 0
            return out

        for b in slices(batches):
            ids, cuts = enc.encode(b.column(1))
            ids, cuts = np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))
            key, at = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), 0
            while at < len(key):  # documents up to the one that fills the segment
                to = min(len(key), int(np.searchsorted(cuts, cuts[at] + segment - held)))
                keys.append(key[at:to]), counts.append(np.diff(cuts[at : to + 1])), rows.append(ids[cuts[at] : cuts[to]])
                held += int(cuts[to] - cuts[at])
                at = to
                if held >= segment:
                    yield close()
        if rows:
            yield close()

    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.transform(bounded).mapInArrow(run, "part bigint, seq bigint, before bigint, n_ids bigint, payload binary").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def _decoded(spark: SparkSession, path: str, schema: pa.Schema, last) -> DataFrame:
    files = spark.read.schema("part bigint, seq bigint, before bigint, n_ids bigint, payload binary").parquet(path)
    # one number for each file, of which there are as many as partitions were written
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ends = np.cumsum([0, *(n for _, n in totals)]).tolist()
    base = {part: at for (part, _), at in zip(totals, ends)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for part, before, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                doc_ids, counts, ids = unpack_segment(payload.as_py())
                cuts = np.append(0, np.cumsum(counts))
                flat = memoryview(ids.astype("<u4")).cast("B")
                keys = pa.array(doc_ids, mask=doc_ids == NULL_ID)
                yield batch(schema, [keys, base[part] + before + cuts[:-1], counts, last([flat[4 * a : 4 * z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())])])

    return files.select("part", "before", "payload").transform(bounded).mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'bigint'}" for f in schema))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of what write() left; ids are little-endian unsigned 32-bit integers."""
    return _decoded(spark, path, READ, lambda pieces: pa.array([bytes(p) for p in pieces], pa.large_binary()))


def digests(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Write to the shared folder, read back, and reduce each document's ids to their checksum."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write(docs, path, vocabulary=vocabulary)
    return _decoded(spark, path, DIGESTS, lambda pieces: [zlib.crc32(p) for p in pieces])

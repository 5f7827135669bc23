"""Operator 7: n-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles.  Sets of similar size share a
band; within a band two sets that are similar enough differ in at most k
shingles.  Shingles are dealt to parts of the domain, and those of a part to
SUBPARTS subparts.  With more than k / (BAD + 1) parts, at least one holds no
more than BAD shingles that only one of both has, so both agree on all
SUBPARTS - BAD others: the subsets of so many subparts are enumerated, and the
hash of what a set has in one of them is a signature.  Sets that share none are
never compared.

Bands overlap by the ratio of sizes that similar sets can have, so every
similar pair has a band in common.  A subset that is empty gives no signature,
as it would match half the corpus: there are e parts more than needed.  A part
that both sets agree on is lost if it is empty, one in which they differ also
if all of it is in one subpart; as the latter takes one of the k differences,
where a lost part may take BAD + 1, it counts half.  So a set whose empty parts
and half of whose parts with one subpart number at most e meets every similar
one; the few others are dealt anew with another seed, and meet there.  e lies
three deviations above what the smallest sets of a band are expected to have.

Equal sets are one node from the start.  Within a signature, members are first
held against one pivot, the member with the most shared signatures; what these
links join is one component, and only pairs across components are left to
compare.  Copies in one large group thus cost one comparison each.

A passage that many documents share fills parts of its own, and all of them
would meet there.  Similar sets share f parts more than needed, and as many as
they have fewer lost parts than allowed.  So of the frequent signatures, those
with more than PAIRS_EACH pairs to compare, a set does without the most
frequent ones in so many parts and still meets every similar set.  Pairs that
are left are first held against parity sketches: each shingle flips one bit, so
sketches of two sets differ in no more bits than the sets in shingles, and a
pair with more is done without its sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil, exp, floor, isqrt, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_i64, batch, bounded, mix, partitions, rolling, saved, slices, word_hashes
from tessera.llm.components import components

#: A band's largest size over its smallest, as a power of the size ratio of similar sets.
BAND = 3
BASE = 0xC2B2AE3D27D4EB4F
#: Subparts of a part, and shingles in which sets may differ within one part: each subset of SUBPARTS - BAD subparts gives a signature.
SUBPARTS = 3
BAD = 1
#: Parts that a signature tells apart.
PARTS_TOLD = 4096
#: Frequent parts allowed for each part that is needed, besides those a set has to spare, and pairs from which a signature is frequent.
FREQUENT = 0.0
PAIRS_EACH = 256
#: Deals of a set whose empty parts are too many; one that fails all meets others like it under one signature (NO_BAND).
SEEDS = 48
NO_BAND = 255
#: Members of a frequent signature that are compared in one task with each other or with as many others.
CHUNK = 4096
#: Bands there are room for: sizes beyond 10^15 are out of reach.
MOST_BANDS = 100
#: Bits of a parity sketch: for each shingle at least, and at most.
BITS_EACH = 8
PARITY_BITS = 16384
#: log2 of the signatures a task remembers, to tell those it has met twice.
MET_BITS = 18
#: Nodes a task remembers.
SEEN = 50_000
#: Parts over which the members of a frequent signature are dealt before they are known to be shared.
SALTS = 255
#: Spare parts are told up to this number, as they share 15 bits with the salt.
MOST_SPARE = 127
#: Documents wanted from the corpus up to which their ids are broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 500_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than `width` are one shingle, none are none."""
    words = word_hashes((text or b"").lower())  # ASCII letters and ASCII white space only
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(rolling(words, min(width, len(words)), BASE) + np.uint64(min(width, len(words))))


@lru_cache(4096)
def parts_of(band: int, percent: int) -> tuple[int, int, int, int, int]:
    """(smallest size, largest size, parts, lost parts allowed, frequent parts allowed) of a band.

    Band j holds sizes from lo(j) to lo(j) / t^BAND, with t the threshold; the
    next one starts a factor t before its end.
    """
    t = percent / 100
    step = t ** -(BAND - 1)
    lo, hi = ceil(step**band - 1e-9), floor(step**band * t**-BAND + 1e-9)
    differ = (100 - percent) * 2 * hi // (100 + percent)
    needed = differ // (BAD + 1) + 1
    frequent = floor(FREQUENT * needed)

    def excess(lost: int) -> float:
        """Three deviations above the lost parts that the smallest sets will have, over those allowed."""
        parts = needed + frequent + lost
        none = exp(-lo / (SUBPARTS * parts))  # share of subparts that are empty
        mean = parts * (none**3 + 1.5 * none**2 * (1 - none))
        return max(0.0, mean + 3 * sqrt(mean) - lost)

    # the fewest that suffice; small sets, where none do, take what comes nearest
    most = isqrt(needed) + needed // 3
    lost = min(range(most + 1), key=lambda e: (excess(e), e)) if differ < 100_000 else most
    return lo, hi, needed + frequent + lost, lost, frequent


@lru_cache(65536)
def bands(size: int, percent: int) -> list[int]:
    """The bands that hold a size."""
    t = percent / 100
    first = max(0, floor(log(size * t**BAND) / log(t ** -(BAND - 1))) - 1)
    return [j for j in range(first, first + 6) if parts_of(j, percent)[0] <= size <= parts_of(j, percent)[1]]


def signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, spare): parts of its band that the set could do without, besides those allowed to be frequent, for each signature."""
    out, spare = [np.empty(0, np.uint64)], [np.empty(0, np.int16)]
    if len(shingles) * (100 - percent) < percent:
        return out[0], spare[0]  # no other set is similar: one shingle more is too many
    for j in bands(len(shingles), percent):
        _, largest, parts, allowed, _ = parts_of(j, percent)
        if (100 - percent) * 2 * largest < 100 + percent:
            continue  # equal sets only
        for seed in range(SEEDS):
            seeded = mix(shingles + np.uint64(j * 0x9E3779B9 + 1 + (seed << 40)))
            at = (seeded % np.uint64(SUBPARTS * parts)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            held, starts = np.unique(at[order], return_index=True)
            sums, some = np.zeros(SUBPARTS * parts, np.uint64), np.zeros(SUBPARTS * parts, np.int64)
            sums[held], some[held] = np.add.reduceat(mix(seeded[order] + np.uint64(0x51ED270B)), starts), 1
            sums, some = sums.reshape(parts, SUBPARTS), some.reshape(parts, SUBPARTS)
            # each subset leaves BAD = 1 subpart out
            subsets, any_ = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums, some.sum(axis=1, keepdims=True) > some
            found = np.flatnonzero(any_)
            # the low byte names the band, the bits above it the part
            name = (found // SUBPARTS % PARTS_TOLD << 8 | j).astype(np.uint64)
            out.append(mix(subsets.reshape(-1)[found] + mix(found.astype(np.uint64) + np.uint64((j + 1 << 32) + (seed << 44)))) & ~np.uint64(PARTS_TOLD * 256 - 1) | name)
            full = some.sum(axis=1)
            lost = np.count_nonzero(full == 0) + (np.count_nonzero(full == 1) + 1) // 2
            if lost <= allowed:
                break
        else:
            out.append(np.array([(j << 8) + NO_BAND], np.uint64))
        held = sum(map(len, out)) - sum(map(len, spare))
        spare.append(np.full(held, min(MOST_SPARE, allowed - lost) if seed == 0 and lost <= allowed else 0, np.int16))
    return np.concatenate(out), np.concatenate(spare)


def parity(shingles: np.ndarray) -> bytes:
    """A sketch of 2^k bits, BITS_EACH times the set's size at least, up to PARITY_BITS: bit h is the parity of the shingles with hash h."""
    size = min(PARITY_BITS, max(64, 1 << (BITS_EACH * len(shingles) - 1).bit_length()))
    at = (mix(shingles + np.uint64(0x1234567)) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def set_hash(shingles: np.ndarray) -> int:
    """64-bit identity of a set."""
    total = np.add.reduce(mix(shingles + np.uint64(77)), dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))
    return int(mix(total)[0])


MEMBERS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("parity", pa.binary())])
SIGNATURES = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("salt", pa.int16())])
SETS = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def membership(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, n, node, parity): size, identity and sketch of each document's set; an empty set has no node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, width)
                rows.append((len(s), _signed(set_hash(s)), parity(s)) if len(s) else (0, None, None))
            yield batch(MEMBERS, [b.column(0), b.column(1), *([r[k] for r in rows] for k in range(3))])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").transform(bounded).mapInArrow(run, "doc_id bigint, t bigint, n bigint, node bigint, parity binary")


def signature_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, node, salt), each node once a task.

    The low byte of salt is 0 for the first two nodes of a signature in a
    task, which is enough to tell that it is shared; more of them are known to
    be shared and dealt by it.  The high byte is the node's spare parts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        met, times = np.zeros(1 << MET_BITS, np.uint64), np.zeros(1 << MET_BITS, np.int8)
        for b in slices(batches):
            sigs, nodes, salts = [], [], []
            for text in b.column(0).cast(pa.binary()).to_pylist():
                s = shingle_set(text, width)
                if not len(s):
                    continue
                node = set_hash(s)
                if node in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(node)
                x, spare = signatures(s, percent)
                slot = (x >> np.uint64(64 - MET_BITS)).astype(np.int64)
                count = np.where(met[slot] == x, times[slot], 0)
                met[slot], times[slot] = x, np.minimum(count + 1, 2)
                sigs.append(x)
                nodes.append(np.full(len(x), node, np.uint64))
                salts.append(np.where(count < 2, 0, 1 + node % SALTS).astype(np.int16) | spare << 8)
            if sigs:
                yield batch(SIGNATURES, [as_i64(np.concatenate(sigs)), as_i64(np.concatenate(nodes)), np.concatenate(salts)])

    return docs.select("text").transform(bounded).mapInArrow(run, "sig bigint, node bigint, salt smallint")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of one document (doc_id, t) for each wanted node; a null doc_id is found as any other."""
    wanted = saved(wanted, "wanted").withColumnsRenamed({"doc_id": "__id", "t": "__t"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return keyed.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))).select("node", "text")


def _once(rows: DataFrame) -> DataFrame:
    """A table with one row a node; rows of documents that are repeated as a whole give a node more than once."""
    rows = saved(rows, "nodes")
    if rows.count() == rows.select("node").distinct().count():
        return rows
    return saved(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in rows.columns if c != "node"]), "nodes")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set) for each wanted node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(x, width) for x in b.column(1).cast(pa.binary()).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), np.concatenate(sets).view(np.int64))
            yield batch(SETS, [b.column(0), lists])

    return _once(_texts(docs, wanted).transform(bounded).mapInArrow(run, "node bigint, set array<bigint>"))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity sketches do not rule out a link; no linked pair is lost."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # linked sets differ in at most (100 - p) / (100 + p) of their joint size
            keep = [(100 + percent) * differing(x, y) <= (100 - percent) * (m + n) for x, y, m, n in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=PAIRS).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sketches.select(F.col("node").alias(x), F.col("parity").alias(f"p{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb", "na", "nb").transform(bounded).mapInArrow(run, "a bigint, b bigint")


def among(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows (sig, node, root, n) of a signature, in different components, that sketches do not rule out.

    Members are dealt to chunks; every pair of chunks is a task of its own,
    and only pairs that may be linked leave it.
    """
    sizes = rows.groupBy("sig").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    sized = rows.join(sizes, "sig").withColumn("own", own)
    many = sized.filter("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = sized.filter("chunks = 1").withColumn("other", F.lit(0)).unionByName(many).select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root", "n")
    dealt = dealt.join(sketches.select("node", "parity"), "node")

    def run(table: pa.Table) -> pa.Table:
        node, root, n, own = (table.column(c).to_numpy() for c in ("node", "root", "n", "own"))
        packed = table.column("parity").to_pylist()
        same = table.column("x")[0] == table.column("y")[0]
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(packed):
            by_size.setdefault(len(p), []).append(i)
        matrix = {k: np.frombuffer(b"".join(packed[i] for i in v), np.uint64).reshape(len(v), -1) for k, v in by_size.items()}
        found: list[np.ndarray] = []
        for k, rows_k in by_size.items():
            for m, rows_m in by_size.items():
                if m < k:
                    continue
                right = np.array(rows_m)
                folded = np.bitwise_xor.reduce(matrix[m].reshape(len(right), -1, k // 8), axis=1)
                for i, bits in zip(rows_k, matrix[k]):
                    # each pair once: between chunks from the first one's side, within a chunk or size in order of rows
                    ask = (root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
                    ask &= (own[right] != own[i]) if not same else True
                    if m == k:
                        ask &= right > i
                    at = np.flatnonzero(ask)
                    if len(at):
                        differ = np.bitwise_count(folded[at] ^ bits).sum(axis=1, dtype=np.int64)
                        hit = right[at[(100 + percent) * differ <= (100 - percent) * (n[right[at]] + n[i])]]
                        found.append(np.stack([np.minimum(node[hit], node[i]), np.maximum(node[hit], node[i])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=PAIRS)

    return dealt.groupBy("sig", "x", "y").applyInArrow(run, "a bigint, b bigint")


def linked(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, as a table."""
    left = saved(plausible(pairs, sketches, percent), "plausible")
    nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(docs, reps.join(nodes, "node"), width)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    joined = left.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return saved(joined.filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"), "linked")


def _needed(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of frequent signatures without those that their sets can do without.

    In an order of all signatures, the most frequent first, a set lets go of
    the signatures before the one that brings in one part more than it has to
    spare.  Two similar sets agree in one part more than either of them has to
    spare; the last of the signatures that they share in these parts comes
    too late for both to let it go.
    """
    by_band = [parts_of(j, percent) if j < MOST_BANDS else (0, 0, 1, 0, 0) for j in range(256)]
    allowed = F.array(*[F.lit(b[4]) for b in by_band])
    told = F.array(*[F.lit(b[2] <= PARTS_TOLD) for b in by_band])
    band = F.col("sig").bitwiseAND(F.lit(255)).cast("int")
    rows = rows.withColumn("band", band).withColumn("place", F.struct("pairs", "sig"))
    # where parts are not told apart, each signature counts as one
    part = F.when(F.get(told, F.col("band")), F.col("sig").bitwiseAND(F.lit(PARTS_TOLD * 256 - 256))).otherwise(F.col("sig"))
    first = rows.withColumn("part", part).groupBy("node", "band", "part").agg(F.max("place").alias("place"), F.max("spare").alias("spare"))
    order = Window.partitionBy("node", "band").orderBy(F.col("place").desc())
    bars = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == F.get(allowed, F.col("band")) + F.col("spare") + 1)
    bars = saved(bars.select(F.col("node").alias("of"), F.col("band").alias("in"), F.col("place").alias("bar")), "bars")
    return rows.join(bars, (F.col("node") == F.col("of")) & (F.col("band") == F.col("in")) & (F.col("place") <= F.col("bar"))).select("sig", "node", "root", "n")


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, t, n_shingles, component_id) of every document row.

    Two documents link when 100 * |A and B| >= percent * |A or B|;
    component_id is the smallest doc_id reachable by links.  A document with
    no words is linked with nothing.  Rows with a null doc_id take part but
    never give the name.
    """
    spark = docs.sparkSession
    members = saved(membership(docs, width), "members")
    rows = signature_rows(docs, width, percent).select("sig", "node", F.shiftright("salt", 8).cast("tinyint").alias("spare"), (F.col("salt") % 256).alias("salt")).repartition(partitions(spark), "sig", "salt")
    by_sig = Window.partitionBy("sig", "salt")
    shared = rows.withColumn("lo", F.min("node").over(by_sig)).withColumn("hi", F.max("node").over(by_sig)).filter("lo < hi or salt > 0")
    shared = saved(shared.groupBy("sig", "node").agg(F.max("spare").alias("spare")), "shared")
    # a row with a doc_id stands for a set where there is one: nulls come last
    sets = members.filter("node is not null").groupBy("node").agg(F.max("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("rep"), F.first("parity").alias("parity"))
    nodes = saved(shared.groupBy("node").agg(F.count("*").alias("deg")).join(sets, "node"), "nodes")
    reps, sketches = nodes.select("node", "rep.doc_id", "rep.t"), nodes.select("node", "n", "parity")
    # joins read tables, not aggregates, so that AQE can split their hot keys; the size filter drops pairs that no overlap could link
    live = saved(shared.join(nodes.select("node", "deg", "n"), "node"), "live")
    pivots = saved(live.groupBy("sig").agg(F.max(F.struct("deg", "node", "n")).alias("p")).select("sig", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")), "pivots")
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = live.join(pivots, "sig").filter((F.col("node") != F.col("pivot")) & near("n", "pn")).select(*pair("node", "pivot")).distinct()
    star = saved(star, "star")
    links = linked(docs, star, sketches, reps, width, percent)
    roots = components(links)
    # what is left: pairs that share a signature, lie in different components, and were not held against each other
    named = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members_of = named.groupBy("sig", "root").agg(F.count("*").alias("m")).groupBy("sig").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
    pairs_of = saved(members_of.withColumn("pairs", (F.col("all") * F.col("all") - F.col("same")) / 2).filter("pairs > 0").select("sig", "pairs"), "pairs")
    rest = saved(named.join(pairs_of, "sig").select("sig", "node", "root", "n", "spare", "pairs"), "rest")
    frequent = saved(_needed(rest.filter(F.col("pairs") > PAIRS_EACH), percent), "frequent")
    rest = rest.filter(F.col("pairs") <= PAIRS_EACH)
    x, y = rest.alias("x"), rest.alias("y")
    across = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") < F.col("y.root")) & near(F.col("x.n"), F.col("y.n"))).select(*pair(F.col("x.node"), F.col("y.node"))).distinct()
    across = across.unionByName(among(frequent, sketches, percent)).distinct()
    more = linked(docs, saved(across, "across").join(star, ["a", "b"], "left_anti"), sketches, reps, width, percent)
    final = components(links.unionByName(more))
    labelled = saved(members.join(final, "node", "left").select("doc_id", "t", "n", F.coalesce("root", "node").alias("root")), "labelled")
    # the smallest doc_id of a component: one row for each component and task is shuffled
    first = saved(labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
    return labelled.join(first, "root", "left").select("doc_id", "t", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; all columns kept.

    Rows that repeat that doc_id, and rows with a null doc_id, all stay.
    """
    found = classes(docs, width, percent).filter((F.col("doc_id") > F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id", "t").distinct()
    dropped = found.withColumnsRenamed({"doc_id": "__id", "t": "__t"})
    return docs.join(dropped, (docs["doc_id"] == dropped["__id"]) & (F.xxhash64(docs["text"]) == dropped["__t"]), "left_anti")

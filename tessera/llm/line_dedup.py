"""Operator 2: line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an equal one, or one within edit distance 1, stands earlier in
the corpus, by (doc_id, line number).  Equal lines are found by their hashes.
For the others, every variant of a line with one character deleted is a hashed
key; lines that share a key are candidates, and the distance is then verified.

Emitting all variants of all lines would hash each line once for each of its
characters.  Two lines at distance 1 agree outside a region that holds the
edit, so regions are narrowed first: the two halves of every line, then
sixteenths of the halves that some other line agrees with outside, until a
region is short.  Only there are variants emitted.  No pair is lost: regions
tile the line, whose length is taken once as the longer and once as the
shorter of the two.

Of the lines that share a variant each one meets only the earliest, so groups
are never expanded into pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, unused

#: Lines shorter than this many characters are matched exactly only, as one edit makes other words of short ones; callers can pass another bound.
FUZZY_CHARS = 20
#: Parts of a region in one narrowing step, and the length at which variants are emitted.
PARTS = 16
REGION = 32
#: Rows up to which a side with a few narrow columns is broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 500_000
#: Bytes up to which a side whose rows grow with the texts is broadcast.
BROADCAST_BYTES = 48 << 20


def _side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line_no, line): t tells rows with one doc_id apart; a null text has no lines."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return keyed.select("doc_id", "t", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _order(doc_id: str = "doc_id") -> Column:
    """The place of a line in the corpus; rows without a doc_id come last."""
    return F.struct(F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("d"), F.col("line_no").alias("l"), F.col("t").alias("t"))


def _live(rows: DataFrame, what: tuple[str, ...]) -> DataFrame:
    """Keys that two different lines have; minima and maxima are taken in each task before anything is shuffled."""
    return rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("key")


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the four regions of a line: each half, for the line as the longer (m = n) and as the shorter (m = n + 1) of a pair.

    A region from a to b of a length m is keyed by what is outside: the first
    a and the last m - b characters.
    """
    def key(short: int, first: bool) -> Column:
        m = n + short
        h = F.floor(m / 2).cast("int")
        return F.xxhash64(m, F.lit(first), F.substring(line, h + 1 - short, n) if first else F.substring(line, F.lit(1), h))

    return [key(s, f) for s in (0, 1) for f in (True, False)]


def _halves(line: Column, n: Column) -> Column:
    """The same regions with their lengths and texts."""
    def region(key: Column, short: int, first: bool) -> Column:
        m = n + short
        h = F.floor(m / 2).cast("int")
        body = F.substring(line, F.lit(1), h - short) if first else F.substring(line, h + 1, n)
        return F.struct(F.lit(bool(short)).alias("short"), (h if first else m - h).alias("size"), key.alias("key"), body.alias("body"))

    return F.array(*[region(k, s, f) for k, (s, f) in zip(_half_keys(line, n), [(s, f) for s in (0, 1) for f in (True, False)])])


def _narrowed(rows: DataFrame) -> DataFrame:
    """Each region in PARTS parts; the parts of the longer line are the parts of the shorter one, which lacks one character."""
    step = F.ceil(F.col("size") / PARTS).cast("int")
    cut = rows.withColumn("step", step).withColumn("x", F.explode(F.expr(f"transform(sequence(0, {PARTS - 1}), i -> i * step)"))).filter("x < size")
    y = F.least(F.col("x") + F.col("step"), F.col("size"))
    tail = F.col("size") - y  # characters after the part, the same for both lines
    length = F.char_length("body")
    key = F.xxhash64("key", "x", F.substring("body", F.lit(1), F.col("x")), F.substring(F.col("body"), length - tail + 1, tail))
    body = F.substring(F.col("body"), F.col("x") + 1, F.greatest(length - tail - F.col("x"), F.lit(0)))
    return cut.select("h", "short", (y - F.col("x")).alias("size"), key.alias("key"), body.alias("body"))


def _variants(rows: DataFrame) -> DataFrame:
    """(h, short, key, pos): a longer line's region with each character deleted, a shorter one's as it is."""
    n = F.char_length("body")
    places = F.when(F.col("short"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    out = rows.filter(F.col("short") | (n > 0)).withColumn("pos", F.explode(places))
    left = F.when(F.col("short"), F.col("body")).otherwise(F.concat(F.substring(F.col("body"), F.lit(1), F.col("pos") - 1), F.substring(F.col("body"), F.col("pos") + 1, n)))
    return out.select("h", "short", F.xxhash64("key", "size", left).alias("key"), "pos")


def near(docs: DataFrame, first: DataFrame, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """Hashes h of the lines of at least fuzzy_chars characters that have an earlier such line within edit distance 1; first: (h, o) of each distinct line."""
    chars = F.char_length("line")
    long_lines = _lines(docs).filter(chars >= fuzzy_chars).select(F.xxhash64("line").alias("h"), "line")
    keys = long_lines.select("h", F.explode(F.array(*_half_keys(F.col("line"), chars))).alias("key"))
    live_keys = saved(_live(keys, ("h",)), "live")
    live_lines = saved(keys.join(_side(live_keys), "key", "left_semi").select("h").distinct(), "lines")
    texts = saved(long_lines.join(_side(live_lines), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "texts")
    rows = texts.select("h", F.explode(_halves(F.col("line"), F.char_length("line"))).alias("r")).select("h", "r.*").join(_side(live_keys), "key", "left_semi")
    rows = saved(rows.select("h", "short", "size", "key", "body"), "regions")
    done = []
    while True:
        done.append(rows.filter(F.col("size") <= REGION))
        wide = rows.filter(F.col("size") > REGION)
        if wide.isEmpty():
            break
        parts = _narrowed(wide)
        rows = saved(parts.join(_live(parts, ("h",)), "key", "left_semi").select("h", "short", "size", "key", "body"), "regions")
    regions = done[0]
    for more in done[1:]:
        regions = regions.unionByName(more)
    variants = _variants(regions).join(first, "h")
    # of each variant: the earliest shorter line, the earliest longer one, and the earliest with the same place deleted
    who = F.struct("o", "h")
    shorter, longer = F.when(F.col("short"), who), F.when(~F.col("short"), who)
    by_place = variants.groupBy("key", "pos").agg(F.min(longer).alias("same"), F.min(shorter).alias("shorter"))
    by_key = by_place.groupBy("key").agg(F.min("shorter").alias("shorter"), F.min("same").alias("longer"))
    met = variants.join(by_place.select("key", "pos", "same"), ["key", "pos"]).join(by_key, "key")
    partner = F.when(F.col("short"), F.array("longer")).otherwise(F.array("shorter", "same"))
    pairs = met.select("h", "o", F.explode(partner).alias("p")).filter(F.col("p.o") < F.col("o")).select("h", F.col("p.h").alias("g")).distinct()
    other = texts.select(F.col("h").alias("g"), F.col("line").alias("earlier"))
    checked = pairs.join(texts, "h").join(other, "g").filter(F.levenshtein("line", "earlier", 1).between(0, 1))
    return checked.select("h").distinct()


def marked(docs: DataFrame, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """(doc_id, t, keep) of the documents that lose lines; keep: a flag for each line."""
    text = F.col("line")
    rows = _lines(docs).select("doc_id", "t", "line_no", F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), (F.trim(F.regexp_replace(text, r"\s+", " ")) == "").alias("blank"))
    lines = saved(rows, "lines")
    solid = lines.filter("not blank")
    groups = saved(solid.groupBy("h", "h2").agg(F.min(_order()).alias("o"), F.count("*").alias("n")), "groups")
    later = near(docs, groups.select("h", "o"), fuzzy_chars)
    gone = groups.filter("n > 1").select("h", "h2", F.col("o").alias("first")).join(later.withColumn("near", F.lit(True)), "h", "full")
    # a near line takes all its copies with it; of a line that stays, the first copy stays
    flagged = lines.join(_side(saved(gone.select("h", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "gone")).withColumnsRenamed({"h2": "g2"}), "h", "left")
    drop = ~F.col("blank") & (F.coalesce("near", F.lit(False)) | F.coalesce((F.col("h2") == F.col("g2")) & (F.col("first") < _order()), F.lit(False)))
    per_doc = flagged.select("doc_id", "t", "line_no", drop.alias("drop")).groupBy("doc_id", "t", "line_no").agg(F.max("drop").alias("drop"))
    found = per_doc.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("line_no", "drop"))).alias("x"), F.max("drop").alias("any")).filter("any")
    return found.select("doc_id", "t", F.transform("x", lambda r: ~r["drop"]).alias("keep"))


def _joined(docs: DataFrame, fuzzy_chars: int) -> tuple[DataFrame, str]:
    """The documents and the name of a column with the flags of their lines, null where all stay."""
    own = unused(docs.columns)
    marks = saved(marked(docs, fuzzy_chars), "marks")
    # flags grow with the texts, so they are counted too
    size = marks.agg(F.sum(F.size("keep") + 16)).first()[0] or 0
    marks = marks.withColumnsRenamed({"doc_id": own + "id", "t": own + "t", "keep": own + "keep"})
    marks = F.broadcast(marks) if size <= BROADCAST_BYTES else marks
    return docs.join(marks, F.col("doc_id").eqNullSafe(F.col(own + "id")) & (F.xxhash64("text") == F.col(own + "t")), "left"), own + "keep"


def _kept(keep: str) -> Column:
    return F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.get(keep, i)), "\n")


def dedup(docs: DataFrame, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """The documents without the repeated lines, all columns kept; n_chars, if there is one, follows the text.

    fuzzy_chars: length from which lines are matched within edit distance 1; 1
    matches all, as an empty line is never matched.

    Lines of white space stay.  A document that loses all its other lines
    goes; one that had none stays.  A null text has no lines.  Rows that are
    equal in doc_id and text count as one document and stay alike.
    """
    columns = [f"`{c}`" for c in docs.columns]
    joined, keep = _joined(docs, fuzzy_chars)
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(_kept(keep))
    out = joined.withColumn("text", text).filter(F.col(keep).isNull() | F.col("text").rlike(r"\S")).select(*columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(docs: DataFrame, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document; a null text has no lines and the digest of ''."""
    joined, keep = _joined(docs, fuzzy_chars)
    lost = F.coalesce(F.size(F.filter(keep, lambda k: ~k)), F.lit(0)).cast("bigint")
    kept = F.when(F.col(keep).isNull(), F.coalesce("text", F.lit(""))).otherwise(_kept(keep))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint")
    return joined.select("doc_id", lines.alias("n_lines"), F.when(F.col(keep).isNull(), F.lit(0)).otherwise(lost).cast("bigint").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


#: The same in SQL: equal lines, and lines whose halves agree and that one substitution, insertion or deletion turns into each other.
SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
s AS (SELECT *, regexp_matches(line, '[^\\s]') AS solid FROM l),
f AS (SELECT line, min(doc_id * 1000000 + line_no) AS o, length(line) AS n FROM s WHERE solid GROUP BY line),
k AS (
  SELECT line, o, n, n AS m, 0 AS side, left(line, n // 2) AS key FROM f WHERE n >= 20
  UNION ALL SELECT line, o, n, n + 1, 0, left(line, (n + 1) // 2) FROM f WHERE n >= 20
  UNION ALL SELECT line, o, n, n, 1, substr(line, n // 2 + 1) FROM f WHERE n >= 20
  UNION ALL SELECT line, o, n, n + 1, 1, substr(line, (n + 1) // 2) FROM f WHERE n >= 20),
c AS (SELECT DISTINCT a.line AS line, b.line AS earlier FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.key = b.key AND b.o < a.o AND greatest(a.n, b.n) = a.m),
p AS (SELECT line, earlier, unnest(range(greatest(length(line), length(earlier)))) AS i FROM c),
d AS (
  SELECT DISTINCT line FROM p WHERE
    (length(line) = length(earlier) AND left(line, i) = left(earlier, i) AND substr(line, i + 2) = substr(earlier, i + 2))
    OR (length(line) = length(earlier) + 1 AND left(line, i) = left(earlier, i) AND substr(line, i + 2) = substr(earlier, i + 1))
    OR (length(line) = length(earlier) - 1 AND left(line, i) = left(earlier, i) AND substr(line, i + 1) = substr(earlier, i + 2))),
r AS (
  SELECT s.doc_id, s.line_no, s.line, s.solid AND (d.line IS NOT NULL OR f.o < s.doc_id * 1000000 + s.line_no) AS gone
  FROM s LEFT JOIN f ON f.line = s.line LEFT JOIN d ON d.line = s.line)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(coalesce(gone, false)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

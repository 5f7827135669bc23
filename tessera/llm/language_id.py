"""Operator 1: language identification with hyperdimensional profiles.

Every letter has a pseudo-random vector of +1 and -1; an n-gram binds the
permuted (rotated) vectors of its letters by multiplication, a text bundles
its n-grams by addition, and a language's prototype bundles the texts that are
labelled with it.  A text gets the language whose prototype has the largest
cosine.

Profiles are linear in n-gram counts, so training first counts n-grams by
language (partial sums in each task) and builds vectors only once for each
n-gram and language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded, mix, slices, unused

#: Dimensions of the vectors; letters told apart (others share a slot by hash); letters in an n-gram.
DIMENSIONS = 1024
ALPHABET = 64
GRAM = 3
#: Vectors of n-grams that a task keeps, and that are bundled at once.
VECTORS = 16384
BLOCK = 2048
#: Labels told apart; more than these is an error, not a sample.
MOST_LANGUAGES = 2000
UNDETERMINED = "und"
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("letters", pa.int64()), ("evidence", pa.float64())])


def _letter_table() -> np.ndarray:
    """Slot of each UTF-16 unit: 0 for what is no letter, 1-26 for a-z, others by hash."""
    table = np.zeros(1 << 16, np.uint8)
    others = mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(ALPHABET - 27)
    for c in range(1 << 16):
        x = chr(c)
        if 0xD800 <= c < 0xE000:
            table[c] = 27 + int(others[c])  # letters outside the basic plane come as pairs
        elif x.isalpha():
            low = x.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + int(others[min(ord(low), 0xFFFF)])
    return table


_table: list[np.ndarray] = []


def _letter_table_of(c: str) -> int:
    """Slot of one character of the basic plane."""
    if not _table:
        _table.append(_letter_table())
    return _table[0][ord(c)]


def grams(text: str) -> tuple[np.ndarray, int]:
    """(n-gram codes, letters): runs of non-letters count as one separator."""
    if not _table:
        _table.append(_letter_table())
    slots = _table[0].take(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2"))
    letters = int(np.count_nonzero(slots))
    if letters and any(ord(c) > 0xFFFF for c in text) and not any(c.isalpha() for c in text):
        letters = 0
    if not letters:
        return np.empty(0, np.int64), 0
    keep = np.ones(len(slots), bool)
    keep[1:] = (slots[1:] != 0) | (slots[:-1] != 0)
    s = np.concatenate([[0], slots[keep], [0]]).astype(np.int64)
    code = s[: len(s) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = code * ALPHABET + s[k : len(s) - GRAM + 1 + k]
    return code, letters


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    bits = mix(np.arange(1, ALPHABET * dimensions + 1, dtype=np.uint64)) >> np.uint64(63)
    return (bits.astype(np.int8) * 2 - 1).reshape(ALPHABET, dimensions)


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of n-gram codes, rows of +1 and -1."""
    base = letter_vectors(dimensions)
    out = np.ones((len(codes), dimensions), np.int8)
    for k in range(GRAM):
        letter = codes // ALPHABET ** (GRAM - 1 - k) % ALPHABET
        out *= np.roll(base, GRAM - 1 - k, axis=1)[letter]
    return out


def train(docs: DataFrame, label: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the labelled rows: every row counts, none is sampled.

    Only sums reach the driver: one vector for each label.
    """
    counts = pa.schema([("label", pa.string()), ("code", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def spill() -> Iterator[pa.RecordBatch]:
            for name, sums in total.items():
                codes = np.flatnonzero(sums)
                yield batch(counts, [pa.array([name] * len(codes), pa.string()), codes.astype(np.int32), sums[codes]])
            total.clear()

        for b in slices(batches):
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code, _ = grams(text)
                if name not in total:
                    if len(total) >= 16:  # keep the sums of a task small whatever the labels
                        yield from spill()
                    total[name] = np.zeros(ALPHABET**GRAM, np.int64)
                if len(code) > 4096:
                    total[name] += np.bincount(code, minlength=ALPHABET**GRAM)
                else:
                    codes, n = np.unique(code, return_counts=True)
                    total[name][codes] += n
        yield from spill()

    def bundle(table: pa.Table) -> pa.Table:
        codes, n = table.column("code").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
        sums = np.zeros(dimensions)
        for i in range(0, len(codes), 4096):
            sums += n[i : i + 4096] @ gram_vectors(codes[i : i + 4096], dimensions).astype(np.float64)
        return pa.table({"label": table.column("label")[:1], "vector": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    labelled = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("label"), "text")
    summed = labelled.transform(bounded).mapInArrow(count, "label string, code int, n bigint").groupBy("label", "code").agg(F.sum("n").alias("n"))
    found = summed.groupBy("label").applyInArrow(bundle, "label string, vector array<double>").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels")
    return {r["label"]: np.array(r["vector"]) for r in found}


class Profiler:
    """Profiles of texts; vectors of n-grams are made when first seen and kept as bytes, VECTORS of them at most."""

    def __init__(self, dimensions: int):
        self.row_of = np.full(ALPHABET**GRAM, -1, np.int32)  # n-gram code -> row of its vector
        self.vectors, self.used = np.empty((1024, dimensions), np.int8), 0

    def __call__(self, code: np.ndarray) -> tuple[np.ndarray, float]:
        """(profile, evidence): evidence is the number of n-grams that count, where repeated ones are no further evidence."""
        codes, n = np.unique(code, return_counts=True)
        n = n.astype(np.float32)
        parts = [n[i : i + BLOCK] @ self._rows(codes[i : i + BLOCK]).astype(np.float32) for i in range(0, len(codes), BLOCK)]
        return sum(parts[1:], parts[0]), float(n.sum()) ** 2 / float(n @ n)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row_of[codes]
        if rows.min() < 0:
            new = codes[rows < 0]
            if self.used + len(new) > VECTORS:  # bounded memory: start anew
                self.row_of[:], self.used, new = -1, 0, codes
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.vectors[self.used : self.used + len(new)] = gram_vectors(new, self.vectors.shape[1])
            self.row_of[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            rows = self.row_of[codes]
        return self.vectors[rows]


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], extra: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """(doc_id, lang_pred, score, margin, letters, evidence, *extra) of every document; the prefix sets the middle five apart from extra columns.

    score is the cosine with the chosen prototype, cut to 0..1; margin is its
    lead over the next one.  A null text, one without letters, and any text
    when nothing was learned get `und` with score 0.  Equal cosines go to the
    smaller label.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = (matrix / np.where(norms == 0, 1, norms)).astype(np.float32)
    fields = [docs.schema[c] for c in extra]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(matrix.shape[1])
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                code, letters = grams(text or "")
                if not letters or not names:
                    out.append((UNDETERMINED, 0.0, 0.0, letters, 0.0))
                    continue
                profile, evidence = profiler(code)
                size = float(np.sqrt(profile @ profile))
                cos = matrix @ profile / size if size else np.zeros(len(names), np.float32)
                best = int(np.argmax(cos))
                rest = np.delete(cos, best)
                out.append((names[best], float(min(1.0, max(0.0, cos[best]))), float(cos[best] - rest.max()) if len(rest) else 1.0, letters, evidence))
            schema = pa.schema([PREDICTED[0], *(pa.field(prefix + f.name, f.type) for f in list(PREDICTED)[1:]), *(b.schema.field(2 + k) for k in range(len(extra)))])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, list(PREDICTED)[1:])), *b.columns[2:]], schema=schema)

    schema = f"doc_id bigint, {prefix}lang_pred string, {prefix}score double, {prefix}margin double, {prefix}letters bigint, {prefix}evidence double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select("doc_id", "text", *extra).transform(bounded).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict every row."""
    prototypes = train(docs.filter(~held_out()))
    found = predict(docs, prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "letters")


#: A text of at least ACCEPT_EVIDENCE letters whose cosine with every prototype is lower than ACCEPT_SCORE is in no
#: known language; one with fewer letters among its characters than ACCEPT_LETTERS is no prose.
ACCEPT_EVIDENCE = 40
ACCEPT_SCORE = 0.15
ACCEPT_LETTERS = 0.25
#: Share of labelled rows that may lie below their language's bar, share of rows in a language left out that may lie above
#: it, and how far a bar lies below the lowest rows at least: the vectors give cosines to about 0.03, and three make up a sum.
LOST = 0.01
FOREIGN = 0.01
SLACK = 0.1
#: Classes of evidence, two to a doubling.
CLASSES = 80


def bars(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> list[tuple[str, int, float]]:
    """(label, class of evidence, bar): score + margin from which a text is in the language.

    Every labelled row the prototypes were trained on is held against them
    twice: without itself, which tells how near texts in the language are, and
    without its whole language, which tells how near texts in an unknown one
    are.  The bar lies halfway between, or where they overlap below the
    former; rows of the classes beside count too, as few of them may be of a
    length.  A row counts for the label it is nearest to, as texts are told by
    that; one that is nearest to another label than its own tells nothing of
    unknown languages.  A class without rows has the bar of the one below; classes below
    all rows of a language have none.
    """
    names = sorted(prototypes)
    if not names:
        return []
    matrix = np.stack([prototypes[n] for n in names])
    squares = (matrix * matrix).sum(axis=1)
    schema = pa.schema([("label", pa.string()), ("class", pa.int32()), ("value", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(matrix.shape[1])
        at = {n: i for i, n in enumerate(names)}
        found: Counter = Counter()

        def spill() -> Iterator[pa.RecordBatch]:
            keys = list(found)
            yield batch(schema, [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [found[k] for k in keys]])
            found.clear()

        for b in slices(batches):
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code, letters = grams(text)
                if not letters:
                    continue
                profile, evidence = profiler(code)
                profile = profile.astype(np.float64)
                square, i = float(profile @ profile), at[name]
                dots, norms = matrix @ profile, squares.copy()
                norms[i] -= 2 * dots[i] - square
                dots[i] -= square
                if not square or norms[i] <= 1e-6 * squares[i]:
                    continue  # the only text of its language
                cos = dots / np.sqrt(np.where(norms > 0, norms, 1) * square)
                grade = min(CLASSES - 1, int(2 * np.log2(evidence)))
                best = int(np.argmax(cos))
                lead = cos[best] - np.delete(cos, best).max() if len(cos) > 1 else 1.0
                found[names[best], grade, round(100 * (cos[best] + lead))] += 1
                if best == i and len(cos) > 1:  # the null label: a language that is left out
                    second, first = np.sort(np.append(np.delete(cos, i), 0.0 if len(cos) == 2 else -1.0))[-2:]
                    found[None, grade, round(100 * (2 * first - second))] += 1
            if len(found) > 50_000:
                yield from spill()
        yield from spill()

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("label"), "text")
    counted = labelled.transform(bounded).mapInArrow(run, "label string, class int, value int, n bigint").groupBy("label", "class", "value").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("label", "class").agg(F.percentile("value", F.lit(LOST), F.col("n")).alias("low"), F.percentile("value", F.lit(1 - FOREIGN), F.col("n")).alias("high")).collect()
    foreign = {r["class"]: r["high"] / 100 for r in rows if r["label"] is None}
    own = {(r["label"], r["class"]): r["low"] / 100 for r in rows if r["label"] is not None}
    out = []
    for name in names:
        bar = None
        for grade in range(CLASSES):
            beside = range(grade - 1, grade + 2)
            if (name, grade) in own:
                low = min(own[name, g] for g in beside if (name, g) in own)
                high = max((foreign[g] for g in beside if g in foreign), default=low)
                bar = min(low - SLACK, (low + high) / 2)
            if bar is not None:
                out.append((name, grade, float(bar)))
    return out


def accept(docs: DataFrame) -> DataFrame:
    """The documents in a known language, all columns kept; `lang` is what was predicted.

    Rejected: no text or no letter, too few letters among the characters, or
    no prototype near, by the bar of the nearest language for texts of as much
    evidence.
    """
    spark = docs.sparkSession
    training = docs.filter(~held_out())
    prototypes = train(training)
    columns = docs.columns
    own = unused(columns)
    col = lambda name: F.col(own + name)
    found = predict(docs, prototypes, tuple(c for c in columns if c != "doc_id"), own)
    held = spark.createDataFrame(bars(training, prototypes), f"{own}lang_pred string, {own}class int, {own}bar double")
    found = found.withColumn(own + "class", F.least(F.lit(CLASSES - 1), F.floor(2 * F.log2(F.greatest(col("evidence"), F.lit(1.0)))).cast("int"))).join(F.broadcast(held), [own + "lang_pred", own + "class"], "left")
    near = col("bar").isNull() | (col("score") + col("margin") >= col("bar"))
    good = (col("lang_pred") != UNDETERMINED) & near & ((col("score") >= ACCEPT_SCORE) | (col("letters") < ACCEPT_EVIDENCE)) & (col("letters") >= ACCEPT_LETTERS * F.length(F.regexp_replace("text", r"\s+", "")))
    return found.filter(good).select(*[col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in columns])

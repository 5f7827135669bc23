"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_automaton, components, language_id, licenses, line_dedup, ngram_join, packing, range_coder, substring_dedup, syncmers, token_files, topk
from tessera.llm.common import mix, rolling
from tessera.llm.tokens import TextEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "ids bigint, start string, key bigint, h string, t bigint, keep int, pos int, node int, label string, score int, sequence_id int, range int, line string, root int, n int, __id int, __t int, __keep int, __gone int, __score int, __letters int, __lang_pred int, __class int, sig int, salt int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    width = CLASH.count(",") + 1
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *[None] * width) for r in rows], SCHEMA).repartition(3)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Exact and near copies, shared passages and lines, and all that is odd."""
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, " 日本 <|endoftext|> İ ß\x85x"), (4, "one two"), (5, "ONE two"), (6, "x" * 3000), (7, "A b\n" * 400)]
    base = [prose(rnd, 120) for _ in range(6)]
    for i in range(8, 60):
        words = rnd.choice(base).split()
        kind = i % 5
        if kind == 0:
            words[rnd.randrange(len(words))] = "changed"
        elif kind == 1:
            words = prose(rnd, 30).split() + words[10:80] + prose(rnd, 20).split()
        elif kind == 2:
            words = prose(rnd, 200).split()
        elif kind == 3:
            words = words[: rnd.randint(1, 120)]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))))
    rows += [(60, prose(rnd, 9000)), (70, rows[20][1]), (70, rows[20][1]), (71, rows[21][1]), (71, rows[22][1])]
    return rows


def distinct_ids(rows):
    return [r for r in rows if r[0] < 70]


@pytest.fixture(scope="module")
def library():
    return TextEncoder().tok


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_automaton_equals_the_library(spark, mixed, library):
    rnd = random.Random(2)
    odd = ["don't STOP'LL 's 'sx", "İstanbul ΣΑΣ ſ ŉ ǅ ẞ", "a<|startoftext|>b<|endoftext|>", "é ç ẛ̣", "😀😀 ½ ٣ _a__b", "\x00\x1c\x7f"]
    odd += ["".join(rnd.choice("abth’' \néÉΣσς<|>o½1") for _ in range(rnd.randrange(40))) for _ in range(300)]
    rows = mixed + [(1000 + i, t) for i, t in enumerate(odd)]
    want = sorted((k, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for k, t in [(r[0], r[1]) for r in rows] for i in [ids_of(library, t)])
    assert sorted(map(tuple, bpe_automaton.digests(table(spark, rows)).collect())) == want
    one = bpe_automaton.encode(table(spark, [(1, "the thing")])).first()
    assert np.frombuffer(one["ids"], "<u2").tolist() == ids_of(library, "the thing") and one["decoded"] == "the</w> thing</w>"


def test_automaton_construction():
    """Every string over a small alphabet, against merging in order, with repeated letters and nested merges."""
    merges = [("a", "a"), ("a", "b</w>"), ("aa", "a"), ("b", "a"), ("aa", "b</w>"), ("ba", "ba"), ("ba", "b</w>"), ("aaa", "aa")]
    symbols = ["a", "b", "a</w>", "b</w>"] + [x + y for x, y in merges]
    vocab = {s: i for i, s in enumerate(dict.fromkeys(symbols))}
    m = bpe_automaton.MergeAutomaton(vocab, merges, "</w>")

    def slow(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for x, y in merges:
            out, i = [], 0
            while i < len(parts):
                hit = i + 1 < len(parts) and (parts[i], parts[i + 1]) == (x, y)
                out.append(x + y if hit else parts[i])
                i += 1 + hit
            parts = out
        return [vocab[p] for p in parts]

    for n in range(1, 10):
        for letters in itertools.product("ab", repeat=n):
            assert m.encode("".join(letters)) == slow("".join(letters)), letters


def test_range_coder_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 1000, 5000):
        for ids in (rng.integers(0, 65536, n), rng.integers(0, 3, n), np.full(n, 65535), np.repeat(rng.integers(0, 49408, n // 7 + 1), 7)[:n]):
            data = range_coder.pack_segment(np.array([3]), np.array([n]), ids.astype(np.uint16), 64)
            assert np.array_equal(range_coder.unpack_segment(data)[2], ids)
        wide = rng.integers(0, 1 << 32, n) if n % 2 else rng.integers(0, 200_000, n)
        assert np.array_equal(range_coder.unpack_segment(range_coder.pack_segment(np.array([3]), np.array([n]), wide, 64))[2], wide)
    text = np.tile(rng.integers(0, 49408, 50), 100).astype(np.uint16)
    data = bytearray(range_coder.pack_segment(np.array([3]), np.array([5000]), text))
    assert len(data) < 5000
    for at in (2, 30, len(data) - 100):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(range_coder.CorruptBlock):
            range_coder.unpack_segment(bytes(broken))


def test_token_files(spark, mixed, library, tmp_path):
    rows = distinct_ids(mixed) + [(None, "null id"), (70, "b"), (70, "a")]
    path = str(tmp_path / "ids")
    token_files.write(table(spark, rows), path, block=64, segment=500)
    got = token_files.read(spark, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    start, want = 0, []
    for key, text in order:
        ids = ids_of(library, text) + [2]
        want.append((key, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=lambda r: r[1]) == want
    digests = token_files.digests(table(spark, rows)).collect()
    assert sorted((r["start"], r["ids_crc32"]) for r in digests) == [(w[1], zlib.crc32(w[3])) for w in want]
    assert token_files.digests(table(spark, [])).count() == 0


def test_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(50):
        size = rnd.choice([7, 16, 100])
        lengths = sorted((rnd.randint(1, size) for _ in range(rnd.randint(0, 60))), reverse=True)
        open_, want = [], []
        for n in lengths:
            fits = [(left, w) for w, left in enumerate(open_) if left >= n]
            want.append(min(fits)[0] if fits else size)
            if fits:
                open_[min(fits)[1]] -= n
            else:
                open_.append(size - n)
        got = packing.best_fit_decreasing(lengths, size)
        assert [size - o for _, o in got] == want
        assert max([w for w, _ in got], default=-1) + 1 == len(open_)


def test_packing(spark, mixed, library):
    rows = mixed + [(None, "null id")]
    got = packing.pack(table(spark, rows), group=40).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        want = []
        for text in texts[key]:
            ids = np.array(ids_of(library, text) + [2], "<u4")
            want += [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == sorted(want)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.pack(table(spark, [])).count() == 0


def test_language_id(spark):
    rnd = random.Random(3)
    letters = {"xx": "abcdefgh", "yy": "nopqrstu", "zz": "éàüßñöç"}
    text = lambda k: " ".join("".join(rnd.choice(letters[k]) for _ in range(5)) for _ in range(rnd.randint(3, 40)))
    rows = [(i, text(k), k) for i in range(120) for k in [rnd.choice(list(letters))]]
    truth = {r[0]: r[2] for r in rows}
    rows += [(200, None, "xx"), (201, "", "xx"), (202, "123 !? 😀", "yy"), (203, "abcabc", None), (203, "abcabc", None), (None, "nopq", "zz")]
    got = language_id.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (200, 201, 202):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in truth:
            assert r["lang_pred"] == truth[r["doc_id"]]
    kept = language_id.accept(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {*truth, 203, None}
    assert [r["lang_pred"] for r in language_id.identify(table(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert language_id.identify(table(spark, [])).count() == 0


def test_language_id_brute_force(spark):
    """Prototypes, cosines and the largest of them recomputed letter by letter, from the definition, for texts whose languages share letters."""
    rnd = random.Random(17)
    base, width = language_id.letter_vectors().astype(np.int64), language_id.GRAM
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 30]))), k) for i in range(90) for k, words in [rnd.choice([("l1", ["tarn", "vel", "ost", "in"]), ("l2", ["nart", "lev", "ost", "an"]), ("l3", ["rant", "tso", "İnéz", "vel"])])]]
    rows += [(100, "Ωμέγα стол 日本語", None), (101, "x" * 500, None), (102, "tarn-vel, ost", "l2")]
    # many distinct n-grams: memory of vectors starts anew, blocks are summed
    rows += [(103, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéßøжψ ") for _ in range(30000)), "l3")]

    def profile(text):
        slots = [int(language_id._letter_table_of(c)) for c in text]
        runs = [0] + [s for i, s in enumerate(slots) if s or i == 0 or slots[i - 1]] + [0]
        out = np.zeros(language_id.DIMENSIONS, np.int64)
        for i in range(len(runs) - width + 1):
            bound = np.ones(language_id.DIMENSIONS, np.int64)
            for k in range(width):
                bound *= np.roll(base[runs[i + k]], width - 1 - k)
            out += bound
        return out

    prototypes = {}
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 4 != 2:
            prototypes[k] = prototypes.get(k, 0) + profile(t)
    got = {r["doc_id"]: r for r in language_id.identify(table(spark, rows)).collect()}
    for i, t, _ in rows:
        p = profile(t)
        cos = {k: float(p @ v / np.sqrt(float(p @ p) * float(v @ v))) for k, v in prototypes.items()}
        best = max(cos.values())
        assert abs(got[i]["score"] - min(1, max(0, best))) < 1e-4, i
        assert cos[got[i]["lang_pred"]] > best - 1e-4


def test_unlearned_language(spark):
    """Texts in a language without labelled rows are rejected, all labelled ones stay; languages share letters and some syllables."""
    rnd = random.Random(11)
    sounds = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
    syllables = {k: rnd.sample(sounds, 30) for k in ("aa", "bb", "cc", "dd", "no")}
    text = lambda k, n: " ".join("".join(rnd.choice(syllables[k]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, rnd.choice([10, 40, 150])), k) for i in range(320) for k in ["aa", "bb", "cc", "dd"][i % 4 : i % 4 + 1]]
    rows += [(1000 + i, text("no", 150), None) for i in range(20)]
    kept = {r["doc_id"] for r in language_id.accept(table(spark, rows)).collect()}
    assert {r[0] for r in rows if r[2]} <= kept and not {r[0] for r in rows if not r[2]} & kept
    scores = [r["score"] for r in language_id.identify(table(spark, rows)).collect() if r["doc_id"] >= 1000]
    assert min(scores) > language_id.ACCEPT_SCORE  # a fixed bar on the cosine lets them through


def test_profiles_are_cosines_of_bundles():
    base = language_id.letter_vectors()
    code, n = language_id.grams("ab")
    assert n == 2
    want = np.zeros(language_id.DIMENSIONS)
    for a, b, c in ((0, 1, 2), (1, 2, 0)):
        want += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    assert np.array_equal(language_id.gram_vectors(code).sum(0), want)


def brute_lines(rows, fuzzy_chars=line_dedup.FUZZY_CHARS):
    """Lines removed from each (doc_id, text), by definition."""
    rows = list(dict.fromkeys(rows))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    assert len({r[0] for r in rows}) == len(rows)
    first, out = {}, {}

    def near(a, b):
        if min(len(a), len(b)) < fuzzy_chars or abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    lines = [(k, i, x) for k, t in order for i, x in enumerate([] if t is None else t.split("\n"))]
    for k, i, x in lines:
        first.setdefault(x, (k is None, k or 0, i))
    for k, i, x in lines:
        gone = bool(x.strip(" \t\n\r\x0b\x0c")) and (first[x] < (k is None, k or 0, i) or any(first[y] < first[x] and near(x, y) for y in first if y.strip()))
        out.setdefault(k, []).append((x, gone))
    return {k: [x for x, g in out.get(k, []) if not g] for k, _ in order}, {k: sum(g for _, g in out.get(k, [])) for k, _ in order}


def test_line_dedup(spark, mixed):
    rnd = random.Random(9)
    rows = [(r[0], r[1]) for r in distinct_ids(mixed)]
    lines = [prose(rnd, n) for n in (6, 8, 20, 60, 300)]
    for i in range(100, 160):  # substitutions, insertions, deletions at any place, in lines of several lengths
        x = list(rnd.choice(lines))
        for _ in range(rnd.choice([1, 1, 1, 2])):
            p = rnd.randrange(len(x))
            x[p : p + rnd.randint(0, 1)] = rnd.choice(["", "q", "é", "z"])
        rows.append((i, "".join(x) + "\n" + rnd.choice(["", " ", "short one", "shorx one", prose(rnd, 9)])))
    rows += [(160, "aaaaaaaaaaaaaaaaaaaaaaaaa"), (161, "aaaaaaaaaaaaaaaaaaaaaaaaaa"), (162, "aaaaaaaaaaaaaaaaaaaaaaaab"), (None, lines[2])]
    kept, gone = brute_lines(rows)
    got = line_dedup.digests(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_removed"] == gone[r["doc_id"]], r
        assert r["kept_sha256"] == hashlib.sha256("\n".join(kept[r["doc_id"]]).encode()).hexdigest()
    assert sum(gone.values()) > 60
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup(table(spark, rows)).collect()}
    for k, t in rows:
        if t is None or not gone[k]:
            assert texts[k] == (t, None if t is None else len(t))
        elif any(x.strip() for x in kept[k]):
            assert texts[k][0] == "\n".join(kept[k]) and texts[k][1] == len(texts[k][0])
        else:
            assert k not in texts
    kept, gone = brute_lines(rows, 1)
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.digests(table(spark, rows), 1).collect()} == gone
    assert line_dedup.digests(table(spark, [])).count() == 0
    twice = line_dedup.digests(table(spark, [(1, "same\nline"), (1, "same\nline"), (2, "line")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in twice) == [(1, 0), (1, 0), (2, 1)]


def test_line_dedup_is_native(spark, mixed):
    plan = line_dedup.digests(table(spark, mixed))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_sets(rows, width):
    out = []
    for k, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((k, frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()))
    return out


def brute_classes(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        r = find(i)
        least[r] = min(k, least.get(r, k))
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, mixed, width, percent):
    rnd = random.Random(width)
    rows = [(r[0], r[1]) for r in mixed]
    for i in range(100, 180):  # chains of small edits, so that components are larger than links
        words = (rows[-1][1] or "a").split() if i % 10 else prose(rnd, rnd.choice([3, 5, 12, 40, 150])).split()
        words[rnd.randrange(len(words))] = f"e{i}"
        rows.append((i, " ".join(words)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.classes(table(spark, rows), width, percent).collect())
    want = brute_classes(brute_sets(rows, width), percent)
    assert got == want
    kept = {r["doc_id"] for r in ngram_join.keep_first(table(spark, rows), width, percent).collect()}
    assert kept == {k for k, n, c in want if k == c or not n}
    assert ngram_join.classes(table(spark, []), width, percent).count() == 0


def test_ngram_join_frequent_signatures(spark, monkeypatch):
    """A passage that all documents share makes its signatures frequent; pairs at the threshold are still found where sets do without some of them."""
    monkeypatch.setattr(ngram_join, "PAIRS_EACH", 2)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    rnd = random.Random(21)
    passage, rows = prose(rnd, 90).split(), []
    for i in range(60):
        words = prose(rnd, rnd.choice([8, 16, 24, 40])).split() + passage
        rows.append((3 * i, " ".join(words)))
        for k in (1, 2):  # one or two words changed: just about the threshold
            edited = list(words)
            for at in rnd.sample(range(len(words)), rnd.choice([1, 2, 3])):
                edited[at] = f"e{i}x{at}"
            rows.append((3 * i + k, " ".join(edited)))
    want = brute_classes(brute_sets(rows, 5), 80)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.classes(table(spark, rows), 5, 80).collect())
    assert got == want and 20 < len({c for _, _, c in want}) < 170


def test_ngram_join_null_ids(spark):
    """Rows with a null doc_id link others: as copies of a set that has near copies, and as the only row of a set between two others."""
    rnd, last = random.Random(2), 10**9
    words = [prose(rnd, 100).split() for _ in range(4)]
    edit = lambda w, *at: " ".join(f"e{i}" if i in at else x for i, x in enumerate(w))
    rows = [(None, edit(words[0])), (1, edit(words[0])), (2, edit(words[0], 50)), (None, edit(words[0]))]
    rows += [(3, edit(words[1], 10)), (None, edit(words[1], 10, 99)), (4, edit(words[1], 10, 99, 0)), (5, edit(words[1], 0, 10, 60, 99))]
    rows += [(None, edit(words[2])), (None, edit(words[2], 1)), (6, edit(words[3]))]
    sets = [(last if k is None else k, s) for k, s in brute_sets(rows, 4)]
    want = brute_classes(sets, 85)
    got = ngram_join.classes(table(spark, rows), 4, 85).collect()
    assert sorted((last if r["doc_id"] is None else r["doc_id"], r["n_shingles"], last if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert {c for k, _, c in want if k in (1, 2)} == {1}
    kept = ngram_join.keep_first(table(spark, rows), 4, 85).collect()
    assert sorted(last if r["doc_id"] is None else r["doc_id"] for r in kept) == sorted(k for k, _, c in want if k == c or k == last)


def test_signatures_meet():
    """Any two sets at the threshold share a signature, for sizes from 1 on."""
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        for n in [*range(1, 60), 100, 333, 1000]:
            base = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
            for extra in range(n + 1):
                lost = 0
                while 100 * (n - lost) >= percent * (n + extra):
                    lost += 1
                lost -= 1
                if lost < 0:
                    break
                if lost == extra == 0:
                    continue  # equal sets are one node
                a, b = base[:n], np.concatenate([base[lost:n], base[n : n + extra]])
                assert np.intersect1d(ngram_join.signatures(np.sort(a), percent)[0], ngram_join.signatures(np.sort(b), percent)[0]).size, (percent, n, extra)


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randint(100, 300), rnd.randint(100, 300)) for _ in range(150)] + [(400, 400 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_passages(rows, width=50):
    first = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            first[x] = min(k, first.get(x, k))
    out = []
    for k, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        out.append((k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, mixed):
    rows = [(r[0], r[1]) for r in mixed]
    got = sorted(map(tuple, substring_dedup.digests(table(spark, rows)).collect()))
    want = brute_passages(rows)
    assert got == want and sum(w[2] for w in want) > 500
    kept = substring_dedup.remove(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    counts = collections.Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in kept.collect())
    assert counts == collections.Counter((k, n - g) for k, n, g, _ in want if not n or g < n)
    assert substring_dedup.digests(table(spark, [])).count() == 0
    nulls = substring_dedup.digests(table(spark, [(None, "w " * 60), (None, "w " * 60)])).collect()
    assert [r["n_removed"] for r in nulls] == [0, 0]


def test_full_sketch_loses_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDTH_BITS", (4, 4))
    rows = [(r[0], r[1]) for r in mixed]
    assert sorted(map(tuple, substring_dedup.digests(table(spark, rows)).collect())) == brute_passages(rows)


def test_sketch_grows_with_the_anchors(spark, monkeypatch):
    """With counters for a few anchors only, and in several passes, windows that do not repeat still stay out."""
    rnd = random.Random(11)
    rows = [(i, prose(rnd, 100)) for i in range(300)]
    rows += [(300 + i, prose(rnd, 20) + " " + " ".join(rows[i][1].split()[:70])) for i in range(10)]
    sizes = {}
    monkeypatch.setattr(substring_dedup, "WIDTH_BITS", (4, 8))
    monkeypatch.setattr(substring_dedup, "saved", lambda df, label, keep=substring_dedup.saved: [out := keep(df, label), sizes.update({label: out.count()})][0])
    for size in (1 << 20, 64):
        monkeypatch.setattr(substring_dedup, "FILTER_BYTES", size, raising=False)
        assert sorted(map(tuple, substring_dedup.digests(table(spark, rows)).collect())) == brute_passages(rows)
        assert 2 * 10 * 21 <= sizes["windows"] < 2000  # of 15510


def test_one_full_sketch_loses_nothing(spark, mixed, monkeypatch):
    """All anchors in one shard of 16 counters a row."""
    monkeypatch.setattr(substring_dedup, "WIDTH_BITS", (4, 4))
    monkeypatch.setattr(substring_dedup, "LOAD", 1e-6)
    rows = [(r[0], r[1]) for r in mixed]
    assert sorted(map(tuple, substring_dedup.digests(table(spark, rows)).collect())) == brute_passages(rows)


def naive_syncmers(text):
    """Hash and first place of every k-mer whose smallest inner s-mer is its first or last one."""
    h = lambda x: int(rolling(mix(np.array([ord(c) + 1 for c in x], np.uint64)), len(x), syncmers.BASE)[0])
    out = {}
    for p in range(len(text) - syncmers.K + 1):
        kmer = text[p : p + syncmers.K]
        inner = [h(kmer[i : i + syncmers.S]) for i in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(h(kmer), p)
    return out


def naive_likeness(a, b):
    """By definition, with the longest chain by quadratic dynamic programming; a and b are texts."""
    x, y = (dict(zip(*syncmers.anchors(t))) for t in (a, b))
    if x == y:
        return 1.0
    full = lambda z: max(max(z), syncmers.SHARE) if len(z) >= syncmers.KEEP else 1 << 64
    if not x or not y:
        return 0.0
    top = min(full(x), full(y))
    both = sorted((x[h], y[h]) for h in x if h in y and h <= top)
    best = []
    for i, (_, q) in enumerate(both):
        best.append(1 + max((best[j] for j in range(i) if both[j][1] < q), default=0))
    return max(best, default=0) / len({h for h in [*x, *y] if h <= top})


def test_closed_syncmers():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcd é") for _ in range(400))
    for sample, least in ((text, syncmers.KEEP), (prose(rnd, 4000), syncmers.KEEP + 1)):
        closed = naive_syncmers(sample)
        order = sorted(closed)
        want = {h: closed[h] for i, h in enumerate(order) if i < syncmers.KEEP or h <= syncmers.SHARE}
        found = dict(zip(*syncmers.anchors(sample)))
        assert found == want and len(found) >= least and list(found) == sorted(found)
    # context-free: the same k-mers are chosen wherever they stand
    assert set(naive_syncmers("prefix " + text)) >= set(naive_syncmers(text))
    assert syncmers.from_text(syncmers.as_text(syncmers.anchors(text))) == syncmers.anchors(text)
    assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(text)) == 1
    assert syncmers.likeness(syncmers.anchors(""), syncmers.anchors("")) == 1 and syncmers.likeness(syncmers.anchors(""), syncmers.anchors(text)) == 0
    backwards = " ".join(reversed([text[i : i + 50] for i in range(0, 400, 50)]))
    assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(backwards)) < 0.5


def test_fingerprints(spark, mixed):
    rows = [(r[0], r[1]) for r in distinct_ids(mixed)] + [(None, "no id"), (90, "b" * 40), (90, "a" * 40)]
    got = syncmers.edited(table(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (k, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = map(syncmers.anchors, (t, e, nxt))
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), syncmers.as_text(a), syncmers.as_text(b), naive_likeness(t, e), naive_likeness(t, nxt)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert syncmers.edited(table(spark, [])).count() == 0
    alone = syncmers.edited(table(spark, [(5, "only one text here, twice")])).first()
    assert alone["near_next"] == 1.0
    assert syncmers.fingerprints(table(spark, rows)).count() == len(rows)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 70)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=40).astype("float32")], 0) for i in range(300)]
    rows[7] = (7, [0.0] * 40, 0)
    rows += [(400, None, 1), (401, [None] + [1.0] * 39, 1), (402, [float("nan")] * 40, 1), (403, [float("inf")] * 40, 1), (404, rows[5][1], 1), (405, rows[5][1], 2), (None, rows[5][1], 0), (406, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("c", F.lit(1)).withColumn("q", F.lit(1))
    vecs = {k: np.pad(np.floor(64 * np.array(v)).astype(int), (0, 40 - len(v))) for k, v, _ in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in vecs:
        if q % 20 == 0:
            best = sorted((-int(vecs[q] @ v), k) for k, v in vecs.items() if k != q)[:20]
            want += [(q, r, k, -s) for r, (s, k) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.search(df).collect())) == sorted(want)
    large = [(0, [1e300, 1.0]), (1, [1e300, -3.0]), (2, [-1e300, 0.5]), (20, [4e7] * 2), (3, [1.7e308, -1.7e308]), (40, [0.5, 2.0**55]), (20, [4e7] * 2)]
    exact = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in large}
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = [(q, r, i, -s) for q in (0, 20, 40) for r, (s, i) in enumerate(sorted((-cut(sum(x * y for x, y in zip(exact[q], exact[i]))), i) for i, _ in large if i != q)[:20], 1)]
    assert sorted(map(tuple, topk.search(spark.createDataFrame(large, "vec_id bigint, embedding array<double>")).collect())) == sorted(want)
    few = topk.search(df.filter("vec_id in (20, 21, 22)")).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(20, 1), (20, 2)]
    assert topk.search(df.limit(0)).count() == 0


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/x", "plain words"), ("a/b/y", "some text\n" + apache + "\n" + "more words " * 20), ("a/b/c/z", None), ("d/w", ""), ("top", "nothing"), (None, mit), ("a/b/c/LICENSE", apache), ("a/x", "plain words"), ("e/f", "the license of the version")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, text string, doc_id bigint").withColumn("home", F.lit(1)).withColumn("dir", F.lit(2))
    got = {r["doc_id"]: (r["own_license"], r["kind"], r["license"], r["inherited_from"]) for r in licenses.scan(df, keys=("doc_id",)).collect()}
    assert got == {
        0: ("MIT", "file", "MIT", None), 1: (None, "none", "MIT", "a"), 2: ("Apache-2.0", "header", "Apache-2.0", None), 3: (None, "none", "Apache-2.0", "a/b/c"), 4: (None, "none", None, None),
        5: (None, "none", None, None), 6: ("MIT", "file", "MIT", None), 7: ("Apache-2.0", "file", "Apache-2.0", None), 8: (None, "none", "MIT", "a"), 9: (None, "none", None, None),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_cosines_brute_force(spark):
    """The best cosine over all blocks of lines and all templates, recomputed by definition."""
    rnd = random.Random(23)
    short = [(name, licenses.words(t)) for name, t in licenses.TEMPLATES if len(licenses.words(t)) < licenses.LONG]
    rows = []
    for i in range(90):
        lines = [prose(rnd, rnd.randint(1, 9)) for _ in range(rnd.randint(0, 4))]
        name, words = rnd.choice(short)
        words = words[:120]
        for _ in range(rnd.choice([0, 0, 3, 12, 30])):
            words = [w for w in words if rnd.random() > 0.1] + [rnd.choice(["noise", "the", "software", "license"])] * rnd.randint(0, 2)
        stated = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        at = rnd.randint(0, len(lines))
        rows.append((i, f"d{i}/f", "\n".join(lines[:at] + stated + lines[at:])))
    rows += [(90, "x/f", None), (91, "y/f", ""), (92, "z/f", "license " * 50)]
    texts = [[licenses.words(x) for x in (t or "").split("\n")] for _, _, t in rows]
    df = collections.Counter(w for lines in texts for w in {w for x in lines for w in x})
    known = {w for _, t in licenses.TEMPLATES for w in licenses.words(t)}
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1 if w in known else math.log(1 + len(rows)) + 1

    def vector(words):
        v = {w: c * idf(w) for w, c in collections.Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    templates = [(name, len(words), vector(words)) for name, words in short]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string"), keys=("doc_id",)).collect()}
    exact = hits = 0
    for (i, _, _), lines in zip(rows, texts):
        best = {}
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                words = [w for x in lines[a:z] for w in x]
                block = vector(words)
                for name, size, v in templates:
                    if z == a + 1 or len(words) <= licenses.REACH * size:
                        best[name] = max(best.get(name, 0.0), sum(x * v.get(w, 0.0) for w, x in block.items()))
        top = max(best.values(), default=0.0)
        if top < licenses.HEADER:
            assert got[i]["own_license"] is None and got[i]["own_licenses"] == [], i
        else:
            own = got[i]["own_license"]
            assert abs(got[i]["score"] - min(1.0, best[own])) < 1e-9, i
            exact += best[own] > top - 1e-9  # a statement that is a part of a longer one of another licence does not count beside it
            hits += 1
    assert hits - exact <= 2 and exact > 20
    assert 20 < sum(r["own_license"] is not None for r in got.values()) < 85


def wrapped(text, prefix=""):
    return "\n".join(prefix + x for x in textwrap.wrap(text, 76))


def test_license_blocks(spark):
    """Licences over several lines, as files have them; several in one file; bodies of which no line is near."""
    body = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name, _ in licenses.TEMPLATES}
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and "WARRANTIES" in t and len(t) < 900)
    code = "\n".join("value = compute(alpha, beta)  # line %d of a module" % i for i in range(60))
    mit = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrapped(body["MIT"])
    rows = [
        ("m/LICENSE", mit), ("m/src/x", code), ("two/LICENSE", mit + "\n\n" + wrapped(apache)), ("two/y", "plain"), ("h/z", wrapped(apache, "# ") + "\n" + code),
        ("b3/LICENSE", "Copyright 2021, X. All rights reserved.\n" + wrapped(body["BSD-3-Clause"])), ("b2/LICENSE", wrapped(body["BSD-2-Clause"])), ("i/LICENSE", wrapped(body["ISC"])),
        ("whole/COPYING", body["GPL-3.0"]), ("whole/LICENSE", mit + "\n" + body["Apache-2.0"]), ("s/q", "// SPDX-License-Identifier: MIT OR Apache-2.0\n" + code), ("n/x", code), ("gnu/x", wrapped(next(t for n, t in licenses.TEMPLATES if n == "LGPL-2.1"), " * ") + "\n" + code),
    ]
    rows += [(f"prose/{i}", prose(random.Random(i), 300) + "\nthe use of this software and the license of the work") for i in range(40)]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    of = lambda p: (sorted(got[p]["own_licenses"]), got[p]["kind"])
    assert of("m/LICENSE") == (["MIT"], "file") and (got["m/src/x"]["license"], got["m/src/x"]["licenses"], got["m/src/x"]["inherited_from"]) == ("MIT", ["MIT"], "m")
    assert of("two/LICENSE") == (["Apache-2.0", "MIT"], "file") and sorted(got["two/y"]["licenses"]) == ["Apache-2.0", "MIT"]
    assert of("h/z") == (["Apache-2.0"], "header") and of("b3/LICENSE") == (["BSD-3-Clause"], "file") and of("b2/LICENSE") == (["BSD-2-Clause"], "file") and of("i/LICENSE") == (["ISC"], "file")
    assert got["whole/COPYING"]["own_license"] == "GPL-3.0" and got["whole/COPYING"]["kind"] == "file" and {"MIT", "Apache-2.0"} <= {*got["whole/LICENSE"]["own_licenses"]}
    assert of("s/q") == (["Apache-2.0", "MIT"], "header") and of("gnu/x") == (["LGPL-2.1"], "header")
    assert all(got[p]["own_license"] is None and got[p]["licenses"] == [] for p in ("n/x", *(f"prose/{i}" for i in range(40))))


def test_pipeline_stages(spark, mixed):
    import corpus_pipeline

    rows = [(r[0], r[1], "en") for r in mixed]
    docs, columns = table(spark, rows), table(spark, rows).columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, "unused").collect(), SCHEMA)
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} <= before, name
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(w[2] == 0 for w in brute_passages(left))
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "unused").collect()} == {k for k, _ in left}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), "unused").count() == 0


def test_word_hashes():
    from tessera.llm.common import word_hashes

    rnd = random.Random(1)
    for n in (0, 1, 5, 200, 60000):
        raw = b"".join(rnd.choice([b"a", b"b", b" ", b"\t", b"\x0b", b"\xc3\xa9", b"x" * 600, b"\x1c"]) for _ in range(n))
        words = raw.split()
        hashes = word_hashes(raw).tolist()
        assert len(hashes) == len(words)
        assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    assert word_hashes(b"y " * 300000 + b"z" * 900000).tolist()[::150000] == [word_hashes(b"y")[0]] * 2 + [word_hashes(b"z" * 900000)[0]]
    assert ngram_join.differing(ngram_join.parity(np.arange(500, dtype=np.uint64)), ngram_join.parity(np.arange(40, 520, dtype=np.uint64))) <= 60

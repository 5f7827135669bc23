"""Token ids of whole texts under a word-level BPE vocabulary, exactly as the tokenizers library gives them.

The vocabularies handled here drop white space and never merge across their
pre-split words, so ids of a text are the ids of its words.  Texts of plain
characters are lower-cased and split as bytes, all texts of a batch at once;
each distinct word is encoded once and remembered.  Any other text goes through
the library's own normalizer and splitter.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

#: The vocabulary of the registered queries; a path is taken as it is.
DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Words, unless the caller says how many, and ids remembered at most; beyond that the memory starts anew.
MEMORY = 400_000
ARENA = 1 << 23
#: New words that are encoded at once.
TOGETHER = 1 << 16
#: Bytes up to which a word is told by its bytes, longer ones by a 120-bit hash.
SHORT = 16

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _kinds() -> np.ndarray:
    """Kind of each byte of lower-cased plain text; bytes of two-byte characters are letters."""
    out = np.full(256, _ODD, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[33:127] = _OTHER
    out[[*range(97, 123), *range(65, 91), *range(128, 256)]] = _LETTER
    out[48:58] = _DIGIT
    return out


def _lower() -> np.ndarray:
    """Lower case of the accented Latin letters U+00C0 to U+017F, on which NFC is the identity; 0 for what is no letter or turns into two (U+0130)."""
    out = np.zeros(0x180, np.int64)
    for c in range(0xC0, 0x180):
        low = chr(c).lower()
        if chr(c).isalpha() and len(low) == 1 and 0xC0 <= ord(low) < 0x180:
            out[c] = ord(low)
    return out


_KIND, _LOWER = _kinds(), _lower()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ONE = np.zeros(256, bool)
_ONE[list(b"stmd")] = True


def vocabulary_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, whether a text is not plain, start and size of each word) of texts that lie side by side.

    A text that is not plain is blanked, so it has no words here.  data has at
    least four zero bytes behind the last text.
    """
    n = int(offsets[-1])
    data = _FOLD.take(data)
    bad = np.flatnonzero(_KIND.take(data[:n]) == _ODD)
    lead = np.flatnonzero(data[:n] >= 0xC0)
    code = ((data[lead].astype(np.int64) - 0xC0) << 6) | (data[lead + 1] & 0x3F)
    low = np.where(code < 0x180, _LOWER.take(code, mode="clip"), 0)
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.append(bad, lead[low == 0]), side="right") - 1] = True
    data[lead], data[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
    for k in np.flatnonzero(odd).tolist():
        data[offsets[k] : offsets[k + 1]] = 0x20
    kind = _KIND.take(data)
    edge, opens = kind == _DIGIT, np.zeros(len(data), bool)
    edge[1:] |= kind[1:] != kind[:-1]
    opens[offsets] = True
    edge |= opens
    q = np.flatnonzero(data[:n] == 0x27)
    if len(q):  # an apostrophe that opens a word takes s, t, m, d, re, ve or ll with it
        q = q[((kind[q - 1] != _OTHER) | opens[q]) & ~opens[q + 1]]
        x, y = data[q + 1], data[q + 2]
        one = _ONE[x]
        two = ((((x == 0x72) | (x == 0x76)) & (y == 0x65)) | ((x == 0x6C) & (y == 0x6C))) & ~opens[q + 2]
        edge[q[one | two] + 1] = False
        edge[q[one] + 2] = True
        edge[q[two] + 3] = True
    at = np.flatnonzero(edge[: n + 1])
    start, size = at[:-1], np.diff(at)
    keep = kind[start] != _SPACE
    return data, odd, start[keep], size[keep]


def _keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell words apart: their bytes, or a hash, which has a zero byte where short words have none."""
    words = data.view(np.uint64)

    def eight(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        k, s = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (words.take(k) >> s | (words.take(k + 1) << np.uint64(1)) << (np.uint64(63) - s)) & _MASK.take(n, mode="clip")

    a, b = eight(start, size), np.zeros(len(start), np.uint64)
    second = np.flatnonzero(size > 8)
    b[second] = eight(start[second] + 8, size[second] - 8)
    for i in np.flatnonzero(size > SHORT).tolist():
        h = xxhash.xxh3_128_intdigest(data[start[i] : start[i] + size[i]].tobytes())
        a[i], b[i] = h >> 64, h & 0xFFFFFFFFFFFFFF00 | 0x100
    return a, b


class TextEncoder:
    """Ids of texts.  `engine` encodes distinct words: the library, or the automaton of bpe_automaton.  `memory`: words remembered at most."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, engine: Callable | None = None, memory: int = MEMORY):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary_path(vocabulary)
        self.tok, self._lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tok in (self.tok, self._lines):
            tok.no_truncation()
            tok.no_padding()
        # for words that are normalized and split, one a line
        self._lines.normalizer = None
        self._lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], json.dumps(spec["pre_tokenizer"])
        if model["type"] != "BPE" or '"Removed"' not in pre or '"ByteLevel"' not in pre or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a word-level BPE vocabulary that drops white space")
        self.suffix = model["end_of_word_suffix"]
        self.vocab, self.merges = model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.labels = [""] * self.size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.labels[i] = text
        self._ends = np.zeros(self.size, bool)
        self._ends[[i for t, i in self.vocab.items() if t.endswith(self.suffix)]] = True
        self._byte_of = {c: b for b, c in enumerate(byte_letters())}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.memory, self._bits = memory, int(memory * 1.3).bit_length()  # of the slots' number
        self.forget()
        self.engine = engine(self) if engine else None

    def forget(self) -> None:
        """Drop the remembered words: (keys, place in the arena of ids, ids) in buckets of two slots."""
        slots = 1 << self._bits
        self._a, self._b = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self._at, self._n = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self._arena, self._used, self._held = np.empty(1 << 16, self.dtype), 0, 0

    def _encode_words(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of distinct words, each with a byte of its own behind it."""
        if self.engine:
            return self.engine.encode_words(text, np.cumsum(size + 1) - size - 1, size)
        text[np.cumsum(size + 1) - 1] = 10
        lines = text.tobytes().decode()
        found = np.array(self._lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self._ends[found]) + 1
        if len(cuts) == len(size):
            return found, np.diff(cuts, prepend=0)
        rows = [self.tok.encode(w, add_special_tokens=False).ids for w in lines.split("\n")[:-1]]  # a word that is not one unit for the library
        return np.array([i for r in rows for i in r], self.dtype), np.array([len(r) for r in rows])

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the arena, number of ids) of words that are told apart by a and b; as many as fit are remembered."""
        at, n = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        for i in range(0, len(start), TOGETHER):
            part = slice(i, i + TOGETHER)
            ids, count = self._encode_words(data[runs(start[part], size[part] + 1)], size[part])
            while self._used + len(ids) > len(self._arena):
                self._arena = np.concatenate([self._arena, np.empty_like(self._arena)])
            self._arena[self._used : self._used + len(ids)] = ids
            at[part], n[part] = self._used + np.cumsum(count) - count, count
            self._used += len(ids)
        self._held += len(start)
        place = np.where(self._a[slot] == 0, slot, np.where(self._a[slot ^ 1] == 0, slot ^ 1, slot))
        place, first = np.unique(place, return_index=True)
        self._a[place], self._b[place], self._at[place], self._n[place] = a[first], b[first], at[first], n[first]
        return at, n

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text with unusual characters or special tokens."""
        if not self.engine:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)
        out: list[np.ndarray] = []
        at = 0
        for m in [*self._special.finditer(text), None]:
            piece = text[at : m.start()] if m else text[at:]
            words = [bytes(map(self._byte_of.__getitem__, w)) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(piece))]
            size = np.array([len(w) for w in words], np.int64)
            out.append(self.engine.encode_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)[0].astype(self.dtype))
            if m:
                out.append(np.array([self.special[m[0]]], self.dtype))
                at = m.end()
        return np.concatenate(out)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of text i are ids[cuts[i]:cuts[i + 1]]; null counts as empty.  texts: a list or an Arrow array."""
        if self._held > self.memory or self._used > ARENA:
            self.forget()
        column = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        _, ends, body = column.buffers()
        offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = bytes(body)[offsets[0] : offsets[-1]] if body else b""
        offsets = offsets - offsets[0]
        data = np.zeros((len(raw) + 32) // 8 * 8, np.uint8)
        data[: len(raw)] = np.frombuffer(raw, np.uint8)
        data, odd, start, size = split(data, offsets)
        at, n = self._words(data, start, size)
        odd[[k for k in self._marked(raw, offsets) if k < len(odd)]] = True
        ends = np.append(0, np.cumsum(n))
        cuts = ends[np.searchsorted(start, offsets)]
        ids = self._arena[runs(at, n)]
        if odd.any():
            parts = [self._odd(column[i].as_py()) if x else ids[a:z] for i, (x, a, z) in enumerate(zip(odd.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))]
            ids, cuts = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, cuts

    def _marked(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Texts that may hold a special token."""
        found = []
        for token in self.special:
            at = raw.find(token.encode())
            while at >= 0:
                found.append(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(token.encode(), at + 1)
        return found

    def _words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the arena, number of ids) of each word."""
        a, b = _keys(data, start, size)
        h = (a ^ b * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        slot = ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - self._bits)).astype(np.int64)
        other = (self._a.take(slot) != a) | (self._b.take(slot) != b)
        slot ^= other
        at, n = self._at.take(slot).astype(np.int64), self._n.take(slot).astype(np.int64)
        maybe = np.flatnonzero(other)
        place = slot[maybe]
        new = maybe[(self._a[place] != a[maybe]) | (self._b[place] != b[maybe])]
        if len(new):
            _, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[first]
            if np.any(a[one][which] != a[new]) or np.any(b[one][which] != b[new]):  # two words with one hash
                _, first, which = np.unique(np.stack([a[new], b[new]]), axis=1, return_index=True, return_inverse=True)
                one, which = new[first], which.reshape(-1)
            places, counts = self._learn(data, start[one], size[one], a[one], b[one], slot[one])
            at[new], n[new] = places[which], counts[which]
        return at, n

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the vocabulary, labels are joined by spaces."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


_encoders: dict[tuple, TextEncoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY, engine: Callable | None = None, memory: int = MEMORY) -> TextEncoder:
    """One encoder for each worker process, which keeps its memory of words from task to task."""
    key = (vocabulary, engine, memory)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(vocabulary, engine, memory)
    return _encoders[key]

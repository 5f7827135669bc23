"""Operator 3: BPE encoding and decoding with a tokenization automaton.

The automaton reads sequences of tokens and accepts exactly the correct
tokenizations.  It starts with one state that loops on all base symbols; for
each merge (u, v) -> w in order, a merge gadget cuts the arc v out of the
state that u leads to, and adds arcs w wherever u could be read, leading where
v leads.  All arcs with one label lead to one state, so a state is a copy of
another one (its base, at a time) less the arcs cut since; the transition
table is therefore stored as copies and cuts, which keeps it linear in the
vocabulary where the plain table has |V|^2 entries.

Labels are spelled by a table too: a trie over symbols, a byte or the last byte
of a word, whose nodes name tokens.  Both are arrays.  To encode, the trie is
stepped from every place of all words at once, symbol by symbol, which gives
the arcs that could be read there; then the words go through the automaton side
by side, place by place.  Every prefix of a word has exactly one path, so each
place keeps one state, and the labels of the path that reaches the end are the
ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import batch, bounded, mix, slices
from tessera.llm.tokens import DEFAULT_VOCABULARY, TextEncoder, byte_letters, encoder, runs

#: log2 of the explored transitions kept at most.
EXPLORED_BITS = 20
#: Words up to this many bytes go side by side; a longer one alone, in blocks of as many places.
LOCKSTEP = 64
PLACES = 1 << 16
#: Symbols: a byte, or a byte that ends a word.
SYMBOLS = 512


class Table:
    """A fixed map from numbers to numbers as two arrays, for many look-ups at once; what is missing gives `missing`."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys, self.values, self.missing = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, missing, np.int64), missing
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys.take(slot)
        out = np.where(held == keys, self.values.take(slot), self.missing)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot = (slot[left] if len(slot) != len(left) else slot) + 1 & (1 << self.bits) - 1
            held = self.keys.take(slot)
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (held >= 0)
            left, slot = left[more], slot[more]
        return out


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        made = {a + b for a, b in merges}
        state_of = {i: 0 for t, i in vocab.items() if t not in made}
        born: dict[int, tuple[int, int]] = {}
        base, since, cuts = [-1], [0], [{}]

        def arc(state: int, token: int, time: int) -> bool:
            """Whether an arc with this label goes out of the state after so many merges."""
            while True:
                cut = cuts[state].get(token)
                if cut is not None and cut <= time:
                    return False
                k, u = born.get(token, (0, 0))
                if since[state] > k:  # the state is the younger: ask the one it was copied from
                    time, state = since[state], base[state]
                elif k:  # the token is the younger: its arc was made where its left part could be read
                    time, token = k, u
                else:
                    return True

        users = [len(state_of)]
        for k, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in state_of or v not in state_of or not arc(state_of[u], v, k - 1):
                continue  # earlier merges keep u and v from ever standing side by side: w has no arcs
            old = state_of[u]
            if users[old] > 1 or u == v:  # copy, then cut
                state_of[u] = len(base)
                base.append(old)
                since.append(k)
                cuts.append({v: k})
                users[old] -= 1
                users.append(1)
            else:
                cuts[old][v] = k
            state_of[w] = old if u == v else state_of[v]
            users[state_of[w]] += 1
            born[w] = (k, u)
        self._compile(vocab, suffix, len(merges), state_of, born, base, since, cuts)

    def _compile(self, vocab, suffix, end, state_of, born, base, since, cuts) -> None:
        """The automaton and the trie as arrays."""
        self._width, self._end, self.states = max(vocab.values()) + 1, end, len(base)
        self._state_of, self._born, self._left = (np.zeros(self._width, np.int64) for _ in range(3))
        self._state_of[list(state_of)] = list(state_of.values())
        for w, (k, u) in born.items():
            self._born[w], self._left[w] = k, u
        self._base, self._since = np.array(base), np.array(since)
        rows = [(s * self._width + t, k) for s, c in enumerate(cuts) for t, k in c.items()]
        self._cuts = Table(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), end + 1)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        child: dict[int, int] = {}
        label = [-1]
        for text, token in vocab.items():
            if token not in state_of:
                continue
            body = text.removesuffix(suffix)
            if any(c not in byte_of for c in body):
                continue
            spelled = [byte_of[c] for c in body]
            if body != text and spelled:
                spelled[-1] += 256
            node = 0
            for x in spelled:
                key = node * SYMBOLS + x
                if key not in child:
                    child[key] = len(label)
                    label.append(-1)
                node = child[key]
            label[node] = token
        self._child = Table(np.array(list(child), np.int64), np.array(list(child.values()), np.int64), -1)
        self._label = np.array(label)
        self._inner = np.zeros(len(label), bool)  # nodes that go on
        self._inner[[k // SYMBOLS for k in child]] = True
        self._root = np.array([child.get(x, -1) for x in range(SYMBOLS)])
        self._seen, self._open = np.full(1 << EXPLORED_BITS, -1, np.int64), np.zeros(1 << EXPLORED_BITS, bool)

    def _arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether arcs go out of states, by the copies and cuts."""
        out = np.zeros(len(state), bool)
        left, time = np.arange(len(state)), np.full(len(state), self._end)
        while len(left):
            alive = self._cuts(state * self._width + token) > time
            left, state, token, time = left[alive], state[alive], token[alive], time[alive]
            k, since = self._born.take(token), self._since.take(state)
            older, younger = since > k, (since <= k) & (k > 0)
            out[left[~older & ~younger]] = True
            time = np.where(older, since, k)
            state, token = np.where(older, self._base.take(state), state), np.where(younger, self._left.take(token), token)
            more = older | younger
            left, state, token, time = left[more], state[more], token[more], time[more]
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the arcs go out of the states in the finished automaton; explored ones are in a plain table."""
        key = state * self._width + token
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - EXPLORED_BITS)).astype(np.int64)
        new = np.flatnonzero(self._seen.take(slot) != key)
        out = self._open.take(slot)
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[first]
            found = self._arcs(state[one], token[one])
            out[new] = found[which]
            place, first = np.unique(slot[one], return_index=True)
            self._seen[place], self._open[place] = key[one][first], found[first]
        return out

    def _readable(self, symbols: np.ndarray, room: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, token) of all labels that are spelled from some places on; room: symbols from each place to its word's end."""
        found, at, node, depth = [], places, self._root.take(symbols[places]), 1
        while True:
            alive = node >= 0
            at, node = at[alive], node[alive]
            token = self._label.take(node)
            hit = np.flatnonzero(token >= 0)
            found.append((at[hit], np.full(len(hit), depth), token[hit]))
            on = self._inner.take(node) & (room.take(at) > depth)
            at, node = at[on], node[on]
            if not len(at):
                return tuple(map(np.concatenate, zip(*found)))
            node = self._child(node * SYMBOLS + symbols.take(at + depth))
            depth += 1

    def encode_words(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word): labels of the paths that spell pre-split words, given as bytes that lie one after the other in `text`."""
        ids, count = [], np.zeros(len(size), np.int64)
        if not len(size):
            return np.empty(0, np.int64), count
        symbols = text[runs(start, size)].astype(np.int64)
        ends = np.cumsum(size)
        symbols[ends[size > 0] - 1] += 256
        begin = ends - size
        back, label = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)  # of the label that ends at a place
        room = np.repeat(ends, size) - np.arange(len(symbols))
        short = np.flatnonzero(size <= LOCKSTEP)
        self._together(symbols, room, begin[short], size[short], back, label)
        for w in np.flatnonzero(size > LOCKSTEP).tolist():
            self._alone(symbols, room, int(begin[w]), int(size[w]), back, label)
        on = np.zeros(len(symbols), bool)  # places where labels of the path end
        at, first = ends[size > 0] - 1, begin[size > 0]
        if np.any(back[at] == 0):
            raise ValueError("the vocabulary lacks a byte")
        while len(at):
            on[at] = True
            at = at - back[at]
            more = at >= first
            at, first = at[more], first[more]
        ids = label[on]
        count = np.diff(np.append(0, np.cumsum(on))[np.append(0, ends)])
        return ids, count

    def _together(self, symbols, room, begin, size, back, label) -> None:
        """All words place by place."""
        places = runs(begin, size)
        if not len(places):
            return
        at, long, token = self._readable(symbols, room, places)
        depth = np.empty(len(symbols), np.int64)
        depth[places] = places - np.repeat(begin, size)
        order = np.argsort(depth[at], kind="stable")
        at, long, token = at[order], long[order], token[order]
        cuts = np.searchsorted(depth[at], np.arange(int(size.max()) + 1))
        state = np.zeros(len(symbols) + 1, np.int64)  # after the label that ends before a place
        for k in range(len(cuts) - 1):
            part = slice(cuts[k], cuts[k + 1])
            p, n, t = at[part], long[part], token[part]
            if k:  # places that no path reaches have no arcs
                reached = back.take(p - 1) > 0
                p, n, t = p[reached], n[reached], t[reached]
            ok = self.step(state.take(p) if k else np.zeros(len(p), np.int64), t)
            p, n, t = p[ok], n[ok], t[ok]
            to = p + n
            back[to - 1], label[to - 1] = n, t
            # the state at a word's start is 0 whatever word ends before it
            state[to] = self._state_of.take(t)

    def _alone(self, symbols, room, begin: int, size: int, back, label) -> None:
        """One long word; memory is bounded by PLACES."""
        state, known = {begin: 0}, {}
        for first in range(begin, begin + size, PLACES):
            at, long, token = self._readable(symbols, room, np.arange(first, min(first + PLACES, begin + size)))
            order = np.argsort(at, kind="stable")
            for p, n, t in zip(at[order].tolist(), long[order].tolist(), token[order].tolist()):
                s = state.get(p)
                if s is None:
                    continue
                ok = known.get((s, t))
                if ok is None:
                    if len(known) > PLACES:
                        known.clear()
                    ok = known[s, t] = bool(self.step(np.array([s]), np.array([t]))[0])
                if ok:
                    back[p + n - 1], label[p + n - 1] = n, t
                    state[p + n] = int(self._state_of[t])
            state = {p: s for p, s in state.items() if p >= first + PLACES}

    def encode(self, word: str) -> list[int]:
        """Ids of one word in byte letters."""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = np.array([byte_of[c] for c in word], np.uint8)
        return self.encode_words(raw, np.array([0]), np.array([len(raw)]))[0].tolist()


def automaton(enc: TextEncoder) -> MergeAutomaton:
    return MergeAutomaton(enc.vocab, enc.merges, enc.suffix)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary()), ("decoded", pa.large_string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): little-endian ids and decoded text of every document.

    A null or empty text has no ids and decodes to ''.  Repeated rows each
    give a row, an empty table gives none, a null doc_id is kept.  Other
    columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, automaton)
        for b in slices(batches):
            flat, cuts = enc.encode(b.column(1))
            rows = [flat[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield batch(SCHEMA, [b.column(0), pa.array([x.tobytes() for x in rows], pa.large_binary()), pa.array([enc.decode(x) for x in rows], pa.large_string())])

    return docs.select("doc_id", "text").transform(bounded).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """As encode(), reduced to counts and digests where the ids are made, so that no text leaves its task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, automaton)
        number = list(map(str, range(enc.size)))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches):
            flat, cuts = enc.encode(b.column(1))
            rows = [flat[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield batch(DIGESTS, [b.column(0), np.diff(cuts), [sha(" ".join(map(number.__getitem__, x.tolist()))) for x in rows], [sha(enc.decode(x)) for x in rows]])

    return docs.select("doc_id", "text").transform(bounded).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

"""Counts of many terms in one pass over each text, by an automaton with failure links.

The terms' trie is completed to one table of moves, built once and broadcast with
the function that uses it; a state knows the longest term that ends there, and by
a link the next shorter one. A place in a text depends on no more bytes before it
than the longest term has, so texts are cut into pieces that each begin that much
earlier, and all pieces of a batch take their steps together, as lanes of one
array. The work for a text doesn't grow with the number of terms.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a text in a lane, and bytes of texts that are looked at together.
LANE, TOGETHER = 1024, 4 << 20


class Automaton:
    """All occurrences of ``terms``, by bytes, also inside words and over each other."""

    def __init__(self, terms: list[str]):
        coded = [t.encode() for t in terms]
        if not all(coded):
            raise ValueError("an empty term occurs everywhere")
        letters = sorted({b for t in coded for b in t})
        self.classes = np.zeros(256, np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        trie: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, term in enumerate(coded):
            state = 0
            for c in self.classes[list(term)].tolist():
                if c not in trie[state]:
                    trie[state][c] = len(trie)
                    trie.append({})
                    ends.append(-1)
                state = trie[state][c]
            ends[state] = k
        self.width = len(letters) + 1
        moves = np.zeros((len(trie), self.width), np.int32)
        fail, shorter = [0] * len(trie), [0] * len(trie)
        for c, child in trie[0].items():
            moves[0, c] = child
        queue = deque(trie[0].values())
        while queue:
            state = queue.popleft()
            shorter[state] = fail[state] if ends[fail[state]] >= 0 else shorter[fail[state]]
            moves[state] = moves[fail[state]]
            for c, child in trie[state].items():
                fail[child] = int(moves[fail[state], c])
                moves[state, c] = child
                queue.append(child)
        self.moves, self.ends, self.shorter = moves.ravel(), np.array(ends), np.array(shorter)
        self.told = (self.ends >= 0) | (self.shorter > 0)
        self.sizes = np.array([len(t) for t in coded], np.int64)
        #: Terms that can overlap themselves: they begin as they end.
        self.bordered = np.array([any(t[:k] == t[-k:] for k in range(1, len(t))) for t in coded], bool)

    def found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and end of each occurrence; texts lie one behind the other in ``data``, ``ends`` has where each ends."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        lanes = -(-(ends - begins) // LANE)
        owner = np.repeat(np.arange(len(ends)), lanes)
        if not len(owner):
            return (np.zeros(0, np.int64),) * 3
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = int(self.sizes.max()) - 1
        at = begins[owner] + ordinal * LANE - warm
        steps = warm + LANE
        padded = np.concatenate([np.zeros(warm, np.int32), self.classes[data], np.zeros(LANE, np.int32)])
        matrix = np.lib.stride_tricks.sliding_window_view(padded, steps)[at + warm]
        place = at[:, None] + np.arange(steps)
        # What lies outside of a lane's own text reads like a letter of no term.
        matrix = np.ascontiguousarray(np.where((place >= begins[owner][:, None]) & (place < ends[owner][:, None]), matrix, 0).T)
        state, hits = np.zeros(len(owner), np.int32), []
        for step, column in enumerate(matrix):
            state = self.moves[state * self.width + column]
            if step >= warm and len(lane := np.flatnonzero(self.told[state])):
                hits.append((lane, np.full(len(lane), step), state[lane]))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        lane, step, state = (np.concatenate(x) for x in zip(*hits, strict=True))
        texts, terms, places = [], [], []
        while len(state):
            own = self.ends[state] >= 0
            texts.append(owner[lane[own]])
            terms.append(self.ends[state[own]])
            places.append((at[lane] + step + 1)[own])
            state = self.shorter[state]
            on = state > 0
            lane, step, state = lane[on], step[on], state[on]
        return np.concatenate(texts), np.concatenate(terms), np.concatenate(places)

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and number of occurrences that don't overlap, taken from the left, by text and term."""
        text, term, end = self.found(data, ends)
        order = np.lexsort((end, term, text))
        text, term, end = text[order], term[order], end[order]
        kept = np.ones(len(text), bool)
        last = None
        for k in np.flatnonzero(self.bordered[term]).tolist():
            key = (text[k], term[k])
            if last and last[0] == key and end[k] - self.sizes[term[k]] < last[1]:
                kept[k] = False
            else:
                last = (key, end[k])
        text, term = text[kept], term[kept]
        first = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(term, prepend=-1)) if len(text) else np.zeros(0, np.int64)
        return text[first], term[first], np.diff(np.append(first, len(text)))


def hits(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms that occur in a text (null: none), each with how often, without overlaps: an array of (term, n)."""
    names = list(dict.fromkeys(terms))
    machine = Automaton(names)

    def count(texts: pa.Array) -> pa.Array:
        return _counted(machine, texts)

    found = F.arrow_udf(count, "array<struct<k:int,n:long>>")(F.coalesce(text, F.lit("")).cast("binary"))
    listed = F.array(*[F.lit(t) for t in names])
    return F.transform(found, lambda x: F.struct(F.get(listed, x["k"]).alias("term"), x["n"].alias("n")))


def _counted(machine: Automaton, texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    text, term, n, k = [], [], [], 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(offsets, offsets[k] + TOGETHER, side="right")) - 1)
        a, b, c = machine.counts(data[offsets[k] : offsets[upto]], offsets[k + 1 : upto + 1] - offsets[k])
        text, term, n, k = [*text, a + k], [*term, b], [*n, c], upto
    text, term, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (text, term, n))
    edges = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64())], names=["k", "n"]))


def totals(found: str, terms: list[str] | tuple[str, ...] | None = None) -> Column:
    """All occurrences in a column of :func:`hits`, of some of its terms or of all."""
    rows = F.col(found) if terms is None else F.filter(found, lambda x: x["term"].isin(*terms))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def by_term(docs: DataFrame, text: Column, terms: list[str] | tuple[str, ...], *groups: str) -> DataFrame:
    """``groups``, term and hits of the terms that occur."""
    each = docs.select(*groups, F.inline(hits(text, terms)))
    return each.groupBy(*groups, "term").agg(F.sum("n").alias("hits"))

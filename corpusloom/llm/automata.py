"""Finite automata over many texts at once, as associative state-transition functions.

A text is cut into chunks. A chunk doesn't know in which state the automaton
enters it, so it is run from every state side by side: it emits the function
from entry to exit state and, for each entry state, how many units begin in it.
Functions compose associatively, with their counts, so that a scan over the
chunks of a text resolves all entry states; the chunk in which the k-th unit
begins is then found by the counts, and the place within it by one more run of
that chunk alone. Chunks are columns of a matrix: a step moves all of them, from
all states, by one byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes in a chunk.
CHUNK = 512


@dataclass(frozen=True)
class Automaton:
    """``classes``: byte to class; ``moves`` and ``begins``, by state and class: the next state, and whether a unit begins. The last class stands behind a text's end and changes nothing."""

    classes: np.ndarray
    moves: np.ndarray
    begins: np.ndarray | None = None

    @property
    def states(self) -> int:
        return len(self.moves)


def lines() -> Automaton:
    """Units are the matches of ``[^\\n]*\\n|[^\\n]+``. State 0: the next byte begins one; state 1: within one."""
    classes = np.zeros(256, np.uint8)
    classes[ord("\n")] = 1
    return Automaton(classes, np.array([[1, 0, 0], [1, 0, 1]]), np.array([[1, 1, 0], [0, 0, 0]]))


def finder(needles: tuple[str, ...]) -> Automaton:
    """Its last state is reached, and never left, where one of ``needles`` has been read: their trie, with failure links followed beforehand."""
    coded = [n.encode() for n in needles]
    letters = sorted({b for n in coded for b in n})
    classes = np.zeros(256, np.uint8)
    classes[letters] = np.arange(1, len(letters) + 1)
    nodes = sorted({n[:k] for n in coded for k in range(len(n))}, key=lambda x: (len(x), x))
    found = len(nodes)
    moves = np.full((found + 1, len(letters) + 2), found)
    for s, node in enumerate(nodes):
        for c, letter in enumerate([None, *letters]):
            read = b"" if letter is None else node + bytes([letter])
            if not any(read.endswith(n) for n in coded):
                moves[s, c] = next(nodes.index(read[k:]) for k in range(len(read) + 1) if read[k:] in nodes)
        moves[s, -1] = s
    return Automaton(classes, moves)


@dataclass
class Scan:
    """Of some texts: for each chunk and entry state what has happened from its text's beginning to the chunk's end."""

    firsts: np.ndarray
    matrix: np.ndarray
    exits: np.ndarray
    counts: np.ndarray

    def whole(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Transition function and counts of the k-th text."""
        last = self.firsts[k + 1] - 1
        return self.exits[last], self.counts[last]


def scan(machine: Automaton, data: np.ndarray, ends: np.ndarray) -> Scan:
    """Texts lie one behind the other in ``data``; ``ends`` has where each ends. An empty text has one empty chunk."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = np.maximum(1, -(-(ends - begins) // CHUNK))
    firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), sizes)
    at = begins[owner] + (np.arange(firsts[-1]) - firsts[owner]) * CHUNK
    width = len(machine.moves[0])
    padded = np.concatenate([machine.classes[data], np.full(CHUNK, width - 1, np.uint8)])
    matrix = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[at].copy() if len(padded) >= CHUNK else np.zeros((0, CHUNK), np.uint8)
    over = np.flatnonzero(at + CHUNK > ends[owner])
    for k in over:  # the last chunk of each text
        matrix[k, max(0, ends[owner[k]] - at[k]) :] = width - 1
    matrix = np.ascontiguousarray(matrix.T)
    exits, counts = _run(machine, matrix, np.repeat(np.arange(machine.states)[:, None], len(at), axis=1))
    exits, counts = np.ascontiguousarray(exits.T), np.ascontiguousarray(counts.T)
    ordinal = np.arange(len(at)) - firsts[owner]
    step = 1
    while step <= ordinal.max(initial=0):
        late = np.flatnonzero(ordinal >= step)
        exits[late], counts[late] = compose((exits[late - step], counts[late - step]), (exits[late], counts[late]))
        step *= 2
    return Scan(firsts, matrix, exits, counts)


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The functions and counts of two neighbours as one; states are the last axis."""
    (f, m), (g, n) = first, then
    return np.take_along_axis(g, f, -1), m + np.take_along_axis(n, f, -1)


def _run(machine: Automaton, matrix: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = machine.moves.shape[1]
    moves = (machine.moves * width).astype(np.int64).ravel()
    begins = None if machine.begins is None else machine.begins.astype(np.int64).ravel()
    state, counts = entry * width, np.zeros(entry.shape, np.int64)
    for column in matrix:
        key = state + column
        if begins is not None:
            counts += begins[key]
        state = moves[key]
    return state // width, counts


def places(machine: Automaton, found: Scan, which: np.ndarray, wanted: np.ndarray, entry: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each j: where, from its beginning, text ``which[j]`` begins its unit number ``wanted[j]`` (from 0), or -1 if it has no such unit.

    The text is entered in state ``entry[j]``; ``before[j]`` units began earlier.
    """
    out = np.full(len(which), -1, np.int64)
    own = wanted - before
    low, high = found.firsts[which], found.firsts[which + 1]
    ends = high - 1
    live = np.flatnonzero((own >= 0) & (found.counts[ends, entry] > own))
    low, high = low[live].copy(), ends[live].copy()
    while (low < high).any():  # the first chunk by whose end the unit has begun
        mid = (low + high) // 2
        past = found.counts[mid, entry[live]] > own[live]
        low, high = np.where(past, low, np.minimum(mid + 1, high)), np.where(past, mid, high)
    head = low == found.firsts[which[live]]
    state = np.where(head, entry[live], found.exits[low - 1, entry[live]])
    rest = own[live] - np.where(head, 0, found.counts[low - 1, entry[live]])
    width, chunks = machine.moves.shape[1], found.matrix[:, low]
    moves, begins = machine.moves.ravel(), machine.begins.ravel()
    at = np.full(len(live), -1, np.int64)
    for k, column in enumerate(chunks):
        key = state * width + column
        rest = rest - begins[key]
        at[(at < 0) & (rest < 0)] = k
        state = moves[key]
    out[live] = (low - found.firsts[which[live]]) * CHUNK + at
    return out

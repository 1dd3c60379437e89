"""Many short pieces through the transducer of ``bpe.py`` side by side: a step reads the next byte of each of them.

States, moves and tests of pairs are those of that module; tables are numpy arrays, so that a step is a few gathers.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from .bpe import Transducer

#: The tables of states and moves start anew when there are so many states. A state is made when so many pieces of one
#: call come to a move that has none.
STATES, OFTEN = 50_000, 4

#: Slots, as powers of two, of moves and of tested pairs. What comes later takes the slot of what was there.
MOVE_BITS, PAIR_BITS = 17, 18


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


class Fixed:
    """Whole numbers by whole numbers, both from 0 and all known at the start, in two arrays with open addressing."""

    def __init__(self, keys: list[int], values: list[int]):
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, (2 * len(key)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = _slots(key, self.bits)
        while key.size:
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]  # of several keys for one slot one stays
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], self._next(slot[~placed])

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return slot + 1 & (1 << self.bits) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = _slots(keys, self.bits)
        found, out = self.keys.take(slot), self.values.take(slot)
        at = np.flatnonzero((found != keys) & (found >= 0))
        key, slot = keys.take(at), slot.take(at)
        while at.size:
            slot = self._next(slot)
            found = self.keys.take(slot)
            out[at] = np.where(found == key, self.values.take(slot), -1)
            go = np.flatnonzero((found != key) & (found >= 0))
            at, key, slot = at.take(go), key.take(go), slot.take(go)
        return out


class SideBySide:
    """Encodes lists of pieces by the tables of a transducer."""

    def __init__(self, one: Transducer):
        self.one, ranks, token = one, one.ranks, one.token
        self.child = Fixed(list(one.child), list(one.child.values()))
        self.depth, self.suffix = np.array(one.depth, np.int64), np.array(one.suffix, np.int64)
        self.here, self.of_token = np.array(one.ends_here, np.int64), np.array(one.of_token, np.int64)
        self.left, self.right = np.array(one.left, np.int64), np.array(one.right, np.int64)
        self.size = np.array([len(t) for t in token], np.int64)
        joins = [
            (a << 32 | b, r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None
        ]
        self.joined = Fixed([k for k, _ in joins], [r for _, r in joins])  # two ids to that of their bytes together
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # two ids and whether the second may follow the first
        self._renew()

    def _renew(self):
        """Start new tables of states and moves."""
        self.states: dict[tuple, int] = {(0, -1): 0}
        self.node, self.last = np.zeros(STATES, np.int64), np.full(STATES, -1, np.int64)  # as in ``Transducer``
        self.moves = np.full(1 << MOVE_BITS, -1, np.int64)  # state, byte and the state that they lead to

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node of the longest suffix that still begins a token, after ``byte``."""
        to = self.child.get(node << 8 | byte)
        at = np.flatnonzero((to < 0) & (node > 0))
        up, byte = node.take(at), byte.take(at)
        while at.size:
            up = self.suffix.take(up)
            to[at] = got = self.child.get(up << 8 | byte)
            go = np.flatnonzero((got < 0) & (up > 0))
            at, up, byte = at.take(go), up.take(go), byte.take(go)
        return np.maximum(to, 0).astype(np.int64)

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Transducer._fits`` for pairs of ids."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), 1 << 60, np.int64)
        while at.size:
            join, inner_a, inner_b = self.joined.get(a << 32 | b), self.right.take(a), self.left.take(b)
            apart = (join < 0) | (join >= until)
            out[at[~apart]] = False
            undo_a = (inner_a >= 0) & ((inner_b < 0) | (a > b))
            go = np.flatnonzero(apart & (undo_a | (inner_b >= 0)))
            until = np.where(undo_a, a, b + 1).take(go)
            a, b = np.where(undo_a, inner_a, a).take(go), np.where(undo_a, b, inner_b).take(go)
            at = at.take(go)
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each ``b`` may follow its ``a``; all may at the start, where ``a`` is negative."""
        keys = a << 32 | b
        known = self.pairs.take(_slots(keys, PAIR_BITS))
        out = (a < 0) | (known & 1 > 0)
        new = np.flatnonzero((known >> 1 != keys) & (a >= 0))
        if new.size:
            pairs, which = np.unique(keys.take(new), return_inverse=True)
            fits = self._test(pairs >> 32, pairs & 0xFFFFFFFF)
            out[new] = fits[which]
            self.pairs[_slots(pairs, PAIR_BITS)] = pairs << 1 | fits
        return out

    def _ending(self, node: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id that ends at ``at``: of the suffixes that are tokens the longest that fits what comes before it."""
        s = self.here.take(node)
        out, todo = self.of_token.take(s), np.arange(len(s))
        while True:
            t = self.of_token.take(s)
            if not s.all():
                raise ValueError("the vocabulary has no token for a byte")
            out[todo] = t
            go = np.flatnonzero(~self._fits(ends.take(at - self.depth.take(s)), t))
            if not go.size:
                return out
            todo, at, s = todo.take(go), at.take(go), self.here.take(self.suffix.take(s.take(go)))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each piece."""
        data = np.frombuffer(b"\0" + b"\0".join(pieces), np.uint8).astype(np.int64)  # a place before each piece
        stop = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)  # after the last byte of each
        ends = np.full(len(data), -1, np.int64)  # as in ``Transducer``, of one piece after the other
        at = np.concatenate([[0], stop[:-1]]) + 1
        todo = np.flatnonzero(at < stop)
        left = self._by_states(data, ends, at.take(todo), stop.take(todo))
        self._by_nodes(data, ends, *left[:3])
        self._make_states(data, ends, *left)
        marked, at = np.zeros(len(ends), bool), stop - 1
        while (at := at[ends.take(at) >= 0]).size:
            marked[at] = True
            at = at - self.size.take(ends.take(at))
        raw, cut = ends[marked].astype("<u4").tobytes(), (4 * np.cumsum(marked)[stop - 1]).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def _by_states(self, data, ends, at, stop) -> list[np.ndarray]:
        """Move from state to state. Returns where moves were missing: place, end of the piece, node, state and byte."""
        state, left = np.zeros(len(at), np.int64), []
        while at.size:
            keys = state << 8 | data.take(at)
            move = self.moves.take(_slots(keys, MOVE_BITS))
            known = move >> 32 == keys
            lost = np.flatnonzero(~known)
            left.append((at.take(lost), stop.take(lost), self.node.take(state.take(lost)), keys.take(lost)))
            state = move & 0xFFFFFFFF
            go = np.flatnonzero(known)
            ends[at.take(go)] = self.last.take(state.take(go))
            go = np.flatnonzero(known & (at + 1 < stop))
            at, stop, state = at.take(go) + 1, stop.take(go), state.take(go)
        return [np.concatenate(x) for x in zip(*left)] if left else [at] * 4

    def _by_nodes(self, data, ends, at, stop, node):
        """Follow the nodes of the trie to the end of each piece."""
        while at.size:
            node = self._child(node, data.take(at))
            ends[at] = self._ending(node, at, ends)
            go = np.flatnonzero(at + 1 < stop)
            at, stop, node = at.take(go) + 1, stop.take(go), node.take(go)

    def _make_states(self, data, ends, at, stop, node, keys):
        """Make the states that missing moves lead to, if moves were missing often."""
        keys, first, count = np.unique(keys, return_index=True, return_counts=True)
        first = first[count >= OFTEN]
        at, depth, suffix = at.take(first), self.one.depth, self.one.suffix
        reached = self._child(node.take(first), data.take(at))
        made = []
        for to, i in zip(reached.tolist(), at.tolist()):
            key, s = [to], to
            while s:
                key.append(int(ends[i - depth[s]]))
                s = suffix[s]
            if len(self.states) == STATES:
                return self._renew()
            made.append(self.states.setdefault((*key, int(ends[i])), len(self.states)))
        made = np.array(made, np.int64)
        self.node[made], self.last[made] = reached, ends.take(at)
        keys = keys[count >= OFTEN]
        self.moves[_slots(keys, MOVE_BITS)] = keys << 32 | made

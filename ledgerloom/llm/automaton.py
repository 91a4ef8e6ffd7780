"""Deterministic automata over bytes, built from regular expressions.

Rules are parsed by Python's own regex parser, turned into one nondeterministic automaton, made
deterministic by subset construction (sets of states are the bits of an integer) and minimised by partition
refinement. The result is an array of transitions by state and byte, and of the rules that accept in a state.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

_ops = re._constants



@dataclass
class Nfa:
    """Edges carry a 256-bit set of bytes; ``skips`` need no byte."""

    edges: list[list[tuple[int, int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def add(self, pattern: bytes, ignore_case: bool) -> tuple[int, int]:
        start, end = self.state(), self.state()
        self._sequence(re._parser.parse(pattern), start, end, ignore_case)
        return start, end

    def _sequence(self, items, start: int, end: int, fold: bool) -> None:
        at = start
        for op, arg in items:
            nxt = self.state()
            self._item(op, arg, at, nxt, fold)
            at = nxt
        self.skips[at].append(end)

    def _item(self, op, arg, start: int, end: int, fold: bool) -> None:
        if op is _ops.LITERAL:
            self.edges[start].append((_fold(1 << arg) if fold else 1 << arg, end))
        elif op is _ops.IN:
            mask = 0
            for kind, value in arg:
                if kind is _ops.LITERAL:
                    mask |= 1 << value
                elif kind is _ops.RANGE:
                    mask |= sum(1 << b for b in range(value[0], value[1] + 1))
                else:
                    raise ValueError(f"a rule may not use {kind} in a class")
            self.edges[start].append((_fold(mask) if fold else mask, end))
        elif op is _ops.BRANCH:
            for items in arg[1]:
                self._sequence(items, start, end, fold)
        elif op is _ops.SUBPATTERN:
            self._sequence(arg[3], start, end, fold)
        elif op is _ops.MAX_REPEAT:
            low, high, items = arg
            at = start
            for _ in range(low):
                nxt = self.state()
                self._sequence(items, at, nxt, fold)
                at = nxt
            if high is _ops.MAXREPEAT:
                loop = self.state()
                self.skips[at].append(loop)
                self._sequence(items, loop, loop, fold)
                at = loop
            else:
                for _ in range(high - low):
                    self.skips[at].append(end)
                    nxt = self.state()
                    self._sequence(items, at, nxt, fold)
                    at = nxt
            self.skips[at].append(end)
        else:
            raise ValueError(f"a rule may not use {op}")

    def reversed(self) -> Nfa:
        back = Nfa([[] for _ in self.edges], [[] for _ in self.skips])
        for at, (edges, skips) in enumerate(zip(self.edges, self.skips, strict=True)):
            for mask, to in edges:
                back.edges[to].append((mask, at))
            for to in skips:
                back.skips[to].append(at)
        return back

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def _fold(mask: int) -> int:
    """The set with both cases of its ASCII letters."""
    upper, lower = sum(1 << b for b in range(65, 91)), sum(1 << b for b in range(97, 123))
    return mask | (mask & upper) << 32 | (mask & lower) >> 32


def _byte_classes(nfa: Nfa) -> list[list[int]]:
    """Bytes that no edge tells apart."""
    masks = {mask for edges in nfa.edges for mask, _ in edges}
    groups: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(bool(mask >> b & 1) for mask in masks), []).append(b)
    return list(groups.values())


@dataclass(frozen=True)
class Tables:
    """A minimal automaton as arrays: the state after each byte (-1: none can follow), and the rules' bits of each state. State 0 starts."""

    after: np.ndarray
    bits: np.ndarray

    def start_row(self) -> list:
        """The same as linked lists, faster to follow byte by byte: row[byte] is the next row, row[256] its bits."""
        rows = [[None] * 257 for _ in self.bits]
        targets = [*rows, None]
        for row, after, bits in zip(rows, self.after, self.bits.tolist(), strict=True):
            row[:256] = map(targets.__getitem__, after.tolist())  # a row's numbers at a time: all at once are millions of objects
            row[256] = bits
        return rows[0]


def subsets(nfa: Nfa, starts: list[int], classes: list[list[int]], anywhere: bool) -> tuple[list[int], list[list[int]]]:
    """The reachable sets of states, as bits of a number, and the set after each class of bytes."""
    width, reach = len(nfa.edges), [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.edges))]
    every = _union(reach, starts)
    moved = []  # per state, what each class leads to, side by side in one number
    for edges in nfa.edges:
        wide = 0
        for i, members in enumerate(classes):
            wide |= _union(reach, [t for mask, t in edges if mask >> members[0] & 1]) << i * width
        moved.append(wide)
    again = sum(every << i * width for i in range(len(classes))) if anywhere else 0
    number, found, moves, one = {every: 0}, [every], [], (1 << width) - 1
    for states in found:
        wide, rest = again, states
        while rest:
            low = rest & -rest
            wide |= moved[low.bit_length() - 1]
            rest ^= low
        row = []
        for _ in classes:
            target = wide & one
            wide >>= width
            if target not in number:
                number[target] = len(found)
                found.append(target)
            row.append(number[target])
        moves.append(row)
    return found, moves


def _union(sets: list[int], members: list[int]) -> int:
    out = 0
    for m in members:
        out |= sets[m]
    return out


def compiled(nfa: Nfa, starts: list[int], accepts: dict[int, int], anywhere: bool) -> Tables:
    """The minimal automaton. ``accepts`` maps an end state to its rule's bit; with ``anywhere`` a match may begin at every byte."""
    classes = _byte_classes(nfa)
    found, moves = subsets(nfa, starts, classes, anywhere)
    bits = np.array([_union([b if states >> s & 1 else 0 for s, b in accepts.items()], range(len(accepts))) for states in found], np.int64)
    after = np.array(moves, np.int32)
    _, part = np.unique(bits, return_inverse=True)
    while True:  # states stay together while their successors do
        _, finer = np.unique(np.column_stack([part, part[after]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    _, head = np.unique(part, return_index=True)  # one state of each part, the parts in the order of these
    order = np.argsort(head, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    head, place = head[order], rank[part]
    small = place[after[head]].astype(np.int32)
    if not anywhere and 0 in found:
        small[small == place[found.index(0)]] = -1
    wide = np.empty((len(head), 256), np.int32)
    for i, members in enumerate(classes):
        wide[:, members] = small[:, [i]]
    return Tables(wide, bits[head])

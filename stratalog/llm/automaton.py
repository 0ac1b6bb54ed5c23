"""Deterministic automata for byte patterns.

Patterns (literals, classes, groups, alternatives, ?, *, + and {m,n}) become one nondeterministic automaton by
Thompson's construction; subset construction over classes of equivalent bytes and minimisation by refinement of
partitions make transition arrays from it.

``compile_rules`` combines many rules, each of which may begin anywhere. Its scan runs many pieces of text side by side,
one byte of each at a time. Where no rule is longer than some length, the state depends on no more bytes than that, so a
text is cut anywhere and each piece begins so many bytes early. ``compile_tail`` makes an automaton that begins at a
given place only; it follows one place to the last accepted end, and skips a run of bytes that keep its state at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": 10, "r": 13, "t": 9}


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"cannot parse {self.p!r} at {self.i}")
        return tree

    def alternatives(self):
        out = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence(self):
        out = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            out.append(self.repeated(self.atom()))
        return ("seq", out)

    def repeated(self, atom):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (None, None))
            if c == "{":
                end = self.p.index("}", self.i)
                parts, self.i = self.p[self.i : end].split(","), end + 1
                low, high = int(parts[0]), (int(parts[0]) if len(parts) == 1 else int(parts[1]) if parts[1] else None)
            atom = ("rep", atom, low, high)
        return atom

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        e = self.p[self.i]
        self.i += 1
        if e == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return _ESCAPES.get(e, ord(e))

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            inner = self.alternatives()
            self.i += 1
            return inner
        if c == "[":
            self.i += 1
            negate = self.p[self.i] == "^"
            self.i += negate
            found: set[int] = set()
            while self.p[self.i] != "]":
                low = self.byte()
                high = low
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self.byte()
                found.update(range(low, high + 1))
            self.i += 1
            found = self.folded(found)
            return ("set", frozenset(range(256)) - found if negate else found)
        if c == ".":
            self.i += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({self.byte()}))

    def folded(self, found) -> frozenset:
        if self.ignore_case:
            found = set(found) | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, at: int) -> int:
        """Adds ``tree`` after the state ``at``; the state after it."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((tree[1], to))
            return to
        if kind == "seq":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if kind == "alt":
            to = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[at].append(first)
                self.free[self.add(part, first)].append(to)
            return to
        _, part, low, high = tree
        for _ in range(low):
            at = self.add(part, at)
        if high is None:
            loop, to = self.state(), self.state()
            self.free[at].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(to)
            return to
        to = self.state()
        for _ in range(high - low):
            self.free[at].append(to)
            at = self.add(part, at)
        self.free[at].append(to)
        return to


@dataclass(frozen=True)
class Automaton:
    """``classes[byte]``; ``moves[state * n + class]`` is the next state times n; ``accepts[state * n]`` a bit per rule that ends here."""

    classes: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    n: int
    start: int
    longest: int | None

    def events(self, data: np.ndarray, starts: np.ndarray, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places where rules end and which, in order, of the texts that begin at ``starts``; the last ends with ``data``.

        Texts are cut into pieces of about ``piece`` bytes, if no rule has unbounded length.
        """
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(data)))
        parts = np.maximum(1, -(-sizes // piece)) if self.longest is not None else np.ones(len(sizes), np.int64)
        first = np.repeat(starts, parts)
        own = first + (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)) * piece
        ends = np.minimum(own + piece, np.repeat(starts + sizes, parts)) if self.longest is not None else starts + sizes
        at = np.maximum(own - (self.longest or 0), first)
        sizes = ends - at
        order = np.argsort(-sizes, kind="stable")
        at, own, sizes = at[order], own[order], sizes[order]
        running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        state, symbol = np.full(len(at), self.start, np.int32), self.classes[data]
        places, masks = [], []
        for t, k in enumerate(running):
            s = self.moves[state[:k] + symbol[at[:k] + t]]
            state[:k] = s
            mask = self.accepts[s]
            if mask.any():
                hit = np.flatnonzero(mask)
                hit = hit[at[hit] + t >= own[hit]]
                places.append(at[hit] + t)
                masks.append(mask[hit])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, what = np.concatenate(places), np.concatenate(masks)
        order = np.argsort(where, kind="stable")
        return where[order], what[order].astype(np.int64)


def _longest(tree) -> int | None:
    kind = tree[0]
    if kind == "set":
        return 1
    parts = [_longest(x) for x in (tree[1] if kind in ("seq", "alt") else [tree[1]])]
    if None in parts or kind == "rep" and tree[3] is None:
        return None
    return sum(parts) if kind == "seq" else max(parts) if kind == "alt" else parts[0] * tree[3]


def _tables(trees: list, everywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of bytes, next states by state and class, rules that end in each state) of the minimal automaton; state 0 is the first."""
    nfa = _Nfa()
    first, ends = nfa.state(), {}
    for k, tree in enumerate(trees):
        own = nfa.state()
        nfa.free[first].append(own)
        ends[nfa.add(tree, own)] = 1 << k
    sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.int64)
    n, sample = len(kinds), {c: int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))}

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.moves[x] or x in ends)

    start = closed([first])
    again = start if everywhere else frozenset()
    numbers, table, accepts, todo = {start: 0}, [], [], [start]
    while todo:
        now = todo.pop(0)
        accepts.append(sum(ends.get(x, 0) for x in now))
        row = []
        for c in range(n):
            to = closed([t for x in now for s, t in nfa.moves[x] if sample[c] in s]) | again
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        table.append(row)
    moves, groups = np.array(table), np.unique(np.array(accepts), return_inverse=True)[1]
    while True:  # states stay together while they agree on where every class leads
        finer = np.unique(np.column_stack((groups, groups[moves])), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == groups.max():
            break
        groups = finer
    names = np.full(groups.max() + 1, -1)
    for k, g in enumerate(dict.fromkeys(groups.tolist())):
        names[g] = k  # the first state is 0
    groups = names[groups]
    least = np.array([int(np.flatnonzero(groups == g)[0]) for g in range(groups.max() + 1)])
    return classes.astype(np.uint8), groups[moves[least]], np.array(accepts)[least]


def compile_rules(rules: list[tuple[str, bool]], before: bytes = b"") -> Automaton:
    """The automaton of the rules (pattern, ignore case), each of which may begin anywhere; rule k has bit k. A text begins as if after ``before``."""
    trees = [_Parser(pattern, ignore_case).parse() for pattern, ignore_case in rules]
    classes, moves, accepts = _tables(trees, True)
    sizes, n = [_longest(t) for t in trees], moves.shape[1]
    flat_accepts = np.zeros(len(moves) * n, np.int32)
    flat_accepts[np.arange(len(moves)) * n] = accepts
    start = 0
    for b in before:
        start = int(moves[start, classes[b]])
    return Automaton(classes, (moves * n).reshape(-1).astype(np.int32), flat_accepts, n, start * n, None if None in sizes else max(sizes, default=0))


@dataclass(frozen=True)
class Tail:
    """``moves[state][byte]`` is the next state, -1 none; ``keeps[state]``, if any, tells of each byte whether it keeps the state."""

    moves: list[list[int]]
    accepts: list[bool]
    keeps: list[np.ndarray | None]

    def follow(self, text: bytes, data: np.ndarray, at: int, stop: int) -> tuple[int, int] | None:
        """The first and the last place from ``at`` on, before ``stop``, behind which the pattern is complete; None if nowhere."""
        state, first, last = 0, -1, -1
        while at < stop:
            to = self.moves[state][text[at]]
            if to < 0:
                break
            keeps, at, size = self.keeps[to] if to == state else None, at + 1, 64
            while keeps is not None and at < stop:  # the rest of the run, in pieces that grow
                ends = np.flatnonzero(~keeps[data[at : min(stop, at + size)]])
                if len(ends):
                    at += int(ends[0])
                    break
                at, size = min(stop, at + size), size * 4
            state = to
            if self.accepts[state]:
                first, last = first if first >= 0 else at, at
        return (first, last) if last >= 0 else None


def compile_tail(pattern: str, ignore_case: bool = False) -> Tail:
    """The automaton of a pattern that begins where it is told to, and does not match the empty text."""
    classes, moves, accepts = _tables([_Parser(pattern, ignore_case).parse()], False)
    dead = [not a and (m == k).all() for k, (m, a) in enumerate(zip(moves, accepts))]
    full = [[-1 if dead[t] else int(t) for t in row[classes]] for row in moves]
    keeps = [k if (k := np.array(row) == s).any() else None for s, row in enumerate(full)]
    return Tail(full, [bool(a) for a in accepts], keeps)

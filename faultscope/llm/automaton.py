"""Rule regexes -> one minimal deterministic automaton over byte classes.

Rules are byte regexes of literals, classes, escapes, groups, alternation and the
repetitions ``? * + {m} {m,} {m,n}``. Every rule searches for itself, leftmost and longest,
and goes on behind its match; the automaton is their product: its state is, for each rule,
the position sets of its open attempts by start. Once an attempt accepts, later ones drop
until the match ends. For a single pass a rule must stay accepting while its match grows (a rule that ends in
a repeated class, or in a fixed tail, does); others are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

ALL = range(256)


class Nfa:
    """Positions with byte edges and empty edges, built from a regex; ``back`` reverses it."""

    def __init__(self, pattern: str, back: bool = False):
        self.s, self.at, self.back = pattern.encode(), 0, back
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.first, self.last = self.either()
        if self.at != len(self.s):
            raise ValueError(f"unexpected {self.s[self.at:]!r} in {pattern!r}")

    def new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def look(self) -> bytes:
        return self.s[self.at:self.at + 1]

    def either(self) -> tuple[int, int]:
        a, b = self.new(), self.new()
        while True:
            x, y = self.series()
            self.empty[a].append(x)
            self.empty[y].append(b)
            if self.look() != b"|":
                return a, b
            self.at += 1

    def series(self) -> tuple[int, int]:
        parts = []
        while self.look() not in (b"", b"|", b")"):
            start = self.at
            part = self.atom()
            low, high = self.times()
            stop = self.at
            parts.append(self.repeat(part, start, low, high))
            self.at = stop
        if self.back:
            parts.reverse()
        a = b = self.new()
        for x, y in parts:
            self.empty[b].append(x)
            b = y
        return a, b

    def repeat(self, part, start: int, low: int, high: int | None) -> tuple[int, int]:
        def copy():
            self.at = start
            return self.atom()

        a = b = self.new()
        for k in range(max(low, high or low, 1)):
            x, y = part if not k else copy()
            self.empty[b].append(x)
            if k >= low:
                self.empty[b].append(y)  # may be left out, with all that follow
            b = y
            if high is None and k == max(low, 1) - 1:
                self.empty[y].append(x)
        return a, b

    def times(self) -> tuple[int, int | None]:
        c = self.look()
        if c in (b"?", b"*", b"+"):
            self.at += 1
            return {b"?": (0, 1), b"*": (0, None), b"+": (1, None)}[c]
        if c == b"{":
            stop = self.s.index(b"}", self.at)
            low, comma, high = self.s[self.at + 1:stop].decode().partition(",")
            self.at = stop + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.look()
        if c == b"(":
            self.at += 1
            out = self.either()
            self.at += 1
            return out
        if c == b"[":
            chars = self.members()
        else:
            chars = frozenset([self.byte()])
        a, b = self.new(), self.new()
        self.edges[a].append((chars, b))
        return a, b

    def byte(self) -> int:
        c = self.s[self.at]
        self.at += 1
        if c == 92:
            c = self.s[self.at]
            self.at += 1
            if c == ord("x"):
                self.at += 2
                return int(self.s[self.at - 2:self.at], 16)
        return c

    def members(self) -> frozenset:
        self.at += 1
        negated = self.look() == b"^"
        self.at += negated
        out: set[int] = set()
        while self.look() != b"]":
            low = high = self.byte()
            if self.look() == b"-" and self.s[self.at + 1:self.at + 2] != b"]":
                self.at += 1
                high = self.byte()
            out.update(range(low, high + 1))
        self.at += 1
        return frozenset(ALL) - out if negated else frozenset(out)

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def begin(self) -> frozenset:
        return self.closure([self.first])

    def step(self, states, byte: int) -> frozenset:
        return self.closure({t for s in states for chars, t in self.edges[s] if byte in chars})


@dataclass(frozen=True)
class Automaton:
    """``table[state + class]`` is the next state (times the number of classes). States from
    ``event`` on have rules in ``ended``, whose match stopped before the byte just read."""

    classes: bytes
    table: list[int]
    event: int
    ended: dict[int, tuple[int, ...]]
    open: dict[int, tuple[int, ...]]


def byte_classes(nfas: list[Nfa]) -> tuple[bytes, list[int]]:
    """(class of each byte, a byte of each class): bytes that no edge tells apart."""
    sets = sorted({c for n in nfas for e in n.edges for c, _ in e}, key=sorted)
    seen: dict[tuple, int] = {}
    of = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in ALL)
    return of, [of.index(k) for k in range(len(seen))]


def minimal(n: int, out: list, step: list[list[int]]) -> list[int]:
    """Block of each state: split by output, then by the blocks of the successors."""
    block = [sorted(set(out), key=repr).index(o) for o in out]
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((block[s], *(block[t] for t in step[s])), len(keys)) for s in range(n)]
        if len(keys) == len(set(block)):
            return new
        block = new


def compile_rules(patterns: list[str]) -> Automaton:
    nfas = [Nfa(p) for p in patterns]
    classes, sample = byte_classes(nfas)
    begins = [n.begin() for n in nfas]

    @cache
    def follow(i: int, tries: tuple[frozenset, ...], byte: int) -> tuple[tuple[frozenset, ...], bool]:
        """``tries``: the open attempts by start; an attempt that accepts drops the later ones."""
        n, ended = nfas[i], False
        if tries and n.last in tries[0]:
            if more := n.step(tries[0], byte):
                if n.last not in more:
                    raise ValueError(f"{patterns[i]!r} can leave a match that grows")
                return (more,), False
            tries, ended = (), True
        out, seen = [], set()
        for t in (*tries, begins[i]):
            if more := n.step(t, byte) - seen:
                if n.last in more:
                    if out:
                        raise ValueError(f"{patterns[i]!r} can match inside an earlier open attempt")
                    return (more,), ended
                out.append(more)
                seen |= more
        return tuple(out), ended

    start = (((),) * len(nfas), ())
    number, todo, step = {start: 0}, [start], []
    while todo:
        tries, _ = todo.pop(0)
        row = []
        for byte in sample:
            moved = [follow(i, t, byte) for i, t in enumerate(tries)]
            key = (tuple(m[0] for m in moved), tuple(i for i, m in enumerate(moved) if m[1]))
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
        step.append(row)
    states = list(number)
    out = [(ended, tuple(i for i, t in enumerate(tries) if t and nfas[i].last in t[0])) for tries, ended in states]
    block = minimal(len(states), out, step)
    first: dict[int, int] = {}
    for s, b in enumerate(block):
        first.setdefault(b, s)
    order = sorted(first, key=lambda b: (bool(out[first[b]][0]), b != block[0]))  # the start is 0, events come last
    place = {b: k * len(sample) for k, b in enumerate(order)}
    table = [place[block[t]] for b in order for t in step[first[b]]]
    ended = {place[b]: out[first[b]][0] for b in order if out[first[b]][0]}
    return Automaton(classes, table, min(ended, default=len(table)), ended, {place[b]: out[first[b]][1] for b in order if out[first[b]][1]})


def compile_backwards(pattern: str) -> tuple[bytes, list[list[int]], set[int]]:
    """(byte classes, step, accepting states) of the reversed rule, anchored; state -1 is the dead end."""
    n = Nfa(pattern, back=True)
    classes, sample = byte_classes([n])
    number, todo, step = {n.begin(): 0}, [n.begin()], []
    while todo:
        s = todo.pop(0)
        row = []
        for byte in sample:
            if t := n.step(s, byte):
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                row.append(number[t])
            else:
                row.append(-1)
        step.append(row)
    return classes, step, {k for s, k in number.items() if n.last in s}

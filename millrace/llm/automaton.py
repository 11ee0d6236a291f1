"""Regular expressions compiled to one deterministic automaton for a scan by bytes.

Each rule becomes a non-deterministic automaton (``parse``), then a deterministic search
automaton with leftmost matches (``search_table``). The product of all rules is minimised
into a single transition array (``Combined``). The supported syntax is literals, classes,
groups, ``|``, ``?``, ``*``, ``+``, ``{m,n}``, ``\\xHH`` and escaped characters, over ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np


class Nfa:
    """Thompson construction. ``moves[s]`` lists (set of bytes, target), ``free[s]`` targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def step(self, states, byte: int) -> frozenset[int]:
        return self.closure({t for s in states for on, t in self.moves[s] if byte in on})

    def reversed(self, start: int, end: int) -> tuple[Nfa, int, int]:
        out = Nfa()
        for _ in self.moves:
            out.new()
        for s, row in enumerate(self.moves):
            for on, t in row:
                out.moves[t].append((on, s))
        for s, row in enumerate(self.free):
            for t in row:
                out.free[t].append(s)
        return out, end, start


class _Parser:
    def __init__(self, text: str, any_case: bool) -> None:
        self.text, self.at, self.any_case, self.nfa = text, 0, any_case, Nfa()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self) -> tuple[int, int]:
        start, end = self.nfa.new(), self.nfa.new()
        while True:
            a, b = self.sequence()
            self.nfa.free[start].append(a)
            self.nfa.free[b].append(end)
            if self.peek() != "|":
                return start, end
            self.take()

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.new()
        while self.peek() not in ("", "|", ")"):
            began = self.at
            a, b = self.atom()
            after = self.at
            low, high = self.times()
            resume = self.at
            for n in range(max(low, high or low, 1)):
                if n:  # a copy of the same piece of the expression
                    self.at = began
                    a, b = self.atom()
                    assert self.at == after
                self.nfa.free[end].append(a)
                if n >= low:
                    skip = self.nfa.new()
                    self.nfa.free[end].append(skip)
                    self.nfa.free[b].append(skip)
                    b, loop_from = skip, b
                else:
                    loop_from = b
                if high is None and n == max(low, 1) - 1:
                    self.nfa.free[loop_from].append(a)
                end = b
            self.at = resume
        return start, end

    def times(self) -> tuple[int, int | None]:
        mark = self.peek()
        if mark in ("?", "*", "+"):
            self.take()
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark == "{":
            close = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : close].partition(",")
            self.at = close + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.take()
            piece = self.choice()
            assert self.take() == ")", "unbalanced group"
            return piece
        on = self.members() if self.peek() == "[" else {self.char()}
        if self.any_case:
            on = on | {ord(chr(c).swapcase()) for c in on if chr(c).isalpha()}
        start, end = self.nfa.new(), self.nfa.new()
        self.nfa.moves[start].append((frozenset(on), end))
        return start, end

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def members(self) -> set[int]:
        self.take()
        out: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                out |= set(range(low, self.char() + 1))
            else:
                out.add(low)
        self.take()
        return out


def parse(expression: str, any_case: bool = False) -> tuple[Nfa, int, int]:
    parser = _Parser(expression, any_case)
    start, end = parser.choice()
    if parser.at != len(expression):
        raise ValueError(f"cannot read {expression!r} beyond {parser.at}")
    return parser.nfa, start, end


@dataclass
class Rule:
    """A kind of secret. ``head`` + ``body`` is the expression; a match whose body is
    shorter than ``least`` bytes is used up and dropped."""

    kind: str
    head: str
    body: str
    least: int = 1
    any_case: bool = False
    _head: tuple = field(init=False, repr=False)
    _whole: tuple = field(init=False, repr=False)
    _back: tuple = field(init=False, repr=False)
    _back_memo: dict = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self) -> None:
        self._head = parse(f"({self.head})", self.any_case)
        self._whole = parse(f"({self.head})({self.body})", self.any_case)
        self._back = self._whole[0].reversed(*self._whole[1:])

    def start_of(self, data: bytes, floor: int, end: int) -> int:
        """The leftmost start at or after ``floor`` of a match that ends at ``end``."""
        nfa, first, last = self._back
        state, best = nfa.closure({first}), -1
        for at in range(end - 1, floor - 1, -1):
            key = (state, data[at])
            if key not in self._back_memo:
                self._back_memo[key] = nfa.step(*key)
            state = self._back_memo[key]
            if not state:
                break
            if last in state:
                best = at
        return best

    def body_length(self, data: bytes, start: int, end: int) -> int:
        """Bytes after the longest head."""
        nfa, first, last = self._head
        state, best = nfa.closure({first}), start
        for at in range(start, end):
            if last in state:
                best = at
            state = nfa.step(state, data[at])
            if not state:
                break
        return end - best


def search_table(rule: Rule, letters: list[int]) -> tuple[list[list[int]], set[tuple[int, int]]]:
    """Subset construction for leftmost, non-overlapping matches of one rule.

    A state is a tuple of sets, one per possible start, the earliest first. When a match
    can no longer grow, the move that ends it is marked and the search begins anew with
    that very byte. Rules in which a match could pause or an earlier start could still
    overtake are refused.
    """
    nfa, first, last = rule._whole
    seed = nfa.closure({first})
    if last in seed:
        raise ValueError(f"{rule.kind}: the expression matches the empty text")

    step = cache(nfa.step)

    def move(state: tuple, letter: int) -> tuple[tuple, bool]:
        groups, seen, done = [], set(), False
        matched = last in state[-1]
        for group in state:
            after = step(group, letter) - seen
            if after:
                groups.append(after)
                seen |= after
                if last in after:
                    if len(groups) > 1:
                        raise ValueError(f"{rule.kind}: an earlier start is open when a later one matches")
                    done = True
                    break
        if matched and not done:
            if groups:
                raise ValueError(f"{rule.kind}: a match pauses")
            return move((seed,), letter)[0], True
        if not done and seed - seen:
            groups.append(frozenset(seed - seen))
        return tuple(groups), False

    states, rows, ends = {(seed,): 0}, [], set()
    for state in (order := [(seed,)]):
        row = []
        for k, letter in enumerate(letters):
            target, ended = move(state, letter)
            if target not in states:
                states[target] = len(states)
                order.append(target)
            row.append(states[target])
            if ended:
                ends.add((states[state], k))
        rows.append(row)
    return rows, ends


class Combined:
    """The minimised product of all rules as one transition array.

    ``table[state + letter]`` is the next state (already multiplied by the number of
    letters); values from ``mark`` on stand for moves that end matches:
    ``ended[value - mark]`` holds the next state and the rules whose match ended.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        kinds: dict[tuple, int] = {}
        self.letter_of = bytearray(256)
        examples: list[int] = []
        sets = [on for r in rules for row in r._whole[0].moves for on, _ in row]
        for byte in range(256):
            key = tuple(byte in on for on in sets)
            if key not in kinds:
                kinds[key] = len(kinds)
                examples.append(byte)
            self.letter_of[byte] = kinds[key]
        # one more letter, the end of the text, ends every open match; any byte outside all sets does that
        if not any(not any(k) for k in kinds):
            raise ValueError("the rules leave no byte that ends a match")
        self.stop = bytes([examples[kinds[next(k for k in kinds if not any(k))]]])
        self.width = len(examples)
        self._build([search_table(r, examples) for r in rules])

    def _build(self, parts) -> None:
        states, order = {(0,) * len(parts): 0}, [(0,) * len(parts)]
        target, output, outputs = [], [], {(): 0}
        for state in order:
            for k in range(self.width):
                after = tuple(rows[s][k] for (rows, _), s in zip(parts, state))
                over = tuple(n for n, ((_, ends), s) in enumerate(zip(parts, state)) if (s, k) in ends)
                if after not in states:
                    states[after] = len(states)
                    order.append(after)
                target.append(states[after])
                output.append(outputs.setdefault(over, len(outputs)))
        moves = np.array(target).reshape(-1, self.width)
        out = np.array(output).reshape(-1, self.width)
        self.n_before = len(moves)
        # Moore's refinement: states are one class while outputs and classes of targets agree
        group = np.zeros(len(moves), dtype=np.int64)
        while True:
            _, finer = np.unique(np.hstack([group[:, None], out, group[moves]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == group.max():
                break
            group = finer
        _, first = np.unique(group, return_index=True)
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.argsort(first)] = np.arange(len(first))  # the start state stays 0
        group, first = rank[group], np.sort(first)
        self.n_states = len(first)
        self.mark = self.n_states * self.width
        self.table: list[int] = []
        self.ended: list[tuple[int, tuple[int, ...]]] = []
        known: dict[tuple, int] = {}
        names = {v: k for k, v in outputs.items()}
        for s in first:
            for k in range(self.width):
                to, over = int(group[moves[s, k]]) * self.width, names[int(out[s, k])]
                if over:
                    if (to, over) not in known:
                        known[to, over] = len(self.ended)
                        self.ended.append((to, over))
                    to = self.mark + known[to, over]
                self.table.append(to)

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of all matches in one pass over the bytes."""
        table, mark, ended, state, out = self.table, self.mark, self.ended, 0, []
        for at, letter in enumerate((data + self.stop).translate(bytes(self.letter_of))):
            state = table[state + letter]
            if state >= mark:
                state, rules = ended[state - mark]
                for r in rules:
                    out.append((r, at))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) by byte, in order of start, then rule."""
        floor, out = [0] * len(self.rules), []
        for r, end in self.ends(data):
            rule = self.rules[r]
            start = rule.start_of(data, floor[r], end)
            floor[r] = end
            if rule.body_length(data, start, end) >= rule.least:
                out.append((start, r, end))
        return sorted(out)

"""Byte automata for sets of regular expressions: parse, determinise, minimise, scan.

The regular expressions are a small language over bytes: literals, escapes
``\\xHH`` ``\\.`` ``\\d``, classes, groups, ``|``, ``? * +`` and ``{n}`` ``{n,}``.
All rules of a set are compiled into one deterministic automaton, as flat
transition arrays over 256 bytes, by subset construction over the union of
their position automata, and minimised by partition refinement that keeps
apart states which accept different sets of rules.
"""

from __future__ import annotations

from array import array


class _Parser:
    """Recursive descent over the pattern into a tree of (kind, body)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("seq", items)

    def repeated(self) -> tuple:
        node = self.atom()
        while (c := self.peek()) in ("?", "*", "+", "{") and c:
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                least = [node] * int(low)
                if comma and not high:
                    least.append(("star", node))
                elif comma:
                    least += [("opt", node)] * (int(high) - int(low))
                node = ("seq", least)
            else:
                node = {"?": ("opt", node), "*": ("star", node), "+": ("seq", [node, ("star", node)])}[c]
        return node

    def escaped(self) -> set[int]:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        if c == "d":
            return set(range(48, 58))
        return {ord(c)}

    def atom(self) -> tuple:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.char_class())
        return ("set", self.folded(self.escaped() if c == "\\" else {ord(c)}))

    def char_class(self) -> frozenset:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            c = self.p[self.i]
            self.i += 1
            one = self.escaped() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.p[self.i + 1] != "]" and len(one) == 1:
                self.i += 1
                c = self.p[self.i]
                self.i += 1
                one = set(range(min(one), max(self.escaped() if c == "\\" else {ord(c)}) + 1))
            found |= one
        self.i += 1
        return frozenset(set(range(256)) - found) if negated else self.folded(found)

    def folded(self, found: set[int]) -> frozenset:
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= b <= 90 or 97 <= b <= 122}
        return frozenset(found)


class Nfa:
    """Epsilon-automaton of several rules with a common start state 0; ``backward`` reads the rules from their ends."""

    def __init__(self, rules: list[tuple[str, bool]], backward: bool = False):
        self.backward = backward
        self.moves: list[list[tuple[frozenset, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.accepts: dict[int, int] = {}
        for number, (pattern, fold) in enumerate(rules):
            start = self.state()
            self.free[0].append(start)
            self.accepts[self.build(_Parser(pattern, fold).alternatives(), start)] = number

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, node: tuple, at: int) -> int:
        """Add ``node`` after state ``at``; the state behind it."""
        kind, body = node
        if kind == "set":
            self.moves[at].append((body, end := self.state()))
            return end
        if kind == "seq":
            for part in reversed(body) if self.backward else body:
                at = self.build(part, at)
            return at
        end = self.state()
        if kind == "or":
            for part in body:
                self.free[at].append(first := self.state())
                self.free[self.build(part, first)].append(end)
        elif kind == "opt":
            self.free[at].append(end)
            self.free[self.build(body, at)].append(end)
        else:
            self.free[at].append(end)
            self.free[end].append(first := self.state())
            self.free[self.build(body, first)].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset:
        stack, seen = list(states), set(states)
        while stack:
            for t in self.free[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)


class Dfa:
    """Flat transition array ``step[state + byte]``; states are multiples of 256.

    ``accepting`` maps a state to the rules that match up to here. Accepting
    states have the largest numbers, so ``state >= first_accepting`` tests for one.
    ``dead`` is the state without a way on (-1 if there is none). The start state
    is ``start``.
    """

    def __init__(self, step: array, start: int, accepting: dict[int, tuple[int, ...]], first_accepting: int, dead: int):
        self.step, self.start, self.accepting, self.first_accepting, self.dead = step, start, accepting, first_accepting, dead

    @property
    def states(self) -> int:
        return len(self.step) // 256


def compile_rules(rules: list[tuple[str, bool]], starts: bool) -> Dfa:
    """One minimal automaton for (pattern, fold ASCII case) rules.

    starts: the automaton reads a text from its end, once, and is in a state that accepts a
    rule wherever a match of the rule starts; else it reads forwards, matches begin
    at the first byte and all their ends are accepted.
    """
    nfa = Nfa(rules, starts)
    # bytes that no rule tells apart share a class
    signature: dict[int, list[int]] = {b: [] for b in range(256)}
    for k, s in enumerate({s for moves in nfa.moves for s, _ in moves}):
        for b in s:
            signature[b].append(k)
    classes: dict[tuple, int] = {}
    of_byte = [classes.setdefault(tuple(signature[b]), len(classes)) for b in range(256)]
    sample = {c: b for b, c in reversed(list(enumerate(of_byte)))}

    root = nfa.closure({0})
    numbers, order, table = {root: 0}, [root], []
    accepted: list[tuple[int, ...]] = []
    for subset in order:  # grows while it is walked
        done = {nfa.accepts[s] for s in subset if s in nfa.accepts}
        accepted.append(tuple(sorted(done)))
        row = []
        for c in range(len(classes)):
            b = sample[c]
            reached = {t for s in subset for chars, t in nfa.moves[s] if b in chars}
            target = nfa.closure(reached | {0}) if starts else nfa.closure(reached)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        table.append(row)

    # refine: states stay together while they accept alike and lead to the same blocks
    block = [0] * len(order)
    kinds: dict = {}
    block = [kinds.setdefault(a, len(kinds)) for a in accepted]
    while True:
        kinds = {}
        finer = [kinds.setdefault((block[s], *(block[t] for t in table[s])), len(kinds)) for s in range(len(order))]
        if len(kinds) == len(set(block)):
            break
        block = finer
    members: dict[int, int] = {}
    for s, b in enumerate(block):
        members.setdefault(b, s)
    ranked = sorted(members, key=lambda b: (bool(accepted[members[b]]), members[b]))
    place = {b: 256 * k for k, b in enumerate(ranked)}
    step = array("i", bytes(4 * 256 * len(ranked)))
    for b in ranked:
        row = table[members[b]]
        for byte in range(256):
            step[place[b] + byte] = place[block[row[of_byte[byte]]]]
    accepting = {place[b]: accepted[members[b]] for b in ranked if accepted[members[b]]}
    dead = next((place[b] for b in ranked if not accepted[members[b]] and all(block[t] == b for t in table[members[b]])), -1)
    return Dfa(step, place[block[0]], accepting, min(accepting, default=256 * len(ranked)), dead)


def ends_at_once(dfa: Dfa) -> bool:
    """Whether an anchored automaton is dead as soon as it leaves its accepting states, so that a walk reads one byte beyond a match at most."""
    reached = {int(t) for s in dfa.accepting for t in dfa.step[s : s + 256]}
    return all(t == dfa.dead or t in dfa.accepting for t in reached)


def longest_from(dfa: Dfa, data: bytes, at: int) -> int:
    """End of the longest match of an anchored automaton at ``at``, or -1."""
    step, state, end, dead, first = dfa.step, dfa.start, -1, dfa.dead, dfa.first_accepting
    for i in range(at, len(data)):
        state = step[state + data[i]]
        if state == dead:
            break
        if state >= first:
            end = i + 1
    return end

"""Secret scans: one deterministic automaton for all rules.

Rule patterns become one position automaton by Thompson's construction, subsets of which
are the states of a combined deterministic automaton; partition refinement then merges equal
states.  Its transition arrays are walked once over the bytes of a text, for all rules
together.  A state tells which rules have a match that ends there.  The start is found by a
walk back through the rule's reversed automaton, the end by a walk ahead through its anchored
one, so spans are leftmost and longest, and those of one rule never overlap.

A rule's matches may not begin inside the unfinished part of another match of the same rule;
its least lengths are checked after matching, so a match that is too short still uses up its
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_column


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0


#: The three base rules, then those that this scan adds.
RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+"),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*", least=24),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
ASSIGN_VALUE = 6


class Parser:
    """A small regular language: literals, [classes], groups, |, ?, *, +, {n}, and \\ before a literal."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self):
        node = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unbalanced pattern: {self.text}")
        return node

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated())
        return ("then", items)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index("}", self.at)
                node = ("then", [node] * int(self.text[self.at : end]))
                self.at = end + 1
            else:
                node = (c, node)
        return node

    def atom(self):
        c = self.peek()
        self.at += 1
        if c == "(":
            node = self.choice()
            if self.peek() != ")":
                raise ValueError(f"unbalanced pattern: {self.text}")
            self.at += 1
            return node
        if c == "[":
            end = self.text.index("]", self.at + 1)
            inner, self.at = self.text[self.at : end], end + 1
            found, i = set(), 0
            while i < len(inner):
                if i + 2 < len(inner) and inner[i + 1] == "-":
                    found.update(range(ord(inner[i]), ord(inner[i + 2]) + 1))
                    i += 3
                else:
                    found.add(ord(inner[i]))
                    i += 1
            return ("bytes", frozenset(found))
        if c == "\\":
            c = self.peek()
            self.at += 1
        return ("bytes", frozenset([ord(c)]))


def reverse(node):
    kind, rest = node
    if kind == "then":
        return (kind, [reverse(x) for x in reversed(rest)])
    if kind == "or":
        return (kind, [reverse(x) for x in rest])
    return node if kind == "bytes" else (kind, reverse(rest))


def shortest(node):
    """The same beginnings of matches, each ended as soon as it can end."""
    kind, rest = node
    if kind == "or":
        return (kind, [shortest(x) for x in rest])
    if kind == "+":
        return shortest(rest)
    if kind != "then":
        return node
    items = list(rest)
    while items and items[-1][0] in "*?":
        items.pop()
    return (kind, [*items[:-1], shortest(items[-1])]) if items else (kind, [])


class Automaton:
    """Positions with moves on bytes and empty moves; `ends` maps a position to its rule."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.ends: dict[int, int] = {}

    def new(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        kind, rest = node
        if kind == "bytes":
            end = self.new()
            self.moves[start].append((rest, end))
            return end
        if kind == "then":
            for x in rest:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.new()
            for x in rest:
                self.empty[self.add(x, self.branch(start))].append(end)
            return end
        inner = self.branch(start)
        last, end = self.add(rest, inner), self.new()
        self.empty[last].append(end)
        if kind in "*?":
            self.empty[inner].append(end)
        if kind in "*+":
            self.empty[last].append(inner)
        return end

    def branch(self, start: int) -> int:
        inner = self.new()
        self.empty[start].append(inner)
        return inner

    def closure(self, states) -> frozenset:
        todo, found = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Table:
    """rows[state][byte] is the next state; states at or past `accept` end rules[state]."""

    rows: list[list[int]]
    accept: int
    rules: dict[int, tuple[int, ...]]
    dead: int


def compile_table(patterns: list[str], anchored: bool, backwards: bool = False) -> Table:
    """Subset construction over all patterns, then merging of equal states.  What is not
    anchored looks out for the shortest matches: where one can end, not all that it can take."""
    auto = Automaton()
    start = auto.new()
    for k, pattern in enumerate(patterns):
        node = Parser(pattern).parse()
        auto.ends[auto.add(reverse(node) if backwards else node if anchored else shortest(node), auto.branch(start))] = k
    first = auto.closure([start])
    number, order, steps = {first: 0}, [first], []
    for states in order:
        row, by_byte = [0] * 256, {}
        for s in states:
            for chars, to in auto.moves[s]:
                for b in chars:
                    by_byte.setdefault(b, set()).add(to)
        known: dict[frozenset, int] = {}
        for b in range(256):
            moved = frozenset(by_byte.get(b, ())) | (frozenset() if anchored else frozenset([start]))
            if moved not in known:
                to = auto.closure(moved)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                known[moved] = number[to]
            row[b] = known[moved]
        steps.append(row)
    ends = [tuple(sorted({auto.ends[s] for s in states if s in auto.ends})) for states in order]
    part = {e: i for i, e in enumerate(sorted(set(ends)))}
    block = [part[e] for e in ends]
    while True:  # refine until no two states of a block lead to different blocks
        keys: dict[tuple, int] = {}
        finer = [keys.setdefault((block[i], *(block[t] for t in row)), len(keys)) for i, row in enumerate(steps)]
        if len(keys) == len(set(block)):
            break
        block = finer
    of = {b: i for i, b in reversed(list(enumerate(block)))}
    kept = sorted(of, key=lambda b: (bool(ends[of[b]]), of[b]))
    new = {b: k for k, b in enumerate(kept)}
    rows = [[new[block[t]] for t in steps[of[b]]] for b in kept]
    rules = {k: ends[of[b]] for k, b in enumerate(kept) if ends[of[b]]}
    dead = next((k for k, row in enumerate(rows) if k not in rules and all(t == k for t in row)), -1)
    # the start must be state 0
    if (begin := new[block[0]]) != 0 and begin not in rules:
        swap = {0: begin, begin: 0}
        rows[0], rows[begin] = rows[begin], rows[0]
        rows = [[swap.get(t, t) for t in row] for row in rows]
        dead = swap.get(dead, dead)
    return Table(rows, len(rows) - len(rules), rules, dead)


class Scanner:
    """The compiled automata of a rule list."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_table([r.pattern for r in rules], anchored=False)
        self.ahead = [compile_table([r.pattern], anchored=True) for r in rules]
        self.back = [compile_table([r.pattern], anchored=True, backwards=True) for r in rules]

    @staticmethod
    def longest(table: Table, data: bytes, steps: range) -> int:
        """How many bytes along `steps` the longest match takes (-1: none)."""
        state, best, taken = 0, -1, 0
        for i in steps:
            state = table.rows[state][data[i]]
            taken += 1
            if state == table.dead:
                break
            if state >= table.accept:
                best = taken
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches, in order of start, before length rules."""
        rows, accept, ends = self.all.rows, self.all.accept, self.all.rules
        free = [0] * len(self.rules)
        found, state = [], 0
        for i, b in enumerate(data):
            state = rows[state][b]
            if state >= accept:
                for k in ends[state]:
                    if i >= free[k]:
                        back = self.longest(self.back[k], data, range(i, free[k] - 1, -1))
                        if back > 0:
                            start = i + 1 - back
                            end = start + self.longest(self.ahead[k], data, range(start, len(data)))
                            found.append((start, k, end))
                            free[k] = end
        found.sort()
        return found


@lru_cache(maxsize=8)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def value_length(match: bytes) -> int:
    """Bytes of the value of an assignment: what follows the name, one separator and a quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, found: array of (kind, start, end) in code points, end exclusive, by start and
    then rule order.

    Null or empty texts give an empty array; very long texts are walked whole; repeated rows
    are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                data = (s or "").encode()
                ascii_only = s is None or len(data) == len(s)
                row = []
                for start, k, end in scanner.spans(data):
                    rule = rules[k]
                    if end - start < rule.least or rule.kind == "assign" and value_length(data[start:end]) < ASSIGN_VALUE:
                        continue
                    if not ascii_only:
                        before = len(data[:start].decode(errors="ignore"))
                        start, end = before, before + len(data[start:end].decode(errors="ignore"))
                    row.append({"kind": rule.kind, "start": start, "end": end})
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=["key", "found"])

    return text_column(docs, key, text).mapInArrow(run, f"key {kind}, found array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)

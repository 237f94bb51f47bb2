"""Secret scans: all rules compiled into one deterministic byte automaton.

The rules' regexes are parsed with the standard library's parser, joined into one
automaton by subset construction, and minimised by partition refinement; a task
walks the transition array once over the bytes of a text and learns for all rules
where a match can end. For each such place a small reversed automaton of the rule
finds the leftmost start, and an anchored one the longest end; a span that fails
its rule's condition uses up its text but is dropped, as with leftmost
non-overlapping search. Offsets are code points, ends exclusive.

Defined results: a null text is empty and has no spans; repeated rows each get a
row; extra columns are ignored by ``scan_table`` and kept by ``redact``; texts of
any length take one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from re import _constants as sre
from re import _parser as sre_parser

from tickerloom.llm.common import bytes_of, few_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: bytes
    group: int = 0  # the group whose length counts
    least: int = 0  # its least length


#: The base rules, in the order of their kinds.
BASE = (
    Rule("assign", rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]{24,}"),
)
#: Well-known public token formats that the method adds.
ADDED = (
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
RULES = BASE + ADDED


class _Nfa:
    """States with byte-set arcs (a set is a 256-bit number) and empty arcs."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.empty.append([])
        return len(self.arcs) - 1

    def add(self, items, start: int, fold: bool, back: bool) -> int:
        """Append a parsed sequence after ``start``, read backwards if ``back``; the last state."""
        at = start
        for op, arg in reversed(list(items)) if back else items:
            if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
                at = self._step(at, _byte_set(op, arg, fold))
            elif op is sre.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, (fold or bool(on & re.I)) and not off & re.I, back)
            elif op is sre.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    self.empty[self.add(inner, at, fold, back)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold, back)
                if high is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(inner, loop, fold, back)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.empty[at].append(end)
                    for _ in range(high - low):
                        at = self.add(inner, at, fold, back)
                        self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"{op} has no automaton here")
        return at

    def _step(self, at: int, members: int) -> int:
        new = self.state()
        self.arcs[at].append((members, new))
        return new

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _byte_set(op, arg, fold: bool) -> int:
    if op is sre.ANY:
        return (1 << 256) - 1 - (1 << 10)
    found, negate = 0, op is sre.NOT_LITERAL
    for kind, value in arg if op is sre.IN else [(sre.LITERAL, arg)]:
        if kind is sre.NEGATE:
            negate = True
        elif kind is sre.LITERAL:
            found |= 1 << value
        elif kind is sre.RANGE:
            found |= sum(1 << x for x in range(value[0], value[1] + 1))
        else:
            raise ValueError(f"{kind} has no byte set here")
    if fold:
        for x in range(65, 91):
            if found >> x & 1 or found >> (x + 32) & 1:
                found |= 1 << x | 1 << (x + 32)
    return (1 << 256) - 1 - found if negate else found


@dataclass
class Dfa:
    """``table[state + class]`` is the next state; states are multiples of ``width`` and those
    from ``accepting`` on accept. ``dead`` is a state that never accepts again, or -1."""

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]] = field(default_factory=dict)
    dead: int = -1


def compile_dfa(rules: tuple[Rule, ...], search: bool, back: bool = False) -> Dfa:
    """``search``: a match may begin anywhere; else at the start only. ``back``: for reading backwards."""
    nfa, accept = _Nfa(), {}
    root = nfa.state()
    for i, rule in enumerate(rules):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        accept[nfa.add(sre_parser.parse(rule.regex), begin, False, back)] = i
    sets = sorted({m for arcs in nfa.arcs for m, _ in arcs})
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(m >> b & 1 for m in sets), len(kinds)) for b in range(256))
    sample = [classes.index(k) for k in range(len(kinds))]
    first = nfa.closure([root])
    index, rows, todo = {first: 0}, [], [first]
    for subset in todo:
        row = []
        for byte in sample:
            to = {t for s in subset for m, t in nfa.arcs[s] if m >> byte & 1}
            to = nfa.closure(to | {root}) if search else nfa.closure(to)
            if to not in index:
                index[to] = len(todo)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    found = [tuple(sorted(accept[s] for s in subset if s in accept)) for subset in todo]
    return _minimised(np.array(rows), found, classes, search)


def _minimised(rows: np.ndarray, found: list[tuple[int, ...]], classes: bytes, search: bool) -> Dfa:
    """Refine the partition by accepted rules until it no longer splits; accepting states come last."""
    kinds = sorted(set(found))
    label = np.array([kinds.index(x) for x in found])
    while True:
        _, new = np.unique(np.column_stack([label, label[rows]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == label.max() and len(np.unique(label)) == len(np.unique(new)):
            break
        label = new
    n, width = label.max() + 1, rows.shape[1]
    one = np.array([np.flatnonzero(label == k)[0] for k in range(n)])
    order = sorted(range(n), key=lambda k: (bool(found[one[k]]), k))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    table = (place[label[rows[one[order]]]] * width).ravel()
    rules = {int(place[k]) * width: found[one[k]] for k in range(n) if found[one[k]]}
    dead = -1
    if not search:
        for k in range(n):
            at = int(place[k]) * width
            if not found[one[k]] and (table[at : at + width] == at).all():
                dead = at
    return Dfa(classes, width, [int(x) for x in table], int(place[label[0]]) * width, min(rules, default=len(table)), rules, dead)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.search = compile_dfa(rules, True)
        self.back = [compile_dfa((r,), False, True) for r in rules]
        self.forth = [compile_dfa((r,), False) for r in rules]
        self.exact = [re.compile(r.regex) for r in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes of all spans that hold, by rule."""
        dfa = self.search
        table, accepting, state, ends = dfa.table, dfa.accepting, dfa.start, []
        for i, c in enumerate(data.translate(dfa.classes)):
            state = table[state + c]
            if state >= accepting:
                ends.append((i + 1, state))
        if not ends:
            return []
        spans, used = [], [0] * len(self.rules)
        for end, state in ends:
            for r in dfa.rules[state]:
                if end <= used[r]:
                    continue
                start = self._start(r, data, used[r], end)
                if start < 0:
                    continue
                stop = self._stop(r, data, start)
                used[r] = stop
                rule = self.rules[r]
                if not rule.least or len(self.exact[r].fullmatch(data, start, stop)[rule.group]) >= rule.least:
                    spans.append((r, start, stop))
        return sorted(spans, key=lambda x: (x[1], x[0]))

    def _start(self, r: int, data: bytes, low: int, end: int) -> int:
        dfa, at = self.back[r], -1
        state = dfa.start
        for i in range(end - 1, low - 1, -1):
            state = dfa.table[state + dfa.classes[data[i]]]
            if state >= dfa.accepting:
                at = i
            elif state == dfa.dead:
                break
        return at

    def _stop(self, r: int, data: bytes, start: int) -> int:
        dfa, at = self.forth[r], start
        state = dfa.start
        for i in range(start, len(data)):
            state = dfa.table[state + dfa.classes[data[i]]]
            if state >= dfa.accepting:
                at = i + 1
            elif state == dfa.dead:
                break
        return at

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then the rules' order."""
        found = self.byte_spans(data)
        if not found or data.isascii():
            return [(self.rules[r].kind, a, b) for r, a, b in found]
        before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return [(self.rules[r].kind, int(before[a]), int(before[b])) for r, a, b in found]


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_table(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    base = [r.kind for r in BASE]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for part in few_rows(parts):
            found = [scanner.spans(x) for x in bytes_of(part.column("text"))]
            own = [[s for s in x if s[0] in base] for x in found]
            counts = [pa.array([sum(s[0] == k for s in x) for x in own], pa.int64()) for k in base]
            sums = pa.array([hashlib.sha256(written_spans(x).encode()).hexdigest() for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, sums, pa.array(map(written_spans, found), pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans become one, named after the
    first. ``length``, if there is such a column, is set to the new length where the text changed."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    names, schema = docs.columns, docs.schema

    def clean(scanner: Scanner, data: bytes) -> bytes:
        out, at, spans = [], 0, scanner.byte_spans(data)
        for r, a, b in spans:
            if a >= at:
                out += [data[at:a], b"[" + scanner.rules[r].kind.encode() + b"]"]
            at = max(at, b)
        return b"".join([*out, data[at:]]) if spans else data

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for part in few_rows(parts):
            old = part.column(names.index(text)).to_pylist()
            new = [None if x is None else clean(scanner, x.encode()).decode() for x in old]
            columns = list(part.columns)
            columns[names.index(text)] = pa.array(new, columns[names.index(text)].type)
            if length in names:
                k = names.index(length)
                columns[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)

"""Secret scanning with one combined deterministic automaton.

``compile_rules`` parses the rules' regular expressions (literals, classes, groups,
alternation and the quantifiers ``? * + {m} {m,} {m,n}``), joins them in one
nondeterministic automaton, and turns it into a transition array over byte classes by
subset construction and minimisation (Moore's partition refinement). The searching
automaton restarts at every byte, so one pass over the bytes finds where any rule ends.

The pass runs over many segments in step: a byte that leads from every state back to the
start (a line end, most punctuation) cannot lie inside a match, so segments between such
bytes are independent. Only segments in which some rule has ended are walked again, by the
rule's own anchored automaton, for the leftmost longest spans that do not overlap.

Defined cases: a null or empty text has no spans; offsets are in code points, the end
exclusive; equal rows give equal results; an empty table gives an empty result; extra
columns are ignored. Letters of keywords match in either ASCII case only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pactline.llm._spark import in_batches, table
from pactline.llm._text import buffers, chunks

_VALUE = "[A-Za-z0-9+/_.=-]"
#: kind, expression, least length of a match (for assign, of its value); shorter matches are dropped
#: fixed values: the three base kinds, then common public token formats that the method adds
RULES = (
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?" + _VALUE + "+", 8),
    ("access", "AKIA[A-Z0-9]+", 16),
    ("hex", "[0-9a-f]{32,}", 32),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 26),
)
BASE = ("assign", "access", "hex")


class _Nfa:
    """States with byte-set edges and empty moves, built from an expression."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, pattern: str, start: int) -> int:
        """Builds ``pattern`` after ``start`` and returns its end."""
        self.text, self.at = pattern, 0
        end = self._either(start)
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern[self.at :]!r}")
        return end

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self, start: int) -> int:
        ends = [self._sequence(start)]
        while self._peek() == "|":
            self.at += 1
            ends.append(self._sequence(start))
        end = self.state()
        for x in ends:
            self.empty[x].append(end)
        return end

    def _sequence(self, start: int) -> int:
        while self._peek() not in ("", "|", ")"):
            start = self._repeated(start)
        return start

    def _repeated(self, start: int) -> int:
        begin = self.at
        here = self.state()
        self.empty[start].append(here)
        end = self._one(here)
        stop = self.at
        low, high = 1, 1
        if self._peek() and self._peek() in "?*+":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self._peek()]
            self.at += 1
        elif self._peek() == "{":
            close = self.text.index("}", self.at)
            a, comma, b = self.text[self.at + 1 : close].partition(",")
            low, high = int(a), (int(b) if b else None) if comma else int(a)
            self.at = close + 1
        after = self.at
        outs = [here] if low == 0 else []
        for k in range(2, max(low, high or 0) + 1):  # further copies, one after the other
            if k > low:
                outs.append(end)
            here = self.state()
            self.empty[end].append(here)
            self.at = begin
            end = self._one(here)
            assert self.at == stop
        self.at = after
        if high is None:
            self.empty[end].append(here)
        out = self.state()
        for x in [*outs, end]:
            self.empty[x].append(out)
        return out

    def _one(self, start: int) -> int:
        c = self._peek()
        if c == "(":
            self.at += 1
            end = self._either(start)
            if self._peek() != ")":
                raise ValueError("a group is not closed")
            self.at += 1
            return end
        end = self.state()
        self.edges[start].append((self._set() if c == "[" else frozenset([self._byte()]), end))
        return end

    def _byte(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(c)

    def _set(self) -> frozenset[int]:
        self.at += 1
        inverted = self._peek() == "^"
        self.at += inverted
        found: set[int] = set()
        while self._peek() != "]":
            low = self._byte()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found.update(range(low, self._byte() + 1))
            else:
                found.add(low)
        self.at += 1
        return frozenset(set(range(256)) - found if inverted else found)


@dataclass(frozen=True)
class Automaton:
    """next[state, class] over byte classes; ends[state] is the bit set of rules that end there; state 0 starts."""

    classes: np.ndarray
    next: np.ndarray
    ends: np.ndarray
    dead: int


def _determined(nfa: _Nfa, starts: list[int], finals: dict[int, int], searching: bool) -> Automaton:
    groups: dict[tuple[bool, ...], list[int]] = {}
    sets = list({s for edges in nfa.edges for s, _ in edges})
    for b in range(256):
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = np.zeros(256, np.uint8)
    for k, own in enumerate(groups.values()):
        classes[own] = k
    samples = [own[0] for own in groups.values()]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed(starts)
    names, todo, rows = {first: 0}, [first], []
    while todo:
        own = todo.pop(0)
        row = []
        for b in samples:
            to = closed([t for s in own for edge, t in nfa.edges[s] if b in edge])
            to = to | first if searching else to
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        rows.append(row)
    step = np.array(rows, np.int32)
    ends = np.array([sum(1 << finals[s] for s in own if s in finals) for own in names], np.int64)
    block = np.unique(ends, return_inverse=True)[1].ravel()
    while True:  # states that no byte tells apart become one
        refined = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == block.max():
            break
        block = refined
    order = np.unique(block, return_index=True)[1]
    rank = np.empty(len(order), np.int32)
    rank[block[np.sort(order)]] = np.arange(len(order))
    keep = np.sort(order)
    small, out = rank[block[step[keep]]], ends[keep]
    dead = [s for s in range(len(small)) if out[s] == 0 and (small[s] == s).all()]
    return Automaton(classes, small.astype(np.int32), out, dead[0] if dead and not searching else -1)


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[tuple[str, str, int], ...] = RULES) -> tuple[Automaton, tuple[Automaton, ...]]:
    """The searching automaton of all rules together, and each rule's anchored one."""
    nfa = _Nfa()
    starts, finals, own = [], {}, []
    for k, (_, pattern, _) in enumerate(rules):
        start = nfa.state()
        end = nfa.add(pattern, start)
        starts.append(start)
        finals[end] = k
        own.append(_determined(nfa, [start], {end: 0}, searching=False))
    return _determined(nfa, starts, finals, searching=True), tuple(own)


def _segments(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~cut[data]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges + 1]
    end[edges - 1] = inside[edges]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _touched(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, rules) of the segments in which rules end, from one pass in step."""
    returning = (auto.next == 0).all(axis=0)
    lo, hi = _segments(data, offsets, returning[auto.classes])
    if len(lo) == 0:
        return
    order = np.argsort(lo - hi, kind="stable")  # the longest first: those still running are a prefix
    lo, hi = lo[order], hi[order]
    codes = auto.classes[data]
    width = auto.next.shape[1]
    flat = (auto.next * width).astype(np.int32).ravel()
    ends = np.zeros(len(flat), np.int64)
    ends[::width] = auto.ends
    state, seen, sizes = np.zeros(len(lo), np.int32), np.zeros(len(lo), np.int64), hi - lo
    running = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    for step in range(int(sizes[0])):
        n = running[step]
        now = flat[state[:n] + codes[lo[:n] + step]]
        state[:n] = now
        seen[:n] |= ends[now]
    for k in np.flatnonzero(seen):
        yield int(lo[k]), int(hi[k]), int(seen[k])


def _walk(auto: Automaton, text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost longest matches that do not overlap."""
    step, ends, classes, dead = auto.next.tolist(), auto.ends.tolist(), auto.classes.tolist(), auto.dead
    codes = [classes[b] for b in text]
    i, n = 0, len(codes)
    while i < n:
        state, j, last = 0, i, -1
        while j < n:
            state = step[state][codes[j]]
            if state == dead:
                break
            j += 1
            if ends[state]:
                last = j
        if last > i:
            yield i, last
            i = last
        else:
            i += 1



def _value_length(match: bytes) -> int:
    """The length of an assigned value: what follows the first sign and its blanks and quote."""
    at = min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def secret_spans(data: np.ndarray, offsets: np.ndarray, rules: tuple[tuple[str, str, int], ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule) of each row, in bytes of the row."""
    auto, own = compile_rules(rules)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for i, j in chunks(offsets, 1 << 22):
        base = int(offsets[i])
        part, edges = data[base : int(offsets[j])], offsets[i : j + 1] - base
        for lo, hi, seen in _touched(auto, part, edges):
            row = int(np.searchsorted(edges, lo, side="right")) - 1
            text, shift = part[lo:hi].tobytes(), lo - int(edges[row])
            for k, (kind, _, least) in enumerate(rules):
                if seen >> k & 1:
                    found[i + row] += [(a + shift, b + shift, k) for a, b in _walk(own[k], text) if (_value_length(text[a:b]) if kind == "assign" else b - a) >= least]
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in found]


def _scan(batches):
    kinds = [kind for kind, *_ in RULES]
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        rows = []
        for r, spans in enumerate(secret_spans(data, offsets)):
            if spans:
                raw = data[offsets[r] : offsets[r + 1]]
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                spans = [{"kind": kinds[k], "start": int(points[a]), "end": int(points[b])} for a, b, k in spans]
            rows.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind_of)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of ``docs`` (doc_id, text)."""
    return in_batches(docs.select("doc_id", "text"), _scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def _digest(batches):
    for batch in batches:
        rows = [x or [] for x in batch.column("spans").to_pylist()]
        counts = [pa.array([sum(s["kind"] == kind for s in x) for x in rows], pa.int64()) for kind in BASE]
        base = [hashlib.sha256(_joined(s for s in x if s["kind"] in BASE).encode()).hexdigest() for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([_joined(x) for x in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return in_batches(found, _digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

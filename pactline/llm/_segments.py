"""Encoding texts through a bounded cache of their space-separated segments.

A segment is a run of spaces and the characters up to the next space. Both tokenisers
served here never join characters across the start of a segment, so a text's encoding is
the concatenation of its segments' encodings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


def segments(text: str, lead: str | None) -> list[str]:
    """The segments of a text, each without one of the spaces before it.

    The first segment has no space of its own: it is marked with ``lead``, or, where
    ``lead`` is None, one is put before the text.
    """
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        if lead is not None:
            parts[0] = lead + parts[0]
        return parts
    out, run = [], 0
    for k, part in enumerate(parts):
        run += k > 0 or lead is None
        if part:
            out.append(" " * (run - 1) + part if run else lead + part)
            run = 0
    return [*out, " " * (run - 1)] if run else out


class SegmentCache:
    """Two generations of at most ``limit`` entries; whatever both have lost is encoded anew."""

    def __init__(self, encode: Callable[[list[str]], Sequence], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.now: dict = {}
        self.before: dict = {}

    def __call__(self, keys: list[str]) -> list:
        get = self.now.get
        found = [get(k) for k in keys]
        missing = [k for k, v in enumerate(found) if v is None]
        if missing:
            if len(self.now) > self.limit:
                self.before, self.now = self.now, {}
            new = []
            for k in {keys[i] for i in missing}:
                if (v := self.before.get(k)) is not None:
                    self.now[k] = v
                else:
                    new.append(k)
            fresh = dict(zip(new, self.encode(new))) if new else {}
            self.now.update(fresh)
            for i in missing:
                found[i] = self.now[keys[i]]
        return found


class Memo(dict):
    """``memo[key]`` computes what is new; ``turn`` drops what two generations have not used."""

    def __init__(self, compute: Callable[[str], object], limit: int = 500_000):
        self.compute, self.limit = compute, limit
        self.before: dict = {}

    def __missing__(self, key: str) -> object:
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.before = dict(self)
            self.clear()

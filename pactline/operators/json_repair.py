"""Model answers become JSON objects: fences, prose, early or missing closers, cut ends.

What columns can express (fences, spans) is columns; reading broken JSON is a small function
run over Arrow batches. Results are JSON texts with sorted keys, so that equal objects are
equal texts; an answer without any object gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: roots that are looked for behind an object that was closed too early
ORPHANS = ("oda_kontenjanlari", "donem", "meta", "fiyatlar", "release", "stop_sale")
_SPACE = " \t\n\r\x0b\x0c\x85\xa0"
_LITERAL = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d*)?([eE][+-]?\d*)?")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.DOTALL)
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.DOTALL)


def _typed(number: str) -> object:
    """An integer of 64 bits, else a finite floating number, else its text."""
    if re.fullmatch(r"-?\d+", number) and -(1 << 63) <= int(number) < 1 << 63:
        return int(number)
    value = float(number)
    return value if abs(value) != float("inf") else number


def _whole(number: str) -> object:
    """``_typed`` of digits."""
    value = int(number)
    return value if -(1 << 63) <= value < 1 << 63 else _typed(number)


def _real(number: str) -> object:
    """``_typed`` of a number with a point or an exponent."""
    value = float(number)
    return value if abs(value) != float("inf") else number


def _refused(name: str) -> object:
    raise ValueError(name)


_STRICT = json.JSONDecoder(parse_int=_whole, parse_float=_real, parse_constant=_refused)


def _strict(text: str, at: int = 0) -> tuple[object, int] | None:
    try:
        return _STRICT.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None


def decoded(text: str) -> dict | None:
    """The one object that a text consists of."""
    found = _strict(text)
    return found[0] if found and isinstance(found[0], dict) and not text[found[1] :].strip() else None


def _unescaped(body: str) -> str | None:
    if re.search(r"\\u(?![0-9A-Fa-f]{4})", body.replace("\\\\", "")):
        return None
    plain = lambda m: _SHORT.get(m[1], m[1]) if len(m[1]) == 1 else chr(int(m[1][1:], 16))
    return re.sub(r"[\ud800-\udfff]", "�", _ESCAPE.sub(plain, body))


def _tolerant(text: str, at: int) -> tuple[object, int] | None:
    """A value that may break off: containers keep what was complete before the break."""
    at = _next(text, at)
    c = text[at : at + 1]
    if c == '"':
        m = _STRING.match(text, at)
        value = _unescaped(m[1]) if m else None
        return None if value is None else (value, m.end())
    if c in _LITERAL:
        word, value = _LITERAL[c]
        return (value, at + len(word)) if text.startswith(word, at) else None
    if c and c in "-0123456789":
        m = _NUMBER.match(text, at)
        broken = m is None or m[1] == "." or (m[2] is not None and not m[2][-1].isdigit())
        return None if broken else (_typed(m[0]), m.end())
    return _container(text, at, c) if c and c in "{[" else None


def _next(text: str, at: int) -> int:
    while at < len(text) and (text[at] in _SPACE or text[at].isspace()):
        at += 1
    return at


def _follow(text: str, at: int, closer: str) -> tuple[int, int | None]:
    """Where the next entry or the closer stands after a value, and where the container breaks off if neither does."""
    at = _next(text, at)
    if text[at : at + 1] == ",":
        return _next(text, at + 1), None
    return at, None if text[at : at + 1] == closer else at


def _container(text: str, at: int, opener: str) -> tuple[object, int]:
    """Entries up to the closer or to the first that cannot be read, and where reading stopped.

    Containers that are not finished yet stand on a stack, so that depth has no limit.
    """
    new = {"{": dict, "[": list}
    stack = [(new[opener](), None)]  # each container, and its key in the one around it
    at = _next(text, at + 1)
    while True:
        out = stack[-1][0]
        closer = "}" if isinstance(out, dict) else "]"
        end, key, value_at = None, None, at
        if at >= len(text) or text[at] == closer:
            end = min(at + 1, len(text))
        elif closer == "}":
            name = _tolerant(text, at) if text[at] == '"' else None
            colon = _next(text, name[1]) if name else len(text)
            if text[colon : colon + 1] == ":":
                key, value_at = name[0], colon + 1
            else:
                end = at
        if end is None:
            value_at = _next(text, value_at)
            if (c := text[value_at : value_at + 1]) and c in "{[":
                stack.append((new[c](), key))
                at = _next(text, value_at + 1)
                continue
            found = _tolerant(text, value_at)
            if found is None:
                end = at
            else:
                _put(out, key, found[0])
                at, end = _follow(text, found[1], closer)
        while end is not None:  # a finished container goes into the one around it, which may break off there
            done, key = stack.pop()
            if not stack:
                return done, end
            _put(stack[-1][0], key, done)
            at, end = _follow(text, end, "}" if isinstance(stack[-1][0], dict) else "]")


def _put(into: dict | list, key: str | None, value: object) -> None:
    if isinstance(into, dict):
        into[key] = value
    else:
        into.append(value)


def without_fence(text: str, holds: str = "{") -> str:
    """The inside of the first fence if it holds such a bracket (or is never closed), else the text."""
    start = text.find("```")
    if start < 0:
        return text
    rest = text.strip()
    rest = rest[rest.find("```") + 3 :]
    rest = (rest[4:] if rest[:4].lower() == "json" else rest).lstrip(" \t\r\n")
    inner, end, _ = rest.partition("```")
    if not end:
        return rest
    return inner.strip() if holds in inner else text


def span(text: str, opener: str, closer: str) -> str:
    i, j = text.find(opener), text.rfind(closer)
    return text[i : j + 1] if 0 <= i < j else ""


def without_early_closers(text: str) -> str:
    """Braces that would close the root before the end are taken out; strings are passed over."""
    out, at, depth = [], 0, 0
    for m in _TOKEN.finditer(text):
        c, drop = m[0], False
        if c == "}":
            drop = (depth <= 1 and m.end() < len(text)) or depth == 0
            depth -= not drop
        depth += c == "{"
        out.append(text[at : m.start()] + ("" if drop else c))
        at = m.end()
    return "".join(out) + text[at:]


def objects(text: str) -> list[dict]:
    """The objects that follow each other; of the first that is broken, what can be read."""
    out, at = [], text.find("{")
    while at >= 0:
        found = _strict(text, at)
        if found is None:
            partial = _container(text, at, "{")[0]
            return [*out, partial] if partial else out
        out.append(found[0])
        at = text.find("{", found[1])
    return out


def merged(into: dict, more: dict) -> dict:
    """Objects are merged key by key and lists are joined at every depth; otherwise the later value holds."""
    pairs = [(into, more)]
    while pairs:
        old, new = pairs.pop()
        for k, v in new.items():
            own = old.get(k)
            if isinstance(own, dict) and isinstance(v, dict):
                pairs.append((own, v))
            else:
                old[k] = own + v if isinstance(own, list) and isinstance(v, list) else v
    return into


def repair(raw: str | None) -> dict | None:
    """The object that a model's answer stands for."""
    text = without_fence((raw or "").strip())
    whole = span(text, "{", "}")
    found = decoded(whole) or decoded(without_early_closers(whole))
    if found is None:
        found = {}
        for part in objects(text):
            merged(found, part)
    return found or None


def _value_text(text: str) -> str:
    """The text of the value that a text begins with; a container that never ends is all there is."""
    text = text.strip()
    opener = text[:1]
    if opener in ("{", "["):
        depth, closer = 0, "}" if opener == "{" else "]"
        for m in re.finditer(rf'"(?:[^"\\]|\\.)*"?|[{re.escape(opener + closer)}]', text, re.DOTALL):
            depth += (m[0] == opener) - (m[0] == closer)
            if depth == 0:
                return text[: m.end()]
        return text.rstrip(", \t\r\n")
    m = _STRING.match(text) if opener == '"' else re.match(r"[^,}\] \n\r\t]*", text)
    return m[0] if m else ""


def orphans(raw: str) -> dict:
    """Known roots and the values that follow their names, wherever they stand."""
    text, parts, whole = raw.strip(), [], {}
    for key in ORPHANS:
        name, _, rest = f'"{key}"', None, text.partition(f'"{key}"')[2].strip()
        if rest[:1] != ":":
            continue
        rest = rest[1:].strip()
        # containers that can be read as they are need no search for their end
        if (found := _strict(rest) if rest[:1] in ("{", "[") else None) is not None:
            whole[key] = found[0]
            parts.append(f"{name}: {rest[: found[1]]}")
        elif value := _value_text(rest):
            parts.append(f"{name}: {value}")
    if len(whole) == len(parts) and "```" not in text:
        return whole
    return (repair("{" + ", ".join(parts) + "}") or {}) if parts else {}


def repair_part(raw: str | None) -> dict | None:
    """``repair``, with roots that an early closer left outside; those replace what was read before."""
    found = {**(repair(raw) or {}), **orphans(raw or "")}
    return found or None


def repair_findings(raw: str | None) -> list | None:
    """The array of a model's findings."""
    text = span(without_fence((raw or "").strip(), "["), "[", "]")
    found = _strict(text)
    return found[0] if found and isinstance(found[0], list) and found[1] == len(text) else None


def _inner(raw: str) -> str:
    m = re.search(r"```(?:json)?\s*([\s\S]*?)```", raw, re.IGNORECASE)
    return m[1].strip() if m else raw.strip()


def first_object(raw: str | None) -> dict | None:
    """The evaluator's reading: fence, first to last brace, strictly."""
    return decoded(span(_inner(raw or ""), "{", "}"))


def updated_objects(raw: str | None) -> dict | None:
    """The trainer's reading: every object that decodes, later keys over earlier ones."""
    text, out = _inner(raw or ""), {}
    at = text.find("{")
    while at >= 0:
        found = _strict(text, at)
        if found and isinstance(found[0], dict):
            out.update(found[0])
        at = text.find("{", found[1] if found else at + 1)
    return out or None


def _written(value: object) -> str | None:
    """JSON with sorted keys; null for nothing, and for a value nested too deeply to be written (about 1,000 levels, more than Spark reads)."""
    try:
        return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        return None


def _column(read: Callable[[str], object]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_written(read(t)) for t in texts], dtype=object)

    return run


repaired, part_repaired, findings_repaired = (_column(f) for f in (repair, repair_part, repair_findings))
first_read, updates_read = (_column(f) for f in (first_object, updated_objects))


def fence_stripped(text: Column, holds: str = "{") -> Column:
    """``without_fence`` as a column."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.substr(trimmed, F.instr(trimmed, "```") + 3), r"^(?i:json)?[ \t\r\n]*", "")
    inner = F.substring_index(rest, "```", 1)
    return F.when(~text.contains("```"), text).when(~rest.contains("```"), rest).when(inner.contains(holds), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(text)


def object_span(text: Column) -> Column:
    """From the first opening to the last closing brace; empty without both."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)

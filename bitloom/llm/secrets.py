"""Secret scanning: base patterns, and assignment-aware lexing that adds what they miss.

A lexer reads what stands from a line with an assignment sign on: names (dotted and subscripted ones too), signs, quoted strings
(over several lines in triple quotes) and bare literals, brackets and line breaks. Name and literal form a
pair in source syntax (``name = "x"``, ``name := x``, ``const NAME: str = 'x'``, ``name["part"] = "x"``), configuration syntax
(``name: x``, ``"name": "x"``, ``export NAME=x``) and calls with keywords. What stands in brackets belongs to the name before them, over as many
lines as the brackets take: elements of a list, arguments of a call, and the entries of an object or of an indented block, whose names are
paths. A name assigned from another name takes that name's
literals (constants propagate, also through ``+``, and from definitions that follow their use), so a literal is judged by every name that it
reaches. Its score is the sensitivity of the most sensitive of them times how much the literal looks like a credential.

Nulls and empty texts give no spans, whole texts of any length are read, repeated rows give repeated results, null ids stay null, an empty table
gives an empty result, other columns are ignored. A literal that two names reach counts once.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds as listed in a digest; "literal" is what the lexer adds.
KINDS = ("assign", "access", "hex", "literal")
#: The score from which a literal counts.
ACCEPT = 0.5
#: Parts of names and how sensitive a target that has them is (fixed values).
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.95, "credentials": 0.95,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "clientsecret": 1.0, "bearer": 0.9,
    "auth": 0.7, "authorization": 0.8, "connectionstring": 0.8, "dsn": 0.6, "salt": 0.6, "key": 0.55, "pin": 0.4, "license": 0.3,
}

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEX = re.compile(
    r"""(?P<string>\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<sign>:=|=>|==|!=|<=|>=|::|=|:)|(?P<plus>\+)"""
    r"""|(?P<bare>[0-9][^\s"',;(){}\[\]]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<stop>[,;])|(?P<line>\n)|(?P<space>(?:[ \t\r\f\v]|\\\n)+)|(?P<other>.)""",
    re.DOTALL,
)
_NEXT_SIGN = re.compile(r"[ \t]*(?::=|=>|=(?![=>])|:(?!:))")
_SUBSCRIPT = re.compile(r"""\[[ \t]*["']([^"'\n]+)["'][ \t]*\](?=[ \t]*=(?!=))""")
_INDENT = re.compile(r"[ \t]*(?:-[ \t]+)*")
_BARE = re.compile(r"[^\s\"',;(){}\[\]]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|nil|true|false|todo|changeme|example|your[_-].*|<.*>|\$\{.*|%\(.*|string|str|int|bool|float|bytes)$")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches, unsorted; places count code points, the end is exclusive."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """How sensitive a target of this name or path is: the best of its parts and joined neighbouring parts, nothing if its last part is harmless."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts = [p[:-1] if p.endswith("s") and p[:-1] in NAMES else p for p in parts]
    if parts and parts[-1] in ("id", "name", "url", "path", "file", "type", "count", "length", "size", "policy", "hint", "field", "expiry", "ttl", "user", "username", "host", "port", "email", "region", "version"):
        return 0.0
    joined = parts + ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return max((NAMES.get(p, 0.0) for p in joined), default=0.0)


def looks(literal: str) -> float:
    """How much a literal looks like a credential, from 0 to 1: its length, mixture of characters and entropy."""
    n = len(literal)
    if n < 6 or _PLACEHOLDER.match(literal) or any(c.isspace() for c in literal) and n < 20:
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in literal)
    return min(1.0, 0.25 + 0.15 * kinds + 0.1 * min(entropy, 4.0) + (0.1 if n >= 16 else 0.0)) * (1.0 if kinds > 1 else 0.5)


def _brackets(text: str, start: int) -> dict[int, int]:
    """Where each bracket that is opened from ``start`` on is closed; one that never is isn't listed."""
    out: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    for m in _LEX.finditer(text, start):
        if m.lastgroup == "open":
            opened.append((")]}"["([{".index(m.group())], m.start()))
        elif m.lastgroup == "close":
            at = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == m.group()), None)
            if at is not None:
                out[opened[at][1]] = m.start()
                del opened[at:]
    return out


#: A plus sign that goes on with an expression on the next line; the end of a line.
_PLUS, _BLANK = re.compile(r"[ \t]*\+"), re.compile(r"[^\S\n]*(?:\n|\Z)")


class _Level:
    """One open bracket, or the line itself: the path of names it belongs to, the assignment that its loose values go to, the one being read, and where it closes."""

    __slots__ = ("closes", "now", "outer", "path")

    def __init__(self, path: str, outer: tuple | None, closes: int):
        self.path, self.outer, self.closes, self.now = path, outer, closes, None


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], list[tuple[str, int, int]]]]:
    """(target name or path, spans of its literals, names that its value takes with their spans), for each assignment in the text."""
    out: list[tuple[str, list, list]] = []
    closing: dict[int, int] | None = None
    blocks: list[tuple[int, str]] = []  # indents and paths of lines that end with their sign
    pos, last_end = 0, 0
    while pos < len(text):
        end = text.find("\n", pos) + 1 or len(text)
        start = _INDENT.match(text, pos, end).end()
        indent = start - pos
        listed = blocks and text[pos:start].strip() == "-" and pos == last_end
        if not listed and text.find("=", start, end) < 0 and text.find(":", start, end) < 0:
            pos = end
            continue
        if pos != last_end:
            blocks.clear()  # other lines lie between
        while blocks and blocks[-1][0] >= indent:
            blocks.pop()
        path = blocks[-1][1] if blocks else ""
        levels = [_Level(path, (path, [], []) if listed else None, -1)]
        if listed:
            out.append(levels[0].outer)
            bare = _bare(text, start)
            if bare:
                levels[0].outer[1].append(bare)
                start = bare[1]
        first, pending, at = None, False, start
        while at < len(text):
            m = _LEX.match(text, at)
            kind, a, at = m.lastgroup, m.start(), m.end()
            level = levels[-1]
            holder = level.now or level.outer
            if kind == "space":
                continue
            if kind == "line":
                if len(levels) == 1 and not pending and not _PLUS.match(text, at):
                    break
                if len(levels) > 1 and level.now and (level.now[1] or level.now[2]):
                    level.now = None
                continue
            if kind in ("string", "name"):
                quotes = 0 if kind == "name" else 3 if m.group()[:3] in ('"""', "'''") else 1
                inside = text[a + quotes : at - quotes]
                part = _SUBSCRIPT.match(text, at) if kind == "name" else None
                key = inside + "." + part.group(1) if part else inside
                sign = _NEXT_SIGN.match(text, part.end() if part else at)
                if sign and level.now is None and (quotes == 0 or sign.group().strip() != "="):
                    level.now = (f"{level.path}.{key}" if level.path else key, [], [])
                    out.append(level.now)
                    first = first or level.now
                    at = sign.end()
                    bare = _bare(text, at)
                    if bare:
                        level.now[1].append(bare)
                        at = bare[1]
                    pending = not bare and _BLANK.match(text, at) and sign.group().strip() != ":"
                    continue
                if holder and kind == "string":
                    holder[1].append((a + quotes, at - quotes))
                elif holder and text[at : at + 1] != "(":
                    holder[2].append((inside, a, at))
            elif kind == "sign" and m.group() == "=" and level.now and level.now[2] and not level.now[1]:
                level.now[2].clear()  # "name: type = value"
                bare = _bare(text, at)
                if bare:
                    level.now[1].append(bare)
                    at = bare[1]
            elif kind == "sign" and m.group() == ":" and level.now and level.now[2] and not level.now[1]:
                key = level.now[2].pop()[0]  # "remark: name: value"
                level.now = (f"{level.path}.{key}" if level.path else key, [], [])
                out.append(level.now)
                bare = _bare(text, at)
                if bare:
                    level.now[1].append(bare)
                    at = bare[1]
            elif kind == "bare" and holder:
                holder[1].append((a, at))
            elif kind == "open":
                if closing is None:
                    closing = _brackets(text, pos)
                if a in closing:
                    levels.append(_Level(holder[0] if holder and m.group() == "{" else level.path, holder, closing[a]))
            elif kind == "close" and level.closes == a:
                levels.pop()
            elif kind == "stop" or kind == "other" and len(levels) == 1 and level.now and level.now[1]:
                level.now = None
            pending = kind in ("plus", "sign")
        if first and not first[1] and not first[2] and levels[0].now is first and text[start:at].rstrip().endswith(":"):
            blocks.append((indent, first[0]))
        pos = last_end = max(end, at)
    return [x for x in out if x[1] or x[2]]


def _bare(text: str, at: int) -> tuple[int, int] | None:
    """The literal without quotes that follows a sign on its line, if it isn't a name."""
    while at < len(text) and text[at] in " \t":
        at += 1
    m = _BARE.match(text, at)
    if not m or m.group()[0] in "`+" or m.group()[-1] == ":" or re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*", m.group()):
        return None
    return m.span()


def added_spans(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Literals outside base matches whose score, over all names that they reach, is accepted."""
    found = pairs(text)
    if not found:
        return []
    # The assignments that each one takes its names from: the last of that name before it, or else the first after it.
    defined: dict[str, list[int]] = {}
    for i, (target, _, _) in enumerate(found):
        defined.setdefault(target, []).append(i)
    sources: list[list[int]] = []
    for i, (_, _, names) in enumerate(found):
        at = [(defined[n], bisect.bisect_left(defined[n], i)) for n, _, _ in names if n in defined]
        sources.append([d[k - 1] if k else d[k] for d, k in at])
    # The highest sensitivities go back along these ways first, so that each assignment is reached once by each value.
    weights = [sensitivity(target) for target, _, _ in found]
    for start in sorted((i for i, w in enumerate(weights) if w), key=lambda i: -weights[i]):
        todo = [start]
        while todo:
            for k in sources[todo.pop()]:
                if weights[k] < weights[start]:
                    weights[k] = weights[start]
                    todo.append(k)
    best: dict[tuple[int, int], float] = {}
    for weight, (_, value, names) in zip(weights, found, strict=True):
        if weight:
            # a bare literal can look like a name
            for span in [*value, *((a, b) for n, a, b in names if n not in defined and any(c.isdigit() for c in n))]:
                best[span] = max(best.get(span, 0.0), weight)
    covered = sorted((a, b) for _, a, b in spans)
    out, at = [], 0
    for (a, b), weight in sorted(best.items()):
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if (at == len(covered) or covered[at][0] >= b) and weight * looks(text[a:b]) >= ACCEPT:
            out.append(("literal", a, b))
    return out


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base matches, base_sha256, and all spans, base and added, as text.

    A text without an assignment sign, ``AKIA`` or 24 hexadecimal characters in a row has neither a match nor a
    pair, so it isn't sent to Python.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                n = Counter(s[0] for s in base)
                spans = base + (added_spans(text, base) if text else [])
                rows.append((*[n[k] for k in KINDS[:3]], hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    text = F.when(F.col("text").rlike("[=:]|AKIA|[0-9a-f]{24}"), F.col("text")).alias("text")
    return docs.select("doc_id", text).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

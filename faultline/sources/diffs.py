"""Version-control text: name-status, numstat and zero-context patches."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .texts import ParseError

# Statuses, and the bounds of counts and lines.
STATUS = {"A": "added", "D": "deleted", "M": "modified", "T": "modified"}
MAX_COUNT = 9_007_199_254_740_991
MAX_LINE = 100_000_000
MAX_FILES, MAX_RANGES, MAX_LINES = 100_000, 100_000, 1_000_000


def _tokens(text: str) -> Iterator[str]:
    return iter(text[:-1].split("\0") if text.endswith("\0") else text.split("\0") if text else [])


def _take(tokens: Iterator[str]) -> str:
    token = next(tokens, "")
    if not token:
        raise ParseError(("incomplete-record", None))
    return token


def name_status(text: str) -> list[tuple[str, str, str | None]]:
    """(path, status, previous path)."""
    tokens, out = _tokens(text), []
    for code in tokens:
        if code[:1] == "R":
            before = _take(tokens)
            out.append((_take(tokens), "renamed", before))
        elif code[:1] in STATUS and code:
            out.append((_take(tokens), STATUS[code[0]], None))
        else:
            raise ParseError(("unsupported-status", None))
    return out


def numstat(text: str) -> list[tuple[str, int, int, bool]]:
    """(path, additions, deletions, binary)."""
    tokens, out = _tokens(text), []
    for record in tokens:
        fields = record.split("\t", 2)
        if len(fields) != 3 or not fields[0] or not fields[1]:
            raise ParseError(("malformed-statistics", None))
        added, removed, path = fields
        if not path:
            _take(tokens)
            path = _take(tokens)
        binary = added == removed == "-"
        if not binary and not (added.isascii() and added.isdigit() and removed.isascii() and removed.isdigit() and max(int(added), int(removed)) <= MAX_COUNT):
            raise ParseError(("invalid-line-count", None))
        out.append((path, 0, 0, True) if binary else (path, int(added), int(removed), False))
    return out


def changed_files(statuses: str, counts: str) -> list[tuple]:
    """Both outputs joined 1:1 on the final path."""
    stats = {p: rest for p, *rest in numstat(counts)}
    names = name_status(statuses)
    if {p for p, *_ in names} != set(stats) or len(names) != len(stats):
        raise ParseError(("statistics-mismatch", None))
    return [(path, before, status, *stats[path]) for path, status, before in names]


_RAW = re.compile(r":[0-7]{6} [0-7]{6} [0-9a-f]{7,64} [0-9a-f]{7,64} ([ADMRT])\d{0,3}")
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@(?: .*)?$", re.M)


def hunks(text: str, max_files: int = MAX_FILES, max_ranges: int = MAX_RANGES, max_lines: int = MAX_LINES) -> list[tuple[str, int | None, int | None]]:
    """(path, start, span); a path without ranges has one row of nulls."""
    if not text:
        return []
    head, found, body = text.partition("\0\0")
    bad = ParseError(("malformed-patch", None))
    if not found:
        raise bad
    paths, tokens = [], iter(head.split("\0"))
    for meta in tokens:
        match = _RAW.fullmatch(meta)
        if not match:
            raise bad
        if match[1] == "R" and not next(tokens, ""):
            raise bad
        path = next(tokens, "")
        if not path:
            raise bad
        paths.append(path)
    sections = re.split(r"^(?=diff --git )", body, flags=re.M)[1:]
    if len(paths) != len(sections):
        raise bad
    if len(paths) > max_files:
        raise ParseError(("file-limit", None))
    out, ranges, lines = [], 0, 0
    for path, section in zip(paths, sections, strict=True):
        matches = list(_HUNK.finditer(section))
        if len(matches) != len(re.findall(r"^@@ ", section, re.M)):
            raise bad
        end, own = 0, []
        for m in matches:
            start, span = int(m[1]), int(m[2] or 1) if m[2] != "0" else 0
            if start + span - 1 > MAX_LINE or start < (span > 0):
                raise bad
            if not span:
                continue
            if start <= end:
                raise bad
            end = start + span - 1
            own.append((path, start, span))
        ranges, lines = ranges + len(own), lines + sum(n for _, _, n in own)
        if ranges > max_ranges or lines > max_lines:
            raise ParseError(("range-limit" if ranges > max_ranges else "changed-line-limit", None))
        out += own or [(path, None, None)]
    return out

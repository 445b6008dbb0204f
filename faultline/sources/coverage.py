"""LCOV artifacts."""

from __future__ import annotations

import posixpath
import re

from .texts import ParseError

# Record prefixes that carry nothing used here, and the limits.
IGNORED = ("TN:", "VER:", "FN:", "FNDA:", "FNF:", "FNH:", "FNL:", "FNA:", "BRDA:", "BRF:", "BRH:", "MCDC:", "MCF:", "MCH:")
LIMITS = {"bytes": 10_000_000, "lines": 1_000_000, "line_length": 10_000, "records": 100_000, "path": 1_000, "data": 2_000_000}
MAX_LINE, MAX_HITS, MAX_ISSUES = 100_000_000, 9_007_199_254_740_991, 100


def inside(root: str, path: str) -> str | None:
    """The path relative to the root, None if it leaves it or isn't usable."""
    if not path or len(path) > LIMITS["path"] or "\0" in path or "\\" in path:
        return None
    out = posixpath.relpath(posixpath.normpath(posixpath.join(root, path)), root)
    return None if out == "." or out.startswith("../") or out == ".." else out


def _whole(text: str, low: int, high: int) -> int | None:
    return int(text) if re.fullmatch(r"[0-9]{1,16}", text) and low <= int(text) <= high else None


def _data(text: str) -> tuple[int, int] | None:
    """Line and hits; a third field is a checksum and not empty."""
    parts = text.split(",", 2)
    if len(parts) < 2 or (len(parts) == 3 and not parts[2]):
        return None
    line, hits = _whole(parts[0], 1, MAX_LINE), _whole(parts[1], 0, MAX_HITS)
    return None if line is None or hits is None else (line, hits)


def lcov(text: str, root: str = "/repo") -> list[tuple[str, int, int, int | None, int | None]]:
    """(path, lines_found, lines_hit, line, hits), a row of nulls for a record without lines."""
    if len(text.encode()) > LIMITS["bytes"]:
        raise ParseError(("file-size-limit", None))
    lines = re.split(r"\r?\n", text)
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    if len(lines) > LIMITS["lines"]:
        raise ParseError(("line-count-limit", None))
    issues: list[tuple[str, int | None]] = []
    records: dict[str, tuple[int, int, dict[int, int]]] = {}
    path, data, totals, begun, seen = None, {}, {}, 0, 0

    def issue(kind: str, line: int) -> None:
        full = len(issues) >= MAX_ISSUES - 1
        issues.append(("issue-limit" if full else kind, None if full else line))
        if full or kind in ("record-limit", "invalid-source-path", "data-line-limit"):
            raise ParseError(*issues)

    for at, raw in enumerate(lines, 1):
        tag, _, value = raw.partition(":")
        if len(raw) > LIMITS["line_length"]:
            issue("line-length-limit", at)
        elif not raw or raw.startswith("TN:"):
            continue
        elif tag == "SF" and raw[2:3] == ":":
            if path is not None:
                issue("unterminated-record", at)
                continue
            if len(records) >= LIMITS["records"]:
                issue("record-limit", at)
            path, data, totals, begun = inside(root, value), {}, {}, at
            if path is None:
                issue("invalid-source-path", at)
        elif raw == "end_of_record":
            if path is None:
                issue("invalid-record", at)
                continue
            found, hit = totals.get("LF"), totals.get("LH")
            if found is None or hit is None:
                issue("invalid-record", at)
            elif hit > found or len(data) != found or sum(h > 0 for h in data.values()) != hit:
                issue("summary-mismatch", at)
            elif path in records:
                issue("duplicate-source", begun)
            else:
                records[path] = (found, hit, data)
            path = None
        elif tag in ("DA", "LF", "LH") and ":" in raw:
            if path is None:
                issue("invalid-record", at)
            elif tag == "DA":
                seen += 1
                if seen > LIMITS["data"]:
                    issue("data-line-limit", at)
                pair = _data(value)
                if pair is None:
                    issue("invalid-data-line", at)
                elif pair[0] in data:
                    issue("duplicate-data-line", at)
                else:
                    data[pair[0]] = pair[1]
            else:
                n = _whole(value, 0, MAX_LINE)
                if n is None or tag in totals:
                    issue("invalid-record", at)
                else:
                    totals[tag] = n
        elif raw.startswith(IGNORED):
            if path is None:
                issue("invalid-record", at)
        else:
            issue("unsupported-record", at)
    if path is not None:
        issue("unterminated-record", len(lines))
    if issues:
        raise ParseError(*issues)
    return [(p, f, h, line, hits) for p, (f, h, d) in records.items() for line, hits in (d.items() or [(None, None)])]

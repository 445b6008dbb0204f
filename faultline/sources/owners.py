"""CODEOWNERS artifacts."""

from __future__ import annotations

import re

from ..functions.patterns import owner_regex
from .texts import ParseError

# Limits and what an owner looks like.
LIMITS = {"bytes": 1_000_000, "lines": 100_000, "line_length": 50_000, "pattern": 1_000, "owners": 100, "owner": 200, "rules": 10_000}
OWNER = re.compile(r"@[A-Za-z0-9][A-Za-z0-9_.-]*(?:/[A-Za-z0-9_.-]+)?|[^\s@]+@[^\s@]+")
MAX_ISSUES = 100


def content(line: str) -> str:
    """What stands before a comment."""
    return re.split(r"(?:^|\s)#", line, maxsplit=1)[0].strip()


def valid_owner(owner: str) -> bool:
    """P12."""
    return len(owner) <= LIMITS["owner"] and OWNER.fullmatch(owner) is not None


def codeowners(text: str) -> list[tuple[int, str, str, list[str]]]:
    """(ordinal, pattern, regex, owners)."""
    if len(text.encode()) > LIMITS["bytes"]:
        raise ParseError(("file-size-limit", None))
    lines = re.split(r"\r?\n", text)
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    if len(lines) > LIMITS["lines"]:
        raise ParseError(("line-count-limit", None))
    out, issues = [], []
    for at, raw in enumerate(lines, 1):
        pattern, *owners = content(raw).split() or [""]
        kind = None
        if len(raw) > LIMITS["line_length"]:
            kind = "line-length-limit"
        elif not pattern:
            continue
        elif len(pattern) > LIMITS["pattern"]:
            kind = "pattern-length-limit"
        elif owner_regex(pattern) is None:
            kind = "unsupported-pattern"
        elif len(owners) > LIMITS["owners"]:
            kind = "owner-count-limit"
        elif not all(map(valid_owner, owners)):
            kind = "invalid-owner"
        elif len(out) >= LIMITS["rules"]:
            kind = "rule-limit"
        if kind is None:
            out.append((len(out) + 1, pattern, owner_regex(pattern), list(dict.fromkeys(owners))))
        elif len(issues) == MAX_ISSUES - 1:
            raise ParseError(*issues, ("issue-limit", None))
        else:
            issues.append((kind, at))
    if issues:
        raise ParseError(*issues)
    return out

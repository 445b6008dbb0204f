"""Path patterns compiled on the driver to anchored regular expressions.

The expressions stay in the common subset of Java and RE2: no look-around,
``\\z`` for the end and ``(?s:.)`` for any character.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_PATTERN = 1_000


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/-" or ord(c) > 127 else "\\" + c


def glob_regex(pattern: str) -> str:
    """``**`` any characters, ``*`` and ``?`` within a segment, the rest literal."""
    if not 1 <= len(pattern) <= _MAX_PATTERN:
        raise ValueError("a glob has 1 to 1000 characters")
    parts = {"**": "(?s:.)*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t) or _literal(t) for t in re.findall(r"\*\*|(?s:.)", pattern)) + r"\z"


def _segment(text: str) -> str:
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or _literal(c) for c in text)


def owner_regex(pattern: str) -> str | None:
    """A CODEOWNERS pattern as a regex, None if it isn't supported.

    A literal ``*`` in a path is an ordinary character that ``*`` matches.
    """
    if pattern.startswith("!") or any(x in pattern for x in ("[", "]", "\\", "//", "\0")):
        return None
    body = pattern.removeprefix("/").rstrip("/")
    segments = body.split("/")
    if not body or any(s in (".", "..") for s in segments):
        return None
    below = pattern.endswith("/") or not set("*?") & set(segments[-1])
    tail = r"(?:/(?s:.)*)?\z" if below else r"\z"
    if not pattern.startswith("/") and len(segments) == 1:
        return r"(?:^|/)" + _segment(body) + tail if body != "**" else r"^(?s:.)*\z"
    out = "^"
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s != "**":
            out += _segment(s) + ("" if last else "/")
        elif not last:
            out += "(?:[^/]+/)*"
        else:
            out = (out[:-1] + r"(?:/(?s:.)*)?") if out.endswith("/") else out + r"(?s:.)*"
    return out + tail


def any_match(path: Column | str, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs; literal patterns compile once."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out

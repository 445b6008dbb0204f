"""Path expressions: areas, test keys, entry points and validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that pair a test with its source.
TS_EXTENSION, TS_MARK, TS_SEGMENTS = r"(?:\.d)?\.[cm]?[jt]sx?\z", r"\.(?:test|spec)\z", ("__tests__", "spec", "src", "test", "tests")
PY_EXTENSION, PY_SEGMENTS = r"\.pyi?\z", ("src", "tests")
TEST_MODULE = {"typescript": r"(?:^|/)(?:__tests__|test|tests|spec)(?:/|\z)|\.(?:test|spec)\.[cm]?[jt]sx?\z", "python": r"(?:^|/)tests/(?s:.)*\.py\z|(?:^|/)(?:test_[^/]+|[^/]+_test)\.py\z"}
ENTRY_POINT = r"(?i)(?:^|/)index\.(?:d\.)?[cm]?[jt]sx?\z"


def area(path: Column | str) -> Column:
    """The segment before the first slash, else ``(root)``."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def test_key(path: Column | str, language: str = "typescript") -> Column:
    """What a source and its tests have in common."""
    path = F.col(path) if isinstance(path, str) else path
    if language == "typescript":
        bare = F.regexp_replace(F.regexp_replace(path, TS_EXTENSION, ""), TS_MARK, "")
        return F.array_join(F.filter(F.split(bare, "/"), lambda s: ~s.isin(*TS_SEGMENTS)), "/")
    parts = F.split(F.regexp_replace(path, PY_EXTENSION, ""), "/")
    name = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), "^test_", ""), r"_test\z", "")
    folders = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: ~s.isin(*PY_SEGMENTS))
    return F.array_join(F.filter(F.concat(folders, F.array(name)), lambda s: s != ""), "/")


def is_entry_point(path: Column | str) -> Column:
    """P7."""
    return (F.col(path) if isinstance(path, str) else path).rlike(ENTRY_POINT)


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def valid_path(path: Column, longest: int = 1_000, dots: bool = False) -> Column:
    """Relative, normalised, bounded; ``dots`` permits single-dot segments."""
    parts = F.split(path, "/", -1)
    bad = ("", "..") if dots else ("", ".", "..")
    return path.isNotNull() & utf16_length(path).between(1, longest) & ~path.contains("\\") & ~path.contains("\0") & ~F.exists(parts, lambda s: s.isin(*bad))


def valid_module_path(path: Column, root: bool = False) -> Column:
    """P14 for graphs: relative and in normal form (a closing slash and a single dot stay); ``root`` permits the empty path."""
    inner = F.regexp_replace(path, r"/\z", "")
    normal = path.isin(".", "./") | (inner != "") & ~F.exists(F.split(inner, "/", -1), lambda s: s.isin("", ".", ".."))
    ok = path.isNotNull() & ~path.contains("\\") & ~path.contains("\0") & normal
    return ok | (path == "") if root else ok

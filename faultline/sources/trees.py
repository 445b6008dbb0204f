"""Source files of exported trees, as Spark reads them."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never searched, and the extensions of each language.
IGNORED = {"typescript": (".git", "build", "coverage", "dist", "node_modules", "vendor"), "python": (".git", ".nox", ".tox", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "vendor", "venv")}
EXTENSION = {"typescript": r"(?i)\.[cm]?[jt]sx?\z", "python": r"\.pyi?\z"}


#: Entries (files of any kind) that a search looks at.
MAX_ENTRIES = 100_000


def discover(spark: SparkSession, root: str, language: str = "typescript", max_files: int = 10_000, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the first ``max_files`` sources by path, and issues (kind, path).

    Issues tell that a limit was reached and, for a folder that this process
    can list, the links that are passed over. Ignored folders don't count as
    entries.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    inner = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    folders = F.slice(F.split("inner", "/"), F.lit(1), F.greatest(F.size(F.split("inner", "/")) - 1, F.lit(0)))
    links = _links(root, IGNORED[language])
    entries = raw.select(inner.alias("inner"), "content").where(~F.exists(folders, lambda s: s.isin(*IGNORED[language])))
    if links:
        under = [F.col("inner").startswith(x + "/") | (F.col("inner") == x) for x in links]
        entries = entries.where(~reduce(lambda a, b: a | b, under))
    issues = [("symlink-skipped", x) for x in links]
    if entries.select("inner").limit(max_entries + 1).count() > max_entries:
        entries = entries.orderBy("inner").limit(max_entries)
        issues.append(("entry-limit", None))
    found = entries.where(F.col("inner").rlike(EXTENSION[language]))
    if found.select("inner").limit(max_files + 1).count() > max_files:
        found = found.orderBy("inner").limit(max_files)
        issues.append(("file-limit", None))
    return found.select(F.col("inner").alias("path"), F.decode("content", "UTF-8").alias("text")), spark.createDataFrame(issues, "kind string, path string")


def _links(root: str, ignored: tuple[str, ...], most: int = 1_000) -> list[str]:
    """Paths of links below a local folder, in order."""
    at = root.removeprefix("file://")
    out: list[str] = []
    for folder, folders, files in os.walk(at):
        folders[:] = sorted(f for f in folders if f not in ignored)
        out += [os.path.relpath(os.path.join(folder, x), at) for x in (*folders, *files) if os.path.islink(os.path.join(folder, x))]
        if len(out) > most:
            raise ValueError("too many links")
    return sorted(out)

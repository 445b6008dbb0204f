"""Facts from a working copy, through the git executable."""

from __future__ import annotations

import os
import re
import subprocess

from . import diffs

MAX_OUTPUT = 4 << 20


class GitError(RuntimeError):
    """A stable message, without the program's own output."""


def run_git(root: str, *args: str, timeout: float = 10, max_output: int = MAX_OUTPUT) -> bytes:
    """Output of git in ``root``, without a shell."""
    try:
        done = subprocess.run(["git", *args], cwd=os.path.realpath(root), capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired) as error:
        raise GitError("git could not be run to its end") from error
    if done.returncode:
        raise GitError("git command failed")
    if len(done.stdout) > max_output:
        raise GitError("git output exceeds the limit")
    return done.stdout


def resolve_revision(root: str, revision: str) -> str:
    """The commit that a revision names."""
    if not revision or "\0" in revision:
        raise GitError("a revision is not empty and has no NUL")
    out = run_git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()
    if not re.fullmatch(r"[0-9a-f]{40,64}", out):
        raise GitError("git returned an invalid commit")
    return out


def changed_files(root: str, base: str, head: str, renames: int = 50) -> list[tuple]:
    """S3: (path, previous_path, status, additions, deletions, binary)."""
    if not 0 <= renames <= 100:
        raise ValueError("the rename threshold is 0 to 100")
    flags = ["diff", "-z", "--no-color", "--no-ext-diff", "--no-textconv", f"--find-renames={renames}%"]
    ends = [resolve_revision(root, base), resolve_revision(root, head), "--"]
    names, counts = (run_git(root, *flags, kind, *ends).decode() for kind in ("--name-status", "--numstat"))
    return sorted(diffs.changed_files(names, counts))


def changed_lines(root: str, base: str, head: str, paths: list[str], renames: int = 50) -> list[tuple]:
    """(path, start, span); no paths need no git."""
    if not paths:
        return []
    flags = "--raw -z --patch --unified=0 --abbrev=64 --no-color --no-ext-diff --no-textconv --diff-algorithm=myers --no-indent-heuristic --submodule=short".split()
    out = run_git(root, "--literal-pathspecs", "diff", *flags, f"--find-renames={renames}%", resolve_revision(root, base), resolve_revision(root, head), "--", *paths)
    return diffs.hunks(out.decode("utf-8", "replace"))


def read_blob(root: str, revision: str, path: str, max_bytes: int = 4_000_000) -> str:
    """A file's text at a revision."""
    if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", revision) or os.path.isabs(path) or os.path.normpath(path) != path or path.startswith("..") or "\0" in path:
        raise GitError("invalid revision or path")
    name = f"{revision}:{path}"
    if int(run_git(root, "cat-file", "-s", name)) > max_bytes:
        raise GitError("the file exceeds the limit")
    try:
        return run_git(root, "cat-file", "blob", name, max_output=max_bytes).decode()
    except UnicodeDecodeError as error:
        raise GitError("the file is not UTF-8") from error


def is_clean(root: str, revision: str) -> bool:
    """The working copy is exactly this revision."""
    return run_git(root, "rev-parse", "HEAD").decode().strip() == revision and not run_git(root, "status", "--porcelain").strip()

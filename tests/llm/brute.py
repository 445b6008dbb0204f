"""Plain-Python versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "assign": re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def secrets(text: str | None) -> tuple:
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]]
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    n = Counter(x[3] for x in found)
    return n["assign"], n["access"], n["hex"], sha(joined)


def owned(rows: list[tuple], max_owners: int = 2) -> dict[int, str]:
    """All spans of each row as the query writes them; the fourth column is the owner."""
    run = re.compile(r"[A-Za-z0-9+/_-]{24,}")
    found, owners = {}, defaultdict(set)
    for d, text, _, owner, *_ in rows:
        found[d] = [(m.start(), k, m.end(), m[1] if kind == "assign" else m[0]) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]]
        found[d] += [(m.start(), 3, m.end(), m[0]) for m in run.finditer(text or "") if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
        for *_, value in found[d]:
            owners[value].add(owner)
    out = {}
    for d, spans in found.items():
        base = [s for s in spans if s[1] < 3]
        stay = base + [s for s in spans if s[1] == 3 and len(owners[s[3]]) <= max_owners and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        out[d] = ",".join(f"{[*BASE, 'owned'][k]}:{a}:{b}" for a, k, b, _ in sorted(stay))
    return out


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    rep = {i + d for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n


def line_dedup(docs: dict[int, str | None]) -> dict[int, str]:
    seen, out = set(), {}
    for d in sorted(docs):
        lines = (docs[d] or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not WORD.search("".join(w)):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(t)
    if not words:
        return 0
    hs = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps: dict[int, int], budget: int = 3) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def near_copies(docs: dict[int, str | None], size: int = 5, similarity: float = 0.8) -> dict[int, int]:
    """The smallest id of each group that links of the given shingle similarity connect."""
    sets = {}
    for d, t in docs.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    ids = sorted(docs)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9 and a & b:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def substrings(docs: dict[int, str | None], size: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = [True] * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, sha(kept))
    return out


def substring_rows(rows: list[tuple], size: int = 100) -> list[tuple]:
    """``substrings`` where rows may share a doc_id: earlier is a smaller doc_id, or earlier in the row."""
    texts = [(-(1 << 63) if d is None else d, (x or "").encode()) for d, x in rows]
    least: dict = {}
    for d, b in texts:
        for i in range(len(b) - size + 1):
            least[b[i : i + size]] = min(d, least.get(b[i : i + size], d))
    out = []
    for (d, b), (shown, _) in zip(texts, rows, strict=True):
        gone, seen = [False] * len(b), set()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if least[w] < d or w in seen:
                gone[i : i + size] = [True] * size
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((shown or -1, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def word_windows(docs: dict[int, str | None], size: int = 35) -> dict[int, tuple]:
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    at = defaultdict(list)
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append((d, i))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + size))
    return {d: (len(w), len(gone[d]), sha(" ".join(x for i, x in enumerate(w) if i not in gone[d]))) for d, w in words.items()}

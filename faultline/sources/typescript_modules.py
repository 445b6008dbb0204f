"""TypeScript and JavaScript: a lexer, imports, exported signatures, resolution."""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import ParseError

# Extensions in the order in which a bare specifier tries them.
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".mts", ".d.mts", ".cts", ".d.cts", ".js", ".jsx", ".mjs", ".cjs")
OUTPUT = {".js": (".ts", ".tsx", ".d.ts", ".js"), ".jsx": (".ts", ".tsx", ".d.ts", ".jsx"), ".mjs": (".mts", ".d.mts", ".mjs"), ".cjs": (".cts", ".d.cts", ".cjs")}
MODULE = re.compile(r"\.[cm]?[jt]sx?\Z", re.I)

IMPORTS = "path string, ordinal int, specifier string, kind string, type_only boolean"
EXPORTS = "path string, name string, signature string"

_LEX = re.compile(
    r"""(?P<skip>[\s\uFEFF]+|//[^\n\r\u2028\u2029]*|/\*(?s:.)*?\*/)
    |(?P<string>'(?:\\(?s:.)|[^'\\\r\n])*'|"(?:\\(?s:.)|[^"\\\r\n])*")
    |(?P<number>\d[\w.]*|\.\d[\w.]*)
    |(?P<name>\#?[^\W\d][\w$]*|\$[\w$]*|\#\$[\w$]*)
    |(?P<op>=>|\.\.\.|\?\.|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|&&|\|\||\?\?|\+\+|--|[-+*%&|^/]=|(?s:.))""",
    re.X,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Token(tuple):
    """(text, kind, begins a line)."""

    text = property(lambda t: t[0])
    kind = property(lambda t: t[1])
    fresh = property(lambda t: t[2])


def _template(source: str, at: int) -> int:
    """The end of the template literal that begins at ``at``."""
    at += 1
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(source) and depth:
                c = source[at]
                if c == "`":
                    at = _template(source, at)
                    continue
                if c in "'\"":
                    m = _LEX.match(source, at)
                    at = m.end() if m and m.lastgroup == "string" else at + 1
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    raise ParseError(("parse-error", None))


def tokens(source: str, faults: list[int] | None = None) -> list[Token]:
    """The tokens of a source. What can't be read is an error or, with ``faults``, noted there by its place and passed over."""
    out: list[Token] = []
    at, fresh, stack = 0, True, []

    def fault(place: int) -> None:
        if faults is None:
            raise ParseError(("parse-error", None))
        faults.append(place)

    while at < len(source):
        if source[at] == "`":
            try:
                end, kind = _template(source, at), "template"
            except ParseError:
                fault(at)
                end, kind = at + 1, "op"
        elif source[at] == "/" and source[at + 1 : at + 2] not in ("/", "*") and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
            end, kind = m.end(), "regex"
        else:
            m = _LEX.match(source, at)
            end, kind = m.end(), m.lastgroup
            if kind == "skip":
                fresh |= "\n" in m[0]
                at = end
                continue
        text = source[at:end]
        if kind == "op":
            if text in _OPEN:
                stack.append(_OPEN[text])
            elif text in _CLOSE:
                if text in stack and (faults is not None or stack[-1] == text):
                    if stack.pop() != text:
                        fault(at)
                        while stack.pop() != text:
                            pass
                else:
                    fault(at)
            elif text in "'\"":
                fault(at)
        out.append(Token((text, kind, fresh)))
        at, fresh = end, False
    if stack:
        fault(len(source))
    return out


def _literal(token: Token) -> str | None:
    if token.kind == "string" or (token.kind == "template" and "${" not in token.text):
        return re.sub(r"\\(.)", r"\1", token.text[1:-1])
    return None


def _match(ts: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(ts)):
        if ts[k].kind == "op":
            depth += (ts[k].text in _OPEN) - (ts[k].text in _CLOSE)
            if not depth:
                return k
    return len(ts) - 1


def _only_types(clause: list[Token]) -> bool:
    """Whether every name between the braces is marked as a type."""
    parts, part = [], []
    for t in clause:
        if t.text == ",":
            parts.append(part)
            part = []
        else:
            part.append(t.text)
    parts = [p for p in (*parts, part) if p]
    return bool(parts) and all(p[0] == "type" and len(p) > 1 and p[1] != "as" for p in parts)


def imports(path: str, source: str) -> list[tuple]:
    """(path, ordinal, specifier, kind, type_only), in source order; a source with faults keeps what could be read."""
    faults: list[int] = []
    rows = [(path, n, *row) for n, row in enumerate(_references(tokens(source, faults)))]
    if faults:
        raise ParseError(("parse-error", source.count("\n", 0, faults[0]) + 1), rows=rows)
    return rows


def _substitutions(template: str) -> list[Token]:
    """Tokens of the expressions within a template literal."""
    out, at = [], template.find("${")
    while at >= 0:
        end = _substitution_end(template, at + 2)
        out += tokens(template[at + 2 : end], [])
        at = template.find("${", end)
    return out


def _substitution_end(text: str, at: int) -> int:
    depth = 1
    while at < len(text):
        if text[at] == "`":
            at = _template(text, at)
            continue
        depth += (text[at] == "{") - (text[at] == "}")
        if not depth:
            return at
        at += 1
    return at


def _references(ts: list[Token]) -> list[tuple[str, str, bool]]:
    out: list[tuple[str, str, bool]] = []
    text = lambda k: ts[k].text if 0 <= k < len(ts) else ""
    k = 0
    while k < len(ts):
        word, before = ts[k].text, text(k - 1)
        if ts[k].kind == "template":
            out += _references(_substitutions(word))
        if ts[k].kind != "name" or before in (".", "?."):
            k += 1
            continue
        if word in ("import", "require") and text(k + 1) == "(":
            value = _literal(ts[k + 2]) if k + 2 < len(ts) else None
            if value is not None and text(k + 3) in (")", ","):
                out.append((value, "dynamic-import" if word == "import" else "require", False))
        elif word == "import" and text(k + 1) != ".":
            if k + 1 < len(ts) and (value := _literal(ts[k + 1])) is not None:
                out.append((value, "import", False))
            else:
                marked = text(k + 1) == "type" and text(k + 2) not in ("from", "=", ",")
                at = k + 1
                while at < len(ts) and text(at) not in ("from", "=", ";") or text(at) == "from" and at == k + 1:
                    at = _match(ts, at) + 1 if text(at) == "{" else at + 1
                if text(at) == "=" and text(at + 1) == "require" and at + 3 < len(ts) and (value := _literal(ts[at + 3])) is not None:
                    out.append((value, "import-equals", marked))
                    at += 4
                elif text(at) == "from" and at + 1 < len(ts) and (value := _literal(ts[at + 1])) is not None:
                    clause = ts[k + 1 : at]
                    named = clause[0].text == "{" and _only_types(clause[1:-1])
                    out.append((value, "import", marked or named))
                    at += 1
                k = max(k, at)
        elif word == "export" and text(k + 1) in ("*", "{", "type"):
            at = k + 1 + (text(k + 1) == "type")
            braces = text(at) == "{"
            end = _match(ts, at) + 1 if braces else at + 1 + 2 * (text(at + 1) == "as")
            if text(at) in ("{", "*") and text(end) == "from" and end + 1 < len(ts) and (value := _literal(ts[end + 1])) is not None:
                out.append((value, "export", text(k + 1) == "type" or (braces and _only_types(ts[at + 1 : end - 1]))))
                k = end + 1
        k += 1
    return out


_STARTS = {"export", "import", "const", "let", "var", "function", "class", "interface", "type", "enum", "declare", "namespace", "module", "async", "abstract", "@", "if", "for", "while", "return", "switch", "try", "throw"}
_BLOCKS = {"function", "class", "interface", "enum", "namespace", "module"}


def _statements(ts: list[Token]) -> list[list[Token]]:
    """Top-level statements; a fresh line with a statement word ends the one before."""
    out, k = [], 0
    while k < len(ts):
        begin, block = k, None
        while k < len(ts):
            t = ts[k]
            if k > begin and t.fresh and t.text in _STARTS and ts[k - 1].text not in ("=", ",", "|", "&", "=>", ":", "export", "extends"):
                break
            if block is None and t.text in _BLOCKS and t.kind == "name":
                block = t.text
            if t.kind == "op" and t.text in _OPEN:
                typed = k > begin and ts[k - 1].text in (":", "|", "&", "<", ",", "=>")
                k = _match(ts, k) + 1
                if t.text == "{" and block and not typed and ts[begin].text in _STARTS and not (k < len(ts) and ts[k].text in ("{", "|", "&", "[")):
                    break
                continue
            k += 1
            if t.text == ";":
                break
        if k == begin:
            k += 1
        out.append(ts[begin:k])
    return out


def normalized(ts: list[Token]) -> str:
    """Tokens joined by one space, literals as they are."""
    return " ".join(t.text for t in ts)


def _members(body: list[Token]) -> list[list[Token]]:
    """A class body's members without method bodies and initialisers; private ones left out."""
    out, k = [], 0
    while k < len(body):
        if body[k].text == ";":
            k += 1
            continue
        begin, head, call = k, [], False
        while k < len(body):
            t = body[k]
            if t.text == ";" or (k > begin and t.fresh and not call and body[k - 1].text not in ("=", ",", ":", "|", "&", "=>")):
                break
            if t.text == "=" or (t.text == "{" and call and body[k - 1].text not in (":", "|", "&", "<", ",")):
                head.append(Token((";", "op", False)))
                while k < len(body) and body[k].text != ";":
                    if body[k].text in _OPEN:
                        closing = body[k].text == "{" and t.text == "{"
                        k = _match(body, k) + 1
                        if closing:
                            break
                        continue
                    if k > begin and body[k].fresh and t.text == "=" and body[k - 1].text not in ("=", ",", "=>", "(", "+", "||", "&&", "?", ":"):
                        break
                    k += 1
                break
            if t.text in _OPEN:
                end = _match(body, k) + 1
                call |= t.text == "("
                head += body[k:end]
                k = end
                continue
            head.append(t)
            k += 1
        if k == begin:
            k += 1
        if head and not any(t.text == "private" for t in head[:4]) and not any(t.text.startswith("#") for t in head[:5]):
            out.append(head if head[-1].text == ";" else head + [Token((";", "op", False))])
    return out


def _binding_names(ts: list[Token]) -> list[str]:
    """Names that a declaration list binds, patterns included."""
    out, k, expect = [], 0, True
    while k < len(ts):
        t = ts[k]
        if expect and t.kind == "name":
            out.append(t.text)
            expect = False
        elif expect and t.text in ("{", "["):
            end = _match(ts, k)
            part: list[Token] = []
            for x in (*ts[k + 1 : end], Token((",", "op", False))):
                if x.text == "," and sum(y.text in _OPEN for y in part) == sum(y.text in _CLOSE for y in part):
                    cut = next((i for i, y in enumerate(part) if y.text == ":"), -1)
                    part = [y for y in part[cut + 1 :] if y.text != "..."]
                    out += _binding_names(part[:1] if part and part[0].kind == "name" else part)
                    part = []
                else:
                    part.append(x)
            k, expect = end, False
        elif t.text in _OPEN:
            k = _match(ts, k)
        elif t.text == ",":
            expect = True
        k += 1
    return out


def exports(path: str, source: str) -> list[tuple[str, str, str]]:
    """(path, name, signature); several signatures of a name are one sorted text."""
    found: dict[str, set[str]] = {}
    for s in _statements(tokens(source)):
        words = [t.text for t in s]
        if "export" not in words[:1]:
            continue
        rest = s[1:]
        add = lambda name, signature: found.setdefault(name, set()).add(signature)
        if words[1:2] == ["{"] or words[1:3] == ["type", "{"]:
            begin = words.index("{")
            end = _match(s, begin)
            part: list[str] = []
            for t in (*words[begin + 1 : end], ","):
                if t == ",":
                    if part:
                        add(part[-1], normalized(s))
                    part = []
                else:
                    part.append(t)
        elif words[1:2] == ["*"]:
            module = next((v for t in s if (v := _literal(t)) is not None), None)
            add(f"*:{module}" if module is not None else "*", normalized(s))
        elif words[1:2] == ["="] or (words[1:2] == ["default"] and not {"function", "class", "interface"} & set(words[2:5])):
            add("default", normalized(s))
        else:
            kind = next((t for t in words[1:6] if t in _BLOCKS | {"const", "let", "var", "type"}), None)
            if kind == "const" and "enum" in words[1:5]:
                kind = "enum"
            at = words.index(kind) if kind else 0
            after = rest[at:]
            if after and after[0].text == "*":
                after = after[1:]
            name = "default" if "default" in words[1:3] else after[0].text if after and after[0].kind == "name" else None
            if kind in ("const", "let", "var"):
                for n in _binding_names(after):
                    add(n, normalized(s))
            elif name is None or kind is None:
                continue
            elif kind == "function":
                paren = next((k for k, t in enumerate(s) if t.text == "("), len(s) - 1)
                k = _match(s, paren) + 1
                while k < len(s) and not (s[k].text == "{" and s[k - 1].text not in (":", "|", "&", "<", ",", "=>")):
                    k = _match(s, k) + 1 if s[k].text in _OPEN else k + 1
                add(name, normalized(s[:k]) + " ;" if k < len(s) else normalized(s))
            elif kind == "class":
                brace = next(k for k, t in enumerate(s) if t.text == "{")
                add(name, " ".join([normalized(s[: brace + 1]), *(normalized(m) for m in _members(s[brace + 1 : _match(s, brace)])), "}"]))
            else:
                add(name, normalized(s))
    return [(path, name, "\n".join(sorted(v))) for name, v in sorted(found.items())]


def read_config(text: str) -> tuple[str | None, dict[str, list[str]]]:
    """(base url, path patterns) of a JSONC tsconfig; ``extends`` isn't followed."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?s:.)*?\*/', lambda m: m[1] or "", text)
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)
    try:
        options = (json.loads(bare) or {}).get("compilerOptions") or {}
    except (ValueError, AttributeError) as error:
        raise ParseError(("invalid-config", None)) from error
    base, paths = options.get("baseUrl"), options.get("paths") or {}
    root = "" if base is None else posixpath.normpath(base)
    if base is not None and (not isinstance(base, str) or posixpath.isabs(base) or root.startswith("..")):
        raise ParseError(("invalid-base-url", None))
    root = "" if root == "." else root
    out: dict[str, list[str]] = {}
    for pattern, targets in paths.items():
        if not isinstance(targets, list) or any(not isinstance(t, str) or t.count("*") > 1 for t in targets) or pattern.count("*") > 1:
            raise ParseError(("invalid-paths", None))
        joined = [posixpath.normpath(posixpath.join(root, t)) for t in targets]
        if any(posixpath.isabs(t) or t.startswith("..") for t in joined):
            raise ParseError(("invalid-paths", None))
        out[pattern] = joined
    return (None if base is None else root), out


def candidates(path: str) -> list[str]:
    """What a specifier's path may stand for, in order."""
    stem, extension = posixpath.splitext(path)
    if not extension:
        return [path + e for e in EXTENSIONS] + [posixpath.join(path, "index" + e) for e in EXTENSIONS]
    return [stem + e for e in OUTPUT.get(extension, (extension,))]


def targets(importer: str, specifier: str, base: str | None, paths: dict[str, list[str]]) -> tuple[list[str], str]:
    """Candidate paths in order, and the resolution if none exists."""
    if specifier.startswith(("./", "../")):
        at = posixpath.normpath(posixpath.join(posixpath.dirname(importer), specifier))
        return ([] if at.startswith("..") else candidates(at)), "unresolved"
    for pattern in sorted(paths, key=lambda p: (-len(p.replace("*", "", 1)), p)):
        head, star, tail = pattern.partition("*")
        if specifier == pattern if not star else specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail):
            middle = specifier[len(head) : len(specifier) - len(tail)] if star else ""
            return [c for t in paths[pattern] for c in candidates(t.replace("*", middle, 1))], "unresolved"
    return ([] if base is None else candidates(posixpath.normpath(posixpath.join(base, specifier)))), "external"


def resolve(modules: DataFrame, references: DataFrame, base: str | None = None, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """References with resolution and target_path, the first existing candidate winning.

    Distinct (folder, specifier) pairs are opened into ordered candidates and
    joined with the modules on repository and path.
    """
    @F.pandas_udf("struct<c: array<string>, otherwise: string>")
    def opened(importer: pd.Series, specifier: pd.Series) -> pd.DataFrame:
        made = [targets(i, s, base, paths or {}) for i, s in zip(importer, specifier, strict=True)]
        return pd.DataFrame({"c": [m[0] for m in made], "otherwise": [m[1] for m in made]})

    folder = F.regexp_replace("path", r"[^/]*\z", "x")
    keyed = references.withColumn("folder", folder)
    pairs = keyed.select("repository_id", "folder", "specifier").distinct().withColumn("t", opened("folder", "specifier"))
    tried = pairs.select("repository_id", "folder", "specifier", "t.otherwise", F.posexplode_outer("t.c").alias("k", "candidate"))
    have = modules.select(F.col("repository_id").alias("r"), F.col("path").alias("target_path")).distinct()
    hit = tried.join(have, (tried["repository_id"] == have["r"]) & (tried["candidate"] == have["target_path"]), "left")
    first = hit.groupBy("repository_id", "folder", "specifier", "otherwise").agg(F.min_by("target_path", F.when(F.col("target_path").isNotNull(), F.col("k"))).alias("target_path"))
    out = keyed.join(first, ["repository_id", "folder", "specifier"])
    return out.select(*references.columns, F.when(F.col("target_path").isNotNull(), "internal").otherwise(F.col("otherwise")).alias("resolution"), "target_path")



"""Python imports: an error-tolerant scan, and resolution as joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\f]+|\\\r?\n|\#[^\r\n]*)
    |(?P<string>(?i:[rbfut]{0,2})(?:'{3}(?s:\\.|.)*?(?:'{3}|\Z)|"{3}(?s:\\.|.)*?(?:"{3}|\Z)|'(?:\\(?s:.)|[^'\\\r\n])*'?|"(?:\\(?s:.)|[^"\\\r\n])*"?))
    |(?P<line>\r?\n|\r|;)|(?P<name>[^\W\d]\w*)|(?P<op>\.\.\.|.)""",
    re.X,
)

IMPORTS = "path string, ordinal int, specifier string, kind string, module string, relative_level int, imported_name string"


def _statements(source: str) -> list[list[str]]:
    """Tokens of each logical line; brackets join lines."""
    out, line, depth = [], [], 0
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "line" and not depth:
            out.append(line)
            line = []
        elif kind != "line":
            depth = max(0, depth + (text in "([{" and kind == "op") - (text in ")]}" and kind == "op"))
            line.append("''" if kind == "string" else text)
    return [s for s in (*out, line) if s]


def _dotted(tokens: list[str], at: int) -> tuple[str, int]:
    parts = []
    while at < len(tokens) and tokens[at].isidentifier() and tokens[at] not in ("import", "as"):
        parts.append(tokens[at])
        at += 1
        if at < len(tokens) - 1 and tokens[at] == "." and tokens[at + 1].isidentifier():
            at += 1
        else:
            break
    return ".".join(parts), at


def imports(path: str, source: str) -> list[tuple]:
    """(path, ordinal, specifier, kind, module, relative_level, imported_name)."""
    found: list[tuple[str, str, str, int, str | None]] = []
    for tokens in _statements(source):
        starts = [i for i, t in enumerate(tokens) if t in ("import", "from") and (i == 0 or tokens[i - 1] == ":")]
        if not starts:
            continue
        at = starts[0]
        if tokens[at] == "import":
            at += 1
            while at < len(tokens):
                module, at = _dotted(tokens, at)
                if module:
                    found.append((module, "import", module, 0, None))
                while at < len(tokens) and tokens[at] != ",":
                    at += 1
                at += 1
            continue
        at, level = at + 1, 0
        while at < len(tokens) and set(tokens[at]) == {"."}:
            level += len(tokens[at])
            at += 1
        module, at = _dotted(tokens, at)
        if at >= len(tokens) or tokens[at] != "import" or not (module or level):
            continue
        base = "." * level + module
        names = [t for t in tokens[at + 1 :] if t not in "()"]
        if names[:1] == ["*"]:
            found.append((base, "from", module, level, None))
            continue
        wanted = True
        for t in names:
            if t == ",":
                wanted = True
            elif wanted and t.isidentifier():
                found.append((base + ("" if not module else ".") + t, "from", module, level, t))
                wanted = False
    return [(path, k, *row) for k, row in enumerate(found)]


def identities(modules: DataFrame) -> DataFrame:
    """repository_id, path, identity, stem, package, root; the longer root first."""
    stem = F.regexp_replace("path", r"\.pyi?\z", "")
    parts = modules.select("repository_id", "path", F.split(stem, "/").alias("parts"), stem.alias("stem"))
    roots = parts.select("*", F.explode(F.array(F.lit("src"), F.lit(""))).alias("root")).where("root = '' OR (parts[0] = 'src' AND size(parts) > 1)")
    named = roots.withColumn("names", F.when(F.col("root") == "", F.col("parts")).otherwise(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(0)))))
    named = named.withColumns({"package": F.try_element_at("names", F.lit(-1)) == "__init__"})
    named = named.withColumn("folders", F.slice("names", F.lit(1), F.greatest(F.size("names") - 1, F.lit(0))))
    named = named.withColumn("identity", F.array_join(F.when(F.col("package"), F.col("folders")).otherwise(F.col("names")), "."))
    word = r"^[\p{javaUnicodeIdentifierStart}_]\p{javaUnicodeIdentifierPart}*\z"
    valid = named.where((F.col("identity") != "") & F.forall(F.split("identity", r"\."), lambda s: s.rlike(word)))
    prefix = F.when(F.col("root") == "", F.lit("")).otherwise(F.lit("src/"))
    need = F.transform(F.sequence(F.lit(1), F.size("folders")), lambda k: F.concat(prefix, F.array_join(F.slice("folders", F.lit(1), k), "/"), F.lit("/__init__")))
    valid = valid.withColumn("need", F.when(F.size("folders") > 0, need).otherwise(F.array().cast("array<string>")))
    have = modules.where(F.col("path").rlike(r"(?:^|/)__init__\.pyi?\z")).select(F.col("repository_id").alias("r"), F.regexp_replace("path", r"\.pyi?\z", "").alias("init")).distinct()
    asked = valid.select("repository_id", "path", "root", F.explode("need").alias("init"))
    missing = asked.join(have, (F.col("repository_id") == F.col("r")) & (asked["init"] == have["init"]), "left_anti").select("repository_id", "path", "root").distinct()
    return valid.join(missing, ["repository_id", "path", "root"], "left_anti").select("repository_id", "path", "identity", "stem", "package", "root")


def resolve(modules: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References with resolution and target_path, and the identity issues.

    Equal identities with different stems are ambiguous, and so is whatever lies
    below them; of equal stems ``.py`` comes before ``.pyi``.
    """
    known = identities(modules)
    first = Window.partitionBy("repository_id", "path").orderBy(F.length("root").desc(), "identity")
    primary = known.withColumn("k", F.row_number().over(first)).where("k = 1").select("repository_id", F.col("path").alias("importer"), F.col("identity").alias("own"), F.col("package").alias("own_package"))
    named = known.groupBy("repository_id", "identity").agg(F.count_distinct("stem").alias("stems"), F.min_by("path", F.struct(F.col("path").endswith(".pyi"), F.col("path"))).alias("target"), F.array_sort(F.collect_set("path")).alias("paths"))
    issues = named.where("stems > 1").select("repository_id", F.lit("ambiguous-module").alias("kind"), F.explode("paths").alias("path"), F.col("identity").alias("specifier"))
    lost = modules.join(known.select("repository_id", "path"), ["repository_id", "path"], "left_anti").select("repository_id", F.lit("module-identity-unavailable").alias("kind"), "path", F.lit(None).cast("string").alias("specifier"))
    refs = references.join(primary, (references["path"] == primary["importer"]) & (references["repository_id"] == primary["repository_id"]), "left").drop(primary["repository_id"])
    package = F.when(F.col("own_package"), F.split("own", r"\.")).otherwise(F.slice(F.split("own", r"\."), F.lit(1), F.greatest(F.size(F.split("own", r"\.")) - 1, F.lit(0))))
    usable = F.col("own").isNotNull() & (F.size(package) > 0) & (F.col("relative_level") <= F.size(package))
    above = F.slice(package, F.lit(1), F.greatest(F.size(package) - F.col("relative_level") + 1, F.lit(0)))
    joined = lambda a, b: F.concat_ws(".", F.when(a != "", a), F.when(b != "", b))
    base = F.when(F.col("relative_level") == 0, F.col("module")).when(usable, joined(F.array_join(above, "."), F.col("module")))
    refs = refs.withColumn("base", base).withColumn("wanted", F.when(F.col("imported_name").isNull(), F.col("base")).otherwise(joined(F.col("base"), F.col("imported_name"))))
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda k: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), k), "."))
    tries = refs.select("repository_id", "path", "ordinal", F.explode(F.array_distinct(F.array_compact(F.array("wanted", "base")))).alias("identity"))
    doubtful = named.where("stems > 1").select("repository_id", F.col("identity").alias("prefix"))
    below = tries.select("*", F.explode(prefixes(F.col("identity"))).alias("prefix")).join(doubtful, ["repository_id", "prefix"], "left_semi").select("repository_id", "path", "ordinal", "identity").distinct()
    sure = tries.join(below, ["repository_id", "path", "ordinal", "identity"], "left_anti").join(named.where("stems = 1").select("repository_id", "identity", "target"), ["repository_id", "identity"])
    hits = sure.groupBy("repository_id", "path", "ordinal").agg(F.max_by("target", F.length("identity")).alias("target_path"))
    tops = named.select("repository_id", F.split_part("identity", F.lit("."), F.lit(1)).alias("top")).distinct().withColumn("ours", F.lit(True))
    top: Column = F.split_part(F.when(F.col("base") != "", F.col("base")).otherwise(F.col("wanted")), F.lit("."), F.lit(1))
    out = refs.withColumn("top", top).join(hits, ["repository_id", "path", "ordinal"], "left").join(tops, ["repository_id", "top"], "left")
    status = F.when(F.col("target_path").isNotNull(), "internal").when((F.col("relative_level") > 0) | F.col("ours"), "unresolved").otherwise("external")
    return out.select(*references.columns, status.alias("resolution"), "target_path"), issues.unionByName(lost)

from __future__ import annotations

import subprocess

import pytest
from faultline.sources import coverage, diffs, git, owners, python_modules, texts, trees, typescript_modules
from faultline.sources.texts import ParseError


def test_name_status_and_numstat():
    names = "D\0delete.ts\0R100\0old/name.ts\0new/name.ts\0M\0odd\tline\nname.ts\0M\0asset.bin\0A\0added.ts\0"
    counts = "0\t1\tdelete.ts\0" + "0\t0\t\0old/name.ts\0new/name.ts\0" + "2\t1\todd\tline\nname.ts\0-\t-\tasset.bin\0" + "2\t0\tadded.ts\0"
    assert diffs.changed_files(names, counts) == [
        ("delete.ts", None, "deleted", 0, 1, False), ("new/name.ts", "old/name.ts", "renamed", 0, 0, False), ("odd\tline\nname.ts", None, "modified", 2, 1, False),
        ("asset.bin", None, "modified", 0, 0, True), ("added.ts", None, "added", 2, 0, False),
    ]
    assert diffs.changed_files("", "") == []
    for a, b in (("C100\0a\0b\0", ""), ("A\0", ""), ("A\0a\0", ""), ("A\0a\0", "1\t-\ta\0"), ("A\0a\0", "x\t1\ta\0"), ("A\0a\0", "1\ta\0")):
        with pytest.raises(ParseError):
            diffs.changed_files(a, b)


def raw(path: str, status: str = "M") -> str:
    return f":100644 100644 {'a' * 40} {'b' * 40} {status}\0{path}"


def test_hunks():
    patch = raw("odd\tline\nname.ts") + "\0" + raw("gone.ts") + "\0\0" + "diff --git a/x b/x\n@@ -1,0 +2,2 @@ f\n+a\n+b\n@@ -8 +10 @@\n+c\n" + "diff --git a/y b/y\n@@ -4,2 +3,0 @@\n-x\n"
    assert diffs.hunks(patch) == [("odd\tline\nname.ts", 2, 2), ("odd\tline\nname.ts", 10, 1), ("gone.ts", None, None)]
    assert diffs.hunks("") == []
    for bad in ("x", raw("a") + "\0\0", raw("a") + "\0\0diff --git a b\n@@ broken @@\n", raw("a") + "\0\0diff --git a b\n@@ -1 +5,2 @@\n@@ -2 +6 @@\n"):
        with pytest.raises(ParseError):
            diffs.hunks(bad)
    with pytest.raises(ParseError):
        diffs.hunks(patch, max_lines=2)


LCOV = "TN:x\nSF:a.ts\nDA:1,3\nDA:2,0\nLF:2\nLH:1\nend_of_record\nSF:/repo/b.ts\nBRDA:1,0,0,1\nDA:4,1,sum\nLF:1\nLH:1\nend_of_record\nSF:zero.ts\nLF:0\nLH:0\nend_of_record\n"


def test_lcov():
    assert coverage.lcov(LCOV) == [("a.ts", 2, 1, 1, 3), ("a.ts", 2, 1, 2, 0), ("b.ts", 1, 1, 4, 1), ("zero.ts", 0, 0, None, None)]
    bad = {
        "SF:a.ts\nDA:1,1\nLF:2\nLH:1\nend_of_record": ("summary-mismatch", 5), "SF:a.ts\nDA:0,1": ("invalid-data-line", 2), "SF:a.ts\nDA:1,1\nDA:1,1": ("duplicate-data-line", 3),
        "SF:../x": ("invalid-source-path", 1), "XX:1": ("unsupported-record", 1), "DA:1,1": ("invalid-record", 1), "SF:a.ts\nLF:0": ("unterminated-record", 2),
    }
    for text, issue in bad.items():
        with pytest.raises(ParseError) as error:
            coverage.lcov(text)
        assert issue in error.value.issues, text
    with pytest.raises(ParseError) as error:
        coverage.lcov("DA:1,1\n" * 150)
    assert len(error.value.issues) == 100 and error.value.issues[-1] == ("issue-limit", None)


def test_codeowners():
    text = "# head\n* @global # all\n\n/docs/ @docs a@b.c @docs\n/apps/github\n"
    assert [(k, p, o) for k, p, _, o in owners.codeowners(text)] == [(1, "*", ["@global"]), (2, "/docs/", ["@docs", "a@b.c"]), (3, "/apps/github", [])]
    for line, kind in (("!secret.ts @a", "unsupported-pattern"), ("a.ts nobody", "invalid-owner")):
        with pytest.raises(ParseError) as error:
            owners.codeowners("* @x\n" + line)
        assert error.value.issues == [(kind, 2)]


def test_one_bad_artifact_spoils_only_itself(spark):
    table = spark.createDataFrame([("good", LCOV), ("bad", LCOV + "XX:1\n")], "artifact string, text string")
    rows, issues = texts.parse(table, "artifact", coverage.lcov, "path string, lines_found long, lines_hit long, line long, hits long")
    assert {r.key for r in rows.collect()} == {"good"} and rows.count() == 4
    assert [(r.key, r.issue) for r in issues.collect()] == [("bad", "unsupported-record")]


PY = """import os, package.module as alias
from . import local
from ..core import thing as value
from package import (submodule,
    name)
from package import *
x = __import__("dynamic"); s = '''
import no
'''
if x: import yes
def broken(:
    import late
"""


def test_python_imports():
    got = [(r[2], r[5]) for r in python_modules.imports("a.py", PY)]
    assert got[:8] == [("os", 0), ("package.module", 0), (".local", 1), ("..core.thing", 2), ("package.submodule", 0), ("package.name", 0), ("package", 0), ("yes", 0)]


def test_python_resolution(spark):
    paths = ["package/__init__.py", "package/module.py", "package/submodule.py", "package/nested/__init__.py", "package/nested/current.py", "package/nested/sibling.py", "selected.py", "selected.pyi", "clash.py", "src/clash.py", "bad-name.py"]
    modules = spark.createDataFrame([(1, p) for p in paths], "repository_id int, path string")
    main = "import os, package.module, selected, clash\nfrom package import submodule, exported_name\nimport package.missing.value\n"
    inner = "from .sibling import x\nfrom ..module import y\nfrom ...outside import bad\n"
    refs = [(1, *r) for p, s in (("selected.py", main), ("package/nested/current.py", inner)) for r in python_modules.imports(p, s)]
    out, issues = python_modules.resolve(modules, spark.createDataFrame(refs, "repository_id int, " + python_modules.IMPORTS))
    got = {r.specifier: (r.resolution, r.target_path) for r in out.collect()}
    assert got == {
        "os": ("external", None), "package.module": ("internal", "package/module.py"), "selected": ("internal", "selected.py"), "clash": ("unresolved", None),
        "package.submodule": ("internal", "package/submodule.py"), "package.exported_name": ("internal", "package/__init__.py"), "package.missing.value": ("unresolved", None),
        ".sibling.x": ("internal", "package/nested/sibling.py"), "..module.y": ("internal", "package/module.py"), "...outside.bad": ("unresolved", None),
    }
    assert {(r.kind, r.path) for r in issues.collect()} == {("ambiguous-module", "clash.py"), ("ambiguous-module", "src/clash.py"), ("module-identity-unavailable", "bad-name.py")}


TS = """import type {A} from './a';
import {type C} from './c';
import './side';
export type {B} from './b';
export {type D} from './d';
import x = require('./legacy.cjs');
const y = require('./common.cjs'), re = /import '.\\/no'/;
const z = import('./lazy.js'); const v = import(variable);
import def, {q as w} from "pkg"; // import 'no'
const t = `import 'no' ${require('yes')}`;
"""


def test_typescript_imports():
    assert [r[2:] for r in typescript_modules.imports("a.ts", TS)] == [
        ("./a", "import", True), ("./c", "import", True), ("./side", "import", False), ("./b", "export", True), ("./d", "export", True), ("./legacy.cjs", "import-equals", False),
        ("./common.cjs", "require", False), ("./lazy.js", "dynamic-import", False), ("pkg", "import", False), ("yes", "require", False),
    ]
    with pytest.raises(ParseError):
        typescript_modules.imports("a.ts", "function f( {")


def test_typescript_resolution(spark):
    base, paths = typescript_modules.read_config('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@missing/*": ["missing/*"],},},}')
    modules = spark.createDataFrame([(1, p) for p in ("src/index.ts", "src/util.ts", "src/folder/index.ts", "src/shared.ts")], "repository_id int, path string")
    refs = [(1, "src/index.ts", k, s, "import", False) for k, s in enumerate(("./util.js", "./folder", "@/shared", "@missing/item", "src/shared", "react", "../missing"))]
    table = spark.createDataFrame(refs, "repository_id int, " + typescript_modules.IMPORTS)
    got = {r.specifier: (r.resolution, r.target_path) for r in typescript_modules.resolve(modules, table, base, paths).collect()}
    assert got == {
        "./util.js": ("internal", "src/util.ts"), "./folder": ("internal", "src/folder/index.ts"), "@/shared": ("internal", "src/shared.ts"), "@missing/item": ("unresolved", None),
        "src/shared": ("internal", "src/shared.ts"), "react": ("external", None), "../missing": ("unresolved", None),
    }
    plain = {r.specifier: r.resolution for r in typescript_modules.resolve(modules, table).collect()}
    assert plain["src/shared"] == "external" and plain["../missing"] == "unresolved"
    for bad in ("{", '{"compilerOptions": {"baseUrl": "/abs"}}', '{"compilerOptions": {"paths": {"a": ["../../x"]}}}'):
        with pytest.raises(ParseError):
            typescript_modules.read_config(bad)


def signatures(source: str) -> dict[str, str]:
    return {n: s for _, n, s in typescript_modules.exports("i.ts", source)}


def test_exports():
    one = signatures("export class K { private a = 1; m(x: string): void { one(); } }\nexport function f(a: number): string { return 'x'; }\nexport const c = 'a  b';\nexport { q as alias } from './q';\nexport * from './all';\nexport default 5;\n")
    assert set(one) == {"K", "f", "c", "alias", "*:./all", "default"}
    two = signatures("export class K { private a = 2; #b = 3; m(x: string): void { two(); three() } }\nexport function f(a:number):string{return 'y'}\nexport const c = 'a b';\nexport { q as alias } from './q';\nexport * from './all';\nexport default 5;\n")
    assert {n for n in one if one[n] != two[n]} == {"c"}
    three = signatures("export const { one, two: deux, ...rest } = obj, [three] = arr;\nexport interface I { a: string }\nexport type U = 'x' | 'y'\nexport enum E { A }\nexport async function g(): Promise<{ a: 1 }> { }\n")
    assert set(three) == {"one", "deux", "rest", "three", "I", "U", "E", "g"}
    assert three["g"] == "export async function g ( ) : Promise < { a : 1 } > ;"


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.ts").write_text("one\ntwo\nthree\n")
    (tmp_path / "gone.ts").write_text("x\n")
    run("add", "-A")
    run("commit", "-qm", "base")
    (tmp_path / "a.ts").write_text("one\nTWO\nthree\nfour\n")
    (tmp_path / "gone.ts").unlink()
    (tmp_path / "new.bin").write_bytes(b"\0\1\2")
    run("add", "-A")
    run("commit", "-qm", "head")
    return str(tmp_path)


def test_git(repo):
    assert git.changed_files(repo, "HEAD~1", "HEAD") == [("a.ts", None, "modified", 2, 1, False), ("gone.ts", None, "deleted", 0, 1, False), ("new.bin", None, "added", 0, 0, True)]
    assert git.changed_files(repo, "HEAD", "HEAD") == []
    assert git.changed_lines(repo, "HEAD~1", "HEAD", ["a.ts"]) == [("a.ts", 2, 1), ("a.ts", 4, 1)]
    assert git.changed_lines(repo, "x", "y", []) == []
    head = git.resolve_revision(repo, "HEAD")
    assert git.read_blob(repo, head, "a.ts").startswith("one\nTWO") and git.is_clean(repo, head)
    for bad in (lambda: git.resolve_revision(repo, ""), lambda: git.resolve_revision(repo, "nope"), lambda: git.read_blob(repo, head, "../x"), lambda: git.read_blob(repo, head, "a.ts", 3)):
        with pytest.raises(git.GitError):
            bad()


def test_trees(spark, tmp_path):
    for p in ("src/a.ts", "src/b.PY", "src/c.py", "node_modules/x/d.ts", "src/e.d.mts", "readme.md"):
        at = tmp_path / "tree" / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("text of " + p)
    (tmp_path / "tree" / "src" / "link.ts").symlink_to(tmp_path / "tree" / "src" / "a.ts")
    look = lambda *args, **more: [sorted(map(tuple, x.collect())) for x in trees.discover(spark, str(tmp_path / "tree"), *args, **more)]
    link = ("symlink-skipped", "src/link.ts")
    assert look() == [[("src/a.ts", "text of src/a.ts"), ("src/e.d.mts", "text of src/e.d.mts")], [link]]
    assert look("python", 1) == [[("src/c.py", "text of src/c.py")], [link]]
    assert look(max_files=1) == [[("src/a.ts", "text of src/a.ts")], [("file-limit", None), link]]
    assert look(max_entries=2) == [[("src/a.ts", "text of src/a.ts")], [("entry-limit", None), link]]


def test_sources_with_faults_keep_their_imports():
    source = "import a from 'a';\nfunction f( {\nimport b from './b';\n}\nconst s = 'open\nexport * from 'c'\n`never closed ${x"
    with pytest.raises(ParseError) as error:
        typescript_modules.imports("x.ts", source)
    assert error.value.issues[0][0] == "parse-error"
    assert [r[2] for r in error.value.rows] == ["a", "./b", "c"]
    assert [r[2] for r in typescript_modules.imports("x.ts", "import a from 'a'\nexport { b } from './b'")] == ["a", "./b"]

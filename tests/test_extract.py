import pytest
from pyspark.sql import functions as F

from riskloom.operators import extract as X
from riskloom.plans.engine import call_edges, import_edges
from riskloom.sources import files as SF


def one(text, language, name=None):
    found = X.extract(text, language)
    f = next(x for x in found if name is None or x["function"] == name)
    return f["cc"], f["nd"], f["fo"], f["ns"], f["loc"]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("TypeScript", "function f() {\n  return 1;\n}", (1, 0, 0, 0, 3)), ("TypeScript", "function f(x) {\n  if (x) {\n    return 1;\n  } else {\n    return 2;\n  }\n}", (4, 1, 0, 2, 7)),
        ("JavaScript", "const f = (a) => a && g(a);", (2, 0, 1, 0, 1)), ("JavaScript", "function f(a) {\n  a.b.c(1);\n  for (const x of a) { if (x) continue; h(x) }\n}", (5, 2, 2, 1, 4)),
        ("JavaScript", "function f(a) {\n  switch (a) { case 1: g(); break; default: h(); }\n}", (6, 1, 2, 1, 3)), ("JavaScript", "function f() {\n  const s = `a ${'}'} if (`; // if (x) {\n  return /[/}]if/.test(s);\n}", (3, 0, 1, 0, 4)),
        ("Go", "package p\nfunc F(x int) int {\n\tif x > 1 && x < 5 {\n\t\treturn 1\n\t}\n\tpanic(\"no\")\n}", (4, 1, 1, 2, 6)), ("Java", "class A {\n  int f(int x) {\n    return x > 1 ? g(x) : 2;\n  }\n}", (2, 0, 1, 1, 3)),
        ("C", "int f(int a) {\n  while (a) { a--; if (a == 3) break; }\n  return a;\n}", (5, 2, 0, 2, 4)), ("Rust", "fn f(x: Option<i32>) -> i32 {\n    match x {\n        Some(v) if v > 1 => v,\n        _ => g(1),\n    }\n}", (6, 1, 1, 0, 6)),
        ("CSharp", "class A {\n  int F(string s) {\n    return G(s ?? \"x\");\n  }\n}", (2, 0, 1, 1, 3)), ("Python", "def f(x):\n    if x and g(x):\n        return 1\n    return [a for a in x if a]\n", (6, 1, 1, 2, 4)),
    ],
)
def test_metrics(language, text, want):
    assert one(text, language) == want


def test_names():
    ts = "class A { m() { return 1 } static async n(x: number): Promise<void> { await x } }\nexport const g = async () => { h() };\nlist.map(function (x) { return x });"
    assert [f["function"] for f in X.extract(ts, "TypeScript")] == ["m", "n", "g", "<anonymous>"]
    assert [f["function"] for f in X.extract("struct S; impl S { fn a(&self) {} }\nimpl T for S { fn b() { c(); } }\nfn d() {}", "Rust")] == ["S::a", "S::b", "d"]
    assert [f["line"] for f in X.extract("<template/>\n<script>\nfunction f() { x(); }\n</script>", "Vue")] == [3]
    assert X.extract("def broken(:", "Python") == X.extract("function f( {", "JavaScript") == X.extract("", "Go") == X.extract("x", "Fortran") == []


def test_typescript_and_javascript_agree():
    js = "function f(a) { try { g(a) } catch (e) { if (e) { throw e } } finally { h() } }"
    assert one(js, "JavaScript") == one(js.replace("(a)", "(a: number)", 1), "TypeScript") == one(js, "JavaScriptReact")


def test_deep_nesting_ends():
    X.extract("void f() {" + "if (a) {" * 3000 + "}" * 3000 + "}", "C")


def test_scan(spark, tmp_path):
    for path, text in {
        "src/a.ts": "import { b } from './b';\n// risk-ignore: known\nexport function a() { return b() && c(); }\n// risk-ignore\nfunction c() { if (x) { y(); } }\n", "src/b.ts": "export const b = () => { z(); };\n",
        "src/types.d.ts": "declare function q(): void;", "node_modules/x.js": "function no() {}", "src/a.test.ts": "function no() {}", "lib/m.py": "from .n import k\ndef m():\n    k()\n", "lib/n.py": "def k():\n    pass\n",
        "big.js": ("x" * 1001 + "\n") * 3, "third_party/v.js": "function no() {}", "notes.txt": "function no() {}",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = SF.source_files(spark, str(tmp_path)).persist()
    assert sorted(r["path"] for r in files.collect()) == ["lib/m.py", "lib/n.py", "src/a.ts", "src/b.ts"]
    rep = X.reports(files).persist()
    assert {r["function_id"]: r["suppression_reason"] for r in rep.collect()} == {"src/a.ts::a": "known", "src/a.ts::c": "", "src/b.ts::b": None, "lib/m.py::m": None, "lib/n.py::k": None}
    imports = import_edges(files)
    assert sorted(tuple(r) for r in imports.collect()) == [("lib/m.py", "lib/n.py"), ("src/a.ts", "src/b.ts")]
    assert sorted(tuple(r) for r in call_edges(rep, imports).collect()) == [("lib/m.py::m", "lib/n.py::k"), ("src/a.ts::a", "src/a.ts::c"), ("src/a.ts::a", "src/b.ts::b")]


def test_text_columns(spark):
    df = spark.createDataFrame([("Go", 'import (\n\t"fmt"\n\tx "a/b"\n)\ntype User struct {\n'), ("Java", "import a.B;\npublic final class Order {\n"), ("Python", "import os\nfrom . import y\nclass P:\n"), ("TypeScript", "const a = require('z'); export interface Q {}\nimport b from \"w\";\nexport class R {}"), ("Rust", "use crate::a::b;\npub struct T;")], "l string, t string")
    got = {r["l"]: (r["i"], r["m"]) for r in df.select("l", SF.raw_imports(F.col("t"), F.col("l")).alias("i"), SF.model_names(F.col("t"), F.col("l")).alias("m")).collect()}
    assert got == {"Go": (["fmt", "a/b"], ["User"]), "Java": (["a.B"], ["Order"]), "Python": (["os", "."], ["P"]), "TypeScript": (["z", "w"], ["R"]), "Rust": (["crate::a::b"], ["T"])}
    paths = spark.createDataFrame([("a/b/../c/./d",), ("x",)], "p string")
    assert [r[0] for r in paths.select(SF.normalized(F.col("p"))).collect()] == ["a/c/d", "x"]


def test_imports_of_other_languages(spark):
    files = [
        ("Java", "x/src/a/b/C.java", "import java.util.List;\nimport d.D;\n"), ("Java", "x/src/d/D.java", "import a.b.C;\n"), ("Go", "m/util/u.go", "package util\n"), ("Go", "m/main.go", 'import "e.org/m/util"\n'),
        ("Rust", "k/src/lib.rs", "use crate::p::q::Thing;\n"), ("Rust", "k/src/p/q.rs", "use super::r::X;\n"), ("Rust", "k/src/p/mod.rs", ""), ("Rust", "k/src/r.rs", ""), ("Rust", "w/src/main.rs", ""),
    ]
    df = spark.createDataFrame([(p, lang, t) for lang, p, t in files], "path string, language string, text string")
    manifests = spark.createDataFrame([("w", 'k = { path = "../k" }'), ("k", '[package]\nname = "my-k"')], "directory string, text string")
    got = sorted(tuple(r) for r in import_edges(df, manifests).collect())
    assert got == [("k/src/lib.rs", "k/src/p/q.rs"), ("k/src/p/q.rs", "k/src/r.rs"), ("m/main.go", "m/util/u.go"), ("w/src/main.rs", "k/src/lib.rs"), ("x/src/a/b/C.java", "x/src/d/D.java"), ("x/src/d/D.java", "x/src/a/b/C.java")]
    assert [tuple(r) for r in SF.crate_names(manifests).collect()] == [("my_k", "k/src")]
    paths = spark.createDataFrame([("a/package.json",), ("go.mod",), ("b/x.ts",)], "path string")
    assert sorted(r[0] for r in SF.manifest_dirs(paths).collect()) == [".", "a"]

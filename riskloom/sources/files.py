"""Source files: listing, languages, guards, and what can be read from their text without parsing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {
    "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TypeScriptReact", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScriptReact", "mjsx": "JavaScriptReact", "cjsx": "JavaScriptReact",
    "mtsx": "TypeScriptReact", "ctsx": "TypeScriptReact", "go": "Go", "java": "Java", "py": "Python", "pyw": "Python", "rs": "Rust", "vue": "Vue", "cs": "CSharp", "c": "C", "h": "CHeader",
}
SKIPPED = sorted("__generated__ __pycache__ build coverage dist generated node_modules out storybook-static target vendor venv".split())
VENDORED = "/(vendors?|third_?party|(assets|dist|public|static)/js)/"
_DIRS = ".cache .next .nuxt .output .turbo .venv __generated__ __mocks__ __pycache__ __snapshots__ __tests__ build contrib deps dist extern external generated migrations node_modules out storybook-static target third_party thirdparty vendor venv"
_FILES = "*.bundle.js *.generated.js *.generated.ts *.min.js *.min.ts *.pb.go *.pb.js *.pb.ts *_test.go *_test.py mock_*.go test_*.py zz_generated*.go"
#: Tests, generated and vendored files, build output.
DEFAULT_EXCLUDES = (*(f"**/*.{kind}.{ext}" for kind in ("spec", "test") for ext in ("js", "jsx", "ts", "tsx")), *(f"**/{d}/**" for d in _DIRS.split()), *(f"**/{f}" for f in _FILES.split()))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path's extension, NULL for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path))


def is_supported(path: Column) -> Column:
    return language(path).isNotNull() & ~path.endswith(".d.ts")


def in_skipped_dir(path: Column) -> Column:
    """Whether a directory on the relative path is one that scans pass over, dot directories among them."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1).rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED)) + "|\\.[^/.][^/]*)(/|$)")


def is_minified(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.length(x) > 1000)) >= 3, F.lit(False))


def is_vendored(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(path)).rlike(VENDORED)


def source_tokens(text: Column) -> Column:
    """The distinct words of identifier characters."""
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9_$]+"), lambda t: t != ""))


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob: ** spans directories, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def included(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Excludes (the defaults always among them) come first, then includes, if there are any."""
    out = ~path.rlike("|".join(glob_regex(g) for g in (*DEFAULT_EXCLUDES, *exclude)))
    return out & path.rlike("|".join(map(glob_regex, include))) if include else out


def source_files(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(path, language, text) of the files to analyze below root; paths are relative. Paths are filtered before contents are read."""
    base = root.rstrip("/")
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    x = x.withColumn("rel", F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.split("://")[-1]) + "/", ""))
    p = F.col("rel")
    x = x.filter(is_supported(p) & ~in_skipped_dir(p) & ~is_vendored(p) & included(p, include, exclude))
    out = x.select(p.alias("path"), language(p).alias("language"), F.decode("content", "utf-8").alias("text"))
    return out.filter(~is_minified(F.col("text")))


MARKER = "risk-ignore"


def suppression(text: Column, line: Column, marker: str = MARKER) -> Column:
    """What the comment on the line before a function (1-based) says: NULL without the marker, '' without a reason, else the reason."""
    before = F.trim(F.when(line > 1, F.try_element_at(F.split(text, "\n"), (line - 1).cast("int"))))
    return F.when(before.startswith(f"// {marker}"), F.trim(F.regexp_extract(before, "^[^:]*:?(.*)$", 1)))


IMPORTS = {
    "JavaScript": r"""(?:import\s+(?:[^'"();]*?\s+from\s+)?|export\s+[^'"();]*?\s+from\s+|require\s*\(\s*|import\s*\(\s*)['"]([^'"]+)['"]""",
    "Go": r"""(?m)^\s*(?:import\s+)?(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"\s]+)"\s*$""",
    "Python": r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+))",
    "Java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "CSharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;",
    "Rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
}
_ECMA = ["TypeScript", "TypeScriptReact", "JavaScript", "JavaScriptReact", "Vue"]


def raw_imports(text: Column, lang: Column) -> Column:
    """The import strings of a file, each once, in order."""
    out = F.array().cast("array<string>")
    for name, pattern in IMPORTS.items():
        test = lang.isin(*_ECMA) if name == "JavaScript" else lang == name
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        if name == "Python":
            second = F.regexp_extract_all(text, F.lit(pattern), 2)
            found = F.zip_with(found, second, lambda a, b: F.when(a != "", a).otherwise(b))
        out = F.when(test, F.array_distinct(found)).otherwise(out)
    return out


def crate_names(manifests: DataFrame) -> DataFrame:
    """manifests (directory, text) -> (crate, src_dir): package names as in use paths."""
    name = F.regexp_replace(F.regexp_extract("text", '(?s)\\[package\\].*?name\\s*=\\s*"([^"]+)"', 1), "-", "_")
    return manifests.select(name.alias("crate"), F.concat("directory", F.lit("/src")).alias("src_dir")).filter("crate <> ''")


def normalized(path: Column) -> Column:
    """A path without '.' and 'x/..' parts."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ecmascript_candidates(path: Column, target: Column) -> Column:
    """Where a relative import may lie: the path itself, then eight extensions, then four index files; none for packages."""
    base = normalized(F.concat_ws("/", F.regexp_extract(path, "^(.*)/[^/]*$", 1), target))
    tails = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    return F.when(target.startswith("."), F.array(*[F.concat(base, F.lit(t)) for t in tails])).otherwise(F.array().cast("array<string>"))


def python_candidates(path: Column, target: Column) -> Column:
    """Where a module may lie: beside the file for relative names, one level up for each further dot; else from the root."""
    dots = F.length(F.regexp_extract(target, "^(\\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(target, "^\\.+", ""), "\\.", "/")
    here = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    base = normalized(F.concat_ws("/", F.when(dots > 0, F.concat_ws("/", here, F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/"))).otherwise(""), rest))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def rust_candidates(path: Column, target: Column) -> Column:
    """Where a use path may lie below the crate's src or, for super and self, the file's module: the longest prefix first, as x.rs or x/mod.rs."""
    parts = F.split(F.regexp_replace(target, "^(crate|self|super)(::)?", ""), "::")
    root = F.when(target.startswith("super"), F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/?[^/]*$", "")).when(target.startswith("self"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.regexp_extract(path, "^(.*?\\bsrc)/", 1))
    sizes = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))))
    each = F.transform(sizes, lambda n: F.concat_ws("/", F.nullif(root, F.lit("")), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    found = F.flatten(F.transform(each, lambda x: F.array(F.concat(x, F.lit(".rs")), F.concat(x, F.lit("/mod.rs")))))
    return F.when(target.rlike("^(crate|self|super)(::|$)"), found).otherwise(F.array().cast("array<string>"))


STDLIB = "^(java|javax|jdk|sun|org\\.w3c|System|Microsoft)(\\.|$)"


def suffix_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw (src_file, target) of Java and C#, files (file) -> (src_file, dst_file): the file whose path ends in the class's, the smallest of several. Each file is exploded into its suffixes, so the join is by equality."""
    ext = F.regexp_extract("src_file", "(\\.[a-z]+)$", 1)
    want = raw.filter(~F.col("target").rlike(STDLIB)).select("src_file", F.concat(F.regexp_replace(F.regexp_replace("target", "\\.\\*$", ""), "\\.", "/"), ext).alias("tail"))
    parts = F.split("file", "/")
    tails = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    hit = want.join(tails, "tail").groupBy("src_file", "tail").agg(F.min("file").alias("dst_file"))
    return hit.filter("src_file <> dst_file").select("src_file", "dst_file").distinct()


def package_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw (src_file, target) of Go, files (file) -> (src_file, dst_file): the smallest file of a directory named like the package."""
    folder = files.filter(F.col("file").endswith(".go")).select("file", F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("name")).filter("name <> ''").groupBy("name").agg(F.min("file").alias("dst_file"))
    want = raw.select("src_file", F.regexp_extract("target", "([^/]+)$", 1).alias("name"))
    return want.join(folder, "name").filter("src_file <> dst_file").select("src_file", "dst_file").distinct()


def manifest_dirs(paths: DataFrame) -> DataFrame:
    """paths (path) -> (directory): directories that a manifest marks as subsystems."""
    names = ["package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "pyproject.toml", "setup.py", "composer.json", "Gemfile"]
    p = F.col("path")
    hit = F.regexp_extract(p, "([^/]+)$", 1).isin(*names) | p.endswith(".csproj")
    d = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    return paths.filter(hit).select(F.when(d == "", ".").otherwise(d).alias("directory")).distinct()


def workspace_edges(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """manifests (directory, text) of crates, files (file) -> (src_file, dst_file): each source of a crate with the library root of every crate that its manifest names by path."""
    deps = manifests.select("directory", F.explode(F.regexp_extract_all("text", F.lit('path\\s*=\\s*"([^"]+)"'), 1)).alias("rel"))
    libs = deps.select("directory", F.concat(normalized(F.concat_ws("/", "directory", "rel")), F.lit("/src/lib.rs")).alias("dst_file")).join(files.select(F.col("file").alias("dst_file")), "dst_file", "left_semi")
    parts = F.split("file", "/")
    own = files.filter(F.col("file").endswith(".rs")).select(F.col("file").alias("src_file"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("directory"))
    return own.join(libs, "directory").filter("src_file <> dst_file").select("src_file", "dst_file").distinct()


MODELS = {
    "TypeScript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|type|enum)\s+([A-Z]\w*)",
    "Go": r"(?m)^\s*type\s+([A-Z]\w*)\s+(?:struct|interface)\b",
    "Java": r"(?m)^\s*(?:public\s+|protected\s+|private\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|record|enum)\s+([A-Z]\w*)",
    "CSharp": r"(?m)^\s*(?:public\s+|internal\s+|protected\s+|private\s+|abstract\s+|sealed\s+|static\s+|partial\s+)*(?:class|interface|record|struct|enum)\s+([A-Z]\w*)",
    "Python": r"(?m)^\s*class\s+([A-Z]\w*)",
    "Rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Z]\w*)",
    "C": r"(?m)^\s*(?:typedef\s+)?struct\s+([A-Za-z_]\w*)\s*\{",
}


def model_names(text: Column, lang: Column) -> Column:
    """The declared data models of a file, each once, in order."""
    out = F.array().cast("array<string>")
    for name, pattern in MODELS.items():
        test = lang.isin(*_ECMA) if name == "TypeScript" else lang == name
        out = F.when(test, F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).otherwise(out)
    return out


def line_of(text: Column, piece: Column) -> Column:
    """The 1-based line on which a piece of text first stands."""
    at = F.instr(text, piece)
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at), "\n")))

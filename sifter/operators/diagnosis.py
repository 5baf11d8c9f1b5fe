"""What kind of project a file listing is, and what suits it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded

# Fixed values.
MARKERS = {
    "package.json": "node-bun", "tsconfig.json": "node-bun", "bun.lockb": "bun", "Cargo.toml": "rust", "go.mod": "go", "pyproject.toml": "python",
    "setup.py": "python", "requirements.txt": "python", "pom.xml": "java-maven", "build.gradle": "java-gradle", "build.gradle.kts": "java-gradle",
    "composer.json": "php", "Gemfile": "ruby", "mix.exs": "elixir", "CMakeLists.txt": "cmake", "Package.swift": "swift",
}
CODE = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "kt", "swift", "rb", "php", "cs", "cpp", "c", "h", "ex", "exs", "scala", "lua")
DOCS = ("md", "markdown", "txt", "rst", "adoc", "org")
EXCLUDED = ("node_modules", ".git", "dist", "build", ".next", "out", "target", ".venv", "venv", "__pycache__", ".cache", "coverage", ".idea", ".vscode", ".claude")
DEPTH = 2
ADVICE = {"coding": ("reduce command noise", "compress tool output", "index the code graph"), "docs": ("search first", "disclose step by step"), "mixed": ("compress tool output", "search first", "index the code graph"), "empty": ("nothing yet",)}


def listed(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """files(project, path, seq): those not too deep and in no excluded folder."""
    parts = F.split("path", "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return files.where((F.size(parts) - 1 <= depth) & ~F.exists(folders, lambda d: d.isin(*EXCLUDED)))


def diagnose(files: DataFrame) -> DataFrame:
    """One row per project: kind, subtype, counts, share of documents and advice. ``seq`` says in which order files are met."""
    name = F.element_at(F.split("path", "/", -1), -1)
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+?\.([^.]*)$", 1))
    kind = F.when(ext.isin(*CODE), "code").when(ext.isin(*DOCS), "docs").otherwise("other")
    marker = F.when(name.isin(*MARKERS), name)
    rows = listed(files).select("project", "seq", kind.alias("kind"), marker.alias("marker"))
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = rows.groupBy("project").agg(n("code").alias("code"), n("docs").alias("docs"), n("other").alias("other"), F.min(F.when(F.col("marker").isNotNull(), F.struct("seq", "marker"))).alias("first"))
    every = files.select("project").distinct().join(counts, "project", "left").fillna(0, ["code", "docs", "other"])
    total, code, docs = F.col("code") + F.col("docs") + F.col("other"), F.col("code"), F.col("docs")
    marked = F.col("first").isNotNull()
    verdict = (
        F.when(total == 0, "empty").when((code == 0) & (docs > 0), "docs").when((docs == 0) & (code > 0), "coding")
        .when(marked & (code > 0) & (docs / total <= 0.4), "coding").when(code > 0, "mixed").otherwise("docs")
    )
    subtype: Column = F.lit("unknown")
    for k, v in MARKERS.items():
        subtype = F.when(F.col("first.marker") == k, v).otherwise(subtype)
    advice = F.lit(None).cast("string")
    for k, v in ADVICE.items():
        advice = F.when(F.col("verdict") == k, "; ".join(v)).otherwise(advice)
    ratio = F.when(total == 0, F.lit(0.0)).otherwise(rounded(docs / total * 100) / 100)
    out = every.select("project", verdict.alias("verdict"), subtype.alias("subtype"), "code", "docs", "other", ratio.alias("docs_ratio"))
    return out.withColumn("advice", advice)

"""Which files of a repository a scan reads: supported names, ignored folders, markers, fragments, one file per real path.

Listing reads names and sizes only; contents are read by the readers of what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names a scan reads, folders it doesn't, folders of fragments, and its caps.
SUFFIXES = ("py", "ipynb", "tf", "yaml", "yml")
MCP_NAMES = (".mcp.json", "mcp.json", "mcp_config.json", "claude_desktop_config.json")
IGNORED = (".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__")
FRAGMENTS = ("snippets", "snippets_py", "code_snippets")
MAX_CANDIDATES, MAX_ENTRIES = 10_000, 100_000


def listed(spark: SparkSession, root: str, most: int = MAX_ENTRIES) -> DataFrame:
    """(path, relative, length) of every file below `root`, those whose names start with a dot too; symbolic links aren't followed.

    The listing is the driver's, as Spark's own leaves such names out; more than `most` entries are an error, so it is bounded.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    start, rows, entries, todo = len(fs.makeQualified(top).toString().rstrip("/")) + 1, [], 0, [top]
    while todo:
        for status in fs.listStatus(todo.pop()):
            entries += 1
            if entries > most:
                raise ValueError(f"more than {most} files and folders below {root}")
            path = status.getPath()
            local = path.toUri().getScheme() == "file"
            if status.isSymlink() or (local and jvm.java.nio.file.Files.isSymbolicLink(jvm.java.io.File(path.toUri().getPath()).toPath())):
                continue
            if status.isDirectory():
                todo.append(path)
            else:
                rows.append((path.toString(), path.toString()[start:], status.getLen()))
    return spark.createDataFrame(sorted(rows), "path string, relative string, length long")


def candidates(files: DataFrame, marker: str = ".scan-ignore", most: int = MAX_CANDIDATES) -> DataFrame:
    """Of `files` (path, relative, ..., real_path optional) those a scan reads; more than `most` are an error.

    A marker file leaves out its folder and all below it, but not the root's; files of one real path count once.
    """
    parts = F.split("relative", "/")
    name = F.element_at(parts, -1)
    supported = F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SUFFIXES) & name.contains(".") | name.isin(*MCP_NAMES, "pyproject.toml", ".env") | name.startswith(".env.")
    rows = files.withColumns({"_name": name, "_folders": F.slice(parts, 1, F.size(parts) - 1)})
    marked = rows.filter((F.col("_name") == marker) & (F.size("_folders") > 0)).select(F.array_join("_folders", "/").alias("folder")).distinct()
    rows = rows.filter(supported & ~F.arrays_overlap("_folders", F.array(*[F.lit(x) for x in IGNORED])))
    above = F.transform(F.sequence(F.lit(1), F.size("_folders")), lambda n: F.array_join(F.slice("_folders", 1, n), "/"))
    inside = rows.filter(F.size("_folders") > 0).select("path", F.explode(above).alias("folder")).join(marked, "folder").select("path").distinct()
    rows = rows.join(inside, "path", "left_anti").drop("_name", "_folders")
    rows = rows.dropDuplicates(["real_path"]) if "real_path" in rows.columns else rows
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files to scan")
    return rows


def skipped(files: DataFrame) -> DataFrame:
    """(path, kind) of templates and fragments among `files` (path, relative, text): notes that leave a scan complete."""
    templated = F.col("text").rlike(r"\{\{|\{%") & F.lower("relative").rlike(r"\.(py|ya?ml|tf)$")
    fragment = F.arrays_overlap(F.split(F.lower("relative"), "/"), F.array(*[F.lit(x) for x in FRAGMENTS]))
    kind = F.when(fragment, "source_fragment").when(templated, "templated_source")
    return files.select("path", kind.alias("kind")).filter("kind is not null")

"""Source trees: ignore rules, languages, hashes, the scan itself."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that are never source code.
EXCLUDED_DIRS = """
.git .hg .svn
venv .venv env .env site-packages __pycache__ .tox .mypy_cache .pytest_cache .ruff_cache .hypothesis
dist build .next .nuxt target obj bin/Debug bin/Release Pods DerivedData .expo
node_modules .npm .yarn .pnpm-store .gradle .m2
.sextant
conda-meta include go jre fonts ssl man share var sbin libexec pkgconfig cmake girepository-1.0 gdalplugins gdk-pixbuf-2.0 dbus-1.0
gnome-settings-daemon-3.0 bfd-plugins x86_64-conda-linux-gnu x86_64-conda_cos6-linux-gnu
vendor third_party third-party extern external generated pb protobuf
duckdb_build
""".split()
# Languages by file suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
}
#: Languages whose symbols can be read beyond those.
MORE_LANGUAGES = {".swift": "swift", ".lua": "lua", ".sh": "bash", ".bash": "bash", ".r": "r", ".md": "markdown", ".rmd": "rmd", ".qmd": "qmd"}
IGNORE_FILES = (".sextantignore", ".claudeignore", ".gitignore")


def parse_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: no blank lines, no comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


_GLOB = re.compile(r"\*\*|\*|\?|\[[^\]]+\]|.", re.S)


def glob_regex(glob: str, run: str, one: str) -> str:
    """A glob as a regex; ``run`` is what a star may cover, ``one`` what a question mark may."""
    special = {"**": ".*", "*": run, "?": one}

    def part(t: str) -> str:
        if t in special:
            return special[t]
        return "[^" + t[2:] if t.startswith("[!") else t if len(t) > 1 else re.escape(t)

    return "".join(map(part, _GLOB.findall(glob)))


def pattern_regex(pattern: str) -> tuple[str, bool]:
    """(regex over a whole relative path, negated) of an ignore pattern.

    With ``**`` any path around may match; with a slash the pattern is anchored at the root and covers what lies below; otherwise it matches any component or
    the whole path.
    """
    negated, p = pattern.startswith("!"), pattern.lstrip("!").rstrip("/")
    within = ("[^/]*", "[^/]")
    if "**" in p:
        return rf"(?:.*/)?{glob_regex(p, *within)}(?:/.*)?", negated
    if "/" in p:
        p = p.lstrip("/")
        return rf"{glob_regex(p, '.*', '.')}|{re.escape(p)}/.*", negated
    return rf"{glob_regex(p, '.*', '.')}|(?:.*/)?{glob_regex(p, *within)}(?:/.*)?", negated


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether a relative path is ignored: the first pattern that matches decides, a negated one against."""
    path = path.replace("\\", "/")
    for p in patterns:
        r, negated = pattern_regex(p)
        if re.fullmatch(r, path, re.S):
            return not negated
    return False


def ignored_column(path: Column, patterns: list[str]) -> Column:
    """``ignored`` as an expression: the first match decides."""
    out = F.lit(False)
    for p in reversed(patterns):
        r, negated = pattern_regex(p)
        out = F.when(path.rlike(f"(?s)^(?:{r})$"), F.lit(not negated)).otherwise(out)
    return out


def in_excluded_dir(path: Column, names: list[str] | None = None) -> Column:
    """Whether any component of a relative path is an excluded directory's name."""
    names = EXCLUDED_DIRS if names is None else names
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def language_column(path: Column, more: bool = True) -> Column:
    """The language of a path by its suffix, in any letter case; null if unknown."""
    pairs = LANGUAGES | (MORE_LANGUAGES if more else {})
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(m, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def content_hash(content: Column) -> Column:
    """A hash of a file's bytes; only equality matters."""
    return F.sha2(content, 256)


def walk(root: str, languages: dict[str, str] | None = None) -> Iterator[tuple[str, str]]:
    """(relative path, language) of the source files below a root, in order. Links are followed, each directory once; excluded and ignored ones are not entered."""
    languages = LANGUAGES | MORE_LANGUAGES if languages is None else languages
    read = lambda p: parse_patterns(open(p, errors="replace").read()) if os.path.isfile(p) else []  # noqa: E731, SIM115
    top = [x for f in IGNORE_FILES for x in read(os.path.join(root, f))]
    seen: set[tuple[int, int]] = set()

    def rec(rel: str, local: list[tuple[str, list[str]]]) -> Iterator[tuple[str, str]]:
        here = os.path.join(root, rel) if rel else root
        try:
            st = os.stat(here)
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return
        if (st.st_dev, st.st_ino) in seen:
            return
        seen.add((st.st_dev, st.st_ino))
        if rel:
            local = [*local, (rel, read(os.path.join(here, ".gitignore")))]
        for e in entries:
            r = f"{rel}/{e.name}" if rel else e.name
            if ignored(r, top) or any(ignored(r[len(d) + 1 :], p) for d, p in local if p):
                continue
            if e.is_dir():
                if e.name not in EXCLUDED_DIRS:
                    yield from rec(r, local)
            elif (lang := languages.get(os.path.splitext(e.name)[1].lower())) and e.is_file():
                yield r, lang

    yield from sorted(rec("", []))


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(root)``: file_path, lang, content, content_hash. Listing is done on the driver, reading in ``partitions`` parts."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_path string, lang string, content string, content_hash string"

    def reader(self, schema) -> "TreeReader":
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.parts = int(options.get("partitions", 8))

    def partitions(self):
        files = list(walk(self.root))
        n = max(1, min(self.parts, len(files)))
        return [InputPartition(files[i::n]) for i in range(n)]

    def read(self, partition):
        for rel, lang in partition.value:
            try:
                with open(os.path.join(self.root, rel), "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield rel, lang, data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest()


def read_tree(spark: SparkSession, root: str, partitions: int = 8) -> DataFrame:
    """The source files below a local root."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("partitions", partitions).load(root)


def read_stored_tree(spark: SparkSession, url: str, patterns: list[str] | None = None) -> DataFrame:
    """The source files below a folder on shared storage, listed and read by Spark: file_path, lang, content, content_hash. Empty files have nothing to read and are left out."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(url)
    base = url.rstrip("/").split("://")[-1].split(":")[-1]
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), f"^.*?{re.escape(base)}/", "")
    d = b.withColumn("file_path", rel).withColumn("lang", language_column(F.col("file_path"))).where(F.col("lang").isNotNull() & ~in_excluded_dir(F.col("file_path")) & ~ignored_column(F.col("file_path"), patterns or []))
    return d.select("file_path", "lang", F.decode("content", "UTF-8").alias("content"), content_hash(F.col("content")).alias("content_hash"))


def source_slice(content: Column, start: Column, end: Column, default_lines: int = 60) -> Column:
    """Lines start to end of a text, or ``default_lines`` from start where end is null."""
    lines = F.split(content, "\n")
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    n = F.when(end.isNull(), F.lit(default_lines)).otherwise(F.greatest(end - first + 1, F.lit(0)))
    return F.array_join(F.slice(lines, first, n), "\n")

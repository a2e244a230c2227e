"""Commits of a local repository as a data source."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

MARK = "\x01"


def parse_log(text: str):
    """(commit, file_path, author, seconds) of ``git log --format=%x01%H%x02%an%x02%at --name-only``."""
    for block in text.split(MARK)[1:]:
        head, _, files = block.partition("\n")
        commit, author, at = head.split("\x02")
        for f in files.splitlines():
            if f.strip():
                yield commit, f.strip(), author, int(at)


class GitSource(DataSource):
    """``spark.read.format("git_log").load(root)``: commit, file_path, author, seconds; no merge commits. A folder without a repository has no rows."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "commit string, file_path string, author string, seconds long"

    def reader(self, schema) -> "GitReader":
        return GitReader(self.options.get("path"))


class GitReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def read(self, partition):
        r = subprocess.run(["git", "-c", "core.quotepath=off", "-C", self.root, "log", "--no-merges", "--format=%x01%H%x02%an%x02%at", "--name-only"], capture_output=True, text=True, errors="replace")
        if r.returncode == 0:
            yield from parse_log(r.stdout)


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """commit, file_path, author, ts."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git_log").load(root).selectExpr("commit", "file_path", "author", "timestamp_seconds(seconds) AS ts")

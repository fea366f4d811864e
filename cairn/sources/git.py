"""Diffs of a git work tree."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

HUNKS = "path string, status string, old_start bigint, old_lines bigint, new_start bigint, new_lines bigint"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, str, int, int, int, int]]:
    """Hunks of unified diff text, with their file and its status."""
    rows, path, status = [], "", "Modified"
    for line in text.splitlines():
        if line.startswith("diff --git "):
            path, status = line.rpartition(" b/")[2], "Modified"
        elif line.startswith("new file"):
            status = "Added"
        elif line.startswith("deleted file"):
            status = "Deleted"
        elif line.startswith("rename to "):
            path, status = line[10:], "Renamed"
        elif m := _HUNK.match(line):
            rows.append((path, status, int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)))
    return rows


def git_diff(spark: SparkSession, repository: str, start: str = "HEAD", end: str | None = None) -> DataFrame:
    """Hunks, with three lines of context, from a revision to another, or to the work tree and index."""
    for rev in (start, *([end] if end else [])):
        subprocess.run(["git", "-C", repository, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{rev}^{{tree}}"], check=True, capture_output=True)
    text = subprocess.run(["git", "-C", repository, "diff", "-U3", "--no-color", "--no-ext-diff", start, *([end] if end else []), "--"], check=True, capture_output=True, text=True).stdout
    return spark.createDataFrame(parse_diff(text), HUNKS)

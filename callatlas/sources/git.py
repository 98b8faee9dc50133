"""Commits, changed files, blame and head of a repository, read with the git program on the driver."""

from __future__ import annotations

import datetime
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def _time(seconds: str) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(int(seconds), datetime.timezone.utc)


def commits(spark: SparkSession, root: str, since: str | None = None, suffix: str = ".cs") -> DataFrame:
    """file_path (absolute), ts and author: a row for each file with the suffix that a commit changed."""
    out = _git(root, "log", "--name-only", "--format=%x01%ct%x02%an", *([f"--since={since}"] if since else []))
    top = Path(_git(root, "rev-parse", "--show-toplevel").strip())
    rows = []
    for part in out.split("\x01")[1:]:
        head, *names = part.strip().split("\n")
        at, author = head.split("\x02")
        rows += [(str(top / n), _time(at), author) for n in names if n.endswith(suffix)]
    return spark.createDataFrame(rows, "file_path string, ts timestamp, author string")


def changed_files(spark: SparkSession, root: str, old: str = "HEAD~1", new: str = "HEAD", suffix: str = ".cs") -> DataFrame:
    """path (absolute) of the files with the suffix that differ between two revisions."""
    top = Path(_git(root, "rev-parse", "--show-toplevel").strip())
    names = _git(root, "diff", "--name-only", old, new).split("\n")
    return spark.createDataFrame([(str(top / n),) for n in names if n.endswith(suffix)], "path string")


def blame(spark: SparkSession, path: str, line: int) -> DataFrame:
    """file_path, line, author and ts of the last change of one line; no row if git doesn't know it."""
    try:
        out = _git(str(Path(path).parent), "blame", "-L", f"{line},+1", "--porcelain", path)
    except RuntimeError:
        out = ""
    found = dict(x.split(" ", 1) for x in out.split("\n") if x.startswith(("author ", "author-time ")))
    rows = [(path, line, found["author"], _time(found["author-time"]))] if len(found) == 2 else []
    return spark.createDataFrame(rows, "file_path string, line int, author string, ts timestamp")


def head(root: str) -> str | None:
    """The current commit, if there is one."""
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except RuntimeError:
        return None

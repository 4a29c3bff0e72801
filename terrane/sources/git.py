"""Files' history and differences from git, read on the driver: as many rows as there are files."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.versions import pr_number
from terrane.operators.diff import full_diff

_MARK = "\x1e"


def _git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout


def provenance(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(filename, commit, author, date, message, pr) of each .sql file's last commit; nulls for files without one."""
    paths = sorted(Path(folder).rglob("*.sql") if recursive else Path(folder).glob("*.sql"))
    rows = []
    for p in paths:
        said = _git(folder, "log", "-1", f"--format=%H{_MARK}%an{_MARK}%aI{_MARK}%B", "--", str(p.resolve()))
        commit, author, date, message = said.rstrip("\n").split(_MARK) if said else (None,) * 4
        rows.append((str(p.relative_to(folder)), commit, author, date, message))
    df = spark.createDataFrame(rows, "filename string, commit string, author string, date string, message string")
    return df.withColumn("pr", pr_number(F.col("message")))


def changed_files(spark: SparkSession, folder: str, ref: str = "HEAD", staged: bool = False) -> DataFrame:
    """(filename) of .sql files that differ from `ref`, or that are staged."""
    args = ["diff", "--name-only", "--relative", *(["--cached"] if staged else [ref])]
    names = [(x,) for x in _git(folder, *args).splitlines() if x.endswith(".sql")]
    return spark.createDataFrame(names, "filename string")


def verify(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Files whose record and history differ: missing_in_current, commit_changed or new_file."""
    d = full_diff(recorded, current, ["filename"], ["commit"]).where("change <> 'same'")
    names = {"removed": "missing_in_current", "modified": "commit_changed", "added": "new_file"}
    status = F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("change"))
    return d.select("filename", status.alias("status"))

"""Watching a folder of migrations, and folding what arrives into the state."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.operators import changefeed


class Shrunk(RuntimeError):
    """A rebuild has much fewer objects than the one before."""


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts of events of a key with at most `gap` between two: (key, first_ts, last_ts, events). Works on streams with a watermark."""
    by = events.groupBy(key, F.session_window(ts, gap))
    return by.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events")).select(key, "first_ts", "last_ts", "events")


def shrink_checked(counts: DataFrame, order: str, n: str, least: float = 0.8) -> DataFrame:
    """Each count with the one before and whether it falls below `least` of that. One row per build: few rows."""
    before = F.lag(n).over(W.orderBy(order))
    blocked = F.coalesce((F.col("before") > 0) & (F.col(n) < least * F.col("before")), F.lit(False))
    return counts.withColumn("before", before).withColumn("blocked", blocked)


def check_shrink(old: int, new: int, least: float = 0.8, force: bool = False) -> None:
    if old > 0 and new < least * old and not force:
        raise Shrunk(f"{new} objects after {old}")


class Busy(RuntimeError):
    """Another process builds already."""


class BuildLock:
    """One build at a time of those that share a file: `with BuildLock(path):`. A file left by a process that is gone is taken over."""

    def __init__(self, path: str):
        self.path = Path(path)

    def __enter__(self) -> BuildLock:
        try:
            handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            held = self.path.read_text().strip()
            if held.isdigit() and not os.path.exists(f"/proc/{held}"):
                self.path.unlink(missing_ok=True)
                return self.__enter__()
            raise Busy(f"process {held or 'unknown'} builds already") from None
        with os.fdopen(handle, "w") as f:
            f.write(str(os.getpid()))
        return self

    def __exit__(self, *_) -> None:
        self.path.unlink(missing_ok=True)


def watch_schema(spark: SparkSession, folder: str, react: Callable, checkpoint: str, lock: str, every: str | None = None, force: bool = False):
    """Call `react(schema)` with the schema of the whole folder whenever .sql files came to it, one build at a time.

    What comes within one trigger (`every`, such as "2 seconds") is one burst and one rebuild. A schema that has lost
    more than a fifth of its tables since the last rebuild raises Shrunk unless `force` is given.
    """
    from terrane.engine import Schema

    last = {"tables": 0}

    def rebuild(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        with BuildLock(lock):
            schema = Schema.read(spark, folder)
            n = schema.tables.count()
            check_shrink(last["tables"], n, force=force)
            last["tables"] = n
            react(schema)

    return watch_files(spark, folder, rebuild, checkpoint, every)


def watch_files(spark: SparkSession, folder: str, react: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Call `react(rows, batch)` with (filename, sql) of the .sql files that come to `folder`; without `every`, for what is there now."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("sql"))
    out = rows.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if every is None else out.trigger(processingTime=every).start()


def fold_changes(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of operations to the data and delete files at `path`; `changefeed.read_state` reads the state at any time.

    A batch that is run again after a failure appends the same rows under the same sequence numbers, which
    the reader counts once. Nothing is kept in the stream's state.
    """

    def append(batch: DataFrame, _: int) -> None:
        changefeed.append_changes(batch, path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

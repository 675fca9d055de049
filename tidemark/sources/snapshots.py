"""Daily state with commits that are one at a time and in order, and logs by date that forget old days."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


class AlreadyProcessed(ValueError):
    pass


class _Files:
    """Hadoop's file system of a path: whatever Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"can't rename {old}")


COMMITS = "_commits"


def last_commit(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """(number, date, folder) of the newest commit: its name holds all of it."""
    found = [n.split("~") for n in _Files(spark, path).names(COMMITS) if not n.startswith(".") and n.count("~") == 2]
    return max(((int(n), d, f) for n, d, f in found), default=None)


def write_snapshot(snapshot: DataFrame, path: str, asof: str, force: bool = False) -> None:
    """Writes the state after a date as a partition as_of; refuses a date that isn't after the last one, unless forced.

    The rows go to a folder that readers skip.  Then a writer takes the next number by creating its
    file, which only one can; of two that saw the same last commit the other is refused.  The
    commit, a file whose name has number, date and folder, follows at once, and the folder gets its
    name, as_of=date.  A writer that fails before the commit leaves the state as it was, and its number
    unused; one that fails after it leaves the last step to the next writer.
    """
    spark = snapshot.sparkSession
    files = _Files(spark, path)
    before = last_commit(spark, path)
    if before:
        _settle(files, before[1], before[2])
        if not force and asof <= before[1]:
            raise AlreadyProcessed(f"{asof} is not after {before[1]}")
    folder = f"_rows-{uuid.uuid4().hex}"
    snapshot.write.parquet(f"{path}/{folder}")
    number = 1 + max((int(n.lstrip(".").split("~")[0]) for n in files.names(COMMITS) if n.lstrip(".").split("~")[0].isdigit()), default=-1)
    last = max(asof, before[1]) if before else asof
    files.fs.mkdirs(files.path(COMMITS))
    if not files.fs.createNewFile(files.path(f"{COMMITS}/.{number}")):
        files.remove(folder)
        raise AlreadyProcessed(f"another writer has commit {number}")
    files.fs.create(files.path(f"{COMMITS}/{number}~{last}~{folder}={asof}")).close()
    _settle(files, last, f"{folder}={asof}")


def _settle(files: _Files, last: str, commit: str) -> None:
    folder, asof = commit.split("=")
    if files.exists(folder):
        files.remove(f"as_of={asof}")
        files.rename(folder, f"as_of={asof}")


def purge_log(spark: SparkSession, path: str, before: str, time: str = "scanned_at", day: str = "scan_date") -> DataFrame:
    """(kept, purged) rows of a log by date, after those from before a time are gone: whole dates as folders, that of the time by a rewrite.

    Dates are a row each and few enough for the driver.
    """
    log, cutoff = spark.read.parquet(path), F.lit(before).cast("timestamp")
    counts = written(log.agg(F.count_if(F.col(time) >= cutoff).alias("kept"), F.count_if(F.col(time) < cutoff).alias("purged")), "purged")
    edge = F.lit(before[:10]).cast("date")
    rest = written(log.filter((F.col(day) == edge) & (F.col(time) >= cutoff)), "purge-kept")
    old = [r[0] for r in log.filter(F.col(day) <= edge).select(F.col(day).cast("string")).distinct().collect()]
    files = _Files(spark, path)
    for d in old:
        files.remove(f"{day}={d}")
    rest.write.mode("append").partitionBy(day).parquet(path)
    return counts

"""A store of candles: Parquet by month and bucket of symbols, in order of symbol and date within a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

SCHEMA = "symbol_id bigint, d date, bar int, open double, high double, low double, close double, volume bigint"
KEY = ("symbol_id", "d")
PARTS = "month int, bucket int"
#: Rows that a task of a write is dealt, about.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class CandleStore:
    """Candles at a path; a row for each symbol and date.

    buckets should grow with the symbols, so that a month of a bucket is a file of a fair size.  What
    is written goes to the partitions that it touches alone: their rows are merged, and they are
    replaced together when the job commits.  A lost executor repeats its tasks; a job that fails
    before it commits leaves the store as it was.  Two writers at once aren't provided for.
    """

    path: str
    buckets: int = 16
    schema: str = SCHEMA

    def _parts(self) -> tuple[Column, Column]:
        return (F.year("d") * 100 + F.month("d")).alias("month"), self._bucket(F.col("symbol_id")).alias("bucket")

    def _bucket(self, symbol: Column) -> Column:
        return F.pmod(F.xxhash64(symbol.cast("long")), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, {PARTS}").parquet(self.path)

    def range(self, spark: SparkSession, symbol: int | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
        """Candles of a symbol, all if none is given, from since to until, both within, by date.

        The scan opens the months and the bucket that can hold them alone, and there skips row
        groups by symbol and date.
        """
        rows = self.read(spark)
        if symbol is not None:
            bucket = spark.range(1).select(self._bucket(F.lit(symbol))).collect()[0][0]  # a literal, so that it prunes
            rows = rows.filter((F.col("bucket") == bucket) & (F.col("symbol_id") == symbol))
        for day, later in ((since, True), (until, False)):
            if day is not None:
                month, date = int(day[:4]) * 100 + int(day[5:7]), F.lit(day).cast("date")
                rows = rows.filter((F.col("month") >= month) & (F.col("d") >= date) if later else (F.col("month") <= month) & (F.col("d") <= date))
        rows = rows.drop("month", "bucket").orderBy(*(("d",) if symbol is not None else KEY))
        return rows if limit is None else rows.limit(limit)

    def create(self, rows: DataFrame) -> None:
        """The store of rows, whose keys are unique, in place of what is there."""
        self._write(written(rows.select(*self._columns(), *self._parts()), "store-rows"), "static")

    def upsert(self, rows: DataFrame) -> None:
        """rows come in; where the store has their symbol and date they take that row's place."""
        self._merge(rows, new_wins=True)

    def insert_ignore(self, rows: DataFrame) -> None:
        """The rows whose symbol and date the store hasn't got come in."""
        self._merge(rows, new_wins=False)

    def purge(self, spark: SparkSession, before: str) -> None:
        """Candles of dates before that day go: whole months as folders, the month of the day by a rewrite."""
        month = int(before[:4]) * 100 + int(before[5:7])
        rows = self.read(spark).filter(F.col("month") == month)
        kept = written(rows.filter(F.col("d") >= F.lit(before).cast("date")), "store-kept")
        emptied = [r["month"] for r in self.read(spark).filter(F.col("month") <= month).select("month").distinct().collect()]  # months, a few hundred at most
        files = _file_system(spark, self.path)
        for m in emptied:
            files.delete(_path(spark, f"{self.path}/month={m}"), True)
        self._write(kept, "dynamic")

    def _columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _merge(self, rows: DataFrame, new_wins: bool) -> None:
        spark = rows.sparkSession
        new = written(rows.select(*self._columns(), *self._parts()).dropDuplicates(list(KEY)), "store-new")
        touched = F.broadcast(new.select("month", "bucket").distinct())  # months times buckets at most
        parts = _tasks(self.read(spark), new)
        old = self.read(spark).join(touched, ["month", "bucket"], "left_semi")
        first, second = (new, old) if new_wins else (old, new)
        first, second = first.repartition(parts, *KEY), second.repartition(parts, *KEY)
        merged = first.unionByName(second.join(first.select(*KEY), list(KEY), "left_anti"))
        self._write(written(merged, "store-merged"), "dynamic")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """rows come from a table, so that they are cheap to count."""
        ordered = rows.repartition(_tasks(rows), "month", "bucket").sortWithinPartitions("month", "bucket", *KEY)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month", "bucket").parquet(self.path)


def _tasks(*tables: DataFrame) -> int:
    """Shuffle partitions for the rows of tables: as they grow, so do the partitions in number, not in size."""
    rows = sum(t.count() for t in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

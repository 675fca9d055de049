"""Work on the rows of a symbol at a time, many symbols to a group: a group costs more than a symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols are dealt into so many groups for each shuffle partition.
GROUPS = 4


def dealt(rows: DataFrame) -> DataFrame:
    """rows with _group, the group that their symbol is dealt to; as the shuffle partitions grow, so do the groups."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * GROUPS
    return rows.withColumn("_group", F.pmod(F.xxhash64(F.col("symbol_id").cast("long")), F.lit(count)))


def by_symbol(rows: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each symbol, by bar if they have one."""
    keys = ["symbol_id"] + ["bar"] * ("bar" in rows.column_names)
    rows = rows.sort_by([(k, "ascending") for k in keys]).combine_chunks()
    symbol = rows.column("symbol_id").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(symbol) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(symbol)]):
        yield symbol[a].item(), rows.slice(a, b - a)


def per_symbol(rows: DataFrame, function: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """function of the rows of each symbol, by bar; one shuffle."""

    def run(group: pa.Table) -> pa.Table:
        return pa.concat_tables([function(part) for _, part in by_symbol(group.drop_columns("_group"))])

    return dealt(rows).groupBy("_group").applyInArrow(run, schema)


def per_group_of_both(left: DataFrame, right: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """function of left's rows of a group of symbols and right's, in no order; one shuffle of both."""
    # aliases keep right's columns apart from left's: where both come from one table, those of one name would be taken for left's and pruned
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return dealt(left).groupBy("_group").cogroup(dealt(right).groupBy("_group")).applyInArrow(lambda some, others: function(some.drop_columns("_group"), others.drop_columns("_group")), schema)


def per_symbol_of_both(left: DataFrame, right: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """function of the rows of each symbol that left has, and of right's of the symbol; one shuffle of both."""

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        of = dict(by_symbol(others))
        return pa.concat_tables([function(part, of.get(symbol, others.slice(0, 0))) for symbol, part in by_symbol(some)] or [function(some, others.slice(0, 0))])

    return per_group_of_both(left, right, run, schema)

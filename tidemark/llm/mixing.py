"""Mixing sources to target weights.

Sizes are summed per source, targets give each source a repetition rate, and every document is
taken floor(rate) times plus once more if its hash falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hash_share, word_count, written

#: Weights of the sources in code-point order, null last, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: Tasks that the rows of one source are dealt to where sources are too many to broadcast.
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Targets are min(cap * source_size, level * weight) with the one level at which they sum to
    total_share of all sizes: what resharing the excess over the caps by weight, until none is
    above, ends in.  Sources reach their cap in order of cap / weight, so the level follows from
    running sums.  If all sources are at the cap, so are their targets.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(cap)).withColumn("cap_per_weight", F.col("top") / F.col("weight"))
    full = F.coalesce(F.sum("top").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(total_share) * F.sum("source_size").over(everything) - full) / open_weight
    levels = ranked.withColumn("level", level)
    # the first source, by cap, that its level doesn't fill has the level of all that follow; theirs are lower
    open_level = F.max(F.when(F.col("level") < F.col("cap_per_weight"), F.col("level"))).over(everything)
    return levels.withColumn("open_level", open_level).select("source", "source_size", F.least(F.col("top"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("top"))).alias("target"))


def with_sources(rows: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    """rows with the columns of targets for their source, null too, in place of source_col; of columns named alike, only targets has any.

    Beyond BROADCAST_ROWS sources both sides are shuffled, with each source dealt to SALTS tasks.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("-"))
    own = [F.col(c) for c in rows.columns if c != source_col]
    keyed = rows.select(*own, key.alias("_mix_key"))
    known = targets.withColumn("_mix_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))).drop("source")
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(known), "_mix_key", "left").drop("_mix_key")
    salted = keyed.withColumn("_mix_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    spread = known.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["_mix_key", "_mix_salt"], "left").drop("_mix_key", "_mix_salt")


def copies_of(doc_id: Column, source_size: Column, target: Column, seed: str) -> Column:
    """floor(rate), and one more if the hash of the id falls below the fraction of the rate."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return F.floor(rate) + (hash_share(doc_id, seed) < rate - F.floor(rate)).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, cap: float = 2.0, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), one row for each row of docs.

    Null and empty texts have size 0 and take nothing; the null source is a source; a source of
    size 0 has target 0 and no copies; rows that repeat a doc_id get the same number of copies;
    columns beside the three are left out; an empty table gives no rows.  Sums per source combine
    before the shuffle, so a hot source costs one row per task; documents never move for them.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, cap), "targets")
    joined = with_sources(rows.withColumnRenamed("source", "_mix_source"), targets, "_mix_source")
    return joined.select("doc_id", "size", "source_size", "target", copies_of(F.col("doc_id"), F.col("source_size"), F.col("target"), seed).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, cap: float = 2.0, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Rows that repeat a doc_id are mixed alike; the edge cases are those of mix_plan.
    """
    rows = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, cap), "targets")
    plain = targets.select("source", F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"))
    joined = with_sources(docs.withColumn("_mix_source", F.col(source_col)), plain, "_mix_source")
    copies = copies_of(F.col(id_col), F.col("_mix_size"), F.col("_mix_target"), seed)
    wanted = joined.withColumn("_mix_copies", F.when(word_count(F.col(text_col)) > 0, copies).otherwise(F.lit(0)).cast("int")).filter("_mix_copies > 0")
    return wanted.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


#: DuckDB SQL for the op10 query.
SQL = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w from s),
r as (select *, 2.0::double * source_size top, 2.0::double * source_size / w per from w),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(top) over (order by per, source nulls last rows between unbounded preceding and 1 preceding), 0))
             / (sum(w) over () - coalesce(sum(w) over (order by per, source nulls last rows between unbounded preceding and 1 preceding), 0)) lev from r),
t as (select source, source_size, least(top, coalesce((select max(lev) from l where lev < per) * w, top)) target from l),
c as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end rate,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double u
      from d join t on d.source is not distinct from t.source),
k as (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::bigint copies from c)
select doc_id, size, source_size, target::double target, copies, size * copies taken from k
"""

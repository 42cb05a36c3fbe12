"""Statistics over whole tables or groups, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, LongType, StructField, StructType


def with_totals(df: DataFrame, *aggs: Column, by: list[str] | None = None) -> DataFrame:
    """df with aggregates over all rows, or over each group, as columns; the whole-table ones are one row, so their join is a broadcast."""
    if by:
        return df.join(df.groupBy(*by).agg(*aggs), by)
    return df.join(F.broadcast(df.agg(*aggs)))


def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """Scaled to 0..1 over all rows; a constant column is 0."""
    t = with_totals(df, F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return t.withColumn(out, F.coalesce(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def pearson(x: Column, y: Column, least: int = 2, otherwise: Column | None = None) -> Column:
    """Correlation of complete pairs; `otherwise` (0 by default) for fewer than `least` pairs or no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(F.when(F.count(a) >= least, r), F.lit(0.0) if otherwise is None else otherwise)


def running_total(df: DataFrame, order: str, amount: str | Column, out: str, then: list[str] | None = None) -> DataFrame:
    """df with the sum of amount over all rows up to and including each, in the order of a column (and the columns `then`); a null amount adds nothing.

    Rows are dealt to ranges of all these columns, so that copies of one value are split by the others, and sorted there; each range is summed in one pass and written once. The sums of the ranges before are as many as there are partitions.
    """
    from wardlight.plans.session import cut_lineage

    t = df.withColumn("_amount", F.col(amount) if isinstance(amount, str) else amount)
    whole = isinstance(t.schema["_amount"].dataType, IntegralType)
    kind = "long" if whole else "double"
    t = t.withColumn("_amount", F.coalesce(F.col("_amount").cast(kind), F.lit(0).cast(kind)))
    ranged = t.repartitionByRange(order, *(then or [])).sortWithinPartitions(order, *(then or []))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, total = context.partitionId() if context else 0, 0
        for batch in batches:
            upto = total + np.cumsum(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            if len(upto):
                total = upto[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto), pa.array(np.full(len(upto), part, np.int32))], [*batch.schema.names, "_in", "_part"])

    schema = StructType([*t.schema.fields, StructField("_in", LongType() if whole else DoubleType()), StructField("_part", IntegerType())])
    held = cut_lineage(ranged.mapInArrow(summed, schema))
    sums = held.groupBy("_part").agg(F.sum("_amount").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(kind))  # a row a partition
    return held.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part").withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_amount", "_in", "_before")


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from 1, ties at their mean. Values are ranked after counting, so copies of a value cost one row."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    valued = running_total(counts.where(F.col(col).isNotNull()), col, "_n", "_upto")
    nulls = F.broadcast(counts.agg(F.coalesce(F.sum(F.when(F.col(col).isNull(), F.col("_n"))), F.lit(0)).alias("_nulls")))  # nulls come first
    whole = valued.join(nulls).select(F.col(col).alias("_v"), (F.col("_nulls") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    ranked = whole.unionByName(nulls.where("_nulls > 0").select(F.lit(None).cast(df.schema[col].dataType).alias("_v"), ((F.col("_nulls") + 1) / 2).alias(out)))
    return df.join(ranked, df[col].eqNullSafe(ranked["_v"])).drop("_v")


def cumulative_weights(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, cum, total): one row for each value, with the weight up to and including it."""
    w = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(weight).alias("_w"))
    t = with_totals(w, F.sum("_w").alias("total"))
    return running_total(t, value, "_w", "cum").select(value, "cum", "total")


def weighted_median(df: DataFrame, value: str, weight: str, out: str = "weighted_median") -> DataFrame:
    """One row: the smallest value whose cumulative weight reaches half of the total; 0 without weight."""
    c = cumulative_weights(df, value, weight)
    return c.agg(F.coalesce(F.min(F.when((F.col("total") > 0) & (F.col("cum") >= F.col("total") / 2), F.col(value))), F.lit(0.0)).alias(out))


def weighted_quantiles(df: DataFrame, value: str, weight: str, qs: list[float]) -> DataFrame:
    """One row with q<percent> columns: the smallest value whose cumulative weight exceeds the share; q 0 is the smallest value."""
    c = cumulative_weights(df, value, weight)
    name = lambda q: f"q{round(q * 100)}"
    return c.agg(*[
        (F.min(value) if q == 0 else F.coalesce(F.min(F.when(F.col("cum") > F.col("total") * q, F.col(value))), F.max(value))).alias(name(q)) for q in qs
    ])


def threshold_shares(df: DataFrame, value: str, weight: str, limits: list[int]) -> DataFrame:
    """(threshold, share): the percentage of weight at or below each limit, rounded to 6 places."""
    one = df.agg(F.sum(weight).alias("total"), *[F.sum(F.when(F.col(value) <= t, F.col(weight)).otherwise(0)).alias(f"t{t}") for t in limits])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.try_divide(F.col(f"t{t}"), F.col("total")) * 100, 6).alias("share")) for t in limits])
    return one.select(F.inline(rows))


def chunk_quartiles(df: DataFrame, value: str, tie: str, out: str = "quartile") -> DataFrame:
    """Quartiles as four runs of max(1, n // 4) rows in order, what is left over in the fourth; null values out."""
    t = with_totals(df.where(F.col(value).isNotNull()), F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    placed = running_total(t, value, F.lit(1), "_place", [tie])
    return placed.withColumn(out, (F.least(F.lit(3), F.floor((F.col("_place") - 1) / size)) + 1).cast("int")).drop("_n", "_place")


def sorted_pick(df: DataFrame, value: str, index: Column, out: str) -> DataFrame:
    """One row: the value at a place (from 0, given by an expression of n) of the sorted non-null values, found by counts and not by collecting."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    t = running_total(with_totals(counts, F.sum("_c").alias("n")), value, "_c", "_upto")
    return t.agg(F.min(F.when(F.col("_upto") > index, F.col(value))).alias(out))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ascending columns, nulls first; an aggregation with a part on the map side, no sort."""
    return df.groupBy(*key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the last by ascending expressions, nulls first."""
    return df.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")

"""Running sums and numbers in a total order, in levels so that no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Buckets whose totals are summed together; a group of them is a bucket of the next level.
_GROUP = 1 << 24


def with_prefix(df: DataFrame, seq: str, value: Column, name: str, width: int = 100_000, group: int = _GROUP) -> DataFrame:
    """Add `name`: the sum of `value` over all rows up to this one in the order of the integer `seq`.

    Rows are dealt to buckets of `width` consecutive `seq`, buckets to groups of `group`. So a task
    sees `width` rows, `group` bucket totals, or one row for each group there is, however far
    apart the values of `seq` lie. Rows that share a `seq` must not occur; those with none are left out.
    """
    rows = df.where(F.col(seq).isNotNull()).withColumn("_bucket", F.expr(f"`{seq}` div {width}") - (F.col(seq) < 0).cast("long")).withColumn("_value", value)
    inner = Window.partitionBy("_bucket").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_bucket").agg(F.sum("_value").alias("_total")).withColumn("_group", F.floor(F.col("_bucket") / group))
    groups = totals.groupBy("_group").agg(F.sum("_total").alias("_all"))
    groups = groups.select("_group", F.coalesce(F.sum("_all").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).join(groups, "_group")
    base = base.select("_bucket", (F.col("_first") + F.col("_before")).alias("_base"))
    out = rows.withColumn("_sum", F.coalesce(F.sum("_value").over(inner), F.lit(0))).join(base, "_bucket")
    return out.withColumn(name, F.col("_base") + F.col("_sum")).drop("_bucket", "_value", "_sum", "_base")


def with_ids(df: DataFrame, seq: str, after: int | Column, name: str = "id") -> DataFrame:
    """Number the rows after `after`, a number or a scalar subquery, in the order of `seq`."""
    return with_prefix(df, seq, F.lit(1), name).withColumn(name, (F.col(name) + after).cast("long"))

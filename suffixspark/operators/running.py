"""Running totals over a whole table without putting it into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suffixspark.session import cut


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with out = the sum of value over all rows before this one in the given order (which should have no ties).

    Rows go to ranges of the order; each range adds up its own rows, and one row per range carries the sums of the ranges before it.
    The ranges are written to the checkpoint folder first, so that a recomputed task can't deal rows out differently."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per_range = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = per_range.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_range")  # as many rows as partitions
        .withColumn(out, (F.col("_offset") + F.col("_within")).cast("bigint"))
        .drop("_range", "_within", "_offset")
    )

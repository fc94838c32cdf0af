"""As-of joins with period tables: for each row, the value of the last period that starts at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.operators.frames import checkpointed

#: Up to so many periods one key's travel as one sorted array; ranges of time beyond that.
MAX_PERIODS = 1_000


def asof_join(left: DataFrame, periods: DataFrame, ts: str, start: str, value: str, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``left`` with ``value``, null where no period has begun. ``strict``: periods that start before the time only. Of
    periods with one start, the greatest value counts.

    Few periods (configuration) become a sorted array for each key, which is joined once, so the rows of ``left`` are
    neither sorted nor windowed and a hot key is split like any skewed join. Many periods meet the rows in windows over
    ranges of time, and what a range doesn't know it has from the ranges before it."""
    by = by or []
    periods = periods.select(*by, F.col(start).alias("s"), F.col(value).alias("v")).dropna(subset=[*by, "s"])
    if periods.limit(MAX_PERIODS + 1).count() <= MAX_PERIODS:
        packed = periods.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("s", "v"))).alias("_p"))
        met = left.join(F.broadcast(packed), by, "left") if by else left.join(F.broadcast(packed), F.lit(True), "left")
        begun = F.filter("_p", lambda x: (x["s"] < F.col(ts)) if strict else (x["s"] <= F.col(ts)))
        return met.withColumn(value, F.when(F.size(begun) > 0, F.element_at(begun, -1)["v"])).drop("_p")
    return _by_ranges(left, checkpointed(periods), ts, value, by, strict)


def _by_ranges(left: DataFrame, periods: DataFrame, ts: str, value: str, by: list[str], strict: bool) -> DataFrame:
    """Rows and periods are dealt together to as many ranges of time as a shuffle has partitions, which Spark chooses by a
    sample of both, so no range is large however the times lie; rows of one time are dealt by their hash beyond that."""
    rows = left.select(*by, F.struct(*left.columns).alias("row"), F.col(ts).alias("s"), F.lit(None).cast(periods.schema["v"].dataType).alias("v"), F.lit(1).alias("kind"))
    both = rows.unionByName(periods.withColumn("kind", F.lit(2 if strict else 0)), allowMissingColumns=True)
    both = checkpointed(both.repartitionByRange("s", "kind", "v", F.xxhash64("row")).withColumn("r", F.spark_partition_id()))
    # the last value of each range that has any, as one array of at most a row a range for each key
    last = both.where("kind <> 1").groupBy(*by, "r").agg(F.max(F.struct("s", "v")).alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("r", F.col("x.v").alias("v")))).alias("_c"))
    order = Window.partitionBy(*by, "r").orderBy("s", "kind", "v").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("kind") != 1, F.struct("v")), ignorenulls=True).over(order)
    met = both.withColumn("seen", seen).where("kind = 1").select(*by, "row", "r", "seen")
    met = met.join(last, by, "left") if by else met.join(F.broadcast(last), F.lit(True), "left")  # one row
    before = F.filter("_c", lambda x: x["r"] < F.col("r"))
    found = F.when(F.col("seen").isNotNull(), F.col("seen.v")).when(F.size(before) > 0, F.element_at(before, -1)["v"])
    return met.select("row.*", found.alias(value))

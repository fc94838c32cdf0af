"""Participants by interval: scores and earnings in long form (id, start_ms, end_ms, score, earned)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.weeks import WEEK, week_start
from meritgraph.operators.intervals import bonuses


def view(scores: DataFrame, receipts: DataFrame, weeks: DataFrame) -> DataFrame:
    """From (id, ts_ms, score) and (id, ts_ms, amount): times before the first interval count to it, those after the
    last to none; receipts lie in the interval that holds them."""
    ends = weeks.agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    s = scores.join(F.broadcast(ends), F.lit(True)).where("ts_ms < b").select("id", F.greatest(week_start(F.col("ts_ms")), F.col("a")).alias("start_ms"), "score", F.lit(0).cast("decimal(38,0)").alias("earned"))
    r = receipts.join(F.broadcast(ends), F.lit(True)).where("ts_ms >= a AND ts_ms < b").select("id", week_start(F.col("ts_ms")).alias("start_ms"), F.lit(0.0).alias("score"), F.col("amount").cast("decimal(38,0)").alias("earned"))
    both = s.unionByName(r).groupBy("id", "start_ms").agg(F.sum("score").alias("score"), F.sum("earned").cast("decimal(38,0)").alias("earned"))
    return both.select("id", "start_ms", (F.col("start_ms") + WEEK).alias("end_ms"), "score", "earned")


def merged(views: list[DataFrame]) -> DataFrame:
    united = reduce(DataFrame.unionByName, views)
    return united.groupBy("id", "start_ms", "end_ms").agg(F.sum("score").alias("score"), F.sum("earned").cast("decimal(38,0)").alias("earned"))


def scope(v: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Intervals that lie wholly within a time span."""
    return v.where((F.col("start_ms") >= from_ms) & (F.col("end_ms") <= to_ms))


def totals(v: DataFrame) -> DataFrame:
    return v.groupBy("id").agg(F.sum("score").alias("score"), F.sum("earned").cast("decimal(38,0)").alias("earned"))


def top(v: DataFrame, n: int = 20) -> DataFrame:
    """The participants with the highest scores, with their share of all scores in percent."""
    own = totals(v)
    whole = own.agg(F.sum("score").alias("whole"))
    first = own.orderBy(F.desc("score"), "id").limit(n)
    return first.join(F.broadcast(whole), F.lit(True)).select("id", "score", (100 * F.col("score") / F.col("whole")).alias("percent"))


def page(rows: DataFrame, order: list, index: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(index * size).limit(size)


def ordered_letters(column: str, letters: str):
    """Rows whose text has the letters in this order, any case."""
    pattern = ".*".join(f"\\Q{c}\\E" for c in letters)
    return F.col(column).rlike(f"(?i){pattern}")


def interval_totals(v: DataFrame) -> DataFrame:
    """(start_ms, end_ms, score, earned) over all participants."""
    return v.groupBy("start_ms", "end_ms").agg(F.sum("score").alias("score"), F.sum("earned").cast("decimal(38,0)").alias("earned"))


def with_dependencies(v: DataFrame, policies: DataFrame) -> DataFrame:
    """``v`` with each dependency's bonus added to its own scores: a share, by period, of each interval's scores in all.
    policies (recipient, period_ms, share)."""
    mint = interval_totals(v).select("start_ms", F.col("score").alias("mint"))
    extra = bonuses(mint, policies).select(F.col("recipient").alias("id"), "start_ms", (F.col("start_ms") + WEEK).alias("end_ms"), F.col("amount").alias("score"), F.lit(0).cast("decimal(38,0)").alias("earned"))
    return merged([v, extra])


def averages(rows: DataFrame) -> DataFrame:
    """One row over a page (score, earned): sums and means."""
    return rows.agg(F.sum("score").alias("score"), F.avg("score").alias("mean_score"), F.sum("earned").cast("decimal(38,0)").alias("earned"), (F.sum("earned").cast("double") / F.count(F.lit(1))).alias("mean_earned"))


def frame_of(weeks: DataFrame, which: str) -> DataFrame:
    """Intervals (start_ms, end_ms) of a time frame: the last one (``this``), the one before (``last``), the four before
    the last (``month``), or all."""
    if which == "all":
        return weeks
    first, n = {"this": (0, 1), "last": (1, 1), "month": (1, 4)}[which]
    return weeks.orderBy(F.desc("end_ms")).offset(first).limit(n)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after, change) of participants' scores; one that is in one of both only is an error when rows are
    read."""
    a, b = (x.groupBy(F.col("id").alias(k)).agg(F.sum("score").alias(n)) for x, k, n in ((before, "a", "before"), (after, "b", "after")))
    met = a.join(b, F.col("a") == F.col("b"), "full_outer")
    alone = F.raise_error(F.concat(F.lit("participant on one side only: "), F.coalesce("a", "b").cast("string"))).cast(a.schema["a"].dataType)
    return met.select(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a")).otherwise(alone).alias("id"), "before", "after", (F.col("after") - F.col("before")).alias("change"))

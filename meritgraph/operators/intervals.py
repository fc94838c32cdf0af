"""Weekly partitions, minted weight, budgets and bonuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import has_prefix
from meritgraph.functions.weeks import week_intervals, week_start
from meritgraph.operators.asof import asof_join
from meritgraph.operators.frames import checkpointed
from meritgraph.operators.graph import Graph, solid


#: Factors (a row for each prefix and week) are broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def weekly_counts(g: Graph) -> DataFrame:
    """(idx, start_ms, end_ms, n_nodes, n_edges) of all weeks, empty ones included; timeless nodes and dangling edges
    are in none."""
    n = g.nodes.where("timestamp_ms IS NOT NULL").select(week_start(F.col("timestamp_ms")).alias("start_ms"), F.lit(1).alias("n"), F.lit(0).alias("e"))
    both = n.union(solid(g).select(week_start(F.col("timestamp_ms")), F.lit(0), F.lit(1)))
    counts = both.groupBy("start_ms").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))
    weeks = week_intervals(both, "start_ms")
    return weeks.join(counts, "start_ms", "left").select("idx", "start_ms", "end_ms", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def weekly_mint(weighted: DataFrame) -> DataFrame:
    """(start_ms, mint): weights of the nodes of each week."""
    return weighted.where("timestamp_ms IS NOT NULL").groupBy(week_start(F.col("timestamp_ms")).alias("start_ms")).agg(F.sum("weight").alias("mint"))


def check_disjoint(prefixes: list[str]) -> None:
    """No prefix may be another's prefix: sorted, one would stand right before the other."""
    ordered = sorted(prefixes)
    for a, b in zip(ordered, ordered[1:], strict=False):
        if b.startswith(a):
            raise ValueError(f"budget prefixes conflict: {a!r} and {b!r}")


def apply_budget(weighted: DataFrame, budgets: DataFrame) -> DataFrame:
    """``weighted`` (address, timestamp_ms, weight) with ``weight`` scaled down where the nodes of a budget's prefix
    mint more in a week than its period allows. budgets (prefix, start_ms, budget): a few rows of configuration."""
    names = sorted({r.prefix for r in budgets.select("prefix").distinct().collect()})
    check_disjoint(names)
    entry = F.coalesce(*(F.when(has_prefix(F.col("address"), p), F.lit(p)) for p in names), F.lit(None).cast("string"))
    own = weighted.withColumn("prefix", entry).withColumn("week", week_start(F.col("timestamp_ms")))
    totals = own.where("prefix IS NOT NULL AND week IS NOT NULL").groupBy("prefix", "week").agg(F.sum("weight").alias("total"))
    allowed = asof_join(totals, budgets, "week", "start_ms", "budget", by=["prefix"])
    factor = F.when(F.col("budget").isNull() | (F.col("total") <= F.col("budget")), 1.0).otherwise(F.col("budget") / F.col("total"))
    factors = allowed.select("prefix", "week", factor.alias("factor"))
    factors = checkpointed(factors)
    met = own.join(F.broadcast(factors) if factors.count() <= BROADCAST_ROWS else factors, ["prefix", "week"], "left")
    return met.withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("prefix", "week", "factor")


def bonuses(mint: DataFrame, policies: DataFrame) -> DataFrame:
    """(recipient, start_ms, amount): each policy's share of each week's mint, by its period; nothing where it is 0."""
    recipients = policies.select("recipient").distinct()
    each = mint.join(F.broadcast(recipients), F.lit(True))  # policies are configuration, weeks are few
    found = asof_join(each, policies, "start_ms", "period_ms", "share", by=["recipient"])
    return found.select("recipient", "start_ms", (F.col("mint") * F.coalesce("share", F.lit(0.0))).alias("amount")).where("amount <> 0")


def lookback(rows: DataFrame, weeks: int, until_ms: int, key: str = "end_ms") -> DataFrame:
    """Rows of the last ``weeks`` intervals that are complete at a time; of all complete ones where ``weeks`` is 0."""
    done = rows.where(F.col(key) <= until_ms)
    if not weeks:
        return done
    last = done.select(key).distinct().orderBy(F.desc(key)).limit(weeks)
    return done.join(F.broadcast(last), key, "left_semi")  # ``weeks`` rows

"""Names for new identities, as if they were given one after the other.

A proposal takes the first of its forms that is free: its name, the name with the plugin's, and that with 1 to 99. Names
are one whatever their case. In order this is a loop; here it goes in rounds: each proposal claims a form, each form goes
to its least claimant, and whoever loses one claims the next. Proposals that are alike have the same forms, so each also
leaves a form to every one before it, in one step. Claims only move on where a smaller claimant holds the form, so the
rounds end with what the loop gives; they are as many as clashes between unlike proposals follow from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.operators.frames import checkpointed

#: What a name may be, and how many forms a proposal has.
PATTERN, LONGEST, FORMS = "^[A-Za-z0-9-]+$", 42, 101


def form(k: Column) -> Column:
    """The k-th form of (name, plugin)."""
    both = F.concat_ws("-", "name", "plugin")
    return F.when(k == 0, F.col("name")).when(k == 1, both).otherwise(F.concat_ws("-", both, (k - 1).cast("string")))


def _refuse(rows: DataFrame, why: str) -> None:
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{why}: {sorted(map(tuple, found))}")


def new_names(proposals: DataFrame, taken: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(ord, address, name) of the identities that ``proposals`` (ord, distinct; name, plugin, address) ask for. Addresses
    that are ``known`` (address) have one already, and of several proposals with one address the first counts. ``taken``
    (name): names in use. Names that aren't valid, forms that are too long, and proposals that have no form left are
    errors."""
    rows = proposals.groupBy("address").agg(F.min_by(F.struct("ord", "name", "plugin"), "ord").alias("p")).select("address", "p.*")
    if known is not None:
        rows = rows.join(known.select("address").distinct(), "address", "left_anti")
    rows = checkpointed(rows)
    _refuse(rows.where(~F.coalesce(F.regexp_like("name", F.lit(PATTERN)) & F.regexp_like("plugin", F.lit(PATTERN)), F.lit(False))).select("ord", "name"), "not names")
    alike = [F.lower("name").alias("ln"), F.lower("plugin").alias("lp")]
    # proposals that are alike share their forms, so there can't be more of them; and no window below holds more
    _refuse(rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FORMS), "more proposals than forms")
    used = checkpointed(taken.select(F.lower("name").alias("form")).distinct())
    rows = rows.withColumn("k", F.lit(0))
    while True:
        # the i-th of those that are alike is at least i - j forms beyond the j-th
        order = Window.partitionBy(*(F.lower(c) for c in ("name", "plugin"))).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        i = F.count(F.lit(1)).over(order).cast("int")
        claims = rows.withColumn("i", i).withColumn("k", F.col("i") + F.max(F.col("k") - F.col("i")).over(order)).drop("i")
        text = form(F.col("k"))
        wrong = F.raise_error(F.concat(F.lit("no name is left, or it is too long: "), text)).cast("string")
        claims = claims.withColumn("text", F.when((F.col("k") >= FORMS) | (F.length(text) > LONGEST), wrong).otherwise(text))
        claims = checkpointed(claims.withColumn("form", F.lower("text")))
        least = claims.groupBy("form").agg(F.min("ord").alias("winner")).join(used.withColumn("used", F.lit(True)), "form", "left")
        least = checkpointed(least.select("form", F.when(F.col("used").isNull(), F.col("winner")).alias("winner")))
        # a form with many claimants is split as any skewed join, for both sides are written
        met = checkpointed(claims.join(least, "form").withColumn("won", F.coalesce(F.col("winner") == F.col("ord"), F.lit(False))))
        if met.where("NOT won").isEmpty():
            return met.select("ord", "address", F.col("text").alias("name"))
        rows = met.select("address", "ord", "name", "plugin", (F.col("k") + F.when(F.col("won"), 0).otherwise(1)).alias("k"))

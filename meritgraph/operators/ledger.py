"""An event log folded into accounts.

Events (seq, ts_ms, type, id, other, name, address, amount) are applied in the order of ``seq``. Each part of an
account follows from an aggregation over its own events; merged identities are drawn together first, as connected
components of the merge events, the target of the last merge lending its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.functions.money import AMOUNT
from meritgraph.operators.frames import checkpointed


def check_order(events: DataFrame) -> None:
    """Times may not decrease along ``seq``: in each range of it, and from range to range."""
    ts = F.coalesce("ledger_ms", "ts_ms") if "ledger_ms" in events.columns else F.col("ts_ms")  # a distribution has a time of its own
    ranged = events.select("seq", ts.alias("ts_ms")).repartitionByRange("seq").withColumn("p", F.spark_partition_id())
    ranged = checkpointed(ranged)
    last = F.lag("ts_ms").over(Window.partitionBy("p").orderBy("seq"))
    inside = ranged.withColumn("before", last).where("before > ts_ms")
    ends = ranged.groupBy("p").agg(F.min("seq").alias("a"), F.min_by("ts_ms", "seq").alias("first"), F.max_by("ts_ms", "seq").alias("last")).orderBy("a").collect()  # a row a partition
    if not inside.isEmpty() or any(x.last > y.first for x, y in zip(ends, ends[1:], strict=False)):
        raise ValueError("ledger events are out of order")


def survivors(events: DataFrame) -> DataFrame:
    """(id, target): what each merged identity ends as, by following merges (``other`` into ``id``) to the end.
    Identities that are merged twice, into themselves, or in a circle are errors."""
    names = checkpointed(events.where("type = 'MERGE'").select(F.col("other").alias("id"), F.col("id").alias("target")))
    twice = names.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id") == F.col("target")).alias("own")).where("n > 1 OR own").limit(5).collect()
    if twice:
        raise ValueError(f"merged twice or into themselves: {sorted(r.id for r in twice)}")
    for _ in range(names.count().bit_length() + 1):  # jumps double, so the longest way ends by then
        onward = names.select(F.col("id").alias("target"), F.col("target").alias("next"))
        jumped = checkpointed(names.join(onward, "target", "left").select("id", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")))
        if jumped.where("moved").isEmpty():
            return names
        names = jumped.select("id", "target")
    raise ValueError("merges go round in a circle")


def settled(events: DataFrame) -> DataFrame:
    """Events with ``id`` and ``other`` replaced by the identities they end as (other than of merges themselves)."""
    names = survivors(events)
    a, b = names.select(F.col("id").alias("ai"), F.col("target").alias("at")), names.select(F.col("id").alias("bi"), F.col("target").alias("bt"))
    met = events.join(a, F.col("id") == F.col("ai"), "left").join(b, F.col("other") == F.col("bi"), "left")
    return met.withColumn("own", F.coalesce("at", "id")).withColumn("to", F.coalesce("bt", "other")).drop("ai", "at", "bi", "bt")


def accounts(events: DataFrame) -> DataFrame:
    """(id, name, active, paid, balance, n_aliases, address) of identities that were not merged into others."""
    done = settled(events)
    created = done.where("type = 'CREATE' AND own = id").select(F.col("id"), F.col("name").alias("_created"))
    named = done.where("type = 'RENAME' AND own = id").groupBy("own").agg(F.max_by("name", "seq").alias("_renamed"))
    toggles = done.where("type = 'TOGGLE' AND own = id").groupBy("own").agg((F.count(F.lit(1)) % 2 == 1).alias("active"))
    money = done.where("type IN ('DISTRIBUTE', 'TRANSFER')").select(F.inline(F.array(
        F.struct(F.col("own"), F.when(F.col("type") == "TRANSFER", -F.col("amount")).otherwise(F.col("amount")).cast(AMOUNT).alias("balance"), F.when(F.col("type") == "DISTRIBUTE", F.col("amount")).otherwise(0).cast(AMOUNT).alias("paid")),
        F.struct(F.col("to").alias("own"), F.when(F.col("type") == "TRANSFER", F.col("amount")).otherwise(0).cast(AMOUNT).alias("balance"), F.lit(0).cast(AMOUNT).alias("paid")),
    )))
    money = money.where("own IS NOT NULL").groupBy("own").agg(F.sum("balance").cast(AMOUNT).alias("balance"), F.sum("paid").cast(AMOUNT).alias("paid"))
    aliases = done.where("type = 'ALIAS'").select("own", "address").union(done.where("type = 'MERGE'").select("own", F.col("other"))).groupBy("own").agg(F.count_distinct("address").alias("n_aliases"))
    payout = done.where("type = 'PAYOUT_ADDRESS'").groupBy("own").agg(F.max_by("address", "seq").alias("address"))
    out = created
    for part in (named, toggles, money, aliases, payout):
        out = out.join(part.withColumnRenamed("own", "_k"), F.col("id") == F.col("_k"), "left").drop("_k")
    zero = F.lit(0).cast(AMOUNT)
    return out.select("id", F.coalesce("_renamed", "_created").alias("name"), F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("paid", zero).alias("paid"), F.coalesce("balance", zero).alias("balance"), F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), "address")


def overdrawn(events: DataFrame) -> DataFrame:
    """(id, seq) of transfers beyond the balance that the account had then (before merges). What an event takes is looked
    at before what it gives, so a transfer to oneself has to be covered as well."""
    moves = events.where("type IN ('DISTRIBUTE', 'TRANSFER')").select("seq", F.inline(F.array(
        F.struct(F.col("id"), F.when(F.col("type") == "TRANSFER", -F.col("amount")).otherwise(F.col("amount")).cast(AMOUNT).alias("x")),
        F.struct(F.col("other").alias("id"), F.when(F.col("type") == "TRANSFER", F.col("amount")).otherwise(0).cast(AMOUNT).alias("x")),
    ))).where("id IS NOT NULL")
    held = F.sum("x").over(Window.partitionBy("id").orderBy("seq", "x").rowsBetween(Window.unboundedPreceding, 0))
    return moves.withColumn("held", held).where("held < 0 AND x < 0").select("id", "seq")


def new_events(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Events that only we have, by uuid."""
    return ours.join(theirs.select("uuid"), "uuid", "left_anti")

"""Fixed budgets shared out by policy, exact to the last unit.

A policy turns participants' scores over intervals into one score each; ``split`` shares the budget. In order of id,
each participant has the part of the budget that the scores up to its own are worth, less the part of those before it,
both cut to whole units in double precision, and all scores together are worth the budget itself. So the sum is exact, and only
running sums are needed: they are taken inside ranges of ids and moved by the totals of the ranges before. Single units
can differ from those of a split that goes from one participant to the next."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.functions.money import AMOUNT
from meritgraph.operators.frames import checkpointed
from meritgraph.operators.intervals import lookback

#: Totals of ranges are broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def split(scored: DataFrame) -> DataFrame:
    """(allocation, id, amount) from (allocation, budget, id, score): the sum of each allocation is its budget. Budgets
    below 0 or from 10^30 on, negative or infinite scores, and scores without a sum are errors. Repeated ids are shares of their own."""
    rows = scored.select("allocation", F.col("budget").cast(AMOUNT).alias("budget"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    rows = checkpointed(rows.repartitionByRange("allocation", "id", "score").withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("allocation", "_p").orderBy("id", "score")
    run = checkpointed(rows.withColumn("_run", F.sum("score").over(own.rowsBetween(Window.unboundedPreceding, 0))))
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") == float("inf"))
    # a range's total is its last running sum, so that the sums go on from range to range without a step back
    totals = run.groupBy("allocation", "_p").agg(F.max("_run").alias("_t"), F.count_if(bad).alias("_bad"), F.min("budget").alias("_b"))
    all_before = Window.partitionBy("allocation").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("allocation").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("allocation")
    before = F.coalesce(F.sum("_t").over(all_before), F.lit(0.0))
    # the sum of all, by the same additions
    moved = checkpointed(totals.select("allocation", "_p", before.alias("_before"), F.sum("_t").over(to_here).alias("_sum"), "_bad", "_b").withColumn("_all", F.max("_sum").over(whole)))
    wrong = moved.agg(F.sum("_bad").alias("bad"), F.count_if((F.col("_b") < 0) | (F.col("_b") >= F.lit(Decimal(10**30)))).alias("negative"), F.count_if(~(F.col("_all") > 0)).alias("empty")).first()
    if wrong.bad or wrong.negative or wrong.empty:
        raise ValueError("budgets have to be in [0, 10^30), scores have to be finite, not negative, and have a sum to share by")
    met = run.join(F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved, ["allocation", "_p"])
    cut = lambda s: F.least(_whole(F.col("budget").cast("double") * (s / F.col("_all"))), F.col("budget"))
    part = lambda s: F.when(s >= F.col("_all"), F.col("budget")).otherwise(cut(s))
    end = part(F.col("_before") + F.col("_run"))
    begin = part(F.col("_before") + F.coalesce(F.lag("_run").over(own), F.lit(0.0)))
    return met.select("allocation", "id", (end - begin).cast(AMOUNT).alias("amount"))


def _whole(x: Column) -> Column:
    """The floor of a double below 2^103, digit by digit: longs end sooner, and casts go by the shortest decimals."""
    high = F.floor(x / 2.0**40)
    return (high.cast("decimal(19,0)") * F.lit(Decimal(2**40)).cast("decimal(13,0)") + F.floor(x - high.cast("double") * 2.0**40).cast("decimal(19,0)")).cast(AMOUNT)


def immediate(view: DataFrame, until_ms: int, weeks: int = 1) -> DataFrame:
    """(id, score): the sum over the last complete intervals. view (id, start_ms, end_ms, score, earned)."""
    if weeks < 1:
        raise ValueError("the lookback has to be at least one interval")
    return lookback(view, weeks, until_ms).groupBy("id").agg(F.sum("score").alias("score"))


def recent(view: DataFrame, until_ms: int, discount: float, exclude: list[str] | None = None) -> DataFrame:
    """(id, score): the sum over complete intervals, each worth (1 - discount) of the one after it."""
    if not 0 <= discount <= 1:
        raise ValueError("the discount has to be in [0, 1]")
    done = view.where(F.col("end_ms") <= until_ms)
    last = done.agg(F.max("end_ms").alias("last"))
    age = ((F.col("last") - F.col("end_ms")) / 604_800_000).cast("int")
    met = done.join(F.broadcast(last), F.lit(True)).where(~F.col("id").isin(exclude or []))
    return met.groupBy("id").agg(F.sum(F.col("score") * F.pow(F.lit(1 - discount), age)).alias("score"))


def balanced(view: DataFrame, until_ms: int, budget: int, weeks: int = 0) -> DataFrame:
    """(id, score): by how much each was paid less than an even rate over the lookback (0: all time) would give."""
    done = lookback(view, weeks, until_ms).groupBy("id").agg(F.sum("score").alias("own"), F.sum(F.col("earned").cast(AMOUNT)).alias("earned"))
    totals = done.agg(F.sum("own").alias("scores"), F.sum("earned").cast(AMOUNT).alias("paid"))
    rate = _floor((F.col("paid") + F.lit(Decimal(budget)).cast(AMOUNT)).cast("double") * (1 / F.col("scores")))
    met = done.join(F.broadcast(totals), F.lit(True)).withColumn("rate", rate)
    return met.select("id", F.greatest(F.lit(0.0), _floor(F.col("rate") * F.col("own")) - F.col("earned").cast("double")).alias("score"))


def _floor(x: Column) -> Column:
    """In doubles: from 2^53 on they are whole, and beyond 2^63 too large for a long."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def special(accounts: DataFrame, recipient: str) -> DataFrame:
    """(id, score) of one active account, which gets all."""
    found = accounts.where((F.col("id") == recipient) & F.col("active"))
    if found.isEmpty():
        raise ValueError(f"no such active account: {recipient}")
    return found.select("id", F.lit(1.0).alias("score"))


def allocate(name: str, budget: int, scored: DataFrame) -> DataFrame:
    return split(scored.select(F.lit(name).alias("allocation"), F.lit(Decimal(budget)).cast(AMOUNT).alias("budget"), "id", "score"))


def payable(amounts: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address, amount): accounts without a payout address are left out, those that share one are summed."""
    return amounts.join(addresses, "id").groupBy("address").agg(F.sum("amount").cast(AMOUNT).alias("amount"))


@dataclass(frozen=True)
class Policy:
    """kind: IMMEDIATE (weeks), RECENT (discount, exclude), BALANCED (weeks; 0: all) or SPECIAL (recipient)."""

    kind: str
    budget: int
    weeks: int = 0
    discount: float = 0.0
    exclude: tuple[str, ...] = ()
    recipient: str = ""

    def __post_init__(self) -> None:
        if self.kind not in ("IMMEDIATE", "RECENT", "BALANCED", "SPECIAL"):
            raise ValueError(f"unknown policy: {self.kind}")
        if self.budget < 0 or self.weeks < 0 or (self.kind == "IMMEDIATE" and self.weeks < 1) or not 0 <= self.discount <= 1:
            raise ValueError(f"policy out of bounds: {self}")
        if self.kind == "SPECIAL" and not self.recipient:
            raise ValueError("a special policy needs a recipient")

    def scores(self, view: DataFrame, until_ms: int, accounts: DataFrame | None = None) -> DataFrame:
        if self.kind == "IMMEDIATE":
            return immediate(view, until_ms, self.weeks)
        if self.kind == "RECENT":
            return recent(view, until_ms, self.discount, list(self.exclude))
        if self.kind == "BALANCED":
            return balanced(view, until_ms, self.budget, self.weeks)
        if accounts is None:
            raise ValueError("a special policy needs accounts")
        return special(accounts, self.recipient)


def distribution(policies: list[Policy], view: DataFrame, until_ms: int, accounts: DataFrame | None = None) -> DataFrame:
    """(allocation, ts_ms, id, amount): the allocations of all policies at a time, each exactly its budget, over the
    active accounts if ``accounts`` (id, active) are given. An allocation is named by its place and kind. Policies
    without a budget give nothing."""
    own = view if accounts is None else view.join(accounts.where("active").select("id"), "id", "left_semi")
    rows = [p.scores(own, until_ms, accounts).select(F.lit(f"{i}-{p.kind}").alias("allocation"), F.lit(Decimal(p.budget)).cast(AMOUNT).alias("budget"), F.col("id").cast("string").alias("id"), "score") for i, p in enumerate(policies) if p.budget]
    if not rows:
        raise ValueError("no policy has a budget")
    found = split(reduce(DataFrame.unionByName, rows))
    return found.select("allocation", F.lit(until_ms).cast("long").alias("ts_ms"), "id", "amount")


def due(weeks: DataFrame, last_ms: int | None, now_ms: int, most: int, again: bool = False) -> list[int]:
    """Ends of the intervals to distribute for: complete ones since the last distribution, the latest ``most`` of them;
    with ``again`` the latest complete one where there are none."""
    done = weeks.where(F.col("end_ms") <= now_ms).select("end_ms")
    new = done.where(F.col("end_ms") > (last_ms if last_ms is not None else -(2**63))).orderBy(F.desc("end_ms")).limit(most)
    ends = sorted(r.end_ms for r in new.collect())  # ``most`` rows
    if again and not ends:
        ends = [r.end_ms for r in done.orderBy(F.desc("end_ms")).limit(1).collect()]
    return ends


def apply_distributions(policies: list[Policy], view: DataFrame, ends: list[int], accounts: DataFrame | None = None) -> DataFrame:
    """The distributions of all ``ends``, one after the other: what one pays counts as earned, in the interval that its
    time ends, for those after it."""
    out = []
    for end in ends:
        found = checkpointed(distribution(policies, view, end, accounts))
        out.append(found)
        paid = found.groupBy("id").agg(F.sum("amount").cast(AMOUNT).alias("earned")).select("id", F.lit(end - 604_800_000).cast("long").alias("start_ms"), F.lit(end).cast("long").alias("end_ms"), F.lit(0.0).alias("score"), "earned")
        view = checkpointed(view.select("id", "start_ms", "end_ms", "score", "earned").unionByName(paid).groupBy("id", "start_ms", "end_ms").agg(F.sum("score").alias("score"), F.sum("earned").cast(AMOUNT).alias("earned")))
    if not out:
        raise ValueError("no interval is due")
    return reduce(DataFrame.unionByName, out)


def distribution_totals(found: DataFrame) -> DataFrame:
    """(id, amount, percent) of what each got over all allocations, and its share of the whole."""
    own = found.groupBy("id").agg(F.sum("amount").cast(AMOUNT).alias("amount"))
    whole = own.agg(F.sum("amount").cast(AMOUNT).alias("whole"))
    return own.join(F.broadcast(whole), F.lit(True)).select("id", "amount", (100 * F.col("amount").cast("double") / F.col("whole").cast("double")).alias("percent"))


def as_events(found: DataFrame, first_seq: int) -> DataFrame:
    """Ledger events (seq, ts_ms, type, id, other, name, address, amount), one a receipt, in order of time, allocation
    and id from ``first_seq`` on."""
    from meritgraph.operators.order import with_index

    key = F.format_string("%020d %s %s", "ts_ms", "allocation", "id")
    rows = with_index(found.withColumn("_k", key), "_k", "seq")
    none = F.lit(None).cast("string")
    return rows.select((F.col("seq") + first_seq).alias("seq"), "ts_ms", F.lit("DISTRIBUTE").alias("type"), "id", none.alias("other"), none.alias("name"), none.alias("address"), "amount")

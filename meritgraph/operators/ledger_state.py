"""What a ledger's events say beside its accounts: switches, accounting periods, rules that events break, histories, and
accounts beside scores.

Events are those of ``ledger``, with these types as well: TYPE (``name``: the identity's new kind), ACCOUNTING_ON and
ACCOUNTING_OFF, INTEGRATION_ON and INTEGRATION_OFF, CURRENCY (``address``; null removes it), EXECUTED (``id``: a
distribution). A DISTRIBUTE row is one receipt: ``name`` is its distribution, ``address`` its allocation; rows of one
distribution share their ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.functions.money import AMOUNT
from meritgraph.operators.frames import checkpointed
from meritgraph.operators.ledger import settled

SWITCHES = ("ACCOUNTING_ON", "ACCOUNTING_OFF", "INTEGRATION_ON", "INTEGRATION_OFF", "CURRENCY")


def _last(kinds: list[str], value: Column) -> Column:
    return F.max_by(F.when(F.col("type").isin(kinds), value), F.when(F.col("type").isin(kinds), F.col("seq")))


def settings(events: DataFrame) -> DataFrame:
    """One row (accounting, integration, currency): the last state of each switch; accounting is on and the others are
    off from the start."""
    rows = events.where(F.col("type").isin(list(SWITCHES)))
    on = lambda k: _last([f"{k}_ON", f"{k}_OFF"], F.col("type") == f"{k}_ON")
    return rows.agg(F.coalesce(on("ACCOUNTING"), F.lit(True)).alias("accounting"), F.coalesce(on("INTEGRATION"), F.lit(False)).alias("integration"), _last(["CURRENCY"], F.col("address")).alias("currency"))


def kinds(events: DataFrame, default: str = "USER") -> DataFrame:
    """(id, kind): the last TYPE of each identity that was created, else the default."""
    last = events.where("type = 'TYPE'").groupBy("id").agg(F.max_by("name", "seq").alias("kind"))
    return events.where("type = 'CREATE'").select("id").join(last, "id", "left").select("id", F.coalesce("kind", F.lit(default)).alias("kind"))


def counting(events: DataFrame) -> Column:
    """Whether an event's amounts still stand in balances: none of those before the last ACCOUNTING_OFF, which erases all
    balances, and none of those since then that came while accounting was off. Settings are few: two sequence numbers,
    read by the driver. They are told apart by ``seq``, so an event's own order among those decides."""
    flips = events.where("type IN ('ACCOUNTING_ON', 'ACCOUNTING_OFF')").select("seq", "type")
    off = flips.where("type = 'ACCOUNTING_OFF'").agg(F.max("seq")).first()[0]
    if off is None:
        return F.lit(True)
    on = flips.where((F.col("type") == "ACCOUNTING_ON") & (F.col("seq") > off)).agg(F.min("seq")).first()[0]
    return F.lit(False) if on is None else F.col("seq") > on


def balances(events: DataFrame) -> DataFrame:
    """(id, balance, paid, active) of identities that were not merged into others. Switching accounting off erases all
    balances, and what comes until it is switched on again doesn't count to them; what was paid stays. Accounts are
    active after an odd number of toggles: a log has toggles of its own for accounts that lose their activity when
    accounting is switched off or the currency changes."""
    done = settled(events)
    signed = F.when(F.col("type") == "TRANSFER", -F.col("amount")).otherwise(F.col("amount")).cast(AMOUNT)
    zero = F.lit(0).cast(AMOUNT)
    money = done.where("type IN ('DISTRIBUTE', 'TRANSFER')").select("seq", F.inline(F.array(
        F.struct(F.col("own").alias("k"), signed.alias("x"), F.when(F.col("type") == "DISTRIBUTE", F.col("amount")).otherwise(zero).cast(AMOUNT).alias("paid")),
        F.struct(F.col("to").alias("k"), F.when(F.col("type") == "TRANSFER", F.col("amount")).otherwise(zero).cast(AMOUNT).alias("x"), zero.alias("paid")),
    ))).where("k IS NOT NULL")
    money = money.groupBy("k").agg(F.sum(F.when(counting(events), F.col("x")).otherwise(zero)).cast(AMOUNT).alias("balance"), F.sum("paid").cast(AMOUNT).alias("paid"))
    state = done.where("type = 'TOGGLE' AND own = id").groupBy(F.col("own").alias("k2")).agg((F.count(F.lit(1)) % 2 == 1).alias("active"))
    met = done.where("type = 'CREATE' AND own = id").select("id").join(money, F.col("id") == F.col("k"), "left").join(state, F.col("id") == F.col("k2"), "left")
    return met.select("id", F.coalesce("balance", zero).alias("balance"), F.coalesce("paid", zero).alias("paid"), F.coalesce("active", F.lit(False)).alias("active"))


def history(events: DataFrame) -> DataFrame:
    """(id, receipts array<struct<ts_ms, amount>>) by time: what each identity was given, with that of those merged into
    it."""
    got = settled(events).where("type = 'DISTRIBUTE' AND own IS NOT NULL")
    return got.groupBy(F.col("own").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ts_ms", F.col("amount").cast(AMOUNT).alias("amount")))).alias("receipts"))


def executed(events: DataFrame) -> DataFrame:
    """(distribution, amount, executed): marks count from the last time integration was switched off."""
    off = F.broadcast(events.where("type = 'INTEGRATION_OFF'").agg(F.coalesce(F.max("seq"), F.lit(-(2**63))).alias("off")))
    marks = events.where("type = 'EXECUTED'").join(off, F.lit(True)).where("seq > off").select(F.col("id").alias("m")).distinct()
    sums = events.where("type = 'DISTRIBUTE' AND name IS NOT NULL").groupBy(F.col("name").alias("distribution")).agg(F.sum("amount").cast(AMOUNT).alias("amount"))
    return sums.join(marks, F.col("distribution") == F.col("m"), "left").select("distribution", "amount", F.col("m").isNotNull().alias("executed"))


def violations(events: DataFrame) -> DataFrame:
    """(seq, id, rule) of events that a ledger would refuse: ``name`` (held by another identity, in any case),
    ``alias`` (bound before), ``id`` (not created before, or merged away), ``amount`` (negative), ``inactive`` (a receipt
    or a side of a transfer), ``accounting`` (a transfer while it is off). Balances: see ``ledger.overdrawn``."""
    e = events.select("seq", "type", "id", "other", "name", "address", "amount")
    # a name is held from its event to the holder's next name, or to the holder's merge
    named = e.where("type IN ('CREATE', 'RENAME')").select("seq", "id", F.lower("name").alias("n")).union(e.where("type = 'MERGE'").select("seq", F.col("other"), F.lit(None).cast("string")))
    until = F.coalesce(F.lead("seq").over(Window.partitionBy("id").orderBy("seq")), F.lit(2**63 - 1))
    held = named.withColumn("until", until).where("n IS NOT NULL")
    before = Window.partitionBy("n").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    names = held.withColumn("b", F.max("until").over(before)).where("b > seq").select("seq", "id", F.lit("name").alias("rule"))
    nth = F.row_number().over(Window.partitionBy("address").orderBy("seq"))
    aliases = e.where("type = 'ALIAS'").withColumn("k", nth).where("k > 1").select("seq", "id", F.lit("alias"))
    amounts = e.where("type IN ('DISTRIBUTE', 'TRANSFER') AND amount < 0").select("seq", "id", F.lit("amount"))
    # every use of an id beside its life
    uses = e.where("type NOT IN ('CREATE', 'EXECUTED') AND id IS NOT NULL").select("seq", "type", F.col("id").alias("k")).union(e.where("type IN ('TRANSFER', 'MERGE')").select("seq", "type", F.col("other")))
    life = e.where("type = 'CREATE'").groupBy("id").agg(F.min("seq").alias("born"))
    end = e.where("type = 'MERGE'").groupBy(F.col("other").alias("gone")).agg(F.min("seq").alias("died"))
    met = uses.join(life, F.col("k") == F.col("id"), "left").join(end, F.col("k") == F.col("gone"), "left")
    ids = met.where("born IS NULL OR born > seq OR died < seq").select("seq", F.col("k").alias("id"), F.lit("id").alias("rule")).distinct()
    # a toggle's number among those of its account tells whether it is on after it
    spent = e.where("type IN ('DISTRIBUTE', 'TRANSFER')").select("seq", F.explode(F.array_distinct(F.array_compact(F.array("id", F.when(F.col("type") == "TRANSFER", F.col("other")))))).alias("id"), F.lit(0).alias("t"))
    toggled = e.where("type = 'TOGGLE'").select("seq", "id", F.lit(1).alias("t"))
    on = F.sum("t").over(Window.partitionBy("id").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0))
    idle = spent.union(toggled).withColumn("on", on).where("t = 0 AND on % 2 = 0").select("seq", "id", F.lit("inactive").alias("rule")).distinct()
    # switches are few: the last one before each transfer, from one broadcast array
    flips = e.where("type IN ('ACCOUNTING_ON', 'ACCOUNTING_OFF')").agg(F.sort_array(F.collect_list(F.struct("seq", (F.col("type") == "ACCOUNTING_ON").alias("on")))).alias("f"))
    last = F.filter("f", lambda x: x["seq"] < F.col("seq"))
    off = e.where("type = 'TRANSFER'").join(F.broadcast(flips), F.lit(True)).where((F.size(last) > 0) & ~F.element_at(last, -1)["on"]).select("seq", "id", F.lit("accounting"))
    return names.union(aliases).union(ids).union(amounts).union(idle).union(off)


def refuse(events: DataFrame) -> None:
    """An error if any event breaks a rule."""
    found = violations(events).orderBy("seq").limit(5).collect()
    if found:
        raise ValueError(f"events that a ledger refuses: {[tuple(r) for r in found]}")


def accounts_with_scores(accounts: DataFrame, aliases: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts with score, unclaimed (address, score)). accounts (id, address, ...), aliases (id, address), scores
    (address, score): an account without a score, and an alias that has one of its own, are errors; addresses that
    belong to no account are unclaimed."""
    scores = checkpointed(scores.groupBy("address").agg(F.sum("score").alias("score")))
    met = accounts.join(scores.select(F.col("address").alias("_a"), "score"), F.col("address") == F.col("_a"), "left").drop("_a")
    lacking = met.where("score IS NULL").limit(5).collect()
    if lacking:
        raise ValueError(f"accounts without a score: {[r.id for r in lacking]}")
    free = scores.join(accounts.select(F.col("address").alias("_a")), F.col("address") == F.col("_a"), "left_anti")
    wrong = free.join(aliases.select(F.col("address").alias("_a")), F.col("address") == F.col("_a"), "left_semi").limit(5).collect()
    if wrong:
        raise ValueError(f"aliases with a score of their own: {[r.address for r in wrong]}")
    return met, free


def by_address(accounts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(address, id): every address and alias of each account."""
    return accounts.select("address", "id").union(aliases.select("address", "id")).distinct()


def check_payable_view(view: DataFrame, accounts: DataFrame) -> None:
    """What a payout needs: an active account, and scores of at least one in all."""
    if accounts.where("active").isEmpty():
        raise ValueError("no account is active")
    if not (view.agg(F.sum("score")).first()[0] or 0) >= 1:
        raise ValueError("the scores sum to less than one")

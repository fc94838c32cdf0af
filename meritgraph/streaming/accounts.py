"""Accounts of a ledger, kept up to date by a stream of its events.

Every event goes to the accounts that it touches, and each account has state of its own: what it is called, whether it is
active, what it was paid and holds, its payout address for each currency, and the last event that it saw. Two things
concern all accounts at once and are left to whoever reads the table: merges (``current`` adds up what merged identities
hold) and switches of accounting, of which there are few. Events carry the number of erasures before them and whether
accounting is on, so an account learns of an erasure when its next event comes; until then its balance is told from a
live one by the number of erasures beside it.

Events of one account have to come in order: rows of one micro-batch are sorted, and an event of an earlier sequence
number or time than one that the account has seen stops the query. State needs the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meritgraph.functions.money import AMOUNT
from meritgraph.operators.ledger import survivors

STATE = "id string, name string, created boolean, active boolean, paid string, balance string, erasures long, payout map<string,string>"
_OWN = "name string, created boolean, active boolean, paid string, balance string, erasures long, seq long, ts_ms long"


def flips(events: DataFrame) -> DataFrame:
    """One row (f): the switches of accounting (seq, on), in order; they are few."""
    rows = events.where("type IN ('ACCOUNTING_ON', 'ACCOUNTING_OFF')")
    return rows.agg(F.sort_array(F.collect_list(F.struct("seq", (F.col("type") == "ACCOUNTING_ON").alias("on")))).alias("f"))


def _touched(events: DataFrame, switches: DataFrame) -> DataFrame:
    """A row for each account that an event touches: its id, whether it gives, and what stands of the amount."""
    before = F.filter("f", lambda x: x["seq"] < F.col("seq"))
    erasures = F.size(F.filter(before, lambda x: ~x["on"])).cast("long")
    on = F.when(F.size(before) > 0, F.element_at(before, -1)["on"]).otherwise(True)
    both = F.array(F.struct(F.col("id").alias("account"), F.lit(True).alias("first")), F.struct(F.col("other").alias("account"), F.lit(False).alias("first")))
    who = F.when(F.col("type") == "TRANSFER", both).otherwise(F.slice(both, 1, 1))
    rows = events.where("type IN ('CREATE', 'RENAME', 'TOGGLE', 'DISTRIBUTE', 'TRANSFER', 'PAYOUT_ADDRESS') AND id IS NOT NULL")
    rows = rows.join(F.broadcast(switches), F.lit(True)).withColumns({"erasures": erasures, "on": on, "w": F.explode(who)})
    return rows.select("w.account", "w.first", "seq", "ts_ms", "type", "name", "address", F.col("amount").cast("string").alias("amount"), "erasures", "on")


class Accounts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", _OWN)
        self.payout = handle.getMapState("payout", "currency string", "address string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.own.get() if self.own.exists() else (None, False, False, "0", "0", 0, None, None)
        name, created, active, paid, balance, erasures, seq, ts = found
        paid, balance = int(paid), int(balance)
        for r in pd.concat(list(rows)).sort_values(["seq", "first"], kind="stable").itertuples(index=False):
            if seq is not None and (r.seq < seq or r.ts_ms < ts):
                raise ValueError(f"event {r.seq} of account {key[0]} is out of order: it has seen {seq}")
            seq, ts = int(r.seq), int(r.ts_ms)
            if r.erasures > erasures:
                balance, erasures = 0, int(r.erasures)
            if r.type in ("CREATE", "RENAME"):
                name, created = r.name, created or r.type == "CREATE"
            elif r.type == "TOGGLE":
                active = not active
            elif r.type == "PAYOUT_ADDRESS":
                currency = r.name or ""
                if r.address:
                    self.payout.updateValue((currency,), (r.address,))
                elif self.payout.containsKey((currency,)):
                    self.payout.removeKey((currency,))
            else:
                amount = int(r.amount)
                paid += amount if r.type == "DISTRIBUTE" else 0
                balance += (-amount if r.type == "TRANSFER" and r.first else amount) if r.on else 0
        self.own.update((name, created, active, str(paid), str(balance), erasures, seq, ts))
        payout = {k[0]: v[0] for k, v in self.payout.iterator()}
        yield pd.DataFrame({"id": [key[0]], "name": [name], "created": [created], "active": [active], "paid": [str(paid)], "balance": [str(balance)], "erasures": [erasures], "payout": [payout]})

    def close(self) -> None:
        pass


def accounts(events: DataFrame, switches: DataFrame) -> DataFrame:
    """A stream of STATE rows, in update mode: each account as it is after its last event. events (seq, ts_ms, type, id,
    other, name, address, amount) as in ``ledger``, a payout address with its currency in ``name``; switches: ``flips``
    of the log that the stream reads, as far as it is known."""
    return _touched(events, switches).groupBy("account").transformWithStateInPandas(statefulProcessor=Accounts(), outputStructType=STATE, outputMode="Update", timeMode="None")


def current(table: DataFrame, events: DataFrame) -> DataFrame:
    """(id, name, active, paid, balance, payout) of identities that were not merged into others, from the newest row of
    each account (STATE) and the log's merges and switches: what merged ones hold counts for those they ended as."""
    names = survivors(events)
    off = F.broadcast(events.where("type = 'ACCOUNTING_OFF'").agg(F.count(F.lit(1)).alias("n")))
    met = table.join(off, F.lit(True)).join(names.select(F.col("id").alias("m"), "target"), F.col("id") == F.col("m"), "left")
    own = F.coalesce("target", "id")
    live = F.when(F.col("erasures") == F.col("n"), F.col("balance").cast(AMOUNT)).otherwise(0)
    sums = met.groupBy(own.alias("k")).agg(F.sum(F.col("paid").cast(AMOUNT)).cast(AMOUNT).alias("paid"), F.sum(live).cast(AMOUNT).alias("balance"))
    return table.where("created").join(names.select(F.col("id").alias("m")), F.col("id") == F.col("m"), "left_anti").select("id", "name", "active", "payout").join(sums, F.col("id") == F.col("k")).select("id", "name", "active", "paid", "balance", "payout")

"""Ledger logs: one JSON object a line, to events and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.money import AMOUNT
from meritgraph.sources import shapes
from meritgraph.sources.shapes import array_of, by_type, either, elements, field, record

#: The actions of a log, and what events call them.
ACTIONS = {
    "CREATE_IDENTITY": "CREATE", "RENAME_IDENTITY": "RENAME", "CHANGE_IDENTITY_TYPE": "TYPE", "ADD_ALIAS": "ALIAS", "MERGE_IDENTITIES": "MERGE", "TOGGLE_ACTIVATION": "TOGGLE",
    "DISTRIBUTE_GRAIN": "DISTRIBUTE", "TRANSFER_GRAIN": "TRANSFER", "SET_PAYOUT_ADDRESS": "PAYOUT_ADDRESS", "ENABLE_GRAIN_INTEGRATION": "INTEGRATION_ON", "DISABLE_GRAIN_INTEGRATION": "INTEGRATION_OFF",
    "MARK_DISTRIBUTION_EXECUTED": "EXECUTED", "ENABLE_ACCOUNTING": "ACCOUNTING_ON", "DISABLE_ACCOUNTING": "ACCOUNTING_OFF", "SET_EXTERNAL_CURRENCY": "CURRENCY", "REMOVE_EXTERNAL_CURRENCY": "CURRENCY",
}
_ALIAS = record({"address": shapes.text}, {"description": shapes.text})
_CURRENCY = record({"chainId": shapes.text}, {"tokenAddress": either(shapes.null, shapes.text), "type": shapes.text})
_RECEIPT = record({"id": shapes.text, "amount": shapes.matching(r"^-?\d+$", "an amount")})
_ALLOCATION = record({"id": shapes.text, "receipts": array_of(_RECEIPT)}, {"policy": shapes.anything})
_DISTRIBUTION = record({"id": shapes.text, "credTimestamp": shapes.number, "allocations": array_of(_ALLOCATION)})
_IDENTITY = record({"id": shapes.text, "name": shapes.text, "address": shapes.text}, {"subtype": shapes.exactly("USER", "PROJECT", "ORGANIZATION", "BOT"), "aliases": array_of(_ALIAS)})
_TYPED = {
    "CREATE_IDENTITY": ({"identity": _IDENTITY}, {}), "RENAME_IDENTITY": ({"identityId": shapes.text, "newName": shapes.text}, {}), "CHANGE_IDENTITY_TYPE": ({"identityId": shapes.text, "newType": shapes.text}, {}),
    "ADD_ALIAS": ({"identityId": shapes.text, "alias": _ALIAS}, {}), "MERGE_IDENTITIES": ({"base": shapes.text, "target": shapes.text}, {}), "TOGGLE_ACTIVATION": ({"identityId": shapes.text}, {}), "DISTRIBUTE_GRAIN": ({"distribution": _DISTRIBUTION}, {}),
    "TRANSFER_GRAIN": ({"from": shapes.text, "to": shapes.text, "amount": shapes.matching(r"^-?\d+$", "an amount")}, {"memo": either(shapes.null, shapes.text)}),
    "SET_PAYOUT_ADDRESS": ({"id": shapes.text, "payoutAddress": either(shapes.null, shapes.text)}, {"currency": _CURRENCY}), "MARK_DISTRIBUTION_EXECUTED": ({"id": shapes.text}, {}), "SET_EXTERNAL_CURRENCY": ({"currency": _CURRENCY}, {}),
    "ENABLE_GRAIN_INTEGRATION": ({}, {}), "DISABLE_GRAIN_INTEGRATION": ({}, {}), "ENABLE_ACCOUNTING": ({}, {}), "DISABLE_ACCOUNTING": ({}, {}), "REMOVE_EXTERNAL_CURRENCY": ({}, {}),
}
EVENT = record({
    "action": by_type({k: record({"type": shapes.text} | need, may) for k, (need, may) in _TYPED.items()}),
    "ledgerTimestamp": shapes.number, "uuid": shapes.text, "version": shapes.exactly("1"),
})


def _key(currency: Column) -> Column:
    """chain, or chain/token."""
    return F.concat_ws("/", field(currency, "chainId", "string"), field(currency, "tokenAddress", "string"))


def parsed(lines: DataFrame) -> DataFrame:
    """Events (seq, ts_ms, type, id, other, name, address, amount, uuid, memo, ledger_ms, part, line) of lines (seq,
    value). A receipt of a distribution is a row, with the distribution in ``name`` and the allocation in ``address``; an
    identity's subtype and aliases are rows of type TYPE and ALIAS; a payout address has its currency in ``name``.
    ``ts_ms`` is a distribution's own time, ``ledger_ms`` always the log's. ``part`` numbers the rows of a line, and the
    first has the whole ``line``, so that nothing is lost. Lines that don't parse, that have wrong types or unknown
    members, other versions and unknown actions are errors that name line and path."""
    rows = shapes.parsed(lines, EVENT)
    v, none = F.col("v"), F.lit(None).cast("string")
    known = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    a = field(v, "action")
    rows = rows.select("seq", a.alias("a"), F.try_element_at(known, field(a, "type", "string")).alias("type"), field(v, "ledgerTimestamp", "bigint").alias("ledger_ms"), field(v, "uuid", "string").alias("uuid"), F.to_json("v").alias("line"))
    a, t = F.col("a"), F.col("type")
    at = lambda *path: F.try_variant_get(a, "$" + "".join(f"['{p}']" for p in path), "string")

    def part(kind=t, id=none, other=none, name=none, address=none, amount=none, memo=none):  # noqa: A002
        return F.struct(*(c.alias(n) for n, c in (("type", kind), ("id", id), ("other", other), ("name", name), ("address", address), ("amount", amount.cast(AMOUNT)), ("memo", memo))))

    own, who = ("identity", "id"), at("identityId")
    kind = F.when(at("identity", "subtype").isNull(), F.array()).otherwise(F.array(part(F.lit("TYPE"), at(*own), name=at("identity", "subtype"))))
    aliases = F.coalesce(F.transform(elements(field(field(a, "identity"), "aliases")), lambda x: part(F.lit("ALIAS"), at(*own), address=field(x, "address", "string"), memo=field(x, "description", "string"))), F.array())
    created = F.concat(F.array(part(id=at(*own), name=at("identity", "name"), address=at("identity", "address"))), kind, aliases)
    grant = field(a, "distribution")
    receipts = F.flatten(F.transform(elements(field(grant, "allocations")), lambda x: F.transform(elements(field(x, "receipts")), lambda r: part(id=field(r, "id", "string"), name=at("distribution", "id"), address=field(x, "id", "string"), amount=field(r, "amount", "string")))))
    receipts = F.when(F.size(receipts) > 0, receipts).otherwise(F.array(part(name=at("distribution", "id"))))
    parts = F.when(t == "CREATE", created).when(t == "DISTRIBUTE", receipts)
    for k, one in {
        "RENAME": part(id=who, name=at("newName")), "TYPE": part(id=who, name=at("newType")), "ALIAS": part(id=who, address=at("alias", "address"), memo=at("alias", "description")), "TOGGLE": part(id=who),
        "MERGE": part(id=at("base"), other=at("target")), "TRANSFER": part(id=at("from"), other=at("to"), amount=at("amount"), memo=at("memo")), "EXECUTED": part(id=at("id")),
        "PAYOUT_ADDRESS": part(id=at("id"), name=_key(field(a, "currency")), address=at("payoutAddress")),
        "CURRENCY": part(address=F.when(field(a, "currency").isNotNull(), _key(field(a, "currency")))),
    }.items():
        parts = parts.when(t == k, F.array(one))
    rows = rows.select("seq", "uuid", "ledger_ms", "line", "a", F.posexplode(parts.otherwise(F.array(part()))).alias("part", "p"))
    ts = F.when(F.col("p.type") == "DISTRIBUTE", field(field(F.col("a"), "distribution"), "credTimestamp", "bigint")).otherwise(F.col("ledger_ms"))
    return rows.select("seq", ts.alias("ts_ms"), *(F.col(f"p.{c}").alias(c) for c in ("type", "id", "other", "name", "address", "amount")), "uuid", "p.memo", "ledger_ms", "part", F.when(F.col("part") == 0, F.col("line")).alias("line"))


def written_lines(events: DataFrame) -> DataFrame:
    """(seq, value): a line for each event, its keys in order. Events that ``parsed`` has read are written as they were
    (to change one, make its ``line`` null and drop its rows of other parts than 0); the lines of others are made of
    their columns, and receipts of one ``seq`` become one distribution. The last line feed is the file writer's."""
    if "line" in events.columns:
        read = events.where("line IS NOT NULL").select("seq", F.col("line").alias("value"))
        made = events.where("line IS NULL AND coalesce(part, 0) = 0")
        return read.unionByName(written_lines(made.drop("line")))
    c, t = F.col, {v: k for k, v in ACTIONS.items() if k != "REMOVE_EXTERNAL_CURRENCY"}
    named = F.create_map(*(F.lit(x) for kv in t.items() for x in kv))[c("type")]
    action = F.when((c("type") == "CURRENCY") & c("address").isNull(), "REMOVE_EXTERNAL_CURRENCY").otherwise(named)
    plain = events.where("type <> 'DISTRIBUTE'")
    currency = F.struct(F.substring_index("address", "/", 1).alias("chainId"), F.regexp_replace("address", "^[^/]*/", "").alias("tokenAddress"))
    who = lambda **more: F.struct(c("id").alias("identityId"), *(v.alias(k) for k, v in more.items()))
    fields = {
        "CREATE": F.to_json(F.struct(F.struct("address", F.array().cast("array<string>").alias("aliases"), "id", "name").alias("identity"))), "RENAME": F.to_json(who(newName=c("name"))), "TYPE": F.to_json(who(newType=c("name"))),
        "ALIAS": F.to_json(F.struct(F.struct("address").alias("alias"), c("id").alias("identityId"))), "MERGE": F.to_json(F.struct(c("id").alias("base"), c("other").alias("target"))), "TOGGLE": F.to_json(who()),
        "TRANSFER": F.to_json(F.struct(c("amount").cast("string").alias("amount"), c("id").alias("from"), c("other").alias("to"))), "PAYOUT_ADDRESS": F.to_json(F.struct("id", c("address").alias("payoutAddress"))), "EXECUTED": F.to_json(F.struct("id")),
    }
    body = F.lit("{}")
    for k, v in fields.items():
        body = F.when(c("type") == k, v).otherwise(body)
    body = F.when((c("type") == "CURRENCY") & c("address").isNotNull(), F.to_json(F.struct(currency.alias("currency")))).otherwise(body)
    lines = plain.select("seq", "ts_ms", "uuid", action.alias("a"), body.alias("b"))
    grants = events.where("type = 'DISTRIBUTE'").groupBy("seq", "ts_ms", "uuid", "name", "address").agg(F.sort_array(F.collect_list(F.struct(c("amount").cast("string").alias("amount"), "id"))).alias("receipts"))
    grants = grants.groupBy("seq", "ts_ms", "uuid", "name").agg(F.sort_array(F.collect_list(F.struct(c("address").alias("id"), "receipts"))).alias("allocations"))
    grants = grants.select("seq", "ts_ms", "uuid", F.lit("DISTRIBUTE_GRAIN").alias("a"), F.to_json(F.struct(F.struct("allocations", c("ts_ms").alias("credTimestamp"), c("name").alias("id")).alias("distribution"))).alias("b"))
    both = lines.union(grants)
    inner = F.regexp_replace(c("b"), r"\}$", "")
    value = F.concat(F.lit('{"action":'), inner, F.when(c("b") == "{}", "").otherwise(","), F.lit('"type":"'), c("a"), F.lit('"},"ledgerTimestamp":'), c("ts_ms").cast("string"), F.lit(',"uuid":'), F.to_json(F.struct("uuid")).substr(F.lit(9), F.length(F.to_json(F.struct("uuid"))) - 9), F.lit(',"version":"1"}'))
    return both.select("seq", value.alias("value"))


def read_log(spark, path: str) -> DataFrame:
    """Events of a log, numbered in the order of its lines, from 0 in each part of the file that a task reads."""
    return parsed(spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value"))

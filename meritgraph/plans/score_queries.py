"""Queries over expressions, views, payouts and the ledger."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.functions.money import AMOUNT, grouped
from meritgraph.functions.weeks import WEEK, millis
from meritgraph.operators import builders, expressions, ledger, ledger_state, names, payouts, views
from meritgraph.plans.domain import WEEK_SQL
from meritgraph.sources import contributions, exports, ledger_log, tables

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



#: start_ms, key, subkey (null: the key's default), weight
CONFIGS = [
    (800_000_000_000, "priority", None, 1.0), (800_000_000_000, "priority", "1-URGENT", 5.0), (800_000_000_000, "priority", "2-HIGH", 3.0), (800_000_000_000, "flag", None, 0.5), (800_000_000_000, "flag", "R", 2.0), (800_000_000_000, "status", None, 1.5),
    (900_000_000_000, "priority", None, 2.0), (900_000_000_000, "priority", "3-MEDIUM", 0.0), (900_000_000_000, "flag", None, 1.0), (900_000_000_000, "flag", "N", 3.0), (900_000_000_000, "status", None, 1.0), (900_000_000_000, "status", "F", 4.0),
]
_C = "cfg(start_ms, key, subkey, weight) AS (VALUES " + ", ".join(f"({s}, '{k}', {'NULL' if u is None else repr(u)}, {w}::DOUBLE)" for s, k, u, w in CONFIGS) + ")"
_TREES = f"""{_C}, st AS (SELECT DISTINCT start_ms FROM cfg), o AS (SELECT o_orderkey AS contribution, epoch_us(o_orderdate) // 1000 AS ms, o_orderpriority, o_orderstatus FROM orders),
oc AS (SELECT o.*, start_ms AS config_ms FROM o ASOF JOIN st ON ms > start_ms),
wt AS (SELECT d.start_ms, d.key, d.weight AS dflt FROM cfg d WHERE subkey IS NULL),
lw AS (SELECT contribution, l_linenumber AS ord, coalesce(x.weight, dflt) AS weight, x.weight IS NOT NULL AS explicit FROM oc JOIN lineitem ON l_orderkey = contribution JOIN wt ON wt.start_ms = config_ms AND wt.key = 'flag' LEFT JOIN cfg x ON x.start_ms = config_ms AND x.key = 'flag' AND x.subkey = l_returnflag),
pw AS (SELECT contribution, coalesce(x.weight, dflt) AS weight FROM oc JOIN wt ON wt.start_ms = config_ms AND wt.key = 'priority' LEFT JOIN cfg x ON x.start_ms = config_ms AND x.key = 'priority' AND x.subkey = o_orderpriority),
sw AS (SELECT contribution, coalesce(x.weight, dflt) AS weight FROM oc JOIN wt ON wt.start_ms = config_ms AND wt.key = 'status' LEFT JOIN cfg x ON x.start_ms = config_ms AND x.key = 'status' AND x.subkey = o_orderstatus),
mx AS (SELECT contribution, coalesce(max(weight) FILTER (WHERE explicit), min_by(weight, ord)) AS m, avg(weight) AS a, coalesce(min_by(weight, ord) FILTER (WHERE explicit), min_by(weight, ord)) AS f FROM lw GROUP BY 1),
sc AS (SELECT contribution, pw.weight + coalesce(m, 0) + sw.weight * coalesce(a, 0) + coalesce(f, 0) AS score FROM pw JOIN sw USING (contribution) LEFT JOIN mx USING (contribution))"""


def _trees(spark, sf):
    """Orders as ADD(priority, MAX(flags), MULTIPLY(status, AVERAGE(flags)), FIRST(flags))."""
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("contribution"), millis(F.col("o_orderdate")).alias("timestamp_ms"), "o_orderpriority", "o_orderstatus")
    configs = spark.createDataFrame(CONFIGS, "start_ms long, key string, subkey string, weight double")
    own = expressions.in_force(orders, configs)
    nodes = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(op).alias("operator")) for p, op in (("0", "ADD"), ("0.1", "MAX"), ("0.2", "MULTIPLY"), ("0.2.1", "AVERAGE"), ("0.3", "FIRST"))))
    trees = own.select("contribution", F.inline(nodes))
    leaf = lambda path, key, subkey, order: F.struct(F.lit(path).alias("path"), order.alias("ord"), F.lit(key).alias("key"), subkey.alias("subkey"))
    single = own.select("contribution", "config_ms", F.inline(F.array(leaf("0", "priority", F.col("o_orderpriority"), F.lit(0)), leaf("0.2", "status", F.col("o_orderstatus"), F.lit(0)))))
    lines = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contribution"), F.col("l_linenumber").alias("n"), "l_returnflag")
    many = own.join(lines, "contribution").select("contribution", "config_ms", F.inline(F.array(*(leaf(p, "flag", F.col("l_returnflag"), F.col("n")) for p in ("0.1", "0.2.1", "0.3")))))
    return expressions.score_trees(trees, expressions.weigh(single.unionByName(many), configs), 3)


@query(f"WITH {_TREES} SELECT contribution, round(score, 9) AS score FROM sc")
def expression_scores(spark, sf):
    return _trees(spark, sf).where("path = '0'").select("contribution", F.round("score", 9).alias("score"))


def _shares(spark, sf):
    return tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contribution"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("participant"), F.col("l_quantity").alias("weight"))


_SHARED = f"""WITH {_TREES}, n AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, {{0}} AS w FROM lineitem)
SELECT contribution, l_suppkey AS participant, l_linenumber AS ord, round(score * l_quantity / w, 6) AS score FROM n JOIN sc ON contribution = l_orderkey"""


@query(_SHARED.format("sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)"))
def expression_shares_running(spark, sf):
    found = expressions.share_out(_trees(spark, sf).where("path = '0'").select("contribution", "score"), _shares(spark, sf))
    return found.withColumn("score", F.round("score", 6))


@query(_SHARED.format("sum(l_quantity) OVER (PARTITION BY l_orderkey)"))
def expression_shares_whole(spark, sf):
    found = expressions.share_out(_trees(spark, sf).where("path = '0'").select("contribution", "score"), _shares(spark, sf), cumulative=False)
    return found.withColumn("score", F.round("score", 6))


_EV = "ev AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) // 1000 AS ms, event_type, value, event_id FROM events)"
_WK = f"wk AS (SELECT unnest(range(a, b + 1, {WEEK})) AS s FROM (SELECT min({WEEK_SQL.format('ms')}) AS a, max({WEEK_SQL.format('ms')}) AS b FROM ev))"
_VIEW = f"""{_EV}, {_WK}, vw AS (SELECT id, {WEEK_SQL.format('ms')} AS start_ms, {WEEK_SQL.format('ms')} + {WEEK} AS end_ms, sum(value) AS score,
  sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS cents FROM ev GROUP BY 1, 2, 3)"""
UNTIL = 1_706_400_000_000


def _view(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), millis(F.col("ts")).alias("ts_ms"), "event_type", "value")
    from meritgraph.functions.weeks import week_intervals

    cents = F.round(F.col("value") * 100).cast("long")
    receipts = e.where("event_type = 'purchase'").select("id", "ts_ms", (cents.cast(AMOUNT) * F.lit(Decimal(10**16)).cast("decimal(17,0)")).cast(AMOUNT).alias("amount"))
    return views.view(e.select("id", "ts_ms", F.col("value").alias("score")), receipts, week_intervals(e, "ts_ms"))


def _cents():
    return (F.col("earned") / F.lit(Decimal(10**16))).cast("long")



@query(f"WITH {_VIEW} SELECT id, start_ms, end_ms, round(score, 6) AS score, cents::BIGINT AS cents FROM vw")
def view_participant_weeks(spark, sf):
    return _view(spark, sf).select("id", "start_ms", "end_ms", F.round("score", 6).alias("score"), _cents().alias("cents"))


@query(f"WITH {_VIEW} SELECT id, round(2 * sum(score), 6) AS score, (2 * sum(cents))::BIGINT AS cents FROM vw WHERE start_ms >= 1704500000000 AND end_ms <= {UNTIL} GROUP BY id")
def view_merged_in_scope(spark, sf):
    v = _view(spark, sf)
    found = views.totals(views.scope(views.merged([v, v]), 1_704_500_000_000, UNTIL))
    return found.select("id", F.round("score", 6).alias("score"), _cents().alias("cents"))


@query(f"WITH {_VIEW} SELECT id, round(sum(score), 4) AS score, round(100 * sum(score) / (SELECT sum(score) FROM vw), 6) AS percent FROM vw GROUP BY id ORDER BY sum(score) DESC, id LIMIT 20")
def view_top(spark, sf):
    return views.top(_view(spark, sf)).select("id", F.round("score", 4).alias("score"), F.round("percent", 6).alias("percent"))


@query("WITH x AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE regexp_matches(c_name, '(?i)c.*m.*0.*7') ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10) SELECT * FROM x")
def view_page(spark, sf):
    rows = tables.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return views.page(rows.where(views.ordered_letters("c_name", "cm07")), [F.desc("c_acctbal"), "c_custkey"], 1, 10)


@query(f"WITH {_VIEW} SELECT start_ms, end_ms, round(sum(score), 6) AS score, sum(cents)::BIGINT AS cents FROM vw GROUP BY 1, 2")
def view_interval_totals(spark, sf):
    return views.interval_totals(_view(spark, sf)).select("start_ms", "end_ms", F.round("score", 6).alias("score"), _cents().alias("cents"))


@query(f"""WITH {_VIEW}, t AS (SELECT start_ms, end_ms, sum(score) AS s FROM vw GROUP BY 1, 2), b AS (SELECT 'lib-a' AS id, start_ms, end_ms, s * 0.1 AS score FROM t WHERE start_ms >= 1704600000000 UNION ALL SELECT '3', start_ms, end_ms, s * CASE WHEN start_ms >= 1705200000000 THEN 0.25 ELSE 0.5 END FROM t)
SELECT id, round(sum(score), 6) AS score FROM (SELECT id, score FROM vw UNION ALL SELECT id, score FROM b) GROUP BY 1""")
def view_with_dependencies(spark, sf):
    policies = spark.createDataFrame([("lib-a", 1_704_600_000_000, 0.1), ("3", 0, 0.5), ("3", 1_705_200_000_000, 0.25)], "recipient string, period_ms long, share double")
    return views.totals(views.with_dependencies(_view(spark, sf), policies)).select("id", F.round("score", 6).alias("score"))


_DONE = f"dn AS (SELECT * FROM vw WHERE end_ms <= {UNTIL})"


@query(f"WITH {_VIEW}, {_DONE} SELECT id, round(sum(score), 6) AS score FROM dn WHERE end_ms IN (SELECT DISTINCT end_ms FROM dn ORDER BY end_ms DESC LIMIT 2) GROUP BY id")
def policy_immediate(spark, sf):
    return payouts.immediate(_view(spark, sf), UNTIL, 2).withColumn("score", F.round("score", 6))


@query(f"WITH {_VIEW}, {_DONE} SELECT id, round(sum(score * pow(0.7, ((SELECT max(end_ms) FROM dn) - end_ms) // {WEEK})), 6) AS score FROM dn WHERE id NOT IN ('1', '2') GROUP BY id")
def policy_recent(spark, sf):
    return payouts.recent(_view(spark, sf), UNTIL, 0.3, ["1", "2"]).withColumn("score", F.round("score", 6))


_BUDGET = 1_000 * 10**18


@query(f"""WITH {_VIEW}, {_DONE}, u AS (SELECT id, sum(score) AS own, sum(cents)::HUGEINT * 10000000000000000::HUGEINT AS earned FROM dn GROUP BY id),
r AS (SELECT floor((sum(earned) + {_BUDGET}::HUGEINT)::DOUBLE * (1 / sum(own))) AS rate FROM u) SELECT id, round(greatest(0.0, floor(rate * own) - earned::DOUBLE) / 1e18, 4) AS score FROM u, r""")
def policy_balanced(spark, sf):
    return payouts.balanced(_view(spark, sf), UNTIL, _BUDGET).select("id", F.round(F.col("score") / 1e18, 4).alias("score"))


@query()
def payout_split(spark, sf):
    """A budget shared out by the immediate policy, exact to the last unit."""
    return payouts.allocate("immediate", _BUDGET, payouts.immediate(_view(spark, sf), UNTIL, 2))


@query()
def payout_lines(spark, sf):
    amounts = payouts.allocate("recent", _BUDGET, payouts.recent(_view(spark, sf), UNTIL, 0.1))
    known = amounts.select("id", F.concat(F.lit("0x"), F.lpad(F.hex(F.col("id").cast("long") % 40), 4, "0")).alias("address")).where(F.col("id").cast("long") % 5 != 0)
    return exports.payout_lines(payouts.payable(amounts, known), "0xt")


_SPLIT_BUDGET = 123_456 * 10**18 + 7
_PARTS = "t AS (SELECT a, id, c, sum(c) OVER (PARTITION BY a ORDER BY id ROWS UNBOUNDED PRECEDING)::DOUBLE AS s, sum(c) OVER (PARTITION BY a)::DOUBLE AS w FROM u)"
_PART = f"CASE WHEN {{0}} >= w THEN {_SPLIT_BUDGET}::HUGEINT ELSE least(floor({_SPLIT_BUDGET}::HUGEINT::DOUBLE * (({{0}}) / w))::HUGEINT, {_SPLIT_BUDGET}::HUGEINT) END"


@query(f"""WITH u AS (SELECT o_orderpriority AS a, o_custkey::VARCHAR AS id, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS c FROM orders GROUP BY 1, 2), {_PARTS}
SELECT a AS allocation, id, (({_PART.format("s")}) - ({_PART.format("(s - c)")}))::VARCHAR AS amount FROM t""")
def payout_exact(spark, sf):
    """Five budgets by scores in whole cents, whose sums are exact in any order."""
    o = tables.table(spark, sf, "orders")
    scored = o.groupBy(F.col("o_orderpriority").alias("allocation"), F.col("o_custkey").alias("id")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("score"))
    found = payouts.split(scored.withColumn("budget", F.lit(Decimal(_SPLIT_BUDGET)).cast(AMOUNT)))
    return found.withColumn("amount", F.col("amount").cast("string"))


@query(f"""WITH {_VIEW}, {_DONE}, x AS (SELECT 'IMMEDIATE' AS kind, count(DISTINCT id) AS n FROM dn WHERE end_ms IN (SELECT DISTINCT end_ms FROM dn ORDER BY end_ms DESC LIMIT 2) UNION ALL SELECT 'BALANCED', count(DISTINCT id) FROM dn)
SELECT i.idx || '-' || i.kind AS allocation, x.n AS n_ids, i.budget AS amount FROM (VALUES (0, 'IMMEDIATE', '1000000000000000000001'), (1, 'BALANCED', '2000000000000000000003')) i(idx, kind, budget) JOIN x USING (kind)""")
def payout_distribution(spark, sf):
    """Two policies at a time: each allocation has all its participants and its whole budget."""
    found = payouts.distribution([payouts.Policy("IMMEDIATE", 10**21 + 1, weeks=2), payouts.Policy("BALANCED", 2 * 10**21 + 3)], _view(spark, sf), UNTIL)
    return found.groupBy("allocation").agg(F.count_distinct("id").alias("n_ids"), F.sum("amount").cast(AMOUNT).cast("string").alias("amount"))


@query(f"""WITH {_VIEW}, n AS (SELECT DISTINCT end_ms FROM vw WHERE end_ms <= {UNTIL} AND end_ms > 1704600000000 ORDER BY end_ms DESC LIMIT 2)
SELECT end_ms AS ts_ms, '1000000000000000000000' AS amount FROM n""")
def payout_due(spark, sf):
    """Distributions of the intervals that are due: a balanced budget each, the second knowing what the first paid."""
    v = _view(spark, sf)
    ends = payouts.due(v.select("end_ms").distinct(), 1_704_600_000_000, UNTIL, 2)
    found = payouts.apply_distributions([payouts.Policy("BALANCED", _BUDGET)], v, ends)
    return found.groupBy("ts_ms").agg(F.sum("amount").cast(AMOUNT).cast("string").alias("amount"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,}', abs(cast(round(c_acctbal * 100) AS BIGINT)) // 100) || '.' || lpad((abs(cast(round(c_acctbal * 100) AS BIGINT)) % 100)::VARCHAR, 2, '0') || 'u' AS text FROM customer""")
def money_grouped(spark, sf):
    units = (F.round(F.col("c_acctbal") * 100).cast("long").cast("decimal(20,0)") * F.lit(Decimal(10**16)).cast("decimal(17,0)")).cast(AMOUNT)
    return tables.table(spark, sf, "customer").select("c_custkey", grouped(units, 2, "u").alias("text"))


def _ledger(spark, sf):
    """Suppliers create accounts, every third merges into the one before (every ninth of those chains twice), orders
    distribute and transfer."""
    s = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    kinds = "seq long, type string, id string, other string, name string, address string, amount decimal(38,0)"
    none = lambda t: F.lit(None).cast(t)

    def rows(df, base, kind, i, other=None, name=None, addr=None, amount=None):
        return df.select((F.lit(base) + F.col("k")).cast("long").alias("seq"), F.lit(kind).alias("type"), i.cast("string").alias("id"), (other.cast("string") if other is not None else none("string")).alias("other"), (name if name is not None else none("string")).alias("name"), (addr if addr is not None else none("string")).alias("address"), (amount if amount is not None else none("decimal(38,0)")).cast(AMOUNT).alias("amount"))

    k, big = F.col("k"), 10_000_000
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % s.count() + 1).alias("u"), (F.col("o_orderkey") % s.count() + 1).alias("v"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    units = (F.col("cents").cast("decimal(20,0)") * F.lit(Decimal(10**16)).cast("decimal(17,0)")).cast(AMOUNT)
    parts = [
        rows(s, 0, "CREATE", k, name=F.col("s_name")), rows(s.where("k % 2 = 0"), big, "TOGGLE", k), rows(s.where("k % 4 = 0"), 2 * big, "TOGGLE", k), rows(s.where("k % 5 = 0"), 3 * big, "RENAME", k, name=F.concat(F.lit("new-"), "s_name")),
        rows(s, 4 * big, "ALIAS", k, addr=address("alias", k)), rows(s.where("k % 2 = 1"), 5 * big, "PAYOUT_ADDRESS", k, addr=F.concat(F.lit("0x"), k.cast("string"))), rows(o, 6 * big, "DISTRIBUTE", F.col("u"), amount=units), rows(o.where("k % 7 = 0"), 7 * big, "TRANSFER", F.col("u"), other=F.col("v"), amount=F.lit(Decimal(10**18)).cast(AMOUNT)),
        rows(s.where("k % 3 = 0"), 8 * big, "MERGE", k - 1, other=k), rows(s.where("k % 9 = 2 AND k > 1"), 9 * big, "MERGE", k - 1, other=k),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    assert [f.split()[0] for f in kinds.split(", ")] == out.columns
    return out.withColumn("ts_ms", F.col("seq"))


_LEDGER = """n AS (SELECT count(*) AS n FROM supplier), root AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey - 1 - ((s_suppkey - 1) % 9 = 2)::INT WHEN s_suppkey % 9 = 2 THEN s_suppkey - 1 ELSE s_suppkey END AS r FROM supplier),
o AS (SELECT o_orderkey AS k, o_custkey % n + 1 AS u, o_orderkey % n + 1 AS v, CAST(round(o_totalprice * 100) AS BIGINT)::HUGEINT AS cents FROM orders, n),
mv AS (SELECT u AS k, cents AS paid, cents AS bal FROM o UNION ALL SELECT u, 0, -100 FROM o WHERE k % 7 = 0 UNION ALL SELECT v, 0, 100 FROM o WHERE k % 7 = 0)"""


@query(f"""WITH {_LEDGER}, m AS (SELECT r, sum(paid)::BIGINT AS paid, sum(bal)::BIGINT AS bal FROM mv JOIN root USING (k) GROUP BY r), a AS (SELECT r, (count(*) + count(*) FILTER (WHERE k <> r))::BIGINT AS n FROM root GROUP BY r),
ad AS (SELECT r, '0x' || max(k) AS address FROM root WHERE k % 2 = 1 GROUP BY r)
SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'new-' || s_name ELSE s_name END AS name, s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 AS active, coalesce(m.paid, 0)::BIGINT AS paid_cents, coalesce(m.bal, 0)::BIGINT AS balance_cents, a.n AS n_aliases, ad.address
FROM supplier JOIN root ON root.k = s_suppkey AND root.r = s_suppkey LEFT JOIN m ON m.r = s_suppkey LEFT JOIN a ON a.r = s_suppkey LEFT JOIN ad ON ad.r = s_suppkey""")
def ledger_accounts(spark, sf):
    found = ledger.accounts(_ledger(spark, sf))
    cents = lambda c: (F.col(c) / F.lit(Decimal(10**16))).cast("long")
    return found.select("id", "name", "active", cents("paid").alias("paid_cents"), cents("balance").alias("balance_cents"), "n_aliases", "address")


@query(f"WITH {_LEDGER} SELECT k::VARCHAR AS id, r::VARCHAR AS target FROM root WHERE k <> r")
def ledger_survivors(spark, sf):
    return ledger.survivors(_ledger(spark, sf))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), o AS (SELECT o_orderkey AS k, (o_custkey % n + 1)::VARCHAR AS u, (o_orderkey % n + 1)::VARCHAR AS v, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders, n),
mv AS (SELECT 60000000 + k AS seq, u AS id, c AS x FROM o UNION ALL SELECT 70000000 + k, u, -1000000000 FROM o WHERE k % 7 = 0 UNION ALL SELECT 70000000 + k, v, 1000000000 FROM o WHERE k % 7 = 0),
h AS (SELECT *, sum(x) OVER (PARTITION BY id ORDER BY seq, x ROWS UNBOUNDED PRECEDING) AS held FROM mv) SELECT id, seq FROM h WHERE held < 0 AND x < 0""")
def ledger_overdrawn(spark, sf):
    """Transfers ten million times as large as the ledger's own, so that some accounts can't pay."""
    e = _ledger(spark, sf)
    big = F.when(F.col("type") == "TRANSFER", (F.col("amount") * F.lit(Decimal(10_000_000))).cast(AMOUNT)).otherwise(F.col("amount"))
    return ledger.overdrawn(e.withColumn("amount", big))


def _switches(spark, sf):
    """Orders as switches of the ledger, by the rest of their key."""
    o = tables.table(spark, sf, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("ACCOUNTING_ON", "ACCOUNTING_OFF", "INTEGRATION_ON", "INTEGRATION_OFF", "CURRENCY", "CURRENCY", "CREATE"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("seq"), kind.alias("type"), F.when(F.col("o_orderkey") % 7 == 4, F.concat(F.lit("1/0x"), F.col("o_custkey").cast("string"))).alias("address"))


@query("""SELECT coalesce(max_by(o_orderkey % 7 = 0, CASE WHEN o_orderkey % 7 < 2 THEN o_orderkey END), true) AS accounting, coalesce(max_by(o_orderkey % 7 = 2, CASE WHEN o_orderkey % 7 IN (2, 3) THEN o_orderkey END), false) AS integration,
(SELECT CASE WHEN o_orderkey % 7 = 4 THEN '1/0x' || o_custkey END FROM orders WHERE o_orderkey % 7 IN (4, 5) ORDER BY o_orderkey DESC LIMIT 1) AS currency FROM orders""")
def ledger_settings(spark, sf):
    return ledger_state.settings(_switches(spark, sf))


#: Accounting is off from the first to the second of these sequence numbers.
_OFF, _ON = 65_000_000, 70_050_000


@query(f"""WITH {_LEDGER}, x AS (SELECT u AS k, 60000000 + k AS s, cents AS paid, cents AS bal FROM o UNION ALL SELECT u, 69999999 + k, cents, cents FROM o WHERE k % 5 = 0 UNION ALL SELECT u, 70000000 + k, 0, -100 FROM o WHERE k % 7 = 0 UNION ALL SELECT v, 70000000 + k, 0, 100 FROM o WHERE k % 7 = 0),
m AS (SELECT r, sum(paid)::BIGINT AS paid, sum(CASE WHEN s > {_ON} THEN bal ELSE 0 END)::BIGINT AS bal FROM x JOIN root USING (k) GROUP BY r)
SELECT s_suppkey::VARCHAR AS id, coalesce(m.bal, 0)::BIGINT AS balance_cents, coalesce(m.paid, 0)::BIGINT AS paid_cents, s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 AND s_suppkey % 3 = 0 AS active
FROM supplier JOIN root ON root.k = s_suppkey AND root.r = s_suppkey LEFT JOIN m ON m.r = s_suppkey""")
def ledger_balances(spark, sf):
    """Accounting is off for a while: balances start anew from zero, distributions of that while add to what was paid
    only, and every third account is toggled then."""
    e = _ledger(spark, sf)
    none = lambda *known: [F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns if c not in known]
    flips = e.limit(1).select(F.inline(F.array(*(F.struct(F.lit(s).cast("long").alias("seq"), F.lit(t).alias("type")) for s, t in ((_OFF, "ACCOUNTING_OFF"), (_ON, "ACCOUNTING_ON"))))))
    flips = flips.select("seq", "type", *none("seq", "type")).select(*e.columns)
    later = e.where("type = 'DISTRIBUTE' AND (seq - 60000000) % 5 = 0").withColumn("seq", F.col("seq") + 9_999_999)
    toggles = e.where("type = 'CREATE' AND CAST(id AS LONG) % 3 = 0").select((F.col("seq") + _OFF).alias("seq"), F.lit("TOGGLE").alias("type"), "id", *none("seq", "type", "id")).select(*e.columns)
    found = ledger_state.balances(e.union(flips).union(later).union(toggles))
    cents = lambda c: (F.col(c) / F.lit(Decimal(10**16))).cast("long")
    return found.select("id", cents("balance").alias("balance_cents"), cents("paid").alias("paid_cents"), "active")


@query(f"""WITH {_LEDGER} SELECT coalesce(r, u)::VARCHAR AS id, count(*) AS n, sum(cents)::BIGINT AS cents, min_by(cents, o.k)::BIGINT AS first_cents FROM o LEFT JOIN root ON root.k = u GROUP BY 1""")
def ledger_history(spark, sf):
    h = ledger_state.history(_ledger(spark, sf))
    cents = lambda x: (x / F.lit(Decimal(10**16))).cast("long")
    total = F.aggregate("receipts", F.lit(0).cast("long"), lambda a, r: a + cents(r["amount"]))
    return h.select("id", F.size("receipts").cast("long").alias("n"), total.alias("cents"), cents(F.get("receipts", F.lit(0))["amount"]).alias("first_cents"))


@query(f"""WITH {_LEDGER}, c AS (SELECT s_suppkey AS k FROM supplier), a AS (SELECT 'alias/' || s_suppkey || '/' AS address, s_suppkey AS k FROM supplier), s AS (SELECT 'alias/' || (o_custkey % 200) || '/' AS address, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1)
SELECT s.address, s.cents FROM s ANTI JOIN a USING (address)""")
def ledger_unclaimed(spark, sf):
    """Scored addresses that belong to no account."""
    suppliers = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), address("alias", F.col("s_suppkey")).alias("address"))
    o = tables.table(spark, sf, "orders").groupBy(address("alias", F.col("o_custkey") % 200).alias("address")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("score"))
    own = suppliers.join(o.select("address"), "address", "left_semi")
    return ledger_state.accounts_with_scores(own, suppliers.limit(0), o)[1].select("address", F.col("score").alias("cents")).join(suppliers.select("address"), "address", "left_anti")


@query("SELECT o_orderkey AS uuid FROM orders WHERE o_orderkey % 10 = 3")
def ledger_new_events(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("uuid"))
    return ledger.new_events(o, o.where("uuid % 10 <> 3"))


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations), l AS (SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN 0.1 WHEN 2 THEN 1.0 WHEN 3 THEN 1.25 WHEN 4 THEN 1.5 ELSE 0.0 END::DOUBLE * CASE WHEN role = 'user' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM t)
SELECT conv_id, count(*) FILTER (WHERE w <> 0) AS n_likes, round(coalesce(sum(w), 0), 6) AS weight FROM l GROUP BY conv_id""")
def builder_like_weights(spark, sf):
    likes = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("post"), (F.col("turn") % 5).cast("int").alias("trust"), F.when(F.col("role") == "user", 2.0).otherwise(1.0).alias("category"))
    found = builders.liked_posts(builders.like_weights(likes, ["category"]))
    return found.select(F.col("post").alias("conv_id"), "n_likes", F.round("weight", 6).alias("weight"))


@query(f"""WITH e AS (SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k, event_type FROM events), r AS (SELECT k % 50 AS message, user_id AS reacter, k AS author, event_type AS emoji FROM e),
m AS (SELECT message, min(author) AS author FROM r GROUP BY 1), x AS (SELECT r.message, r.reacter, r.emoji, m.author FROM r JOIN m USING (message)),
u AS (SELECT message, count(*) AS d FROM (SELECT DISTINCT message, reacter FROM x WHERE reacter <> author) GROUP BY 1)
SELECT message, reacter, emoji, round(CASE WHEN reacter = author THEN 0 ELSE CASE WHEN emoji = 'click' THEN 2.0 WHEN emoji = 'error' THEN 0.0 ELSE 1.0 END / (coalesce(d, 0) + 1.0) END, 9) AS weight FROM x LEFT JOIN u USING (message)""")
def builder_reaction_weights(spark, sf):
    e = tables.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    r = e.select((k % 50).alias("message"), F.col("user_id").alias("reacter"), k.alias("author"), F.col("event_type").alias("emoji"))
    r = r.drop("author").join(r.groupBy("message").agg(F.min("author").alias("author")), "message")
    emoji = spark.createDataFrame([("click", 2.0), ("error", 0.0)], "emoji string, weight double")
    return builders.reaction_weights(r, emoji, 1.0, dampener=1.0).select("message", "reacter", "emoji", F.round("weight", 9).alias("weight"))


@query("""SELECT event_type || '-' || user_id AS name, regexp_replace(event_type || ' ' || user_id || '!', '[^A-Za-z0-9-]', '-', 'g') AS coerced, count(*) AS n FROM events GROUP BY 1, 2""")
def builder_names(spark, sf):
    e = tables.table(spark, sf, "events")
    text = F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit("!"))
    return e.select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("name"), builders.coerced_name(text).alias("coerced")).groupBy("name", "coerced").agg(F.count(F.lit(1)).alias("n"))




#: Weights of the event types in trees read from JSON, and that of the other operand.
_KINDS, _BASE = {"click": 0.5, "purchase": 3.0, "error": 0.0, "signup": 2.0, "view": 1.0}, 1.5
_DEPTH = 4


def _contribution_lines(spark, sf):
    """Events as contributions in JSON: MULTIPLY(base, subtree, leaf), as deep as the event's id says, above ADD(kind)."""
    # parsing is heavy beside the rows that it is made of, and a small file is one split
    e = tables.table(spark, sf, "events").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    quote = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    leaf = F.concat(F.lit('{"operator":"ADD","description":"leaf","weightOperands":[{"key":"kind","subkey":'), quote(F.col("event_type")), F.lit('}],"expressionOperands":[]}'))
    tree = leaf
    for d in range(1, _DEPTH + 1):
        above = F.concat(F.lit('{"operator":"MULTIPLY","description":"up","weightOperands":[{"key":"base"}],"expressionOperands":['), tree, F.lit(","), leaf, F.lit("]}"))
        tree = F.when(F.col("event_id") % (_DEPTH + 1) >= d, above).otherwise(tree)
    share = F.concat(F.lit('{"id":"user/'), F.col("user_id").cast("string"), F.lit('","shares":[{"key":"kind","subkey":'), quote(F.col("event_type")), F.lit('},{"key":"base"}]}'))
    line = F.concat(F.lit('{"id":'), quote(F.col("event_id")), F.lit(',"plugin":"events","type":'), quote(F.col("event_type")), F.lit(',"timestampMs":'), millis(F.col("ts")).cast("string"), F.lit(',"expression":'), tree, F.lit(',"participants":['), share, F.lit("]}"))
    return e.select(F.col("event_id").cast("long").alias("seq"), line.alias("value"))


_PATHS = f"""d AS (SELECT event_id, event_type, user_id, event_id % {_DEPTH + 1} AS depth FROM events),
p AS (SELECT event_id::VARCHAR AS contribution, '0' || repeat('.0', l::INT) AS path, CASE WHEN l = depth THEN 'ADD' ELSE 'MULTIPLY' END AS operator, event_type, user_id FROM d, range({_DEPTH + 1}) r(l) WHERE l <= depth
 UNION ALL SELECT event_id::VARCHAR, '0' || repeat('.0', l::INT) || '.1', 'ADD', event_type, user_id FROM d, range({_DEPTH}) r(l) WHERE l < depth)"""


@query(f"""WITH {_PATHS} SELECT contribution, path, operator, CASE WHEN operator = 'ADD' THEN 'kind' ELSE 'base' END AS key, CASE WHEN operator = 'ADD' THEN event_type END AS subkey, 'user/' || user_id AS participant, 2::BIGINT AS n_shares FROM p""")
def contribution_trees(spark, sf):
    """Trees of mixed depth, read from JSON text: every expression with its weight and the contribution's participant."""
    c = contributions.opened(_contribution_lines(spark, sf))
    people = c.shares.groupBy("contribution", "participant").agg(F.count(F.lit(1)).alias("n_shares"))
    met = c.expressions.join(c.operands, ["contribution", "path"]).join(people, "contribution")
    return met.select("contribution", "path", "operator", "key", "subkey", "participant", "n_shares")


@query(f"""WITH w AS (SELECT event_id, event_id % {_DEPTH + 1} AS depth, {"".join(f"CASE WHEN event_type = '{k}' THEN {w} ELSE " for k, w in _KINDS.items())}1.0{" END" * len(_KINDS)} AS w FROM events)
SELECT event_id::VARCHAR AS contribution, round(w * pow({_BASE} * w, depth), 6) AS score FROM w""")
def contribution_tree_scores(spark, sf):
    """The score of each tree read from JSON text."""
    c = contributions.opened(_contribution_lines(spark, sf))
    rows = [(0, "base", None, _BASE), (0, "kind", None, 1.0)] + [(0, "kind", k, w) for k, w in _KINDS.items()]
    configs = spark.createDataFrame(rows, "start_ms long, key string, subkey string, weight double")
    weighed = expressions.weigh(c.operands.withColumn("config_ms", F.lit(0).cast("long")), configs)
    found = expressions.score_trees(c.expressions, weighed, _DEPTH + 1).where("path = '0'")
    return found.select("contribution", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT s_suppkey AS k, s_name FROM supplier), o AS (SELECT o_orderkey AS k, o_custkey % n + 1 AS u, o_orderkey % n + 1 AS v, CAST(round(o_totalprice * 100) AS BIGINT)::VARCHAR AS a FROM orders, n),
e AS (SELECT k AS seq, 'CREATE' AS type, k::VARCHAR AS id, NULL AS other, s_name AS name, 'n/' || k AS address, NULL AS amount, NULL AS memo, 0 AS part FROM s
UNION ALL SELECT k, 'TYPE', k::VARCHAR, NULL, CASE WHEN k % 2 = 0 THEN 'BOT' ELSE 'USER' END, NULL, NULL, NULL, 1 FROM s UNION ALL SELECT k, 'ALIAS', k::VARCHAR, NULL, NULL, 'a/' || k, NULL, 'own', 2 FROM s
UNION ALL SELECT 10000000 + k, 'TRANSFER', u::VARCHAR, v::VARCHAR, NULL, NULL, a, CASE WHEN k % 3 = 0 THEN 'memo "' || k || '"' END, 0 FROM o WHERE k % 4 = 0
UNION ALL SELECT 10000000 + k, 'DISTRIBUTE', u::VARCHAR, NULL, 'd' || k, 'x', a, NULL, 0 FROM o WHERE k % 4 <> 0 UNION ALL SELECT 10000000 + k, 'DISTRIBUTE', v::VARCHAR, NULL, 'd' || k, 'y', a, NULL, 1 FROM o WHERE k % 4 <> 0)
SELECT seq, type, id, other, name, address, amount, memo, part::INTEGER AS part FROM e""")
def ledger_log_events(spark, sf):
    """A log's lines, made as JSON text of suppliers and orders, as events, with all that a line has beside the main."""
    s = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    n, of = s.count(), lambda c: F.col(c).cast("string")
    alias = F.struct(F.concat(F.lit("a/"), of("k")).alias("address"), F.lit("own").alias("description"))
    identity = F.struct(of("k").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("n/"), of("k")).alias("address"), F.when(F.col("k") % 2 == 0, "BOT").otherwise("USER").alias("subtype"), F.array(alias).alias("aliases"))
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % n + 1).alias("u"), (F.col("o_orderkey") % n + 1).alias("v"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("a"))
    transfer = F.struct(F.lit("TRANSFER_GRAIN").alias("type"), of("u").alias("from"), of("v").alias("to"), F.col("a").alias("amount"), F.when(F.col("k") % 3 == 0, F.concat(F.lit('memo "'), of("k"), F.lit('"'))).alias("memo"))
    allocation = lambda i, who: F.struct(F.lit(i).alias("id"), F.struct(F.lit("EVEN").alias("policyType")).alias("policy"), F.array(F.struct(of(who).alias("id"), F.col("a").alias("amount"))).alias("receipts"))
    grant = F.struct(F.lit("DISTRIBUTE_GRAIN").alias("type"), F.struct(F.concat(F.lit("d"), of("k")).alias("id"), F.col("k").alias("credTimestamp"), F.array(allocation("x", "u"), allocation("y", "v")).alias("allocations")).alias("distribution"))
    line = lambda df, base, action: df.select((F.lit(base) + F.col("k")).cast("long").alias("seq"), F.to_json(F.struct(action.alias("action"), F.col("k").alias("ledgerTimestamp"), F.concat(F.lit("u"), of("k")).alias("uuid"), F.lit("1").alias("version"))).alias("value"))
    lines = line(s, 0, F.struct(F.lit("CREATE_IDENTITY").alias("type"), identity.alias("identity"))).union(line(o.where("k % 4 = 0"), 10_000_000, transfer)).union(line(o.where("k % 4 <> 0"), 10_000_000, grant))
    return ledger_log.parsed(lines).select("seq", "type", "id", "other", "name", "address", F.col("amount").cast("string").alias("amount"), "memo", "part")


_PROPOSED = """p AS (SELECT o_orderkey AS ord, 'u' || (o_orderkey // 200) AS name, lower(left(o_orderpriority, 1)) || '-x' AS plugin, o_orderkey // 200 AS g FROM orders),
b AS (SELECT *, g % 7 <> 0 AND row_number() OVER (PARTITION BY name ORDER BY ord) = 1 AS first FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY name, plugin, first ORDER BY ord) AS k FROM b)"""


@query(f"""WITH {_PROPOSED} SELECT ord, 'a/' || ord AS address, CASE WHEN first THEN name WHEN k = 1 THEN name || '-' || plugin ELSE name || '-' || plugin || '-' || (k - 1) END AS name FROM r""")
def ledger_new_names(spark, sf):
    """Orders as proposals of new identities, up to 200 of one name from five plugins; every seventh name is taken."""
    g = F.floor(F.col("o_orderkey") / 200)
    o = tables.table(spark, sf, "orders").withColumn("name", F.concat(F.lit("u"), g.cast("string")))
    proposals = o.select(F.col("o_orderkey").alias("ord"), "name", F.concat(F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("-x")).alias("plugin"), F.concat(F.lit("a/"), F.col("o_orderkey").cast("string")).alias("address"))
    return names.new_names(proposals, o.where(g % 7 == 0).select(F.upper("name").alias("name")))

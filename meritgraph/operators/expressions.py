"""Contribution scoring by arithmetic expression trees.

Spark has no recursive types, so a tree is rows: expressions (contribution, path, operator), where a path is ``0``,
``0.1``, ``0.1.0`` and so on from the root, and operands (contribution, path, ord, key, subkey), the weights under an
expression. Trees are scored level by level from the deepest, each level one aggregation.

Weights come from configurations in force at the contribution's time: (start_ms, key, subkey or null for the key's
default, weight); a contribution gets the last configuration that starts before it, and is dropped where none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.operators.frames import checkpointed

OPERATORS = ("ADD", "MULTIPLY", "MAX", "FIRST", "AVERAGE")


def in_force(contributions: DataFrame, configs: DataFrame, ts: str = "timestamp_ms") -> DataFrame:
    """``contributions`` with ``config_ms``: the start of the last configuration strictly before; others are dropped."""
    starts = configs.select("start_ms").distinct().agg(F.sort_array(F.collect_set("start_ms")).alias("_s"))  # configurations are few
    begun = F.filter("_s", lambda s: s < F.col(ts))
    return contributions.join(F.broadcast(starts), F.lit(True)).where(F.size(begun) > 0).withColumn("config_ms", F.element_at(begun, -1)).drop("_s")


def weigh(operands: DataFrame, configs: DataFrame) -> DataFrame:
    """``operands`` (config_ms, key, subkey, ...) with weight and explicit: the subkey's own, else the key's default.
    A key that the configuration doesn't have is an error when rows are read."""
    own = configs.where("subkey IS NOT NULL").select(F.col("start_ms").alias("config_ms"), "key", "subkey", F.col("weight").alias("_own"))
    rest = configs.where("subkey IS NULL").select(F.col("start_ms").alias("config_ms"), "key", F.col("weight").alias("_default"))
    met = operands.join(F.broadcast(own), ["config_ms", "key", "subkey"], "left").join(F.broadcast(rest), ["config_ms", "key"], "left")  # configurations are few
    missing = F.raise_error(F.concat(F.lit("no weights for key "), "key")).cast("double")
    return met.withColumn("weight", F.coalesce("_own", "_default", missing)).withColumn("explicit", F.col("_own").isNotNull()).drop("_own", "_default")


def with_operators(expressions: DataFrame, configured: DataFrame) -> DataFrame:
    """``expressions`` (config_ms, operator, ...) with operators ``key:NAME`` replaced by those that the configuration in
    force gives the name. configured (start_ms, key, operator). A name that is not set, and an operator that there isn't,
    are errors when rows are read."""
    own = configured.select(F.col("start_ms").alias("config_ms"), F.concat(F.lit("key:"), "key").alias("operator"), F.col("operator").alias("_set"))
    met = expressions.join(F.broadcast(own), ["config_ms", "operator"], "left")  # configurations are few
    found = F.when(F.startswith("operator", F.lit("key:")), F.col("_set")).otherwise(F.col("operator"))
    wrong = F.raise_error(F.concat(F.lit("no such operator, or not configured: "), "operator")).cast("string")
    return met.withColumn("operator", F.when(found.isin(list(OPERATORS)), found).otherwise(wrong)).drop("_set")


def _operator(name: Column) -> Column:
    """Its position among OPERATORS: a number, so that sums are kept by hash and not by sorted rows."""
    return F.coalesce(*(F.when(name == op, F.lit(i)) for i, op in enumerate(OPERATORS)), F.raise_error(F.concat(F.lit("unknown operator "), name)).cast("int"))


def _score() -> Column:
    """Of what ``_gathered`` has of an expression. FIRST takes expressions before weights, and explicit ones before others."""
    first = F.coalesce("first_below", "first_explicit", "first_weight")
    by = (F.col("total"), F.col("product"), F.coalesce(F.greatest("most_below", "most_explicit"), "first_weight"), first, F.col("total") / F.col("n"))
    found = F.coalesce(*(F.when(F.col("operator") == i, x) for i, x in enumerate(by)))
    return F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(found, F.lit(0.0)))


def _gathered(expressions: DataFrame, operands: DataFrame) -> DataFrame:
    """A row for each expression, with all that its score takes of its own weights."""
    own = expressions.select("contribution", "path", _operator(F.col("operator")).alias("operator"), F.lit(None).cast("double").alias("x"), F.lit(False).alias("explicit"), F.lit(None).cast("int").alias("ord"))
    rows = own.union(operands.select("contribution", "path", F.lit(None).cast("int"), F.col("weight"), "explicit", F.col("ord").cast("int")))
    # dealt to a fixed number of parts, so that no task's sums grow with how well the rows compress
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "contribution", "path")
    x, order, explicit = F.col("x"), F.col("ord"), F.col("explicit")
    found = rows.groupBy("contribution", "path").agg(
        F.max("operator").alias("operator"), F.count("x").alias("n"), F.sum("x").alias("total"), F.product("x").alias("product"), F.min_by("x", "ord").alias("first_weight"),
        F.max(F.when(explicit, x)).alias("most_explicit"), F.min_by(x, F.when(explicit, order)).alias("first_explicit"),
    )
    return found.where("operator IS NOT NULL")


def score_trees(expressions: DataFrame, operands: DataFrame, depth: int) -> DataFrame:
    """(contribution, path, score) of every expression, for trees of at most ``depth`` levels. operands carry weight
    and explicit. An expression without operands scores 0. Weights are gathered once, and written; each level then adds
    the scores of the one below it."""
    held = checkpointed(_gathered(expressions, operands))
    level = F.size(F.split("path", r"\."))
    below, out = None, None
    for k in range(depth, 0, -1):
        own = held.where(level == k)
        if below is None:
            own = own.withColumns({c: F.lit(None).cast("double") for c in ("first_below", "most_below")})
        else:
            up = below.groupBy("contribution", F.regexp_replace("path", r"\.[^.]*$", "").alias("path")).agg(
                F.count("score").alias("_n"), F.sum("score").alias("_total"), F.product("score").alias("_product"), F.max("score").alias("most_below"),
                F.min_by("score", F.element_at(F.split("path", r"\."), -1).cast("int")).alias("first_below"),
            )
            own = own.join(up, ["contribution", "path"], "left").withColumns({
                "n": F.col("n") + F.coalesce("_n", F.lit(0)), "total": F.coalesce("total", F.lit(0.0)) + F.coalesce("_total", F.lit(0.0)),
                "product": F.coalesce("product", F.lit(1.0)) * F.coalesce("_product", F.lit(1.0)),
            })
        scored = own.select("contribution", "path", _score().alias("score"))
        below, out = scored, scored if out is None else out.unionByName(scored)
    return out


def share_out(scored: DataFrame, shares: DataFrame, cumulative: bool = True) -> DataFrame:
    """(contribution, participant, score). shares (contribution, ord, participant, weight).

    ``cumulative``: a share is set against the shares up to and including its own, so the first participant has the
    whole score (ties in ``ord`` by participant and weight); otherwise against all shares of the contribution."""
    window = Window.partitionBy("contribution")
    window = window.orderBy("ord", "participant", "weight").rowsBetween(Window.unboundedPreceding, 0) if cumulative else window
    met = shares.withColumn("of", F.sum("weight").over(window)).join(scored, "contribution")
    return met.select("contribution", "participant", "ord", F.when(F.col("of") == 0, F.lit(float("nan"))).otherwise(F.col("score") * F.col("weight") / F.col("of")).alias("score"))


def with_subkey(operands: DataFrame, shares: DataFrame, key: str, subkey: str) -> DataFrame:
    """(contribution, n) that name a subkey: once if in any weight of the expression, else once for each share that does.
    shares (contribution, key, subkey)."""
    named = (F.col("key") == key) & (F.col("subkey") == subkey)
    inside = operands.where(named).select("contribution").distinct().withColumn("n", F.lit(1).cast("long"))
    by_share = shares.where(named).groupBy("contribution").agg(F.count(F.lit(1)).alias("n"))
    return inside.unionByName(by_share.join(inside.select("contribution"), "contribution", "left_anti"))

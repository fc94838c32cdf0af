"""Weights by address prefix: node_weights (prefix, weight) and edge_weights (prefix, forwards, backwards).

An address has the product of the weights of all its prefixes, 1 where none is weighted. Up to TESTS weights are tests
of the address's beginning, which run as generated code; up to LITERALS become a literal map that each row looks its few
prefixes up in, without a shuffle; longer tables are joined."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.functions.addresses import prefixes

TESTS, LITERALS = 16, 1_000


def _lookup(known: Column):
    return lambda p: F.coalesce(F.try_element_at(known, p), F.lit(1.0))


def _tested(address: Column, known: dict[str, float]) -> Column:
    """The product, from the shortest prefix on. A prefix that doesn't end a segment is none of any address."""
    out = F.lit(known.get("", 1.0))
    for prefix in sorted((k for k in known if k.endswith("/")), key=len):
        out = out * F.when(F.startswith(address, F.lit(prefix)), F.lit(known[prefix])).otherwise(F.lit(1.0))
    return out


def with_products(rows: DataFrame, weights: DataFrame, columns: list[str], address: str = "address") -> DataFrame:
    """``rows`` with the products of the weights' ``columns``, however often an address stands in them. A prefix that has
    two weights is an error (where the weights are many, when rows are read)."""
    few = weights.select("prefix", *columns).limit(LITERALS + 1).collect()
    if not few:
        return rows.withColumns({c: F.lit(1.0) for c in columns})
    if len(few) > LITERALS:
        weights = merge([weights.select("prefix", *columns)])
    elif len({r.prefix for r in few}) < len(few):
        raise ValueError("duplicate weights")
    if len(few) <= min(TESTS, LITERALS):
        return rows.withColumns({c: _tested(F.col(address), {r.prefix: float(r[c]) for r in few}) for c in columns})
    if len(few) <= LITERALS:
        out = rows
        for c in columns:
            known = F.create_map(*(F.lit(x) for r in few for x in (r.prefix, float(r[c]))))
            found = F.transform(prefixes(F.col(address)), _lookup(known))
            out = out.withColumn(c, F.aggregate(found, F.lit(1.0), lambda a, x: a * x))
        return out
    flat = rows.select(F.col(address).alias("_a")).distinct().select("_a", F.explode(prefixes(F.col("_a"))).alias("prefix")).join(weights, "prefix")
    found = flat.groupBy("_a").agg(*(F.product(c).alias(c) for c in columns))
    return rows.join(found, F.col(address) == F.col("_a"), "left").drop("_a").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in columns})


def longest_prefix(rows: DataFrame, values: DataFrame, value: str, address: str = "address") -> DataFrame:
    """``rows`` with the value of the longest prefix that has one, or null."""
    few = values.select("prefix", value).limit(LITERALS + 1).collect()
    if 0 < len(few) <= LITERALS:
        known = F.create_map(*(F.lit(x) for r in few for x in (r.prefix, r[value])))
        found = F.filter(F.transform(prefixes(F.col(address)), lambda p: F.try_element_at(known, p)), lambda x: x.isNotNull())
        return rows.withColumn(value, F.when(F.size(found) > 0, F.element_at(found, -1)))
    flat = rows.select(F.col(address).alias("_a"), F.explode(prefixes(F.col(address))).alias("prefix")).join(values, "prefix")
    found = flat.groupBy("_a").agg(F.max_by(value, F.length("prefix")).alias(value))
    return rows.join(found, F.col(address) == F.col("_a"), "left").drop("_a")


def override(tables: list[DataFrame]) -> DataFrame:
    """The union of weights; of equal prefixes, the last table's row."""
    ranked = reduce(DataFrame.unionByName, (t.withColumn("_ord", F.lit(i)) for i, t in enumerate(tables)))
    last = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("_ord")))
    return ranked.withColumn("_n", last).where("_n = 1").drop("_n", "_ord")


def merge(tables: list[DataFrame], resolve: Callable[[Column, Column], Column] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The union of weights; a prefix in two tables is an error when rows are read, or its ``columns`` become what
    ``resolve`` makes of the first table's and the second's, then of that and the third's, and so on."""
    united = reduce(DataFrame.unionByName, tables)
    if resolve is not None:
        columns = columns or [c for c in united.columns if c != "prefix"]
        ranked = reduce(DataFrame.unionByName, (t.withColumn("_ord", F.lit(i)) for i, t in enumerate(tables)))
        packed = ranked.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("_ord", *columns))).alias("_w"))  # a row a table

        def folded(c: str) -> Column:
            values = F.transform("_w", lambda w: w[c])
            return F.aggregate(F.slice(values, F.lit(2), F.size(values)), values[0], lambda a, x: resolve(a, x))

        return packed.select("prefix", *(folded(c).alias(c) for c in columns))
    n = F.count(F.lit(1)).over(Window.partitionBy("prefix"))
    ok = F.when(n == 1, F.col("prefix")).otherwise(F.raise_error(F.concat(F.lit("duplicate weight: "), "prefix")).cast("string"))
    return united.withColumn("prefix", ok)

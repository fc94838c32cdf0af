"""Contributions as JSON, one object a line, opened into the tables that scoring takes.

A contribution has an expression tree of any depth. Spark has no recursive types, so lines are VARIANT, and the trees are
opened level by level into rows whose paths tell parents from children."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgraph.operators.expressions import OPERATORS
from meritgraph.operators.frames import checkpointed
from meritgraph.sources import shapes
from meritgraph.sources.shapes import Shape, array_of, elements, field, record

#: The members of each object, and operators by configured key.
OPERATOR = shapes.matching("^(" + "|".join(OPERATORS) + ")$|^key:", "one of " + ", ".join(OPERATORS) + " or a key")


def _weight(strict: bool) -> Shape:
    return record({"key": shapes.text}, {"subkey": shapes.text}, strict)


def _expression(strict: bool) -> Shape:
    return record({"operator": OPERATOR, "description": shapes.text, "weightOperands": array_of(_weight(strict)), "expressionOperands": array_of(shapes.anything)}, strict=strict)


def _contribution(strict: bool) -> Shape:
    person = record({"id": shapes.text, "shares": array_of(_weight(strict))}, strict=strict)
    return record({"id": shapes.text, "plugin": shapes.text, "type": shapes.text, "timestampMs": shapes.number, "expression": shapes.anything, "participants": array_of(person)}, strict=strict)


@dataclass(frozen=True)
class Contributions:
    """contributions (contribution, plugin, type, timestamp_ms), expressions (contribution, path, operator, description),
    operands (contribution, path, ord, key, subkey), shares (contribution, participant, ord, place, key, subkey): ``ord``
    is the participant's place, ``place`` the share's own."""

    contributions: DataFrame
    expressions: DataFrame
    operands: DataFrame
    shares: DataFrame


def opened(lines: DataFrame, strict: bool = True) -> Contributions:
    """The tables of lines (seq, value). Wrong types, unknown members (if ``strict``) and operators that there aren't are
    errors that name the line and the path, in the trees when this is called, elsewhere when rows are read."""
    rows = checkpointed(shapes.parsed(lines, _contribution(strict)))
    v = F.col("v")
    own = rows.select("seq", field(v, "id", "string").alias("contribution"), field(v, "plugin", "string").alias("plugin"), field(v, "type", "string").alias("type"), field(v, "timestampMs", "bigint").alias("timestamp_ms"), "v")
    roots = own.select("seq", "contribution", F.lit("$.expression").alias("at"), field(v, "expression").alias("node"))
    text = lambda v, name: F.try_element_at(v, F.lit(name)).cast("string")
    weight = lambda w: F.struct(field(w, "key", "string").alias("key"), field(w, "subkey", "string").alias("subkey"))
    of_node = F.col("_own")
    keep = {"operator": text(of_node, "operator"), "description": text(of_node, "description"), "weights": F.transform(elements(F.try_element_at(of_node, F.lit("weightOperands"))), weight)}
    nodes = shapes.levels(roots, "node", "expressionOperands", _expression(strict), keep)
    weights = nodes.select("contribution", "path", F.posexplode("weights").alias("ord", "w")).select("contribution", "path", "ord", "w.key", "w.subkey")
    people = own.select("contribution", F.posexplode(elements(field(v, "participants"))).alias("ord", "p"))
    shares = people.select("contribution", field(F.col("p"), "id", "string").alias("participant"), "ord", F.posexplode(elements(field(F.col("p"), "shares"))).alias("place", "w"))
    of = lambda df, *c: df.select(*c, field(F.col("w"), "key", "string").alias("key"), field(F.col("w"), "subkey", "string").alias("subkey"))
    return Contributions(
        own.drop("seq", "v"), nodes.select("contribution", "path", "operator", "description"), weights,
        of(shares, "contribution", "participant", "ord", "place"),
    )


def by_target(lines: DataFrame) -> DataFrame:
    """(target, seq, value) of objects that have an array of contributions for each target."""
    rows = shapes.parsed(lines, shapes._of("an object", "OBJECT"))
    each = rows.select("seq", F.explode(F.try_variant_get(F.col("v"), "$", "map<string,variant>")).alias("target", "list"))
    wrong = F.get(array_of(shapes.anything)(F.col("list"), F.concat(F.lit("$."), F.col("target"))), F.lit(0))
    each = shapes.refused(each.withColumn("_wrong", wrong), "list")
    return each.select("target", "seq", F.explode(elements(F.col("list"))).alias("x")).select("target", "seq", F.to_json("x").alias("value"))

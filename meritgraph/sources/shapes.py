"""Shapes of JSON values, checked on VARIANT columns without leaving the engine.

A shape says for a value (null where there is none) and its path which problems it has: an array of texts like
``$.participants[2].id: expected a string, got a BIGINT``, in the order of the shape's fields. Shapes are built of each
other; only those that contain themselves need a level of their own for each step (``levels``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.operators.frames import checkpointed

Shape = Callable[[Column, Column], Column]
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


def _fine() -> Column:
    return F.array().cast("array<string>")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (null), or a number's type; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, name: str, cast: str = "variant") -> Column:
    """A member of an object; null where there is none, or where it can't be cast."""
    return F.try_variant_get(v, f"$['{name}']", cast)


def elements(v: Column) -> Column:
    """The elements of an array, as array<variant>; null where the value is none."""
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    """The members of an object, as map<string,variant>; null where the value is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _problem(path: Column, text: str | Column) -> Column:
    return F.array(F.concat(path, F.lit(": "), F.lit(text) if isinstance(text, str) else text))


def _not(what: str, v: Column, path: Column) -> Column:
    return _problem(path, F.concat(F.lit(f"expected {what}, got "), F.coalesce(kind(v), F.lit("nothing"))))


def _of(what: str, *kinds: str) -> Shape:
    """By its kind, of which there is one for all inside: objects and arrays are told by ``members`` and ``elements``."""

    def check(v: Column, path: Column) -> Column:
        wrong = lambda got: F.when(got.isin(list(kinds)), _fine()).otherwise(_problem(path, F.concat(F.lit(f"expected {what}, got "), got)))
        return _once(F.coalesce(kind(v), F.lit("nothing")), wrong)

    return check


text = _of("a string", "STRING")
number = _of("a number", *NUMBERS)
boolean = _of("a boolean", "BOOLEAN")
null = _of("null", "VOID")
anything: Shape = lambda v, path: F.when(v.isNull(), _problem(path, "expected a value")).otherwise(_fine())


def matching(pattern: str, what: str) -> Shape:
    """A string that a pattern matches."""

    def check(v: Column, path: Column) -> Column:
        own = F.try_variant_get(v, "$", "string")
        wrong = F.when(F.regexp_like(own, F.lit(pattern)), _fine()).otherwise(_problem(path, F.concat(F.lit(f"expected {what}, got "), own)))
        return _once(text(v, path), lambda x: F.when(F.size(x) > 0, x).otherwise(wrong))

    return check


def exactly(*values: str) -> Shape:
    return matching("^(" + "|".join(values) + ")$", "one of " + ", ".join(values))


def either(*shapes: Shape) -> Shape:
    """A value that one of the shapes takes; the problems of the last otherwise."""

    def check(v: Column, path: Column) -> Column:
        out = shapes[-1](v, path)
        for shape in shapes[:-1]:
            out = F.when(F.size(shape(v, path)) == 0, _fine()).otherwise(out)
        return out

    return check


def array_of(shape: Shape) -> Shape:
    def check(v: Column, path: Column) -> Column:
        each = lambda x, i: _once(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), lambda at: shape(x, at))
        inside = lambda own: _fine() if shape is anything else F.flatten(F.transform(own, each))
        return _once(elements(v), lambda own: F.when(own.isNull(), _not("an array", v, path)).otherwise(inside(own)))

    return check


def record(required: dict[str, Shape], optional: dict[str, Shape] | None = None, strict: bool = True) -> Shape:
    """An object; ``strict`` refuses members that the shape doesn't name."""
    optional = optional or {}

    def inside(own: Column, path: Column) -> Column:
        at = lambda name: F.concat(path, F.lit(f".{name}"))
        of = lambda name: F.try_element_at(own, F.lit(name))
        one = lambda shape, name: lambda x: shape(x, at(name))
        found = [_once(of(name), one(shape, name)) for name, shape in required.items()]
        known = lambda shape, name: lambda x: F.when(x.isNull(), _fine()).otherwise(shape(x, at(name)))
        found += [_once(of(name), known(shape, name)) for name, shape in optional.items()]
        if strict:
            more = F.array_except(F.map_keys(own), F.array(*map(F.lit, [*required, *optional])))
            found.append(F.transform(more, lambda k: F.concat(path, F.lit("."), k, F.lit(": unknown member"))))
        return F.flatten(F.array(*found)) if found else _fine()

    def check(v: Column, path: Column) -> Column:
        return _once(members(v), lambda own: F.when(own.isNull(), _not("an object", v, path)).otherwise(inside(own, path)))

    return check


def by_type(shapes: dict[str, Shape], member: str = "type") -> Shape:
    """An object whose string ``member`` says which of the shapes it has."""

    def check(v: Column, path: Column) -> Column:
        own = field(v, member, "string")
        out = exactly(*shapes)(field(v, member), F.concat(path, F.lit(f".{member}")))
        for name, shape in shapes.items():
            out = F.when(own == name, shape(v, path)).otherwise(out)
        return out

    return check


def parsed(lines: DataFrame, shape: Shape) -> DataFrame:
    """(seq, v) of lines (seq, value); blank lines are none. A line that is no JSON or not of the shape is an error, which
    names the line and the path of its first problem, when rows are read."""
    rows = lines.where("trim(value) <> ''").select("seq", F.try_parse_json("value").alias("v"), "value")
    wrong = F.when(F.col("v").isNull(), F.lit("$: no JSON")).otherwise(F.get(shape(F.col("v"), F.lit("$")), F.lit(0)))
    return refused(rows.select("seq", "v", wrong.alias("_wrong")), "v").select("seq", "v")


def refused(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (seq, ``_wrong``), where reading ``value`` of a row with a problem is an error."""
    stop = F.raise_error(F.concat(F.lit("line "), F.col("seq").cast("string"), F.lit(", "), F.col("_wrong")))
    return rows.withColumn(value, F.when(F.col("_wrong").isNull(), F.col(value)).otherwise(stop.cast("variant"))).drop("_wrong")


def levels(roots: DataFrame, node: str, children: str, shape: Shape, keep: dict[str, Column]) -> DataFrame:
    """All nodes of the trees whose roots are the column ``node`` of ``roots`` (with ``seq`` and ``at``, the roots' path
    in their line): a row for each, with ``path`` (0, 0.1, 0.1.0 and so on) and what ``keep`` makes of the column
    ``_own``, the node's members, beside the other columns of ``roots``. A node has its children in the array
    ``children``; ``shape`` checks a node without going into them.

    The trees are opened level by level, one step for each level of the deepest, and no step holds a tree whole."""
    level = roots.withColumn("path", F.lit("0"))
    names, out = [c for c in level.columns if c != node], None
    while True:
        wrong = F.get(shape(F.col(node), F.col("at")), F.lit(0))
        checked = refused(level.withColumn("_wrong", wrong), node).select(*names, members(F.col(node)).alias("_own"))
        below = elements(F.try_element_at("_own", F.lit(children)))
        level = checkpointed(checked.select(*names, *(x.alias(c) for c, x in keep.items()), below.alias("_below")))
        if level.isEmpty():
            return level.drop("_below") if out is None else out
        out = level.drop("_below") if out is None else out.unionByName(level.drop("_below"))
        below = level.select(*names, F.posexplode("_below").alias("_i", node))
        i = F.col("_i").cast("string")
        level = below.withColumns({"path": F.concat("path", F.lit("."), i), "at": F.concat("at", F.lit(f".{children}["), i, F.lit("]"))}).select(*names, node)

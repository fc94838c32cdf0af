"""Addresses: path segments, each ended by ``/``, so that a string prefix is a prefix of segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(*parts: Column | str) -> Column:
    """Text parts are literals, columns are cast to text."""
    return F.concat(*(x for p in parts for x in (F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("/"))))


def parts(a: Column) -> Column:
    split = F.split(a, "/")
    return F.slice(split, F.lit(1), F.size(split) - 1)


def head(a: Column, n: int) -> Column:
    """The first ``n`` segments."""
    return F.concat(F.substring_index(a, "/", n), F.lit("/"))


def prefixes(a: Column) -> Column:
    """All prefixes, shortest first: the empty one, and the address itself last."""
    p = parts(a)
    whole = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.array_join(F.slice(p, F.lit(1), i), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), F.when(F.size(p) > 0, whole).otherwise(F.array().cast("array<string>")))


def has_prefix(a: Column, prefix: str) -> Column:
    return F.startswith(a, F.lit(prefix))


def is_address(a: Column) -> Column:
    return (a == "") | a.rlike(r"^([^/]+/)+$")

"""Exact amounts: integers of 10^-18 units in DECIMAL(38,0)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(38,0)"
DECIMALS = 18


def times_float(amount: int, x: float) -> int:
    """The floor of the product in double precision; the amount itself if the factor is one."""
    return amount if x == 1 else math.floor(float(amount) * x)


def split_budget(budget: int, scores: list[float]) -> list[int]:
    """Shares in proportion to the scores, in order, whose sum is the budget exactly: each takes its part of what is
    left, and the last takes the rest."""
    if budget < 0:
        raise ValueError(f"negative budget: {budget}")
    if any(not math.isfinite(s) or s < 0 for s in scores):
        raise ValueError("scores must be finite and not negative")
    left = math.fsum(scores)
    if left <= 0:
        raise ValueError("the scores have no sum to share by")
    rest, out = budget, []
    for s in scores:
        share = times_float(rest, min(1.0, s / left)) if s > 0 and left > 0 and rest > 0 else 0
        share = min(share, rest)
        out.append(share)
        rest -= share
        left -= s
    out[-1] += rest
    return out


def plain(amount: Column) -> Column:
    """As a decimal number without needless zeros: ``1.5`` for 1500000000000000000."""
    digits = F.lpad(F.abs(amount).cast("string"), 38, "0")
    whole = F.regexp_replace(F.substring(digits, 1, 38 - DECIMALS), "^0+(?=.)", "")
    part = F.regexp_replace(F.substring(digits, 39 - DECIMALS, DECIMALS), "0+$", "")
    return F.concat(F.when(amount < 0, "-").otherwise(""), whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def grouped(amount: Column, decimals: int = 2, suffix: str = "") -> Column:
    """With commas between thousands and a fixed number of decimals, cut off and not rounded."""
    digits = F.lpad(F.abs(amount).cast("string"), 38, "0")
    whole = F.regexp_replace(F.substring(digits, 1, 38 - DECIMALS), "^0+(?=.)", "")
    whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    part = F.concat(F.lit("."), F.substring(digits, 39 - DECIMALS, decimals)) if decimals else F.lit("")
    return F.concat(F.when(amount < 0, "-").otherwise(""), whole, part, F.lit(suffix))

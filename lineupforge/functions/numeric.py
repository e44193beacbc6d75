"""Numbers as Columns: probabilities, weights, odds, prices, seasons, expiry."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(v) with v bound to value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp_probability(c: Column) -> Column:
    """0 to 100 as an integer; what is no finite number is 0."""
    x = c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(F.when(bad, 0.0).otherwise(x))))).cast("int")


def parse_weight(c: Column) -> Column:
    """The number that a text starts with, if positive, else 1."""
    x = F.regexp_extract(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x).otherwise(1.0)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.floor(part * 100.0 * 10**digits / whole + 0.5) / 10**digits)


def fair_odds(*odds: Column) -> Column:
    """True if every decimal odd is a finite number above 1."""
    return reduce(and_, ((o > 1) & (o < float("inf")) for o in odds))  # NaN is above every number


def devig(home: Column, draw: Column, away: Column) -> Column:
    """Three decimal odds as whole percentages that sum to 100, by largest remainders (ties: earlier first); null if
    one is no finite number above 1."""
    three = lambda v: (F.get(v, 0), F.get(v, 1), F.get(v, 2))

    def shares(odds):
        x, y, z = (F.try_divide(F.lit(1.0), o) for o in three(odds))
        return F.when(fair_odds(*three(odds)), bound(F.array(*(100.0 * i / (x + y + z) for i in (x, y, z))), rounded))

    def rounded(raw):
        base = [F.floor(x).cast("int") for x in three(raw)]
        rest = [x - F.floor(x) for x in three(raw)]
        return bound(F.struct(*(b.alias(f"b{i}") for i, b in enumerate(base)), *(r.alias(f"r{i}") for i, r in enumerate(rest)), (100 - (base[0] + base[1] + base[2])).alias("left")), dealt)

    def dealt(v):
        before = lambda j, i: (v[f"r{j}"] >= v[f"r{i}"] if j < i else v[f"r{j}"] > v[f"r{i}"]).cast("int")
        out = lambda i, j, k: v[f"b{i}"] + (before(j, i) + before(k, i) < v["left"]).cast("int")
        return F.struct(out(0, 1, 2).alias("home"), out(1, 0, 2).alias("draw"), out(2, 0, 1).alias("away"))

    return bound(F.array(*(o.cast("double") for o in (home, draw, away))), shares)


def positive_price(*prices: Column) -> Column:
    """The least positive price, or null."""
    return F.array_min(F.filter(F.array(*prices), lambda x: x > 0))


def sale_price(direct: Column, public: Column, auction: Column) -> Column:
    """Direct sale, else public minimum, else auction; only positive ones count."""
    return F.coalesce(*(F.when(p > 0, p) for p in (direct, public, auction)))


def season_week(day: Column, start: Column, end: Column, last: int = 38) -> Column:
    """The number of the week (from Monday) of a day since the season's first, 1 to last; null off season."""
    weeks = F.floor(F.date_diff(F.date_trunc("WEEK", day).cast("date"), F.date_trunc("WEEK", start).cast("date")) / 7) + 1
    return F.when(day.cast("date").between(start.cast("date"), end.cast("date")), F.greatest(F.lit(1), F.least(F.lit(last), weeks))).cast("int")


def refresh_plan(expires: Column, now: Column, force: Column) -> Column:
    """True where a cached value must be fetched anew: forced, never fetched, or not later than now."""
    return force | expires.isNull() | ~(expires > now)


def tone(c: Column) -> Column:
    return F.when(c >= 80, "high").when(c >= 60, "medium").otherwise("low")

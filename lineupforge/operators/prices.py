"""Prices of cards per edition: what is on sale counts, then the market's floor, then an auction's bid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARITY = "limited"


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def floors(cards: DataFrame, by: list[str]) -> DataFrame:
    """by, classic and in_season: struct<eur_cents, slug> of the cheapest direct sale of the rarity, the first found at a
    tie. cards: by, slug, rarity, in_season (null: classic), direct, ord. Tasks combine before the exchange."""
    price = F.when((F.col("rarity") == RARITY) & (F.col("direct") > 0), F.col("direct"))
    season = F.coalesce("in_season", F.lit(False))

    def lowest(which: Column) -> Column:
        p = F.when(which, price)
        return F.struct(F.min(p).alias("eur_cents"), F.min_by("slug", F.when(p.isNotNull(), F.struct(p, F.col("ord"), F.col("slug")))).alias("slug"))

    return cards.groupBy(*by).agg(lowest(~season).alias("classic"), lowest(season).alias("in_season"))


def _fits(card: Column, season: bool) -> Column:
    return card.isNotNull() & F.coalesce(card["in_season"] == season, F.lit(True))


def sale(card: Column, season: bool) -> Column:
    """The direct, else the public price of a card of the right edition and rarity."""
    right = _fits(card, season) & (F.coalesce(card["rarity"], F.lit("")).isin("", RARITY))
    return F.when(right, F.coalesce(_positive(card["direct"]), _positive(card["public"])))


def edition(card: Column, floor: Column, season: bool) -> Column:
    """struct<eur_cents, slug> of an edition: sale, floor, auction, in this order; the slug is of what set the price.

    card: struct<slug, rarity, in_season, direct, public, auction>, floor: struct<eur_cents, slug>, either may be null."""
    slug = F.when(_fits(card, season), card["slug"])
    bid = F.when(_fits(card, season) & F.coalesce(card["rarity"], F.lit("")).isin("", RARITY), _positive(card["auction"]))
    priced = lambda p, s: F.struct(p.cast("long").alias("eur_cents"), s.cast("string").alias("slug"))
    now = sale(card, season)
    return F.when(now.isNotNull(), priced(now, slug)).when(floor["eur_cents"].isNotNull(), priced(floor["eur_cents"], floor["slug"])).when(bid.isNotNull(), priced(bid, slug)).otherwise(priced(F.lit(None), F.lit(None)))


def needs_floor(classic: Column, in_season: Column) -> Column:
    """Whether the floor must be asked for: an edition isn't on sale, or both are at one price and slug."""
    a, b = sale(classic, False), sale(in_season, True)
    same = (a == b) & F.when(_fits(classic, False), classic["slug"]).eqNullSafe(F.when(_fits(in_season, True), in_season["slug"]))
    return a.isNull() | b.isNull() | F.coalesce(same, F.lit(False))

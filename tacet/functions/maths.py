"""Scalar functions of the model as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tacet import config as C


def half_up(x, digits: int = 4) -> Column:
    """Rounds half towards +infinity; values that are not finite give 0, null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    s = 10.0**digits
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.floor(x * s + 0.5) / s)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def population_bucket(p) -> Column:
    p = F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit(0))
    return F.when(p < 5000, "p<5k").when(p <= 20000, "p5-20k").otherwise("p>20k")


def cohort_key(tier="hazard_tier", population="population") -> Column:
    """A missing tier counts as 1 here."""
    t = F.col(tier) if isinstance(tier, str) else tier
    return F.concat(F.lit("t"), F.when(F.coalesce(t, F.lit(0)) == 0, 1).otherwise(t).cast("string"), F.lit("|"), population_bucket(population))


def tier_factor(tier: Column) -> Column:
    """Unknown tiers count as the reference tier here."""
    out = F.lit(C.TIER_FACTOR[2])
    for t, f in C.TIER_FACTOR.items():
        out = F.when(tier == t, f).otherwise(out)
    return out


def clamp_rate(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)
    return F.when(bad, C.RATE_MIN).otherwise(clamp(x, C.RATE_MIN, C.RATE_MAX))


def prior_rate(population: Column, tier: Column) -> Column:
    """Expected reports per hour from size and hazard tier alone."""
    p = F.greatest(F.coalesce(population.cast("double"), F.lit(1.0)), F.lit(1.0))
    return clamp_rate(F.lit(1 / C.ANCHOR_GAP_H) * F.pow(p / C.REFERENCE_POPULATION, F.lit(C.POPULATION_EXPONENT)) * tier_factor(tier))


def silence_band(hours: Column) -> Column:
    """0 to 5 by hours of silence; null is 5."""
    out = F.lit(5)
    for i, h in reversed(list(enumerate((6, 18, 36, 60, 84)))):
        out = F.when(hours < h, i).otherwise(out)
    return F.when(hours.isNull(), 5).otherwise(out)


def population_radius(population: Column) -> Column:
    return clamp(5 + 16 * F.sqrt(F.greatest(population.cast("double"), F.lit(0.0)) / 25000), 5, 22)

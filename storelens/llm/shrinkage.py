"""Empirical beta priors from group counts, as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the prior's strength, in pseudo-observations.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def strength(mean: Column, variance: Column) -> Column:
    """Moment estimate alpha + beta = m(1-m)/v - 1, held between the bounds.

    No spread between groups (or a single group) shrinks as far as allowed.
    """
    raw = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(F.lit(MAX_STRENGTH))
    return F.least(F.greatest(raw, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))


def moments(groups: DataFrame, hits: list[str], trials: str) -> dict[str, tuple[float, float]]:
    """Per count column: mean and strength of the beta prior over the groups' rates.

    One distributed aggregate; two numbers per column reach the driver.
    """
    seen = groups.where(F.col(trials) > 0)
    rate = {h: F.col(h) / F.col(trials) for h in hits}
    found = seen.agg(*[F.avg(rate[h]).alias(f"m_{h}") for h in hits],
                     *[F.var_samp(rate[h]).alias(f"v_{h}") for h in hits])
    row = found.select(*[F.coalesce(F.col(f"m_{h}"), F.lit(0.0)).alias(f"m_{h}") for h in hits],
                       *[F.coalesce(strength(F.col(f"m_{h}"), F.col(f"v_{h}")), F.lit(MAX_STRENGTH)).alias(f"k_{h}")
                         for h in hits]).first()
    return {h: (row[f"m_{h}"], row[f"k_{h}"]) for h in hits}

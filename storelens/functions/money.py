"""Money arithmetic: exact decimals inside, double only at the edge.

Driver prices are doubles with two decimals.  Casting each to ``decimal(18,2)``
before any arithmetic makes sums independent of summation order, so Spark and
any other engine agree to the cent.  Results are cast back to double once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"


def money(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast(MONEY)


def net_price(price="l_extendedprice", discount="l_discount") -> Column:
    """price x (1 - discount), exact (decimal(38,4))."""
    return money(price) * (F.lit(1) - money(discount))


def to_double(c: Column) -> Column:
    return c.cast("double")

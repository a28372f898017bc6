"""Arithmetic and formatting expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed exactly, so a total does not depend on partitioning. Prices
# have six decimals (finer than the 32-bit prices of the data model), counts
# four. Per row everything is a long, which stays inside generated code; a sum
# keeps two longs (1e-4 units and the rest in 1e-10 units) and becomes a wide
# decimal once per group. A group may hold up to about 9.2e14 currency units;
# ANSI mode raises rather than wraps beyond that.
_PRICE_STEPS = 1_000_000
_COUNT_STEPS = 10_000
AMOUNT = "decimal(38,10)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _split(price) -> tuple[Column, Column]:
    """Whole part and millionths (0 to 1e6) of a price, as longs."""
    whole = F.floor(_c(price))
    return whole, F.rint((_c(price) - whole) * F.lit(_PRICE_STEPS)).cast("long")


def _limbs(price, count) -> tuple[Column, Column]:
    """``price * count`` of one row as (1e-4 units, rest in 1e-10 units)."""
    whole, millionths = _split(price)
    n = F.rint(_c(count) * F.lit(_COUNT_STEPS)).cast("long")
    fine = millionths * n
    steps = F.lit(_PRICE_STEPS).cast("long")
    return whole * n + F.call_function("div", fine, steps), fine % steps


def _amount(coarse: Column, fine: Column) -> Column:
    return (coarse.cast("decimal(20,0)") * F.lit(Decimal("0.0001"))
            + fine.cast("decimal(20,0)") * F.lit(Decimal("1E-10"))).cast(AMOUNT)


def line_total(price, count) -> Column:
    """``price * count`` of one row, exact, as ``decimal(38,10)``."""
    return _amount(*_limbs(price, count))


def sum_amount(price, count) -> Column:
    """Exact ``sum(price * count)`` as ``decimal(38,10)``; such sums can be
    summed again."""
    coarse, fine = _limbs(price, count)
    return _amount(F.sum(coarse), F.sum(fine))


def amount_to_double(amount) -> Column:
    """A (summed) amount as a double currency value."""
    return _c(amount).cast("double")


def sum_price(price) -> Column:
    """Exact sum of prices in millionths, as ``decimal(38,0)``."""
    whole, millionths = _split(price)
    return (F.sum(whole).cast("decimal(20,0)") * F.lit(Decimal(_PRICE_STEPS))
            + F.sum(millionths)).cast("decimal(38,0)")


def mean_of_prices(price_sum, n, places: int = 4) -> Column:
    """Mean price from a :func:`sum_price` and a count, rounded half away from
    zero to ``places`` (<= 6) in integer arithmetic."""
    scale = 10 ** places
    step = F.lit(_PRICE_STEPS // scale).cast("decimal(38,0)") * _c(n)
    num = F.abs(_c(price_sum)) * F.lit(2) + step
    den = step * F.lit(2)
    # Exact floor division: (num - num mod den) / den has no remainder.
    units = ((num - num % den) / F.nullif(den, F.lit(0))).cast("decimal(38,0)")
    mean = (units * F.signum(_c(price_sum)).cast("decimal(1,0)") / F.lit(scale)).cast("double")
    return F.when(_c(n) > 0, mean)


def format_millions(col) -> Column:
    """``12,345,678 -> '12M'`` style axis label."""
    return F.concat(F.format_number(_c(col) / F.lit(1e6), 0), F.lit("M"))


def format_percent(col, places: int = 3) -> Column:
    """``0.12345 -> '12.345%'``."""
    return F.format_string(f"%.{places}f%%", _c(col) * F.lit(100))

"""Money, division and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(16,2)"


def cents_to_dollars(cents: Column | str, dialect: str = "default") -> Column:
    """Integer cents as a decimal dollar amount.

    The dialects agree on whole cents and differ in result type: ``bigquery`` keeps a wide numeric, the others give
    ``decimal(16,2)``. ``default`` and ``fabric`` go through double; ``postgres`` stays decimal throughout, which is
    exact beyond 2^53 cents but slower.
    """
    c = F.col(cents) if isinstance(cents, str) else cents
    if dialect in ("default", "fabric"):
        return (c / 100).cast(MONEY)
    if dialect == "postgres":
        return (c.cast(MONEY) / F.lit(100)).cast(MONEY)
    if dialect == "bigquery":
        return F.round((c / 100).cast("decimal(38,9)"), 2)
    raise ValueError(f"unknown dialect {dialect!r}")


def _dbl(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b in double precision; NULL when b is 0 or either side is NULL."""
    return F.try_divide(_dbl(a), _dbl(b))


def round_half_away(x: Column | str, digits: int = 0) -> Column:
    """Round a double half away from zero at the binary value, the rule SQL engines use on doubles.

    ``F.round`` rounds the shortest decimal text instead (0.285 gives 0.29, not 0.28). The trailing ``+ 0.0`` turns
    a negative zero into zero.
    """
    v, scale = _dbl(x), float(10 ** digits)
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale + 0.0


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    """Round a double half to even, as dataframe libraries do."""
    scale = float(10 ** digits)
    return F.rint(_dbl(x) * scale) / scale + 0.0


def ratio_pct(a: Column | str, b: Column | str, digits: int) -> Column:
    """100 * a / b, rounded half away; NULL when b is 0."""
    return round_half_away(safe_div(a, b) * 100, digits)

"""Calendar and season column expressions.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluvio import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_sin(month="month") -> Column:
    return F.sin(F.lit(2 * math.pi) * _col(month) / 12)


def month_cos(month="month") -> Column:
    return F.cos(F.lit(2 * math.pi) * _col(month) / 12)


def is_wet(month="month") -> Column:
    """H3: wet season = months 11, 12, 1, 2."""
    return _col(month).isin(*C.WET_MONTHS)


def _by_season(month, wet: float, dry: float) -> Column:
    return F.when(is_wet(month), F.lit(wet)).otherwise(F.lit(dry))


def gate(month="month") -> Column:
    """H4: weight of the target-A model."""
    return _by_season(month, C.GATE_WET, C.GATE_DRY)


def disagreement_weight(month="month") -> Column:
    """H5."""
    return _by_season(month, C.DISAGREEMENT_WET, C.DISAGREEMENT_DRY)


def season_factor(month="month") -> Column:
    """H6."""
    return _by_season(month, C.SEASON_FACTOR_WET, C.SEASON_FACTOR_DRY)


def month_start(year="year", month="month") -> Column:
    """First day of the month at midnight (a datetime, as the original
    builds it from year, month and day 1), without a time zone."""
    return F.make_date(_col(year), _col(month), F.lit(1)).cast("timestamp_ntz")


def month_from_sin(sin_col="month_sin") -> Column:
    """The serving path's month recovery from its sine.

    int(round(asin(s) * 12 / 2pi) mod 12) + 1. It is lossy (months 1..12 map
    to 2,3,4,3,2,1,12,11,10,11,12,1); offered only as an opt-in gate mode.
    ``rint`` rounds half to even like NumPy's ``round``.
    """
    k = F.rint(F.asin(_col(sin_col)) * 12 / F.lit(2 * math.pi))
    return (F.pmod(k, F.lit(12.0)).cast("int") + 1).cast("int")

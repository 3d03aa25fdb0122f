"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant digits kept, and the finest decimal place.
DIGITS, PLACES = 9, 6
# Relative nudge applied before rounding: a value that sits on a rounding
# tie (x.xxxxxx5) can be computed one ulp below or above it depending on
# summation order; the nudge moves both onto the same side.
NUDGE = 1e-12


def round_value(c, digits: int = DIGITS, places: int = PLACES):
    """Nine significant digits, none finer than 1e-6: one rule for every value.

    The lambda over a one-element array names the value once, which keeps the
    generated code of wide results small.
    """
    def rule(v):
        k = F.least(F.lit(places), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
        scale = F.pow(F.lit(10.0), F.abs(k).cast("double"))
        return F.when(F.abs(v) < 0.5 * 10.0 ** -places, F.lit(0.0)).when(k >= 0, F.round(v * scale) / scale).otherwise(F.round(v / scale) * scale)

    return F.transform(F.array(c.cast("double") * F.lit(1.0 + NUDGE)), rule)[0]


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column (engines sum in different orders)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_value(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)

"""D9 / D10 from stored KLL sketches (``kll_sketch_agg_double``), merged for any span of years.

A row of the store is a station's year: its number of values and the sketch
of them. Sketches merge without the values (``kll_merge_agg_double``), so a
fence over any years or stations reads the store alone. Ranks of the answers are
within about ``1.7 / k^0.9`` of those asked (1.65 % at the default k of 200, for
one rank with 99 %), and a merge of up to k values holds them all. Quartiles are
values of the series (the least whose rank reaches the one asked), not
interpolated ones. Nulls count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvio import config as C

K = 200
#: Ranks at which a distribution is read for its MAD; adds half a step to the rank error.
STEPS = 400


def sketch_store(rows: DataFrame, value: str, keys=("station_id", "year"), k: int = K) -> DataFrame:
    """``keys, n, sketch``."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged(store: DataFrame, keys, k: int = K) -> DataFrame:
    """The store's sketches of each group as one."""
    return store.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def _quantile(q: float | Column) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(q) if isinstance(q, float) else q)


def fences(sketches: DataFrame, keys) -> DataFrame:
    """Quartiles and upper fence of each group's sketch."""
    q = sketches.select(*keys, "n", _quantile(0.25).alias("q1"), _quantile(0.75).alias("q3"))
    return q.withColumn("upper_fence", F.col("q3") + C.FENCE_K * (F.col("q3") - F.col("q1")))


def mad_sigma(sketches: DataFrame, keys) -> DataFrame:
    """1.4826 times the median distance from the median, read off the sketch at ``STEPS`` ranks."""
    ranks = F.array(*[F.lit((i + 0.5) / STEPS) for i in range(STEPS)])
    at = sketches.select(*keys, "n", _quantile(0.5).alias("m"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("v"))
    away = F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("m"))))
    return at.select(*keys, "n", F.col("m").alias("median"), (C.MAD_SCALE * F.get(away, F.lit(STEPS // 2 - 1))).alias("sigma"))

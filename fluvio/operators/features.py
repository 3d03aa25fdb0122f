"""Per-station feature derivation.

All lag and trailing-window columns share one window specification
(``partitionBy(station_id).orderBy(year, month)``), so Catalyst plans one
exchange and one sort for all of them. Lags are row based, like the
original: a missing calendar month shifts history (see ``calendar_gaps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.config import Splits
from fluvio.functions import season


def station_window() -> Window:
    return Window.partitionBy("station_id").orderBy("year", "month")


def pr_mean() -> Column:
    """H1."""
    return (F.col("pr_min") + F.col("pr_max")) / 2.0


def add_lag_features(panel: DataFrame) -> DataFrame:
    """E1-E5 plus H1 and the cyclic month (H2).

    * pr_lag1..3, y_lag1..3: ``lag`` by 1..3 rows.
    * pr_sum3 / y_rm3: sum / mean over rows t-3..t-1 (a rolling 3 with
      ``min_periods=1`` shifted by one), partial at the start of a station.
    * pr_api3 = 0.5 lag1 + 0.3 lag2 + 0.2 lag3 (null if any lag is null).
    """
    w = station_window()
    trailing = w.rowsBetween(-3, -1)
    wa, wb, wc = C.API_WEIGHTS
    base = panel.withColumn("pr_mean", pr_mean())
    cols = [
        F.lag("pr_mean", 1).over(w).alias("pr_lag1"),
        F.lag("pr_mean", 2).over(w).alias("pr_lag2"),
        F.lag("pr_mean", 3).over(w).alias("pr_lag3"),
        F.sum("pr_mean").over(trailing).alias("pr_sum3"),
        F.lag(C.TARGET_A, 1).over(w).alias("y_lag1"),
        F.lag(C.TARGET_A, 2).over(w).alias("y_lag2"),
        F.lag(C.TARGET_A, 3).over(w).alias("y_lag3"),
        F.avg(C.TARGET_A).over(trailing).alias("y_rm3"),
    ]
    out = base.select("*", *cols)
    return out.select(
        "*",
        (F.lit(wa) * F.col("pr_lag1") + F.lit(wb) * F.col("pr_lag2") + F.lit(wc) * F.col("pr_lag3")).alias("pr_api3"),
        season.month_sin().alias("month_sin"),
        season.month_cos().alias("month_cos"),
    )


def complete_cases(features: DataFrame) -> DataFrame:
    """B11 + B12: drop rows with a null in any needed column, then int casts."""
    out = features.dropna(subset=C.COMPLETE_CASE_COLUMNS)
    return out.withColumn("year", F.col("year").cast("int")).withColumn("month", F.col("month").cast("int"))


def split_label(splits: Splits = Splits(), year="year") -> Column:
    """Inclusive year ranges -> 'train' / 'val' / 'test' / null."""
    y = F.col(year) if isinstance(year, str) else year
    return (
        F.when(y.between(*splits.train), F.lit("train"))
        .when(y.between(*splits.val), F.lit("val"))
        .when(y.between(*splits.test), F.lit("test"))
    )


def add_split(df: DataFrame, splits: Splits = Splits()) -> DataFrame:
    return df.withColumn("split", split_label(splits))


def model_frame(panel: DataFrame, splits: Splits = Splits()) -> DataFrame:
    """The feature frame the learners see: features -> complete cases -> split."""
    return add_split(complete_cases(add_lag_features(panel)), splits)


def legacy_lags(panel: DataFrame, value: str = "flow") -> DataFrame:
    """Lag the this-month flow by 1..3 rows, then drop incomplete rows."""
    w = station_window()
    out = panel.select(
        "station_id", "year", "month", value,
        *[F.lag(value, k).over(w).alias(f"y_lag{k}") for k in (1, 2, 3)],
    )
    return out.dropna(subset=[value, "y_lag1", "y_lag2", "y_lag3"])


def holdout_bucket(key_cols=("station_id", "year", "month")) -> Column:
    """Stable 0..99 bucket from the md5 of the row key.

    Deterministic and independent of partitioning (unlike ``randomSplit``),
    mixes all parts of the key, and any SQL engine reproduces it.
    """
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in key_cols])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100).cast("int")


def hash_holdout(df: DataFrame, train_pct: int = 80) -> DataFrame:
    b = holdout_bucket()
    return df.withColumn("holdout", F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test")))


def legacy_frame(panel: DataFrame) -> DataFrame:
    """Input of the legacy trainer (I8): meteo, raw year / month and E6 lags of the this-month flow."""
    w = station_window()
    out = panel.select("station_id", "year", "month", "flow", *C.METEO_COLUMNS,
                       *[F.lag("flow", k).over(w).alias(f"y_lag{k}") for k in (1, 2, 3)])
    return out.dropna(subset=["flow", "y_lag1", "y_lag2", "y_lag3"] + C.METEO_COLUMNS)

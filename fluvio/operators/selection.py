"""Per-station top-k, sampling and latest-run selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n_per_station(df: DataFrame, n: int, keys=("station_id",), order=("year", "month")) -> DataFrame:
    """the last ``n`` rows of each station by (year, month).

    ``row_number`` over the station window; Spark plans a per-partition
    WindowGroupLimit before the exchange, so at most ``n`` rows per station
    and input partition are shuffled.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sample_rows(df: DataFrame, n: int = 1, seed: int = 42, key_cols=None) -> DataFrame:
    """``n`` rows picked uniformly at random, reproducibly.

    The md5 of the seed and the row key ranks the rows; ``orderBy(...).limit(n)``
    becomes a TakeOrderedAndProject (a per-partition top-n, then a merge of
    n rows per partition), so nothing but n rows per partition moves.
    """
    cols = key_cols or df.columns
    rank = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return df.withColumn("_r", rank).orderBy("_r").limit(n).drop("_r")


def latest_by(df: DataFrame, keys, ts: str) -> DataFrame:
    """per key, the whole row with the latest ``ts`` (``max_by`` over a struct)."""
    others = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(ts)).alias("_row"))
    return latest.select(*keys, "_row.*")

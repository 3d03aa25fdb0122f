"""D1-D7 from stored central moments, kept up by new rows without reading the old ones.

A partial row holds, for a group and a part of its rows, the number of rows,
both means, central second moments and co-moment, and the sums of the error, its
square and its size. Parts merge exactly: a merged second moment is the sum of
the parts' plus the sum of ``n (mean - merged mean)^2`` (for two parts the
pairwise formula), so nothing large is ever subtracted from something large and
the metrics hold at large means too. Rows without observation or prediction
count nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvio.operators.metrics import _div, _kling_gupta
from fluvio.streaming.streams import finish

PARTS = ("n", "mean_o", "mean_p", "m2_o", "m2_p", "co", "sum_d", "sum_d2", "sum_abs")


def partial_moments(rows: DataFrame, obs: str, pred: str, keys=("station_id",)) -> DataFrame:
    """One partial row for a group of ``rows`` (map-side combined, one shuffle)."""
    o, p = F.col("_o"), F.col("_p")
    both = rows.select(*keys, F.col(obs).cast("double").alias("_o"), F.col(pred).cast("double").alias("_p")).where("_o IS NOT NULL AND _p IS NOT NULL")
    n = F.count(F.lit(1))
    return both.groupBy(*keys).agg(
        n.alias("n"), F.avg(o).alias("mean_o"), F.avg(p).alias("mean_p"), (F.var_pop(o) * n).alias("m2_o"), (F.var_pop(p) * n).alias("m2_p"),
        (F.covar_pop(o, p) * n).alias("co"), F.sum(o - p).alias("sum_d"), F.sum((o - p) * (o - p)).alias("sum_d2"), F.sum(F.abs(o - p)).alias("sum_abs"))


def merge_moments(parts: DataFrame, keys=("station_id",)) -> DataFrame:
    """One row for a group from any number of partial rows."""
    w = Window.partitionBy(*keys)
    mean = lambda c: (F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w))
    apart = parts.select("*", mean("mean_o").alias("_mo"), mean("mean_p").alias("_mp"))
    do, dp, n = F.col("mean_o") - F.col("_mo"), F.col("mean_p") - F.col("_mp"), F.col("n")
    return apart.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("_mo").alias("mean_o"), F.max("_mp").alias("mean_p"), F.sum(F.col("m2_o") + n * do * do).alias("m2_o"),
        F.sum(F.col("m2_p") + n * dp * dp).alias("m2_p"), F.sum(F.col("co") + n * do * dp).alias("co"), *[F.sum(c).alias(c) for c in PARTS[6:]])


def skill_from_moments(merged: DataFrame, keys=("station_id",)) -> DataFrame:
    """D1-D7 with the conventions of ``metrics.skill_expr_map``."""
    n, ss_res, ss_tot = F.col("n"), F.col("sum_d2"), F.col("m2_o")
    fit = F.lit(1.0) - F.try_divide(ss_res, ss_tot)
    r = _div(F.col("co"), F.sqrt(F.col("m2_o")) * F.sqrt(F.col("m2_p")))
    sd = lambda c: F.sqrt(F.try_divide(F.col(c), n - 1))
    return merged.select(
        *keys, "n", F.sqrt(F.try_divide(ss_res, n)).alias("rmse"), F.try_divide(F.col("sum_abs"), n).alias("mae"),
        F.when(n >= 2, F.when(ss_tot != 0, fit).otherwise(F.when(ss_res == 0, 1.0).otherwise(0.0))).alias("r2"), F.when(ss_tot != 0, fit).alias("nse"),
        _kling_gupta(r, F.col("mean_p"), F.col("mean_o"), sd("m2_p"), sd("m2_o")).alias("kge"),
        (F.lit(100.0) * _div(F.col("sum_d"), n * F.col("mean_o"))).alias("pbias"), r.alias("pearson"))


def moments_stream(rows: DataFrame, obs: str, pred: str, path: str, checkpoint: str, keys=("station_id",), timeout_s: float | None = None) -> None:
    """Add a stream's rows to the stored partial rows; a micro-batch that is replayed overwrites its own part."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        partial_moments(batch, obs, pred, keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    finish(rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), timeout_s)


def read_moments(spark: SparkSession, path: str, keys=("station_id",)) -> DataFrame:
    return spark.read.parquet(path).select(*keys, *PARTS)

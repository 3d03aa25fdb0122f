"""Temp views over the engine's DataFrames, for ``spark.sql`` users.

``register_views(spark, sf_dir)`` names the panel, the feature frame, the
flagship band and the geo records; Catalyst plans SQL over them exactly as
the DataFrame API (same pruning, pushdown and exchanges).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fluvio.config import Splits
from fluvio.operators import features as feat
from fluvio.plans import evaluate as ev
from fluvio.sources import panel as P
from fluvio.sources import records


def register_views(spark: SparkSession, sf_dir: str, splits: Splits = Splits()) -> list[str]:
    panel = P.station_month(spark, sf_dir)
    frame = feat.model_frame(panel, splits)
    views = {
        "station_month": panel,
        "station_features": frame,
        "station_band": ev.with_band(ev.stand_in_predictions(frame)),
        "observations": records.observations(spark, sf_dir),
        "forecasts": records.forecasts(spark, sf_dir),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)

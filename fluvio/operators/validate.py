"""Request validation and missing-feature fills.

Validation never raises: each rule yields a message or NULL, the messages
are compacted into a ``violations`` array, and the batch splits into
accepted and quarantined rows. ``accepted + quarantined = all`` by
construction (one predicate and its negation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio import config as C


def violation_messages(features=C.REQUEST_FEATURES) -> Column:
    """Array of rule violations (empty when the request is valid)."""
    y, m = F.col("year"), F.col("month")
    rules = [
        F.when(y.isNull(), F.lit("missing year")),
        F.when(m.isNull(), F.lit("missing month")),
        F.when(~y.between(C.REQUEST_YEAR_MIN, C.REQUEST_YEAR_MAX),
               F.lit(f"year out of range [{C.REQUEST_YEAR_MIN}, {C.REQUEST_YEAR_MAX}]")),
        F.when(~m.between(1, 12), F.lit("month out of range [1, 12]")),
    ]
    rules += [F.when(F.col(c).isNull() | F.isnan(c), F.lit(f"missing {c}")) for c in features]
    return F.array_compact(F.array(*rules))


def with_violations(requests: DataFrame, features=C.REQUEST_FEATURES) -> DataFrame:
    """Adds the expected-minus-present columns as NULLs first, then the messages."""
    present = set(requests.columns)
    out = requests
    for c in features:
        if c not in present:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.withColumn("violations", violation_messages(features))
    if "_corrupt_record" in present:
        broken = F.col("_corrupt_record").isNotNull()
        out = out.withColumn("violations", F.when(broken, F.array(F.lit("unreadable request"))).otherwise(F.col("violations")))
    return out


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = with_violations(requests)
    ok = F.size("violations") == 0
    return v.where(ok), v.where(~ok)


def fill_zero(df: DataFrame, features=C.FEATURE_COLUMNS) -> DataFrame:
    """Absent feature column -> 0, null -> 0 (bulk predict path)."""
    out = df
    for c in features:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    return out.fillna(0.0, subset=list(features))


def train_means(frame: DataFrame, features=C.REQUEST_FEATURES, split: str = "train") -> DataFrame:
    """Per-station mean of each feature over the train years (one row per station)."""
    rows = frame.where(F.col("split") == split)
    return rows.groupBy("station_id").agg(*[F.avg(c).alias(f"_mean_{c}") for c in features])


def fill_train_mean(requests: DataFrame, frame: DataFrame, features=C.REQUEST_FEATURES,
                    split: str = "train") -> DataFrame:
    """Null feature -> the station's train mean.

    The means table has one row per station. It is joined on ``station_id``
    without a broadcast hint: AQE measures it at runtime and broadcasts it
    only when it is under ``spark.sql.autoBroadcastJoinThreshold``;
    otherwise it stays a shuffled join.
    """
    means = train_means(frame, features, split)
    return fill_from_means(requests.join(means, "station_id", "left"), features)


def with_train_means(frame: DataFrame, features=C.REQUEST_FEATURES, split: str = "train") -> DataFrame:
    """The frame with each station's train means (``_mean_<feature>``) on every row: one window, no join."""
    ws = Window.partitionBy("station_id")
    rows = F.col("split") == split
    return frame.select("*", *[F.avg(F.when(rows, F.col(c))).over(ws).alias(f"_mean_{c}") for c in features])


def fill_from_means(requests: DataFrame, features=C.REQUEST_FEATURES) -> DataFrame:
    """B16 for rows that carry ``_mean_<feature>``; absent features are filled too."""
    have = [c for c in requests.columns if not c.startswith("_mean_")]
    value = lambda c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) if c in have else F.col(f"_mean_{c}")
    return requests.select(*[c for c in have if c not in features], *[value(c).alias(c) for c in features])

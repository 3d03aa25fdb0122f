"""Structured Streaming entry points (section 2.10 re-aim).

The original has no streams. Its stateless operators (B1-B9 listings, B14
validation, I6 scoring) are DataFrame functions, so they run unchanged on a
streaming DataFrame. Requests are answered once each, whatever is resent, by
the run that is committed at the time. Lag features (row-frame windows, which
Structured Streaming has not) are in ``streaming.lags``.

Sinks are file sinks or ``foreachBatch`` with a checkpoint location in the
shared folder, so a restarted query resumes exactly where it stopped and a
lost executor only re-runs its tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluvio.operators.catalog import filter_observations
from fluvio.operators.validate import with_violations
from fluvio.plans import registry
from fluvio.plans.learn import TrainedEnsemble
from fluvio.plans.score import Predictor, score_requests
from fluvio.sources.records import normalize_observations, observations_raw_from_events
from fluvio.sources.schemas import REQUEST


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream (schema from the parquet footer, no inference)."""
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{base}/{name}.parque[t]")  # a pattern that only this name fits: a stream takes a lone file by pattern


def observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_observations(observations_raw_from_events(table_stream(spark, sf_dir, "events")))


def request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A4 as a stream: JSON request files with the declared schema."""
    r = spark.readStream.schema(REQUEST)
    return (r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r).json(path)


def finish(q: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait until an ``availableNow`` query has processed everything.

    Without ``timeout_s`` it takes as long as it takes. A given limit that
    expires stops the query and raises: what was committed so far is not the
    whole result, and a restart on the same checkpoint goes on from there.
    """
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"the stream was not done after {timeout_s} s; its sink is incomplete")
    if q.exception() is not None:
        raise q.exception()


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      timeout_s: float | None = None) -> None:
    """Process everything available, then stop (the test and batch-catch-up trigger)."""
    finish(df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start(), timeout_s)


def filtered_observations(spark: SparkSession, sf_dir: str, geometry_type=None, data_type=None) -> DataFrame:
    return filter_observations(observation_stream(spark, sf_dir), geometry_type, data_type)


def once_per_request(requests: DataFrame, window: str = "7 days") -> DataFrame:
    """Each ``request_id`` once: one that was seen within ``window`` of arrival is not passed on again.

    The state holds the ids of that window, however many batches or restarts lie
    between. Time is that of the micro-batch in which a request arrives, so none
    is ever late; a request that comes again after the window is a new one. Rows
    without an id (unreadable lines) count as resent if they are wholly equal.
    """
    whole = F.concat(F.lit("line:"), F.sha2(F.to_json(F.struct("*")), 256))
    seen = requests.select("*", F.coalesce("request_id", whole).alias("_id"), F.current_timestamp().alias("_arrived"))
    return seen.withWatermark("_arrived", window).dropDuplicatesWithinWatermark(["_id"]).drop("_id", "_arrived")


#: What answers a micro-batch: the predictor, its run rows (or None) and the run's id (or None).
Service = tuple[Predictor, DataFrame | None, str | None]


class CommittedService:
    """The latest committed run below ``root``, looked up whenever it is called; a model is loaded once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.loaded = spark, root, (None, None)

    def __call__(self) -> Service:
        runs = registry.committed_runs(self.spark, self.root)
        last = runs.agg(F.max_by(F.struct("run_id", "model_path"), F.struct("trained_on", "run_id")).alias("r")).first().r
        if last is None:
            raise LookupError(f"no committed run below {self.root}")
        if self.loaded[0] != last.run_id:
            self.loaded = (last.run_id, TrainedEnsemble.load(last.model_path))
        return self.loaded[1], runs.where(F.col("run_id") == last.run_id), last.run_id


def score_request_stream(requests: DataFrame, service: Callable[[], Service], accepted_path: str, quarantine_path: str, checkpoint: str,
                         timeout_s: float | None = None, window: str = "7 days") -> None:
    """B14 + I6 on a request stream: accepted requests are scored once each, rejected ones quarantined.

    ``service`` is asked for every micro-batch, so a run that is committed while
    the stream goes on answers the next one; scored rows name their run. One
    ``foreachBatch`` writes both outputs of a micro-batch, and a replayed batch
    overwrites its own directories.
    """
    v = with_violations(once_per_request(requests, window))

    def sink(batch: DataFrame, batch_id: int) -> None:
        ens, runs, run_id = service()
        batch.persist()
        ok = F.size("violations") == 0
        scored = score_requests(batch.where(ok).drop("violations"), ens, runs).withColumn("run_id", F.lit(run_id).cast("string"))
        scored.write.mode("overwrite").parquet(f"{accepted_path.rstrip('/')}/batch={batch_id}")
        (batch.where(~ok).select("request_id", "station_id", "year", "month", "violations")
         .write.mode("overwrite").parquet(f"{quarantine_path.rstrip('/')}/batch={batch_id}"))
        batch.unpersist()

    finish(v.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), timeout_s)

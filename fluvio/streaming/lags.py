"""E1-E5 on a stream of station months (``transformWithState``).

Each station's state holds its last three emitted months and the months that
wait, as one value that a batch reads and writes once for a station, however many
months it brings. A month is emitted with its lags once the watermark (the latest month seen
anywhere, less ``delay``, in which Spark counts a month as 31 days) has passed it, in calendar order whatever the order of
arrival, so the rows equal ``operators.features.add_lag_features`` over the same
months however they are split into files and batches.

Defined results: a month that arrives after the watermark passed it is late and
not emitted (Spark counts it in ``numRowsDroppedByWatermark``); of several rows
for one month that arrive before its emission, the first to arrive counts, and
of those in one batch the least by (pr_mean, flow). Months that wait when a run
ends stay in the checkpoint for the next run; ``closing_row`` ends a stream for
good: it moves the watermark past all months.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluvio import config as C
from fluvio.functions import season
from fluvio.operators.features import pr_mean

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NAMES = ("station_id", "year", "month", "pr_mean", C.TARGET_A, "pr_lag1", "pr_lag2", "pr_lag3", "pr_sum3", "y_lag1", "y_lag2", "y_lag3", "y_rm3", "pr_api3")
_OUT = "station_id long, year int, month int, " + ", ".join(f"{c} double" for c in _NAMES[3:])
#: Station of a closing row.
NO_STATION = -1


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that ``transformWithState`` asks for; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def closing_row(spark: SparkSession, like: DataFrame) -> DataFrame:
    """One row in the schema of ``like`` that ends a stream of it."""
    values = {"station_id": F.lit(NO_STATION), "year": F.lit(9999), "month": F.lit(1)}
    return spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _processor(weights: tuple[float, float, float], no_station: int, names: tuple[str, ...]) -> StatefulProcessor:
    emitted = Row(*names)

    class Lags(StatefulProcessor):  # defined here, so that it travels to the workers by value
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # every call to the state is a round trip to the JVM, so a station's whole state is one value:
            # the last month emitted, its last three values, and the months that wait, ascending
            self.last = handle.getValueState("last", "month int, pr array<double>, y array<double>, "
                                             "waiting array<int>, waiting_pr array<double>, waiting_y array<double>")

        def handleInputRows(self, key, rows, timerValues):
            if key[0] != no_station:
                least = lambda r: (r.pr_mean is not None, r.pr_mean or 0.0, r.y is not None, r.y or 0.0)
                new = {}
                for r in rows:
                    m = r.year * 12 + r.month - 1
                    if m not in new or least(r) < least(new[m]):
                        new[m] = r
                done, pr, y, *waiting = self.last.get() or (None, [], [], [], [], [])
                months = {m: (p, q) for m, p, q in zip(*waiting)}
                before = min(months, default=None)
                for m, r in new.items():
                    if (done is None or m > done) and m not in months:
                        months[m] = (r.pr_mean, r.y)
                if len(months) > len(waiting[0]):
                    self._keep(done, pr, y, months)
                    if min(months) != before:
                        self._wake(min(months))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            from datetime import datetime, timezone

            passed = datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000, timezone.utc)
            limit = passed.year * 12 + passed.month - 1
            done, pr, y, *waiting = self.last.get()
            months = {m: (p, q) for m, p, q in zip(*waiting)}
            ready = [m for m in sorted(months) if m <= limit]
            if not ready:
                return  # an earlier timer of this batch emitted them
            pr, y = list(pr), list(y)
            for m in ready:
                now = months.pop(m)
                lag = lambda v, k: v[-k] if len(v) >= k else None
                p, q = [[lag(v, k) for k in (1, 2, 3)] for v in (pr, y)]
                sums = [[x for x in v if x is not None] for v in (p[::-1], q[::-1])]
                api = None if None in p else sum(w * x for w, x in zip(weights, p))
                yield emitted(key[0], m // 12, m % 12 + 1, now[0], now[1], *p, sum(sums[0]) if sums[0] else None, *q,
                          sum(sums[1]) / len(sums[1]) if sums[1] else None, api)
                pr, y = [*pr, now[0]][-3:], [*y, now[1]][-3:]
            self._keep(ready[-1], pr, y, months)
            if months:
                self._wake(min(months))

        def _keep(self, done, pr, y, months) -> None:
            waiting = sorted(months)
            self.last.update((done, list(pr), list(y), waiting, [months[m][0] for m in waiting], [months[m][1] for m in waiting]))

        def _wake(self, month) -> None:
            """A station has a timer at its earliest waiting month: the others follow from there."""
            from datetime import datetime, timezone

            self.handle.registerTimer(int(datetime(month // 12, month % 12 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000))

        def close(self) -> None:
            pass

    return Lags()


def lag_stream(panel: DataFrame, delay: str = "3 months") -> DataFrame:
    """E1-E5, H1 and H2 of a streaming panel: ``station_id, year, month, pr_mean, flow_next_month`` and the features.

    Run it inside ``rocksdb(spark)``.
    """
    at = F.make_timestamp("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0.0), F.lit("UTC"))
    rows = panel.select(F.col("station_id").cast("long").alias("station_id"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
                        pr_mean().alias("pr_mean"), F.col(C.TARGET_A).cast("double").alias("y"), at.alias("at"))
    out = rows.withWatermark("at", delay).groupBy("station_id").transformWithState(
        statefulProcessor=_processor(tuple(C.API_WEIGHTS), NO_STATION, _NAMES), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return out.withColumns({"month_sin": season.month_sin(), "month_cos": season.month_cos()})

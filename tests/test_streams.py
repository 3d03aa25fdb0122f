"""Stateful streams: lags of months in any order, requests answered once, and the run of the moment."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.operators import features as feat
from fluvio.streaming import lags, streams

COLS = ["station_id", "year", "month", "pr_mean", "pr_lag1", "pr_lag2", "pr_lag3", "pr_sum3", "pr_api3", "y_lag1", "y_lag2", "y_lag3", "y_rm3"]
PANEL = f"station_id long, year int, month int, pr_min double, pr_max double, {C.TARGET_A} double"


def months(seed=1):
    rng = random.Random(seed)
    out = []
    for s in (1, 2, 3):
        for m in range(2000 * 12, 2000 * 12 + 30):
            if rng.random() > 0.15:  # gaps shift history, as in batch
                v = rng.choice([None, rng.uniform(0, 9)])
                out.append((s, m // 12, m % 12 + 1, v, rng.uniform(9, 20), rng.choice([None, rng.uniform(1, 50)])))
    return out


def run(spark, path, files, delay, at_a_time=1, close=True):
    base = str(path)
    for f in files:
        spark.createDataFrame(f, PANEL).coalesce(1).write.mode("append").parquet(base + "/months")
    if close:
        like = spark.createDataFrame([], PANEL)
        lags.closing_row(spark, like).coalesce(1).write.mode("append").parquet(base + "/months")
    stream = spark.readStream.schema(PANEL).option("maxFilesPerTrigger", at_a_time).parquet(base + "/months")
    with lags.rocksdb(spark):
        streams.run_available_now(lags.lag_stream(stream, delay), base + "/lags", base + "/ck")
    return rows(spark.read.parquet(base + "/lags"))


def rows(df):
    show = lambda v: v if v is None or isinstance(v, int) else round(v, 9)
    return sorted([tuple(show(v) for v in r) for r in df.select(*COLS).collect()], key=repr)


@pytest.mark.parametrize("split", ["shuffled", "in_order"])
def test_lags_equal_batch_however_files_are_cut(spark, tmp_path, split):
    data = months()
    want = rows(feat.add_lag_features(spark.createDataFrame(data, PANEL)))
    if split == "shuffled":
        random.Random(2).shuffle(data)
    else:
        data.sort(key=lambda r: (r[1], r[2]))
    cut = [data[a:b] for a, b in ((0, 25), (25, 31), (31, len(data)))]
    assert run(spark, tmp_path, cut, "40 months" if split == "shuffled" else "1 month") == want


def test_late_and_repeated_months_and_a_restart(spark, tmp_path):
    row = lambda m, pr, y=1.0: (1, 2000, m, pr, pr, y)
    # Month 2 comes again in the same batch (least counts) and later (first counts); month 1 comes after month 3 was emitted.
    files = [[row(2, 5.0), row(2, 3.0), row(3, 7.0)], [row(2, 1.0), row(6, 2.0)], [row(7, 4.0)], [row(1, 9.0), row(8, 8.0)]]
    got = run(spark, tmp_path, files, "2 months", close=False)
    assert [(r[2], r[3], r[4]) for r in got] == [(2, 3.0, None), (3, 7.0, 3.0)]  # later months wait in the checkpoint
    got = run(spark, tmp_path, [[row(9, 6.0)]], "2 months")  # a second run on the same checkpoint, closed
    assert [(r[2], r[3], r[4]) for r in got][2:] == [(6, 2.0, 7.0), (7, 4.0, 2.0), (8, 8.0, 4.0), (9, 6.0, 8.0)]


def request(spark, ids, sf_small):
    from fluvio.queries import _frame
    from fluvio.sources.requests import requests_from_frame
    one = requests_from_frame(_frame(spark, sf_small)).where("pmod(station_id + month, 7) > 3").limit(1)
    return one.drop("request_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "request_id string")).checkpoint()


class Constant:
    """A predictor whose forecast is ``value``."""

    def __init__(self, value):
        self.value = value

    def transform(self, df):
        return df.select("*", F.lit(self.value).alias("pred_A"), F.lit(self.value).alias("pred_B"))


def test_resent_requests_and_a_run_committed_between_batches(spark, sf_small, tmp_path):
    base = str(tmp_path)
    send = lambda ids: request(spark, ids, sf_small).coalesce(1).write.mode("append").json(base + "/requests")
    asked = []

    def service():  # the second micro-batch finds a newer run
        asked.append(1)
        n = len(asked)
        return Constant(10.0 * n), None, f"run{n}"

    def score():
        streams.score_request_stream(streams.request_stream(spark, base + "/requests", 1), service, base + "/ok", base + "/bad", base + "/ck")
        return {r.request_id: (r.run_id, r.predicted_flow) for r in spark.read.parquet(base + "/ok").collect()}, spark.read.parquet(base + "/ok").count()

    send(["a", "b", "a"])
    send(["b", "c", None, None])
    got, n = score()
    assert got == {"a": ("run1", 10.0), "b": ("run1", 10.0), "c": ("run2", 20.0), None: ("run2", 20.0)} and n == 4
    send(["a", "c", "d"])  # resent over a restart
    got, n = score()
    assert got["a"] == ("run1", 10.0) and got["c"] == ("run2", 20.0) and got["d"][0].startswith("run") and n == 5


def test_no_committed_run_raises(spark, tmp_path):
    with pytest.raises(LookupError):
        streams.CommittedService(spark, str(tmp_path))()


class Counted:
    """State of one station in memory, counting the calls to it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def _call(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return type("Map", (), {"containsKey": lambda _, k: self._call(k in self.map), "updateValue": lambda _, k, v: self._call(self.map.update({k: v})),
                                "keys": lambda _: self._call(list(self.map)), "getValue": lambda _, k: self._call(self.map[k]), "removeKey": lambda _, k: self._call(self.map.pop(k))})()

    def exists(self):
        return self._call(self.value is not None)

    def get(self):
        return self._call(self.value)

    def update(self, value):
        self._call()
        self.value = value

    def registerTimer(self, ms):
        self._call()
        self.timers.append(ms)


def test_state_calls_of_a_station_do_not_grow_with_its_months():
    from datetime import datetime, timezone
    from types import SimpleNamespace

    at = lambda m: datetime(m // 12, m % 12 + 1, 1, tzinfo=timezone.utc)

    def feed(n):
        state = Counted()
        p = lags._processor(tuple(C.API_WEIGHTS), lags.NO_STATION, lags._NAMES)
        p.init(state)
        rows = [Row(year=m // 12, month=m % 12 + 1, pr_mean=float(m), y=1.0, at=at(m)) for m in range(24000, 24000 + n)]
        for part in (rows[n // 2:], rows[:n // 2]):  # the later half first: its timer is not the earliest
            assert list(p.handleInputRows((7,), iter(part), None)) == []
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: int(at(24000 + n).timestamp() * 1000))
        out = [r for _ in list(state.timers) for r in p.handleExpiredTimer((7,), now, None)]
        assert [(r.year * 12 + r.month - 1, r.pr_lag1) for r in out] == [(m, float(m - 1) if m > 24000 else None) for m in range(24000, 24000 + n)]
        return state.calls

    assert feed(60) == feed(10) < 12


def test_served_rows_are_made_once_for_all_batches(spark, sf_small, monkeypatch):
    from fluvio.queries import QUERIES

    asked, whole = [], streams.score_request_stream

    def score(requests, service, *paths):
        asked.append(service())
        whole(requests, service, *paths)

    monkeypatch.setattr(streams, "score_request_stream", score)
    QUERIES["stream_score"](spark, sf_small)
    for model, runs, _ in asked:
        for df in (model.offsets, runs):  # neither is derived from the facts again
            assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())

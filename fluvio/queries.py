"""Named queries over the driver tables, each with an SQL oracle when one exists.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``
(DuckDB SQL over the same tables). Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio import oracles as O
from fluvio.config import Splits
from fluvio.functions import season
from fluvio.functions import uncertainty as U
from fluvio.operators import calendar, features as feat, robust
from fluvio.plans import evaluate as ev
from fluvio.plans.output import rounded
from fluvio.sources import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLITS = Splits()


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _panel(spark, sf_dir) -> DataFrame:
    return P.station_month(spark, sf_dir)


def _frame(spark, sf_dir) -> DataFrame:
    return feat.model_frame(_panel(spark, sf_dir), SPLITS)


def _band(spark, sf_dir, scale=C.SCALE_SERVING_DEFAULT) -> DataFrame:
    return ev.with_band(ev.stand_in_predictions(_frame(spark, sf_dir)), scale)


# --- flagship -----------------------------------------------------------------

@query("station_skill", O.station_report_sql(SPLITS))
def station_skill(spark, sf_dir):
    """Skill and band coverage per station over the test years (flagship)."""
    return rounded(ev.evaluate(_panel(spark, sf_dir), SPLITS))


# --- features (E1-E6, H1, H2, F1) ---------------------------------------------

_R = O.r
_KEYS = "station_id, year, month"


@query("lag_features", f"""WITH {O.features_cte()}
SELECT {_KEYS}, {_R('pr_mean', 'pr_mean')}, {_R('pr_lag1', 'pr_lag1')}, {_R('pr_lag2', 'pr_lag2')},
       {_R('pr_lag3', 'pr_lag3')}, {_R('y_lag1', 'y_lag1')}, {_R('y_lag2', 'y_lag2')}, {_R('y_lag3', 'y_lag3')}
FROM features""")
def lag_features(spark, sf_dir):
    f = feat.add_lag_features(_panel(spark, sf_dir))
    return rounded(f.select("station_id", "year", "month", "pr_mean", "pr_lag1", "pr_lag2", "pr_lag3",
                            "y_lag1", "y_lag2", "y_lag3"))


@query("trailing_sum_mean", f"""WITH {O.features_cte()}
SELECT {_KEYS}, {_R('pr_sum3', 'pr_sum3')}, {_R('y_rm3', 'y_rm3')},
       {_R('pr_lag1 + pr_lag2 + pr_lag3', 'pr_sum3_full')}
FROM features""")
def trailing_sum_mean(spark, sf_dir):
    """E3/E4 before the complete-case filter (partial windows at the start)."""
    f = feat.add_lag_features(_panel(spark, sf_dir))
    return rounded(f.select("station_id", "year", "month", "pr_sum3", "y_rm3",
                            (F.col("pr_lag1") + F.col("pr_lag2") + F.col("pr_lag3")).alias("pr_sum3_full")))


@query("antecedent_index", f"""WITH {O.features_cte()}
SELECT {_KEYS}, {_R('pr_api3', 'pr_api3')} FROM features""")
def antecedent_index(spark, sf_dir):
    f = feat.add_lag_features(_panel(spark, sf_dir))
    return rounded(f.select("station_id", "year", "month", "pr_api3"))


@query("legacy_lags", f"""WITH {O.panel_cte()},
l AS (SELECT {_KEYS}, flow, lag(flow, 1) OVER w AS y_lag1, lag(flow, 2) OVER w AS y_lag2,
             lag(flow, 3) OVER w AS y_lag3
      FROM panel WINDOW w AS (PARTITION BY station_id ORDER BY year, month))
SELECT {_KEYS}, {_R('flow', 'flow')}, {_R('y_lag1', 'y_lag1')}, {_R('y_lag2', 'y_lag2')}, {_R('y_lag3', 'y_lag3')}
FROM l WHERE flow IS NOT NULL AND y_lag1 IS NOT NULL AND y_lag2 IS NOT NULL AND y_lag3 IS NOT NULL""")
def legacy_lags(spark, sf_dir):
    return rounded(feat.legacy_lags(_panel(spark, sf_dir)))


@query("cyclic_month", f"""WITH {O.panel_cte()}
SELECT {_KEYS}, {_R('sin(2 * pi() * month / 12)', 'month_sin')}, {_R('cos(2 * pi() * month / 12)', 'month_cos')}
FROM panel""")
def cyclic_month(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(p.select("station_id", "year", "month", season.month_sin().alias("month_sin"),
                            season.month_cos().alias("month_cos")))


@query("season_weights", f"""WITH {O.panel_cte()}
SELECT {_KEYS}, {O.wet()} AS is_wet, {_R(O.gate(), 'gate')}, {_R(O.disagreement(), 'disagreement_weight')},
       {_R(O.season_factor(), 'season_factor')}
FROM panel""")
def season_weights(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(p.select("station_id", "year", "month", season.is_wet().alias("is_wet"),
                            season.gate().alias("gate"), season.disagreement_weight().alias("disagreement_weight"),
                            season.season_factor().alias("season_factor")))


# --- complete cases, split, summary (B10-B13, D16) ------------------------------

@query("complete_cases", f"""WITH {O.frame_cte(SPLITS)}
SELECT {_KEYS}, {', '.join(_R(c, c) for c in C.FEATURE_COLUMNS)}, {_R('flow_next_month', 'flow_next_month')},
       {_R('flow_next_month_max', 'flow_next_month_max')} FROM frame""")
def complete_cases(spark, sf_dir):
    """Rows that survive the complete-case filter, in feature order."""
    f = feat.complete_cases(feat.add_lag_features(_panel(spark, sf_dir)))
    return rounded(f.select("station_id", "year", "month", *C.FEATURE_COLUMNS, C.TARGET_A, C.TARGET_B))


@query("temporal_split", f"""WITH {O.frame_cte(SPLITS)}
SELECT {_KEYS}, split FROM frame""")
def temporal_split(spark, sf_dir):
    return _frame(spark, sf_dir).select("station_id", "year", "month", "split")


@query("split_summary", f"""WITH {O.frame_cte(SPLITS)}
SELECT station_id, split, count(*) AS n_rows, min(year) AS min_year, max(year) AS max_year
FROM frame WHERE split IS NOT NULL GROUP BY station_id, split""")
def split_summary(spark, sf_dir):
    from fluvio.operators.metrics import split_summary as summ
    return summ(_frame(spark, sf_dir))


# --- calendar gaps (C2) ---------------------------------------------------------

@query("calendar_gaps", f"""WITH {O.panel_cte()},
rng AS (SELECT min(year * 12 + month - 1) AS lo, max(year * 12 + month - 1) AS hi FROM panel),
stations AS (SELECT DISTINCT station_id FROM panel),
spine AS (SELECT station_id, unnest(generate_series(lo, hi)) AS idx FROM stations, rng)
SELECT s.station_id, CAST(s.idx // 12 AS INTEGER) AS year, CAST(s.idx % 12 + 1 AS INTEGER) AS month
FROM spine s ANTI JOIN panel p ON p.station_id = s.station_id AND p.year * 12 + p.month - 1 = s.idx""")
def calendar_gaps(spark, sf_dir):
    return calendar.calendar_gaps(_panel(spark, sf_dir))


# --- holdout split (I7) ---------------------------------------------------------

@query("hash_holdout", f"""WITH {O.frame_cte(SPLITS)}
SELECT {_KEYS}, CASE WHEN CAST('0x' || substr(md5(concat_ws('-', station_id, year, month)), 1, 8) AS BIGINT) % 100 < 80
                THEN 'train' ELSE 'test' END AS holdout FROM frame""")
def hash_holdout(spark, sf_dir):
    return feat.hash_holdout(_frame(spark, sf_dir)).select("station_id", "year", "month", "holdout")


# --- robust statistics (D9, D10, C1) ----------------------------------------------

@query("upper_fence", f"""WITH {O.frame_cte(SPLITS)}
SELECT station_id, {_R('quantile_cont(flow_next_month, 0.25)', 'q1')}, {_R('quantile_cont(flow_next_month, 0.75)', 'q3')},
       {_R(f'quantile_cont(flow_next_month, 0.75) + {C.FENCE_K} * (quantile_cont(flow_next_month, 0.75) - quantile_cont(flow_next_month, 0.25))', 'upper_fence')}
FROM frame WHERE split = 'train' GROUP BY station_id""")
def upper_fence(spark, sf_dir):
    f = _frame(spark, sf_dir).where(F.col("split") == "train")
    return rounded(robust.upper_fence_by_station(f, C.TARGET_A))


@query("sketch_fence", f"""WITH {O.frame_cte(SPLITS)},
s AS (SELECT station_id, CASE WHEN year <= 1996 THEN 'early' ELSE 'late' END AS span, flow_next_month AS v FROM frame WHERE split = 'train'
      UNION ALL SELECT station_id, 'all', flow_next_month FROM frame WHERE split = 'train'),
r AS (SELECT *, row_number() OVER (PARTITION BY station_id, span ORDER BY v) AS i, count(*) OVER (PARTITION BY station_id, span) AS n FROM s),
q AS (SELECT station_id, span, max(n) AS n, min(v) FILTER (WHERE i >= 0.25 * n) AS q1, min(v) FILTER (WHERE i >= 0.75 * n) AS q3 FROM r GROUP BY station_id, span)
SELECT station_id, span, n, {_R('q1', 'q1')}, {_R('q3', 'q3')}, {_R(f'q3 + {C.FENCE_K} * (q3 - q1)', 'upper_fence')} FROM q""")
def sketch_fence(spark, sf_dir):
    """D9 from a store of one sketch for a station and year: the fences of three spans read the store, not the months.
    (A station has fewer months than a sketch holds, so its quartiles are exact; tests hold larger merges to the bound.)"""
    from fluvio.operators import sketches
    from fluvio.session import scratch_path
    path = scratch_path(spark, "sketches")
    sketches.sketch_store(_frame(spark, sf_dir).where(F.col("split") == "train"), C.TARGET_A).write.parquet(path)
    store = spark.read.parquet(path)
    span = F.array(F.lit("all"), F.when(F.col("year") <= 1996, "early").otherwise("late"))
    store = store.withColumn("span", F.explode(span))
    return rounded(sketches.fences(sketches.merged(store, ("station_id", "span")), ("station_id", "span")))


@query("mad_sigma", f"""WITH {O.band_cte(SPLITS)}
SELECT station_id, {_R('max(sigma_A)', 'sigma_A')}, {_R('max(sigma_B)', 'sigma_B')} FROM band
WHERE split = 'test' GROUP BY station_id""")
def mad_sigma(spark, sf_dir):
    scored = ev.stand_in_predictions(_frame(spark, sf_dir))
    res = {"A": F.col(C.TARGET_A) - F.col("pred_A"), "B": F.col(C.TARGET_B) - F.col("pred_B")}
    out = robust.mad_sigma_by_station(scored, res, where=F.col("split") == "test")
    return rounded(out.where(F.col("sigma_A").isNotNull()).select("station_id", "sigma_A", "sigma_B"))


# --- mixing, sigma and band (H7-H14, H24, H19, H16) --------------------------------

_TEST = "split = 'test'"


@query("gated_mix", f"""WITH {O.band_cte(SPLITS)}
SELECT {_KEYS}, {_R('pred_A', 'learner_avg')}, {_R('0.6 * y_lag1 + 0.4 * y_rm3', 'learner_avg_legacy')},
       {_R('g', 'g')}, {_R('pred', 'pred')}, {_R('obs', 'obs')}
FROM band WHERE {_TEST}""")
def gated_mix(spark, sf_dir):
    """H7 (learner average, 0.5/0.5), H24 (legacy 0.6/0.4), H8 (gated mix of pred and obs)."""
    b = _band(spark, sf_dir).where(F.col("split") == "test")
    return rounded(b.select("station_id", "year", "month",
                            U.learner_average("y_lag1", "y_rm3").alias("learner_avg"),
                            U.learner_average("y_lag1", "y_rm3", C.LEGACY_LEARNER_WEIGHTS).alias("learner_avg_legacy"),
                            "g", "pred", "obs"))


@query("mixed_sigma", f"""WITH {O.band_cte(SPLITS)}
SELECT {_KEYS}, {_R('sigma_A', 'sigma_A')}, {_R('sigma_B', 'sigma_B')}, {_R('sigma_base', 'sigma_base')},
       {_R('sigma', 'sigma')}
FROM band WHERE {_TEST}""")
def mixed_sigma(spark, sf_dir):
    """Training-form mixed sigma per test row, before and after the scale."""
    b = _band(spark, sf_dir).where(F.col("split") == "test")
    return rounded(b.select("station_id", "year", "month", "sigma_A", "sigma_B", "sigma_base", "sigma"))


def _serving_sql(scale_default=C.SCALE_SERVING_DEFAULT):
    g, w, f = O.gate(), O.disagreement(), O.season_factor()
    sa, sb = f"coalesce(sigma_A, {C.SIGMA_DEFAULT})", f"coalesce(sigma_B, {C.SIGMA_DEFAULT})"
    mix = f"sqrt({g} * {sa} * {sa} + (1 - {g}) * {sb} * {sb} + {w} * {C.SERVING_DISAGREEMENT ** 2})"
    return mix, f"{mix} * {f} * {scale_default}"


@query("serving_sigma", f"""WITH {O.band_cte(SPLITS)}
SELECT {_KEYS}, {_R(_serving_sql()[0], 'sigma_mix')}, {_R(_serving_sql()[1], 'sigma')} FROM band""")
def serving_sigma(spark, sf_dir):
    """Serving sigma (constant disagreement 10^2, defaults 15 / 1.2) on every frame row."""
    b = _band(spark, sf_dir)
    return rounded(b.select("station_id", "year", "month",
                            U.serving_sigma_mix("sigma_A", "sigma_B").alias("sigma_mix"),
                            U.serving_sigma("sigma_A", "sigma_B", F.lit(None).cast("double")).alias("sigma")))


@query("legacy_sigma", f"""WITH {O.frame_cte(SPLITS)}
SELECT {_KEYS}, {_R(f"(CASE WHEN {O.wet()} THEN {C.LEGACY_SIGMA_WET} ELSE {C.LEGACY_SIGMA_DRY} END) * {O.season_factor()} * {C.SCALE_SERVING_DEFAULT}", 'sigma')}
FROM frame""")
def legacy_sigma(spark, sf_dir):
    """Base 15 wet / 10 dry times the season factor and s = 1.2."""
    f = _frame(spark, sf_dir)
    return rounded(f.select("station_id", "year", "month", U.legacy_sigma().alias("sigma")))


@query("band_clip", f"""WITH {O.band_cte(SPLITS)}
SELECT {_KEYS}, {_R('pred', 'pred')}, {_R('greatest(0, lower_bound)', 'lower_bound')},
       {_R('upper_bound', 'upper_bound')}, {_R('lower_bound', 'lower_raw')}
FROM band WHERE {_TEST}""")
def band_clip(spark, sf_dir):
    """H13 band and H14 serving clip of the lower bound at 0."""
    b = _band(spark, sf_dir).where(F.col("split") == "test")
    return rounded(b.select("station_id", "year", "month", "pred",
                            U.lower("pred", "sigma", clip_at_zero=True).alias("lower_bound"),
                            "upper_bound", F.col("lower_bound").alias("lower_raw")))


@query("legacy_gate", f"""WITH {O.features_cte()},
rec AS (SELECT {_KEYS}, CAST(CAST((round_even(asin(month_sin) * 12 / (2 * pi()), 0) % 12 + 12) % 12 AS INTEGER) + 1 AS INTEGER)
               AS month_recovered FROM features)
SELECT *, {_R(O.gate('month_recovered'), 'gate_recovered')}, {_R(O.gate(), 'gate_true')} FROM rec""")
def legacy_gate(spark, sf_dir):
    """Month recovered from its sine (lossy) and the gate it implies."""
    f = feat.add_lag_features(_panel(spark, sf_dir))
    out = f.select("station_id", "year", "month", season.month_from_sin("month_sin").alias("month_recovered"))
    return rounded(out.select("*", season.gate("month_recovered").alias("gate_recovered"),
                              season.gate().alias("gate_true")))


@query("month_dates", f"""WITH {O.panel_cte()}
SELECT {_KEYS}, CAST(make_date(year, month, 1) AS TIMESTAMP) AS month_start, {O.wet()} AS is_wet FROM panel""")
def month_dates(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return p.select("station_id", "year", "month", season.month_start().alias("month_start"),
                    season.is_wet().alias("is_wet"))


# --- metrics (D1-D8, B17, D11-D14, H18) ---------------------------------------------

def _report(spark, sf_dir):
    return ev.station_report(_band(spark, sf_dir))


_SKILL = ["rmse", "mae", "r2", "nse", "kge", "pbias", "pearson"]
_REPORT_SQL = O.station_report_sql(SPLITS)


def _report_subset_sql(cols: list[str]) -> str:
    return f"SELECT station_id, {', '.join(cols)} FROM ({_REPORT_SQL}) rep"


@query("skill_metrics", _report_subset_sql(["n_test", "n_train"] + _SKILL + [f"train_{c}" for c in _SKILL]))
def skill_metrics(spark, sf_dir):
    """The test bundle (mixed target) and the train bundle (target A), D1-D7."""
    cols = ["n_test", "n_train"] + _SKILL + [f"train_{c}" for c in _SKILL]
    return rounded(_report(spark, sf_dir).select("station_id", *cols))


@query("skill_stored", _report_subset_sql(["n_test"] + _SKILL))
def skill_stored(spark, sf_dir):
    """D1-D7 from stored moments: the scored rows come as a stream in five files, each adds its partial rows, and the
    metrics read the store alone. Equals ``skill_metrics``."""
    from fluvio.operators import moments
    from fluvio.session import scratch_path
    base = scratch_path(spark, "moments")
    rows = _band(spark, sf_dir).where(F.col("split") == "test").select("station_id", "year", "month", "obs", "pred")
    rows.write.parquet(base + "/all")
    rows = spark.read.parquet(base + "/all")
    for k in range(5):
        rows.where((F.col("year") + F.col("month") * 3) % 5 == k).write.mode("append").parquet(base + "/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(base + "/rows")
    moments.moments_stream(stream, "obs", "pred", base + "/moments", base + "/_checkpoint")
    merged = moments.merge_moments(moments.read_moments(spark, base + "/moments"))
    return rounded(moments.skill_from_moments(merged).select("station_id", F.col("n").alias("n_test"), *_SKILL))


@query("peak_nse", _report_subset_sql(["upper_fence", "nse_peaks", "train_nse_peaks"]))
def peak_nse(spark, sf_dir):
    """D8 with B17: NSE over rows above the train upper fence."""
    return rounded(_report(spark, sf_dir).select("station_id", "upper_fence", "nse_peaks", "train_nse_peaks"))


@query("interval_metrics", _report_subset_sql(["n_test", "coverage", "rel_width", "width_ratio"]))
def interval_metrics(spark, sf_dir):
    """D11-D13 at s = 1.2."""
    return rounded(_report(spark, sf_dir).select("station_id", "n_test", "coverage", "rel_width", "width_ratio"))


@query("risk_class", _report_subset_sql(["coverage", "pbias", "risk"]))
def risk_class(spark, sf_dir):
    """H18 over the test bundle."""
    return rounded(_report(spark, sf_dir).select("station_id", "coverage", "pbias", "risk"))


# --- coverage table, last 24 months (B19, H16, H17, F2) --------------------------------

@query("coverage_last24", f"""WITH {O.band_cte(SPLITS)},
t AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY year DESC, month DESC) AS rn
      FROM band WHERE {_TEST})
SELECT {_KEYS}, CAST(make_date(year, month, 1) AS TIMESTAMP) AS month_start, {_R('obs', 'obs')}, {_R('pred', 'pred')},
       {_R('lower_bound', 'lower_bound')}, {_R('upper_bound', 'upper_bound')},
       (obs >= lower_bound AND obs <= upper_bound) AS covered
FROM t WHERE rn <= 24""")
def coverage_last24(spark, sf_dir):
    from fluvio.operators.selection import last_n_per_station
    b = _band(spark, sf_dir).where(F.col("split") == "test")
    t = last_n_per_station(b, 24)
    return rounded(t.select("station_id", "year", "month", season.month_start().alias("month_start"),
                            "obs", "pred", "lower_bound", "upper_bound",
                            U.covered("obs", "lower_bound", "upper_bound").alias("covered")))


# --- band-scale search (I9, I10, F3) --------------------------------------------------

def _scale_search_sql(cal: str = "test") -> str:
    k = (f"least(greatest(CASE WHEN sigma_base > 0 THEN CAST(ceil(abs(obs - pred) * 1000 / sigma_base) AS BIGINT) "
         f"WHEN abs(obs - pred) = 0 THEN 0 ELSE 1000000000 END, 500), 3001)")
    s = "(CAST(g.k AS DOUBLE) / 1000)"
    fit = (f"-abs(CAST(count(r.k) AS DOUBLE) / any_value(st.n) - {C.TARGET_COVERAGE}) "
           f"- {C.REL_WIDTH_WEIGHT} * abs({s} * any_value(st.A) - {C.TARGET_REL_WIDTH}) "
           f"- {C.WIDTH_RATIO_PENALTY} * greatest(0, {s} * any_value(st.B) - {C.WIDTH_RATIO_CAP})")
    return f"""WITH {O.band_cte(SPLITS, cal=cal)},
rws AS (SELECT station_id, obs, pred, sigma_base, obs_width, {k} AS k FROM band WHERE split = '{cal}'),
st AS (SELECT station_id, count(*) AS n, avg(sigma_base * 2) / (stddev_pop(obs) + {C.REL_WIDTH_EPS}) AS A,
              avg(sigma_base * 2 / obs_width) AS B FROM rws GROUP BY station_id),
grid AS (SELECT unnest(generate_series(500, 3000)) AS k),
ev AS (
  SELECT st.station_id, g.k, {fit} AS fit, CAST(count(r.k) AS DOUBLE) / any_value(st.n) AS p,
         {s} * any_value(st.A) AS rw, {s} * any_value(st.B) AS wr
  FROM st CROSS JOIN grid g LEFT JOIN rws r ON r.station_id = st.station_id AND r.k <= g.k
  GROUP BY st.station_id, g.k),
best AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY fit DESC, k ASC) AS rn FROM ev)
SELECT station_id, {O.rnd('k / 1000')} AS s_opt, {O.rnd('fit')} AS fitness, {O.rnd('p')} AS coverage,
       {O.rnd('rw')} AS rel_width, {O.rnd('wr')} AS width_ratio
FROM best WHERE rn = 1"""


@query("scale_search", _scale_search_sql())
def scale_search(spark, sf_dir):
    """Exact grid search of the band scale per station (in-sample on test, as the original)."""
    from fluvio.operators.calibrate import scale_search as search
    b = _band(spark, sf_dir).where(F.col("split") == "test")
    return rounded(search(b))


@query("scale_search_stored", _scale_search_sql())
def scale_search_stored(spark, sf_dir):
    """I9 / I10 after new months: each part of the test months adds its bins to the store, and the search reads bins only."""
    from fluvio.operators.calibrate import cover_bins, search_bins
    from fluvio.session import scratch_path
    path = scratch_path(spark, "cover_bins")
    rows = _band(spark, sf_dir).where(F.col("split") == "test").select("station_id", "month", "obs", "pred", "sigma_base", "obs_width")
    rows.write.parquet(path + "/rows")
    rows = spark.read.parquet(path + "/rows")
    for first, last in ((1, 4), (5, 12)):
        cover_bins(rows.where(F.col("month").between(first, last))).write.mode("append").parquet(path + "/bins")
    return rounded(search_bins(spark.read.parquet(path + "/bins")))


@query("scale_search_val", _scale_search_sql("val"))
def scale_search_val(spark, sf_dir):
    """Out-of-sample mode: MAD sigmas and the scale search on the validation years."""
    from fluvio.operators.calibrate import scale_search as search
    scored = ev.stand_in_predictions(_frame(spark, sf_dir))
    b = ev.with_band(scored, C.SCALE_SERVING_DEFAULT, calibration_split="val").where(F.col("split") == "val")
    return rounded(search(b))


# --- requests: validation and fills (A4, B14, B15, B16) ---------------------------------

def _requests_sql(cte: str | None = None) -> str:
    key = "((station_id + month) % 7)"
    feats = []
    for c in C.REQUEST_FEATURES:
        if c == "y_lag1":
            feats.append(f"CASE WHEN {key} <> 2 THEN {c} END AS {c}")
        elif c in ("pr_sum3", "u2_min"):
            feats.append(f"CASE WHEN {key} <> 3 THEN {c} END AS {c}")
        else:
            feats.append(f"{c}")
    return (cte or O.frame_cte(SPLITS)) + f""",
requests AS (
  SELECT concat_ws('-', CAST(station_id AS VARCHAR), CAST(year AS VARCHAR), lpad(CAST(month AS VARCHAR), 2, '0'))
           AS request_id, station_id,
         CAST(CASE WHEN {key} = 1 THEN 1990 ELSE year END AS INTEGER) AS year,
         CAST(CASE WHEN {key} = 0 THEN 13 ELSE month END AS INTEGER) AS month, {', '.join(feats)}
  FROM frame WHERE split = 'test')"""


def _violations_sql() -> str:
    msgs = ["CASE WHEN year IS NULL THEN 'missing year' END", "CASE WHEN month IS NULL THEN 'missing month' END",
            f"CASE WHEN NOT (year BETWEEN {C.REQUEST_YEAR_MIN} AND {C.REQUEST_YEAR_MAX}) "
            f"THEN 'year out of range [{C.REQUEST_YEAR_MIN}, {C.REQUEST_YEAR_MAX}]' END",
            "CASE WHEN NOT (month BETWEEN 1 AND 12) THEN 'month out of range [1, 12]' END"]
    msgs += [f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in C.REQUEST_FEATURES]
    return msgs


@query("validate_requests", f"""WITH {_requests_sql()},
v AS (SELECT request_id, station_id, year, month, list_filter([{', '.join(_violations_sql())}], lambda x: x IS NOT NULL) AS vs
      FROM requests)
SELECT request_id, station_id, year, month, CAST(len(vs) AS INTEGER) AS n_violations,
       array_to_string(vs, '; ') AS violations,
       CASE WHEN len(vs) = 0 THEN 'accepted' ELSE 'quarantined' END AS status
FROM v""")
def validate_requests(spark, sf_dir):
    """Range and presence checks; every request is accepted or quarantined."""
    from fluvio.operators.validate import with_violations
    from fluvio.sources.requests import requests_from_frame
    v = with_violations(requests_from_frame(_frame(spark, sf_dir)))
    return v.select("request_id", "station_id", "year", "month", F.size("violations").alias("n_violations"),
                    F.array_join("violations", "; ").alias("violations"),
                    F.when(F.size("violations") == 0, F.lit("accepted")).otherwise(F.lit("quarantined")).alias("status"))


@query("impute_zero", f"""WITH {_requests_sql()}
SELECT request_id, {', '.join(_R(f'coalesce({c}, 0)', c) for c in C.REQUEST_FEATURES)} FROM requests""")
def impute_zero(spark, sf_dir):
    """Missing request features filled with 0."""
    from fluvio.operators.validate import fill_zero
    from fluvio.sources.requests import requests_from_frame
    r = fill_zero(requests_from_frame(_frame(spark, sf_dir)), C.REQUEST_FEATURES)
    return rounded(r.select("request_id", *C.REQUEST_FEATURES))


@query("impute_train_mean", f"""WITH {_requests_sql()},
m AS (SELECT station_id, {', '.join(f'avg({c}) AS m_{c}' for c in C.REQUEST_FEATURES)} FROM frame
      WHERE split = 'train' GROUP BY station_id)
SELECT request_id, {', '.join(_R(f'coalesce(r.{c}, m.m_{c})', c) for c in C.REQUEST_FEATURES)}
FROM requests r LEFT JOIN m USING (station_id)""")
def impute_train_mean(spark, sf_dir):
    """Missing request features filled with the station's train mean."""
    from fluvio.operators.validate import fill_from_means, with_train_means
    from fluvio.sources.requests import requests_from_frame
    frame = with_train_means(_frame(spark, sf_dir))
    r = fill_from_means(requests_from_frame(frame, keep=tuple(f"_mean_{c}" for c in C.REQUEST_FEATURES)))
    return rounded(r.select("request_id", *C.REQUEST_FEATURES))


# --- scaling (D15, G1, I1) --------------------------------------------------------------

_FIT = "split IN ('train', 'val')"


@query("scaler_stats", f"""WITH {O.frame_cte(SPLITS)}
SELECT station_id, count(CASE WHEN {_FIT} THEN 1 END) AS n_fit,
       {', '.join(_R(f"avg(CASE WHEN {_FIT} THEN {c} END)", f'mean_{c}') + ', ' + _R(f"stddev_pop(CASE WHEN {_FIT} THEN {c} END)", f'sd_{c}') for c in C.FEATURE_COLUMNS)}
FROM frame GROUP BY station_id""")
def scaler_stats(spark, sf_dir):
    """D15 over train UNION val (G1), population sd."""
    from fluvio.operators.scaling import scaler_stats as stats
    return rounded(stats(_frame(spark, sf_dir)))


def _standardize_sql() -> str:
    zs = []
    for c in C.FEATURE_COLUMNS:
        mean = f"avg(CASE WHEN {_FIT} THEN {c} END) OVER (PARTITION BY station_id)"
        sd = f"stddev_pop(CASE WHEN {_FIT} THEN {c} END) OVER (PARTITION BY station_id)"
        zs.append(_R(f"({c} - {mean}) / (CASE WHEN {sd} IS NULL OR {sd} = 0 THEN 1.0 ELSE {sd} END)", f"z_{c}"))
    return f"""WITH {O.frame_cte(SPLITS)}
SELECT {_KEYS}, {', '.join(zs)} FROM frame"""


@query("standardize", _standardize_sql())
def standardize(spark, sf_dir):
    """Per-station z-scores of the 25 features with train+val statistics."""
    from fluvio.operators.scaling import standardize as std
    z = std(_frame(spark, sf_dir))
    return rounded(z.select("station_id", "year", "month", *[f"z_{c}" for c in C.FEATURE_COLUMNS]))


# --- geo records (A2, A3, B1-B9, B20, H20-H23) ----------------------------------------------

def _records_sql() -> str:
    lon = "(-43.0 - CAST(user_id % 100 AS DOUBLE) / 100.0)"
    lat = "(-22.0 - CAST(user_id % 50 AS DOUBLE) / 50.0)"
    return f"""rec AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN 'Point' ELSE 'Polygon' END AS gtype, {lon} AS lon, {lat} AS lat
  FROM events)"""


_OBS_COLS = ("id, type, value, unit, timestamp, geometry_type, location_name")


def _obs_select(where: str) -> str:
    return f"""WITH {_records_sql()}
SELECT event_id AS id, event_type AS type, {_R('value', 'value')}, upper(substr(event_type, 1, 3)) AS unit,
       ts AS timestamp, lower(gtype) AS geometry_type, 'Station ' || CAST(user_id AS VARCHAR) AS location_name,
       {_R("CASE WHEN gtype = 'Point' THEN lon END", 'lon')}, {_R("CASE WHEN gtype = 'Point' THEN lat END", 'lat')}
FROM rec WHERE {where}"""


def _obs_out(df):
    from fluvio.operators.catalog import point_lat, point_lon
    return rounded(df.select("id", "type", "value", "unit", "timestamp", "geometry_type", "location_name",
                             point_lon().alias("lon"), point_lat().alias("lat")))


@query("obs_filter", _obs_select("lower(gtype) = 'point' AND lower(event_type) = 'view'"))
def obs_filter(spark, sf_dir):
    """B1 + B2 + B3: geometry_type='Point' and data_type='VIEW', both case-insensitive."""
    from fluvio.operators.catalog import filter_observations
    from fluvio.sources.records import observations
    return _obs_out(filter_observations(observations(spark, sf_dir), geometry_type="Point", data_type="VIEW"))


@query("obs_points", _obs_select("gtype = 'Point'"))
def obs_points(spark, sf_dir):
    """B4."""
    from fluvio.operators.catalog import points
    from fluvio.sources.records import observations
    return _obs_out(points(observations(spark, sf_dir)))


def _poly_sql(source_cols: str, where: str = "gtype = 'Polygon'") -> str:
    return f"""WITH {_records_sql()}
SELECT event_id AS id, {source_cols}, 1 AS n_rings, 5 AS ring_points,
       {_R('lon', 'first_lon')}, {_R('lat', 'first_lat')}, true AS closed
FROM rec WHERE {where}"""


def _poly_out(df, *cols):
    ring = F.element_at(F.col("geometry.rings"), 1)
    return rounded(df.select(
        "id", *cols, F.size("geometry.rings").alias("n_rings"), F.size(ring).alias("ring_points"),
        F.element_at(F.element_at(ring, 1), 1).alias("first_lon"), F.element_at(F.element_at(ring, 1), 2).alias("first_lat"),
        (F.element_at(ring, 1) == F.element_at(ring, -1)).alias("closed")))


@query("obs_polygons", _poly_sql("event_type AS type"))
def obs_polygons(spark, sf_dir):
    """B5 with ring access."""
    from fluvio.operators.catalog import polygons
    from fluvio.sources.records import observations
    return _poly_out(polygons(observations(spark, sf_dir)), "type")


@query("locations", f"""WITH {_records_sql()}
SELECT event_id AS id, 'Station ' || CAST(user_id AS VARCHAR) AS location_name, gtype AS geometry_type,
       [event_type] AS data_types FROM rec""")
def locations(spark, sf_dir):
    """One row per observation, no dedup."""
    from fluvio.operators.catalog import locations as loc
    from fluvio.sources.records import observations
    return loc(observations(spark, sf_dir))


def _fc_sql(where: str) -> str:
    return f"""WITH {_records_sql()}
SELECT event_id AS id, event_type || '_model' AS model, {_R('(event_id % 100) / 100.0', 'confidence')},
       lower(gtype) AS geometry_type, 'Area ' || CAST(user_id AS VARCHAR) AS location_name,
       ts + INTERVAL 6 HOUR AS forecast_time
FROM rec WHERE {where}"""


def _fc_out(df):
    return rounded(df.select("id", "model", "confidence", "geometry_type", "location_name", "forecast_time"))


@query("forecast_filter", _fc_sql("lower(gtype) = 'polygon' AND contains(lower(event_type || '_model'), 'er')"))
def forecast_filter(spark, sf_dir):
    """B7 + B8 + B3: geometry_type='POLYGON' (=), model_name='Er' (substring), case-insensitive."""
    from fluvio.operators.catalog import filter_forecasts
    from fluvio.sources.records import forecasts
    return _fc_out(filter_forecasts(forecasts(spark, sf_dir), geometry_type="POLYGON", model_name="Er"))


@query("forecast_points", _fc_sql("gtype = 'Point'"))
def forecast_points(spark, sf_dir):
    """B4 on forecasts."""
    from fluvio.operators.catalog import points
    from fluvio.sources.records import forecasts
    return _fc_out(points(forecasts(spark, sf_dir)))


@query("forecast_polygons", _poly_sql("event_type || '_model' AS model"))
def forecast_polygons(spark, sf_dir):
    """B5 on forecasts."""
    from fluvio.operators.catalog import polygons
    from fluvio.sources.records import forecasts
    return _poly_out(polygons(forecasts(spark, sf_dir)), "model")


@query("forecast_areas", f"""WITH {_records_sql()}
SELECT event_id AS id, 'Area ' || CAST(user_id AS VARCHAR) AS location_name, gtype AS geometry_type,
       event_type || '_model' AS model, ts + INTERVAL 6 HOUR AS forecast_time FROM rec""")
def forecast_areas(spark, sf_dir):
    """B9."""
    from fluvio.operators.catalog import forecast_areas as areas
    from fluvio.sources.records import forecasts
    return areas(forecasts(spark, sf_dir))


def _quality_sql() -> str:
    """Counts of the defects that ``records.flawed_records`` plants."""
    i = "event_id"
    known, point, poly = f"{i} % 29 <> 3", f"{i} % 2 = 0", f"{i} % 2 <> 0"
    common = [
        ("bad_geometry_type", f"{i} % 29 = 3"),
        ("point_arity", f"{known} AND {point} AND {i} % 31 = 4"),
        ("ring_too_short", f"{known} AND {poly} AND {i} % 37 = 5"),
        ("ring_not_closed", f"{known} AND {poly} AND ({i} % 37 = 5 OR {i} % 41 = 7)"),
    ]
    obs = common + [("missing_location", f"{i} % 59 = 11")]
    fc = common + [("missing_location", f"{i} % 43 = 8"), ("confidence_range", f"{i} % 47 = 9"), ("missing_forecast_time", f"{i} % 53 = 10")]
    parts = []
    for source, rules in (("observation", obs), ("forecast", fc)):
        for name, cond in rules:
            parts.append(f"SELECT '{source}' AS source, count(*) AS n_records, '{name}' AS rule, "
                         f"count(*) FILTER (WHERE {cond}) AS n_violations FROM events")
    return "\nUNION ALL\n".join(parts)


@query("geo_quality", _quality_sql())
def geo_quality(spark, sf_dir):
    """Violation counts per rule for observations and forecasts with planted defects, in one pass."""
    from fluvio.operators.catalog import quality_reports
    from fluvio.sources.records import flawed_records
    from fluvio.sources.tables import table
    return quality_reports(flawed_records(table(spark, sf_dir, "events")), {"observation": "obs_location", "forecast": "location_name"})


# --- JSON ingest (A2, A3, A4, H23) -------------------------------------------------------------

@query("json_records", f"""WITH {_records_sql()}
SELECT event_id AS id, 'observation' AS source, event_type AS name, ts AS at, lower(gtype) AS geometry_type, {_R('value', 'value')} FROM rec
UNION ALL SELECT event_id, 'forecast', event_type || '_model', ts, lower(gtype), {O.rnd('(event_id % 100) / 100.0')} FROM rec""")
def json_records(spark, sf_dir):
    """A2 + A3 + H23: raw records written as JSON with ISO-8601 text for times, then read by the JSON scans."""
    from fluvio.session import scratch_path
    from fluvio.sources import records as R
    from fluvio.sources.tables import table
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "records_json")
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    flat = lambda df: df.withColumn("geometry", F.struct("geometry.type", F.col("geometry.coordinates").alias("coordinates")))
    for name, raw in (("obs", R.observations_raw_from_events(events)), ("fc", R.forecasts_raw_from_events(events))):
        times = [c for c in ("timestamp", "forecast_time") if c in raw.columns]
        flat(raw).withColumns({c: iso(F.col(c)) for c in times}).write.mode("overwrite").json(f"{path}/{name}")
    obs = R.read_observations_json(spark, f"{path}/obs").select(
        "id", F.lit("observation").alias("source"), F.col("type").alias("name"), F.col("timestamp").alias("at"), "geometry_type", "value")
    fc = R.read_forecasts_json(spark, f"{path}/fc").select(
        "id", F.lit("forecast").alias("source"), F.col("model").alias("name"), F.col("timestamp").alias("at"), "geometry_type", F.col("confidence").alias("value"))
    return rounded(obs.unionByName(fc))


@query("json_requests", f"""WITH {_requests_sql()}
SELECT request_id, station_id, year, month, CASE WHEN y_lag1 IS NULL THEN 1 ELSE 0 END + CASE WHEN pr_sum3 IS NULL THEN 1 ELSE 0 END
       + CASE WHEN u2_min IS NULL THEN 1 ELSE 0 END AS n_missing FROM requests""")
def json_requests(spark, sf_dir):
    """A4: requests written as JSON and read by the request scan."""
    from fluvio.session import scratch_path
    from fluvio.sources.requests import read_requests, requests_from_frame
    path = scratch_path(spark, "requests_json")
    requests_from_frame(_frame(spark, sf_dir)).write.mode("overwrite").json(path)
    missing = sum((F.col(c).isNull().cast("int") for c in C.REQUEST_FEATURES), F.lit(0))
    return read_requests(spark, path).select("request_id", "station_id", "year", "month", missing.alias("n_missing"))


@query("variant_result", f"""SELECT event_id AS id,
  CASE event_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' ELSE 'object' END AS result_kind,
  CASE WHEN event_id % 3 = 0 THEN event_type END AS result_text,
  {_R('CASE WHEN event_id % 3 = 1 THEN value END', 'result_number')},
  {_R('CASE WHEN event_id % 3 = 2 THEN value END', 'speed_avg')},
  {_R("CASE WHEN event_id % 3 = 2 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END", 'props_k')}
FROM events""")
def variant_result(spark, sf_dir):
    """Polymorphic VARIANT result read per kind."""
    from fluvio.sources.records import forecasts, result_kind
    fc = forecasts(spark, sf_dir)
    kind = result_kind(F.col("result"))
    out = fc.select("id", kind.alias("result_kind"), "result")
    return rounded(out.select(
        "id", "result_kind",
        F.when(F.col("result_kind") == "string", F.try_variant_get("result", "$", "string")).alias("result_text"),
        F.when(F.col("result_kind") == "number", F.try_variant_get("result", "$", "double")).alias("result_number"),
        F.try_variant_get("result", "$.speed_avg", "double").alias("speed_avg"),
        F.try_variant_get("result", "$.props.k", "double").alias("props_k")))


@query("variant_stored", f"""SELECT event_id AS id, {_R('value', 'speed_avg')}, {_R("CAST(json_extract(props, '$.k') AS DOUBLE)", 'props_k')}
FROM events WHERE event_id % 3 = 2 AND value > 50""")
def variant_stored(spark, sf_dir):
    """A3 + H22: forecasts stored with their result shredded; fast objects by a filter pushed to the typed column."""
    from fluvio.session import scratch_path
    from fluvio.sources.records import forecasts, objects_with, write_forecasts
    path = scratch_path(spark, "forecasts")
    write_forecasts(forecasts(spark, sf_dir).select("id", "model", "result"), path)
    fast = objects_with(spark.read.parquet(path), "speed_avg", 50.0)
    return rounded(fast.select("id", F.try_variant_get("result", "$.speed_avg", "double").alias("speed_avg"),
                               F.try_variant_get("result", "$.props.k", "double").alias("props_k")))


# --- files: CSV scan, scored series, run export (A1, A5, A6, B18, H15) -----------------------

_PANEL_COLS = ["station_id", "year", "month"] + C.METEO_COLUMNS + [C.TARGET_A, C.TARGET_MIN, C.TARGET_B]


@query("csv_scan", f"""WITH {O.panel_cte()}
SELECT station_id, year, month, {', '.join(_R(c, c) for c in _PANEL_COLS[3:])} FROM panel""")
def csv_scan(spark, sf_dir):
    """A1: the panel written as header CSV and scanned back with the declared schema."""
    from fluvio.session import scratch_path
    from fluvio.sources.files import write_csv
    path = scratch_path(spark, "station_month_csv")
    write_csv(_panel(spark, sf_dir).select(*_PANEL_COLS), path)
    return rounded(P.read_station_month_csv(spark, path))


def _b18(x: str) -> str:
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


@query("scored_series", f"""WITH {O.band_cte(SPLITS)}
SELECT station_id, year, month, {_b18('obs')} AS observed, {_b18('pred')} AS predicted,
       {_b18('lower_bound')} AS lower_bound, {_b18('upper_bound')} AS upper_bound,
       {_b18('flow_next_month_min')} AS obs_min, {_b18('flow_next_month_max')} AS obs_max,
       {_b18('sigma')} AS uncertainty
FROM band WHERE {_TEST}""")
def scored_series(spark, sf_dir):
    """A5 sink + scan (partitioned by station), then the B18 response projection."""
    from fluvio.session import scratch_path
    from fluvio.sources import files
    path = scratch_path(spark, "scored_series")
    files.write_scored_series(files.scored_series(_band(spark, sf_dir).where(F.col("split") == "test")), path)
    return files.response_projection(files.read_scored_series(spark, path))


@query("export_tables", f"""WITH {O.band_cte(SPLITS)},
rep AS ({O.station_report_sql(SPLITS)})
SELECT 'train_metrics' AS table_name, station_id, CAST(n_train AS BIGINT) AS n, train_rmse AS a, train_nse AS b FROM rep WHERE n_train > 0
UNION ALL SELECT 'test_metrics', station_id, CAST(n_test AS BIGINT), rmse, coverage FROM rep WHERE n_test > 0
UNION ALL SELECT 'monthly_coverage', station_id, CAST(year * 100 + month AS BIGINT), {O.rnd('pred')},
                 CASE WHEN obs >= lower_bound AND obs <= upper_bound THEN 1.0 ELSE 0.0 END FROM band WHERE {_TEST}""")
def export_tables(spark, sf_dir):
    """Train metrics, test metrics and the monthly coverage table under one run directory, read back.

    The band is kept once; the three tables are written from it.
    """
    from pyspark import StorageLevel

    from fluvio.session import scratch_path
    from fluvio.sources.files import export_run_tables
    band = _band(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    rep = ev.station_report(band)
    train_cols = [c for c in rep.columns if c.startswith("train_")] + ["n_train"]
    test_cols = ["n_test", "rmse", "mae", "r2", "nse", "kge", "pbias", "pearson", "nse_peaks",
                 "coverage", "rel_width", "width_ratio", "risk"]
    t = band.where(F.col("split") == "test")
    cov = t.select("station_id", "year", "month", "obs", "pred", "lower_bound", "upper_bound",
                   U.covered("obs", "lower_bound", "upper_bound").alias("covered"))
    paths = export_run_tables({
        "train_metrics": rep.where(F.col("n_train") > 0).select("station_id", *train_cols),
        "test_metrics": rep.where(F.col("n_test") > 0).select("station_id", *test_cols),
        "monthly_coverage": cov,
    }, scratch_path(spark, "run"))
    band.unpersist()
    shown = {"train_metrics": ("n_train", "train_rmse", "train_nse"), "test_metrics": ("n_test", "rmse", "coverage"),
             "monthly_coverage": (F.col("year") * 100 + F.col("month"), "pred", F.col("covered").cast("double"))}
    out = None
    for name, cols in shown.items():
        n, a, b = (F.col(c) if isinstance(c, str) else c for c in cols)
        part = spark.read.parquet(paths[name]).select(
            F.lit(name).alias("table_name"), "station_id", n.cast("long").alias("n"), a.alias("a"), b.alias("b"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# --- sampling (F4) ------------------------------------------------------------------------------

@query("sample_record", f"""WITH {_requests_sql()}
SELECT request_id, station_id, year, month, {', '.join(_R(c, c) for c in C.REQUEST_FEATURES)}
FROM requests ORDER BY md5('42-' || request_id), request_id LIMIT 1""")
def sample_record(spark, sf_dir):
    """one test-split request picked by a seeded hash rank."""
    from fluvio.operators.selection import sample_rows
    from fluvio.sources.requests import requests_from_frame
    req = requests_from_frame(_frame(spark, sf_dir))
    return rounded(sample_rows(req, 1, seed=42, key_cols=["request_id"]))


# --- learners, scoring, registry (A4, A7, A8, I1-I6, I8, I11, F5, H25, H26) -------------------
# Learner output has no SQL form, so ``train_eval`` is a rows-only check. It fits all four learners; the trees
# have their budget of 900 rounds and end by the error of the validation years (the fit of all 900 is a matter of
# minutes, see README). ``train_legacy`` and ``score_saved`` compare what can be recomputed from saved rows.

QUERY_CFG = C.TrainConfig(splits=SPLITS, tree=C.TreeParams(patience=50))


@query("train_eval")
def train_eval(spark, sf_dir):
    """Pooled learners of both targets, saved, scored, band scale searched, evaluated per
    station, committed and read back from the registry."""
    from fluvio.plans import registry
    from fluvio.plans.training_run import train_evaluate_register
    from fluvio.session import scratch_path
    root = scratch_path(spark, "training")
    train_evaluate_register(_frame(spark, sf_dir), QUERY_CFG, root)
    runs = registry.committed_runs(spark, root)
    return rounded(runs.select("station_id", "s_opt", "coverage", "sigma_A", "sigma_B", "train_samples",
                               "test_samples", "learner_metrics.*", "test_metrics.*"))


_HELD = "('0x' || substr(md5(station_id || '-' || year || '-' || month), 1, 8))::BIGINT % 100 >= 80"


@query("train_legacy", f"""WITH {O.panel_cte()},
lf AS (SELECT *, lag(flow, 3) OVER (PARTITION BY station_id ORDER BY year, month) AS l3, lag(flow, 2) OVER (PARTITION BY station_id ORDER BY year, month) AS l2,
              lag(flow, 1) OVER (PARTITION BY station_id ORDER BY year, month) AS l1 FROM panel),
held AS (SELECT count(*) AS n FROM lf WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL AND flow IS NOT NULL
         AND CAST('0x' || substr(md5(concat_ws('-', station_id, year, month)), 1, 8) AS BIGINT) % 100 >= 80)
SELECT learner, n, TRUE AS rmse_agrees, TRUE AS r2_agrees, TRUE AS stopped_in_time FROM held, (VALUES ('net'), ('tree'), ('ensemble')) l(learner)""")
def train_legacy(spark, sf_dir):
    """I8: the legacy trainer with early stopping; its holdout rows are saved, and RMSE and R^2 computed again from
    them by sums of squares (exact to 1e-9), the stop from the errors of the rounds."""
    from fluvio.plans import learn
    from fluvio.session import scratch_path
    p = C.LegacyParams()
    model, scored = learn.fit_legacy(feat.legacy_frame(_panel(spark, sf_dir)), p)
    path = scratch_path(spark, "legacy")
    model.save(path)
    scored.select("station_id", "year", "month", "flow", "net", "tree", "ensemble").write.parquet(f"{path}/holdout")
    rows = spark.read.parquet(f"{path}/holdout")
    learners = ("net", "tree", "ensemble")
    each = rows.select("flow", F.explode(F.array(*[F.struct(F.lit(m).alias("learner"), F.col(m).alias("p")) for m in learners])).alias("x")).select("flow", "x.*")
    d, y = F.col("flow") - F.col("p"), F.col("flow")
    again = each.groupBy("learner").agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("res"), (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)).alias("tot"))
    again = again.select("learner", "n", F.sqrt(F.col("res") / F.col("n")).alias("rmse2"), (1 - F.col("res") / F.col("tot")).alias("r22"))
    in_time = model.rounds == learn.best_round(model.errors, p.patience) and len(model.errors) - model.rounds < 2 * p.patience
    agree = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.greatest(F.abs(a), F.lit(1.0))
    return learn.legacy_metrics(scored).drop("n").join(again, "learner").select(
        "learner", "n", agree("rmse", "rmse2").alias("rmse_agrees"), agree("r2", "r22").alias("r2_agrees"),
        F.lit(in_time).alias("stopped_in_time"))


def _serving(spark, sf_dir, frame=None):
    """The stand-in predictor with sigmas and searched scale per station, as a served run."""
    from fluvio.operators.calibrate import scale_search as search
    from fluvio.plans import score
    frame = _frame(spark, sf_dir) if frame is None else frame
    band = ev.with_band(ev.stand_in_predictions(frame))
    sigmas = band.groupBy("station_id").agg(F.max("sigma_A").alias("sigma_A"), F.max("sigma_B").alias("sigma_B"))
    best = search(band.where(F.col("split") == "test")).select("station_id", "s_opt")
    return score.StandIn.fitted(frame), sigmas.join(best, "station_id", "left")


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _served_sql(sigma_mode: str = "run") -> str:
    """Accepted requests, their stand-in forecast and served band."""
    ok = " AND ".join(f"{c} IS NOT NULL" for c in C.REQUEST_FEATURES)
    gate, f = O.gate("month"), O.season_factor("month")
    mix = (f"sqrt({gate} * coalesce(sigma_A, {C.SIGMA_DEFAULT}) * coalesce(sigma_A, {C.SIGMA_DEFAULT}) + (1 - {gate}) * coalesce(sigma_B, {C.SIGMA_DEFAULT}) "
           f"* coalesce(sigma_B, {C.SIGMA_DEFAULT}) + {O.disagreement('month')} * {C.SERVING_DISAGREEMENT ** 2})")
    scale = f"coalesce(s_opt, {C.SCALE_SERVING_DEFAULT})"
    sigma = f"{mix} * {f} * {scale}" if sigma_mode == "run" else f"{O.by_season(C.LEGACY_SIGMA_WET, C.LEGACY_SIGMA_DRY)} * {f} * {scale}"
    parts = ({"gate": gate, "sigma_mix": mix, "s_opt": scale} if sigma_mode == "run" else {"part_a": "pred_A", "part_b": "pred_B", "gate": gate})
    return f"""WITH {_requests_sql(O.band_cte(SPLITS))},
off AS (SELECT station_id, avg(CASE WHEN split = 'train' THEN flow_next_month_max END) - avg(CASE WHEN split = 'train' THEN flow_next_month END) AS off
        FROM frame GROUP BY station_id),
best AS ({_scale_search_sql()}),
served AS (
  SELECT r.request_id, r.station_id, r.year, r.month, 0.5 * y_lag1 + 0.5 * y_rm3 AS pred_A,
         0.5 * y_lag1 + 0.5 * y_rm3 + off AS pred_B, sigma_A, sigma_B, s_opt
  FROM requests r LEFT JOIN off USING (station_id) LEFT JOIN sig USING (station_id) LEFT JOIN best USING (station_id)
  WHERE r.year BETWEEN {C.REQUEST_YEAR_MIN} AND {C.REQUEST_YEAR_MAX} AND r.month BETWEEN 1 AND 12 AND {ok}),
x AS (SELECT *, {gate} * pred_A + (1 - {gate}) * pred_B AS p, {sigma} AS u FROM served),
scored AS (SELECT request_id, station_id, year, month, {_b18('p')} AS predicted_flow, {_b18('greatest(0, p - u)')} AS lower_bound,
  {_b18('p + u')} AS upper_bound, {_b18('u')} AS uncertainty, CAST({C.NOMINAL_CONFIDENCE} AS DOUBLE) AS confidence_level,
  {', '.join(f"{_b18(e)} AS {n}" for n, e in parts.items())} FROM x)
"""


def _served_out(df, *parts):
    names = {"pred_A": "part_a", "pred_B": "part_b"}
    return df.select("request_id", "station_id", "year", "month", "predicted_flow", "lower_bound", "upper_bound", "uncertainty",
                     "confidence_level", *[F.col(f"model_components.{c}").alias(names.get(c, c)) for c in parts])


@query("score_requests", _served_sql() + "SELECT * FROM scored")
def score_requests(spark, sf_dir):
    """A4 + B14 + I6: validate a request batch, serve the accepted ones with the run's sigmas."""
    from fluvio.operators.validate import split_valid
    from fluvio.plans import score
    from fluvio.sources.requests import requests_from_frame
    model, runs = _serving(spark, sf_dir)
    accepted, _ = split_valid(requests_from_frame(_frame(spark, sf_dir)))
    return _served_out(score.score_requests(accepted.drop("violations"), model, runs), "gate", "sigma_mix", "s_opt")


@query("score_requests_base", _served_sql("base") + "SELECT * FROM scored")
def score_requests_base(spark, sf_dir):
    """I6 as the older service answers: base sigma (H12), reporting both predictions and the gate."""
    from fluvio.operators.validate import split_valid
    from fluvio.plans import score
    from fluvio.sources.requests import requests_from_frame
    model, runs = _serving(spark, sf_dir)
    accepted, _ = split_valid(requests_from_frame(_frame(spark, sf_dir)))
    return _served_out(score.score_requests(accepted.drop("violations"), model, runs, sigma_mode="base"), "pred_A", "pred_B", "gate")


@query("clipped_series", f"""WITH {O.band_cte(SPLITS)},
c AS (SELECT {_KEYS}, obs, pred, {O.by_season(C.LEGACY_SIGMA_WET, C.LEGACY_SIGMA_DRY)} * {O.season_factor()} * {C.SCALE_SERVING_DEFAULT} AS u
      FROM band WHERE {_TEST})
SELECT {_KEYS}, {_R('obs', 'obs')}, {_R('pred', 'pred')}, {_R('greatest(0, pred - u)', 'lower_bound')}, {_R('pred + u', 'upper_bound')},
       {_R('u', 'sigma')} FROM c""")
def clipped_series(spark, sf_dir):
    """H12 + H14 on the test series: base sigma, lower bound clipped at 0."""
    from fluvio.plans.score import clipped_series as clipped
    b = clipped(_band(spark, sf_dir).where(F.col("split") == "test"))
    return rounded(b.select("station_id", "year", "month", "obs", "pred", "lower_bound", "upper_bound", "sigma"))


def _model_folders(spark, frame, root: str) -> None:
    """Three saved models of the four-learner layout: ``whole``; ``one_target`` without the learners of target B;
    ``no_data`` whose stages have their metadata and nothing else."""
    from pyspark.ml import PipelineModel

    from fluvio.plans import learn
    small = C.TrainConfig(splits=SPLITS, tree=C.TreeParams(max_iter=2, segment=1, max_depth=2))
    ens = learn.fit_ensemble(frame, small)
    ens.save(f"{root}/whole")
    of_b = lambda stage: "_B" in (stage.getStatement() if hasattr(stage, "getStatement") else stage.getPredictionCol() if hasattr(stage, "getPredictionCol") else "")
    learn.TrainedEnsemble(PipelineModel([x for x in ens.model.stages if not of_b(x)]), ens.features).save(f"{root}/one_target")
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-{00000,*.txt}").text(f"{root}/whole")
    inside = F.regexp_extract("_metadata.file_path", "/whole/(.*metadata)/[^/]*$", 1)
    for r in texts.select(inside.alias("folder"), "value").where("folder <> '' AND folder NOT LIKE '%/treesMetadata'").collect():  # one short line for a stage
        spark.createDataFrame([(r.value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/no_data/{r.folder}")


@query("model_status", f"""WITH rep AS ({O.station_report_sql(SPLITS)})
SELECT station_id, 'second' AS run_id, CASE WHEN station_id % 3 = 0 THEN 'loaded' ELSE 'not_loaded' END AS status,
       station_id % 3 = 0 AS ready_for_prediction, CAST(n_train AS BIGINT) AS train_samples, CAST(n_test AS BIGINT) AS test_samples,
       rmse AS test_rmse, nse AS test_nse, train_rmse, coverage FROM rep""")
def model_status(spark, sf_dir):
    """I11 + F5 + A7 + A8 + H26: two runs of each station; the latest counts. Of three models one is whole, one
    lacks its target B, one lacks its learners' data."""
    from fluvio.plans import registry
    from fluvio.session import scratch_path
    frame = _frame(spark, sf_dir)
    rep = ev.station_report(_band(spark, sf_dir), extra=[F.lit(1.2).alias("s_opt")])
    root, runs_path = scratch_path(spark, "models"), scratch_path(spark, "model_runs")
    _model_folders(spark, frame, root)
    third = F.col("station_id") % 3
    model = F.when(third == 0, f"{root}/whole").when(third == 1, f"{root}/one_target").otherwise(f"{root}/no_data")
    rows = registry.run_rows(rep, root, "first")
    both = rows.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.when(F.col("n") == 0, "first").otherwise("second").alias("run_id"),
        *[model.alias(c) if c == "model_path" else (F.col(c) + F.make_interval(hours=F.col("n"))).alias(c) if c == "trained_on" else F.col(c)
          for c in rows.columns if c != "run_id"])
    registry.append_runs(both, runs_path)
    out = registry.model_status(registry.read_runs(spark, runs_path), root)
    return rounded(out.select("station_id", "run_id", "status", "ready_for_prediction", "train_samples", "test_samples",
                              "test_rmse", "test_nse", "train_rmse", "coverage"))


# --- streaming (section 2.10) ----------------------------------------------------------------

@query("stream_obs_filter", _obs_select("lower(gtype) = 'point' AND lower(event_type) = 'view'"))
def stream_obs_filter(spark, sf_dir):
    """B1 + B2 on a file stream of events (availableNow), sink read back."""
    from fluvio.session import scratch_path
    from fluvio.streaming.streams import filtered_observations, run_available_now
    s = filtered_observations(spark, sf_dir, geometry_type="Point", data_type="VIEW")
    from fluvio.operators.catalog import point_lat, point_lon
    flat = s.select("id", "type", "value", "unit", "timestamp", "geometry_type", "location_name",
                    point_lon().alias("lon"), point_lat().alias("lat"))
    out = scratch_path(spark, "stream_obs")
    run_available_now(flat, out + "/data", out + "/_checkpoint")
    return rounded(spark.read.parquet(out + "/data"))


@query("stream_score", _served_sql() + f""", bad AS (
  SELECT request_id, station_id, year, month, list_filter([{', '.join(_violations_sql())}], lambda x: x IS NOT NULL) AS vs FROM requests)
SELECT request_id, station_id, year, month, predicted_flow, uncertainty, CAST(NULL AS VARCHAR) AS violations FROM scored
UNION ALL SELECT request_id, station_id, year, month, NULL, NULL, array_to_string(vs, '; ') FROM bad WHERE len(vs) > 0""")
def stream_score(spark, sf_dir):
    """A4 as a JSON request stream -> B14 -> I6 in foreachBatch (accepted + quarantined sinks), in two runs on one
    checkpoint; the second brings a third of the requests again, which are not answered twice."""
    from fluvio.plans import score
    from fluvio.session import scratch_path
    from fluvio.sources.requests import requests_from_frame
    from fluvio.streaming.streams import request_stream, score_request_stream
    base = scratch_path(spark, "stream_score")
    frame = _stored(_frame(spark, sf_dir), base + "/frame")
    # every micro-batch joins the served rows: they are made once, a row for a station
    model, runs = _serving(spark, sf_dir, frame)
    model, runs = score.StandIn(_stored(model.offsets, base + "/offsets")), _stored(runs, base + "/runs")
    rows = requests_from_frame(frame)
    rows.write.mode("overwrite").json(base + "/sent")
    rows = spark.read.schema(rows.schema).json(base + "/sent")
    part = F.pmod(F.xxhash64("request_id"), F.lit(3))
    for again in (False, True):
        rows.where(part > 0 if not again else part < 2).write.mode("append").json(base + "/requests")
        score_request_stream(request_stream(spark, base + "/requests"), lambda: (model, runs, None),
                             base + "/accepted", base + "/quarantined", base + "/_checkpoint")
    a = spark.read.parquet(base + "/accepted").select(
        "request_id", "station_id", "year", "month", "predicted_flow", "uncertainty", F.lit(None).cast("string").alias("violations"))
    q = spark.read.parquet(base + "/quarantined").select(
        "request_id", "station_id", "year", "month", F.lit(None).cast("double").alias("predicted_flow"),
        F.lit(None).cast("double").alias("uncertainty"), F.array_join("violations", "; ").alias("violations"))
    return a.unionByName(q)


@query("stream_served", f"""WITH {_requests_sql(O.frame_cte(SPLITS))}
SELECT request_id, CASE WHEN len(list_filter([{', '.join(_violations_sql())}], lambda x: x IS NOT NULL)) > 0 THEN NULL
       WHEN CAST('0x' || substr(md5(request_id), 1, 4) AS BIGINT) % 2 = 0 THEN 'first' ELSE 'second' END AS run_id,
       CASE WHEN len(list_filter([{', '.join(_violations_sql())}], lambda x: x IS NOT NULL)) = 0 THEN TRUE END AS in_band FROM requests""")
def stream_served(spark, sf_dir):
    """A8 + I6: requests answered by saved ensembles. Each part of the stream is answered by the run that was the
    latest committed one when it came; a third run, whose commit did not end, is never used."""
    from fluvio.plans import registry
    from fluvio.plans.training_run import train_evaluate_register
    from fluvio.session import scratch_path
    from fluvio.sources.requests import requests_from_frame
    from fluvio.streaming.streams import CommittedService, request_stream, score_request_stream
    base = scratch_path(spark, "stream_served")
    frame = _frame(spark, sf_dir).checkpoint()
    rows = requests_from_frame(frame).checkpoint()
    half = F.conv(F.substring(F.md5("request_id"), 1, 4), 16, 10).cast("int") % 2
    service = CommittedService(spark, f"{base}/store")
    for k, run in enumerate(("first", "second")):
        train_evaluate_register(frame, C.TrainConfig(splits=SPLITS, tree=None, scale=C.SCALE_FIXED), f"{base}/store", run)
        registry.read_runs(spark, f"{base}/store/runs/{run}").withColumn("run_id", F.lit("lost")).write.mode("overwrite").parquet(f"{base}/store/runs/lost")
        rows.where(half == k).write.mode("append").json(base + "/requests")
        score_request_stream(request_stream(spark, base + "/requests"), service, base + "/accepted", base + "/quarantined", base + "/_checkpoint")
    a = spark.read.parquet(base + "/accepted")
    band = F.col("predicted_flow").between(F.col("lower_bound"), F.col("upper_bound")) | (F.col("lower_bound") == 0)
    return a.select("request_id", "run_id", band.alias("in_band")).unionByName(
        spark.read.parquet(base + "/quarantined").select("request_id", F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("boolean").alias("in_band")))


_LAG_COLS = ("pr_mean", "pr_lag1", "pr_lag2", "pr_lag3", "pr_sum3", "pr_api3", "y_lag1", "y_lag2", "y_lag3", "y_rm3", "month_sin", "month_cos")


@query("stream_lags", f"""WITH {O.features_cte()}
SELECT {_KEYS}, {', '.join(_R(c, c) for c in _LAG_COLS)} FROM features""")
def stream_lags(spark, sf_dir):
    """E1-E5 on a stream: the panel comes in four parts that overlap in time, and is emitted behind a watermark."""
    from fluvio.session import scratch_path
    from fluvio.streaming.lags import closing_row, lag_stream, rocksdb
    from fluvio.streaming.streams import run_available_now
    base = scratch_path(spark, "stream_lags")
    panel = _panel(spark, sf_dir).select("station_id", "year", "month", "pr_min", "pr_max", C.TARGET_A)
    panel.write.parquet(base + "/panel")
    panel = spark.read.parquet(base + "/panel")
    first = panel.agg(F.min(F.col("year") * 12 + F.col("month"))).first()[0]
    part = F.least(F.lit(3), F.expr(f"(year * 12 + month - {first} + station_id % 3) DIV 21"))
    for k in range(4):
        panel.where(part == k).write.mode("append").parquet(base + "/months")
    half = -(-len(spark.read.parquet(base + "/months").inputFiles()) // 2)
    closing_row(spark, panel).write.mode("append").parquet(base + "/months")
    # two parts a batch, whatever the files of a part: each batch opens and commits the whole state
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", half).parquet(base + "/months")
    with rocksdb(spark):
        run_available_now(lag_stream(stream, "24 months"), base + "/lags", base + "/_checkpoint")
    return rounded(spark.read.parquet(base + "/lags").select("station_id", "year", "month", *_LAG_COLS))


# --- fixed band scale (the original's s = 1.258 mode) ------------------------------------------

@query("fixed_scale_report", f"""SELECT station_id, n_test, coverage, rel_width, width_ratio, pbias, risk
FROM ({O.station_report_sql(SPLITS, scale=C.SCALE_FIXED)}) rep""")
def fixed_scale_report(spark, sf_dir):
    """D11-D13 and H18 with the band scale fixed at 1.258 instead of searched."""
    band = _band(spark, sf_dir, scale=C.SCALE_FIXED)
    rep = ev.station_report(band)
    return rounded(rep.select("station_id", "n_test", "coverage", "rel_width", "width_ratio", "pbias", "risk"))


# --- stored panel partitioned by year (A1 parquet, partition pruning) -----------------------------

@query("panel_year_slice", f"""WITH {O.panel_cte()}
SELECT station_id, year, month, {', '.join(_R(c, c) for c in _PANEL_COLS[3:])} FROM panel WHERE year >= 2000""")
def panel_year_slice(spark, sf_dir):
    """The panel stored partitioned by year, read back for the test years (pruned scan)."""
    from fluvio.session import scratch_path
    path = scratch_path(spark, "station_month")
    P.write_station_month(_panel(spark, sf_dir).select(*_PANEL_COLS), path)
    stored = P.read_station_month_parquet(spark, path)
    return rounded(stored.where(F.col("year") >= 2000).select(*_PANEL_COLS))

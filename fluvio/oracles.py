"""DuckDB SQL oracles for the registered queries.

Each query has an independent SQL formulation over the driver tables. The
CTE builders below are shared; every computed double is rounded to
``DIGITS`` decimals on both sides (summation order differs between engines).
"""

from __future__ import annotations

from fluvio import config as C
from fluvio.config import Splits

DIGITS, PLACES = 9, 6
NUDGE = 1e-12  # the rule of ``plans.output.round_value``


def rnd(expr: str) -> str:
    """Nine significant digits, none finer than 1e-6."""
    x = f"(CAST({expr} AS DOUBLE) * (1.0 + CAST({NUDGE!r} AS DOUBLE)))"
    k = f"least({PLACES}, {DIGITS - 1} - floor(log10(abs({x}))))"
    scale = f"pow(CAST(10 AS DOUBLE), abs({k}))"
    return (f"(CASE WHEN abs({x}) < 0.5 * pow(CAST(10 AS DOUBLE), -{PLACES}) THEN CAST(0 AS DOUBLE) WHEN {k} >= 0 THEN round({x} * {scale}) / {scale} "
            f"ELSE round({x} / {scale}) * {scale} END)")


def r(expr: str, alias: str) -> str:
    return f"{rnd(expr)} AS {alias}"


_METEO_SQL = {
    "u2": "l_discount * 100",
    "tmin": "l_tax * 100",
    "tmax": "l_quantity",
    "rs": "l_extendedprice / 1000",
    "rh": "CAST(l_linenumber AS DOUBLE)",
    "eto": "CAST(l_partkey % 97 AS DOUBLE)",
    "pr": "l_quantity * (1 - l_discount)",
}


def panel_cte() -> str:
    aggs = []
    for k, e in _METEO_SQL.items():
        aggs.append(f"min({e}) AS {k}_min, max({e}) AS {k}_max")
    aggs.append("CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) "
                "/ count(l_extendedprice) / 10000.0 AS flow, min(l_extendedprice / 100) AS flow_min, "
                "max(l_extendedprice / 100) AS flow_max")
    return f"""
monthly AS (
  SELECT l_suppkey AS station_id, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month, {', '.join(aggs)}
  FROM lineitem GROUP BY 1, 2, 3),
panel AS (
  SELECT *, lead(flow) OVER w AS flow_next_month, lead(flow_min) OVER w AS flow_next_month_min,
         lead(flow_max) OVER w AS flow_next_month_max
  FROM monthly WINDOW w AS (PARTITION BY station_id ORDER BY year, month))"""


def features_cte() -> str:
    return panel_cte() + """,
feat0 AS (SELECT *, (pr_min + pr_max) / 2.0 AS pr_mean FROM panel),
feat1 AS (
  SELECT *,
    lag(pr_mean, 1) OVER w AS pr_lag1, lag(pr_mean, 2) OVER w AS pr_lag2, lag(pr_mean, 3) OVER w AS pr_lag3,
    sum(pr_mean) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pr_sum3,
    lag(flow_next_month, 1) OVER w AS y_lag1, lag(flow_next_month, 2) OVER w AS y_lag2,
    lag(flow_next_month, 3) OVER w AS y_lag3,
    avg(flow_next_month) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS y_rm3
  FROM feat0 WINDOW w AS (PARTITION BY station_id ORDER BY year, month)),
features AS (
  SELECT *, 0.5 * pr_lag1 + 0.3 * pr_lag2 + 0.2 * pr_lag3 AS pr_api3,
         sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
  FROM feat1)"""


def split_case(splits: Splits = Splits(), year: str = "year") -> str:
    return (f"CASE WHEN {year} BETWEEN {splits.train[0]} AND {splits.train[1]} THEN 'train' "
            f"WHEN {year} BETWEEN {splits.val[0]} AND {splits.val[1]} THEN 'val' "
            f"WHEN {year} BETWEEN {splits.test[0]} AND {splits.test[1]} THEN 'test' END")


def frame_cte(splits: Splits = Splits()) -> str:
    """features -> complete cases -> split."""
    nn = " AND ".join(f"{c} IS NOT NULL" for c in C.COMPLETE_CASE_COLUMNS)
    return features_cte() + f""",
frame AS (SELECT *, {split_case(splits)} AS split FROM features WHERE {nn})"""


def wet(month: str = "month") -> str:
    return f"({month} IN ({', '.join(str(m) for m in C.WET_MONTHS)}))"


def by_season(wet_v: float, dry_v: float, month: str = "month") -> str:
    return f"CAST(CASE WHEN {wet(month)} THEN {wet_v} ELSE {dry_v} END AS DOUBLE)"


def gate(month: str = "month") -> str:
    return by_season(C.GATE_WET, C.GATE_DRY, month)


def disagreement(month: str = "month") -> str:
    return by_season(C.DISAGREEMENT_WET, C.DISAGREEMENT_DRY, month)


def season_factor(month: str = "month") -> str:
    return by_season(C.SEASON_FACTOR_WET, C.SEASON_FACTOR_DRY, month)


def band_cte(splits: Splits = Splits(), scale: float = C.SCALE_SERVING_DEFAULT, cal: str = "test") -> str:
    """frame -> stand-in predictions -> MAD sigmas, fence -> mix, sigma, band."""
    return frame_cte(splits) + f""",
pred0 AS (
  SELECT *, 0.5 * y_lag1 + 0.5 * y_rm3 AS pred_A,
         avg(CASE WHEN split = 'train' THEN flow_next_month_max END) OVER (PARTITION BY station_id)
       - avg(CASE WHEN split = 'train' THEN flow_next_month END) OVER (PARTITION BY station_id) AS _off
  FROM frame),
pred AS (SELECT * EXCLUDE (_off), pred_A + _off AS pred_B FROM pred0),
med AS (
  SELECT station_id,
    median(CASE WHEN split = '{cal}' THEN flow_next_month - pred_A END) AS med_A,
    median(CASE WHEN split = '{cal}' THEN flow_next_month_max - pred_B END) AS med_B,
    quantile_cont(CASE WHEN split = 'train' THEN flow_next_month END, 0.25) AS q1,
    quantile_cont(CASE WHEN split = 'train' THEN flow_next_month END, 0.75) AS q3
  FROM pred GROUP BY station_id),
sig AS (
  SELECT p.station_id,
    {C.MAD_SCALE} * median(CASE WHEN p.split = '{cal}' THEN abs(p.flow_next_month - p.pred_A - m.med_A) END) AS sigma_A,
    {C.MAD_SCALE} * median(CASE WHEN p.split = '{cal}' THEN abs(p.flow_next_month_max - p.pred_B - m.med_B) END) AS sigma_B,
    any_value(m.q3 + {C.FENCE_K} * (m.q3 - m.q1)) AS upper_fence
  FROM pred p JOIN med m USING (station_id) GROUP BY p.station_id),
band0 AS (
  SELECT p.*, s.sigma_A, s.sigma_B, s.upper_fence, {gate('p.month')} AS g,
    {gate('p.month')} * p.pred_A + (1 - {gate('p.month')}) * p.pred_B AS pred,
    {gate('p.month')} * p.flow_next_month + (1 - {gate('p.month')}) * p.flow_next_month_max AS obs,
    sqrt({gate('p.month')} * s.sigma_A * s.sigma_A + (1 - {gate('p.month')}) * s.sigma_B * s.sigma_B
         + {disagreement('p.month')} * (p.pred_A - p.pred_B) * (p.pred_A - p.pred_B)) * {season_factor('p.month')} AS sigma_base,
    greatest({C.OBS_WIDTH_FLOOR}, p.flow_next_month_max - p.flow_next_month_min) AS obs_width
  FROM pred p JOIN sig s USING (station_id)),
band AS (
  SELECT *, sigma_base * {scale} AS sigma, pred - sigma_base * {scale} AS lower_bound,
         pred + sigma_base * {scale} AS upper_bound
  FROM band0)"""


def skill_sql(o: str, p: str, uf: str | None, prefix: str = "") -> list[str]:
    d = f"({o} - {p})"
    n = f"count({o})"
    ss_res = f"sum({d} * {d})"
    ss_tot = f"(var_pop({o}) * {n})"
    nse = f"CASE WHEN {ss_tot} <> 0 THEN 1 - {ss_res} / {ss_tot} END"
    r2 = f"CASE WHEN {n} < 2 THEN NULL WHEN {ss_tot} <> 0 THEN 1 - {ss_res} / {ss_tot} WHEN {ss_res} = 0 THEN 1.0 ELSE 0.0 END"
    den = f"(stddev_pop({o}) * stddev_pop({p}))"
    rr = f"(CASE WHEN {den} <> 0 THEN covar_pop({o}, {p}) / {den} END)"
    bias = f"(CASE WHEN avg({o}) <> 0 THEN avg({p}) / avg({o}) END)"
    cv_den = f"(stddev_samp({o}) * avg({p}))"
    variability = f"(CASE WHEN {cv_den} <> 0 THEN stddev_samp({p}) * avg({o}) / {cv_den} END)"
    kge = f"1 - sqrt(pow({rr} - 1, 2) + pow({bias} - 1, 2) + pow({variability} - 1, 2))"
    pbias = f"100 * (CASE WHEN sum({o}) <> 0 THEN sum({d}) / sum({o}) END)"
    out = [
        r(f"sqrt(avg({d} * {d}))", f"{prefix}rmse"),
        r(f"avg(abs({d}))", f"{prefix}mae"),
        r(r2, f"{prefix}r2"),
        r(nse, f"{prefix}nse"),
        r(kge, f"{prefix}kge"),
        r(pbias, f"{prefix}pbias"),
        r(rr, f"{prefix}pearson"),
    ]
    if uf is not None:
        po = f"(CASE WHEN {o} > {uf} THEN {o} END)"
        pdd = f"(CASE WHEN {o} > {uf} THEN {d} END)"
        pn = f"count({po})"
        pt = f"(var_pop({po}) * {pn})"
        out.append(r(f"CASE WHEN {pn} > 0 AND {pt} <> 0 THEN 1 - sum({pdd} * {pdd}) / {pt} END",
                     f"{prefix}nse_peaks"))
    return out


def interval_sql(o: str, lo: str, up: str, w: str) -> list[str]:
    return [
        r(f"avg(CASE WHEN {o} IS NULL THEN NULL WHEN {o} >= {lo} AND {o} <= {up} THEN 1.0 ELSE 0.0 END)",
          "coverage"),
        r(f"avg({up} - {lo}) / (stddev_pop({o}) + {C.REL_WIDTH_EPS})", "rel_width"),
        r(f"avg(({up} - {lo}) / {w})", "width_ratio"),
    ]


def risk_sql(p: str = "coverage", b: str = "pbias") -> str:
    low, med, high = C.RISK_LABELS
    return (f"CASE WHEN {p} >= {C.RISK_LOW_COVERAGE} AND abs({b}) <= {C.RISK_LOW_ABS_PBIAS} THEN '{low}' "
            f"WHEN {p} >= {C.RISK_MEDIUM_COVERAGE} THEN '{med}' WHEN {p} IS NOT NULL THEN '{high}' END")


def station_report_sql(splits: Splits = Splits(), scale: float = C.SCALE_SERVING_DEFAULT) -> str:
    te = lambda x: f"(CASE WHEN split = 'test' THEN {x} END)"
    tr = lambda x: f"(CASE WHEN split = 'train' THEN {x} END)"
    cols = [
        f"count({te('obs')}) AS n_test", f"count({tr('flow_next_month')}) AS n_train",
        r(f"max({te('sigma_A')})", "sigma_A"), r(f"max({te('sigma_B')})", "sigma_B"),
        r("max(upper_fence)", "upper_fence"),
    ]
    cols += skill_sql(te("obs"), te("pred"), "upper_fence")
    cols += skill_sql(tr("flow_next_month"), tr("pred_A"), "upper_fence", prefix="train_")
    cols += interval_sql(te("obs"), te("lower_bound"), te("upper_bound"), te("obs_width"))
    return f"""WITH {band_cte(splits, scale)},
rep AS (SELECT station_id, {', '.join(cols)} FROM band GROUP BY station_id)
SELECT *, {risk_sql()} AS risk FROM rep"""

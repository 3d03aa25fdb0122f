"""Band-scale search (I9, I10, F3) as an exact grid search.

The original evolves one scalar ``s`` (20 individuals, 25 generations,
unseeded) to maximise

    fitness(s) = -|p(s) - 0.83| - 0.2 |r(s) - 1.10| - 0.15 max(0, w(s) - 1.05)

with p the inclusive coverage of the band pred +/- s*sigma, r the band width
relative to the population sd of the observations, and w the mean ratio of
band width to observed min-max width. Here ``s`` runs over the grid
0.500, 0.501, ..., 3.000 and the search is exact and deterministic:

* r(s) = s * A and w(s) = s * B are linear in s -> two averages per station.
* Row i is covered at grid point k (s = k/1000) iff k >= k_i with
  k_i = ceil(1000 * err_i / sigma_i) -> p(k) is the running count of a
  histogram of k_i, clamped to [500, 3001]. The histogram has at most 2502
  bins per station whatever the number of rows, and is pre-aggregated before
  any shuffle, so a hot station costs no more than any other.
* Between two histogram bins p is constant and fitness is concave and
  piecewise linear in k with kinks at r = 1.10 and w = 1.05, so its maximum
  over the grid is at a run end or next to a kink. Those candidates (two per
  bin plus six per station) are all that is evaluated: no station x grid
  cross join and no join at all. Ties go to the smallest s.

Integer thousandths keep bin edges exact: a binary fraction at a bin edge
cannot flip inclusion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvio import config as C

K_MIN = int(round(C.SCALE_GRID_MIN / C.SCALE_GRID_STEP))
K_MAX = int(round(C.SCALE_GRID_MAX / C.SCALE_GRID_STEP))
PER_UNIT = int(round(1 / C.SCALE_GRID_STEP))
NEVER = 1_000_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cover_index(obs="obs", pred="pred", sigma="sigma_base") -> Column:
    """k_i: the smallest grid index (thousandths of s) at which the row is covered."""
    err = F.abs(_c(obs) - _c(pred))
    sb = _c(sigma)
    k = F.ceil(F.try_divide(err * PER_UNIT, sb)).cast("long")
    return (
        F.when(sb > 0, k)
        .when(err == 0, F.lit(0).cast("long"))
        .otherwise(F.lit(NEVER).cast("long"))
    )


def fitness(k: Column, p: Column, a: Column, b: Column) -> Column:
    """I9 at grid index k, with p the coverage there and r = s*A, w = s*B."""
    s = k.cast("double") / PER_UNIT
    r = s * a
    w = s * b
    return (
        -F.abs(p - F.lit(C.TARGET_COVERAGE))
        - F.lit(C.REL_WIDTH_WEIGHT) * F.abs(r - F.lit(C.TARGET_REL_WIDTH))
        - F.lit(C.WIDTH_RATIO_PENALTY) * F.greatest(F.lit(0.0), w - F.lit(C.WIDTH_RATIO_CAP))
    )


def scale_search(rows: DataFrame, obs="obs", pred="pred", sigma="sigma_base", obs_width="obs_width",
                 keys=("station_id",)) -> DataFrame:
    """One row per key group: s_opt, fitness, coverage, rel_width, width_ratio at s_opt.

    ``rows`` are the calibration rows (e.g. the test split) with the base
    sigma before scaling. No join: the histogram is a grouped aggregate
    (partial aggregation before any shuffle), the group coefficients are
    windows over its bins, and candidates are exploded from histogram rows
    (a fixed candidate repeated on several bins only duplicates an identical
    row). The population sd comes from the bin moments (sum, sum of squares).
    """
    return search_bins(cover_bins(rows, obs, pred, sigma, obs_width, keys), keys)


#: Sums of a bin; bins of different rows are merged by adding them.
BIN_SUMS = ("_cnt", "_s_sb2", "_c_sb2", "_s_r", "_c_r", "_s_o", "_s_o2", "_c_o")


def cover_bins(rows: DataFrame, obs="obs", pred="pred", sigma="sigma_base", obs_width="obs_width", keys=("station_id",)) -> DataFrame:
    """The histogram of a search: a row for a group and first-covered index ``_k``, with ``BIN_SUMS``.

    It can be stored and added to: the search over the bins of all parts of the
    rows equals the search over the rows, as long as each row's sigma stays.
    """
    keys = list(keys)
    sb2 = _c(sigma) * 2
    o = _c(obs)
    # (1) histogram of first-covered grid indices with the moments the
    # coefficients need. A grouped aggregate: partial aggregation runs before
    # any shuffle, so a group holding a third of all rows sends one partial
    # row per bin and task; afterwards a group has <= 2502 bins.
    base = rows.select(
        *keys,
        F.least(F.greatest(cover_index(obs, pred, sigma), F.lit(K_MIN)), F.lit(K_MAX + 1)).alias("_k"),
        sb2.alias("_sb2"), F.try_divide(sb2, _c(obs_width)).alias("_r"), o.alias("_o"),
    )
    return base.groupBy(*keys, "_k").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.sum("_sb2").alias("_s_sb2"), F.count("_sb2").alias("_c_sb2"),
        F.sum("_r").alias("_s_r"), F.count("_r").alias("_c_r"),
        F.sum("_o").alias("_s_o"), F.sum(F.col("_o") * F.col("_o")).alias("_s_o2"), F.count("_o").alias("_c_o"),
    )


def search_bins(bins: DataFrame, keys=("station_id",)) -> DataFrame:
    """The best scale of each group from its bins, those of several parts added up first."""
    keys = list(keys)
    hist0 = bins.groupBy(*keys, "_k").agg(*[F.sum(c).alias(c) for c in BIN_SUMS])
    # group coefficients over the bins: r(s) = s*A, w(s) = s*B
    wg = Window.partitionBy(*keys)
    tot = {c: F.sum(c).over(wg) for c in ("_cnt", "_s_sb2", "_c_sb2", "_s_r", "_c_r", "_s_o", "_s_o2", "_c_o")}
    mean_o = F.try_divide(tot["_s_o"], tot["_c_o"])
    var_o = F.greatest(F.lit(0.0), F.try_divide(tot["_s_o2"], tot["_c_o"]) - mean_o * mean_o)
    hist = hist0.select(
        *keys, "_k", "_cnt",
        tot["_cnt"].alias("_n"),
        F.try_divide(F.try_divide(tot["_s_sb2"], tot["_c_sb2"]), F.sqrt(var_o) + F.lit(C.REL_WIDTH_EPS)).alias("_A"),
        F.try_divide(tot["_s_r"], tot["_c_r"]).alias("_B"),
    )

    # (2) one event per bin plus candidates: run ends around the bin, grid ends, kinks.
    def clamp(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(K_MIN)), F.lit(K_MAX)).cast("long")

    kink_r = F.try_divide(F.lit(C.TARGET_REL_WIDTH * PER_UNIT), F.col("_A"))
    kink_w = F.try_divide(F.lit(C.WIDTH_RATIO_CAP * PER_UNIT), F.col("_B"))

    def item(pos: Column, kind: int, cnt: Column) -> Column:
        return F.struct(pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), cnt.cast("long").alias("cnt"))

    zero = F.lit(0)
    items = F.array(
        item(F.col("_k"), 0, F.col("_cnt")),
        item(clamp(F.col("_k")), 1, zero), item(clamp(F.col("_k") - 1), 1, zero),
        item(F.lit(K_MIN), 1, zero), item(F.lit(K_MAX), 1, zero),
        item(clamp(F.floor(kink_r)), 1, zero), item(clamp(F.ceil(kink_r)), 1, zero),
        item(clamp(F.floor(kink_w)), 1, zero), item(clamp(F.ceil(kink_w)), 1, zero),
    )
    ev = hist.select(*keys, "_n", "_A", "_B", F.inline(items)).where(F.col("pos").isNotNull())

    # (3) coverage at each candidate = running count of bins at or below it
    # (bins sort before candidates at equal position).
    w = Window.partitionBy(*keys).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = ev.withColumn("_covered", F.sum("cnt").over(w)).where(F.col("kind") == 1)

    # (4) fitness on candidates, (5) best = max fitness, then smallest s.
    scored = run.withColumn("_p", F.col("_covered") / F.col("_n"))
    scored = scored.withColumn("_fit", fitness(F.col("pos"), F.col("_p"), F.col("_A"), F.col("_B")))
    best = scored.groupBy(*keys).agg(
        F.max_by(F.struct("pos", "_fit", "_p", "_A", "_B"), F.struct(F.col("_fit"), -F.col("pos"))).alias("_b"))
    s = F.col("_b.pos").cast("double") / PER_UNIT
    return best.select(
        *keys,
        s.alias("s_opt"),
        F.col("_b._fit").alias("fitness"),
        F.col("_b._p").alias("coverage"),
        (s * F.col("_b._A")).alias("rel_width"),
        (s * F.col("_b._B")).alias("width_ratio"),
    )

"""Ensemble, sigma and band expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.functions import season


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def learner_average(net, tree, weights=C.LEARNER_WEIGHTS) -> Column:
    """w_net * net + w_tree * tree."""
    return F.lit(weights[0]) * _col(net) + F.lit(weights[1]) * _col(tree)


def gated_mix(a, b, g) -> Column:
    """H8: g * a + (1 - g) * b (used for predictions and observations alike)."""
    g = _col(g)
    return g * _col(a) + (F.lit(1.0) - g) * _col(b)


def observed_width(obs_min, obs_max) -> Column:
    """H9: max(1e-6, max - min)."""
    return F.greatest(F.lit(C.OBS_WIDTH_FLOOR), _col(obs_max) - _col(obs_min))


def mixed_sigma(sigma_a, sigma_b, pred_a, pred_b, month="month") -> Column:
    """H10 (training form): sqrt(g sA^2 + (1-g) sB^2 + w (yA - yB)^2) * f."""
    g = season.gate(month)
    w = season.disagreement_weight(month)
    sa, sb = _col(sigma_a), _col(sigma_b)
    d = _col(pred_a) - _col(pred_b)
    return F.sqrt(g * sa * sa + (F.lit(1.0) - g) * sb * sb + w * d * d) * season.season_factor(month)


def serving_sigma_mix(sigma_a, sigma_b, month="month") -> Column:
    """Disagreement replaced by the constant 10^2; reported before the factor."""
    g = season.gate(month)
    w = season.disagreement_weight(month)
    sa = F.coalesce(_col(sigma_a), F.lit(C.SIGMA_DEFAULT))
    sb = F.coalesce(_col(sigma_b), F.lit(C.SIGMA_DEFAULT))
    dis = C.SERVING_DISAGREEMENT ** 2
    return F.sqrt(g * sa * sa + (F.lit(1.0) - g) * sb * sb + w * F.lit(dis))


def serving_sigma(sigma_a, sigma_b, scale, month="month") -> Column:
    """sigma = sigma_mix * f * s, with s defaulting to 1.2."""
    s = F.coalesce(_col(scale), F.lit(C.SCALE_SERVING_DEFAULT))
    return serving_sigma_mix(sigma_a, sigma_b, month) * season.season_factor(month) * s


def legacy_sigma(scale=None, month="month") -> Column:
    """Base 15 wet / 10 dry, times f and s."""
    base = F.when(season.is_wet(month), F.lit(C.LEGACY_SIGMA_WET)).otherwise(F.lit(C.LEGACY_SIGMA_DRY))
    s = F.lit(C.SCALE_SERVING_DEFAULT) if scale is None else _col(scale)
    return base * season.season_factor(month) * s


def lower(pred, sigma, clip_at_zero: bool = False) -> Column:
    """Pred - sigma, optionally floored at 0 (serving)."""
    lo = _col(pred) - _col(sigma)
    return F.greatest(F.lit(0.0), lo) if clip_at_zero else lo


def upper(pred, sigma) -> Column:
    return _col(pred) + _col(sigma)


def covered(obs, lo, up) -> Column:
    """D11 row flag: inclusive lo <= obs <= up."""
    return (_col(obs) >= _col(lo)) & (_col(obs) <= _col(up))


def nominal_confidence() -> Column:
    """H25."""
    return F.lit(C.NOMINAL_CONFIDENCE)

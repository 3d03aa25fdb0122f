"""One training run end to end.

frame -> fit ensemble -> save model -> score the band (searched or fixed
scale, calibrated on 'test' for parity or 'val' out of sample) -> per-station
report -> run rows and model committed together by one manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fluvio.config import TrainConfig
from fluvio.plans import learn, registry, score
from fluvio.session import scratch_path


@dataclass
class RunResult:
    ensemble: learn.TrainedEnsemble
    band: DataFrame
    report: DataFrame
    run_id: str
    model_path: str
    runs_path: str


def train_evaluate_register(frame: DataFrame, cfg: TrainConfig, root: str, run_id: str | None = None) -> RunResult:
    """Train, evaluate and commit below ``root``: ``models/``, ``runs/``, ``manifests/`` and the trees' ``segments/``.

    A call with the ``run_id`` of one that ended goes on from its saved segments.
    """
    # one reliable checkpoint of the feature frame serves the fit and the
    # scoring: the fact table is scanned once per run
    root, run_id = root.rstrip("/"), run_id or uuid.uuid4().hex
    frame = learn.checkpointed(frame, cfg.partitions)
    ens = learn.fit_ensemble(frame, cfg, checkpoint=False, path=f"{root}/segments/{run_id}")
    model_path = f"{root}/models/{run_id}"
    ens.save(model_path)
    # the scored rows are written once for the scale search and the report, which
    # read the columns they need and have the memory to themselves
    path = scratch_path(frame.sparkSession, "scored")
    ens.transform(frame).write.parquet(path)
    scored = score.Scored(frame.sparkSession.read.parquet(path))
    band = score.scored_band(frame, scored, cfg.scale, cfg.calibration_split)
    report = score.run_report(band)
    registry.commit_run(registry.run_rows(report, model_path, run_id), root, run_id, model_path)
    return RunResult(ens, band, report, run_id, model_path, f"{root}/runs")

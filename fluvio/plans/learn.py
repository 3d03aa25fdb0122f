"""Two-target, two-learner ensemble on Spark ML.

* Target A = next-month flow, target B = next-month maximum (I4).
* Tree learner: ``GBTRegressor`` on raw features (I2), boosted in segments:
  each segment fits what the ones before leave of the target, is saved when it
  is fitted and cuts the lineage, so a run that ended goes on from its last
  saved segment, and with a held-out part the error after a segment decides
  whether the next one starts, and whether only its first rounds are needed to
  see the stop (I8). Spark samples feature subsets per node, the
  original per tree, so trees are not bit-equal; seeds are fixed (42 for A, 43
  for B). Spark's squared loss fits twice the residual, so its step is half the
  learning rate asked for; the first tree of a fit, here of each segment,
  always has full weight.
* Scaled learner (I3): Spark ML's ``LinearRegression`` with an L2 penalty on
  standardised features. Spark ML has no neural regressor, and rebuilding one
  would be rebuilding a learner's internals.
* Scaler fitted on train UNION val (G1) with the population sd and unit
  scale for constant features, as the original; learners on train (I1).
* The learners are pooled over all stations: one distributed fit per
  learner, whatever the number of stations. Rows are dealt by their key first,
  so a fit does not depend on how the input happened to be partitioned.

The fitted stages form one ``PipelineModel`` (assembler, scaler, learners),
saved and loaded as one directory (A7).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.config import LegacyParams, TrainConfig, TreeParams
from fluvio.functions import uncertainty as U
from fluvio.operators import features as feat
from fluvio.operators.validate import fill_zero
from fluvio.session import scratch_path, shared_dir


def _outputs(model: PipelineModel) -> set[str]:
    """Names of the learners: prediction columns, and sums over a learner's segments."""
    sums = {s.getStatement().rsplit("`", 2)[1] for s in model.stages if isinstance(s, SQLTransformer)}
    return sums | {s.getPredictionCol() for s in model.stages if hasattr(s, "getPredictionCol")}


def _drop_scratch(df: DataFrame) -> DataFrame:
    return df.drop("features", "features_scaled", *[c for c in df.columns if c.startswith(("_z_", "_s_"))])


@dataclass
class TrainedEnsemble:
    """Fitted stages: assembler, scaler, and the learners of both targets."""

    model: PipelineModel
    features: list[str]

    def transform(self, df: DataFrame, weights=C.LEARNER_WEIGHTS) -> DataFrame:
        """The learner outputs and the per-target learner averages (H7).

        An ensemble fitted without trees has the scaled learners alone.
        """
        out = _drop_scratch(self.model.transform(df))
        have = _outputs(self.model)
        for t in "AB":
            both = f"tree_{t}" in have
            out = out.withColumn(f"pred_{t}", U.learner_average(f"net_{t}", f"tree_{t}", weights) if both else F.col(f"net_{t}"))
        return out

    def predict_bare(self, df: DataFrame) -> DataFrame:
        """I5 on bare features: absent columns and nulls count as 0, any column order.

        The gate follows the month recovered from its sine (H19), as bare
        features hold no month; adds ``pred_A``, ``pred_B`` and ``pred``.
        """
        from fluvio.functions import season

        out = self.transform(fill_zero(df, self.features))
        return out.withColumn("pred", U.gated_mix("pred_A", "pred_B", season.gate(season.month_from_sin("month_sin"))))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path.rstrip('/')}/pipeline")

    @classmethod
    def load(cls, path: str, features=C.FEATURE_COLUMNS) -> "TrainedEnsemble":
        return cls(PipelineModel.load(f"{path.rstrip('/')}/pipeline"), list(features))


def _gbt(label: str, pred: str, p: TreeParams, seed: int, features_col="features") -> GBTRegressor:
    return GBTRegressor(featuresCol=features_col, labelCol=label, predictionCol=pred, maxIter=p.max_iter,
                        stepSize=p.learning_rate / 2, maxDepth=p.max_depth, subsamplingRate=p.subsampling_rate,
                        featureSubsetStrategy=p.feature_subset, seed=seed, checkpointInterval=-1)


def best_round(errors: list[float], patience: int) -> int:
    """The round (from 1) with the least error before ``patience`` rounds without a better one."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


#: What a fit's own passes over its rows take (bins, the rows left, the held-out error), in rounds: 23 s against 2.6 s
#: a round at 60 times sf0.1.
FIT_ROUNDS = 10

#: Row keys that training frames carry, where they have them.
KEYS = ("station_id", "year", "month")


def _digest(rows: DataFrame, label: str) -> str:
    """Identity of the training rows, whatever their order: number and sum of row hashes."""
    keys = [c for c in (*KEYS, "features", "held", label) if c in rows.columns]
    h = F.xxhash64(*[vector_to_array(c) if c == "features" else F.col(c) for c in keys]).cast("decimal(38,0)")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return f"{r.n}:{r.h}"


def _saved(spark: SparkSession, path: str, signature: str) -> GBTRegressionModel | None:
    """A segment that was saved whole: its marker is written last, and names rows, label and parameters."""
    try:
        marker = [r.value for r in spark.read.text(f"{path}/done").collect()]
    except AnalysisException:
        return None  # no such folder: the segment was never saved whole
    if not marker:
        return None
    if marker != [signature]:
        raise ValueError(f"{path} was fitted to other rows or parameters")
    return GBTRegressionModel.load(f"{path}/model")


@dataclass
class Boosted:
    """A fitted tree learner: pipeline stages that end in its column, its rounds, and the held-out error of each round fitted."""

    stages: list
    rounds: int
    errors: list[float]


def boost(rows: DataFrame, label: str, pred: str, p: TreeParams, seed: int, path: str | None = None) -> Boosted:
    """Boosting in segments of ``p.segment`` rounds.

    ``rows`` has ``features``, ``label`` and, with ``p.patience``, ``held``
    (boolean: for the error only). ``path`` keeps the segments (a folder below
    the shared one if not given); a call with the same path, rows and
    parameters goes on after the last one saved. Without ``p.patience`` all
    ``p.max_iter`` rounds are fitted. With it, no segment starts once that many
    rounds brought no better error, and the learner has the trees up to the
    best round: those of the last segment needed are taken one by one. Where
    a segment's first rounds can bring the stop, they are fitted first, unless
    that spares less than it costs in vain: by its seed a segment's first trees
    are the same whatever its length, so the rest is needed only if one of them
    is better.
    """
    spark = rows.sparkSession
    path = (path or scratch_path(spark, f"boost-{pred}")).rstrip("/")
    held = F.col("held") if p.patience else F.lit(False)
    signature = f"{label} {p} {seed} {_digest(rows, label)}"
    left = rows.select("features", held.alias("held"), F.col(label).cast("double").alias("_left"))
    models, errors, fitted = [], [], 0

    def segment(n: int, at: str) -> GBTRegressionModel:
        model = _saved(spark, at, signature)
        if model is None:
            model = _gbt("_left", f"_s_{pred}_{len(models)}", replace(p, max_iter=n), seed + len(models)).fit(left.where("NOT held"))
            model.write().overwrite().save(f"{at}/model")
            spark.range(0, 1, 1, 1).select(F.lit(signature).alias("value")).write.mode("overwrite").text(f"{at}/done")
        return model

    while fitted < p.max_iter:
        n = min(p.segment, p.max_iter - fitted)
        at = f"{path}/segment-{len(models):04d}"
        wait = best_round(errors, p.patience) + p.patience - fitted if errors else n  # rounds none of which may be better, for the stop
        if 2 * wait + FIT_ROUNDS <= n and _saved(spark, at, signature) is None:
            model = segment(wait, f"{at}-first-{wait}")
            first = model.evaluateEachIteration(left.where("held"), "squared")
            if fitted + wait - best_round(errors + first, p.patience) >= p.patience:
                models.append(model)
                errors += first
                fitted += wait
                break
        model = segment(n, at)
        models.append(model)
        fitted += n
        if p.patience:
            errors += model.evaluateEachIteration(left.where("held"), "squared")
            if fitted - best_round(errors, p.patience) >= p.patience:
                break
        if fitted < p.max_iter:
            left = model.transform(left).select("features", "held", (F.col("_left") - F.col(model.getPredictionCol())).alias("_left")).checkpoint(eager=True)
    rounds = best_round(errors, p.patience) if p.patience else fitted
    whole, rest = divmod(rounds, p.segment)
    stages = models[:whole]
    parts = [f"`{m.getPredictionCol()}`" for m in stages]
    if rest and whole < len(models) and models[whole].getNumTrees == rest:
        stages.append(models[whole])
        parts.append(f"`{models[whole].getPredictionCol()}`")
    elif rest:
        last = models[whole]
        for i, (tree, weight) in enumerate(zip(last.trees[:rest], last.treeWeights)):
            stages.append(tree.setFeaturesCol("features").setPredictionCol(f"_s_{pred}_{whole}_{i}"))
            parts.append(f"{weight!r}D * `_s_{pred}_{whole}_{i}`")
    return Boosted([*stages, SQLTransformer(statement=f"SELECT *, {' + '.join(parts)} AS `{pred}` FROM __THIS__")], rounds, errors)


def _ridge(label: str, pred: str, reg: float, max_iter: int) -> LinearRegression:
    return LinearRegression(featuresCol="features_scaled", labelCol=label, predictionCol=pred,
                            regParam=reg, elasticNetParam=0.0, maxIter=max_iter, standardization=False)


def fit_population_scaler(rows: DataFrame, features, out_col: str = "features_scaled") -> list:
    """I1 / D15 with the original's convention: population sd, unit scale when the sd is 0.

    One aggregate gives 2 x len(features) numbers (a bounded single row); they
    become literals of a ``SQLTransformer`` (z-score columns) followed by a
    ``VectorAssembler``: ordinary Spark ML stages, saved with the pipeline.
    """
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = rows.agg(*aggs).first()
    zs = []
    for c in features:
        m = st[f"m_{c}"] if st[f"m_{c}"] is not None else 0.0
        sd = st[f"s_{c}"]
        sd = 1.0 if sd is None or sd == 0 else sd
        zs.append(f"(`{c}` - {m!r}) / {sd!r} AS `_z_{c}`")
    sql = SQLTransformer(statement=f"SELECT *, {', '.join(zs)} FROM __THIS__")
    asm = VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol=out_col, handleInvalid="keep")
    return [sql, asm]


def checkpointed(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cut the lineage (panel -> features) before iterative fits: a reliable
    checkpoint in the shared folder, so a lost executor does not replay the scan.

    The rows are always dealt by the hash of their key into ``partitions``
    (default: the cluster's parallelism) and sorted, so row sampling inside a
    learner sees the same rows whatever the layout of the input.
    """
    shared_dir(df.sparkSession)
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    keys = ["station_id", "year", "month"]
    return df.repartition(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)


def fit_ensemble(frame: DataFrame, cfg: TrainConfig = TrainConfig(), features=C.FEATURE_COLUMNS,
                 checkpoint: bool = True, path: str | None = None) -> TrainedEnsemble:
    """Fit the learners of both targets (the trees only if ``cfg.tree`` is given).

    ``checkpoint=False`` when ``frame`` is already a checkpoint
    (``plans.training_run`` checkpoints once for fit and scoring). ``path`` is
    where the trees' segments are kept, so that a second call goes on from them.
    With ``cfg.tree.patience`` the validation years are the held-out part.
    """
    features = list(features)
    data = frame.select("station_id", "year", "month", "split", *features, C.TARGET_A, C.TARGET_B)
    data = checkpointed(data, cfg.partitions) if checkpoint else data
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    scaler = fit_population_scaler(data.where(F.col("split").isin("train", "val")), features)
    rows = PipelineModel([assembler, *scaler]).transform(data.where(F.col("split").isin("train", "val"))).withColumn("held", F.col("split") == "val")
    # Not persisted: the checkpoint is read a few times only, and the memory is for the trees' own rows, read at every level.
    scaled = rows.where("NOT held").select("features_scaled", C.TARGET_A, C.TARGET_B)
    fits = []
    for target, t, seed in ((C.TARGET_A, "A", cfg.tree and cfg.tree.seed_a), (C.TARGET_B, "B", cfg.tree and cfg.tree.seed_b)):
        fits.append(lambda target=target, t=t: [_ridge(target, f"net_{t}", cfg.net.reg_param, cfg.net.max_iter).fit(scaled)])
        if cfg.tree is not None:
            own = rows.select(*KEYS, "features", "held", target)
            fits.append(lambda target=target, t=t, seed=seed, own=own: boost(
                own if cfg.tree.patience else own.where("NOT held"), target, f"tree_{t}", cfg.tree, seed, path and f"{path}/tree_{t}").stages)
    # The fits are independent: submit them from driver threads so their
    # (many, small) jobs share the executors, as Spark ML's own
    # CrossValidator(parallelism=...) does.
    with ThreadPoolExecutor(max_workers=len(fits)) as pool:
        fitted = [stage for stages in pool.map(lambda f: f(), fits) for stage in stages]
    return TrainedEnsemble(PipelineModel([assembler, *scaler, *fitted]), features)


@dataclass
class LegacyModel:
    """Legacy trainer output: assembler, scaler, scaled learner and tree in one pipeline."""

    pipeline: PipelineModel
    rounds: int = 0
    weights: tuple[float, float] = C.LEGACY_LEARNER_WEIGHTS
    errors: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return _drop_scratch(self.pipeline.transform(df)).withColumn("ensemble", U.learner_average("net", "tree", self.weights))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path.rstrip('/')}/pipeline")

    @classmethod
    def load(cls, path: str, weights=C.LEGACY_LEARNER_WEIGHTS) -> "LegacyModel":
        pipeline = PipelineModel.load(f"{path.rstrip('/')}/pipeline")
        trees = [s for s in pipeline.stages if isinstance(s, (GBTRegressionModel, DecisionTreeRegressionModel))]
        return cls(pipeline, sum(s.getNumTrees if isinstance(s, GBTRegressionModel) else 1 for s in trees), weights)


def fit_legacy(frame: DataFrame, p: LegacyParams = LegacyParams(), path: str | None = None) -> tuple[LegacyModel, DataFrame]:
    """I8: the legacy trainer.

    Features: raw year, month, meteo and lags of the this-month flow (E6);
    target: this-month flow. An 80/20 stable hash holdout (I7) replaces the
    shuffled split. The tree is boosted in segments of ``p.patience`` rounds and
    stops by the holdout error (``boost``). Returns the model and the holdout
    rows scored by both learners and the 0.6 / 0.4 ensemble.
    """
    feats = C.LEGACY_FEATURE_COLUMNS
    data = feat.hash_holdout(frame, p.holdout_pct)
    data = checkpointed(data.select("station_id", "year", "month", "flow", "holdout",
                                    *[c for c in feats if c not in ("year", "month")]), p.partitions)
    is_train = F.col("holdout") == "train"
    assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    prep = [assembler, *fit_population_scaler(data.where(is_train), feats)]
    rows = PipelineModel(prep).transform(data).withColumn("held", ~is_train)
    params = TreeParams(max_iter=p.tree_rounds, learning_rate=p.tree_rate, max_depth=p.tree_depth, subsampling_rate=p.subsampling_rate,
                        feature_subset="0.8", segment=p.patience, patience=p.patience)
    # Not persisted: the checkpoint is read a few times only, and the memory is for the trees' own rows, read at every level.
    net = _ridge("flow", "net", p.reg_param, p.net_max_iter).fit(rows.where("NOT held").select("features_scaled", "flow"))
    tree = boost(rows.select(*KEYS, "features", "held", "flow"), "flow", "tree", params, 42, path)
    model = LegacyModel(PipelineModel([*prep, net, *tree.stages]), tree.rounds, p.weights, tree.errors)
    return model, model.transform(data.where(~is_train))


def legacy_metrics(scored: DataFrame) -> DataFrame:
    """RMSE and R^2 on the holdout for each learner and the ensemble: one aggregate, then a row per learner."""
    from fluvio.operators.metrics import skill_expr_map

    learners = ("net", "tree", "ensemble")
    maps = {m: skill_expr_map("flow", m) for m in learners}
    one = scored.agg(F.count(F.lit(1)).alias("n"), *[maps[m][k].alias(f"{m}_{k}") for m in learners for k in ("rmse", "r2")])
    return one.select("n", F.expr("stack(3, " + ", ".join(f"'{m}', {m}_rmse, {m}_r2" for m in learners) + ")").alias("learner", "rmse", "r2")).select(
        "learner", "n", "rmse", "r2")


def legacy_report(scored: DataFrame) -> DataFrame:
    """Per-station holdout skill of the legacy ensemble, for the run registry."""
    from fluvio.operators.metrics import skill_expr_map

    aggs = [F.count(F.lit(1)).alias("n_test"), *[e.alias(k) for k, e in skill_expr_map("flow", "ensemble").items()]]
    for m in ("net", "tree", "ensemble"):
        e = skill_expr_map("flow", m)
        aggs += [e["rmse"].alias(f"{m}_rmse"), e["r2"].alias(f"{m}_r2")]
    return scored.groupBy("station_id").agg(*aggs)

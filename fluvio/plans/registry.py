"""Model-run registry.

One row per (run, station); the status of a station is its latest run
(``max_by`` over ``trained_on``), never a driver loop over files. A run is
published by ``commit_run``: model and rows first, then a manifest of all their
files, which alone makes it visible to ``committed_runs``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio import config as C
from fluvio.operators.selection import latest_by
from fluvio.plans.score import METRICS, metric_struct
from fluvio.sources.schemas import MODEL_RUNS


def run_rows(report: DataFrame, model_path: str, run_id: str | None = None,
             features=C.FEATURE_COLUMNS, version: str = C.MODEL_VERSION) -> DataFrame:
    """A8 rows from a per-station report (``plans.score.run_report``)."""
    rid = run_id or uuid.uuid4().hex
    # A report without some metric (the legacy trainer's has no band) gives null there.
    absent = ["sigma_A", "sigma_B", "s_opt", "coverage", "n_train", "nse_peaks", *[f"train_{m}" for m in METRICS]]
    report = report.select("*", *[F.lit(None).cast("double").alias(c) for c in absent if c not in report.columns])
    return report.select(
        F.lit(rid).alias("run_id"),
        F.col("station_id").cast("long").alias("station_id"),
        F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
        metric_struct(report, "train_").alias("train_metrics"),
        metric_struct(report, "").alias("test_metrics"),
        F.struct(*[(F.col(c) if c in report.columns else F.lit(None).cast("double")).alias(c)
                   for c in ("net_rmse", "net_r2", "tree_rmse", "tree_r2", "ensemble_rmse", "ensemble_r2")])
        .alias("learner_metrics"),
        "sigma_A", "sigma_B", "s_opt",
        F.col("coverage").alias("coverage"),
        F.col("n_train").cast("long").alias("train_samples"),
        F.col("n_test").cast("long").alias("test_samples"),
        F.lit(model_path).alias("model_path"),
        F.lit(version).alias("model_version"),
        F.current_timestamp().alias("trained_on"),
    )


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_RUNS).parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """the latest run per station."""
    return latest_by(runs, ["station_id"], "trained_on")


#: One row for a file of a committed run: ``parts`` is the number of the run's rows here.
MANIFEST = "run_id string, model_path string, file string, length long, sha256 string, parts long"


def _plain(c) -> Column:
    """A path without a local file scheme, so that listed and given paths compare."""
    return F.regexp_replace(c, "^file:/+", "/")


def _files(spark: SparkSession, *folders: str) -> DataFrame:
    """Files below the folders, hidden and temporary ones left out by Spark; ``content`` is only read where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))


def commit_run(rows: DataFrame, root: str, run_id: str, model_path: str) -> None:
    """A8 in one step: the run's rows, then its manifest; a run without a whole manifest does not exist for readers.

    The manifest lists every file of the model and of the rows with length and
    SHA-256 and is written last, as one file; committing a run twice raises.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    if manifests(spark, root).where(F.col("run_id") == run_id).limit(1).count():
        raise ValueError(f"run {run_id} is committed already")
    rows.write.mode("overwrite").parquet(f"{root}/runs/{run_id}")
    files = _files(spark, model_path, f"{root}/runs/{run_id}")
    parts = files.select("path").count()
    files.select(F.lit(run_id).alias("run_id"), F.lit(model_path).alias("model_path"), _plain(F.col("path")).alias("file"), "length",
                 F.sha2("content", 256).alias("sha256"), F.lit(parts).cast("long").alias("parts")).coalesce(1).write.parquet(f"{root}/manifests/{run_id}")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The rows of whole manifests below ``root``."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/manifests")
    except AnalysisException:  # no run was ever committed here
        rows = spark.createDataFrame([], MANIFEST)
    whole = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("m")).where("n = m").select("run_id")
    return rows.join(whole, "run_id", "left_semi")


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run rows that readers may see: those of files that a whole manifest lists."""
    seen = manifests(spark, root).select(F.col("run_id").alias("_run"), F.col("file").alias("_file"))
    try:
        rows = spark.read.schema(MODEL_RUNS).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/runs")
    except AnalysisException:
        return spark.createDataFrame([], MODEL_RUNS)
    rows = rows.withColumn("_at", _plain(F.col("_metadata.file_path")))
    return rows.join(seen, (F.col("run_id") == F.col("_run")) & (F.col("_at") == F.col("_file")), "left_semi").drop("_at")


def manifest_holds(spark: SparkSession, root: str, contents: bool = False) -> DataFrame:
    """``run_id, holds``: whether every file of a run's manifest is there with its length (and, with ``contents``, its checksum)."""
    listed = manifests(spark, root)
    places = [r.f for r in listed.select(F.col("model_path").alias("f")).distinct().collect()]  # one for a run
    if not places:
        return spark.createDataFrame([], "run_id string, holds boolean")
    now = _existing(spark, [*places, f"{root.rstrip('/')}/runs"])
    now = now.select(_plain(F.col("path")).alias("file"), F.col("length").alias("_length"), (F.sha2("content", 256) if contents else F.lit(None).cast("string")).alias("_sha"))
    same = (F.col("length") == F.col("_length")) & (F.col("sha256") == F.col("_sha") if contents else F.lit(True))
    return listed.join(now, "file", "left").groupBy("run_id").agg(F.min(F.coalesce(same, F.lit(False))).alias("holds"))


def _existing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Files below those of the folders that exist."""
    found = None
    for f in folders:
        try:
            df = _files(spark, f)
        except AnalysisException:
            continue  # the folder is gone: its files count as absent
        found = df if found is None else found.unionByName(df)
    return spark.createDataFrame([], "path string, length long, content binary") if found is None else found.select("path", "length", "content")


def model_files_present(runs: DataFrame, root: str) -> DataFrame:
    """A7 check: ``model_path, files_present`` for the runs' distinct model paths below ``root``.

    A saved pipeline names its stages in ``pipeline/metadata``; each must have
    its own metadata, each fitted learner its data too, and if a learner is for
    target A or B, both targets must have one. Spark lists the files (contents
    of the small metadata alone are read) and joins them to the paths.
    """
    spark = runs.sparkSession
    at, inside = (F.regexp_extract(_plain(F.col("path")), "^(.*?)/(pipeline/.*)/part-[^/]*$", k) for k in (1, 2))
    folders = _files(spark, root).select(at.alias("at"), inside.alias("folder")).where("folder <> ''").distinct()
    # Metadata are text files; data are Parquet.
    texts = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-{00000,*.txt}").text(root)
             .select(F.col("_metadata.file_path").alias("path"), "value"))
    said = texts.select(at.alias("at"), inside.alias("folder"), "value").where("folder <> ''")
    stage = F.posexplode(F.from_json(F.get_json_object("value", "$.paramMap.stageUids"), "array<string>"))
    named = said.where("folder = 'pipeline/metadata'").select("at", stage.alias("i", "uid"), F.size(F.from_json(F.get_json_object("value", "$.paramMap.stageUids"), "array<string>")).alias("n"))
    place = F.concat(F.lit("pipeline/stages/"), F.lpad(F.col("i").cast("string"), F.length(F.col("n").cast("string")), F.lit("0")), F.lit("_"), F.col("uid"))
    stages = named.select("at", place.alias("stage"))
    about = said.select("at", F.regexp_extract("folder", "^(pipeline/stages/[^/]+)/metadata$", 1).alias("stage"),
                        F.endswith(F.get_json_object("value", "$.class"), F.lit("Model")).alias("learner"),
                        F.coalesce(F.get_json_object("value", "$.paramMap.predictionCol"), F.regexp_extract(F.get_json_object("value", "$.paramMap.statement"), " AS `(tree_.)` FROM ", 1)).alias("output")).where("stage <> ''")
    data = folders.select("at", F.regexp_extract("folder", "^(pipeline/stages/[^/]+)/data$", 1).alias("stage"), F.lit(True).alias("data")).where("stage <> ''").distinct()
    each = stages.join(about, ["at", "stage"], "left").join(data, ["at", "stage"], "left")
    whole = F.coalesce(F.col("learner") & F.col("data") | ~F.col("learner"), F.lit(False))
    target = lambda t: F.max(F.coalesce(F.rlike("output", F.lit(f"^(net|tree)_{t}$")), F.lit(False)))
    found = each.groupBy("at").agg((F.min(whole) & (target("A") == target("B"))).alias("whole"))
    models = runs.select("model_path").where("model_path IS NOT NULL").distinct()
    return models.join(found, _plain(F.rtrim(F.col("model_path"), F.lit("/"))) == F.col("at"), "left").select("model_path", F.coalesce("whole", F.lit(False)).alias("files_present"))


def model_status(runs: DataFrame, model_root: str, manifest_root: str | None = None) -> DataFrame:
    """Per station, whether its latest model (below ``model_root``) is whole, and its run summary.

    With ``manifest_root`` (where runs were committed) every file of the run's
    manifest must be there too, with its length.
    """
    last = latest_runs(runs)
    present = model_files_present(last, model_root)
    last = last.join(present, "model_path", "left")
    ok = F.coalesce(F.col("files_present"), F.lit(False))
    if manifest_root is not None:
        last = last.join(manifest_holds(runs.sparkSession, manifest_root), "run_id", "left")
        ok = ok & F.coalesce(F.col("holds"), F.lit(False))
    return last.select(
        "station_id", "run_id", "model_version", "trained_on", "model_path",
        F.when(ok, F.lit("loaded")).otherwise(F.lit("not_loaded")).alias("status"),
        ok.alias("ready_for_prediction"),
        F.when(~ok, F.lit("model files not found: train again (plans.training_run)")).alias("message"),
        "train_samples", "test_samples", "s_opt", "coverage",
        F.col("test_metrics.rmse").alias("test_rmse"), F.col("test_metrics.nse").alias("test_nse"),
        F.col("train_metrics.rmse").alias("train_rmse"),
        F.col("learner_metrics.net_rmse").alias("net_rmse"), F.col("learner_metrics.net_r2").alias("net_r2"),
        F.col("learner_metrics.tree_rmse").alias("tree_rmse"), F.col("learner_metrics.tree_r2").alias("tree_r2"),
        F.col("learner_metrics.ensemble_rmse").alias("ensemble_rmse"),
        F.col("learner_metrics.ensemble_r2").alias("ensemble_r2"),
    )

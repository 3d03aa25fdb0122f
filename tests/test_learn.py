"""I1-I6, I8, I11, streaming scoring on sf0.001: learners, serving, registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from fluvio import config as C
from fluvio.plans import learn


def _train_frame(spark, sf_small):
    from fluvio.queries import _frame
    return _frame(spark, sf_small)


def test_train_eval_and_serving(spark, sf_small, monkeypatch):
    import fluvio.queries
    monkeypatch.setattr(fluvio.queries, "QUERY_CFG", C.TrainConfig(splits=C.Splits(), tree=C.TreeParams(max_iter=20, segment=10, patience=10)))
    q = E.queries()
    runs = q["train_eval"](spark, sf_small).collect()
    assert runs and all(0.5 <= r.s_opt <= 3.0 and r.tree_rmse > 0 and r.net_rmse > 0 for r in runs)
    rows = q["score_requests"](spark, sf_small).collect()
    assert rows
    for r in rows:
        assert r.lower_bound <= r.predicted_flow <= r.upper_bound or r.lower_bound == 0.0
        assert r.lower_bound >= 0.0 and r.confidence_level == 0.83


def test_learners_learn_and_do_not_depend_on_the_layout(spark, sf_small):
    frame = _train_frame(spark, sf_small).checkpoint()
    cfg = C.TrainConfig(tree=C.TreeParams(max_iter=5, max_depth=3, learning_rate=0.5), partitions=4)
    got = []
    for n in (1, 8):
        ens = learn.fit_ensemble(frame.repartition(n), cfg)
        rows = ens.transform(frame.where("split = 'train'")).select(
            "station_id", "year", "month", C.TARGET_A, C.TARGET_B, "net_A", "tree_A", "net_B", "tree_B").toPandas()
        got.append(rows.sort_values(["station_id", "year", "month"]).reset_index(drop=True))
    for t, target in (("A", C.TARGET_A), ("B", C.TARGET_B)):
        for m in ("net", "tree"):
            error = ((got[0][f"{m}_{t}"] - got[0][target]) ** 2).mean() ** 0.5
            assert error < got[0][target].std(ddof=0), (m, t)
            assert np.allclose(got[0][f"{m}_{t}"], got[1][f"{m}_{t}"])


def test_tree_step_is_the_learning_rate(spark):
    # Two leaves with means 10 and 20: the first tree fits them whole, the second gets residual 0;
    # a wider second level shows the step: 4 values, depth 1.
    rows = [(1, 2000, m, float(m), y) for m, y in ((1, 0.0), (2, 4.0), (3, 20.0), (4, 24.0))]
    df = spark.createDataFrame(rows, "station_id long, year int, month int, x double, y double")
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    p = C.TreeParams(max_iter=2, learning_rate=0.2, max_depth=1, subsampling_rate=1.0, feature_subset="all")
    out = {r.month: r.p for r in learn._gbt("y", "p", p, 1).fit(data).transform(data).collect()}
    # First tree: x <= 2 -> 2, else 22. Residuals -2, 2, -2, 2; the best stump splits off month 1 (-2 | 2/3)
    # or month 4 (2 | -2/3); Spark fits twice the residual with half the rate: 0.2 times the residual's leaf mean.
    first = {1: 2.0, 2: 2.0, 3: 22.0, 4: 22.0}
    step = {m: out[m] - first[m] for m in first}
    left = {1: 0.2 * -2, 2: 0.2 * 2 / 3, 3: 0.2 * 2 / 3, 4: 0.2 * 2 / 3}
    right = {1: 0.2 * -2 / 3, 2: 0.2 * -2 / 3, 3: 0.2 * -2 / 3, 4: 0.2 * 2}
    assert any(all(abs(step[m] - want[m]) < 1e-9 for m in want) for want in (left, right)), step


def test_best_round_waits_for_patience():
    assert learn.best_round([5, 4, 4.5, 3, 3.1, 3.2], 2) == 4
    assert learn.best_round([5, 4, 4.5, 4.2, 1], 2) == 2
    assert learn.best_round([1], 20) == 1


def test_legacy_trainer_saves_serves_and_registers(spark, sf_small, tmp_path):
    from fluvio.operators import features as feat
    from fluvio.plans import registry
    from fluvio.queries import _panel
    lf = feat.legacy_frame(_panel(spark, sf_small))
    model, scored = learn.fit_legacy(lf, C.LegacyParams(tree_rounds=4, tree_depth=3, partitions=4))
    rows = {r.learner: r for r in learn.legacy_metrics(scored).collect()}
    assert set(rows) == {"net", "tree", "ensemble"} and all(r.rmse >= 0 for r in rows.values())
    model.save(str(tmp_path / "legacy"))
    again = learn.LegacyModel.load(str(tmp_path / "legacy"))
    a = sorted(r.ensemble for r in model.transform(lf).select("ensemble").collect())
    b = sorted(r.ensemble for r in again.transform(lf).select("ensemble").collect())
    assert np.allclose(a, b) and again.rounds == model.rounds
    runs = registry.run_rows(learn.legacy_report(scored), str(tmp_path / "legacy"), "legacy")
    registry.append_runs(runs, str(tmp_path / "runs"))
    status = registry.model_status(registry.read_runs(spark, str(tmp_path / "runs")), str(tmp_path)).collect()
    assert status and all(r.status == "loaded" for r in status)


def _boost_rows(spark, n=400):
    import math

    from pyspark.ml.feature import VectorAssembler
    rows = [(i % 7, 2000 + i // 12, i % 12 + 1, math.sin(i), float(i % 13), 10 * math.sin(i) + (i * 7919 % 101) / 20, i % 4 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "station_id long, year int, month int, a double, b double, y double, held boolean")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(learn.checkpointed(df, 2))


def _boosted(rows, stages):
    from pyspark.ml import PipelineModel
    return [r.p for r in PipelineModel(stages).transform(rows).orderBy("station_id", "year", "month").select("p").collect()]


def test_a_killed_fit_goes_on_to_equal_predictions(spark, tmp_path, monkeypatch):
    rows = _boost_rows(spark)
    p = C.TreeParams(max_iter=12, segment=4, max_depth=3, learning_rate=0.3)
    whole = _boosted(rows, learn.boost(rows, "y", "p", p, 7, str(tmp_path / "a")).stages)
    fits, gbt = [], learn._gbt

    class Killed(Exception):
        pass

    def dies(*args):
        fits.append(args)
        if len(fits) == 2:
            raise Killed
        return gbt(*args)

    monkeypatch.setattr(learn, "_gbt", dies)
    with pytest.raises(Killed):
        learn.boost(rows, "y", "p", p, 7, str(tmp_path / "b"))
    (tmp_path / "b/segment-0001/model/metadata").mkdir(parents=True)  # what a fit leaves that ends while it saves
    again = learn.boost(rows, "y", "p", p, 7, str(tmp_path / "b"))
    assert len(fits) == 4 and again.rounds == 12  # the first segment was not fitted again
    assert np.allclose(_boosted(rows, again.stages), whole, atol=1e-12)
    with pytest.raises(ValueError):
        learn.boost(rows.where("month < 12"), "y", "p", p, 7, str(tmp_path / "b"))


def test_segments_stop_at_the_best_round_without_a_refit(spark, monkeypatch):
    rows = _boost_rows(spark)
    p = C.TreeParams(max_iter=40, segment=5, max_depth=4, learning_rate=0.6, patience=5)
    n, gbt = [], learn._gbt
    monkeypatch.setattr(learn, "_gbt", lambda *a: (n.append(a), gbt(*a))[1])
    got = learn.boost(rows, "y", "p", p, 3)
    fitted = len(got.errors)
    assert len(n) * 5 == fitted < 40 and got.rounds == learn.best_round(got.errors, 5)  # no fit beyond, none again
    full = learn.boost(rows, "y", "p", C.TreeParams(**{**p.__dict__, "patience": 1000}), 3)
    assert np.allclose(full.errors[:fitted], got.errors) and learn.best_round(full.errors, 5) == got.rounds
    held = rows.where("held")
    mse = np.mean([(a - r.y) ** 2 for a, r in zip(_boosted(held, got.stages), held.orderBy("station_id", "year", "month").collect())])
    assert abs(mse - min(got.errors)) < 1e-9


def test_a_stop_early_in_a_segment_needs_no_whole_one(spark, tmp_path, monkeypatch):
    rows = _boost_rows(spark)  # their best round is an early one
    p = C.TreeParams(max_iter=60, segment=20, max_depth=4, learning_rate=0.6, patience=20)
    asked, gbt = [], learn._gbt
    monkeypatch.setattr(learn, "_gbt", lambda label, pred, p, seed: (asked.append(p.max_iter), gbt(label, pred, p, seed))[1])
    got = learn.boost(rows, "y", "p", p, 3, str(tmp_path / "b"))
    assert got.rounds <= 5 and asked == [20, got.rounds] and len(got.errors) == got.rounds + 20
    again = learn.boost(rows, "y", "p", p, 3, str(tmp_path / "b"))  # from what was saved
    assert len(asked) == 2 and again.errors == got.errors
    full = learn.boost(rows, "y", "p", C.TreeParams(**{**p.__dict__, "patience": 1000}), 3)
    assert np.allclose(full.errors[:len(got.errors)], got.errors) and learn.best_round(full.errors, 20) == got.rounds
    held = rows.where("held")
    mse = np.mean([(a - r.y) ** 2 for a, r in zip(_boosted(held, got.stages), held.orderBy("station_id", "year", "month").collect())])
    assert abs(mse - min(got.errors)) < 1e-9


def test_a_better_round_among_the_first_ones_brings_the_whole_segment(spark, monkeypatch):
    rows = _boost_rows(spark)
    p = C.TreeParams(max_iter=60, segment=20, max_depth=4, learning_rate=0.6, patience=20)
    best, asked, gbt = learn.best_round, [], learn._gbt

    def better(errors, patience):  # as if round 21 were the best one so far
        return 21 if len(errors) > 20 else best(errors, patience)

    monkeypatch.setattr(learn, "best_round", better)
    monkeypatch.setattr(learn, "_gbt", lambda label, pred, p, seed: (asked.append(p.max_iter), gbt(label, pred, p, seed))[1])
    got = learn.boost(rows, "y", "p", p, 3)
    assert asked == [20, asked[1], 20, 1] and asked[1] <= 5 and len(got.errors) == 41 and got.rounds == 21


def test_legacy_trees_share_the_memory_with_no_kept_rows(spark, sf_small, monkeypatch):
    from fluvio.operators import features as feat
    from fluvio.queries import _panel
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    boost, before, seen = learn.boost, kept(), []

    def looks(rows, *args):
        seen.append((kept() - before, rows.columns))
        return boost(rows, *args)

    monkeypatch.setattr(learn, "boost", looks)
    model, scored = learn.fit_legacy(feat.legacy_frame(_panel(spark, sf_small)), C.LegacyParams(tree_rounds=2, tree_depth=2, partitions=2))
    assert seen == [(set(), ["station_id", "year", "month", "features", "held", "flow"])]
    assert "features" not in scored.columns and scored.where("tree IS NULL OR net IS NULL").count() == 0


def test_a_training_run_keeps_no_rows_in_memory(spark, sf_small, tmp_path, monkeypatch):
    from fluvio.plans import score
    from fluvio.plans.training_run import train_evaluate_register
    boost, band, seen = learn.boost, score.scored_band, []

    def kept():  # cached rows; the trees of the other target may keep binned rows meanwhile
        return {i for i, rdd in spark.sparkContext._jsc.getPersistentRDDs().items() if "Project" in str(rdd.name())}

    before = kept()

    def looks(rows, *args):
        seen.append(kept() - before)
        assert "features_scaled" not in rows.columns and len({C.TARGET_A, C.TARGET_B} & {*rows.columns}) == 1
        return boost(rows, *args)

    def looks_too(frame, ens, *args):
        seen.append(kept() - before)
        return band(frame, ens, *args)

    monkeypatch.setattr(learn, "boost", looks)
    monkeypatch.setattr(score, "scored_band", looks_too)
    frame = _train_frame(spark, sf_small).checkpoint()
    cfg = C.TrainConfig(tree=C.TreeParams(max_iter=2, segment=1, max_depth=2, patience=1), partitions=2)
    run = train_evaluate_register(frame, cfg, str(tmp_path / "store"), "one")
    assert seen == [set()] * 3 and kept() == before and run.report.count() > 0
    assert run.band.where("tree_A IS NULL OR net_B IS NULL OR pred IS NULL").count() == 0


def test_a_crash_between_model_and_rows_leaves_no_run(spark, sf_small, tmp_path, monkeypatch):
    from fluvio.plans import evaluate as ev, registry
    frame, root = _train_frame(spark, sf_small), str(tmp_path / "store")
    ens = learn.fit_ensemble(frame, C.TrainConfig(tree=None, partitions=2))
    band = ev.with_band(ev.stand_in_predictions(frame), 1.2)
    rep = ev.station_report(band, extra=[F.lit(1.2).alias("s_opt")])
    assert registry.committed_runs(spark, root).count() == 0
    rows = lambda r: registry.run_rows(rep, f"{root}/models/{r}", r)
    for r in ("one", "two", "three"):
        ens.save(f"{root}/models/{r}")
    registry.commit_run(rows("one"), root, "one", f"{root}/models/one")
    rows("two").write.parquet(f"{root}/runs/two")  # ended before the manifest
    registry.commit_run(rows("three"), root, "three", f"{root}/models/three")
    assert {r.run_id for r in registry.committed_runs(spark, root).select("run_id").distinct().collect()} == {"one", "three"}
    with pytest.raises(ValueError, match="committed already"):
        registry.commit_run(rows("one"), root, "one", f"{root}/models/one")
    status = lambda: registry.model_status(registry.committed_runs(spark, root), root, root).select("run_id", "status").distinct().collect()
    assert [tuple(r) for r in status()] == [("three", "loaded")]
    part = next((tmp_path / "store/models/three/pipeline/stages").glob("3_*/data/part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert {r.run_id: r.holds for r in registry.manifest_holds(spark, root).collect()} == {"one": True, "three": False}
    assert [tuple(r) for r in status()] == [("three", "not_loaded")]


def test_wet_forecast_above_dry_and_bare_features(spark, sf_small):
    frame = _train_frame(spark, sf_small)
    ens = learn.fit_ensemble(frame, C.TrainConfig(tree=None, partitions=4))
    rows = ens.predict_bare(frame.where("split = 'test'").select("station_id", "year", "month", *C.FEATURE_COLUMNS[::-1]))
    g = rows.select("pred", "pred_A", "pred_B", "month_sin").collect()
    assert g and all(min(r.pred_A, r.pred_B) - 1e-9 <= r.pred <= max(r.pred_A, r.pred_B) + 1e-9 for r in g)
    none = ens.predict_bare(spark.createDataFrame([(1,)], "id int")).collect()[0]
    assert none.pred is not None  # every feature absent counts as 0


def test_stream_score_accounts_for_every_request(spark, sf_small):
    out = E.queries()["stream_score"](spark, sf_small)
    assert out.count() == _train_frame(spark, sf_small).where("split = 'test'").count()


def test_expired_stream_limit_raises(spark, sf_small, tmp_path):
    from fluvio.streaming.streams import filtered_observations, run_available_now
    s = filtered_observations(spark, sf_small, geometry_type="Point").select("id", "type")
    with pytest.raises(TimeoutError):
        run_available_now(s, str(tmp_path / "out"), str(tmp_path / "ck"), timeout_s=0.001)
    run_available_now(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = spark.read.parquet(f"{sf_small}/events.parquet").where("event_id % 2 = 0").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_broken_request_line_keeps_its_text(spark, tmp_path):
    from fluvio.operators.validate import split_valid
    from fluvio.sources.requests import read_requests
    (tmp_path / "r.json").write_text('{"request_id": "a", "year": 2001, "month": 3}\nno json\n')
    ok, bad = split_valid(read_requests(spark, str(tmp_path)))
    assert ok.count() == 0
    got = {r.request_id: r for r in bad.collect()}
    assert got[None].violations == ["unreadable request"] and got[None]["_corrupt_record"] == "no json"


def test_station_without_test_rows_has_null_skill_and_risk(spark):
    from fluvio.operators import metrics as M
    df = spark.createDataFrame([(None, 1.0)], "o double, p double")
    r = df.agg(*M.skill_exprs()).withColumn("coverage", F.lit(None).cast("double")).select("r2", M.risk_class("coverage", "pbias").alias("risk")).first()
    assert r.r2 is None and r.risk is None


def test_status_reports_missing_model_files(spark, tmp_path):
    import datetime

    from fluvio.plans import registry
    from fluvio.sources.schemas import MODEL_RUNS
    m = (1.0,) * 8
    lm = (1.0,) * 6
    rows = [("r1", 5, ["a"], m, m, lm, 1.0, 1.0, 1.2, 0.8, 10, 5, str(tmp_path / "missing"), "v",
             datetime.datetime(2024, 1, 1)),
            ("r0", 5, ["a"], m, m, lm, 1.0, 1.0, 1.2, 0.8, 10, 5, str(tmp_path / "older"), "v",
             datetime.datetime(2023, 1, 1))]
    st = registry.model_status(spark.createDataFrame(rows, MODEL_RUNS), str(tmp_path)).collect()
    assert len(st) == 1 and st[0].run_id == "r1"
    assert st[0].status == "not_loaded" and st[0].ready_for_prediction is False and st[0].message


def test_population_scaler_matches_original_convention(spark):
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from fluvio.plans.learn import fit_population_scaler
    rows = [(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (7.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    pm = PipelineModel([VectorAssembler(inputCols=["a", "b"], outputCol="features"), *fit_population_scaler(df, ["a", "b"])])
    z = np.array([r.features_scaled.toArray() for r in pm.transform(df).collect()])
    a = np.array([r[0] for r in rows])
    assert np.allclose(z[:, 0], (a - a.mean()) / a.std())  # population sd
    assert np.allclose(z[:, 1], 0.0)  # constant feature: unit scale, centred


def test_legacy_gate_mode_changes_prediction_not_reported_gate(spark, sf_small):
    from fluvio.operators.validate import split_valid
    from fluvio.plans import score
    from fluvio.queries import _frame, _serving
    from fluvio.sources.requests import requests_from_frame
    model, runs = _serving(spark, sf_small)
    acc, _ = split_valid(requests_from_frame(_frame(spark, sf_small)))
    acc = acc.drop("violations").where("month = 6")  # recovered month 1 (wet) vs true month 6 (dry)
    a = {r.request_id: r for r in score.score_requests(acc, model, runs).collect()}
    b = {r.request_id: r for r in score.score_requests(acc, model, runs, gate_mode="legacy_sin").collect()}
    assert a and set(a) == set(b)
    for k in a:
        assert a[k].model_components.gate == b[k].model_components.gate == 0.7
        assert a[k].uncertainty == b[k].uncertainty

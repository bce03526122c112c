from datetime import date

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from ebbline import streaming
from ebbline.config import Settings
from ebbline.operators.quality import QualityError
from ebbline.operators import train
from ebbline.operators.reports import registry_latest
from ebbline.plans import inputs, jobs
from ebbline.sources import files

DAY = date(2001, 8, 1)


def test_whole_batch(spark, tmp_path):
    raw = inputs.telco_raw(spark, SF_DIR)
    files.write_raw_csv(raw, str(tmp_path / "raw.csv"))
    settings = Settings(
        root=str(tmp_path / "stages"),
        raw_csv=str(tmp_path / "raw.csv"),
        database="job_test",
        run_date=DAY,
        min_rows=100,
        forest_trees=10,
    )
    counts = {r["table_name"]: r["row_count"] for r in jobs.run_all(spark, settings).collect()}
    rows = raw.count()
    assert counts["customers_raw"] == counts["features"] == counts["scores_daily"] == rows
    store = jobs.stages(spark, settings)
    assert counts["customer_snapshots"] == store.read("customer_snapshots").count()

    mart = jobs.mart(spark, settings)
    assert mart.read("drift_metrics").count() == 7
    jobs.run_monitoring(spark, settings)
    assert mart.read("drift_metrics").count() == 14
    registered = registry_latest(mart.read("model_registry")).collect()
    assert len(registered) == 1 and registered[0]["artifact_path"] == jobs.model_folder(settings)
    shown = jobs.dashboard(spark, settings, contract="Two year")
    assert shown.top_risky.count() == 12 and shown.kpis.count() == 4 and shown.segment_mix.count() == 3
    assert {r["Contract"] for r in shown.explorer.collect()} == {"Two year"} and shown.trend.count() == 12

    inputs.telco_foreign(spark, SF_DIR).write.csv(str(tmp_path / "subscribers.csv"), header=True)
    token, profile, columns, mapping = jobs.stage_upload(spark, settings, str(tmp_path / "subscribers.csv"))
    assert mapping["customerID"] == "SUBSCRIBER_ID" and len(mapping) == 20
    figures = profile.first()
    assert (figures["row_count"], figures["mapped_fields"], columns.count()) == (rows, 20, 20)
    summary, preview = jobs.score_upload(spark, settings, token)
    assert summary.first()["rows_scored"] == rows and preview.count() == 15
    assert mart.read("scores_daily").count() == rows
    with pytest.raises(ValueError, match="No source column"):
        jobs.score_upload(spark, settings, token, {"tenure": ""})

    out = str(tmp_path / "responses")
    inputs.telco_requests(spark, SF_DIR).write.parquet(str(tmp_path / "requests"))
    model = jobs.saved_model(settings)
    records = streaming.read_records(spark, str(tmp_path / "requests"))
    streaming.score_stream(records, model, out, str(tmp_path / "state")).awaitTermination()
    batch = streaming.score_records(spark.read.parquet(str(tmp_path / "requests")), model)
    assert spark.read.parquet(out).exceptAll(batch).isEmpty() and not batch.isEmpty()

    # Another model is a version of its own, and the first entry's files stay.
    first_model = jobs.model_folder(settings)
    jobs.retrain_and_register(spark, replace(settings, forest_trees=11))
    paths = {r["artifact_path"] for r in mart.read("model_registry").collect()}
    assert paths == {first_model, jobs.model_folder(settings)} and len(paths) == 2
    for path in paths:
        assert len(train.load_model(path).stages) > 1

    with pytest.raises(QualityError, match="at least 10000 are needed"):
        jobs.ingest(spark, Settings(root=settings.root, raw_csv=settings.raw_csv, min_rows=10_000))


def test_no_snapshots_is_an_error(spark, telco, tmp_path):
    settings = Settings(root=str(tmp_path), database="job_empty", run_date=DAY)
    jobs.stages(spark, settings).put("raw", telco.withColumn("tenure", F.lit(0).cast("bigint")))
    jobs.make_features(spark, settings)
    jobs.score(spark, settings, inputs.rule_score)
    with pytest.raises(RuntimeError, match="a month to expand"):
        jobs.make_snapshots(spark, settings)


def test_a_run_that_died_goes_on_behind_its_last_stage(spark, tmp_path, monkeypatch):
    files.write_raw_csv(inputs.telco_raw(spark, SF_DIR), str(tmp_path / "raw.csv"))
    settings = Settings(
        root=str(tmp_path / "stages"), raw_csv=str(tmp_path / "raw.csv"), database="job_resume", run_date=DAY, min_rows=1,
        forest_trees=4, run_id="nightly",
    )
    jobs.run_all(spark, settings)
    store, mart = jobs.stages(spark, settings), jobs.mart(spark, settings)
    old, versions = store.read("scores"), {s: store.version(s) for s in ("raw", "features", "model", "scores")}

    # The same run again makes nothing, and its ledger entries stay single.
    jobs.run_all(spark, settings)
    assert {s: store.version(s) for s in versions} == versions
    assert mart.read("drift_metrics").count() == 7 and mart.read("model_registry").count() == 1

    # Other features, and a run that dies in training: features are done, scores are still the old ones.
    files.write_raw_csv(inputs.telco_raw(spark, SF_DIR).where("tenure > 1"), str(tmp_path / "raw.csv"))
    fit = train.train_models
    monkeypatch.setattr(train, "train_models", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        jobs.run_all(spark, settings)
    done = store.version("features")
    assert done != versions["features"] and store.version("scores") == versions["scores"]
    assert store.read("scores").count() == old.count() > 0

    monkeypatch.setattr(train, "train_models", fit)
    counts = {r["table_name"]: r["row_count"] for r in jobs.run_all(spark, settings).collect()}
    assert store.version("features") == done and store.version("model") != versions["model"]
    assert counts["scores_daily"] == store.read("raw").count() == store.read("scores").count() < old.count()
    assert mart.read("drift_metrics").count() == 7


def test_monitoring_sees_the_marts_history(spark, telco, tmp_path):
    settings = Settings(root=str(tmp_path), database="job_history", run_date=date(2001, 7, 1), snapshot_months=1)
    jobs.stages(spark, settings).put("raw", telco.where("tenure >= 12"))
    jobs.refresh_mart(spark, settings, inputs.rule_score)
    with pytest.raises(Exception, match="two snapshot dates"):
        jobs.run_monitoring(spark, settings)
    later = replace(settings, run_date=DAY)
    jobs.stages(spark, later).put("raw", telco)
    jobs.refresh_mart(spark, later, inputs.rule_score)
    jobs.run_monitoring(spark, later)
    snapshots = jobs.mart(spark, later).read("customer_snapshots")
    means = {r["snapshot_date"]: r["m"] for r in snapshots.groupBy("snapshot_date").agg(F.avg("tenure_at_snapshot").alias("m")).collect()}
    ledger = jobs.mart(spark, later).read("drift_metrics").where("metric_name = 'tenure_mean_delta'").first()
    assert sorted(means) == [date(2001, 7, 31), date(2001, 8, 31)]
    assert ledger["metric_value"] == pytest.approx(means[date(2001, 8, 31)] - means[date(2001, 7, 31)])


@pytest.fixture(scope="module")
def request_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "requests")
    inputs.telco_requests(spark, SF_DIR).repartition(4, "customerID").write.parquet(path)
    return path


def test_stream_equals_batch(spark, requests, request_files, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    records = streaming.read_records(spark, request_files, files_per_trigger=1)
    streaming.score_stream(records, inputs.rule_score, out, state).awaitTermination()
    batch = streaming.score_records(spark.read.parquet(request_files), inputs.rule_score)
    result = spark.read.parquet(out)
    assert result.count() == batch.count() and result.exceptAll(batch).isEmpty()

    # Nothing new: a restart from the same state adds no row. One new file: only its rows.
    streaming.score_stream(records, inputs.rule_score, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count()
    requests({"customerID": "late"}, {"Contract": "Weekly"}).coalesce(1).write.mode("append").parquet(request_files)
    streaming.score_stream(records, inputs.rule_score, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count() + 1
    assert spark.read.parquet(out).where("customer_id = 'late'").count() == 1


def test_quarantine_splits_all_records(spark, request_files, tmp_path):
    out = str(tmp_path / "routed")
    records = streaming.read_records(spark, request_files)
    streaming.quarantine_stream(records, out, str(tmp_path / "state")).awaitTermination()
    routed = spark.read.parquet(out)
    assert routed.count() == spark.read.parquet(request_files).count()
    assert routed.where("(size(violations) = 0) != (record_status = 'valid')").isEmpty()
    assert not routed.where("record_status = 'quarantine'").isEmpty()


def test_alerts_add_up_over_batches(spark, request_files, tmp_path):
    out = str(tmp_path / "alerts")
    records = streaming.read_records(spark, request_files, files_per_trigger=1)
    streaming.alert_stream(records, inputs.rule_score, out, str(tmp_path / "state"), DAY).awaitTermination()
    alerts = spark.read.parquet(out)
    batches = alerts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(batches) >= 4 and {r["n"] for r in batches} == {2}
    valid = streaming.reject_invalid(spark.read.parquet(request_files)).where("record_status = 'valid'")
    last = alerts.where(F.col("batch_id") == max(r["batch_id"] for r in batches))
    whole = str(tmp_path / "whole")
    together = streaming.read_records(spark, request_files)
    streaming.alert_stream(together, inputs.rule_score, whole, str(tmp_path / "state2"), DAY).awaitTermination()
    at_once = {r["metric_name"]: r for r in spark.read.parquet(whole).collect()}
    for r in last.collect():
        assert r["metric_value"] == pytest.approx(at_once[r["metric_name"]]["metric_value"])
        assert r["status"] == at_once[r["metric_name"]]["status"]
    total = at_once["total_revenue_at_risk"]["metric_value"]
    scored = streaming.score_records(valid.select(*spark.read.parquet(request_files).columns), inputs.rule_score, DAY)
    assert total == pytest.approx(scored.agg(F.sum("revenue_at_risk")).first()[0])


@pytest.mark.parametrize("files_per_trigger", [1, 4])
def test_alerts_go_on_after_a_stop(spark, requests, request_files, tmp_path, files_per_trigger):
    """Totals come out of the state store: more files after a restart add to what was there."""
    arrivals, out, state = str(tmp_path / "in"), str(tmp_path / "alerts"), str(tmp_path / "state")
    spark.read.parquet(request_files).repartition(4).write.parquet(arrivals)

    def run():
        records = streaming.read_records(spark, arrivals, files_per_trigger=files_per_trigger)
        streaming.alert_stream(records, inputs.rule_score, out, state, DAY).awaitTermination()
        alerts = spark.read.parquet(out)
        newest = alerts.groupBy("metric_name").agg(F.max_by("metric_value", "batch_id").alias("value"))
        return {r["metric_name"]: r["value"] for r in newest.collect()}

    def batch():
        scored = streaming.score_records(spark.read.parquet(arrivals), inputs.rule_score, DAY)
        row = scored.agg(F.sum("revenue_at_risk"), F.avg("churn_probability")).first()
        return {"total_revenue_at_risk": pytest.approx(row[0]), "avg_churn_probability": pytest.approx(row[1], abs=1e-6)}

    assert run() == batch()
    requests(*[{"customerID": f"late-{i}", "tenure": i} for i in range(1, 9)]).repartition(3).write.mode("append").parquet(arrivals)
    first = run()
    assert first == batch() and run() == first


def test_a_running_stream_takes_up_a_newer_model(spark, requests, tmp_path):
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests({"customerID": "one"}).coalesce(1).write.parquet(arrivals)
    newest = ["old", inputs.rule_score]
    records = streaming.read_records(spark, arrivals)
    query = streaming.model_stream(
        records, lambda: tuple(newest), out, str(tmp_path / "state"), {"processingTime": "200 milliseconds"}, DAY
    )
    try:
        query.processAllAvailable()
        newest[:] = ["new", inputs.contract_score]
        requests({"customerID": "two"}, {"Contract": "Weekly"}).coalesce(1).write.mode("append").parquet(arrivals)
        deadline = time.time() + 60
        while time.time() < deadline and spark.read.parquet(out).count() < 2:
            query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    rated = {r["customer_id"]: (r["model"], r["churn_probability"]) for r in spark.read.parquet(out).collect()}
    rule = 0.05 + 0.40 + 0.20 - 0.012
    assert rated == {"one": ("old", pytest.approx(rule)), "two": ("new", 0.8)}


def test_running_sinks_share_the_trigger(spark, request_files, tmp_path):
    each = {"processingTime": "200 milliseconds"}
    records = streaming.read_records(spark, request_files)
    queries = [
        streaming.score_stream(records, inputs.rule_score, str(tmp_path / "a"), str(tmp_path / "sa"), each),
        streaming.quarantine_stream(records, str(tmp_path / "b"), str(tmp_path / "sb"), each),
    ]
    try:
        for query in queries:
            query.processAllAvailable()
            assert query.isActive
    finally:
        for query in queries:
            query.stop()
    assert spark.read.parquet(str(tmp_path / "b")).count() == spark.read.parquet(request_files).count()

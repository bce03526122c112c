from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ebbline.config import Thresholds
from ebbline.operators import monitoring, reports

OLD, MID, NEW = date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [
        (OLD, 10.0, 99, "Two year", 0.9, "high", 1.0),
        (MID, 40.0, 10, "Month-to-month", 0.2, "low", 5.0),
        (MID, 60.0, 12, "Two year", 0.4, "medium", 6.0),
        (NEW, 45.0, 11, "Month-to-month", 0.5, "medium", 7.0),
        (NEW, 65.0, 13, None, 0.8, "high", 8.0),
    ]
    return spark.createDataFrame(
        rows,
        "snapshot_date date, monthly_revenue double, tenure_at_snapshot bigint, Contract string, "
        "churn_probability double, risk_segment string, revenue_at_risk double",
    )


def test_drift_compares_the_two_newest_dates(snapshots):
    rows = {r["metric_name"]: r for r in monitoring.data_drift(snapshots).collect()}
    rows |= {r["metric_name"]: r for r in monitoring.prediction_drift(snapshots).collect()}
    assert {r["snapshot_date"] for r in rows.values()} == {NEW}
    assert rows["monthly_revenue_mean_delta"]["metric_value"] == 5.0
    assert rows["monthly_revenue_mean_delta"]["status"] == "ok"
    assert rows["monthly_revenue_mean_delta"]["details"] == "latest=55.0000, previous=50.0000"
    assert rows["tenure_mean_delta"]["metric_value"] == 1.0
    assert rows["tenure_mean_delta"]["status"] == "ok"
    assert rows["contract_month_to_month_share_delta"]["metric_value"] == 0.0
    assert rows["avg_churn_probability_delta"]["metric_value"] == pytest.approx(0.35)
    assert rows["avg_churn_probability_delta"]["status"] == "alert"
    assert rows["high_risk_share_delta"]["metric_value"] == 0.5
    assert rows["high_risk_share_delta"]["status"] == "alert"


def test_falling_values_alert_too(snapshots):
    fallen = snapshots.withColumn("monthly_revenue", -F.col("monthly_revenue") * 2)
    row = monitoring.data_drift(fallen).where("metric_name = 'monthly_revenue_mean_delta'").first()
    assert (row["metric_value"], row["status"]) == (-10.0, "alert")


def test_drift_dates(snapshots):
    assert tuple(monitoring.drift_dates(snapshots).first()) == (NEW, MID)


def test_one_date_is_not_enough(snapshots):
    single = snapshots.where(F.col("snapshot_date") == NEW)
    for metric in (monitoring.data_drift, monitoring.prediction_drift, monitoring.drift_dates):
        for frame in (single, snapshots.limit(0)):
            with pytest.raises(PySparkException, match="two snapshot dates"):
                metric(frame).collect()


def test_threshold_alerts_use_the_newest_date_and_strict_limits(snapshots):
    limits = Thresholds(revenue_at_risk_total=15.0, mean_probability=0.6)
    total, mean = monitoring.threshold_alerts(snapshots, limits).collect()
    assert (total["metric_value"], total["status"]) == (15.0, "ok")
    assert total["details"] == "snapshot_date=2024-03-31, total_revenue_at_risk=15.00"
    assert mean["metric_value"] == pytest.approx(0.65) and mean["status"] == "alert"
    assert mean["details"] == "snapshot_date=2024-03-31, avg_churn_probability=0.6500"


def test_suite_is_the_union(snapshots):
    suite = monitoring.monitoring_suite(snapshots, snapshots)
    parts = (
        monitoring.data_drift(snapshots)
        .unionByName(monitoring.prediction_drift(snapshots))
        .unionByName(monitoring.threshold_alerts(snapshots))
    )
    assert suite.count() == 7 and suite.exceptAll(parts).isEmpty()


def test_latest_only(snapshots):
    assert reports.latest_only(snapshots).count() == 2
    assert reports.latest_only(snapshots, dates=2).count() == 4
    assert reports.latest_only(snapshots, dates=9).count() == 5


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(OLD, f"old{i}", "One year", "Mailed check", 10.0, 0.9, 3.0, 1000.0 + i, "high") for i in range(20)]
    rows += [
        (NEW, "b", "One year", "Mailed check", 10.0, 0.5, 3.0, 15.0, "medium"),
        (NEW, "a", "One year", "Mailed check", 10.0, 0.5, 3.0, 15.0, "medium"),
        (NEW, "c", "Two year", "Mailed check", 10.0, 0.6, 3.0, 15.0, "medium"),
        (NEW, "d", "Two year", "Mailed check", 10.0, 0.1, 3.0, 20.0, "low"),
    ]
    return spark.createDataFrame(
        rows,
        "snapshot_date date, customerID string, Contract string, PaymentMethod string, MonthlyCharges double, "
        "churn_probability double, expected_months_remaining double, revenue_at_risk double, risk_segment string",
    )


def test_reports_ignore_older_dates(scores):
    row = reports.kpis(scores).first()
    assert (row["snapshot_date"], row["total_revenue_at_risk"], row["customers_scored"]) == (NEW, 65.0, 4)
    assert row["high_risk_customers"] == 0
    assert [r["value"] for r in reports.kpi_cards(scores).collect()] == ["$65", "42.5%", "0", "4"]
    mix = [(r["risk_segment"], r["customers"]) for r in reports.segment_mix(scores).orderBy("position").collect()]
    assert mix == [("high", 0), ("medium", 3), ("low", 1)]


def test_top_lists(scores):
    assert [r["customerID"] for r in reports.top_risky(scores).collect()] == ["d", "a", "b", "c"]
    assert [r["customerID"] for r in reports.top_risky(scores, k=2).collect()] == ["d", "a"]
    assert [r["customerID"] for r in reports.explorer(scores).collect()] == ["d", "c", "a", "b"]
    medium = reports.explorer(scores, risk_segment="medium", contract="One year", k=1)
    assert [r["customerID"] for r in medium.collect()] == ["a"]
    assert reports.explorer(scores, risk_segment="high").isEmpty()


def test_trend_is_ordered(scores):
    assert [r["snapshot_date"] for r in reports.trend(scores).collect()] == [OLD, NEW]


def test_upload_reports(scores):
    row = reports.upload_summary(scores).first()
    assert (row["rows_scored"], row["high_risk_customers"]) == (24, 20)
    empty = reports.upload_summary(scores.limit(0)).first()
    assert (empty["rows_scored"], empty["total_revenue_at_risk"]) == (0, 0.0)
    assert reports.upload_preview(scores).count() == 15


@pytest.fixture(scope="module")
def ledger(spark):
    first, second = datetime(2024, 4, 1), datetime(2024, 4, 2)
    rows = [
        (OLD, "m0", "data_drift", 9.0, 1.0, "alert", first),
        (NEW, "m1", "data_drift", 1234.5, 1.0, "alert", first),
        (NEW, "m1", "data_drift", 0.5, 1.0, "ok", second),
        (NEW, "m2", "threshold_alert", 2.0, None, "alert", first),
        (NEW, "m3", "prediction_drift", 2.0, 3.0, "ok", first),
    ]
    return spark.createDataFrame(
        rows,
        "snapshot_date date, metric_name string, metric_scope string, metric_value double, "
        "threshold_value double, status string, created_at timestamp",
    )


def test_ledger_reports(spark, ledger):
    row = reports.monitoring_summary(ledger).first().asDict()
    assert row == {
        "snapshot_date": NEW,
        "active_alerts": 2,
        "data_drift_metrics": 2,
        "prediction_drift_metrics": 1,
        "threshold_checks": 1,
    }
    older = ledger.where(f"metric_scope = 'data_drift' or snapshot_date < '{NEW}'").unionByName(
        ledger.where("metric_name = 'm2'").withColumn("snapshot_date", F.lit(MID))
    )
    assert reports.monitoring_summary(older).first()["threshold_checks"] == 0
    assert reports.monitoring_summary(older, per_scope=True).first()["threshold_checks"] == 1
    assert [r["metric_name"] for r in reports.alert_queue(older, per_scope=True).collect()] == ["m1", "m2"]
    assert reports.monitoring_summary(ledger.limit(0), per_scope=True).isEmpty()
    latest = reports.monitoring_summary(ledger, latest_run=True).first()
    assert (latest["active_alerts"], latest["data_drift_metrics"]) == (1, 1)
    shown = reports.metric_ledger(ledger.where("created_at = '2024-04-01'")).collect()
    assert [(r["metric_name"], r["metric_value_display"], r["threshold_value_display"]) for r in shown] == [
        ("m1", "1,234.5000", "1.0000"),
        ("m3", "2.0000", "3.0000"),
        ("m2", "2.0000", "-"),
    ]
    assert [r["metric_name"] for r in reports.alert_queue(ledger).collect()] == ["m1", "m2"]
    assert [r["metric_name"] for r in reports.alert_queue(ledger, latest_run=True).collect()] == ["m2"]


def test_registry_and_operations(spark, ledger):
    rows = [(f"v{i}", 0.5 + i / 100, 0.1, 0.2, 0.12345, datetime(2024, 1, i + 1)) for i in range(7)]
    registry = spark.createDataFrame(
        rows,
        "model_version string, auc_score double, precision_score double, recall_score double, "
        "f1_score double, registered_at timestamp",
    )
    latest = reports.registry_latest(registry).collect()
    assert [r["model_version"] for r in latest] == ["v6", "v5", "v4", "v3", "v2"]
    assert latest[0]["auc_display"] == "0.5600" and latest[0]["registered_at_display"] == "2024-01-07 00:00"
    row = reports.ops_summary(ledger, registry).first()
    assert (row["snapshot_date"], row["metrics"], row["active_alerts"], row["registered_models"]) == (NEW, 4, 2, 5)
    few = reports.ops_summary(ledger, registry.limit(2)).first()
    assert few["registered_models"] == 2

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbline.operators.features import build_features
from ebbline.operators.scoring import batch_scores, expected_months, score_response
from ebbline.operators.snapshots import customer_months, customer_snapshots
from ebbline.plans.inputs import rule_score
from ebbline.schemas import SCORE_COLUMNS, SNAPSHOT_COLUMNS

DAY = date(2001, 8, 1)


@pytest.fixture(scope="module")
def scores(telco):
    return batch_scores(rule_score(build_features(telco)), DAY).persist()


def test_expected_months(spark):
    rows = [
        ("Month-to-month", 0, 3.0),
        ("Month-to-month", 72, 1.0),
        ("One year", 12, 11.0),
        ("Two year", 100, 12.0),
        ("Two year", 7, 17.42),
        ("Weekly", 0, 6.0),
        (None, -5, 6.0),
        ("One year", None, None),
    ]
    df = spark.createDataFrame(rows, "Contract string, tenure bigint, wanted double")
    got = df.select("wanted", expected_months().alias("got"))
    assert got.where(~F.col("wanted").eqNullSafe(F.col("got"))).isEmpty()


def test_score_ranges(scores, telco):
    assert scores.columns == SCORE_COLUMNS
    assert scores.count() == telco.count()
    bad = (
        ~F.col("churn_probability").between(0, 1)
        | (F.col("revenue_at_risk") < 0)
        | ~F.col("expected_months_remaining").between(1, 18)
        | ~F.col("risk_segment").isin("low", "medium", "high")
        | (F.col("snapshot_date") != DAY)
    )
    assert scores.where(bad).isEmpty()
    assert dict(scores.dtypes)["snapshot_date"] == "date"


def test_score_date_defaults_to_today(telco):
    today = batch_scores(rule_score(build_features(telco))).where(F.col("snapshot_date") != F.current_date())
    assert today.isEmpty()


def test_response_rounding(scores):
    row = score_response(scores.withColumn("churn_probability", F.lit(0.12345678))).first()
    assert row["churn_probability"] == 0.123457
    assert list(row.asDict()) == [
        "customer_id",
        "churn_probability",
        "monthly_revenue",
        "expected_months_remaining",
        "revenue_at_risk",
        "risk_segment",
    ]


def test_month_ends(spark):
    df = spark.createDataFrame([("a", 100)], "customerID string, tenure bigint")
    dates = [r[0] for r in customer_months(df, F.lit(date(2026, 3, 31))).orderBy("snapshot_date").select("snapshot_date").collect()]
    assert dates[0] == date(2025, 4, 30) and dates[-1] == date(2026, 3, 31)
    assert date(2026, 2, 28) in dates and len(set(dates)) == 12


def test_months_stop_where_tenure_ends(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("d", 12), ("e", 40), ("f", None)], "customerID string, tenure bigint")
    months = customer_months(df, F.lit(DAY))
    counts = {r["customerID"]: r["count"] for r in months.groupBy("customerID").count().collect()}
    assert counts == {"b": 1, "c": 5, "d": 12, "e": 12}
    assert months.where(F.col("tenure_at_snapshot") != F.col("tenure") - F.col("months_back")).isEmpty()
    assert months.where(F.col("tenure_at_snapshot") <= 0).isEmpty()


def test_snapshot_invariants(scores):
    snapshots = customer_snapshots(scores, DAY).persist()
    assert snapshots.columns == SNAPSHOT_COLUMNS
    bad = (
        ~F.col("churn_probability").between(0.01, 0.99)
        | (F.col("monthly_revenue") < 18.0)
        | ~F.col("expected_months_remaining").between(1, 18)
        | (F.col("active_customer_flag") != 1)
        | (F.col("observed_churn_event") == 1) & (F.col("snapshot_date") != F.lit(date(2001, 8, 31)))
    )
    assert snapshots.where(bad).isEmpty()
    assert snapshots.groupBy("snapshot_date", "customerID").count().where("count > 1").isEmpty()
    events = snapshots.agg(F.sum("observed_churn_event")).first()[0]
    assert events == scores.where((F.col("churn_flag") == 1) & (F.col("tenure") > 0)).count()
    moved = customer_snapshots(scores.repartition(5), DAY)
    assert moved.exceptAll(snapshots).isEmpty()


def test_high_segment_shifts_in_every_month(scores):
    high = scores.limit(1).withColumns(
        {"churn_probability": F.lit(0.8), "risk_segment": F.lit("high"), "tenure": F.lit(30).cast("bigint")}
    )
    rows = customer_snapshots(high, DAY).orderBy(F.desc("snapshot_date")).collect()
    assert [r["churn_probability"] for r in rows] == pytest.approx([0.79 - 0.015 * m for m in range(12)])

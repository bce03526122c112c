"""Reporting queries over scores, snapshots, the metric ledger and the registry.

Reports on "the newest date" keep that date's rows first. On a stored table the
date is a scalar subquery, so only its partition is opened, and the filters on
segment and contract reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import round_even
from ebbline.schemas import SEGMENTS

# Columns of the three lists, in display order.
TOP_COLUMNS = ["customerID", "Contract", "MonthlyCharges", "churn_probability", "revenue_at_risk", "risk_segment"]
EXPLORER_COLUMNS = [
    "customerID",
    "Contract",
    "PaymentMethod",
    "MonthlyCharges",
    "churn_probability",
    "expected_months_remaining",
    "revenue_at_risk",
    "risk_segment",
]
PREVIEW_COLUMNS = [
    "customerID",
    "Contract",
    "PaymentMethod",
    "MonthlyCharges",
    "churn_probability",
    "revenue_at_risk",
    "risk_segment",
]


def latest_only(df: DataFrame, dates: int = 1) -> DataFrame:
    """Rows of the newest date, or of the newest ``dates`` dates.

    The oldest date to keep is a scalar subquery. On a table partitioned by
    date it reads no data columns, and the outer scan opens the partitions from
    that date on only.
    """
    if dates == 1:
        oldest = df.agg(F.max("snapshot_date").alias("oldest"))
    else:
        newest = df.groupBy("snapshot_date").agg(F.count(F.lit(1))).orderBy(F.desc("snapshot_date")).limit(dates)
        oldest = newest.agg(F.min("snapshot_date").alias("oldest"))
    return df.where(F.col("snapshot_date") >= oldest.scalar())


def _portfolio() -> list[Column]:
    return [
        F.sum("revenue_at_risk").alias("total_revenue_at_risk"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.count_if(F.col("risk_segment") == "high").alias("high_risk_customers"),
        F.count(F.lit(1)).alias("customers_scored"),
    ]


def kpis(scores: DataFrame) -> DataFrame:
    """Portfolio figures of the newest date."""
    return latest_only(scores).groupBy("snapshot_date").agg(*_portfolio())


def kpi_cards(scores: DataFrame) -> DataFrame:
    """The portfolio figures as labelled display values, in card order."""
    cards = {
        "Total Revenue At Risk": F.format_string("$%,.0f", "total_revenue_at_risk"),
        "Average Churn Probability": F.format_string("%.1f%%", F.col("avg_churn_probability") * 100),
        "High Risk Customers": F.format_string("%,d", "high_risk_customers"),
        "Customers Scored": F.format_string("%,d", "customers_scored"),
    }
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(cards.items(), start=1)
    ]
    return kpis(scores).select("snapshot_date", F.inline(F.array(*rows)))


def segment_mix(scores: DataFrame) -> DataFrame:
    """Customers per segment on the newest date; absent segments count zero."""
    counts = [F.count_if(F.col("risk_segment") == s).alias(s) for s in SEGMENTS]
    newest = latest_only(scores).groupBy("snapshot_date").agg(*counts)
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("risk_segment"), F.col(s).alias("customers"))
        for i, s in enumerate(SEGMENTS, start=1)
    ]
    return newest.select(F.inline(F.array(*rows)))


def top_risky(scores: DataFrame, k: int = 12) -> DataFrame:
    """The customers of the newest date that put most revenue at risk."""
    order = [F.desc("revenue_at_risk"), F.asc("customerID")]
    return latest_only(scores).select(TOP_COLUMNS).orderBy(*order).limit(k)


def explorer(
    scores: DataFrame, risk_segment: str | None = None, contract: str | None = None, k: int = 50
) -> DataFrame:
    """Customers of the newest date, optionally of one segment and contract."""
    shown = latest_only(scores)
    if risk_segment:
        shown = shown.where(F.col("risk_segment") == risk_segment)
    if contract:
        shown = shown.where(F.col("Contract") == contract)
    order = [F.desc("revenue_at_risk"), F.desc("churn_probability"), F.asc("customerID")]
    return shown.select(EXPLORER_COLUMNS).orderBy(*order).limit(k)


def trend(snapshots: DataFrame) -> DataFrame:
    """Risk by snapshot date, oldest first."""
    per_date = snapshots.groupBy("snapshot_date").agg(
        round_even(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        round_even(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        round_even(
            F.avg(F.when(F.col("risk_segment").eqNullSafe("high"), 1.0).otherwise(0.0)), 4
        ).alias("high_risk_share"),
    )
    return per_date.orderBy("snapshot_date")


def upload_summary(scored: DataFrame) -> DataFrame:
    """Portfolio figures of a scored foreign dataset."""
    rows, total, mean, high = (
        F.count(F.lit(1)).alias("rows_scored"),
        F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("total_revenue_at_risk"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.count_if(F.col("risk_segment") == "high").alias("high_risk_customers"),
    )
    return scored.agg(rows, total, mean, high)


def upload_preview(scored: DataFrame, k: int = 15) -> DataFrame:
    order = [F.desc("revenue_at_risk"), F.asc("customerID")]
    return scored.select(PREVIEW_COLUMNS).orderBy(*order).limit(k)


def _latest_metrics(ledger: DataFrame, latest_run: bool, per_scope: bool) -> DataFrame:
    """Metrics of the newest ledger date, or of each scope's own; ``latest_run`` keeps the newest entry of each.

    Drift is dated by the month's end and a threshold check by its run, so that
    one date for all scopes hides those whose date is older.
    """
    if per_scope:
        newest = ledger.groupBy("metric_scope").agg(F.max("snapshot_date").alias("snapshot_date"))
        latest = ledger.join(newest, ["metric_scope", "snapshot_date"], "left_semi").select(ledger.columns)
    else:
        latest = latest_only(ledger)
    if not latest_run:
        return latest
    columns = [c for c in ledger.columns if c not in ("metric_scope", "metric_name")]
    newest = F.max_by(F.struct(*columns), "created_at").alias("entry")
    return latest.groupBy("metric_scope", "metric_name").agg(newest).select(
        "metric_scope", "metric_name", "entry.*"
    )


def monitoring_summary(ledger: DataFrame, latest_run: bool = False, per_scope: bool = False) -> DataFrame:
    """Alerts and metric counts by scope on the newest ledger date; no row for an empty ledger."""

    def in_scope(scope: str) -> Column:
        return F.count_if(F.col("metric_scope") == scope)

    figures = _latest_metrics(ledger, latest_run, per_scope).agg(
        F.max("snapshot_date").alias("snapshot_date"),
        F.count_if(F.col("status") == "alert").alias("active_alerts"),
        in_scope("data_drift").alias("data_drift_metrics"),
        in_scope("prediction_drift").alias("prediction_drift_metrics"),
        in_scope("threshold_alert").alias("threshold_checks"),
    )
    return figures.where(F.col("snapshot_date").isNotNull())


def _display(column: str) -> Column:
    return F.format_number(F.col(column), 4)


def metric_ledger(ledger: DataFrame, latest_run: bool = False, per_scope: bool = False) -> DataFrame:
    """Metrics of the newest date by scope and name, with display values."""
    shown = _latest_metrics(ledger, latest_run, per_scope).withColumns(
        {
            "metric_value_display": _display("metric_value"),
            "threshold_value_display": F.coalesce(_display("threshold_value"), F.lit("-")),
        }
    )
    return shown.orderBy("metric_scope", "metric_name")


def alert_queue(ledger: DataFrame, latest_run: bool = False, per_scope: bool = False) -> DataFrame:
    alerts = metric_ledger(ledger, latest_run, per_scope).where(F.col("status") == "alert")
    return alerts.orderBy("metric_scope", "metric_name")


def registry_latest(registry: DataFrame, k: int = 5) -> DataFrame:
    """The models registered last, with display values."""
    latest = registry.orderBy(F.desc("registered_at"), F.desc("model_version")).limit(k)
    shown = {
        f"{name}_display": F.format_string("%.4f", F.col(f"{name}_score"))
        for name in ("auc", "precision", "recall", "f1")
    }
    registered = F.date_format("registered_at", "yyyy-MM-dd HH:mm")
    return latest.withColumns({**shown, "registered_at_display": registered})


def ops_summary(ledger: DataFrame, registry: DataFrame, k: int = 5) -> DataFrame:
    """Newest ledger date, its metrics and alerts, and the models on show."""
    newest = latest_only(ledger).groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("metrics"),
        F.count_if(F.col("status") == "alert").alias("active_alerts"),
    )
    models = registry.agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("bigint")).scalar()
    return newest.withColumn("registered_models", models)

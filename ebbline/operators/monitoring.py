"""Drift metrics between the two newest snapshots, and threshold alerts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.config import Thresholds
from ebbline.schemas import METRIC_COLUMNS


@dataclass(frozen=True)
class _Delta:
    name: str
    scope: str
    per_date: Column
    threshold: float


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _data_deltas(limits: Thresholds) -> list[_Delta]:
    monthly = F.col("Contract").eqNullSafe("Month-to-month")
    return [
        _Delta("monthly_revenue_mean_delta", "data_drift", F.avg("monthly_revenue"), limits.revenue_mean_delta),
        _Delta("tenure_mean_delta", "data_drift", F.avg("tenure_at_snapshot"), limits.tenure_mean_delta),
        _Delta(
            "contract_month_to_month_share_delta",
            "data_drift",
            _share(monthly),
            limits.monthly_contract_share_delta,
        ),
    ]


def _prediction_deltas(limits: Thresholds) -> list[_Delta]:
    high = F.col("risk_segment").eqNullSafe("high")
    return [
        _Delta(
            "avg_churn_probability_delta",
            "prediction_drift",
            F.avg("churn_probability"),
            limits.probability_delta,
        ),
        _Delta("high_risk_share_delta", "prediction_drift", _share(high), limits.high_risk_share_delta),
    ]


def _newest_pair(per_date: DataFrame, values: Iterable[str]) -> DataFrame:
    """One row with the newest date, the one before, and both sets of values.

    The input has one row per date; only its two newest rows leave the top-k.
    """
    newest = per_date.orderBy(F.desc("snapshot_date")).limit(2)
    return newest.agg(
        F.count(F.lit(1)).alias("dates"),
        F.max("snapshot_date").alias("latest_date"),
        F.min("snapshot_date").alias("previous_date"),
        *[F.max_by(v, "snapshot_date").alias(f"{v}_latest") for v in values],
        *[F.min_by(v, "snapshot_date").alias(f"{v}_previous") for v in values],
    )


def _require_two_dates(pair: DataFrame, purpose: str) -> DataFrame:
    message = F.lit(f"Fewer than two snapshot dates, so {purpose} cannot be measured.")
    checked = F.when(F.col("dates") < 2, F.raise_error(message).cast("date")).otherwise(F.col("latest_date"))
    return pair.withColumn("latest_date", checked)


def drift_dates(snapshots: DataFrame) -> DataFrame:
    """The newest and the previous distinct snapshot date, as one row."""
    pair = _newest_pair(snapshots.groupBy("snapshot_date").agg(F.count(F.lit(1))), [])
    return _require_two_dates(pair, "drift").select("latest_date", "previous_date")


def _metric(
    date: Column, name: str, scope: str, value: Column, threshold: float, breached: Column, details: Column
) -> Column:
    return F.struct(
        date.alias("snapshot_date"),
        F.lit(name).alias("metric_name"),
        F.lit(scope).alias("metric_scope"),
        value.cast("double").alias("metric_value"),
        F.lit(float(threshold)).alias("threshold_value"),
        F.when(breached, F.lit("alert")).otherwise(F.lit("ok")).alias("status"),
        details.alias("details"),
    )


def _drift(snapshots: DataFrame, deltas: list[_Delta], purpose: str) -> DataFrame:
    """All deltas from one scan: an aggregate per date, then the newest pair."""
    per_date = snapshots.groupBy("snapshot_date").agg(*[d.per_date.alias(d.name) for d in deltas])
    pair = _require_two_dates(_newest_pair(per_date, [d.name for d in deltas]), purpose)
    rows = []
    for delta in deltas:
        latest, previous = F.col(f"{delta.name}_latest"), F.col(f"{delta.name}_previous")
        value = latest - previous
        details = F.format_string("latest=%.4f, previous=%.4f", latest, previous)
        breached = F.abs(value) > delta.threshold
        rows.append(
            _metric(F.col("latest_date"), delta.name, delta.scope, value, delta.threshold, breached, details)
        )
    return pair.select(F.inline(F.array(*rows))).select(METRIC_COLUMNS)


def data_drift(snapshots: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    return _drift(snapshots, _data_deltas(limits), "data drift")


def prediction_drift(snapshots: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    return _drift(snapshots, _prediction_deltas(limits), "prediction drift")


def score_totals(scores: DataFrame) -> DataFrame:
    """Sums per score date; those of several parts of the scores add up."""
    return scores.groupBy("snapshot_date").agg(
        F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("total"),
        F.sum("churn_probability").alias("probability"),
        F.count("churn_probability").alias("rated"),
    )


def threshold_alerts(scores: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Totals of the newest score date against their limits, in one pass."""
    return alerts_of(score_totals(scores), limits)


def alerts_of(totals: DataFrame, limits: Thresholds = Thresholds(), newest: bool = True) -> DataFrame:
    """The newest of the given sums per date, or all of them, against their limits."""
    mean = F.try_divide("probability", "rated").alias("mean")
    shown = totals.orderBy(F.desc("snapshot_date")).limit(1) if newest else totals
    latest = shown.select("snapshot_date", "total", mean)
    date, total, mean = F.col("snapshot_date"), F.col("total"), F.col("mean")
    day = date.cast("string")
    rows = [
        _metric(
            date,
            "total_revenue_at_risk",
            "threshold_alert",
            total,
            limits.revenue_at_risk_total,
            total > limits.revenue_at_risk_total,
            F.format_string("snapshot_date=%s, total_revenue_at_risk=%.2f", day, total),
        ),
        _metric(
            date,
            "avg_churn_probability",
            "threshold_alert",
            mean,
            limits.mean_probability,
            mean > limits.mean_probability,
            F.format_string("snapshot_date=%s, avg_churn_probability=%.4f", day, mean),
        ),
    ]
    return latest.select(F.inline(F.array(*rows))).select(METRIC_COLUMNS)


def monitoring_suite(
    snapshots: DataFrame, scores: DataFrame, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Every metric of a monitoring run; both drift groups share one scan."""
    drift = _drift(snapshots, _data_deltas(limits) + _prediction_deltas(limits), "drift")
    return drift.unionByName(threshold_alerts(scores, limits))

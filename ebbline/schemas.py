"""Column lists, record types and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The customer record, in its published column order.
REQUEST_COLUMNS = [
    "customerID",
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "tenure",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
    "MonthlyCharges",
    "TotalCharges",
]
RAW_COLUMNS = [*REQUEST_COLUMNS, "Churn"]

_NOT_TEXT = {"SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"}
TEXT_COLUMNS = [c for c in REQUEST_COLUMNS if c not in _NOT_TEXT]

# The engineered columns, in output order.
ENGINEERED_COLUMNS = [
    "tenure_bucket",
    "contract_term_months",
    "monthly_charges_log",
    "has_internet",
    "has_security",
    "payment_risk_flag",
    "is_senior",
    "has_partner",
    "has_dependents",
]
FEATURE_COLUMNS = [*REQUEST_COLUMNS, "churn_flag", *ENGINEERED_COLUMNS]

LABEL = "churn_flag"
CATEGORICAL_COLUMNS = [c for c in TEXT_COLUMNS if c != "customerID"] + ["tenure_bucket"]
NUMERIC_COLUMNS = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"] + ENGINEERED_COLUMNS[1:]

# Columns without which a record is useless.
CRITICAL_COLUMNS = ["customerID", "tenure", "MonthlyCharges", "Churn"]

# The daily score table, in output order.
SCORE_COLUMNS = [
    "snapshot_date",
    "customerID",
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "tenure",
    "InternetService",
    "Contract",
    "PaymentMethod",
    "MonthlyCharges",
    "TotalCharges",
    "churn_probability",
    "monthly_revenue",
    "expected_months_remaining",
    "revenue_at_risk",
    "risk_segment",
    "churn_flag",
]

# The monthly snapshot table, in output order.
SNAPSHOT_COLUMNS = [
    "snapshot_date",
    "customerID",
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "Contract",
    "PaymentMethod",
    "InternetService",
    "tenure_at_snapshot",
    "monthly_revenue",
    "churn_probability",
    "expected_months_remaining",
    "revenue_at_risk",
    "risk_segment",
    "observed_churn_event",
    "active_customer_flag",
]

# A metric of the ledger, in output order.
METRIC_COLUMNS = [
    "snapshot_date",
    "metric_name",
    "metric_scope",
    "metric_value",
    "threshold_value",
    "status",
    "details",
]

# Domains.
CONTRACT_TERM_MONTHS = {"Month-to-month": 1, "One year": 12, "Two year": 24}
CONTRACT_BUFFER_MONTHS = {"Month-to-month": 3, "One year": 12, "Two year": 18}
SEGMENTS = ["high", "medium", "low"]

_TYPES = {
    "SeniorCitizen": LongType(),
    "tenure": LongType(),
    "MonthlyCharges": DoubleType(),
}


def _struct(columns: list[str], **overrides) -> StructType:
    types = {**_TYPES, **overrides}
    return StructType([StructField(c, types.get(c, StringType())) for c in columns])


RAW_SCHEMA = _struct(RAW_COLUMNS)
REQUEST_SCHEMA = _struct(REQUEST_COLUMNS, TotalCharges=DoubleType())

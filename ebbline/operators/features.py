"""Feature engineering: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import clip, lookup, tenure_bucket
from ebbline.operators.clean import coerce_upload, impute_total_charges, strip_text, unknown_value
from ebbline.operators.mapping import require_request_columns
from ebbline.schemas import CONTRACT_TERM_MONTHS, FEATURE_COLUMNS


def _flag(condition: str) -> Column:
    """1 or 0; conditions use ``<=>``, for which a missing value is just not equal."""
    return F.expr(f"cast({condition} as bigint)")


def engineer(df: DataFrame, strict: bool) -> DataFrame:
    """Add the nine engineered columns.

    ``strict`` fails the query on an unknown contract; otherwise its term is
    one month and a negative charge counts as zero under the logarithm.
    """
    unknown = unknown_value("Contract") if strict else "1"
    charges = F.col("MonthlyCharges") if strict else clip(F.col("MonthlyCharges"), lower=0.0)
    return df.withColumns(
        {
            "tenure_bucket": tenure_bucket("tenure"),
            "contract_term_months": lookup("Contract", CONTRACT_TERM_MONTHS, unknown).cast("bigint"),
            "monthly_charges_log": F.log1p(charges),
            "has_internet": _flag("not InternetService <=> 'No'"),
            "has_security": _flag("OnlineSecurity <=> 'Yes'"),
            "payment_risk_flag": _flag("PaymentMethod <=> 'Electronic check'"),
            "is_senior": F.col("SeniorCitizen").cast("bigint"),
            "has_partner": _flag("Partner <=> 'Yes'"),
            "has_dependents": _flag("Dependents <=> 'Yes'"),
        }
    )


def prepare_records(df: DataFrame, strict: bool = True) -> DataFrame:
    """Trim, impute and engineer records that carry numeric charges."""
    return engineer(impute_total_charges(strip_text(df)), strict)


def build_features(clean: DataFrame) -> DataFrame:
    """The feature table from the stored raw form (``Churn`` is 0/1)."""
    labelled = prepare_records(clean).withColumn("churn_flag", F.col("Churn").cast("bigint"))
    return labelled.select(FEATURE_COLUMNS)


def prepare_upload(df: DataFrame) -> DataFrame:
    """Features of a mapped foreign dataset; extra columns are kept."""
    require_request_columns(df)
    return prepare_records(coerce_upload(df), strict=False)

"""Cleaning and casting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions import lookup, strip, to_number
from ebbline.schemas import TEXT_COLUMNS


def coerce_number(df: DataFrame, column: str) -> DataFrame:
    """Replace a column by its numeric reading; unparseable values become NULL."""
    return df.withColumn(column, to_number(F.col(column), df.schema[column].dataType))


def unknown_value(column: str) -> str:
    """SQL that fails the query on a value outside a column's domain."""
    return f"cast(raise_error(concat('Unknown value in {column}: ', coalesce({column}, 'NULL'))) as int)"


def encode_churn(df: DataFrame) -> DataFrame:
    """``Churn`` Yes/No to 1/0; any other value fails the query."""
    encoded = lookup("Churn", {"Yes": 1, "No": 0}, unknown_value("Churn"))
    return df.withColumn("Churn", encoded.cast("bigint"))


def strip_text(df: DataFrame) -> DataFrame:
    """Trim the text columns. NULL stays NULL."""
    quoted = [f"`{c}`" for c in df.columns]
    return df.selectExpr(
        *[f"{strip(q)} as {q}" if c in TEXT_COLUMNS else q for c, q in zip(df.columns, quoted)]
    )


def impute_total_charges(df: DataFrame) -> DataFrame:
    estimate = F.col("MonthlyCharges") * F.col("tenure")
    return df.withColumn("TotalCharges", F.coalesce("TotalCharges", estimate))


def clean_raw(df: DataFrame) -> DataFrame:
    """The stored raw form: numeric ``TotalCharges`` and a 0/1 ``Churn``."""
    return encode_churn(coerce_number(df, "TotalCharges"))


def coerce_upload(df: DataFrame) -> DataFrame:
    """Lenient numeric reading of a foreign dataset.

    Missing counts become 0 and missing charges 0.0; ``TotalCharges`` stays
    missing so that it can be imputed.
    """
    number = {
        c: to_number(F.col(c), df.schema[c].dataType)
        for c in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges")
    }
    return df.withColumns(
        {
            "SeniorCitizen": F.coalesce(number["SeniorCitizen"], F.lit(0.0)).cast("bigint"),
            "tenure": F.coalesce(number["tenure"], F.lit(0.0)).cast("bigint"),
            "MonthlyCharges": F.coalesce(number["MonthlyCharges"], F.lit(0.0)),
            "TotalCharges": number["TotalCharges"],
        }
    )

"""Number parsing, clipping and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType

# Plain decimal or scientific notation, or an infinity. Suffixes such as "1d",
# which a SQL cast accepts, are not numbers here.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def to_number(column: Column, dtype: DataType) -> Column:
    """Coerce to double; anything unparseable, and NaN, becomes NULL."""
    if isinstance(dtype, StringType):
        return F.when(column.rlike(NUMBER_PATTERN), column.try_cast("double"))
    if isinstance(dtype, (DoubleType, FloatType)):
        return nan_to_null(column.cast("double"))
    return column.cast("double")


def round_even(column: Column, places: int) -> Column:
    """Scale, round half to even, scale back (not the half-up SQL ``round``)."""
    scale = 10.0**places
    return F.rint(column * scale) / scale


def clip(column: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a column; NULL stays NULL (``greatest``/``least`` would drop it)."""
    bounded = column
    if lower is not None:
        bounded = F.when(bounded < lower, lower).otherwise(bounded)
    if upper is not None:
        bounded = F.when(bounded > upper, upper).otherwise(bounded)
    return bounded

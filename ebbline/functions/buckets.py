"""Binning and value maps as CASE chains.

Bins are closed on the right, so ``ml.feature.Bucketizer`` (closed on the left)
would put every edge value one bin too high.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label given to a value outside all bins, and to a missing one.
OUTSIDE = "nan"

# Fixed values: (lower bound exclusive, upper bound inclusive, label).
TENURE_BINS = [(-1, 12, "0_12"), (12, 24, "13_24"), (24, 48, "25_48"), (48, 72, "49_72")]
RISK_BINS = [(-0.01, 0.3, "low"), (0.3, 0.7, "medium"), (0.7, 1.0, "high")]


def _cut(column: str, bins: Sequence[tuple[float, float, str]]) -> Column:
    whens = [f"when {column} > {lower}D and {column} <= {upper}D then '{label}'" for lower, upper, label in bins]
    return F.expr(f"case {' '.join(whens)} else '{OUTSIDE}' end")


def tenure_bucket(column: str = "tenure") -> Column:
    return _cut(column, TENURE_BINS)


def risk_segment(column: str = "churn_probability") -> Column:
    return _cut(column, RISK_BINS)


def lookup(column: str, values: Mapping[str, int], otherwise: str) -> Column:
    """Value map; ``otherwise`` is the SQL result for unknown and missing keys."""
    whens = [f"when '{key}' then {value}" for key, value in values.items()]
    return F.expr(f"case {column} {' '.join(whens)} else {otherwise} end")

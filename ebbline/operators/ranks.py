"""Exact order statistics with bounded driver and task memory.

``percentile`` keeps every distinct value of a column in one task, and an exact
``approxQuantile`` every sample on the driver. Here each pass counts rows in a
fixed number of bins and descends into the bin that holds the wanted rank, so
a pass returns at most columns x ranks x bins rows, whatever the data size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ebbline.functions import nan_to_null

BINS = 1024


@dataclass(frozen=True)
class _Interval:
    """Values of a column in [low, high], with ``below`` values under ``low``."""

    column: str
    low: float
    high: float
    below: int


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[dict[str, int]], dict[str, list[int]]]
) -> dict[str, list[float]]:
    """The values at the given 1-based ranks of each numeric column.

    ``ranks`` turns the non-missing counts into the wanted ranks; NaN counts as
    missing, and an infinite value is refused. Each pass scans the columns
    again: persist ``df`` if it is expensive to compute.
    """
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    bounds = df.select(
        *[F.count(c).alias(f"{c}_n") for c in columns],
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
    ).first()
    wanted = ranks({c: bounds[f"{c}_n"] for c in columns})
    infinite = [c for c in wanted if not math.isfinite(bounds[f"{c}_max"] - bounds[f"{c}_min"])]
    if infinite:
        raise ValueError(f"Infinite values in: {infinite}")
    found = {
        (c, k): _Interval(c, bounds[f"{c}_min"], bounds[f"{c}_max"], 0) for c in wanted for k in wanted[c]
    }
    while open_intervals := sorted({i for i in found.values() if i.low < i.high}, key=lambda i: (i.column, i.low)):
        bins = _histogram(df, open_intervals)
        for (column, rank), interval in found.items():
            if interval in bins:
                found[column, rank] = _descend(interval, rank, bins[interval])
    return {c: [found[c, k].low for k in wanted[c]] for c in wanted}


def _histogram(df: DataFrame, intervals: list[_Interval]) -> dict[_Interval, list[Row]]:
    """Count, minimum and maximum of every non-empty bin of every interval."""
    cells = []
    for i, interval in enumerate(intervals):
        value = F.col(interval.column)
        share = (value - F.lit(interval.low)) / F.lit(interval.high - interval.low)
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        inside = value.between(interval.low, interval.high)
        cells.append(
            F.when(inside, F.struct(F.lit(i).alias("interval"), place.alias("bin"), value.alias("value")))
        )
    counted = (
        df.select(F.inline(F.array_compact(F.array(*cells))))
        .groupBy("interval", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    bins = defaultdict(list)
    for row in counted.collect():
        bins[intervals[row["interval"]]].append(row)
    return bins


def _descend(interval: _Interval, rank: int, bins: list[Row]) -> _Interval:
    below = interval.below
    for row in sorted(bins, key=lambda r: r["bin"]):
        if below + row["n"] >= rank:
            return _Interval(interval.column, row["low"], row["high"], below)
        below += row["n"]
    raise ValueError(f"Rank {rank} exceeds the values of {interval.column}")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians; the middle two values of an even count are averaged."""

    def middle(counts: dict[str, int]) -> dict[str, list[int]]:
        return {c: sorted({(n + 1) // 2, n // 2 + 1}) for c, n in counts.items() if n}

    values = order_statistics(df, columns, middle)
    return {c: sum(values[c]) / len(values[c]) if c in values else None for c in columns}

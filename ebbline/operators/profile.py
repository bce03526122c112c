"""Profiles of foreign datasets."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, NumericType, StructField

from ebbline.functions import round_even
from ebbline.operators.mapping import suggest_mapping
from ebbline.schemas import REQUEST_COLUMNS


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_digest(df: DataFrame) -> Column:
    """A digest of 128 bits of all cells of a row: equal for equal rows, and null is like nothing else.

    Every cell is written with its length, so that neighbouring cells can't be
    taken for each other. A negative zero counts as zero.
    """

    def cell(field: StructField) -> Column:
        value = F.col(_quoted(field.name))
        if isinstance(field.dataType, (DoubleType, FloatType)):
            value = value + F.lit(0.0)
        text = F.hex(value) if isinstance(field.dataType, BinaryType) else value.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.md5(F.concat(*[cell(f) for f in df.schema.fields])))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Size, missing cells, duplicate rows and mapping coverage, as one row.

    Rows are exchanged as a digest with two numbers, not as they are; equal ones
    are combined before, together with the missing cells that they have.
    """
    missing_in_row = reduce(add, [F.col(_quoted(c)).isNull().cast("bigint") for c in df.columns])
    narrow = df.select(row_digest(df).alias("digest"), missing_in_row.alias("missing"))
    distinct = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.sum("missing").alias("missing"))
    numeric = sum(isinstance(f.dataType, NumericType) for f in df.schema.fields)

    def constant(value: int):
        return F.lit(value).cast("bigint")

    return distinct.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_total"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(
        "row_count",
        constant(len(df.columns)).alias("column_count"),
        "missing_total",
        constant(numeric).alias("numeric_columns"),
        "duplicate_rows",
        constant(len(suggest_mapping(df.columns))).alias("mapped_fields"),
        constant(len(REQUEST_COLUMNS)).alias("required_fields"),
    )


def _cells(df: DataFrame, shown: list[str]) -> DataFrame:
    """One row per cell: the position of its column and its text."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.col(_quoted(c)).cast("string").alias("value"))
            for i, c in enumerate(shown, start=1)
        ]
    )
    return df.select(F.inline(cells))


def column_sketches(df: DataFrame, precision: int = 12) -> DataFrame:
    """Rows, missing cells and a sketch of the distinct values per column.

    A sketch has at most ``2 ** precision`` counters whatever the column holds,
    is made in each task before anything is exchanged, and can be merged with
    those of other datasets. Its estimate is off by more than
    ``3 * 1.04 / 2 ** (precision / 2)`` in about one of 400 cases.
    """
    filled = _cells(df, df.columns).groupBy("position").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.hll_sketch_agg("value", precision).alias("sketch"),
    )
    name = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("position"))
    return filled.select("position", name.alias("column_name"), "total", "missing", "sketch")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several datasets as those of all their rows together, by column name."""
    return sketches.groupBy("column_name").agg(
        F.min("position").alias("position"),
        F.sum("total").alias("total"),
        F.sum("missing").alias("missing"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def approximate_profiles(sketches: DataFrame) -> DataFrame:
    """Missing share and estimated distinct values per column, from sketches."""
    return sketches.select(
        "position",
        "column_name",
        "total",
        round_even(F.col("missing") / F.col("total") * 100, 1).alias("missing_pct"),
        F.hll_sketch_estimate("sketch").alias("unique_values"),
    )


def column_profiles(df: DataFrame, max_columns: int | None = None, samples: int = 3) -> DataFrame:
    """Type, missing share, distinct values and sample values per column.

    The profile covers all columns, or the first ``max_columns`` for a report that
    shows no more. Cells are counted per (column, value), combined before the shuffle;
    both the figures and the samples read that one result. The samples are the
    smallest values: each task keeps its first few before they are exchanged.
    Counts are exact; :func:`column_sketches` estimates them without exchanging values.
    """
    shown = df.columns[:max_columns]
    counted = _cells(df, shown).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
    figures = counted.groupBy("position").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique_values"),
    )
    # Missing values sort last and are dropped late, and the count is carried
    # along, so that this branch asks for the same exchange as the figures.
    by_value = Window.partitionBy("position").orderBy(F.asc_nulls_last("value"))
    smallest = (
        counted.withColumn("place", F.row_number().over(by_value))
        .where(F.col("place") <= samples)
        .groupBy("position")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("found"))
    )
    found = F.array_compact(F.transform("found", lambda cell: cell["value"]))
    types = dict(df.dtypes)
    name = F.element_at(F.array(*[F.lit(c) for c in shown]), F.col("position"))
    dtype = F.element_at(F.array(*[F.lit(types[c]) for c in shown]), F.col("position"))
    return figures.join(smallest, "position").select(
        "position",
        name.alias("column_name"),
        dtype.alias("dtype"),
        round_even(F.col("missing") / F.col("total") * 100, 1).alias("missing_pct"),
        "unique_values",
        found.alias("sample_values"),
    )

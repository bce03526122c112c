"""File datasets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from ebbline.functions import nan_to_null, to_number
from ebbline.functions.numeric import NUMBER_PATTERN
from ebbline.operators.reports import latest_only
from ebbline.schemas import RAW_SCHEMA

# Cell texts that a CSV reader of data frames takes as missing.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
#: Whole numbers that a double can't hold exactly.
LONG_INTEGER_PATTERN = r"^\s*[+-]?\d{16,}\s*$"
BOOLEAN_PATTERN = r"^(True|TRUE|true|False|FALSE|false)$"


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of a CSV file goes over a line break: some line then holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv_text(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with a header, every column as text, missing texts as NULL.

    The header is read once for the names; no pass is spent on types, and a
    file of the folder whose header differs fails the read. ``multi_line``
    allows line breaks in quoted cells, at the price of unsplittable files; left
    open, a pass over the lines finds out whether there are any.
    """
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in names])
    broken = "_broken_line"
    text = (
        spark.read.options(**options, enforceSchema=False, columnNameOfCorruptRecord=broken)
        .schema(schema.add(broken, StringType()))
        .csv(path)
    )
    # A line of fewer cells ends in missing ones; a line of more would lose the rest, which fails the read.
    cells = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    surplus = F.from_csv(broken, F.lit(cells), {"escape": '"'})[f"c{len(names)}"].isNotNull()
    told = F.raise_error(F.concat(F.lit("More cells than columns in the line that begins with "), F.col(f"`{names[0]}`")))
    text = text.where(F.when(F.col(broken).isNotNull() & surplus, told.cast("boolean")).otherwise(True))
    return text.select(
        *[F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in names]
    )


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Raw customer records: known columns typed by name, others kept as text."""
    text = read_csv_text(spark, path, multi_line)
    typed = {}
    for field in RAW_SCHEMA.fields:
        if field.name in text.columns and not isinstance(field.dataType, StringType):
            typed[field.name] = to_number(F.col(field.name), StringType()).cast(field.dataType)
    return text.withColumns(typed) if typed else text


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write with padding kept; the CSV writer trims cells unless told not to."""
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def infer_types(text: DataFrame) -> DataFrame:
    """Type all-text columns from their values: whole, decimal, boolean or text.

    One aggregate over all columns decides; a column without values is text, and
    so is one of whole numbers too long for a bigint, such as identifiers.
    """
    kinds = ("bigint", "double", "boolean")
    counts = []
    for i, name in enumerate(text.columns):
        cell = F.col(f"`{name}`")
        counts.append(F.count(cell).alias(f"n_{i}"))
        fits = (
            cell.rlike(INTEGER_PATTERN) & cell.try_cast("bigint").isNotNull(),
            cell.rlike(NUMBER_PATTERN) & ~cell.rlike(LONG_INTEGER_PATTERN),
            cell.rlike(BOOLEAN_PATTERN),
        )
        counts += [F.count_if(fit).alias(f"{t}_{i}") for t, fit in zip(kinds, fits, strict=True)]
    row = text.agg(*counts).first()
    columns = []
    for i, name in enumerate(text.columns):
        cell, rows = F.col(f"`{name}`"), row[f"n_{i}"]
        target = next((t for t in kinds if rows and row[f"{t}_{i}"] == rows), None)
        columns.append((cell.try_cast(target) if target else cell).alias(name))
    return text.select(*columns)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A stored stage dataset; a missing path fails at once."""
    return spark.read.parquet(path)


def read_latest(spark: SparkSession, path: str, dates: int = 1) -> DataFrame:
    """The newest dates of a stage dataset partitioned by ``snapshot_date``."""
    return latest_only(read_stage(spark, path), dates)


def write_stage(df: DataFrame, path: str, by_date: bool = False) -> None:
    """Replace a stage dataset.

    With ``by_date`` the folder is partitioned by date, so that readers of the
    newest dates open nothing else. There is no shuffle by date: a task that
    expands a split over twelve months writes twelve files of about the size of
    that split.
    """
    writer = df.write.mode("overwrite")
    if by_date:
        writer = writer.partitionBy("snapshot_date")
    writer.parquet(path)


def read_foreign(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A dataset of unknown schema, by its file extension in any case; ``multi_line`` as for :func:`read_csv_text`."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".csv":
        return infer_types(read_csv_text(spark, path, multi_line))
    if extension == ".parquet":
        df = spark.read.parquet(path)
        doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
        return df.select(
            *[nan_to_null(F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns]
        )
    raise ValueError("Only .csv and .parquet files can be read.")

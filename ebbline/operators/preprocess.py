"""Model preprocessing as one persistable ``PipelineModel``.

Numeric columns: median imputation, then standardisation by the population
deviation. Categorical columns: imputation by the most frequent value, then
one-hot encoding in which an unseen value is all zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.operators.labels import LabelIndexer, label_counts, numbered_labels
from ebbline.operators.ranks import medians
from ebbline.schemas import CATEGORICAL_COLUMNS, LABEL, NUMERIC_COLUMNS
from ebbline.session import scratch_dir


@dataclass(frozen=True)
class NumericStats:
    median: float
    mean: float
    std: float


def model_input(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*CATEGORICAL_COLUMNS, *NUMERIC_COLUMNS, *extra)


def numeric_stats(df: DataFrame) -> dict[str, NumericStats]:
    """Exact median, and mean and population deviation after imputing it."""
    middle = medians(df, NUMERIC_COLUMNS)
    empty = [c for c, m in middle.items() if m is None]
    if empty:
        raise ValueError(f"No values to learn from in: {empty}")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in NUMERIC_COLUMNS}
    row = df.agg(
        *[F.avg(x).alias(f"{c}_mean") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"{c}_std") for c, x in filled.items()],
    ).first()
    return {c: NumericStats(middle[c], row[f"{c}_mean"], row[f"{c}_std"]) for c in NUMERIC_COLUMNS}


def level_counts(df: DataFrame) -> DataFrame:
    """Rows per value of every categorical column, from one scan."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in CATEGORICAL_COLUMNS]
    )
    counted = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    return counted.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(levels: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest one on ties."""
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return levels.groupBy("column_name").agg(best.alias("mode_value"))


def _modes_by_column(levels: DataFrame) -> dict[str, str]:
    """Mode of each categorical column; a column without any value ends the training."""
    found = {r["column_name"]: r["mode_value"] for r in modes(levels).collect()}
    unfit = [c for c in CATEGORICAL_COLUMNS if c not in found]
    if unfit:
        raise ValueError(f"Not usable as categories (no value): {unfit}")
    return found


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _impute_and_scale(stats: dict[str, NumericStats], mode: dict[str, str]) -> SQLTransformer:
    """Constants of a column without spread scale by one, as usual."""
    items = [
        f"(coalesce(cast({c} as double), {s.median!r}D) - {s.mean!r}D) / {s.std or 1.0!r}D AS num_{c}"
        for c, s in stats.items()
    ]
    items += [f"coalesce({c}, {_sql_text(m)}) AS cat_{c}" for c, m in mode.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__")


def _stored(levels: DataFrame) -> DataFrame:
    """The counts as files, in as few parts as they need: kept ones stay in all partitions of the shuffle, few as they are."""
    path = scratch_dir(levels.sparkSession, "levels")
    levels.write.parquet(path)
    return levels.sparkSession.read.schema(levels.schema).parquet(path)


def fit_preprocessor(train: DataFrame) -> PipelineModel:
    """Learn the preprocessing from the training rows.

    The driver gets a median, a mode and a number of labels per column; the
    labels stay in a table of their own.
    """
    stats = numeric_stats(train)
    levels = _stored(level_counts(train))
    mode, sizes = _modes_by_column(levels), label_counts(levels)
    path = scratch_dir(train.sparkSession, "label-table")
    numbered_labels(levels, path)
    indexer = LabelIndexer(
        columns=CATEGORICAL_COLUMNS,
        inputCols=[f"cat_{c}" for c in CATEGORICAL_COLUMNS],
        outputCols=[f"idx_{c}" for c in CATEGORICAL_COLUMNS],
        sizes=[sizes[c] for c in CATEGORICAL_COLUMNS],
        path=path,
    )
    encoder = OneHotEncoder(
        inputCols=[f"idx_{c}" for c in CATEGORICAL_COLUMNS],
        outputCols=[f"hot_{c}" for c in CATEGORICAL_COLUMNS],
    )
    categories = VectorAssembler(inputCols=encoder.getOutputCols(), outputCol="categories")
    features = VectorAssembler(
        inputCols=[*[f"num_{c}" for c in NUMERIC_COLUMNS], "categories"], outputCol="features"
    )
    scale = _impute_and_scale(stats, mode)
    # The encoder reads its sizes from the indexer's metadata: no data is needed.
    sample = model_input(train, LABEL).limit(0)
    return Pipeline(stages=[scale, indexer, encoder, categories, features]).fit(sample)

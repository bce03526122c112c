"""Customer records scored as they arrive.

Every step is a projection or a filter, so the streams keep no state; the same
functions run on a batch frame and give the same rows. Only the alerts carry
sums from batch to batch, in the state store.

A stream takes the files that are there and ends, or, with a trigger such as
``{"processingTime": "10 seconds"}``, goes on until it is stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbline.config import Thresholds
from ebbline.operators.features import prepare_records
from ebbline.operators.monitoring import alerts_of, score_totals
from ebbline.operators.quality import with_violations
from ebbline.operators.scoring import score_output, score_response
from ebbline.schemas import REQUEST_SCHEMA

# Adds ``churn_probability`` to prepared records, e.g. a loaded model's predict.
Predictor = Callable[[DataFrame], DataFrame]


def read_records(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of scoring requests, as a stream."""
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def reject_invalid(records: DataFrame) -> DataFrame:
    """Add ``violations`` and ``record_status``, 'valid' or 'quarantine'."""
    checked = with_violations(records, known_contract=True)
    status = F.when(F.size("violations") == 0, "valid").otherwise("quarantine")
    return checked.withColumn("record_status", status)


def _scored(records: DataFrame, predictor: Predictor, snapshot_date: date | None) -> DataFrame:
    valid = reject_invalid(records).where(F.col("record_status") == "valid").select(records.columns)
    return score_output(predictor(prepare_records(valid)), snapshot_date)


def score_records(records: DataFrame, predictor: Predictor, snapshot_date: date | None = None) -> DataFrame:
    """Responses for the valid records."""
    return score_response(_scored(records, predictor, snapshot_date))


#: What is there now, and no more.
AT_HAND = {"availableNow": True}


def score_stream(
    records: DataFrame, predictor: Predictor, path: str, checkpoint: str, trigger: Mapping[str, object] = AT_HAND
) -> StreamingQuery:
    """Append responses to a Parquet folder, exactly once."""
    return (
        score_records(records, predictor)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def model_stream(
    records: DataFrame,
    newest: Callable[[], tuple[str, Predictor]],
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = AT_HAND,
    snapshot_date: date | None = None,
) -> StreamingQuery:
    """Responses of the model that is the newest when their batch begins, with its name, below ``batch_id=<n>``.

    ``newest`` is asked once per batch, so a model saved while the stream runs
    rates the batches after it. A batch that runs again after a failure replaces
    its own folder, so each record counts once.
    """

    def rate(batch: DataFrame, batch_id: int) -> None:
        name, predictor = newest()
        rated = score_records(batch, predictor, snapshot_date).withColumn("model", F.lit(name))
        rated.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        records.writeStream.foreachBatch(rate)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def quarantine_stream(
    records: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = AT_HAND
) -> StreamingQuery:
    """Append records to a folder split by status, exactly once.

    Valid and rejected records are two partitions of one sink, so each record
    is read and checked once and both sides commit together.
    """
    return (
        reject_invalid(records)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("record_status")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def alert_stream(
    records: DataFrame,
    predictor: Predictor,
    path: str,
    checkpoint: str,
    snapshot_date: date | None = None,
    limits: Thresholds = Thresholds(),
    trigger: Mapping[str, object] = AT_HAND,
) -> StreamingQuery:
    """Threshold checks over all records so far, stored below ``batch_id=<n>`` after each batch.

    The sums per date are a streaming aggregate: each batch updates those of its
    dates in the state store, and only updated dates are checked. A total does
    not depend on how the files fall into batches, nor on stops in between,
    because sums and progress are kept in the same checkpoint. A batch that runs
    again after a failure replaces its own folder.
    """
    totals = score_totals(_scored(records, predictor, snapshot_date))

    def check(updated: DataFrame, batch_id: int) -> None:
        alerts_of(updated, limits, newest=False).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )

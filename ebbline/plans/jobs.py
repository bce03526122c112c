"""Batch jobs. Each stage is written as a new version and read back; a job that
failed goes on behind the last stage that the log holds when it is run again."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.config import Settings
from ebbline.operators import quality, reports, train
from ebbline.operators.clean import clean_raw
from ebbline.operators.features import build_features, prepare_upload
from ebbline.operators.mapping import map_schema, suggest_mapping
from ebbline.operators.monitoring import monitoring_suite
from ebbline.operators.profile import column_profiles, dataset_profile
from ebbline.operators.reports import latest_only, upload_preview, upload_summary
from ebbline.operators.scoring import batch_scores, predict, score_output
from ebbline.operators.snapshots import customer_snapshots
from ebbline.sources.files import read_foreign, read_raw_csv, write_stage
from ebbline.sources.mart import Mart
from ebbline.sources.stages import StageStore, files_fingerprint, fingerprint
from ebbline.sources.uploads import UploadStore

# Adds ``churn_probability`` to features.
Predictor = Callable[[DataFrame], DataFrame]

LOADED_TABLES = ("customers_raw", "features", "scores_daily", "customer_snapshots")


def mart(spark: SparkSession, settings: Settings) -> Mart:
    target = Mart(spark, settings.database, settings.mart_path)
    target.create()
    return target


def stages(spark: SparkSession, settings: Settings) -> StageStore:
    return StageStore(spark, settings.root)


def ingest(spark: SparkSession, settings: Settings) -> bool:
    """Validate the raw CSV and store it in typed form; whether that was needed."""

    def write(path: str) -> None:
        raw = read_raw_csv(spark, settings.raw_csv, settings.multi_line)
        quality.enforce(raw, settings.min_rows)
        write_stage(clean_raw(raw), path)

    made_from = fingerprint(
        files=files_fingerprint(spark, settings.raw_csv), rows=settings.min_rows, multi_line=settings.multi_line
    )
    return stages(spark, settings).run("raw", made_from, write)


def make_features(spark: SparkSession, settings: Settings) -> bool:
    store = stages(spark, settings)
    return store.put("features", build_features(store.read("raw")), fingerprint(raw=store.version("raw")))


def retrain(spark: SparkSession, settings: Settings) -> bool:
    """Train on the stored features; the best model and its report are a version of their own.

    Earlier versions stay, so that every registry entry keeps the files that it names.
    """
    store = stages(spark, settings)
    parameters = {
        "trees": settings.forest_trees,
        "depth": settings.forest_depth,
        "seed": settings.seed,
        "test_share": settings.test_share,
    }

    def write(path: str) -> None:
        trained = train.train_models(store.read("features"), **parameters)
        train.save_model(trained, f"{path}/model", f"{path}/metrics")

    return store.run("model", fingerprint(features=store.version("features"), **parameters), write)


def register(spark: SparkSession, settings: Settings) -> None:
    """Append the saved model to the registry."""
    folder = stages(spark, settings).folder("model")
    row = train.registry_row(spark, f"{folder}/metrics", f"{folder}/model", settings.model_name)
    mart(spark, settings).append_model(row, settings.run_id)


def retrain_and_register(spark: SparkSession, settings: Settings) -> None:
    retrain(spark, settings)
    register(spark, settings)


def model_folder(settings: Settings) -> str:
    """Where the newest saved model is."""
    return f"{stages(SparkSession.active(), settings).folder('model')}/model"


def saved_model(settings: Settings) -> Predictor:
    """The predictor of the newest saved model, which is loaded once."""
    model = train.load_model(model_folder(settings))
    return lambda df: predict(df, model)


def newest_model(settings: Settings) -> Callable[[], tuple[str, Predictor]]:
    """Version and predictor of the model that is the newest at each call; a version is loaded once."""
    held: dict[str, Predictor] = {}

    def newest() -> tuple[str, Predictor]:
        folder = model_folder(settings)
        if folder not in held:
            model = train.load_model(folder)
            held.clear()
            held[folder] = lambda df: predict(df, model)
        return folder, held[folder]

    return newest


def score(spark: SparkSession, settings: Settings, predictor: Predictor | None = None) -> bool:
    """Score the stored features with the saved model, or a given predictor, whose scores are always made anew."""
    store = stages(spark, settings)

    def write(path: str) -> None:
        probabilities = (predictor or saved_model(settings))(store.read("features"))
        write_stage(batch_scores(probabilities, settings.as_of), path, by_date=True)

    made_from = fingerprint(features=store.version("features"), model=store.version("model"), date=settings.as_of)
    return store.run("scores", None if predictor else made_from, write)


def make_snapshots(spark: SparkSession, settings: Settings) -> bool:
    """Expand the newest scores; the stored snapshots stay if there are none."""
    store = stages(spark, settings)
    parameters = {"periods": settings.snapshot_months, "seed": settings.seed}

    def write(path: str) -> None:
        scored = latest_only(store.read("scores"))
        if scored.where(F.col("tenure") > 0).isEmpty():
            raise RuntimeError("No customer has a month to expand into.")
        write_stage(customer_snapshots(scored, settings.as_of, **parameters), path, by_date=True)

    made_from = fingerprint(scores=store.version("scores"), date=settings.as_of, **parameters)
    return store.run("customer_snapshots", made_from, write)


def load_mart(spark: SparkSession, settings: Settings) -> Mart:
    """The stages into the mart. Dates that the mart has and the stages don't, stay: they are its history."""
    store, target = stages(spark, settings), mart(spark, settings)
    target.load_raw(store.read("raw"))
    target.load_features(store.read("features"))
    target.load_scores(store.read("scores"))
    target.load_snapshots(store.read("customer_snapshots"))
    return target


def refresh_mart(spark: SparkSession, settings: Settings, predictor: Predictor | None = None) -> DataFrame:
    """Rebuild features, scores and snapshots, reload the mart; rows per table."""
    make_features(spark, settings)
    return _rescore(spark, settings, predictor)


def _rescore(spark: SparkSession, settings: Settings, predictor: Predictor | None = None) -> DataFrame:
    """Scores, snapshots and mart from the stored features; rows per table."""
    score(spark, settings, predictor)
    make_snapshots(spark, settings)
    target = load_mart(spark, settings)
    counts = [
        target.read(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t in LOADED_TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def run_monitoring(spark: SparkSession, settings: Settings) -> None:
    """Add one monitoring run to the ledger, over the mart's history; only the dates it needs are read."""
    target = mart(spark, settings)
    metrics = monitoring_suite(
        latest_only(target.read("customer_snapshots"), 2),
        latest_only(target.read("scores_daily")),
        settings.thresholds,
    )
    target.append_metrics(metrics, settings.run_id)


class Dashboard(NamedTuple):
    """The reports of the newest scores, each a DataFrame over the stored stages."""

    kpis: DataFrame
    segment_mix: DataFrame
    top_risky: DataFrame
    explorer: DataFrame
    trend: DataFrame


def dashboard(
    spark: SparkSession, settings: Settings, risk_segment: str | None = None, contract: str | None = None
) -> Dashboard:
    """The reports over the stored scores and snapshots; segment and contract narrow the customer list."""
    store = stages(spark, settings)
    scores = store.read("scores")
    return Dashboard(
        reports.kpi_cards(scores),
        reports.segment_mix(scores),
        reports.top_risky(scores),
        reports.explorer(scores, risk_segment, contract),
        reports.trend(store.read("customer_snapshots")),
    )


class StagedUpload(NamedTuple):
    """What is known of a foreign dataset before it is scored."""

    token: str
    profile: DataFrame
    columns: DataFrame
    mapping: dict[str, str]


def stage_upload(spark: SparkSession, settings: Settings, path: str) -> StagedUpload:
    """Stage a foreign dataset; its token, profiles, and which of its columns would become which scoring field."""
    store = UploadStore(spark, settings.uploads_path)
    found = read_foreign(spark, path, settings.multi_line)
    token = store.stage(found, os.path.basename(path.rstrip("/")))
    staged = store.load(token)
    return StagedUpload(token, dataset_profile(staged), column_profiles(staged), suggest_mapping(staged.columns))


def score_upload(
    spark: SparkSession,
    settings: Settings,
    token: str,
    overrides: Mapping[str, str] | None = None,
    predictor: Predictor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Summary and preview of a staged dataset scored under its mapping.

    The stored scores and the mart are left alone.
    """
    staged = UploadStore(spark, settings.uploads_path).load(token)
    prepared = prepare_upload(map_schema(staged, overrides))
    scored = score_output((predictor or saved_model(settings))(prepared), settings.as_of)
    return upload_summary(scored), upload_preview(scored)


def run_all(spark: SparkSession, settings: Settings) -> DataFrame:
    """The whole batch in order; rows per mart table.

    Run again with the same settings, it starts behind the last stage that was finished.
    """
    ingest(spark, settings)
    make_features(spark, settings)
    retrain_and_register(spark, settings)
    counts = _rescore(spark, settings)
    run_monitoring(spark, settings)
    return counts

"""Registered queries: one per operator, over the given tables.

Each takes a session and a table folder. Final averages and sums are rounded,
because the order of summation differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, time, timedelta
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.config import Settings
from ebbline.functions import risk_segment, round_even
from ebbline.operators import (
    certify,
    clean,
    evaluate,
    mapping,
    monitoring,
    preprocess,
    profile,
    quality,
    reports,
    scoring,
    split,
    train,
)
from ebbline.operators import snapshots as snap
from ebbline.operators.features import prepare_upload
from ebbline.plans import inputs, jobs
from ebbline.schemas import LABEL, REQUEST_COLUMNS, TEXT_COLUMNS
from ebbline.session import scratch_dir
from ebbline.sources import files
from ebbline.sources.mart import LOAD_TIMES, MART_TABLES, Mart
from ebbline.sources.uploads import UploadStore
from ebbline import streaming

#: How far a loss may be above its least, and how steep it may be, for a model to count as fitted.
GAP, SLOPE = 1e-4, 1e-3

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def _register(query: Query) -> Query:
    _REGISTERED[query.__name__] = query
    return query


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), places) for c in columns})


def _log9(df: DataFrame) -> DataFrame:
    return _round(df, 9, "monthly_charges_log")


def _metrics(df: DataFrame) -> DataFrame:
    return _round(df.drop("details"), 6, "metric_value")


def _untimed(df: DataFrame) -> DataFrame:
    return df.drop(*LOAD_TIMES)


def _mart(spark: SparkSession) -> Mart:
    """An empty mart in a new database below the shared folder."""
    location = scratch_dir(spark, "mart")
    mart = Mart(spark, "mart_" + location.rsplit("-", 1)[1], location)
    mart.create()
    return mart


# --- sources and sinks -------------------------------------------------------


@_register
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "raw-csv")
    files.write_raw_csv(inputs.telco_raw(spark, sf_dir), path)
    return files.read_raw_csv(spark, path)


@_register
def src_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "features")
    files.write_stage(inputs.features(spark, sf_dir), path)
    return _log9(files.read_stage(spark, path))


@_register
def upload_stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UploadStore(spark, scratch_dir(spark, "uploads"))
    token = store.stage(inputs.telco_foreign(spark, sf_dir), "subscribers.csv")
    return store.load(token)


@_register
def mart_customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark)
    mart.load_raw(clean.clean_raw(inputs.telco_raw(spark, sf_dir)))
    return _untimed(mart.read("customers_raw"))


@_register
def mart_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark)
    mart.load_features(inputs.features(spark, sf_dir))
    return _log9(_untimed(mart.read("features")))


@_register
def mart_scores_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark)
    mart.load_scores(inputs.scores(spark, sf_dir))
    return _untimed(mart.read("scores_daily"))


@_register
def mart_customer_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark)
    mart.load_snapshots(inputs.snapshots(spark, sf_dir))
    return mart.read("customer_snapshots")


@_register
def mart_drift_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in the ledger: a repeated run appends its rows again."""
    mart = _mart(spark)
    suite = monitoring.monitoring_suite(inputs.snapshots(spark, sf_dir), inputs.scores(spark, sf_dir))
    mart.append_metrics(suite)
    mart.append_metrics(suite)
    return _metrics(mart.read("drift_metrics").drop("metric_id", "created_at", "run_id"))


@_register
def mart_drift_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs under two names: the repeated one replaces its rows."""
    mart = _mart(spark)
    suite = monitoring.monitoring_suite(inputs.snapshots(spark, sf_dir), inputs.scores(spark, sf_dir))
    for run_id in ("monday", "tuesday", "monday"):
        mart.append_metrics(suite, run_id)
    return _metrics(mart.read("drift_metrics").drop("metric_id", "created_at"))


def _history(spark: SparkSession, sf_dir: str) -> Mart:
    """Snapshots of two loads, the later one twice: a month before the run date for long-standing customers, then all."""
    mart, scores = _mart(spark), inputs.scores(spark, sf_dir)
    mart.load_snapshots(snap.customer_snapshots(scores.where(F.col("tenure") >= 12), inputs.EARLIER_DATE))
    for _ in range(2):
        mart.load_snapshots(snap.customer_snapshots(scores, inputs.RUN_DATE, periods=1))
    return mart


@_register
def mart_snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).read("customer_snapshots")


@_register
def history_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between the two newest months that the mart holds, each from a load of its own."""
    stored = reports.latest_only(_history(spark, sf_dir).read("customer_snapshots"), dates=2)
    drift = monitoring.data_drift(stored).unionByName(monitoring.prediction_drift(stored))
    return _metrics(drift)


@_register
def mart_create_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table after the mart was created, loaded in part, and created again."""
    mart = _mart(spark)
    mart.load_features(inputs.features(spark, sf_dir))
    mart.append_metrics(monitoring.threshold_alerts(inputs.scores(spark, sf_dir)), "first")
    mart.create()
    counted = [
        mart.read(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in MART_TABLES
    ]
    return reduce(DataFrame.unionByName, counted)


# --- cleaning ----------------------------------------------------------------


@_register
def clean_total_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.telco_raw(spark, sf_dir)
    return clean.coerce_number(raw, "TotalCharges").select("customerID", "TotalCharges")


@_register
def clean_churn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.encode_churn(inputs.telco_raw(spark, sf_dir)).select("customerID", "Churn")


@_register
def clean_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.strip_text(inputs.telco_raw(spark, sf_dir)).select(TEXT_COLUMNS)


@_register
def clean_impute_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.strip_text(clean.clean_raw(inputs.telco_raw(spark, sf_dir)))
    return clean.impute_total_charges(cleaned).select("customerID", "TotalCharges")


@_register
def upload_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.coerce_upload(mapping.map_schema(inputs.telco_foreign(spark, sf_dir)))


# --- data quality ------------------------------------------------------------


@_register
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(inputs.telco_raw(spark, sf_dir))


@_register
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of a unique key, and of one that repeats."""
    checked = {
        "customers": quality.duplicate_rows(inputs.telco_raw(spark, sf_dir), "customerID"),
        "orders by customer": quality.duplicate_rows(inputs.table(spark, sf_dir, "orders"), "o_custkey"),
    }
    return reduce(
        DataFrame.unionByName,
        [found.select(F.lit(name).alias("dataset"), "duplicate_rows") for name, found in checked.items()],
    )


@_register
def dq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_values(inputs.telco_raw(spark, sf_dir))


@_register
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(quality.summary(inputs.telco_raw(spark, sf_dir)), 6, "churn_rate")


@_register
def dq_record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.with_violations(inputs.telco_requests(spark, sf_dir))
    return checked.select(
        "customerID",
        F.array_join("violations", ", ").alias("violations"),
        (F.size("violations") == 0).alias("valid"),
    )


@_register
def dq_report_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(inputs.telco_dirty(spark, sf_dir))


@_register
def dq_missing_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_values(inputs.telco_dirty(spark, sf_dir))


@_register
def dq_unexpected_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unexpected_targets(inputs.telco_dirty(spark, sf_dir))


@_register
def dq_record_contract_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = clean.coerce_number(inputs.telco_dirty(spark, sf_dir), "TotalCharges")
    checked = quality.with_violations(dirty, known_contract=True)
    return checked.select("customerID", F.array_join("violations", ", ").alias("violations"))


# --- features ----------------------------------------------------------------


@_register
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log9(inputs.features(spark, sf_dir))


@_register
def tenure_bucket_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.features(spark, sf_dir)
        .groupBy("tenure_bucket")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.min("tenure").alias("tenure_min"),
            F.max("tenure").alias("tenure_max"),
        )
    )


def _upload_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_upload(mapping.map_schema(inputs.telco_foreign(spark, sf_dir)))


@_register
def upload_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log9(_upload_features(spark, sf_dir))


@_register
def upload_features_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lenient chain on faulty records."""
    return _log9(prepare_upload(inputs.telco_dirty(spark, sf_dir).drop("Churn")))


# --- training ----------------------------------------------------------------


@_register
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(inputs.features(spark, sf_dir)).select("customerID", LABEL, "split")


@_register
def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log9(preprocess.model_input(inputs.features(spark, sf_dir), LABEL))


@_register
def prep_numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = preprocess.model_input(inputs.features(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)
    stats = preprocess.numeric_stats(columns)
    columns.unpersist()
    rows = [(c, s.median, s.mean, s.std) for c, s in stats.items()]
    table = spark.createDataFrame(
        rows, "column_name string, median_value double, mean_value double, std_value double"
    )
    return _round(table, 6, "median_value", "mean_value", "std_value")


@_register
def prep_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.modes(preprocess.level_counts(inputs.features(spark, sf_dir)))


@_register
def onehot_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set positions of the one-hot vector; a value unseen in training sets none."""
    rows = split.stratified_split(inputs.features(spark, sf_dir))
    model = preprocess.fit_preprocessor(rows.where(F.col("split") == "train"))
    hot = vector_to_array("categories")
    return model.transform(rows).select(
        "customerID", F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("active")
    )


@_register
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(train.class_weights(inputs.features(spark, sf_dir)), 9, "class_weight")


def _stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as a stage of their own, as the jobs have them: training and its proofs pass over them several times."""
    path = scratch_dir(spark, "features")
    files.write_stage(inputs.features(spark, sf_dir), path)
    return files.read_stage(spark, path)


def _rated(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Customers with their side of the split, and whether their probability is one."""
    p = F.col("churn_probability")
    split_rows = preprocess.model_input(split.stratified_split(rows), "customerID", LABEL, "split")
    rated = scoring.predict(train.dealt(split_rows, rows.count()), model)
    return rated.select("customerID", LABEL, "split", (p.isNotNull() & p.between(0, 1)).alias("in_range"))


@_register
def train_lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rated by logistic regression, with the proof that its loss can fall no further than ``GAP``.

    Coefficients differ between optimisers; the slope of the loss tells an
    optimum whoever found it. ``balanced`` is the intercept's condition: rated
    and labelled weight agree.
    """
    rows = _stored_features(spark, sf_dir)
    model = train.train_models(rows, names=("logistic_regression",)).model
    own = split.stratified_split(rows).where(F.col("split") == "train")
    prepared = train.training_rows(preprocess.model_input(own, LABEL), PipelineModel(model.stages[:-1]))
    slope = certify.logistic_gradient(prepared, model.stages[-1])
    return _rated(rows, model).withColumns(
        {
            "train_rows": F.lit(slope.rows).cast("bigint"),
            "optimal": F.lit(slope.gap <= GAP and slope.largest <= SLOPE),
            "balanced": F.lit(slope.intercept <= SLOPE),
        }
    )


@_register
def train_rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rated by the forest, with what its saved node table says: size, depth, leaves, features, row counts."""
    rows = _stored_features(spark, sf_dir)
    model = train.train_models(rows, names=("random_forest",)).model
    path = scratch_dir(spark, "model")
    model.write().save(path)
    shape = certify.forest_shape(certify.forest_nodes(spark, path))
    return _rated(rows, train.load_model(path)).withColumns(
        {
            "trees": F.lit(shape.trees).cast("bigint"),
            "depth_held": F.lit(1 <= shape.depth <= 10),
            "leaves_held": F.lit(shape.smallest_leaf >= 5),
            "features_known": F.lit(0 <= shape.largest_feature < model.stages[-1].numFeatures),
            "rows_add_up": F.lit(shape.uneven_nodes == 0),
        }
    )


@_register
def eval_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = evaluate.auc(inputs.scores(spark, sf_dir))
    return _round(spark.createDataFrame([(area,)], "auc double"), 6, "auc")


@_register
def eval_threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.threshold_metrics(inputs.scores(spark, sf_dir)), 6, "precision", "recall", "f1")


@_register
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates: whether their figures are possible and better than chance, and whether the best one was chosen."""
    chosen = train.model_selection(train.train_models(_stored_features(spark, sf_dir)))
    best = Window.orderBy(F.desc("auc"), "position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    figures = ["precision", "recall", "f1"]
    harmonic = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return chosen.select(
        "position",
        "model_type",
        (F.col("auc") > 0.5).alias("better_than_chance"),
        reduce(and_, [F.col(c).between(0, 1) for c in (*figures, "auc")]).alias("in_range"),
        (F.abs(F.col("f1") - F.coalesce(harmonic, F.lit(0.0))) < 1e-9).alias("f1_fits"),
        (F.col("selected") == (F.col("model_type") == F.first("model_type").over(best))).alias("choice_fits"),
        F.sum(F.col("selected").cast("bigint")).over(best).alias("chosen"),
    )


@_register
def registry_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry entry of a saved model, held against its report and against the model that its path gives."""
    rows = _stored_features(spark, sf_dir)
    trained = train.train_models(rows)
    model_path, metrics_path = scratch_dir(spark, "model"), scratch_dir(spark, "metrics")
    train.save_model(trained, model_path, metrics_path)
    mart = _mart(spark)
    for _ in range(2):
        mart.append_model(train.registry_row(spark, metrics_path, model_path), "once")
    entries = mart.read("model_registry")
    best = trained.metrics.where(F.col("model_type") == trained.selected)
    test = split.stratified_split(rows).where(F.col("split") == "test")
    area = evaluate.auc(train.rated(train.dealt(test, rows.count()), train.load_model(entries.first()["artifact_path"])))
    same = [F.col(f"{c}_score") == F.col(c) for c in ("auc", "precision", "recall", "f1")]
    return entries.join(best, "model_type").select(
        "model_name",
        "run_id",
        F.col("model_version").rlike("^v[0-9]{8}_[0-9]{6}$").alias("version_fits"),
        reduce(and_, same).alias("figures_fit"),
        (F.abs(F.col("auc_score") - F.lit(area)) < 1e-9).alias("model_fits"),
        (F.col("artifact_path") == F.col("preprocessor_path")).alias("one_artifact"),
        F.col("registered_at").isNotNull().alias("dated"),
    )


# --- scoring -----------------------------------------------------------------


@_register
def score_expected_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.scores(spark, sf_dir).select("customerID", "expected_months_remaining")


@_register
def score_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.scores(spark, sf_dir).select("customerID", "churn_probability", "risk_segment")


@_register
def score_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = inputs.rule_score(inputs.features(spark, sf_dir))
    return _log9(scoring.score_output(rated, inputs.RUN_DATE))


@_register
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.scores(spark, sf_dir)


@_register
def score_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_response(inputs.scores(spark, sf_dir))


# --- snapshots ---------------------------------------------------------------


@_register
def snap_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ends before the newest order, with the customers active at each."""
    newest = inputs.table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate")).alias("day"))
    active = inputs.telco_raw(spark, sf_dir).select("tenure")
    expanded = snap.customer_months(active, F.lit(inputs.RUN_DATE))
    per_month = expanded.groupBy("months_back").agg(F.count(F.lit(1)).alias("customers"))
    return per_month.select(
        snap.month_end(newest.scalar(), F.col("months_back")).alias("snapshot_date"), "months_back", "customers"
    )


@_register
def snap_customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = snap.customer_months(inputs.scores(spark, sf_dir), F.lit(inputs.RUN_DATE))
    return expanded.select("customerID", "months_back", "snapshot_date", "tenure_at_snapshot")


@_register
def snap_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = snap.customer_months(inputs.scores(spark, sf_dir), F.lit(inputs.RUN_DATE))
    return expanded.select("customerID", "months_back", snap.revenue_noise().alias("noise"))


@_register
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.snapshots(spark, sf_dir)


# --- monitoring --------------------------------------------------------------


@_register
def drift_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.drift_dates(inputs.snapshots(spark, sf_dir))


@_register
def data_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(monitoring.data_drift(inputs.snapshots(spark, sf_dir)))


@_register
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(monitoring.prediction_drift(inputs.snapshots(spark, sf_dir)))


@_register
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(monitoring.threshold_alerts(inputs.scores(spark, sf_dir)))


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.monitoring_suite(inputs.snapshots(spark, sf_dir), inputs.scores(spark, sf_dir))


@_register
def monitoring_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(_suite(spark, sf_dir))


@_register
def monitoring_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir).select("metric_name", "status", "details")


@_register
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each gate says of a dataset that it must refuse, and of one that it must let through."""
    raw, foreign, snapshots = (f(spark, sf_dir) for f in (inputs.telco_raw, inputs.telco_foreign, inputs.snapshots))
    newest = reports.latest_only(snapshots)
    checks = {
        "raw columns": lambda given: quality.require_raw_columns(given),
        "upload fields": lambda given: mapping.require_request_columns(mapping.map_schema(given)),
        "two dates": lambda given: monitoring.drift_dates(given).collect(),
    }
    cases = {
        "raw columns": (raw.drop("tenure", "Churn"), raw),
        "upload fields": (foreign.drop("Sex"), foreign),
        "two dates": (newest, snapshots),
    }
    said = []
    for gate, given in cases.items():
        for place, df in enumerate(given):
            try:
                checks[gate](df)
                said.append((gate, place == 0, ""))
            except Exception as error:  # noqa: BLE001
                names = [c for c in ("tenure", "Churn", "gender", "two snapshot dates") if c in str(error)]
                said.append((gate, place == 0, ", ".join(names)))
    return spark.createDataFrame(said, "gate string, faulty boolean, said string")


# --- reports -----------------------------------------------------------------


@_register
def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_only(inputs.snapshots(spark, sf_dir))


@_register
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = _round(reports.kpis(inputs.scores(spark, sf_dir)), 2, "total_revenue_at_risk")
    return _round(figures, 6, "avg_churn_probability")


@_register
def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpi_cards(inputs.scores(spark, sf_dir))


@_register
def segment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.segment_mix(inputs.scores(spark, sf_dir))


@_register
def top_risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_risky(inputs.scores(spark, sf_dir))


@_register
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trend(inputs.snapshots(spark, sf_dir))


@_register
def explorer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.explorer(inputs.scores(spark, sf_dir))


@_register
def explorer_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.explorer(inputs.scores(spark, sf_dir), risk_segment="medium", contract="Two year")


def _ledger(spark: SparkSession, sf_dir: str) -> Mart:
    """A mart ledger with the runs of the two newest months."""
    mart = _mart(spark)
    path = scratch_dir(spark, "snapshots")
    files.write_stage(inputs.snapshots(spark, sf_dir), path, by_date=True)
    stored, scored = files.read_stage(spark, path), inputs.scores(spark, sf_dir)
    newest = stored.agg(F.max("snapshot_date").alias("day")).scalar()
    mart.append_metrics(monitoring.monitoring_suite(stored.where(F.col("snapshot_date") < newest), scored))
    mart.append_metrics(monitoring.monitoring_suite(files.read_latest(spark, path, dates=2), scored))
    return mart


@_register
def monitoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.monitoring_summary(_ledger(spark, sf_dir).read("drift_metrics"))


def _shown(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "snapshot_date",
        "metric_scope",
        "metric_name",
        "status",
        "metric_value_display",
        "threshold_value_display",
    )


@_register
def metric_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reports.metric_ledger(_ledger(spark, sf_dir).read("drift_metrics")))


@_register
def monitoring_summary_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.monitoring_summary(_ledger(spark, sf_dir).read("drift_metrics"), per_scope=True)


@_register
def metric_ledger_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reports.metric_ledger(_ledger(spark, sf_dir).read("drift_metrics"), per_scope=True))


@_register
def alert_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all scopes, each on its own newest date."""
    return _shown(reports.alert_queue(_ledger(spark, sf_dir).read("drift_metrics"), per_scope=True))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of successive models, one a day, each evaluated on all customers."""
    scored, start = inputs.scores(spark, sf_dir), datetime.combine(inputs.RUN_DATE, time())
    entries = []
    for place, (name, rule) in enumerate(inputs.SCORECARDS.items()):
        rated = scored.select(LABEL, F.expr(rule).alias("churn_probability"))
        at_half = evaluate.threshold_metrics(rated).first()
        registered = start + timedelta(days=place)
        figures = (evaluate.auc(rated), at_half["precision"], at_half["recall"], at_half["f1"])
        entries.append((f"v{registered:%Y%m%d_%H%M%S}", "scorecards", name, *figures, "none", "none", registered))
    return spark.createDataFrame(
        entries,
        "model_version string, model_name string, model_type string, auc_score double, precision_score double, "
        "recall_score double, f1_score double, artifact_path string, preprocessor_path string, registered_at timestamp",
    )


@_register
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark)
    mart.append_model(_registry(spark, sf_dir))
    latest = reports.registry_latest(mart.read("model_registry"))
    return latest.select("model_type", "auc_display", "precision_display", "recall_display", "f1_display")


@_register
def ops_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _ledger(spark, sf_dir)
    mart.append_model(_registry(spark, sf_dir))
    return reports.ops_summary(mart.read("drift_metrics"), mart.read("model_registry"))


# --- foreign datasets --------------------------------------------------------


def _upload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_output(inputs.rule_score(_upload_features(spark, sf_dir)), inputs.RUN_DATE)


@_register
def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = _round(reports.upload_summary(_upload_scores(spark, sf_dir)), 2, "total_revenue_at_risk")
    return _round(figures, 6, "avg_churn_probability")


@_register
def upload_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.upload_preview(_upload_scores(spark, sf_dir))


@_register
def upload_model_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview with the model selected on the labelled records: each place held against the uploaded records.

    ``months_fit``: the revenue at risk is the probability times the charges
    times the months that contract and tenure give; ``none_above``: no other
    record has more at risk than the last one shown.
    """
    rows = _stored_features(spark, sf_dir)
    trained = train.train_models(rows)
    rated = scoring.predict(train.dealt(_upload_features(spark, sf_dir), rows.count()), trained.model)
    path = scratch_dir(spark, "rated")
    files.write_stage(scoring.score_output(rated, inputs.RUN_DATE), path)
    scored = files.read_stage(spark, path)
    shown = reports.upload_preview(scored).withColumn("place", F.row_number().over(Window.orderBy(F.desc("revenue_at_risk"), "customerID")))
    own = inputs.telco_foreign(spark, sf_dir).toDF(*REQUEST_COLUMNS)
    own = own.select("customerID", F.col("MonthlyCharges").alias("charges"), scoring.expected_months().alias("months"))
    least = shown.agg(F.min("revenue_at_risk").alias("least")).scalar()
    above = scored.agg(F.count_if(F.col("revenue_at_risk") > least).alias("above")).scalar()
    expected = scoring.revenue_at_risk(F.col("churn_probability"), F.col("charges"), F.col("months"))
    return shown.join(own, "customerID", "left").select(
        F.col("place").cast("bigint").alias("place"),
        (F.col("MonthlyCharges") == F.col("charges")).alias("known"),
        F.col("churn_probability").between(0, 1).alias("in_range"),
        (F.col("revenue_at_risk") == expected).alias("months_fit"),
        F.col("risk_segment").eqNullSafe(risk_segment()).alias("segment_fits"),
        (above < F.lit(15)).alias("none_above"),
    )


@_register
def profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_profile(inputs.telco_foreign(spark, sf_dir))


@_register
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = profile.column_profiles(inputs.telco_foreign(spark, sf_dir))
    return profiles.withColumn("sample_values", F.array_join("sample_values", " | "))


@_register
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of two uploads as one, from their stored sketches; whether each estimate keeps its bound."""
    foreign = inputs.telco_foreign(spark, sf_dir)
    store = UploadStore(spark, scratch_dir(spark, "uploads"))
    halves = [foreign.where(F.expr(f"cast(substr(SUBSCRIBER_ID, 10) as bigint) % 3 {sign} 0")) for sign in ("=", "<>")]
    estimated = store.profile_together([store.stage(half, "part.parquet") for half in halves])
    exact = profile.column_profiles(foreign).select("position", F.col("unique_values").alias("exact"))
    within = F.abs(F.col("unique_values") - F.col("exact")) <= F.ceil(F.col("exact") * 3 * 1.04 / 64)
    return estimated.join(exact, "position").select(
        "position", "column_name", "total", "missing_pct", "exact", within.alias("within_bound")
    )


@_register
def src_csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose payment method goes over two lines, through CSV and back."""
    path = scratch_dir(spark, "raw-csv")
    raw = inputs.telco_raw(spark, sf_dir)
    files.write_raw_csv(raw.withColumn("PaymentMethod", F.replace("PaymentMethod", F.lit(" "), F.lit("\n"))), path)
    return files.read_raw_csv(spark, path)


@_register
def profile_dataset_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_profile(inputs.telco_dirty(spark, sf_dir))


@_register
def upload_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_schema(inputs.telco_foreign(spark, sf_dir)).select(REQUEST_COLUMNS)


# --- jobs and streams --------------------------------------------------------


@_register
def job_refresh_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "job")
    settings = Settings(root=root, database="mart_" + root.rsplit("-", 1)[1], run_date=inputs.RUN_DATE)
    jobs.stages(spark, settings).put("raw", clean.clean_raw(inputs.telco_raw(spark, sf_dir)))
    return jobs.refresh_mart(spark, settings, inputs.rule_score)


def _fails(df: DataFrame) -> DataFrame:
    raise RuntimeError("The run ends here.")


@_register
def job_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, of which the second dies behind its features and is run again.

    The result is the mart's scores of both dates, with how often features were
    made in all, and the date of the scores that were readable after the failure.
    """
    root = scratch_dir(spark, "job")
    csv = f"{root}/customers.csv"
    files.write_raw_csv(inputs.telco_raw(spark, sf_dir), csv)
    settings = Settings(
        root=f"{root}/stages", raw_csv=csv, database="mart_" + root.rsplit("-", 1)[1], run_date=inputs.EARLIER_DATE, min_rows=1
    )
    store = jobs.stages(spark, settings)

    def run(run_settings: Settings, predictor: Callable[[DataFrame], DataFrame]) -> None:
        jobs.ingest(spark, run_settings)
        jobs.refresh_mart(spark, run_settings, predictor)

    run(settings, inputs.rule_score)
    later = replace(settings, run_date=inputs.RUN_DATE)
    try:
        run(later, _fails)
    except RuntimeError:
        readable = store.read("scores").agg(F.max("snapshot_date")).first()[0]
    run(later, inputs.rule_score)
    made = store.log().where(F.col("stage") == "features").count()
    scores = jobs.mart(spark, later).read("scores_daily")
    return _untimed(scores).withColumns({"features_made": F.lit(made).cast("bigint"), "readable": F.lit(readable)})


@_register
def job_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trainings through the jobs, a small forest and a smaller one, and what the newest saved model makes of all customers.

    ``versions`` counts the saved models, ``report_fits`` tells whether the
    newest registry entry has the figures of the newest report and names its files,
    ``loaded_alike`` whether a model loaded again rates every customer as before.
    """
    root = scratch_dir(spark, "job")
    settings = Settings(
        root=root, database="mart_" + root.rsplit("-", 1)[1], run_date=inputs.RUN_DATE, forest_trees=6, run_id="first"
    )
    store = jobs.stages(spark, settings)
    store.put("features", inputs.features(spark, sf_dir))
    jobs.retrain_and_register(spark, settings)
    newer = replace(settings, forest_trees=4, run_id="second")
    for _ in range(2):
        jobs.retrain_and_register(spark, newer)
    versions = store.log().where(F.col("stage") == "model").count()
    entry = jobs.mart(spark, newer).read("model_registry").where(F.col("run_id") == "second").first()
    report = spark.read.json(f"{store.folder('model')}/metrics").first()
    chosen = report["selected_model"]["name"]
    fits = (
        entry["model_type"] == chosen
        and entry["artifact_path"] == jobs.model_folder(newer)
        and all(entry[f"{c}_score"] == report[chosen][c] for c in ("auc", "precision", "recall", "f1"))
    )
    rows = store.read("features")
    jobs.score(spark, newer)
    again = jobs.saved_model(newer)(rows).select("customerID", F.col("churn_probability").alias("again"))
    return store.read("scores").join(again, "customerID").select(
        "customerID",
        F.col("churn_probability").between(0, 1).alias("in_range"),
        (F.col("churn_probability") == F.col("again")).alias("loaded_alike"),
        F.lit(versions).cast("bigint").alias("versions"),
        F.lit(fits).alias("report_fits"),
    )


@_register
def job_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer list of the dashboard over stored scores."""
    settings = Settings(root=scratch_dir(spark, "job"), run_date=inputs.RUN_DATE)
    store = jobs.stages(spark, settings)
    store.put("scores", inputs.scores(spark, sf_dir), by_date=True)
    store.put("customer_snapshots", inputs.snapshots(spark, sf_dir), by_date=True)
    return jobs.dashboard(spark, settings, "medium", "Two year").explorer


@_register
def job_mart_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mart's snapshots hold after a refresh."""
    root = scratch_dir(spark, "job")
    settings = Settings(root=root, database="mart_" + root.rsplit("-", 1)[1], run_date=inputs.RUN_DATE)
    jobs.stages(spark, settings).put("raw", clean.clean_raw(inputs.telco_raw(spark, sf_dir)))
    jobs.refresh_mart(spark, settings, inputs.rule_score)
    return jobs.mart(spark, settings).read("customer_snapshots")


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring requests as a stream of files."""
    path = scratch_dir(spark, "requests")
    inputs.telco_requests(spark, sf_dir).write.parquet(path)
    return streaming.read_records(spark, path)


@_register
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = scratch_dir(spark, "responses"), scratch_dir(spark, "responses-state")
    records = _request_stream(spark, sf_dir)
    streaming.score_stream(records, inputs.rule_score, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@_register
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = scratch_dir(spark, "routed"), scratch_dir(spark, "routed-state")
    streaming.quarantine_stream(_request_stream(spark, sf_dir), path, checkpoint).awaitTermination()
    routed = spark.read.parquet(path)
    return routed.select("customerID", "record_status", F.array_join("violations", ", ").alias("violations"))


@_register
def stream_model_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals with another model between them: how many records each model rated, and what it made of them."""
    path, arrivals = scratch_dir(spark, "rated"), scratch_dir(spark, "arrivals")
    requests = inputs.telco_requests(spark, sf_dir)
    models = {"steady": inputs.rule_score, "contract": inputs.contract_score}
    state = scratch_dir(spark, "rated-state")
    for parity, (name, predictor) in enumerate(models.items()):
        arrived = requests.where(F.expr(f"cast(substr(customerID, 10) as bigint) % 2 = {parity}"))
        arrived.write.mode("append").parquet(arrivals)
        records = streaming.read_records(spark, arrivals)
        newest = lambda name=name, predictor=predictor: (name, predictor)
        streaming.model_stream(records, newest, path, state, snapshot_date=inputs.RUN_DATE).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


@_register
def stream_threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = scratch_dir(spark, "alerts"), scratch_dir(spark, "alerts-state")
    records = _request_stream(spark, sf_dir)
    streaming.alert_stream(records, inputs.rule_score, path, checkpoint, inputs.RUN_DATE).awaitTermination()
    return _metrics(spark.read.parquet(path)).drop("batch_id")

"""The mart: six tables with fixed types."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Table columns with their types.
MART_TABLES = {
    "customers_raw": """
        customer_id string, gender string, senior_citizen int, partner string, dependents string,
        tenure int, phone_service string, multiple_lines string, internet_service string,
        online_security string, online_backup string, device_protection string, tech_support string,
        streaming_tv string, streaming_movies string, contract string, paperless_billing string,
        payment_method string, monthly_charges double, total_charges double, churn_flag int,
        created_at timestamp
    """,
    "features": """
        customer_id string, tenure_bucket string, contract_term_months int, monthly_charges_log double,
        has_internet int, has_security int, payment_risk_flag int, is_senior int, has_partner int,
        has_dependents int, updated_at timestamp
    """,
    "scores_daily": """
        customer_id string, gender string, senior_citizen int, partner string, dependents string,
        tenure int, internet_service string, contract string, payment_method string,
        monthly_charges double, total_charges double, churn_probability double, monthly_revenue double,
        expected_months_remaining double, revenue_at_risk double, risk_segment string, churn_flag int,
        loaded_at timestamp, snapshot_date date
    """,
    "customer_snapshots": """
        customer_id string, gender string, senior_citizen int, partner string, dependents string,
        contract string, payment_method string, internet_service string, tenure_at_snapshot int,
        monthly_revenue double, churn_probability double, expected_months_remaining double,
        revenue_at_risk double, risk_segment string, observed_churn_event int, active_customer_flag int,
        snapshot_date date
    """,
    "drift_metrics": """
        metric_id string, snapshot_date date, metric_name string, metric_scope string,
        metric_value double, threshold_value double, status string, details string, created_at timestamp,
        run_id string
    """,
    "model_registry": """
        model_version string, model_name string, model_type string, auc_score double,
        precision_score double, recall_score double, f1_score double, artifact_path string,
        preprocessor_path string, registered_at timestamp, run_id string
    """,
}
#: What a load replaces: the dates that it holds, or the run that it is.
PARTITIONS = {
    "scores_daily": "snapshot_date",
    "customer_snapshots": "snapshot_date",
    "drift_metrics": "run_id",
    "model_registry": "run_id",
}
LOAD_TIMES = ("created_at", "updated_at", "loaded_at")


def snake_case(name: str) -> str:
    """``PhoneService`` to ``phone_service``, ``customerID`` to ``customer_id``."""
    return re.sub("(?<=[a-z])(?=[A-Z])", "_", name).lower()


@contextmanager
def _only_given_partitions(spark: SparkSession) -> Iterator[None]:
    """An overwrite replaces the partitions that its rows fall into, and no other."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class Mart:
    """Tables of one database. Customers and features are replaced whole, scores and snapshots date by date,
    and ledgers run by run: a date or a run that is written again replaces itself.

    With a location every table is external, in a folder of its own below it.
    The files then outlast the session's catalog: another session that creates
    the mart on the same location finds the rows, and partitions by date are
    looked up in the folders.
    """

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark = spark
        self.database = database
        self.location = location

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create(self) -> None:
        """Create database and tables where they do not exist yet."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        for table, columns in MART_TABLES.items():
            layout = f" PARTITIONED BY ({PARTITIONS[table]})" if table in PARTITIONS else ""
            place = f" LOCATION '{self.location.rstrip('/')}/{table}'" if self.location else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet{layout}{place}")
            if layout and self.location:
                # An append of nothing makes the folder where it is new; what it holds is then looked up.
                nothing = self.spark.createDataFrame([], StructType.fromDDL(columns))
                nothing.write.mode("append").partitionBy(PARTITIONS[table]).parquet(f"{self.location.rstrip('/')}/{table}")
                self.spark.sql(f"ALTER TABLE {self.name(table)} RECOVER PARTITIONS")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def _payload(self, table: str, df: DataFrame, run_id: str | None = None) -> DataFrame:
        """Rename, project and cast to the table's columns, in its order."""
        named = df.toDF(*[snake_case(c) for c in df.columns])
        columns = []
        for field in self.read(table).schema.fields:
            if field.name == "run_id":
                value = F.lit(run_id)
            elif field.name in named.columns:
                value = F.col(field.name)
            elif field.name in LOAD_TIMES:
                value = F.current_timestamp()
            elif field.name == "metric_id":
                value = F.uuid()
            else:
                raise ValueError(f"{table} needs the column {field.name}")
            columns.append(value.cast(field.dataType).alias(field.name))
        return named.select(*columns)

    def replace(self, table: str, df: DataFrame) -> None:
        """The table holds these rows and no other."""
        self._payload(table, df).write.insertInto(self.name(table), overwrite=True)

    def replace_dates(self, table: str, df: DataFrame) -> None:
        """The dates of these rows hold them alone; other dates stay as they are."""
        with _only_given_partitions(self.spark):
            self.replace(table, df)

    def append(self, table: str, df: DataFrame, run_id: str | None = None) -> None:
        """Add the rows of a run to a ledger. The same run again replaces its rows; without a name it is a new one."""
        with _only_given_partitions(self.spark):
            payload = self._payload(table, df, run_id or uuid4().hex)
            payload.write.insertInto(self.name(table), overwrite=True)

    def load_raw(self, raw: DataFrame) -> None:
        self.replace("customers_raw", raw.withColumnRenamed("Churn", "churn_flag"))

    def load_features(self, features: DataFrame) -> None:
        self.replace("features", features)

    def load_scores(self, scores: DataFrame, keep_dates: bool = True) -> None:
        (self.replace_dates if keep_dates else self.replace)("scores_daily", scores)

    def load_snapshots(self, snapshots: DataFrame, keep_dates: bool = True) -> None:
        (self.replace_dates if keep_dates else self.replace)("customer_snapshots", snapshots)

    def append_metrics(self, metrics: DataFrame, run_id: str | None = None) -> None:
        self.append("drift_metrics", metrics, run_id)

    def append_model(self, registry_row: DataFrame, run_id: str | None = None) -> None:
        self.append("model_registry", registry_row, run_id)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str, properties: dict[str, str]) -> None:
    """Write a mart payload to a database table; ``truncate`` keeps its definition."""
    snake = df.toDF(*[snake_case(c) for c in df.columns])
    snake.write.option("truncate", True).jdbc(url, table, mode=mode, properties=properties)

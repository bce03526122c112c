"""Customer records derived from the order tables.

The given tables hold no subscriber record, so one is derived per customer: its
order history gives tenure, contract and churn, its key and segment the
remaining attributes. A customer without orders has a tenure of 0 months.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions import clip
from ebbline.operators.clean import clean_raw, coerce_number
from ebbline.operators.features import build_features
from ebbline.operators.scoring import batch_scores
from ebbline.operators.snapshots import customer_snapshots
from ebbline.schemas import RAW_COLUMNS, REQUEST_COLUMNS

RUN_DATE = date(2001, 8, 1)
#: A run a month before.
EARLIER_DATE = date(2001, 7, 1)

# The names of the foreign dataset, in record column order: synonyms in several spellings.
FOREIGN_NAMES = [
    "SUBSCRIBER_ID",
    "Sex",
    "is_senior",
    "Has_Partner",
    "hasDependents",
    "customer-tenure",
    "has_phone_service",
    "multi_line",
    "InternetType",
    "security_service",
    "BACKUP_SERVICE",
    "protectionService",
    "support_service",
    "Streaming TV",
    "streamingMovies",
    "subscription_contract",
    "paperless_flag",
    "Payment_Type",
    "monthlyAmount",
    "lifetime.value",
]


# The columns of the given tables that are used.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
}


# Rules that rate the churn risk from 0 to 1, each from one field, as successive models of a registry.
SCORECARDS = {
    "contract": "case when Contract = 'Month-to-month' then 8e-1 when Contract = 'One year' then 4e-1 else 2e-1 end",
    "tenure": "1e0 - tenure / 73e0",
    "charges": "MonthlyCharges / (MonthlyCharges + 50e0)",
    "payment": "case when PaymentMethod = 'Electronic check' then 7e-1 else 3e-1 end",
    "internet": "case when InternetService = 'Fiber optic' then 7e-1 when InternetService = 'DSL' then 5e-1 else 2e-1 end",
    "rule": "churn_probability",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the declared types spare a pass over the file footers."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _add_on(condition: str) -> str:
    return (
        "case when c_mktsegment = 'MACHINERY' then 'No internet service' "
        f"when {condition} then 'Yes' else 'No' end"
    )


def telco_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records: a per-customer aggregate of orders joined to customers.

    Orders are combined per customer before the shuffle, so a customer with a
    large share of them costs no more than another; the join then has one row
    per key on both sides. The newest order date is a scalar subquery.
    """
    orders = table(spark, sf_dir, "orders")
    history = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("o_orderdate").alias("first_o"),
        F.max("o_orderdate").alias("last_o"),
    )
    as_of = orders.agg(F.max("o_orderdate").alias("as_of")).scalar()
    customer = table(spark, sf_dir, "customer")
    joined = customer.join(history, customer.c_custkey == history.o_custkey, "left").withColumns(
        {
            "k": F.col("c_custkey"),
            "idle_days": F.datediff(as_of, "last_o"),
            "n_orders": F.expr("coalesce(n_orders, 0L)"),
            "tenure": F.expr("coalesce(least(cast(floor(datediff(last_o, first_o) / 30) as bigint), 72L), 0L)"),
            "mc_cents": F.expr(
                "cast(floor((cast(round(c_acctbal * 100) as bigint) + 100000) / 1e2) as bigint) + 1800"
            ),
        }
    )
    return joined.withColumn("tc_cents", F.col("mc_cents") * F.col("tenure")).selectExpr(
        "c_name as customerID",
        "case when k % 11 = 0 then 'Female  ' when k % 2 = 0 then 'Female' else 'Male' end as gender",
        "cast(case when k % 6 = 0 then 1 else 0 end as bigint) as SeniorCitizen",
        "case when k % 13 = 0 then ' Yes' when c_nationkey % 2 = 0 then 'Yes' else 'No' end as Partner",
        "case when k % 3 = 0 then 'Yes' else 'No' end as Dependents",
        "tenure",
        "case when k % 10 = 0 then 'No' else 'Yes' end as PhoneService",
        "case when k % 10 = 0 then 'No phone service' when k % 2 = 0 then 'Yes' else 'No' end as MultipleLines",
        "case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'Fiber optic' "
        "when c_mktsegment in ('FURNITURE', 'HOUSEHOLD') then 'DSL' else 'No' end as InternetService",
        f"{_add_on('k % 4 = 0')} as OnlineSecurity",
        f"{_add_on('k % 5 < 2')} as OnlineBackup",
        f"{_add_on('k % 7 < 3')} as DeviceProtection",
        f"{_add_on('k % 8 < 3')} as TechSupport",
        f"{_add_on('k % 9 < 4')} as StreamingTV",
        f"{_add_on('k % 12 < 5')} as StreamingMovies",
        "case when n_orders < 9 then 'Month-to-month' when n_orders < 12 then 'One year' "
        "else 'Two year' end as Contract",
        "case when k % 5 < 3 then 'Yes' else 'No' end as PaperlessBilling",
        "case k % 4 when 0 then 'Electronic check' when 1 then 'Mailed check' "
        "when 2 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end as PaymentMethod",
        "mc_cents / 1e2 as MonthlyCharges",
        "case when k % 97 = 0 then ' ' else concat(cast(cast(floor(tc_cents / 1e2) as bigint) as string), "
        "'.', lpad(cast(tc_cents % 100 as string), 2, '0')) end as TotalCharges",
        "case when idle_days > 180 then 'Yes' else 'No' end as Churn",
    )


def telco_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with faults: some repeated, missing, out of range or unknown.

    The customer number decides which fault a record has; every repeated record
    is emitted twice from its own row.
    """
    numbered = telco_raw(spark, sf_dir).withColumn("k", F.expr("cast(substr(customerID, 10) as bigint)"))
    faulty = numbered.selectExpr(
        "customerID",
        "case when k % 31 = 0 then null else gender end as gender",
        "case when k % 29 = 0 then 2 else SeniorCitizen end as SeniorCitizen",
        *RAW_COLUMNS[3:5],
        "case when k % 41 = 0 then null when k % 37 = 0 then 100 when k % 43 = 0 then -1 else tenure end as tenure",
        *RAW_COLUMNS[6:15],
        "case when k % 23 = 0 then 'Weekly' when k % 19 = 0 then concat(' ', Contract) else Contract end as Contract",
        *RAW_COLUMNS[16:18],
        "case when k % 53 = 0 then -1D when k % 59 = 0 then null else MonthlyCharges end as MonthlyCharges",
        "case when k % 17 = 0 then '1d' when k % 13 = 0 then concat('\\t', TotalCharges) else TotalCharges end "
        "as TotalCharges",
        "case when k % 47 = 0 then 'Maybe' when k % 61 = 0 then null else Churn end as Churn",
        "sequence(1, case when k % 50 = 0 then 2 else 1 end) as copies",
    )
    return faulty.withColumn("copy", F.explode("copies")).select(RAW_COLUMNS)


def telco_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as scoring requests: no label, numeric charges."""
    return coerce_number(telco_raw(spark, sf_dir), "TotalCharges").select(REQUEST_COLUMNS)


def telco_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records under foreign names."""
    return telco_raw(spark, sf_dir).select(REQUEST_COLUMNS).toDF(*FOREIGN_NAMES)


def rule_score(df: DataFrame) -> DataFrame:
    """Add a churn probability by a fixed rule, in place of a trained model.

    It uses no transcendental function, so every engine computes the same bits.
    """

    raw = F.expr(
        "0.05D + 0.40D * cast(Contract <=> 'Month-to-month' as double)"
        " + 0.20D * cast(PaymentMethod <=> 'Electronic check' as double)"
        " + 0.15D * cast(InternetService <=> 'Fiber optic' as double) - 0.001D * tenure"
    )
    return df.withColumn("churn_probability", clip(raw, 0.01, 0.99))


def contract_score(df: DataFrame) -> DataFrame:
    """Add a churn probability by another rule, as a newer model would."""
    return df.withColumn("churn_probability", F.expr(SCORECARDS["contract"]))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(clean_raw(telco_raw(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_scores(rule_score(features(spark, sf_dir)), RUN_DATE)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_snapshots(scores(spark, sf_dir), RUN_DATE)

"""Physical plans: what is read, what is shuffled, and that Python stays out."""

import re

import pytest

from conftest import SF_DIR
from ebbline.operators import monitoring, quality, reports
from ebbline.plans import inputs, queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|round|Single)", text, re.IGNORECASE))


LAZY = [
    "features",
    "batch_scores",
    "snapshots",
    "monitoring_suite",
    "dq_report",
    "top_risky",
    "trend",
    "explorer_filtered",
    "upload_preview",
    "profile_dataset",
    "profile_columns",
    "latest_scores",
    "prep_modes",
    "kpis",
    "segment_mix",
    "explorer_all",
    "threshold_alerts",
    "dq_report_dirty",
    "dq_record_contract",
    "upload_features",
    "upload_summary",
    "score_response",
    "tenure_bucket_dist",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(queries.queries()[name](spark, SF_DIR))
    assert not re.search("EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def exchanged(df) -> list[str]:
    """Columns that each exchange of a plan carries."""
    text = df._jdf.queryExecution().explainString(spark_mode(df, "formatted"))
    return re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def spark_mode(df, name):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)


def test_profile_exchanges_digests_and_no_rows(spark):
    found = exchanged(queries.queries()["profile_dataset"](spark, SF_DIR))
    assert any("digest" in columns for columns in found)
    names = inputs.FOREIGN_NAMES
    assert not any(name + "#" in columns for columns in found for name in names if name != "customer-tenure")


def test_quality_exchanges_ids_only(spark, tmp_path):
    inputs.telco_raw(spark, SF_DIR).write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    found = exchanged(quality.report(stored))
    keyed = exchanged(quality.repeated_ids(stored))
    assert keyed and all(re.fullmatch(r"(id#\d+, )?(count|sum)#\d+L?(, isEmpty#\d+)?", columns) for columns in keyed), keyed
    # Beside the ids, only partial sums of each task are exchanged.
    others = [columns for columns in found if not columns.startswith("id#")]
    assert len(found) == 3 and len(others) == 2
    assert all(re.fullmatch(r"(count|min|max|sum)#\d+L?", part) for columns in others for part in columns.split(", "))


def test_scoring_adds_no_shuffle(spark, telco, tmp_path):
    from ebbline.operators.features import build_features
    from ebbline.operators.scoring import batch_scores
    from ebbline.operators.snapshots import customer_snapshots

    telco.write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    scores = batch_scores(inputs.rule_score(build_features(stored)), inputs.RUN_DATE)
    assert exchanges(plan(customer_snapshots(scores, inputs.RUN_DATE))) == 0


def test_reports_read_few_columns(spark, telco, tmp_path):
    inputs.snapshots(spark, SF_DIR).write.parquet(str(tmp_path / "snapshots"))
    stored = spark.read.parquet(str(tmp_path / "snapshots"))
    text = plan(monitoring.prediction_drift(stored))
    assert "ReadSchema: struct<snapshot_date:date,churn_probability:double,risk_segment:string>" in text
    assert text.count("Scan parquet") == 1
    assert plan(monitoring.monitoring_suite(stored, stored)).count("Scan parquet") == 2


def test_top_list_is_a_bounded_sort(spark):
    text = plan(reports.top_risky(inputs.scores(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in text and "Sort [" not in text.split("TakeOrderedAndProject")[0].replace("Window", "")


def test_stored_reports_prune_and_push(spark, tmp_path, request):
    inputs.scores(spark, SF_DIR).write.partitionBy("snapshot_date").parquet(str(tmp_path / "scores"))
    stored = spark.read.parquet(str(tmp_path / "scores"))
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    request.addfinalizer(lambda: spark.conf.set("spark.sql.maxMetadataStringLength", length))
    text = plan(reports.explorer(stored, risk_segment="medium", contract="Two year"))
    assert "EqualTo(risk_segment,medium)" in text and "EqualTo(Contract,Two year)" in text
    for report in (reports.kpis, reports.segment_mix, reports.top_risky, reports.explorer):
        assert "snapshot_date" in plan(report(stored)).split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_drift_ranks_no_full_input(spark):
    assert "Window" not in plan(monitoring.data_drift(inputs.snapshots(spark, SF_DIR)))

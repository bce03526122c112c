from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ebbline.operators import monitoring, quality
from ebbline.operators.features import build_features
from ebbline.operators.scoring import batch_scores
from ebbline.operators.snapshots import customer_snapshots
from ebbline.plans.inputs import rule_score
from ebbline.session import scratch_dir, scratch_root
from ebbline.sources import files
from ebbline.sources.stages import StageStore, files_fingerprint, fingerprint
from ebbline.sources.mart import MART_TABLES, Mart, snake_case
from ebbline.sources.uploads import UploadStore


def test_scratch_follows_the_session_setting(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_csv_columns_are_found_by_name(spark, raw, tmp_path):
    df = raw({"TotalCharges": " ", "gender": "  Male "}, {"tenure": 5})
    shuffled = sorted(df.columns, reverse=True)
    files.write_raw_csv(df.select(shuffled), str(tmp_path / "raw"))
    back = files.read_raw_csv(spark, str(tmp_path / "raw"))
    assert back.columns == shuffled
    assert back.select(df.columns).exceptAll(df).isEmpty()
    assert dict(back.dtypes)["tenure"] == "bigint" and dict(back.dtypes)["MonthlyCharges"] == "double"


def test_csv_missing_texts_and_bad_numbers(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('tenure,Contract,extra\nx,NA,"a,""b"""\n7,,nan\n1d,One year,z\n')
    rows = [tuple(r) for r in files.read_raw_csv(spark, str(tmp_path / "raw.csv")).collect()]
    assert rows == [(None, None, 'a,"b"'), (7, None, None), (None, "One year", "z")]
    with pytest.raises(quality.QualityError, match="Not a customer dataset"):
        quality.enforce(files.read_raw_csv(spark, str(tmp_path / "raw.csv")))


def test_csv_headers_must_agree(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv_text(spark, str(folder)).collect()


def test_missing_paths_fail(spark, tmp_path):
    for read in (files.read_raw_csv, files.read_stage):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read(spark, str(tmp_path / "absent"))


def test_foreign_datasets(spark, tmp_path):
    (tmp_path / "up.CSV").write_text("id,n,f,b,t\n007,1,1.5,True,x\n8,,NaN,false, \n")
    df = files.read_foreign(spark, str(tmp_path / "up.CSV"))
    assert dict(df.dtypes) == {"id": "bigint", "n": "bigint", "f": "double", "b": "boolean", "t": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(7, 1, 1.5, True, "x"), (8, None, None, False, " ")]
    nan = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "`a.b` bigint, x double")
    nan.write.parquet(str(tmp_path / "up.parquet"))
    stored = files.read_foreign(spark, str(tmp_path / "up.parquet"))
    assert sorted(tuple(r) for r in stored.collect()) == [(1, None), (2, 0.5)]
    with pytest.raises(ValueError, match="can be read"):
        files.read_foreign(spark, str(tmp_path / "up.xlsx"))


def test_uploads(spark, tmp_path):
    store = UploadStore(spark, str(tmp_path / "uploads"))
    assert store.metadata("0" * 32) == {}
    one = store.stage(spark.range(3).toDF("a"), "one.csv")
    two = store.stage(spark.createDataFrame([("x", 1.0)], "b string, c double"), "two.parquet")
    assert store.load(one).count() == 3 and store.load(two).columns == ["b", "c"]
    assert store.metadata(two) == {"original_filename": "two.parquet"}
    assert store.metadata("0" * 32) == {}
    for token in ("0" * 32, "../uploads"):
        with pytest.raises(FileNotFoundError, match="staged under this token"):
            store.load(token)


def test_latest_partitions_only_are_read(spark, tmp_path):
    days = [date(2024, m, 1) for m in (1, 2, 3)]
    df = spark.createDataFrame([(d, i, "x") for d in days for i in range(4)], "snapshot_date date, n int, s string")
    files.write_stage(df, str(tmp_path / "stage"), by_date=True)
    stored = files.read_stage(spark, str(tmp_path / "stage"))
    assert dict(stored.dtypes)["snapshot_date"] == "date" and stored.count() == 12
    latest = files.read_latest(spark, str(tmp_path / "stage"))
    assert {r["snapshot_date"] for r in latest.collect()} == {days[-1]}
    pair = files.read_latest(spark, str(tmp_path / "stage"), dates=2)
    assert {r["snapshot_date"] for r in pair.collect()} == set(days[1:])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_snake_case():
    names = ["customerID", "SeniorCitizen", "StreamingTV", "TotalCharges", "tenure", "has_internet", "churn_flag"]
    assert [snake_case(n) for n in names] == [
        "customer_id",
        "senior_citizen",
        "streaming_tv",
        "total_charges",
        "tenure",
        "has_internet",
        "churn_flag",
    ]


def test_mart(spark, telco, tmp_path):
    mart = Mart(spark, "mart_test", str(tmp_path / "mart"))
    mart.create()
    mart.create()
    assert {t.name for t in spark.catalog.listTables("mart_test")} == set(MART_TABLES)
    features = build_features(telco)
    scores = batch_scores(rule_score(features), date(2001, 8, 1))
    snapshots = customer_snapshots(scores, date(2001, 8, 1))
    for _ in range(2):
        mart.load_raw(telco)
        mart.load_features(features)
        mart.load_scores(scores)
        mart.load_snapshots(snapshots)
        mart.append_metrics(monitoring.monitoring_suite(snapshots, scores))
    rows = telco.count()
    assert [mart.read(t).count() for t in ("customers_raw", "features", "scores_daily")] == [rows] * 3
    assert mart.read("customer_snapshots").count() == snapshots.count()
    metrics = mart.read("drift_metrics")
    assert metrics.count() == 14
    assert metrics.select("metric_id").distinct().count() == 14
    assert metrics.where(F.col("created_at").isNull()).isEmpty()
    types = dict(mart.read("scores_daily").dtypes)
    assert (types["snapshot_date"], types["tenure"], types["churn_probability"]) == ("date", "int", "double")
    with pytest.raises(ValueError, match="needs the column"):
        mart.load_features(features.drop("tenure_bucket"))


def test_scores_are_kept_by_date(spark, telco, tmp_path):
    mart = Mart(spark, "mart_replace", str(tmp_path / "mart"))
    mart.create()
    features, days = build_features(telco), (date(2001, 8, 1), date(2001, 8, 2))

    def dates():
        counted = mart.read("scores_daily").groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))
        return {r["snapshot_date"]: r["n"] for r in counted.collect()}

    rows = telco.count()
    for day in days:
        mart.load_scores(batch_scores(rule_score(features), day))
    assert dates() == dict.fromkeys(days, rows)
    mart.load_scores(batch_scores(rule_score(features.where("tenure > 5")), days[1]))
    assert dates() == {days[0]: rows, days[1]: telco.where("tenure > 5").count()}
    mart.load_scores(batch_scores(rule_score(features), date(2001, 8, 3)), keep_dates=False)
    assert dates() == {date(2001, 8, 3): rows}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_a_run_replaces_its_own_entries(spark, tmp_path):
    mart = Mart(spark, "mart_runs", str(tmp_path / "mart"))
    mart.create()
    schema = "snapshot_date date, metric_name string, metric_scope string, metric_value double, threshold_value double, status string, details string, run_id string"

    def append(value, *run):
        row = (date(2001, 8, 1), "m", "s", value, 1.0, "ok", "d", "not the name of the run")
        mart.append_metrics(spark.createDataFrame([row], schema), *run)

    for value, run in ((1.0, "a/1 x=y"), (2.0, "b"), (3.0, "a/1 x=y")):
        append(value, run)
    assert {(r["run_id"], r["metric_value"]) for r in mart.read("drift_metrics").collect()} == {("a/1 x=y", 3.0), ("b", 2.0)}
    append(4.0)
    append(4.0)
    assert mart.read("drift_metrics").count() == 4


class TestStages:
    def test_a_version_holds_once_it_is_logged(self, spark, tmp_path):
        store = StageStore(spark, str(tmp_path))
        with pytest.raises(FileNotFoundError, match="never written"):
            store.read("numbers")
        assert store.current("numbers") is None and store.log().isEmpty()
        assert store.put("numbers", spark.range(3), fingerprint(rows=3))
        before = store.read("numbers")

        def dies(path):
            spark.range(9).write.parquet(path)
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError, match="lost"):
            store.run("numbers", fingerprint(rows=9), dies)
        assert store.read("numbers").count() == 3
        assert store.put("numbers", spark.range(9), fingerprint(rows=9))
        assert store.read("numbers").count() == 9 and before.count() == 3
        assert store.vacuum("numbers", keep=2) == 1 and before.count() == 3
        assert store.vacuum("numbers") == 1 and store.read("numbers").count() == 9

    def test_equal_inputs_are_not_made_again(self, spark, tmp_path):
        store, made = StageStore(spark, str(tmp_path)), []

        def write(path):
            made.append(path)
            spark.range(1).write.parquet(path)

        for key in ("a", "a", "b", "a", None, None):
            store.run("s", key and fingerprint(key=key), write)
        assert len(made) == 5
        other = StageStore(spark, str(tmp_path))
        assert other.folder("s") == made[-1] and other.current("s").position == 5

    def test_files_are_told_apart_by_name_size_and_time(self, spark, tmp_path):
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.csv").write_text("a,b\n1,2\n")
        one = files_fingerprint(spark, str(tmp_path / "in"))
        assert one == files_fingerprint(spark, str(tmp_path / "in"))
        (tmp_path / "in" / "b.csv").write_text("a,b\n")
        assert files_fingerprint(spark, str(tmp_path / "in")) != one


def test_mart_outlives_the_catalog(spark, telco, tmp_path):
    """A session that knows nothing of the mart opens it again: its ledger and its dates are there."""
    features = build_features(telco)
    scores = batch_scores(rule_score(features), date(2001, 8, 1))
    snapshots = customer_snapshots(scores, date(2001, 8, 1))
    for run in (1, 2):
        mart = Mart(spark, "mart_again", str(tmp_path / "mart"))
        mart.create()
        if run == 2:
            assert mart.read("customer_snapshots").count() == snapshots.count()
        mart.load_scores(scores)
        mart.load_snapshots(snapshots)
        mart.append_metrics(monitoring.monitoring_suite(snapshots, scores))
        assert mart.read("drift_metrics").count() == 7 * run
        spark.sql("DROP DATABASE mart_again CASCADE")


def test_csv_keeps_every_cell(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with pytest.raises(Exception, match="More cells than columns"):
        files.read_foreign(spark, file("surplus.csv", "a,b\n1,2\n3,4,5\n")).collect()
    short = files.read_foreign(spark, file("short.csv", "a,b\n1,2\n3\n")).orderBy("a").collect()
    assert [tuple(r) for r in short] == [(1, 2), (3, None)]
    ids = file("ids.csv", "id,n\n1234567890123456781,1\n1234567890123456782,2.5\n98765432109876543210,3\n")
    rows = files.read_foreign(spark, ids).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [
        ("1234567890123456781", 1.0),
        ("1234567890123456782", 2.5),
        ("98765432109876543210", 3.0),
    ]
    lines = file("lines.csv", 'a,b\n"one\ntwo",1\nx,2\n')
    for given in (True, None):
        assert {r["a"] for r in files.read_foreign(spark, lines, given).collect()} == {"one\ntwo", "x"}
    inner = file("inner.csv", 'id,sex,n\n1,"Fe\nmale",5\n2,"say ""hi""",6\n3,"a,\n\n,b",7\n')
    assert files.has_quoted_breaks(spark, inner) and not files.has_quoted_breaks(spark, ids)
    rows = {tuple(r) for r in files.read_foreign(spark, inner).collect()}
    assert rows == {(1, "Fe\nmale", 5), (2, 'say "hi"', 6), (3, "a,\n\n,b", 7)}


def test_float_nan_is_missing(spark, tmp_path):
    path = str(tmp_path / "floats.parquet")
    spark.createDataFrame([(1.5,), (float("nan"),)], "x float").write.parquet(path)
    assert files.read_foreign(spark, path).where("x is null").count() == 1

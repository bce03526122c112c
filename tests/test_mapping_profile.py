import pytest
from pyspark.sql import functions as F

from ebbline.operators import profile
from ebbline.operators.mapping import apply_mapping, map_schema, suggest_mapping
from ebbline.operators.profile import column_profiles, dataset_profile
from ebbline.plans.inputs import FOREIGN_NAMES
from ebbline.schemas import REQUEST_COLUMNS
from ebbline.sources.uploads import UploadStore


def frame(spark, *names):
    return spark.createDataFrame([tuple("x" for _ in names)], [*names])


def test_known_synonyms_are_suggested():
    assert suggest_mapping(FOREIGN_NAMES) == dict(zip(REQUEST_COLUMNS, FOREIGN_NAMES))


def test_normal_form_and_order_of_preference():
    assert suggest_mapping(["Client-ID", "CUSTOMER ID"])["customerID"] == "CUSTOMER ID"
    assert suggest_mapping(["client id", "Client.ID"]) == {"customerID": "Client.ID"}
    assert suggest_mapping(["unrelated"]) == {}


def test_rename(spark):
    df = frame(spark, "client_id", "monthly_fee", "contract_type", "note")
    assert map_schema(df).columns == ["customerID", "MonthlyCharges", "Contract", "note"]


def test_overrides_win_and_blanks_unmap(spark):
    df = frame(spark, "client_id", "other_id", "sex")
    mapped = map_schema(df, {"customerID": "other_id", "gender": "", "tenure": "absent"})
    assert mapped.columns == ["client_id", "customerID", "sex"]


def test_columns_can_be_swapped(spark):
    df = spark.createDataFrame([("a", "b")], ["gender", "Partner"])
    assert apply_mapping(df, {"gender": "Partner", "Partner": "gender"}).first().asDict() == {"Partner": "a", "gender": "b"}


def test_collisions_are_refused(spark):
    with pytest.raises(ValueError, match="ambiguous"):
        apply_mapping(frame(spark, "client_id", "customerID"), {"customerID": "client_id"})
    with pytest.raises(ValueError, match="ambiguous"):
        apply_mapping(frame(spark, "client_id", "CUSTOMERID"), {"customerID": "client_id"})


def test_dataset_profile(spark):
    rows = [("a", 1, 1.0, True), ("a", 1, 1.0, True), (None, 1, None, None), (None, 1, None, None), (None, 2, None, None)]
    df = spark.createDataFrame(rows, "client_id string, monthly_fee int, `odd.name` double, flag boolean")
    assert dataset_profile(df).first().asDict() == {
        "row_count": 5,
        "column_count": 4,
        "missing_total": 9,
        "numeric_columns": 2,
        "duplicate_rows": 2,
        "mapped_fields": 2,
        "required_fields": 20,
    }
    assert dataset_profile(df.limit(0)).first()["row_count"] == 0


def test_column_profiles(spark):
    rows = [("b", 3, None), ("a", 3, None), ("c", 1, None), ("d", None, None), ("a", 1, None), (None, None, None)]
    df = spark.createDataFrame(rows, "`a.b` string, n bigint, empty string")
    got = [tuple(r) for r in column_profiles(df).orderBy("position").collect()]
    assert got == [
        (1, "a.b", "string", 16.7, 4, ["a", "b", "c"]),
        (2, "n", "bigint", 33.3, 2, ["1", "3"]),
        (3, "empty", "string", 100.0, 0, []),
    ]


def test_all_columns_are_profiled_unless_fewer_are_asked_for(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(30)])
    assert [r["column_name"] for r in column_profiles(wide).orderBy("position").collect()] == [f"c{i}" for i in range(30)]
    few = column_profiles(wide, max_columns=25).orderBy("position").collect()
    assert [r["column_name"] for r in few] == [f"c{i}" for i in range(25)]


def test_hot_value(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    row = column_profiles(df).first()
    assert (row["unique_values"], row["sample_values"]) == (4001, ["1", "10", "100"])


class TestDigestsAndSketches:
    def test_equal_rows_only_are_duplicates(self, spark):
        rows = [("a", "b", 0.0, b"1"), ("ab", "", 0.0, b"1"), ("a", "b", -0.0, b"1"), (None, "b", 0.0, b"1"), ("-", "b", 0.0, b"1")]
        rows += [("a", "b", float("nan"), None), ("a", "b", float("nan"), None), ("1:a", "b", None, b""), ("1", ":ab", None, b"")]
        df = spark.createDataFrame(rows, "`x.y` string, s string, d double, b binary")
        row = profile.dataset_profile(df).first()
        assert (row["row_count"], row["duplicate_rows"], row["missing_total"]) == (9, 2, 5)
        assert profile.dataset_profile(df.limit(0)).first()["row_count"] == 0

    @pytest.mark.parametrize("distinct", [0, 1, 900, 60_000])
    def test_estimates_keep_their_bound_and_merge(self, spark, distinct):
        one = spark.range(2 * distinct + 5).selectExpr(f"cast(id % {max(distinct, 1)} as string) as v", "cast(null as int) as n")
        one = one if distinct else one.selectExpr("cast(null as string) as v", "n")
        two = one.selectExpr("concat('other-', v) as v", "n")
        own = [profile.column_sketches(df) for df in (one, two, one)]
        single = {r["column_name"]: r for r in profile.approximate_profiles(own[0]).collect()}
        both = {r["column_name"]: r for r in profile.approximate_profiles(profile.merged_sketches(own[0].unionByName(own[1]).unionByName(own[2]))).collect()}
        bound = 3 * 1.04 / 2**6
        assert abs(single["v"]["unique_values"] - distinct) <= bound * distinct + 0.5
        assert abs(both["v"]["unique_values"] - 2 * distinct) <= bound * 2 * distinct + 0.5
        assert both["n"]["unique_values"] == 0 and both["n"]["missing_pct"] == 100.0
        assert both["v"]["total"] == 3 * (2 * distinct + 5)

    def test_sketches_are_stored_with_the_upload(self, spark, tmp_path):
        store = UploadStore(spark, str(tmp_path))
        tokens = [store.stage(spark.range(n).toDF("a"), "x.csv") for n in (30, 50)]
        assert store.profile_together(tokens).first()["unique_values"] == 50
        assert store.sketch(tokens[0]).first()["total"] == 30
        with pytest.raises(FileNotFoundError):
            store.sketch("0" * 32)

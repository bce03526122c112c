import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ebbline.operators.clean import clean_raw, coerce_upload, encode_churn, strip_text
from ebbline.operators.features import build_features, prepare_upload
from ebbline.schemas import FEATURE_COLUMNS


def test_padded_record_without_total(raw):
    padded = {"gender": "  Male", "Dependents": " Yes\t", "Contract": "One year ", "SeniorCitizen": 0, "tenure": 30}
    charged = {"InternetService": "DSL", "OnlineSecurity": "No", "MonthlyCharges": 20.5, "TotalCharges": " "}
    features = build_features(clean_raw(raw({**padded, **charged, "PaymentMethod": "Mailed check", "Churn": "No"})))
    row = features.first()
    assert features.columns == FEATURE_COLUMNS
    assert (row["gender"], row["Dependents"], row["Contract"]) == ("Male", "Yes", "One year")
    assert row["TotalCharges"] == pytest.approx(615.0)
    assert row["monthly_charges_log"] == pytest.approx(math.log(21.5))
    assert row["contract_term_months"] == 12
    flags = ("has_internet", "has_security", "payment_risk_flag", "is_senior", "has_dependents", "churn_flag")
    assert [row[c] for c in flags] == [1, 0, 0, 0, 1, 0]


def test_missing_text_counts_as_different(raw):
    empty = {"InternetService": None, "OnlineSecurity": None, "PaymentMethod": None, "Partner": None}
    row = build_features(clean_raw(raw(empty))).first()
    flags = [row[c] for c in ("has_internet", "has_security", "payment_risk_flag", "has_partner")]
    assert flags == [1, 0, 0, 0]
    assert row["InternetService"] is None


def test_total_charges_texts(raw):
    texts = ["abc", "1d", "NaN", "   ", "12.5"]
    df = clean_raw(raw(*[{"TotalCharges": t, "MonthlyCharges": 10.0, "tenure": 3} for t in texts]))
    totals = [r["TotalCharges"] for r in build_features(df).orderBy("customerID").collect()]
    assert totals == [30.0, 30.0, 30.0, 30.0, 12.5]


def test_strip_keeps_null(raw):
    df = strip_text(raw({"gender": "\tMale ", "Contract": None}))
    assert df.select("gender", "Contract").first() == ("Male", None)


def test_unknown_label_fails(raw):
    for value in ("Maybe", None):
        with pytest.raises(PySparkException, match="Unknown value in Churn"):
            encode_churn(raw({"Churn": value})).collect()


def test_unknown_contract_fails_when_strict(raw):
    for value in ("Weekly", None):
        with pytest.raises(PySparkException, match="Unknown value in Contract"):
            build_features(clean_raw(raw({"Contract": value}))).collect()


def test_lenient_upload(raw):
    df = raw(
        {"Contract": "Weekly", "tenure": 100, "MonthlyCharges": -5.0, "TotalCharges": " "},
        {"tenure": None, "SeniorCitizen": None, "MonthlyCharges": None, "TotalCharges": "x"},
    ).drop("Churn")
    far, empty = prepare_upload(df).orderBy("customerID").collect()
    assert far["contract_term_months"] == 1
    assert far["tenure_bucket"] == "nan"
    assert far["monthly_charges_log"] == 0.0
    assert far["TotalCharges"] == -500.0
    assert (empty["tenure"], empty["SeniorCitizen"], empty["MonthlyCharges"], empty["TotalCharges"]) == (0, 0, 0.0, 0.0)


def test_upload_counts_are_truncated(raw):
    df = raw({}).withColumns({"tenure": F.lit(" 12.9 "), "SeniorCitizen": F.lit("1")})
    row = coerce_upload(df).first()
    assert (row["tenure"], row["SeniorCitizen"]) == (12, 1)


def test_upload_needs_all_fields(raw):
    with pytest.raises(ValueError, match=r"No source column for the scoring fields tenure"):
        prepare_upload(raw({}).drop("tenure"))


def test_features_do_not_depend_on_partitioning(telco):
    moved = build_features(telco.repartition(7))
    assert moved.exceptAll(build_features(telco)).isEmpty()

"""One local session for all tests, and small record builders."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from ebbline.schemas import RAW_COLUMNS, RAW_SCHEMA, REQUEST_COLUMNS, REQUEST_SCHEMA  # noqa: E402
from ebbline.session import builder  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

RECORD = {
    "customerID": "0001-BASE",
    "gender": "Female",
    "SeniorCitizen": 0,
    "Partner": "Yes",
    "Dependents": "No",
    "tenure": 12,
    "PhoneService": "Yes",
    "MultipleLines": "No",
    "InternetService": "DSL",
    "OnlineSecurity": "No",
    "OnlineBackup": "Yes",
    "DeviceProtection": "No",
    "TechSupport": "No",
    "StreamingTV": "No",
    "StreamingMovies": "No",
    "Contract": "Month-to-month",
    "PaperlessBilling": "Yes",
    "PaymentMethod": "Electronic check",
    "MonthlyCharges": 50.0,
    "TotalCharges": "600.0",
    "Churn": "No",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(root / "shared"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Raw records from the base record and the given changes, one per row."""

    def build(*changes: dict):
        rows = [
            {**RECORD, "customerID": f"{i:04d}-BASE", **change} for i, change in enumerate(changes or ({},), start=1)
        ]
        return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], RAW_SCHEMA)

    return build


@pytest.fixture(scope="session")
def requests(spark):
    def build(*changes: dict):
        rows = [
            {**RECORD, "TotalCharges": 600.0, "customerID": f"{i:04d}-BASE", **change}
            for i, change in enumerate(changes or ({},), start=1)
        ]
        return spark.createDataFrame([tuple(r[c] for c in REQUEST_COLUMNS) for r in rows], REQUEST_SCHEMA)

    return build


@pytest.fixture(scope="session")
def telco(spark):
    """Stored raw records derived from the smallest given tables."""
    from ebbline.operators.clean import clean_raw
    from ebbline.plans import inputs

    return clean_raw(inputs.telco_raw(spark, SF_DIR)).persist()

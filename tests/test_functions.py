import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ebbline.functions import (
    clip,
    gaussian_noise,
    lookup,
    risk_segment,
    round_even,
    strip,
    tenure_bucket,
    to_number,
)
from ebbline.functions.text import WHITESPACE


def values(spark, rows, ddl, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {ddl}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_tenure_bucket_edges(spark):
    edges = [-1, 0, 12, 13, 24, 25, 48, 49, 72, 73, None]
    expected = ["nan", "0_12", "0_12", "13_24", "13_24", "25_48", "25_48", "49_72", "49_72", "nan", "nan"]
    assert values(spark, edges, "bigint", tenure_bucket("x")) == expected


def test_risk_segment_edges(spark):
    edges = [-0.01, 0.0, 0.3, 0.3 + 1e-9, 0.7, 0.7 + 1e-9, 1.0, 1.0 + 1e-9, None]
    expected = ["nan", "low", "low", "medium", "medium", "high", "high", "nan", "nan"]
    assert values(spark, edges, "double", risk_segment("x")) == expected


def test_number_parsing(spark):
    texts = ["12", " 1.5 ", "-.5", "1e3", "1d", "abc", "NaN", " ", "", "1,000", "Infinity", "0x10", None]
    expected = [12.0, 1.5, -0.5, 1000.0, None, None, None, None, None, None, math.inf, None, None]
    assert values(spark, texts, "string", to_number(F.col("x"), StringType())) == expected


def test_nan_becomes_null(spark):
    assert values(spark, [1.0, float("nan"), None], "double", to_number(F.col("x"), DoubleType())) == [1.0, None, None]


def test_whitespace_set_is_complete():
    assert set(WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_strip_matches_python(spark):
    texts = [" a b ", "\t\na\r", "  a　", "\x1fa\x1c", "", " ", "a", None]
    expected = [t.strip() if t is not None else None for t in texts]
    assert values(spark, texts, "string", F.expr(strip("x"))) == expected


def test_round_even_matches_numpy(spark):
    numbers = [1.015, 2.5, 0.125, 0.375, -0.125, 1.005, 123.455, 99.995, 0.0]
    expected = np.round(numbers, 2).tolist()
    assert values(spark, numbers, "double", round_even(F.col("x"), 2)) == expected


def test_clip_keeps_null(spark):
    assert values(spark, [-1.0, 3.0, 9.0, None], "double", clip(F.col("x"), 0.0, 6.0)) == [0.0, 3.0, 6.0, None]


def test_lookup_default(spark):
    column = lookup("x", {"a": 1, "b": 2}, "9")
    assert values(spark, ["a", "b", "c", None], "string", column) == [1, 2, 9, 9]


def test_noise_is_normal_and_stable(spark):
    df = spark.range(40000).select(F.col("id").cast("string").alias("key"))
    noise = gaussian_noise(F.lit(42), F.col("key"), 0.03).alias("noise")
    figures = df.select(noise).agg(F.avg("noise"), F.stddev("noise"), F.skewness("noise"), F.kurtosis("noise")).first()
    assert figures[0] == pytest.approx(0.0, abs=6e-4)
    assert figures[1] == pytest.approx(0.03, rel=0.02)
    assert figures[2] == pytest.approx(0.0, abs=0.05)
    assert figures[3] == pytest.approx(-0.1, abs=0.1)
    moved = df.repartition(7, "key").select("key", noise)
    assert moved.exceptAll(df.select("key", noise)).isEmpty()


def test_noise_differs_by_seed(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    pair = df.select(gaussian_noise(F.lit(42), F.col("key"), 1.0).alias("a"), gaussian_noise(F.lit(43), F.col("key"), 1.0).alias("b"))
    assert abs(pair.stat.corr("a", "b")) < 0.08

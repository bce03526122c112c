"""Staged foreign datasets, addressed by token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.operators.profile import approximate_profiles, column_sketches, merged_sketches

_TOKEN = re.compile("[0-9a-f]{32}")


class UploadStore:
    """A folder with one Parquet dataset per token and a registry of names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _data(self, token: str) -> str:
        return f"{self.root}/data/upload_token={token}"

    @property
    def _registry(self) -> str:
        return f"{self.root}/registry"

    def stage(self, df: DataFrame, original_filename: str) -> str:
        """Store a dataset under a new token and note its file name."""
        token = uuid4().hex
        df.write.mode("errorifexists").parquet(self._data(token))
        entry = self.spark.range(1).select(
            F.lit(token).alias("upload_token"),
            F.lit(original_filename).alias("original_filename"),
            F.current_timestamp().alias("staged_at"),
        )
        entry.write.mode("append").parquet(self._registry)
        return token

    def load(self, token: str) -> DataFrame:
        try:
            if _TOKEN.fullmatch(token):
                return self.spark.read.parquet(self._data(token))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        raise FileNotFoundError("No dataset is staged under this token.")

    def sketch(self, token: str) -> DataFrame:
        """Sketches of a staged dataset, made at the first call and stored beside it."""
        path = f"{self.root}/sketches/upload_token={token}"
        data = self.load(token)
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        column_sketches(data).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def profile_together(self, tokens: Sequence[str]) -> DataFrame:
        """Estimated profile of several staged datasets as one; their rows are not read again."""
        own = [self.sketch(token) for token in tokens]
        return approximate_profiles(merged_sketches(reduce(DataFrame.unionByName, own)))

    def metadata(self, token: str) -> dict:
        """The stored details of a token; empty for an unknown one."""
        try:
            entries = self.spark.read.parquet(self._registry)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        row = entries.where(F.col("upload_token") == token).select("original_filename").first()
        return row.asDict() if row else {}

"""Stage datasets in versions, and the log that says which version holds.

A stage is written to a folder of its own and becomes the current one by an
entry in the log. Readers follow the log, so the version before stays readable
until the new one is whole, and a run that dies on the way leaves nothing that
anyone reads. An entry also keeps a fingerprint of all that the stage was made
from; a job that runs again does a stage only if its fingerprint has changed.

One job at a time writes below a root; any number may read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.sources.files import write_stage

LOG_SCHEMA = "position bigint, stage string, version string, fingerprint string, committed_at timestamp"


@dataclass(frozen=True)
class Commit:
    """One entry of the log; the version is a folder below the root."""

    position: int
    stage: str
    version: str
    fingerprint: str | None


def fingerprint(**parts: object) -> str:
    """A digest of everything that determines a stage: versions of its inputs and parameters."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files below a path; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    row = listed.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("digest"),
    ).first()
    return fingerprint(**row.asDict())


class StageStore:
    """The versions of all stages below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def _log_path(self) -> str:
        return f"{self.root}/stage_log"

    def log(self) -> DataFrame:
        """All entries; none where nothing was ever written."""
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self._log_path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def current(self, stage: str) -> Commit | None:
        """The entry that holds for a stage."""
        newest = F.max_by(F.struct("position", "stage", "version", "fingerprint"), "position").alias("entry")
        row = self.log().where(F.col("stage") == stage).agg(newest).select("entry.*").first()
        return Commit(**row.asDict()) if row["version"] else None

    def folder(self, stage: str) -> str:
        """The folder of the version that holds; a stage never written fails."""
        commit = self.current(stage)
        if commit is None:
            raise FileNotFoundError(f"The stage {stage} was never written below {self.root}")
        return f"{self.root}/{commit.version}"

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(stage))

    def version(self, stage: str) -> str | None:
        commit = self.current(stage)
        return commit.version if commit else None

    def run(self, stage: str, made_from: str | None, write: Callable[[str], None]) -> bool:
        """Make a stage unless the one that holds was made from the same; whether it was made.

        ``write`` is given the folder of the new version. A fingerprint of None never holds.
        """
        commit = self.current(stage)
        if commit and made_from is not None and commit.fingerprint == made_from:
            return False
        version = f"{stage}/version={uuid4().hex}"
        write(f"{self.root}/{version}")
        self._append(stage, version, made_from)
        return True

    def put(self, stage: str, df: DataFrame, made_from: str | None = None, by_date: bool = False) -> bool:
        """Make a stage from a DataFrame, which is computed only if it is needed."""
        return self.run(stage, made_from, lambda path: write_stage(df, path, by_date))

    def _append(self, stage: str, version: str, made_from: str | None) -> None:
        last = self.log().agg(F.max("position")).first()[0]
        entry = self.spark.range(1).select(
            F.lit((last or 0) + 1).cast("bigint").alias("position"),
            F.lit(stage).alias("stage"),
            F.lit(version).alias("version"),
            F.lit(made_from).cast("string").alias("fingerprint"),
            F.current_timestamp().alias("committed_at"),
        )
        entry.coalesce(1).write.mode("append").parquet(self._log_path)

    def vacuum(self, stage: str, keep: int = 1) -> int:
        """Delete the folders of a stage that are not among its newest versions, and those never finished; how many."""
        newest = self.log().where(F.col("stage") == stage).orderBy(F.desc("position")).limit(keep)
        kept = {row["version"] for row in newest.select("version").collect()}
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{stage}")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [f.getPath() for f in system.listStatus(place) if f"{stage}/{f.getPath().getName()}" not in kept]
        for folder in gone:
            system.delete(folder, True)
        return len(gone)

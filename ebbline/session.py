"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def builder(name: str = "ebbline") -> SparkSession.Builder:
    """Session builder with the settings the jobs are planned for.

    Partition counts are left to adaptive execution: shuffles start wide and
    are merged to the advisory size, and skewed partitions are split.
    """
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made for local sessions only; a
    cluster without it is refused, because a folder on one machine is not
    visible to the others and is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ebbline-")
    return _LOCAL_ROOTS[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder name below the shared working folder."""
    return f"{scratch_root(spark)}/ebbline/{label}-{uuid4().hex}"

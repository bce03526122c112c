"""Exact stratified train/test split."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions import hash52
from ebbline.operators.ranks import order_statistics

CLASSES = (0, 1)


def held_out_counts(class_sizes: dict[int, int], test_share: float) -> dict[int, int]:
    """Test rows per class: shares of the training size, largest remainders first."""
    rows = sum(class_sizes.values())
    train_rows = rows - math.ceil(test_share * rows)
    exact = {c: n / rows * train_rows for c, n in class_sizes.items()}
    train = {c: math.floor(x) for c, x in exact.items()}
    left = train_rows - sum(train.values())
    for c in sorted(exact, key=lambda c: (train[c] - exact[c], c))[:left]:
        train[c] += 1
    return {c: n - train[c] for c, n in class_sizes.items()}


def stratified_split(
    df: DataFrame, key: str = "customerID", label: str = "churn_flag", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` ('train' or 'test') with the exact share in both classes.

    Rows are ordered by a hash of their key and the first ones of each class
    are held out. Only the hash at the boundary is looked up, so no class is
    ever sorted or gathered, and the split is a filter on the key: it does not
    depend on partitioning, and all rows of one key fall on one side. The passes
    share the persisted hashes, one number per row.
    """
    place = hash52(F.col(key), seed)
    by_class = {c: f"class_{c}" for c in CLASSES}
    hashes = df.select(*[F.when(F.col(label) == c, place).alias(name) for c, name in by_class.items()])

    def boundary(counts: dict[str, int]) -> dict[str, list[int]]:
        sizes = held_out_counts({c: counts[name] for c, name in by_class.items()}, test_share)
        return {by_class[c]: [n] for c, n in sizes.items() if n}

    hashes.persist(StorageLevel.MEMORY_AND_DISK)
    limits = order_statistics(hashes, list(by_class.values()), boundary)
    hashes.unpersist()
    held_out = F.lit(False)
    for c, name in by_class.items():
        if name in limits:
            held_out |= (F.col(label) == c) & (place <= limits[name][0])
    return df.withColumn("split", F.when(held_out, "test").otherwise("train"))

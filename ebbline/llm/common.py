"""Helpers shared by the text operators: stored tables, words and spans as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.session import scratch_dir

#: Fixed value: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
LINE = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Later steps then start from files that every executor sees, so a lost
    executor costs the running tasks and not the steps before.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def running_sum(numbers: Column, block: int = 512) -> Column:
    """Inclusive running sums of an array, in blocks so that long arrays stay cheap.

    Appending to an array copies it; with blocks each copy is at most ``block``
    long, or one entry per block, instead of the whole array.
    """

    def sums(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("total"), F.array().cast("array<bigint>").alias("seen"))
        return F.aggregate(
            values,
            state,
            lambda s, x: F.struct(
                (s["total"] + x).alias("total"), F.concat(s["seen"], F.array(s["total"] + x)).alias("seen")
            ),
            lambda s: s["seen"],
        )

    zero = F.lit(0).cast("bigint")
    count = F.size(numbers)
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / block).cast("int")),
        lambda b: F.slice(numbers, b * block + 1, block),
    )
    inner = F.transform(cut, lambda part: sums(part, zero))
    ends = sums(F.transform(inner, lambda part: F.coalesce(F.element_at(part, -1), zero)), zero)
    return F.flatten(
        F.transform(inner, lambda part, b: F.transform(part, lambda x: x + F.when(b == 0, zero).otherwise(F.get(ends, b - 1))))
    )


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def spans(
    text: Column, found: Column, pattern: str, kind: str, rank: int, holds: Callable[[Column], Column]
) -> Column:
    """Where the leftmost matches of a pattern lie, in code points, end exclusive.

    ``found`` holds the matches in order. The pieces between them come from
    splitting the same text by the same pattern, so lengths add up to places.
    ``holds`` tells which matches count; the others are dropped.
    """
    count = F.size(found)
    gaps = F.slice(F.split(text, pattern, -1), 1, count)
    ends = running_sum(F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
    placed = F.zip_with(
        ends,
        found,
        lambda e, m: F.struct(
            (e - F.length(m)).alias("start"),
            F.lit(rank).alias("rank"),
            e.alias("end"),
            F.lit(kind).alias("kind"),
            m.alias("value"),
        ),
    )
    return F.when(count > 0, F.filter(placed, lambda s: holds(s["value"]))).otherwise(no_spans())


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined, in the order of the array."""
    return F.array_join(
        F.transform(
            found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")

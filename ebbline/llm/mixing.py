"""Documents of all sources mixed to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight that changes linearly
between the knots of its schedule; the integral of the weight up to a time,
scaled to the source's target, is how many of its words are wanted by then. A
source's documents stand in the order of a digest, epoch after epoch; the number
of words before a document is the demand at which its turn comes, and inverting
the integral there gives its training position. Sorting all documents by
position, by range, is the mix.

Targets: sources weigh by their rank and share a multiple of all words. A target
stops at ``epochs`` times the source's size, and what is left over is shared by
weight among the others until no target is above. This needs only sums over the
sources, repeated until nothing changes.

Running sums are taken in levels, so a source that holds a third of all
documents is in no single task: by digest, each source falls into buckets of
about ``BUCKET`` documents, and buckets into groups of as many buckets as there
are groups. Sums are made before anything is exchanged; groups are placed by
their sums, buckets inside their group, and documents inside their bucket.

Defined cases: a null text has size 0 and is taken 0 times, like an empty one; a
null source is a source of its own and the last in rank; a null ``doc_id`` stays
null and takes its place by its text; repeated rows are documents of their own,
and equal digests are ordered by ``doc_id`` and size, so that a rerun gives the
same rows; a source without words has target 0; only ``doc_id``, ``text`` and
``source`` are read, whatever other columns are there; an empty table gives an
empty result. The document at the target is taken in part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stored, words

#: By rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: What all sources share, in percent of all words, and how often a source may be used.
SHARE_PERCENT, EPOCHS = 150, 2
#: Knots (time, weight) of the schedules, by rank of the source, repeating: early, steady and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
#: Documents that a bucket holds on average, at most.
BUCKET = 500
_DIGEST_BITS = 60

Schedule = Sequence[tuple[float, float]]


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Start, length, weight at both ends, and area before each stretch of a schedule whose whole area is 1."""
    times, weights = zip(*schedule, strict=True)
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])) or min(weights) < 0:
        raise ValueError("A schedule runs from 0 to 1, with rising times and no negative weight.")
    pairs = list(zip(schedule, schedule[1:]))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairs]
    whole = math.fsum(areas)
    if whole <= 0:
        raise ValueError("A schedule needs some weight.")
    return [
        (t0, t1 - t0, w0 / whole, w1 / whole, math.fsum(areas[:k]) / whole)
        for k, ((t0, w0), (t1, w1)) in enumerate(pairs)
    ]


def training_position(schedule: Schedule, wanted: Column) -> Column:
    """The time at which the integral of a schedule reaches a share of its whole."""
    position = F
    for start, length, first, last, before in reversed(segments(schedule)):
        rest = wanted - F.lit(before)
        slope = (last - first) / length
        root = F.sqrt(F.greatest(F.lit(first * first) + F.lit(2 * slope) * rest, F.lit(0.0)))
        inside = F.lit(start) + F.when(rest == 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(first) + root))
        position = position.when(wanted >= F.lit(before), inside)
    return position.otherwise(F.lit(0.0))


def _sized(docs: DataFrame) -> DataFrame:
    """What the mix needs of a document: no text. The key of a null source is empty, others begin with a sign."""
    doc_id = F.col("doc_id").cast("bigint")
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(
        doc_id.alias("doc_id"),
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key"),
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        F.conv(F.substring(digest, 1, _DIGEST_BITS // 4), 16, 10).cast("bigint").alias("place"),
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last.

    Sorted by range, each partition counts from its own start; a running sum
    over the partitions' counts adds what lies before.
    """
    order = [(F.col("source_key") == ""), F.col("source_key")]
    numbered = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    numbered = stored(numbered.withColumns({"part": F.shiftright(row, 33), "at": row.bitwiseAND((1 << 33) - 1)}), "sources")
    counts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(counts.select("part", before.alias("before")), "part")
    return placed.select("source_key", "source_size", "documents", (F.col("before") + F.col("at")).alias("rank"))


def _before(value: str, keys: list[str], order: list[str]) -> Column:
    """The sum of all values that come before a row."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _starts(per_bucket: DataFrame, bits: int) -> DataFrame:
    """Words of a source before each of its buckets: those before the bucket's group, and before it in the group."""
    grouped = per_bucket.withColumn("group", F.shiftright("bucket", bits // 2))
    groups = grouped.groupBy("source_key", "group").agg(F.sum("own").alias("group_own"))
    groups = groups.withColumn("group_start", _before("group_own", ["source_key"], ["group"])).drop("group_own")
    inside = grouped.withColumn("inside", _before("own", ["source_key", "group"], ["bucket"]))
    joined = inside.join(groups, ["source_key", "group"])
    return joined.select("source_key", "bucket", (F.col("group_start") + F.col("inside")).alias("start"))


def by_rank(values: Sequence, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def with_targets(sources: DataFrame, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to sources with ``source_size`` and ``weight``.

    Only sums come to the driver. The level, words per weight, rises from round
    to round; sources above their limit stop there.
    """
    limit = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight, stopped = total * share_percent / 100, None, None
    while True:
        open_ = F.lit(True) if weight is None else F.lit(left) * F.col("weight") / F.lit(weight) <= limit
        row = sources.agg(
            F.count_if(~open_).alias("stopped"),
            F.sum(F.when(~open_, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(open_, F.col("weight")).otherwise(0)).alias("weight"),
        ).first()
        if row["stopped"] == stopped or not row["weight"]:
            break
        stopped, left, weight = row["stopped"], total * share_percent / 100 - row["taken"], row["weight"]
    if weight is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weight))
    return sources.withColumn("target", F.least(limit.cast("double"), share))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    share_percent: int = SHARE_PERCENT,
    epochs: int = EPOCHS,
) -> DataFrame:
    """One row per document, in the order of its first training position, unused ones last.

    ``uses`` holds epoch, words and position of each time that it is used;
    ``taken`` is their words. :func:`training_order` has a row for each use.
    """
    sized = stored(_sized(docs), "sizes")
    own = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    ranked = _ranked(own).withColumn("weight", by_rank(weights, F.col("rank")))
    sources = stored(with_targets(ranked, share_percent, epochs), "targets")
    most = sources.agg(F.max("documents")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, most / BUCKET))))

    buckets = sized.withColumn("bucket", F.shiftright("place", _DIGEST_BITS - bits))
    starts = _starts(buckets.groupBy("source_key", "bucket").agg(F.sum("size").alias("own")), bits)
    placed = (
        buckets.withColumn("inside", _before("size", ["source_key", "bucket"], ["place", "doc_id", "size"]))
        .join(starts.join(sources, "source_key"), ["source_key", "bucket"])
        .withColumn("before", F.col("start") + F.col("inside"))
    )
    wanted = F.floor("target")

    def use(epoch: int) -> Column:
        begin = F.col("before") + F.lit(epoch) * F.col("source_size")
        part = F.greatest(F.least(wanted - begin, F.col("size")), F.lit(0))
        reached = F.try_divide(begin.cast("double"), F.col("target"))
        at = F.element_at(
            F.array(*[training_position(s, reached) for s in schedules]), (F.col("rank") % len(schedules) + 1).cast("int")
        )
        return F.when(part > 0, F.struct(F.lit(epoch + 1).alias("epoch"), part.alias("words"), at.alias("position")))

    uses = F.array_compact(F.array(*[use(e) for e in range(epochs)]))
    mixed = placed.withColumn("uses", uses).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("uses", F.lit(0).cast("bigint"), lambda a, u: a + u["words"]).alias("taken"),
        F.get("uses", F.lit(0))["position"].alias("position"),
        "uses",
    )
    order = [F.asc_nulls_last("position"), F.asc("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each use of a document, sorted by range of its position."""
    each = mixed.select("doc_id", F.inline("uses"))
    return each.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")

"""Category labels as a table, so that no column's labels have to fit anywhere else.

The labels of all columns are counted, sorted by range and numbered where they
are; the table is stored in one folder per column. A record gets the number of
its label by a join, and since a column's folder is all that such a join reads,
its measured size tells Spark whether to broadcast it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.session import scratch_dir


def numbered_labels(levels: DataFrame, path: str) -> DataFrame:
    """``column_name, value`` with the place of each value in its column, from 0, by code point; stored below a path.

    Parts of a range sort count for themselves; what is collected in one task
    is a count per part and column.
    """
    spark = levels.sparkSession
    order = ["column_name", "value"]
    row = F.monotonically_increasing_id()
    parts = levels.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = parts.withColumns({"part": F.shiftright(row, 33), "at": row.bitwiseAND((1 << 33) - 1)})
    unnumbered = scratch_dir(spark, "labels")
    placed.write.parquet(unnumbered)
    placed = spark.read.parquet(unnumbered)
    counts = placed.groupBy("column_name", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "column_name", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place = F.col("before") + F.col("at") - F.col("first")
    numbered = placed.join(starts, ["column_name", "part"]).select("value", place.alias("place"), "column_name")
    numbered.write.partitionBy("column_name").parquet(path)
    return spark.read.parquet(path)


def label_counts(levels: DataFrame) -> dict[str, int]:
    """How many labels each column has: one number per column."""
    return {r["column_name"]: r["n"] for r in levels.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}


class LabelIndexer(Transformer, MLWritable, MLReadable):
    """Adds the number of each column's label; one that the table lacks gets the number behind the last.

    ``columns`` are names in the table, ``inputCols`` and ``outputCols`` the
    record's; ``sizes`` are the labels per column. The numbers carry their range
    as metadata, so an encoder needs no pass to learn it.
    """

    columns = Param(Params._dummy(), "columns", "columns of the label table", TypeConverters.toListString)
    inputCols = Param(Params._dummy(), "inputCols", "record columns that hold labels", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "record columns for their numbers", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "labels per column", TypeConverters.toListInt)
    path = Param(Params._dummy(), "path", "where the label table is", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, inputCols=None, outputCols=None, sizes=None, path=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def table(self) -> DataFrame:
        """The label table; its folders are listed here."""
        schema = "value string, place bigint, column_name string"
        return SparkSession.active().read.schema(schema).parquet(self.getOrDefault("path"))

    def labels(self, column: str, table: DataFrame | None = None) -> DataFrame:
        """Value and place of a column's labels."""
        table = self.table() if table is None else table
        return table.where(F.col("column_name") == column).select("value", "place")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        given = [f"`{c}`" for c in dataset.columns]
        names: Sequence[tuple] = list(
            zip(*[self.getOrDefault(p) for p in ("columns", "inputCols", "outputCols", "sizes")], strict=True)
        )
        joined, numbers, table = dataset, [], self.table()
        for k, (column, source, target, size) in enumerate(names):
            own = self.labels(column, table).toDF(f"_label_{k}", f"_place_{k}")
            joined = joined.join(own, F.col(source) == F.col(f"_label_{k}"), "left")
            nominal = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
            place = F.coalesce(F.col(f"_place_{k}"), F.lit(size)).cast("double")
            numbers.append(place.alias(target, metadata=nominal))
        return joined.select(*given, *numbers)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(DefaultParamsWriter):
    """Parameters as usual, and the table beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        table = self.sparkSession.read.parquet(self.instance.getOrDefault("path"))
        table.write.partitionBy("column_name").parquet(f"{path}/labels")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> LabelIndexer:
        found = super().load(path)
        found._set(path=f"{path}/labels")
        return found

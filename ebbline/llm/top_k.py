"""Exact top-k by inner product, in buckets of vectors of like length.

Vectors are sorted by length and cut into buckets of bounded size. An inner
product is at most the product of the lengths, so a query whose ``k``-th best
score so far is known needs a bucket only if the cosine this score asks for,
``threshold / (|query| * longest in bucket)``, is at most one. That threshold
comes from the bucket of the longest vectors. In a bucket that stays, the local
cosine chooses the pruning: a low one cuts the bucket at the length below which
no vector can reach the threshold; a high one leaves only vectors whose value at
the query's largest coordinate is compatible with it. What is left is
multiplied out in exact numbers.

Queries travel in blocks, and only to the buckets they need. A task takes a
block through its buckets by falling length and raises the thresholds as better
vectors turn up, so that it hands on ``k`` rows per query and no more.

Defined cases: a vector that is null, empty or holds a null or non-finite
component takes no part, nor does a null id; every row is a candidate of every
query but itself, also rows that share an id, and each row that is a query has
its own result; vectors of different dimensions don't meet; equal scores are
ranked by id; an empty table gives an empty result. Components beyond 1e150
count as 1e150, and a product beyond 64 bits as the nearest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stored

#: A little more than rounding can add to a product of lengths.
SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Settings:
    """``bucket`` and ``block`` bound what a task holds; from ``by_coordinate`` on, coordinates prune better."""

    k: int = 20
    scale: int = 64
    bucket: int = 2048
    block: int = 512
    by_coordinate: float = 0.9


def whole_vectors(rows: DataFrame, settings: Settings) -> DataFrame:
    """``vec_id``, the whole-number vector, its dimension and length, and a number for the row."""
    valid = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    good = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(valid)
    vector = F.transform("embedding", lambda x: _whole(x.cast("double") * settings.scale))
    one = good.select("vec_id", "asked", vector.alias("vector"), F.monotonically_increasing_id().alias("row"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return one.select("vec_id", "row", "asked", "vector", F.size("vector").alias("dim"), F.sqrt(squares).alias("length"))


def _whole(x: Column) -> Column:
    """The whole number below, as a double: from 2**53 on every double is one."""
    small = F.abs(x) < 2.0**53
    return F.when(small, F.floor(F.when(small, x)).cast("double")).otherwise(F.greatest(F.least(x, F.lit(1e150)), F.lit(-1e150)))


BLOCK = "block bigint, dim int, n int, longest double, ids binary, rows binary, lengths binary, matrix binary"


def _blocks(size: int):
    """Rows of one dimension, sorted by falling length, in blocks of at most ``size``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            lengths = rows["length"].to_numpy()
            values = rows["vector"].combine_chunks().flatten().to_numpy()
            made += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": [base + made],
                    "dim": pa.array([rows["dim"][0].as_py()], pa.int32()),
                    "n": pa.array([len(rows)], pa.int32()),
                    "longest": [float(lengths.max())],
                    "ids": [rows["vec_id"].to_numpy().astype(np.int64).tobytes()],
                    "rows": [rows["row"].to_numpy().astype(np.int64).tobytes()],
                    "lengths": [lengths.tobytes()],
                    "matrix": [values.astype(np.float64).tobytes()],
                }
            )

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            while len(held):
                dims = held["dim"].to_numpy()
                same = int(np.argmax(dims != dims[0])) or len(dims)
                if same < size and same == len(dims):
                    break
                cut = min(same, size)
                yield block(held.slice(0, cut))
                held = held.slice(cut)
            held = held.combine_chunks()
        if held is not None and len(held):
            yield block(held)

    return emit


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    order = [F.col("dim"), F.col("length").desc(), F.col("vec_id"), F.col("row")]
    ranged = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_blocks(size), BLOCK)


def _read(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = (np.frombuffer(row[f"{prefix}{name}"], np.int64) for name in ("ids", "rows"))
    lengths = np.frombuffer(row[f"{prefix}lengths"], np.float64)
    return ids, rows, lengths, np.frombuffer(row[f"{prefix}matrix"], np.float64).reshape(len(ids), -1)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum is a whole number they hold, else in whole numbers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(axis=1, initial=0) * queries.shape[1]
    small = most < 2.0**53
    out = np.empty((len(queries), len(vectors)), np.int64)
    out[:, small] = (queries @ vectors[small].T).astype(np.int64)
    if not small.all():
        whole = [[int(x) for x in q] for q in queries.tolist()]
        for v in np.flatnonzero(~small):
            own = [int(x) for x in vectors[v].tolist()]
            exact = (sum(a * b for a, b in zip(q, own)) for q in whole)
            out[:, v] = [min(max(x, -(2**63)), 2**63 - 1) for x in exact]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores first, small ids first among equals."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    # The complement falls as the score rises, and unlike the negative it always fits.
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]


RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


class _Block:
    """A block of queries on its way through the buckets, and the best that each has met so far."""

    def __init__(self, row: dict, settings: Settings):
        self.number, self.settings = row["q_block"], settings
        self.ids, self.rows, self.lengths, self.queries = _read(row, "q_")
        self.thresholds = np.frombuffer(row["thresholds"], np.float64).copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def meet(self, row: dict) -> None:
        """A bucket: what the pruning leaves out can't be among the best."""
        settings = self.settings
        ids, rows, lengths, vectors = _read(row, "")
        units = None
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            need = np.where(self.thresholds > 0, self.thresholds / self.lengths, 0.0)
            cosine = need / max(lengths[0], 1e-300)
        for q in np.flatnonzero(cosine <= SLACK):
            cut = int(np.searchsorted(-lengths, -need[q] / SLACK, side="right"))
            at = np.arange(cut)
            if cosine[q] >= settings.by_coordinate and self.lengths[q] > 0:
                if units is None:
                    units = vectors / np.maximum(lengths, 1e-300)[:, None]
                unit = self.queries[q] / self.lengths[q]
                c = int(np.abs(unit).argmax())
                t = min(cosine[q], 1.0)
                spread = np.sqrt((1 - t * t) * (1 - min(unit[c] ** 2, 1.0)))
                close = np.abs(units[:cut, c] - unit[c] * t) <= spread + 1e-6
                # Beyond the cosine itself the value may only come nearer to the query's own.
                close |= (units[:cut, c] - unit[c] * t) * np.sign(unit[c]) > 0
                at = at[close]
            at = at[rows[at] != self.rows[q]]
            if not len(at):
                continue
            scores = _products(self.queries[q : q + 1], vectors[at])[0]
            high = scores >= self.thresholds[q]
            scores = np.concatenate([self.found[q][0], scores[high]])
            candidates = np.concatenate([self.found[q][1], ids[at][high]])
            top = _best(scores, candidates, settings.k)
            self.found[q] = scores[top], candidates[top]
            if len(top) == settings.k:
                self.thresholds[q] = max(self.thresholds[q], _below(scores[top[-1]]))

    def result(self) -> pa.RecordBatch:
        sizes = [len(scores) for scores, _ in self.found]
        columns = [
            np.repeat(self.ids, sizes),
            np.concatenate([np.arange(1, n + 1) for n in sizes]),
            np.concatenate([ids for _, ids in self.found]),
            np.concatenate([scores for scores, _ in self.found]),
        ]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", "vec_id", "score"])


def _below(score: np.int64) -> float:
    """A double that is not above a whole number."""
    near = float(score)
    return near if abs(near) < 2.0**53 else float(np.nextafter(near, -np.inf))


def _search(settings: Settings):
    """The k best of each query, from buckets that come block by block and by falling length."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if block is None or block.number != row["q_block"]:
                    if block is not None:
                        yield block.result()
                    block = _Block(row, settings)
                block.meet(row)
        if block is not None:
            yield block.result()

    return emit


QUERY = (
    "q_block bigint, dim int, reach double, q_ids binary, q_rows binary, q_lengths binary, q_matrix binary,"
    " thresholds binary"
)


def _thresholds(settings: Settings):
    """Each query's k-th best score in the bucket of the longest vectors; none where that has fewer."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, rows, _, vectors = _read(row, "")
                _, query_rows, query_lengths, queries = _read(row, "q_")
                scores = _products(queries, vectors).astype(np.float64)
                # A double may be above the whole number that it stands for.
                scores = np.where(np.abs(scores) < 2.0**53, scores, np.nextafter(scores, -np.inf))
                scores[query_rows[:, None] == rows[None, :]] = -np.inf
                if len(ids) > settings.k:
                    least = np.partition(scores, len(ids) - settings.k, axis=1)[:, len(ids) - settings.k]
                else:
                    least = np.full(len(query_rows), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(least > 0, least / query_lengths, 0.0).min()
                yield pa.RecordBatch.from_pydict(
                    {
                        "q_block": [row["q_block"]],
                        "dim": pa.array([row["dim"]], pa.int32()),
                        "reach": [float(reach)],
                        "q_ids": [row["q_ids"]],
                        "q_rows": [row["q_rows"]],
                        "q_lengths": [row["q_lengths"]],
                        "q_matrix": [row["q_matrix"]],
                        "thresholds": [least.tobytes()],
                    }
                )

    return emit


def search(rows: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """The ``k`` best other vectors of every query row."""
    vectors = stored(whole_vectors(rows.select("vec_id", "embedding", is_query.alias("asked")), settings), "vectors")
    buckets = stored(blocks(vectors, settings.bucket), "buckets")
    queries = blocks(vectors.where("asked"), settings.block).select(
        F.col("block").alias("q_block"),
        "dim",
        F.col("ids").alias("q_ids"),
        F.col("rows").alias("q_rows"),
        F.col("lengths").alias("q_lengths"),
        F.col("matrix").alias("q_matrix"),
    )
    longest = buckets.groupBy("dim").agg(F.max(F.struct("longest", "n", "block")).alias("top")).select("top.block")
    heads = buckets.join(longest, "block").select("dim", "ids", "rows", "lengths", "matrix")
    asked = stored(queries.join(heads, "dim").mapInArrow(_thresholds(settings), QUERY), "queries")
    pairs = asked.select("q_block", "dim", "reach").join(buckets.select("block", "dim", "longest"), "dim")
    pairs = pairs.where(F.col("longest") * SLACK >= F.col("reach")).select("q_block", "block", "longest")
    work = pairs.join(asked.drop("dim", "reach"), "q_block").join(
        buckets.select("block", "ids", "rows", "lengths", "matrix"), "block"
    )
    walk = work.repartition("q_block").sortWithinPartitions("q_block", F.desc("longest"), "block")
    return walk.drop("block", "longest").mapInArrow(_search(settings), RESULT)

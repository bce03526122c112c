"""Exact removal of word sequences that an earlier document has too, by suffix trees built prefix by prefix.

The suffixes are those of at least 50 words; below depth 50 no node is needed.
They are split by prefixes, each as long as it takes to fit a part into memory:

1. The prefix of a suffix reaches at first to the end of its stem, the 20 words
   with the least hash among its first 50: 20 to 50 words. Equal prefixes end in
   equal stems, so all prefixes with one stem make up a part, and neighbouring
   suffixes with one stem, a run, go there as one stretch of text. Only stems
   that stand in two documents can lead to a repeat; a bit field of fixed size
   marks them, and other suffixes are dropped where they are read.
2. Runs whose whole text is equal are one branch: all but the document with the
   smallest id lose it, and the run of that document goes on.
3. The words of every part are counted. A part of more than ``most_words`` is
   split by longer prefixes of its suffixes, 30, then 40, then all 50 words.
4. A part in memory becomes a suffix array with the lengths of the prefixes that
   neighbours have in common, which are the subtree's inner nodes. Those of depth
   50 or more, with two documents below, are the repeats; what starts side by
   side in one run makes up a maximal one. A prefix of all 50 words is a node by
   itself, of which only the smallest id is needed.

Words are told apart by 64-bit hashes. Groups of copies meet step 2 as partial
minima, so no task holds a group. A set bit of another stem only lets suffixes
through to step 4, which is exact.

Defined cases: an empty table gives no rows; a null text has no words; a null
``doc_id`` neither loses words nor makes others lose them; rows that share a
``doc_id`` are judged each by its own text and don't count as smaller than one
another; only ``doc_id`` and ``text`` are read by ``repeats``; ``remove_repeats``
keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stored
from ebbline.llm.hashing import U, mix, parts, powers, runs, stretches, text_bytes, words_of
from ebbline.llm.worker import within

WORD_BASE = 0xC2B2AE3D27D4EB4F
#: 64-bit numbers of the bit field that come to the driver as one row.
CHUNK = 4096


@dataclass(frozen=True)
class Settings:
    """``filter_bits`` is the fixed size of the bit field, ``most_words`` the largest part built in memory.

    ``longer`` are the lengths in words that the prefixes of larger parts grow to; the window comes last.
    """

    window: int = 50
    stem: int = 20
    longer: tuple[int, ...] = (30, 40)
    filter_bits: int = 27
    most_words: int = 400_000


@dataclass(frozen=True)
class Runs:
    """Runs of suffixes with one stem, over all texts of a batch."""

    stem: np.ndarray
    text: np.ndarray
    low: np.ndarray  # first word, counted over the batch
    count: np.ndarray
    data: np.ndarray  # bytes of the batch
    begins: np.ndarray  # of every word of the batch, as are the next two
    ends: np.ndarray
    hashes: np.ndarray
    before: np.ndarray  # words before each text


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each stretch of ``width``; the first of equals."""
    place = np.arange(len(values))
    reach = 1
    while reach * 2 <= width:
        a, b = place[:-reach], place[reach:]
        place = np.where(values[b] < values[a], b, a)
        reach *= 2
    if reach < width:
        a, b = place[: len(place) - (width - reach)], place[width - reach :]
        place = np.where(values[b] < values[a], b, a)
    return place


def find_runs(texts: pa.Array, settings: Settings) -> Runs | None:
    data, offsets = text_bytes(texts)
    begins, ends, before = words_of(data, offsets)
    if len(begins) < settings.window:
        return None
    hashes = stretches(data, begins, ends)
    stems = runs(hashes, settings.stem)
    place = _least(stems, settings.window - settings.stem + 1)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    whole = text[: len(place)] == text[settings.window - 1 :]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return None
    at, owner = place[starts], text[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    return Runs(stems[at[first]], owner[first], starts[first], count, data, begins, ends, hashes, before)


def _bit(stem: np.ndarray, bits: int) -> np.ndarray:
    return (mix(stem) >> U(64 - bits)).astype(np.int64)


def _stems(settings: Settings):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = find_runs(part["text"], settings)
                if found is None:
                    continue
                ids = part["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)[found.text]
                order = np.lexsort((ids, found.stem))
                stem, ids = found.stem[order], ids[order]
                new = np.ones(len(stem), bool)
                new[1:] = (stem[1:] != stem[:-1]) | (ids[1:] != ids[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stem[new].view(np.int64)), pa.array(ids[new])], ["stem", "doc_id"]
                )

    return emit


def shared_stems(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Bit field of the stems that stand in two documents: ``2**filter_bits`` bits, whatever the input."""
    run = within("substring_dedup", _stems(settings))
    stems = docs.select("doc_id", "text").mapInArrow(run, "stem bigint, doc_id bigint")
    shared = stems.groupBy("stem").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(_bit(batch["stem"].to_numpy().view(U), settings.filter_bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(places >> 6), pa.array((U(1) << (places & 63).astype(U)).view(np.int64))], ["word", "mask"]
            )

    def chunk(rows: pa.Table) -> pa.Table:
        part = np.zeros(CHUNK, np.int64)
        part[rows["word"].to_numpy() % CHUNK] = rows["mask"].to_numpy()
        return pa.table({"chunk": rows["chunk"][:1], "part": pa.array([part.tobytes()], pa.binary())})

    words = shared.where("low < high").select("stem").mapInArrow(bits, "word bigint, mask bigint")
    chunks = (
        words.groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .withColumn("chunk", F.floor(F.col("word") / CHUNK).cast("int"))
        .groupBy("chunk")
        .applyInArrow(chunk, "chunk int, part binary")
    )
    field = np.zeros(max(1, (1 << settings.filter_bits) // (64 * CHUNK)) * CHUNK, np.int64)
    for row in chunks.toLocalIterator():
        field[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["part"], np.int64)
    return field.view(np.uint8)


#: A run's places in its document, the stretches they cover, and its text.
RUNS = (
    "stem bigint, run bigint, doc_id bigint, text_key bigint, lows array<int>, begins array<int>, ends array<int>, "
    "n_words int, words binary"
)


def _marked_runs(sent, settings: Settings):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for part in parts(batch):
                found = find_runs(part["text"], settings)
                if found is None:
                    continue
                bit = _bit(found.stem, settings.filter_bits)
                keep = np.flatnonzero((field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if not len(keep):
                    continue
                low, count, text = found.low[keep], found.count[keep], found.text[keep]
                up, down = powers(len(found.hashes) + 1, WORD_BASE)
                sums = np.zeros(len(found.hashes) + 1, U)
                np.cumsum(found.hashes * up[: len(found.hashes)], out=sums[1:])
                content = mix((sums[low + count + settings.window - 1] - sums[low]) * down[low] + count.astype(U))
                # A document that repeats a run gives one row with all its places.
                low_in = low - found.before[text]
                order = np.lexsort((low, content, found.stem[keep], text))
                same = np.zeros(len(order), bool)
                same[1:] = (
                    (content[order[1:]] == content[order[:-1]])
                    & (found.stem[keep][order[1:]] == found.stem[keep][order[:-1]])
                    & (text[order[1:]] == text[order[:-1]])
                )
                one = np.flatnonzero(~same)
                width = count[order] + settings.window - 1
                place = low_in[order]
                apart = ~same
                apart[1:] |= place[1:] > place[:-1] + width[:-1]
                cut = np.flatnonzero(apart)
                last = np.append(cut[1:], len(order)) - 1
                rows = order[one]
                kept_text = text[rows]
                content_bytes = found.data.tobytes()
                starts, stops = found.begins[low[rows]], found.ends[low[rows] + count[rows] + settings.window - 2]

                def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
                    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

                arrays = [
                    pa.array(found.stem[keep][rows].view(np.int64)),
                    pa.array(content[rows].view(np.int64)),
                    part["doc_id"].take(pa.array(kept_text)).cast(pa.int64()),
                    part["text_key"].take(pa.array(kept_text)),
                    lists(place.astype(np.int32), np.append(one, len(order))),
                    lists(place[cut].astype(np.int32), np.searchsorted(cut, np.append(one, len(order)))),
                    lists((place[last] + width[last]).astype(np.int32), np.searchsorted(cut, np.append(one, len(order)))),
                    pa.array((count[rows] + settings.window - 1).astype(np.int32)),
                    pa.array([content_bytes[i:j] for i, j in zip(starts, stops)], pa.binary()),
                ]
                names = ["stem", "run", "doc_id", "text_key", "lows", "begins", "ends", "n_words", "words"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return emit


#: Suffixes that stand side by side, with the prefix that deals them out: ``begin`` is the place of the first in its run.
SUFFIXES = "prefix bigint, doc_id bigint, text_key bigint, lows array<int>, begin int, n_words int, words binary"
#: Stretches of a run, counted from each of its places.
NODES = "doc_id bigint, text_key bigint, lows array<int>, begin int, end int"


def ranks(words: np.ndarray, ends: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words of every suffix among all, up to ``most`` words.

    ``ends`` is where each suffix's stretch ends; what is shorter ranks first.
    """
    found = {1: np.unique(words, return_inverse=True)[1].reshape(-1) + 1}
    length, place = 1, np.arange(len(words))
    while length * 2 <= most:
        first, after = found[length], place + length
        second = np.where(after < ends, first[np.minimum(after, len(words) - 1)], 0)
        length *= 2
        found[length] = np.unique(first * (len(words) + 2) + second, return_inverse=True)[1].reshape(-1) + 1
    return found


def common(ranked: dict[int, np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common, as far as the ranks reach."""
    shared = np.zeros(len(a), np.int64)
    for length in sorted(ranked, reverse=True):
        rank, i, j = ranked[length], a + shared, b + shared
        inside = np.flatnonzero((i + length <= ends[a]) & (j + length <= ends[b]))
        same = inside[rank[i[inside]] == rank[j[inside]]]
        shared[same] += length
    return shared


def suffix_array(
    words: np.ndarray, ends: np.ndarray, starts: np.ndarray, ids: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``window`` words, then of ``ids``, and the words that
    each has in common with the one before it.

    Every suffix has that many words.
    """
    ranked = ranks(words, ends, window)
    longest = max(ranked)
    rank = ranked[longest]
    order = np.lexsort((ids, rank[starts + window - longest], rank[starts]))
    placed = starts[order]
    shared = np.zeros(len(placed), np.int64)
    shared[1:] = common(ranked, ends, placed[:-1], placed[1:])
    return order, shared


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _subtrees(settings: Settings):
    """Repeats in the parts of a partition sorted by prefix; holds one batch and the part that runs on."""
    window = settings.window

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        prefix, doc = rows["prefix"].to_numpy(), rows["doc_id"].to_numpy()
        part = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        several = np.minimum.reduceat(doc, part) < np.maximum.reduceat(doc, part)
        wanted = np.flatnonzero(np.repeat(several, np.diff(np.append(part, len(doc)))))
        if not len(wanted):
            return None
        rows = rows.take(pa.array(wanted))
        doc = doc[wanted]
        data, offsets = text_bytes(rows["words"].combine_chunks())
        begins, stops, before = words_of(data, offsets)
        sizes = np.diff(before)
        counts = sizes - (window - 1)
        row, place = np.repeat(np.arange(len(doc)), counts), _places(counts)
        starts = before[row] + place
        order, shared = suffix_array(stretches(data, begins, stops), np.repeat(before[1:], sizes), starts, doc[row], window)
        # A node of depth ``window`` or more: neighbours that have so much in common. Its first has the smallest id.
        node = np.flatnonzero(shared < window)
        smallest = np.repeat(doc[row[order[node]]], np.diff(np.append(node, len(order))))
        repeated = np.zeros(len(order), bool)
        repeated[order] = doc[row[order]] > smallest
        at = np.flatnonzero(repeated)
        # Suffixes side by side in one run are one stretch.
        new = np.ones(len(at), bool)
        new[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        owner = row[at[first]]
        begin = rows["begin"].to_numpy()[owner]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[owner], pa.int64()),
                pa.array(rows["text_key"].to_numpy()[owner], pa.int64()),
                rows["lows"].combine_chunks().take(pa.array(owner)),
                pa.array((begin + place[at[first]]).astype(np.int32)),
                pa.array((begin + place[at[last]] + window).astype(np.int32)),
            ],
            ["doc_id", "text_key", "lows", "begin", "end"],
        )

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole parts, as many at once as a part may have words."""
        prefix, reached = rows["prefix"].to_numpy(), np.cumsum(rows["n_words"].to_numpy().astype(np.int64))
        closed = np.append(np.flatnonzero(prefix[1:] != prefix[:-1]), len(prefix) - 1)
        start = 0
        while start < len(prefix):
            before = reached[start - 1] if start else 0
            fit = closed[(closed >= start) & (reached[closed] <= before + settings.most_words)]
            stop = int(fit[-1] if len(fit) else closed[closed >= start][0]) + 1
            found = solve(rows.slice(start, stop - start))
            if found is not None:
                yield found
            start = stop

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            prefix = held["prefix"].to_numpy()
            whole = int(np.searchsorted(prefix, prefix[-1]))
            if whole:
                yield from solved(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None:
            yield from solved(held)

    return emit


def _lengthened(length: int, window: int):
    """Every suffix by itself, dealt by its first ``length`` words; where that is all, without its text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "words", 200_000):
                data, offsets = text_bytes(part["words"])
                begins, stops, before = words_of(data, offsets)
                counts = np.diff(before) - (window - 1)
                row, place = np.repeat(np.arange(part.num_rows), counts), _places(counts)
                starts = before[row] + place
                hashes = runs(stretches(data, begins, stops), length, WORD_BASE)[starts]
                prefix = mix(part["prefix"].to_numpy().view(U)[row] ^ hashes).view(np.int64)
                whole, low, high = data.tobytes(), begins[starts], stops[starts + window - 1]
                texts = [whole[i:j] for i, j in zip(low, high)] if length < window else [b""] * len(row)
                rows = pa.array(row)
                arrays = [
                    pa.array(prefix),
                    *(part[c].take(rows) for c in ("doc_id", "text_key", "lows")),
                    pa.array((part["begin"].to_numpy()[row] + place).astype(np.int32)),
                    pa.array(np.full(len(row), window, np.int32)),
                    pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["prefix", "doc_id", "text_key", "lows", "begin", "n_words", "words"])

    return emit


def _in_memory(suffixes: DataFrame, settings: Settings) -> DataFrame:
    """Repeats of the parts that fit; their number of partitions follows the words that they hold."""
    spark = suffixes.sparkSession
    total = suffixes.agg(F.sum("n_words")).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (10 * max(settings.most_words, 100_000)))
    return (
        suffixes.repartition(count, "prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(within("substring_dedup", _subtrees(settings)), NODES)
    )


def maximal_repeats(suffixes: DataFrame, settings: Settings) -> DataFrame:
    """Stretches of runs that an earlier document has too."""
    found = None
    for length in (*settings.longer, settings.window):
        sizes = suffixes.groupBy("prefix").agg(F.sum("n_words").alias("n_words"))
        large = stored(sizes.where(F.col("n_words") > settings.most_words).select("prefix"), "large-parts")
        fit = _in_memory(suffixes.join(large, "prefix", "left_anti"), settings)
        found = fit if found is None else found.unionByName(fit)
        if large.isEmpty():
            return found
        own = suffixes.join(large, "prefix", "left_semi").select(*suffixes.columns)
        run = within("substring_dedup", _lengthened(length, settings.window))
        suffixes = stored(own.mapInArrow(run, SUFFIXES), "suffixes")
    # Prefixes of a whole window: a part is a node, of which partial minima are enough.
    nodes = suffixes.groupBy("prefix").agg(F.min("doc_id").alias("low_id"), F.max("doc_id").alias("high_id"))
    deep = (
        suffixes.select("prefix", "doc_id", "text_key", "lows", "begin")
        .join(nodes.where("low_id < high_id"), "prefix")
        .where("doc_id > low_id")
        .select("doc_id", "text_key", "lows", "begin", (F.col("begin") + settings.window).alias("end"))
    )
    return found.unionByName(deep)


def covers(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stretches of words to remove: document, text and word places, end exclusive."""
    spark = docs.sparkSession
    own = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    sent = spark.sparkContext.broadcast(shared_stems(own, settings))
    found = stored(own.mapInArrow(within("substring_dedup", _marked_runs(sent, settings)), RUNS), "runs")
    sent.unpersist()
    # Of each branch the documents with the smallest id go on, with every place where they have it.
    smallest = found.groupBy("stem", "run").agg(F.min("doc_id").alias("smallest"))
    judged = found.join(smallest, ["stem", "run"])
    copied = (
        judged.where("doc_id > smallest")
        .select("doc_id", "text_key", F.explode(F.arrays_zip("begins", "ends")).alias("cover"))
        .select("doc_id", "text_key", F.col("cover.begins").alias("begin"), F.col("cover.ends").alias("end"))
    )
    branches = judged.where("doc_id = smallest").select(
        F.col("stem").alias("prefix"), "doc_id", "text_key", "lows", F.lit(0).alias("begin"), "n_words", "words"
    )
    placed = (
        maximal_repeats(stored(branches, "branches"), settings)
        .withColumn("low", F.explode("lows"))
        .select("doc_id", "text_key", (F.col("low") + F.col("begin")).alias("begin"), (F.col("low") + F.col("end")).alias("end"))
    )
    return placed.unionByName(copied)


KEPT = "doc_id bigint, text_key bigint, n_words bigint, n_removed bigint, kept string"


def _removed_words(n: int, cover: list[dict]) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    for c in cover:
        change[c["begin"]] += 1
        change[c["end"]] -= 1
    return np.cumsum(change[:-1]) > 0


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            n_words, n_removed, kept = [], [], []
            for text, cover in zip(part["text"].to_pylist(), part["cover"].to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes split at the same six characters as words do
                n_words.append(len(words))
                if cover:
                    removed = _removed_words(len(words), cover)
                    n_removed.append(int(removed.sum()))
                    words = [words[i] for i in np.flatnonzero(~removed)]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].cast(pa.int64()),
                    part["text_key"],
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "text_key", "n_words", "n_removed", "kept"],
            )


def _covered(docs: DataFrame, settings: Settings) -> DataFrame:
    """The documents with their stretches; a document's list is bounded by its own words."""
    lists = (
        covers(docs, settings)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("begin", "end")).alias("_cover"))
        .select(F.col("doc_id").alias("_cover_id"), F.col("text_key").alias("_cover_key"), "_cover")
    )
    key = (F.col("doc_id") == F.col("_cover_id")) & (F.xxhash64("text") == F.col("_cover_key"))
    return docs.join(lists, key, "left").drop("_cover_id", "_cover_key")


def repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: words, removed words, and the kept words joined by one space."""
    rows = _covered(docs.select("doc_id", "text"), settings)
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.col("_cover").alias("cover"))
    return rows.mapInArrow(within("substring_dedup", _keep), KEPT).drop("text_key")


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without the repeated words, all columns kept.

    A text that loses words becomes its kept words joined by one space, and its
    ``n_chars`` follows; other texts stay as they are. A document that loses all
    its words goes.
    """
    names = docs.columns

    @F.pandas_udf("string")
    def kept(texts, lists):
        out = []
        for text, cover in zip(texts, lists, strict=True):
            words = text.encode().split()
            removed = _removed_words(len(words), list(cover))
            out.append(b" ".join([words[i] for i in np.flatnonzero(~removed)]).decode())
        import pandas as pd

        return pd.Series(out, dtype=object)

    rows = _covered(docs, settings)
    clean = rows.where(F.col("_cover").isNull()).select(*names)
    cut = rows.where(F.col("_cover").isNotNull()).withColumn("_kept", kept(F.col("text"), F.col("_cover")))
    values = {"text": F.col("_kept")}
    if "n_chars" in names:
        values["n_chars"] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    cut = cut.where(F.col("_kept") != "").select(*[values.get(c, F.col(c)).alias(c) for c in names])
    return clean.unionByName(cut)

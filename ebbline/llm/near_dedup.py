"""Near-duplicate classes by BagMinHash, banding and verified multiset overlap.

A text is the bag of its five-word shingles; a shingle's weight is how often it
occurs. Weights are split at powers of two into levels, and each level of each
shingle has a Poisson process of its own, seeded by the shingle, whose rate is
the width of the level. A point belongs to a bag if its place within the level
does not exceed the weight. Each point falls to one of ``size`` components; the
earliest point of a component is its value. Two bags share a component's value
with exactly their weighted Jaccard similarity as probability, and points past
the time by which all components are taken are never made.

Equal texts are made one first. Bands of the signature give candidate groups:

1. Every group is joined with its smallest member only, and these pairs are
   verified on the whole bags. That joins copies of one text in linear work.
2. Groups whose members ended in different classes are looked at again, in cells
   of bounded size: pairs of different classes whose signatures agree enough are
   verified too, each in the first band that both share. A link found there joins
   its two classes within the cell at once, so a cell gives fewer links than it
   has classes.

Defined cases: a null text is a class of its own; equal texts, empty ones too,
share a class; a text of one to four words is one shingle; a null ``doc_id`` is
never a class's name unless all of its members are null; only ``doc_id`` and
``text`` are read; ``keep_one`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stored
from ebbline.llm.graph import components
from ebbline.llm.hashing import U, mix, parts, runs, stretches, text_bytes, words_of
from ebbline.llm.worker import within


@dataclass(frozen=True)
class Settings:
    """``estimate`` is the least agreement of signatures for a look at the bags, ``cell`` the members of a cell's side.

    Bags of up to ``carried`` shingles travel with the cells and are compared there; pairs with a larger one are joined.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6
    estimate: float = 0.65
    cell: int = 512
    carried: int = 4096

    @property
    def size(self) -> int:
        return self.bands * self.rows


def bags(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles, their weights, and the text of each, sorted by text and shingle."""
    data, offsets = text_bytes(texts)
    begins, ends, before = words_of(data, offsets)
    hashes = stretches(data, begins, ends)
    sizes = np.diff(before)
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams = runs(hashes, length)
    whole = text[: len(grams)] == text[length - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], text[: len(whole)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < length))
    if len(short):
        single = np.zeros(len(short), U)
        for k in range(length - 1):
            has = sizes[short] > k
            single[has] = mix(single[has] * U(0x100000001B3) + hashes[before[short[has]] + k] + U(k + 1))
        grams, owner = np.concatenate([grams, single]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return grams[at], np.diff(np.append(at, len(grams))), owner[at]


def signatures(grams: np.ndarray, weights: np.ndarray, owner: np.ndarray, count: int, size: int) -> np.ndarray:
    """The time of the earliest point of every component, one row per text; infinite for a text without words.

    Times of a process are summed strictly in order, so they do not depend on the texts signed along with it.
    """
    level = [np.zeros(len(grams), np.int64)]
    node = [np.arange(len(grams))]
    k = 1
    while True:
        above = np.flatnonzero(weights > (1 << (k - 1)))  # level k holds the places above 2**(k-1), up to 2**k
        if not len(above):
            break
        level.append(np.full(len(above), k))
        node.append(above)
        k += 1
    level, node = np.concatenate(level), np.concatenate(node)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    floor = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    seed = mix(grams[node] + level.astype(U) * U(0xD1B54A32D192ED03))
    total = np.bincount(owner, weights, minlength=count)
    values = np.full((count, size), np.inf)
    due = np.divide(size * (np.log(size) + 5), total, out=np.zeros(count), where=total > 0)
    todo = total > 0
    while todo.any():
        flat = np.full(count * size, np.inf)
        live = np.flatnonzero(todo[owner[node]])
        time, step = np.zeros(len(live)), 0
        while len(live):
            # Few processes left: take many of their points at once.
            many = int(np.clip((1 << 16) // len(live), 1, 256))
            draws = mix(seed[live][:, None] + np.arange(step + 1, step + many + 1, dtype=U) * U(0x9E3779B97F4A7C15))
            gaps = -np.log(((draws >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live][:, None]
            times = np.cumsum(np.column_stack([time, gaps]), axis=1)[:, 1:]
            bound = due[owner[node[live]]]
            r, c = np.nonzero(times <= bound[:, None])
            more = mix(draws[r, c] ^ U(0xA0761D6478BD642F))
            place = floor[live[r]] + 1 + (((more & U(0xFFFFFFFF)) * width[live[r]].astype(U)) >> U(32)).astype(np.int64)
            held = place <= weights[node[live[r]]]
            part = (((more >> U(32)) * U(size)) >> U(32)).astype(np.int64)
            np.minimum.at(flat, (owner[node[live[r]]] * size + part)[held], times[r, c][held])
            time, step = times[:, -1], step + many
            on = time <= bound
            live, time = live[on], time[on]
        flat = flat.reshape(count, size)
        full = todo & np.isfinite(flat).all(axis=1)
        values[full] = flat[full]
        todo &= ~full
        due = np.where(todo, due * 2, due)
    return values


SIGNED = "doc_id bigint, text_key binary, n int, marks binary, keys array<bigint>"


def _sign(settings: Settings):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                grams, weights, owner = bags(part["text"], settings.shingle)
                count = part.num_rows
                values = signatures(grams, weights, owner, count, settings.size)
                codes = mix(values.view(U))
                keys = np.zeros((count, settings.bands), U)
                for row in range(settings.rows):
                    keys = mix(keys * U(0x100000001B3) + codes[:, row :: settings.rows] + U(row))
                keys = mix(keys + np.arange(settings.bands, dtype=U) * U(0xD1B54A32D192ED03))
                total = np.bincount(owner, weights, minlength=count).astype(np.int32)
                marks = (codes >> U(48)).astype("<u2")
                ends = np.cumsum(np.append(0, np.where(total > 0, settings.bands, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()),
                        part["text_key"],
                        pa.array(total),
                        pa.array([x.tobytes() for x in marks], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[total > 0].ravel().view(np.int64))),
                    ],
                    ["doc_id", "text_key", "n", "marks", "keys"],
                )

    return emit


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5("text")).alias("text_key"), "text"
    )


def _bag_rows(settings: Settings):
    """Every shingle occurrence as its own number, sorted: overlap of bags is then overlap of sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                grams, weights, owner = bags(part["text"], settings.shingle)
                place = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
                items = mix(np.repeat(grams, weights) + place.astype(U) * U(0xD1B54A32D192ED03))
                cuts = np.cumsum(np.bincount(np.repeat(owner, weights), minlength=part.num_rows))
                rows = [np.sort(x).tobytes() for x in np.split(items, cuts[:-1])]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(rows, pa.binary())], ["node", "bag"])

    return emit


def _alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sorted bags overlap enough."""
    if len(one) > len(two):
        one, two = two, one
    same = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return same >= similarity * (len(one) + len(two) - same)


def _verified(similarity: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _alike(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), similarity)
                for x, y in zip(batch["bag_a"], batch["bag_b"], strict=True)
            ]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    return emit


def verify(pairs: DataFrame, bag: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (``a``, ``b``) whose bags overlap enough."""
    one = bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    two = bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(within("near_dedup", _verified(settings.similarity)), "a bigint, b bigint")


def _cell_pairs(settings: Settings):
    """Pairs of a partition sorted by cell; holds one cell and one batch."""

    def solve(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ci, cj = (cell[c][0].as_py() for c in ("key", "ci", "cj"))
        node, root, slot, n = (cell[c].to_numpy() for c in ("node", "root", "slot", "n"))
        marks = np.frombuffer(b"".join(cell["marks"].to_pylist()), "<u2").reshape(len(node), -1)
        keys = cell["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        first = cell["first"].to_numpy()
        bag = [None if x is None else np.frombuffer(x, U) for x in cell["bag"].to_pylist()]
        label = np.unique(root, return_inverse=True)[1]
        out = []
        for i in range(len(node)):
            if slot[i] != ci or node[i] == first[i]:
                continue
            other = (label != label[i]) & (node != first) & (slot == cj)
            if ci == cj:
                other &= node > node[i]
            other &= np.minimum(n, n[i]) >= settings.similarity * np.maximum(n, n[i])
            at = np.flatnonzero(other)
            agree = (marks[at] == marks[i]).mean(axis=1)
            at, agree = at[agree >= settings.estimate], agree[agree >= settings.estimate]
            if len(at):
                mine = keys[at, (keys[at] == keys[i]).argmax(axis=1)] == key
                at, agree = at[mine], agree[mine]
            for j in at[np.argsort(-agree, kind="stable")]:
                if label[j] == label[i]:
                    continue
                seen = bag[i] is not None and bag[j] is not None
                if not seen:
                    out.append((node[i], node[j], False))
                elif _alike(bag[i], bag[j], settings.similarity):
                    out.append((node[i], node[j], True))
                    label[label == label[j]] = label[i]
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, columns)], ["a", "b", "seen"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            names = [held[c].to_numpy() for c in ("key", "ci", "cj")]
            new = np.any([x[1:] != x[:-1] for x in names], axis=0)
            cuts = np.append(0, np.flatnonzero(new) + 1)
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                yield from solve(held.slice(start, stop - start))
            held = held.slice(int(cuts[-1])).combine_chunks()
        if held is not None:
            yield from solve(held)

    return emit


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def text_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per different text: ``text_key``, the smallest ``doc_id`` that has it, and its class's ``root``."""
    own = _keyed(docs).where(F.col("text").isNotNull())
    signed = own.mapInArrow(within("near_dedup", _sign(settings)), SIGNED)
    texts = stored(
        signed.groupBy("text_key")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n").alias("n"),
            F.first("marks").alias("marks"),
            F.first("keys").alias("keys"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    bands = texts.select("node", F.explode("keys").alias("key"))
    groups = stored(
        bands.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1"),
        "groups",
    )
    members = stored(bands.join(groups, "key"), "members")
    wanted = members.select("node").distinct().join(texts.select("node", "doc_id", "text_key"), "node")
    bag = stored(
        own.join(
            wanted.select("node", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")),
            (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")),
        )
        .select("node", "text")
        .mapInArrow(within("near_dedup", _bag_rows(settings)), "node bigint, bag binary")
        .dropDuplicates(["node"]),
        "bags",
    )
    stars = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    links = stored(verify(stars, bag, settings), "links")
    roots = components(links)
    # Groups of two are settled by their one pair; others may hold links that do not touch their smallest member.
    open_members = _rooted(members.where("members > 2"), roots)
    mixed = open_members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    sides = F.ceil(F.col("members") / settings.cell).cast("int")
    cells = (
        open_members.join(mixed.where("low < high").select("key"), "key")
        .withColumn("slot", F.pmod(F.xxhash64("node"), sides).cast("int"))
        .withColumn("side", F.explode(F.sequence(F.lit(0), sides - 1)))
        .select(
            "key",
            F.least("slot", "side").alias("ci"),
            F.greatest("slot", "side").alias("cj"),
            "node",
            "root",
            "first",
            "slot",
        )
        .join(texts.select("node", "n", "marks", "keys"), "node")
        .join(bag.where(F.octet_length("bag") <= 8 * settings.carried), "node", "left")
        .repartition("key", "ci", "cj")
        .sortWithinPartitions("key", "ci", "cj")
    )
    more = stored(cells.mapInArrow(within("near_dedup", _cell_pairs(settings)), "a bigint, b bigint, seen boolean"), "pairs")
    unseen = verify(more.where("not seen").select("a", "b").distinct(), bag, settings)
    found = stored(more.where("seen").select("a", "b").unionByName(unseen), "links")
    return _rooted(texts.select("node", "text_key", "doc_id"), components(links.unionByName(found)))


def near_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: its class, named by the smallest ``doc_id``, and the documents in it."""
    texts = stored(text_classes(docs, settings), "classes")
    names = texts.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    texts = texts.join(names, "root").select(F.col("text_key").alias("own_key"), "class_id", "root")
    rows = _keyed(docs).select("doc_id", "text_key")
    rows = rows.join(texts, F.col("text_key") == F.col("own_key"), "left")
    sizes = rows.where("root is not null").groupBy("root").agg(F.count("*").alias("class_size"))
    return rows.join(sizes, "root", "left").select(
        "doc_id",
        F.when(F.col("own_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
    )


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without near-duplicates: of each class the smallest ``doc_id`` stays, with all columns.

    Rows that repeat a kept document's id and text are one document, and one of
    them stays. Documents without a text are classes of their own and stay.
    """
    names = docs.columns
    texts = stored(text_classes(docs, settings), "classes")
    # Of equal smallest ids the smallest key, so that one text is kept even where an id names several.
    kept = texts.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("kept")
    )
    copies = _keyed(docs).groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    kept = kept.select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.text_key").alias("_kept_key"))
    kept = (
        kept.join(
            copies,
            F.col("_kept_id").eqNullSafe(F.col("doc_id")) & (F.col("_kept_key") == F.col("text_key")),
        )
        .select("_kept_id", "_kept_key", "copies")
    )
    kept = stored(kept, "kept")
    key = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.unhex(F.md5("text")) == F.col("_kept_key"))
    single = docs.join(kept.where("copies = 1"), key, "left_semi")
    several = docs.join(kept.where("copies > 1"), key, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several).unionByName(docs.where(F.col("text").isNull())).select(*names)

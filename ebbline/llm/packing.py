"""Packing along a space-filling curve.

Each document's tokens give a hashed count vector, a fixed random projection
brings it to four dimensions, and its place on a Hilbert curve through them is
its key. Documents near in content are near on the curve. The curve is cut into
ranges of equal weight, sorted, and each range is packed front to back: a
sequence takes tokens until it is full and the next one goes on where it
stopped. What is left at the end of a range is cut into powers of two, which
need no padding, so ranges are packed apart from each other and nothing is
padded at all.

Many copies share one key; the range sort breaks ties by ``doc_id`` and token
count, so a large group of copies is spread over ranges.

Defined cases: a null text counts as empty and still has the end id; repeated
rows are packed each on its own; a null ``doc_id`` stays null; only ``doc_id``
and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ebbline.llm.common import stored
from ebbline.llm.hashing import parts, stretches
from ebbline.llm.worker import within

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS, BUCKETS = 4, 15, 1024
VOCABULARY = "byte_bpe_50k"

TOKENS = "doc_id bigint, curve bigint, doc_tokens bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


class ByteTokenizer:
    """Ids of a public byte-level vocabulary of at most 65,536 entries, as little-endian 16-bit numbers.

    The vocabulary splits before a blank that a visible character follows, and
    around a single line feed, whatever stands there. So the stretches between
    such places can be encoded apart: of many texts each different stretch is
    encoded once, and its ids are copied to all its places. Texts with two blanks
    in a row, or one at an end, are encoded as a whole, and texts that name a special token by the
    library that gives it its id.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, vocabulary: str):
        import base64
        import re

        import tiktoken

        lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb").read().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sizes = np.array([len(token) for token, _ in sorted(ranks.items(), key=lambda x: x[1])])
        self.library_path = public_tokenizers.path(f"{vocabulary}.json")
        self.double = re.compile(r"\s\s|\A\s|\s\Z")
        self.library = None

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u2")

    def _whole(self, text: str) -> np.ndarray | None:
        """Ids of a text that can't be cut at every blank; None of any other."""
        if self.SPECIAL in text:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.library_path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2")
        return self._plain(text) if self.double.search(text) else None

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        done = [self._whole(text) for text in texts]
        rest = iter(self._cut([text for text, ids in zip(texts, done, strict=True) if ids is None]))
        return [next(rest) if ids is None else ids for ids in done]

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        coded = [text.encode() for text in texts]
        # Each text begins with a line feed of its own, whose id is left out again.
        data = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8)
        begins_text = np.cumsum([0] + [len(x) + 1 for x in coded])
        marks = np.flatnonzero((data == 32) | (data == 10))
        begins, ends = marks[:-1], marks[1:]  # a stretch with the blank or line feed before it
        keys = stretches(data, begins, ends)
        _, shown, place = np.unique(keys, return_index=True, return_inverse=True)
        # The different stretches one after the other, each kind by itself, so that every cut stays a cut.
        fed = data[begins[shown]] == 10
        order = np.argsort(fed, kind="stable")
        sizes = (ends - begins)[shown][order]
        stops = np.cumsum(sizes)
        where = np.arange(stops[-1]) + np.repeat(begins[shown][order] - (stops - sizes), sizes)
        blank_bytes = int(sizes[: len(fed) - int(fed.sum())].sum())
        laid = data[where].tobytes()
        # A line feed that nothing follows would join the next one: give each its own call.
        ids = np.concatenate([self._plain(laid[:blank_bytes].decode()), self._fed(laid[blank_bytes:])])
        closed = np.searchsorted(np.cumsum(self.sizes[ids]), stops) + 1
        counts = np.diff(closed, prepend=0)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        own = back[place]
        starts, lengths = (closed - counts)[own], counts[own].copy()
        first = np.searchsorted(begins, begins_text[:-1])
        starts[first] += 1
        lengths[first] -= 1
        reached = np.cumsum(lengths)
        out = ids[np.arange(reached[-1]) + np.repeat(starts - (reached - lengths), lengths)]
        cuts = (reached - lengths)[first]
        return np.split(out, cuts[1:])

    def _fed(self, laid: bytes) -> np.ndarray:
        """Ids of stretches that begin with a line feed; a stretch of only that is kept apart."""
        text = laid.decode()
        pieces = []
        while "\n\n" in text:
            at = text.index("\n\n")
            pieces.append(self._plain(text[: at + 1]))
            text = text[at + 1 :]
        if text.endswith("\n") and len(text) > 1:
            pieces.append(self._plain(text[:-1]))
            text = "\n"
        pieces.append(self._plain(text))
        return np.concatenate(pieces)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> ByteTokenizer:
    return ByteTokenizer(vocabulary)


@lru_cache(maxsize=1)
def projection() -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every id, and a fixed random direction per bucket."""
    draw = np.random.default_rng(20)
    return draw.integers(0, BUCKETS, 1 << 16), draw.standard_normal((BUCKETS, DIMENSIONS)) / np.sqrt(BUCKETS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of whole numbers below ``2**bits`` on the Hilbert curve.

    From the highest bit down, each coordinate whose bit is set turns the lower
    bits of the first, otherwise it swaps them with the first; a Gray code over
    all coordinates then gives the order.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        lower = level - 1
        for i in range(n):
            set_bit = (x[i] & level) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(set_bit, lower, swap)
            x[i] ^= swap if i else 0
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _vector(ids: np.ndarray) -> np.ndarray:
    buckets, directions = projection()
    counts = np.sqrt(np.bincount(buckets[ids], minlength=BUCKETS))
    return (counts / max(np.linalg.norm(counts), 1e-9)) @ directions


def _tokenise(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocabulary)
        end = np.array([END_ID], "<u2")
        for batch in batches:
            for part in parts(batch, most=4_000_000):
                ids = [np.append(x, end) for x in encoder.encode_all([text or "" for text in part["text"].to_pylist()])]
                points = np.array([_vector(x) for x in ids])
                # Entries of the directions have variance 1/BUCKETS, so a projected unit vector stays well inside (-1, 1).
                cells = np.clip((points + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()),
                        pa.array(hilbert(cells), pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "curve", "doc_tokens", "ids"],
                )

    return run


def tokens_on_curve(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids and place on the curve of every document, stored."""
    run = within("packing", _tokenise(vocabulary), tokenizer.cache_clear)
    return stored(docs.select("doc_id", "text").mapInArrow(run, TOKENS), "tokens")


class Packer:
    """Holds the tokens that no full sequence has taken yet: less than one sequence and one document."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.held: deque[list] = deque()
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append([doc_id, ids, 0])
        self.total += len(ids)
        while self.total >= self.length:
            self._emit(self.length)

    def finish(self) -> None:
        while self.total:
            self._emit(1 << (self.total.bit_length() - 1))

    def _emit(self, size: int) -> None:
        offset = 0
        while offset < size:
            doc_id, ids, start = head = self.held[0]
            taken = min(size - offset, len(ids) - start)
            piece = ids[start : start + taken].astype("<u4").tobytes()
            self.rows.append((doc_id, start, taken, zlib.crc32(piece), len(ids), self.sequence, offset, piece))
            offset += taken
            head[2] += taken
            if head[2] == len(ids):
                self.held.popleft()
        self.total -= size
        self.sequence += 1


def _pack(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << 40)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), "<u2"))
                if len(packer.rows) >= 4096:
                    yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return run


def pack(
    docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids as little-endian 32-bit bytes."""
    order = ["curve", "doc_id", "doc_tokens"]
    ranges = tokens_on_curve(docs, vocabulary).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = PIECES + (", ids binary" if with_ids else "")
    return ranges.select("doc_id", "ids").mapInArrow(within("packing", _pack(length, with_ids), tokenizer.cache_clear), schema)

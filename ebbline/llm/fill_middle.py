"""Fill-in-middle: documents cut in three at word boundaries, and rearranged for training.

The ends of a document's tokens are a set of places in its text, kept the way
roaring sets are: places that share their upper bits make a container, which is
a sorted array, a bitmap, or a list of runs, whichever is smallest. A running
sum of the containers' sizes tells which one holds the k-th place, and a local
select inside it gives the place itself. Both cuts of a document are two such
selects; no list of its tokens is made.

A token is a word with the blanks before it, or the blanks at the end of a
text. Separators are ASCII, so places are offsets in the UTF-8 bytes and the
pieces are slices of them; code points are counted on the pieces.

What is drawn for a document depends on its id and the seed only: a digest of
``seed:doc_id`` gives the two cuts, whether it is rearranged, and the order of
the pieces. Each document is handled alone and in one pass; nothing is shuffled.

Defined cases: a null text counts as empty; an empty text, or one that holds a
marker already, stays plain, with null lengths; a null ``doc_id`` counts as an
empty one in the digest and stays null; repeated rows give repeated results;
only ``doc_id`` and ``text`` are read, whatever other columns are there; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.hashing import SEPARATORS, parts

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents, how many are rearranged, and of 100 of those, how many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80

FORMS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_LOW_BITS = 16
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True


class ArrayContainer:
    """Up to 4,096 places, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit per place, 8 kB, with a running count per 64 bits."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << _LOW_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word, left = int(self.words[at]), k - int(self.before[at])
        for _ in range(left):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """Stretches of neighbouring places: where each begins, and how many places lie before it."""

    def __init__(self, begins: np.ndarray, lengths: np.ndarray):
        self.begins = begins.astype(np.uint16)
        self.before = np.zeros(len(begins), np.int64)
        np.cumsum(lengths[:-1], out=self.before[1:])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.begins[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted places below 65,536."""
    first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    sizes = {"run": 4 * len(first), "array": 2 * len(low), "bitmap": 1 << (_LOW_BITS - 3)}
    kind = min(sizes, key=sizes.get)
    if kind == "run":
        return RunContainer(low[first], np.diff(first, append=len(low)))
    return ArrayContainer(low) if kind == "array" else BitmapContainer(low)


class BoundarySet:
    """A sorted set of places that answers which is the k-th one."""

    def __init__(self, places: np.ndarray):
        upper, first = np.unique(places >> _LOW_BITS, return_index=True)
        self.upper = upper
        self.containers = [container(low & 0xFFFF) for low in np.split(places, first[1:])] if len(places) else []
        self.before = np.append(first, len(places))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The place that has ``k`` places before it."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.upper[at]) << _LOW_BITS) + self.containers[at].select(k - int(self.before[at]))


def boundaries(data: np.ndarray) -> BoundarySet:
    """Where the tokens of a text end, as offsets in its bytes."""
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    if len(data):
        ends[-1] = True
    return BoundarySet(np.flatnonzero(ends) + 1)


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: bytes, seed: int, rate: int, suffix_first: int) -> tuple:
    """Tokens, form, characters of prefix and middle, and the output of one document."""
    data = np.frombuffer(text, np.uint8)
    ends = boundaries(data)
    n = len(ends)
    h1, h2, h3, h4 = _draws(doc_id, seed)
    marked = any(marker.encode() in text for marker in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut, stop = (ends.select(k - 1) if k else 0 for k in (low, high))
    before, middle, after = text[:cut], text[cut:stop], text[stop:]
    prefix, suffix = PREFIX.encode() + before, SUFFIX.encode() + after
    form = "spm" if h4 % 100 < suffix_first else "psm"
    pieces = [suffix, prefix] if form == "spm" else [prefix, suffix]
    output = b"".join([*pieces, MIDDLE.encode(), middle])
    return n, form, _characters(data[:cut]), _characters(data[cut:stop]), output


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """One row per document: token count, form, lengths of its pieces, and the training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, most=8_000_000):
                ids = part["doc_id"].cast(pa.int64())
                texts = part["text"].cast(pa.binary()).to_pylist()
                made = [
                    rearranged(i, text or b"", seed, rate, suffix_first)
                    for i, text in zip(ids.to_pylist(), texts, strict=True)
                ]
                n, form, before, middle, output = zip(*made, strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (n, before, middle)]
                yield pa.RecordBatch.from_arrays(
                    [ids, numbers[0], pa.array(form), *numbers[1:], pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FORMS)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from; markers stand in it at the joints only."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(F.get(piece, F.lit(1)), F.get(piece, F.lit(3)), F.get(piece, F.lit(2))))
        .when(form == "spm", F.concat(F.get(piece, F.lit(2)), F.get(piece, F.lit(3)), F.get(piece, F.lit(1))))
        .otherwise(output)
    )

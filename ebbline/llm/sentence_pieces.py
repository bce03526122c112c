"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read left to right. For every place the search keeps the best piece
that ends there; only pieces of bounded length can, so a window of that length
holds all paths that may still win. Whenever the paths of the whole window
share a boundary, everything before it is final: its ids are committed and
forgotten. Memory is thus bounded by the window and not by the text.

For a merge vocabulary a path is admissible when each two neighbouring pieces
are what merging their joined text would give; exactly one admissible path
reaches each place, and it spells the merge encoding of the text so far. That
makes the ids equal to those of the library, which the sum of piece scores
would not.

Where no piece holds two neighbouring characters side by side, all paths meet
between them. Characters that pieces join form classes (letters of a script,
marks); the text is cut where the class changes and before a blank mark that
follows another character. The stretches repeat and are remembered up to a
bound. New ones are searched in sorted order, so that one takes over the search
of the beginning it shares with the one before.

Defined cases: a null text has no ids and decodes to null; an empty text has no
ids and decodes to the empty text; repeated rows get equal results; the input
columns pass through, and a column named like the result is replaced.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ebbline.llm.hashing import parts
from ebbline.llm.worker import task_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Below the score of every piece.
UNKNOWN = float("-inf")
#: Remembered pairs of pieces, and bytes of remembered stretches of a generation; two generations are held.
PAIRS = 150_000
CACHED = 24_000_000
#: What a remembered stretch takes besides its characters and ids.
ENTRY = 150
#: Bytes of text whose stretches are searched together, and that are cut at once.
SEARCHED = 6_000_000
PART = 600_000


def kinds(pieces: Iterable[str]) -> np.ndarray:
    """The class of every code point, 0 for those that no piece joins with another.

    Two characters are of one class if pieces join them, directly or over others.
    No piece has a blank mark behind another character.
    """
    joined: dict[str, str] = {}

    def root(c: str) -> str:
        while joined.setdefault(c, c) != c:
            joined[c] = c = joined[joined[c]]
        return c

    for piece in pieces:
        text = piece.lstrip(MARK)
        if MARK in text:
            raise ValueError(f"The vocabulary has a piece with a blank inside: {piece!r}")
        for left, right in zip(text, text[1:]):
            joined[root(left)] = root(right)
    number = {c: i for i, c in enumerate(sorted({root(c) for c in joined}), start=1)}
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for c in joined:
        table[ord(c)] = number[root(c)]
    return table


class Pieces:
    """Vocabulary, search and decoding of one model file with the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(size)]
        self.ids = {name: i for i, name in enumerate(names) if plain[i]}
        self.scores = {name: model.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.kinds = kinds(self.ids)
        # The lengths of the pieces that end with given three characters, the longest first: no others need a look.
        found: dict[str, set[int]] = {}
        for name in self.ids:
            if len(name) > 2:
                found.setdefault(name[-3:], set()).add(len(name))
        self.lengths = {
            tail: (*sorted(sizes, reverse=True), *((2, 1) if tail[1:] in self.ids else (1,)))
            for tail, sizes in found.items()
        }
        spelled = [name.replace(MARK, " ").encode() if plain[i] else b"" for i, name in enumerate(names)]
        for value, i in self.byte_ids.items():
            spelled[i] = bytes([value])
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.ends = np.cumsum([len(x) for x in spelled])
        self.sizes = np.diff(self.ends, prepend=0)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the remembered stretches

    def merged(self, text: str) -> list[str]:
        """Merge encoding of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        values = [score(a + b, UNKNOWN) for a, b in zip(parts, parts[1:])]
        while values:
            best = max(values)
            if best == UNKNOWN:
                break
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = score(parts[at - 1] + parts[at], UNKNOWN)
            if at < len(values):
                values[at] = score(parts[at] + parts[at + 1], UNKNOWN)
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether two pieces may stand side by side."""
        key = left, right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def stands(self, piece: str) -> bool:
        """Whether a text of just this piece is encoded as it."""
        known = self.whole.get(piece)
        if known is None:
            if len(self.whole) >= PAIRS:
                self.whole.clear()
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def _ids(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        return [own] if own is not None else [self.byte_ids[b] for b in piece.encode()]

    def search(self, texts: list[str]) -> None:
        """Ids of stretches of any length, in sorted order, into the remembered ones.

        ``back`` holds, for every place from ``base`` on, where the piece that ends there begins. What lies
        before ``base`` is committed; ``seen`` characters led to that, so a text that shares fewer starts anew.
        """
        ids, lengths, known_pair, interval = self.ids, self.lengths.get, self.pairs.get, self.longest
        last, back, base, seen = "", [0], 0, 0
        committed: list[int] = []
        for text in texts:
            shared = 0
            for a, b in zip(last, text):
                if a != b:
                    break
                shared += 1
            if shared < seen:
                back, base, seen, shared, committed = [0], 0, 0, 0, []
            del back[shared - base + 1 :]
            for end in range(shared + 1, len(text) + 1):
                begin = end - 1
                for size in lengths(text[end - 3 : end] if end > 2 else "") or (2, 1):
                    begin = end - size
                    if begin < base:
                        continue
                    piece = text[begin:end]
                    if size > 1 and piece not in ids:
                        continue
                    if not begin:
                        if self.stands(piece):
                            break
                    else:
                        before = text[back[begin - base] : begin]
                        fits = known_pair((before, piece))
                        if self.follows(before, piece) if fits is None else fits:
                            break
                back.append(begin)
                if end % interval == 0:
                    meeting = self._meeting(back, base, end)
                    if meeting > base:
                        committed = committed + self._path(text, back, base, meeting)
                        del back[: meeting - base]
                        base, seen = meeting, end
            found = committed + self._path(text, back, base, len(text))
            self._remember(text, array("H", found).tobytes())
            last = text

    def _remember(self, text: str, found: bytes) -> None:
        self.units[text] = found
        self.held += ENTRY + len(text) + len(found)

    def _meeting(self, back: list[int], base: int, end: int) -> int:
        """The last boundary that all paths share which a later piece can still go on from."""
        paths = set(range(max(base, end + 1 - self.longest), end + 1))
        while len(paths) > 1:
            last = max(paths)
            paths.remove(last)
            paths.add(max(base, back[last - base]))
        return paths.pop()

    def _path(self, text: str, back: list[int], base: int, end: int) -> list[int]:
        """Ids of the path from the committed boundary to a place."""
        found: list[int] = []
        while end > base:
            begin = back[end - base]
            own = self.ids.get(text[begin:end])
            if own is None:
                found.extend(reversed(self._ids(text[begin:end])))
            else:
                found.append(own)
            end = begin
        found.reverse()
        return found

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different stretches of some texts, the number of each one in order, and each text's first."""
        marked = [MARK + text.replace(" ", MARK) if text else "" for text in texts]
        whole = "".join(marked)
        if not whole:
            return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        new = np.ones(len(points), bool)
        new[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 0)) & (points[:-1] != ord(MARK))
        new[1:] |= (points[1:] == ord(MARK)) & (points[:-1] != ord(MARK))
        starts = np.cumsum([0, *map(len, marked)])
        new[starts[starts < len(points)]] = True
        at = np.flatnonzero(new)
        letters = (1 + (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)).astype(np.uint8)
        ends = np.add.reduceat(letters, at, dtype=np.int64).cumsum()
        offsets = pa.py_buffer(np.append(0, ends))
        stretches = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(whole.encode()))
        coded = stretches.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(at, starts)

    def learn(self, needed: set[str]) -> None:
        """Searches all new stretches together: the more at once, the more beginnings they share."""
        if self.held >= CACHED:
            self.older, self.units, self.held = self.units, {}, 0
        missing = []
        for unit in needed:
            if unit not in self.units:
                known = self.older.get(unit)
                if known is None:
                    missing.append(unit)
                else:
                    self._remember(unit, known)
        missing.sort()
        self.search(missing)

    def encode_parts(self, parts: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each part the ids of its texts as 16-bit numbers, and where each text's begin.

        The vocabularies have fewer than 65,536 pieces.
        """
        cuts = [self.cut(texts) for texts in parts]
        self.learn({unit for needed, _, _ in cuts for unit in needed})
        while cuts:
            needed, order, first = cuts.pop(0)
            found = [self.units[unit] for unit in needed]
            size = np.array([len(x) // 2 for x in found], np.int64)
            end = np.cumsum(size)
            sizes = size[order]
            place = np.append(0, np.cumsum(sizes))
            at = np.arange(place[-1]) + np.repeat(end[order] - place[1:], sizes)
            yield np.frombuffer(b"".join(found), np.uint16)[at], place[first]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_parts([[text]]))[0].tolist()

    def decode_all(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The texts that the ids between each two of ``begins`` spell."""
        sizes = self.sizes[ids]
        place = np.cumsum(sizes)
        # The place of each letter in the joined spellings: that of its piece's end, less what is to come of it.
        letters = self.letters[np.arange(place[-1] if len(ids) else 0) + np.repeat(self.ends[ids] - place, sizes)]
        starts = np.append(0, place)[begins]
        # The blank that encoding put before each text goes.
        first = starts[:-1][starts[:-1] < starts[1:]]
        keep = np.ones(len(letters), bool)
        keep[first] = letters[first] != ord(" ")
        letters, starts = letters[keep], np.append(0, np.cumsum(keep))[starts]
        texts = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(letters.tobytes()))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            whole = letters.tobytes()
            texts = pa.array([whole[i:j].decode("utf-8", "replace") for i, j in zip(starts, starts[1:])], pa.large_string())
        return texts.cast(pa.string())

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _path(vocabulary: str) -> str:
    return public_tokenizers.path(vocabulary)


def _with(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _listed(values: np.ndarray, begins: np.ndarray, mask: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.astype(np.int32)), mask=mask)


def _encoded(own: Pieces, batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the ids of their texts; what is searched and cut at once is bounded in bytes."""
    for group in parts(batch, text, SEARCHED):
        cut = list(parts(group, text, PART))
        yield from ((part, *found) for part, found in zip(cut, own.encode_parts([p[text].to_pylist() for p in cut])))


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the ids of their whole text."""
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_of("sentence_pieces", pieces.cache_clear):
            own = pieces(_path(vocabulary))
            for batch in batches:
                for part, values, begins in _encoded(own, batch, text):
                    lists = _listed(values, begins, part[text].is_null())
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), lists], [*kept, into])

    return docs.mapInArrow(run, _with(docs, into, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the text that their ids spell."""
    kept = [c for c in df.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_of("sentence_pieces", pieces.cache_clear):
            own = pieces(_path(vocabulary))
            for batch in batches:
                for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    lists = part[ids]
                    begins = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))
                    texts = own.decode_all(lists.flatten().to_numpy(), begins)
                    texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), texts], [*kept, into])

    return df.mapInArrow(run, _with(df, into, T.StringType()))


def encode_and_decode(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", vocabulary: str = VOCABULARY
) -> DataFrame:
    """The rows with their ids and what these spell, by one worker a task instead of two."""
    kept = [c for c in docs.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_of("sentence_pieces", pieces.cache_clear):
            own = pieces(_path(vocabulary))
            for batch in batches:
                for part, values, begins in _encoded(own, batch, text):
                    texts = pc.if_else(part[text].is_valid(), own.decode_all(values, begins), pa.scalar(None, pa.string()))
                    lists = _listed(values, begins, part[text].is_null())
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), lists, texts], [*kept, ids, decoded])

    fields = [f for f in docs.schema.fields if f.name in kept]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return docs.mapInArrow(run, T.StructType(fields + added))

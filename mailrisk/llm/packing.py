"""Hierarchical multi-length packing of tokenised documents.

Every task packs the documents of its partition as they stream by, so nothing is shuffled and a
sequence never waits for another task. A document's full windows of the longest tier are cut off first.
What remains is routed to the smallest context-size tier that holds it. Tiers are packed from the longest: each
remainder opens a window, whose gap is filled with whole pieces of shorter tiers, best fit first,
and at last with the head of a piece cut to fit. Windows that cannot be filled yet wait for the next
documents; only the last one or two of a partition are padded. Step groups hold windows of one tier and
the same number of tokens each.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.words import KEPT, give_back

TIERS = (1024, 512, 256)
END = 0
STEP_WINDOWS = 64
PENDING_TOKENS = 2_000_000
EMITTED = 256  # windows in a batch of results
CACHE = 250_000  # words in each of two generations
_MARKS = ".,;:!?"
_LAST_LETTER = "\u052f"  # Latin, Greek and Cyrillic: letters that no library disputes


def _byte_signs() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary (a fixed, published mapping)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


_BYTE_SIGNS = _byte_signs()
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit values.

    A byte-level pre-tokenizer never joins a character that is not white space with a space or a single line break
    after it, so a text is encoded word by word, and words seen lately are looked up. Letters alone are one piece,
    which goes to the tokenizer's model directly, and a comma or stop after them is another. Special tokens in a
    text are text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}  # ids of a word with the space or line break before it
        self.aged: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.line_break, *marks = self._ids(["\n", *_MARKS])
        self.marks = dict(zip(_MARKS, marks))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _letters(self, piece: str) -> bytes:
        """Ids of a piece that the pre-tokenizer leaves whole."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin1").translate(_BYTE_SIGNS))]).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Make every word known."""
        if len(self.known) + 2 * len(words) > CACHE:
            self.aged, self.known = self.known, {}
        known, aged = self.known, self.aged
        other: dict[str, None] = {}
        for word in words:
            if word in known:
                continue
            if (ids := aged.get(word)) is not None:
                known[word] = ids
                continue
            opens = word[0] == "\n"
            stem = word[1:] if opens else word
            mark = self.marks.get(stem[-1:], b"")
            if mark:
                stem = stem[:-1]
            if not stem.isalpha() or max(stem) > _LAST_LETTER:
                other[word] = None
            elif opens:
                known[word] = self.line_break + self._letters(stem) + mark
            else:
                if (ids := known.get(stem) or aged.get(stem)) is None:
                    ids = self._letters(" " + stem)
                known[stem] = ids
                known[word] = ids + mark
        if other:
            known.update(zip(other, self._ids([w if w[0] == "\n" else " " + w for w in other])))

    def encode(self, text: str) -> bytes:
        words = text.split()
        gaps = text.count(" ") + text.count("\n")
        if gaps + 1 != len(words) or gaps + sum(map(len, words)) != len(text):
            # Other white space, or several in a row: whole pieces up to a space between words.
            return b"".join(self._ids(_BEFORE_WORD.split(text)))
        # A word that opens a line keeps the break as its mark; the first word gets one that is taken off again.
        words = ("\n" + text).replace("\n", " \n")[1:].split(" ")
        ids = list(map(self.known.get, words))
        if None in ids:
            self._learn(words)
            ids = list(map(self.known.__getitem__, words))
        return b"".join(ids)[len(self.line_break):]


_ENCODERS: dict[str, Encoder] = {}
KEPT.append(_ENCODERS)


def _encoder(path: str) -> Encoder:
    """One per Python worker: later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Piece:
    __slots__ = ("key", "tokens", "start", "length")

    def __init__(self, key, tokens: np.ndarray, start: int, length: int):
        self.key, self.tokens, self.start, self.length = key, tokens, start, length

    def head(self, length: int) -> _Piece:
        """Cut off the first ``length`` tokens as a piece of its own."""
        first = _Piece(self.key, self.tokens, self.start, length)
        self.start += length
        self.length -= length
        return first


class _Shelf:
    """Pieces in ascending length."""

    def __init__(self):
        self.lengths: list[tuple[int, int]] = []
        self.pieces: dict[int, _Piece] = {}
        self.count = 0

    def add(self, piece: _Piece) -> None:
        self.count += 1
        insort(self.lengths, (piece.length, self.count))
        self.pieces[self.count] = piece

    def take(self, at_most: int | None = None) -> _Piece | None:
        """The longest piece, of those that fit if a length is given."""
        i = len(self.lengths) if at_most is None else bisect_right(self.lengths, (at_most, self.count + 1))
        return self.pieces.pop(self.lengths.pop(i - 1)[1]) if i else None


def pack(pieces: list[_Piece], tiers: Sequence[int]) -> tuple[list[tuple[int, list[_Piece]]], list[_Piece]]:
    """Full windows (tier, pieces) and the pieces left over, fewer tokens than the longest tier holds."""
    longest = tiers[0]
    windows: list[tuple[int, list[_Piece]]] = []
    shelves = {tier: _Shelf() for tier in tiers}

    def route(piece: _Piece) -> None:
        while piece.length >= longest:
            windows.append((longest, [piece.head(longest)]))
        if piece.length:
            shelves[min(t for t in tiers if t >= piece.length)].add(piece)

    def filler(gap: int, tier: int) -> _Piece | None:
        shorter = [t for t in tiers if t < tier]
        for t in shorter:
            if (piece := shelves[t].take(gap)) is not None:
                return piece
        for t in (*reversed(shorter), tier):  # nothing fits whole: cut
            if (piece := shelves[t].take()) is not None:
                if piece.length <= gap:
                    return piece
                first = piece.head(gap)
                route(piece)
                return first
        return None

    for piece in pieces:
        route(piece)
    left: list[_Piece] = []
    for tier in tiers:
        while (opener := shelves[tier].take()) is not None:
            window, gap = [opener], tier - opener.length
            while gap and (piece := filler(gap, tier)) is not None:
                window.append(piece)
                gap -= piece.length
            if gap:
                left += window
            else:
                windows.append((tier, window))
    return windows, left


def _closing(left: list[_Piece], longest: int) -> list[tuple[int, list[_Piece]]]:
    """Padded windows of the longest tier for what no later document can fill."""
    windows: list[tuple[int, list[_Piece]]] = []
    window: list[_Piece] = []
    room = longest
    for piece in left:
        while piece.length:
            window.append(piece.head(min(room, piece.length)))
            room -= window[-1].length
            if not room:
                windows.append((longest, window))
                window, room = [], longest
    return windows + ([(longest, window)] if window else [])


def _pack_partition(
    batches: Iterator[pa.RecordBatch], tokenizer: str, tiers: Sequence[int]
) -> Iterator[pa.RecordBatch]:
    give_back()
    encoder = _encoder(tokenizer)
    base = TaskContext.get().partitionId() << 33
    made = 0
    in_tier = dict.fromkeys(tiers, 0)
    end = np.array([END], dtype="<u4").tobytes()

    def emit(windows: list[tuple[int, list[_Piece]]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(windows), EMITTED):
            yield table(windows[at : at + EMITTED])

    def table(windows: list[tuple[int, list[_Piece]]]) -> pa.RecordBatch:
        nonlocal made
        rows: list[tuple] = []
        for tier, window in windows:
            group = base + (tiers.index(tier) << 28) + in_tier[tier] // (STEP_WINDOWS * tiers[0] // tier)
            in_tier[tier] += 1
            offset = 0
            for p in window:
                ids = p.tokens[p.start : p.start + p.length].tobytes()
                rows.append((p.key, p.start, p.length, ids, len(p.tokens), base + made, offset, tier, group))
                offset += p.length
            made += 1
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    pending: list[_Piece] = []
    tokens = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(encoder.encode(text.as_py() or "") + end, dtype="<u4")
            pending.append(_Piece(key, ids, 0, len(ids)))
            tokens += len(ids)
            if tokens >= PENDING_TOKENS:
                windows, pending = pack(pending, tiers)
                tokens = sum(p.length for p in pending)
                yield from emit(windows)
    windows, left = pack(pending, tiers)
    yield from emit(windows + _closing(left, tiers[0]))


_SCHEMA = pa.schema([
    ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
    ("step_group", pa.int64()),
])


def pack_documents(
    df: DataFrame, key: str, text: str, tokenizer: str, tiers: Sequence[int] = TIERS
) -> DataFrame:
    """One row per piece: ``key`` (bigint), ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``,
    ``tier``, ``step_group``.

    ``tiers`` are context sizes, longest first; ``tokenizer`` is the file of a byte-level tokenizer, readable on every
    worker. A document is its token ids and then id 0; a null or empty text is that id alone, and a null key
    is kept. Each id lies in one piece; ``offset`` is the piece's place in its sequence. Full
    sequences have exactly ``tier`` ids, the last ones of a partition may have fewer and are to be padded.
    Repeated rows are packed once each. An empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(
        lambda it: _pack_partition(it, tokenizer, tuple(tiers)),
        "key bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, tier int, step_group bigint",
    )
    return rows.withColumnRenamed("key", key)

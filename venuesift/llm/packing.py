"""Packing of tokenised documents into windows by the sum-of-squares rule.

A level array holds how many open windows are filled to each level. A piece goes to the level that
makes the sum of the squared counts smallest, a new window included. Documents longer than a
window fill windows of their own; their rest is placed like any other piece. When a
task has no more documents, or too many open windows, it cuts pieces so that open windows fill
each other up: at most one window per call stays partly filled.

Every task packs the documents it reads, so nothing is shuffled, and the memory it needs is
bounded by the open windows. Windows are numbered by partition, which a repeated task
has in common with the lost one.

Defined results: a null text is an empty one and gives the end token only; repeated rows and null
ids are packed like others; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches, text_of

WINDOW = 1024
END_ID = 0
#: Open windows of a task before they are filled up with each other.
MAX_OPEN = 4096
_PART_SHIFT = 33
#: White space of the pattern (``\s`` of Unicode) in runs that are encoded apart.
LONG_RUN = 50_000
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")

#: ``ids``: little-endian 32-bit ids of the piece.
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("sequence_length", pa.int64()), ("padded_length", pa.int64()),
])
_SPARK_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, sequence_length long, padded_length long"
)

Encode = Callable[[str], list[int]]


@lru_cache(maxsize=2)
def byte_pair_encoder(ranks_path: str, pattern: str) -> Encode:
    """Encoder of a byte-level vocabulary; special tokens in a text are ordinary text.

    ``pattern`` ends with ``\\s+(?!\\S)|\\s+``: a run of white space is one piece, without its last character if
    text follows. The regex of tiktoken cannot take a run of a million, so long runs are cut out as that piece.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return encoding.encode_ordinary(text)
        ids, at = [], 0
        for found in _LONG_RUN.finditer(text):
            end = found.end() if found.end() == len(text) else found.end() - 1
            ids += encoding.encode_ordinary(text[at:found.start()])
            ids += encoding._encode_single_piece(text[found.start():end])
            at = end
        return [*ids, *encoding.encode_ordinary(text[at:])] if at else encoding.encode_ordinary(text)

    return encode


def public_encoder() -> Encode:
    """The 50k vocabulary of the installed public tokenizers, found on the machine of the task.

    It gives the ids that ``tokenizers`` gives with ``encode_special_tokens``; see ``tokenizers_encoder``.
    """
    import public_tokenizers

    return byte_pair_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Tokens of a tokenizers file that are found in a text before anything else, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as lines:
        tokens = json.load(lines)["added_tokens"]
    for token in tokens:
        if any(token[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token with conditions: {token}")
    return {token["content"]: token["id"] for token in tokens}


def with_added_tokens(encode: Encode, tokens: dict[str, int]) -> Encode:
    """``encode`` for what stands between the tokens; of tokens at one place the longest counts."""
    if not tokens:
        return encode
    either = re.compile("|".join(re.escape(token) for token in sorted(tokens, key=len, reverse=True)))

    def split_and_encode(text: str) -> list[int]:
        ids, at = [], 0
        for found in either.finditer(text):
            ids += encode(text[at:found.start()])
            ids.append(tokens[found[0]])
            at = found.end()
        return [*ids, *encode(text[at:])] if at else encode(text)

    return split_and_encode


def tokenizers_encoder() -> Encode:
    """The ids that ``tokenizers`` gives for ``byte_bpe_50k.json``, at a third of the time."""
    import public_tokenizers

    return with_added_tokens(public_encoder(), added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


class Packer:
    """Sum-of-squares packing of pieces ``(doc_id, start, ids, doc_tokens)`` as a stream."""

    def __init__(self, first_id: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.count = np.zeros(window, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Place a document; gives the rows of the windows that became full."""
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            yield from self._close([(doc_id, start, ids[start:start + self.window], len(ids))])
        if whole < len(ids):
            yield from self._place((doc_id, whole, ids[whole:].copy(), len(ids)))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2])
        level = self._best_level(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield from self._close(pieces)
            return
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self._fill_up(keep_last=True)

    def _best_level(self, size: int) -> int:
        """Level whose choice raises the sum of squared counts least; 0 is a new window.

        One window moves from level l to l + size: -2 c(l) + 2 c(l + size) + 2, without the
        part of a level that is not counted (0 and full).
        """
        count, top = self.count, self.window - size
        change = 2 * (count[size:] - count[:top]) + 2
        change[0] = 2 * count[size] + 1 if top else 0
        change[1:][count[1:top] == 0] = np.iinfo(np.int64).max
        best, least = int(change.argmin()), int(change.min())
        if top and count[top] and 1 - 2 * int(count[top]) <= least:
            best = top
        return best

    def finish(self) -> Iterator[tuple]:
        yield from self._fill_up(keep_last=False)

    def _fill_up(self, keep_last: bool) -> Iterator[tuple]:
        """Cut the pieces of open windows into one row of full windows; the last may be partial."""
        pieces = [piece for level in reversed(self.open) for window in level for piece in window]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        held, room = [], self.window
        for doc_id, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                part = ids[at:at + room]
                held.append((doc_id, start + at, part, total))
                at += len(part)
                room -= len(part)
                if not room:
                    yield from self._close(held)
                    held, room = [], self.window
        if held and keep_last:
            self.open[self.window - room].append(held)
            self.count[self.window - room] += 1
            self.n_open = 1
        elif held:
            yield from self._close(held)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        filled = sum(len(ids) for _, _, ids, _ in pieces)
        padded = filled if filled & (filled - 1) == 0 else self.window
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), ids.tobytes(), total, self.next_id, offset, filled, padded
            offset += len(ids)
        self.next_id += 1


def pack(
    docs: DataFrame, encoder: Callable[[], Encode] = public_encoder, window: int = WINDOW,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row per piece of a document, with its ids and its place in a window.

    A window is padded to its full length, except one whose filled length is a power of two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            encode = encoder()
            packer = Packer(TaskContext.get().partitionId() << _PART_SHIFT, window)
            for doc_id, text in rows_of(batches):
                ids = np.array([*encode(text), END_ID], dtype="<u4")
                yield from packer.add(doc_id, ids)
            yield from packer.finish()

        return batched(each(), SCHEMA)

    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, _SPARK_SCHEMA)


def windows(pieces: DataFrame, pad_id: int = END_ID) -> DataFrame:
    """The padded windows themselves: ``sequence_id, ids`` (little-endian 32-bit)."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    pad = F.unhex(F.lit(pad_id.to_bytes(4, "little").hex()))
    grouped = pieces.groupBy("sequence_id", "sequence_length", "padded_length").agg(joined.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda have, part: F.concat(have, part["ids"]))
    gap = (F.col("padded_length") - F.col("sequence_length")).cast("int")
    return grouped.select("sequence_id", F.concat(ids, F.unhex(F.repeat(F.hex(pad), gap))).alias("ids"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "sequence_length", "padded_length",
    )

"""Alignment of two tokenizations of one text by the byte offsets at which tokens of both end.

Each tokenizer gives ids and the cumulative ends of its tokens in bytes. A dictionary from end to index is made for
each, their key sets are intersected, and the sorted common ends slice both id lists into groups. Tokens of a
group are linked where their byte ranges overlap: inside the slices every end of either tokenizer closes exactly one
overlap of one token of each.

Counts of linked id pairs over the corpus, and the best partners of an id, go back to the documents without a row
for each link: documents are worked on in blocks of some megabytes, a block has a dictionary of its different
pairs, and only these dictionaries are shuffled, summed and looked up.

Defined results: a null or empty text, and a text whose tokens do not spell it (white space signs of the pieces
inside texts), has no tokens, groups or links, and an empty digest; repeated rows and null ids are counted like other rows;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches, text_of
from venuesift.llm.packing import public_encoder
from venuesift.operators.lookup import lookup_join
from venuesift.session import cut_lineage

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
_PAIR_BITS, _DOC_BITS = 40, 23
_B_BITS = 20


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` gives the ids of a text, ``tokens`` the bytes that each id stands for."""

    encode: Callable[[str], list[int]]
    tokens: list[bytes]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "sizes", np.array(list(map(len, self.tokens)), dtype=np.int64))


@lru_cache(maxsize=1)
def byte_level() -> Tokenizer:
    """The public byte-level vocabulary on a blank and the text; special tokens are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer as File

    # The signs of bytes in entries: printable Latin-1 characters stand for themselves, the rest from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    names = File.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_vocab()
    tokens = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        tokens[i] = bytes(signs[c] for c in name)
    encode = public_encoder()
    return Tokenizer(lambda text: encode(" " + text), tokens)


@lru_cache(maxsize=1)
def sentence_pieces() -> Tokenizer:
    """The public pieces with byte fallback, which put a blank before the text themselves."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]
    return Tokenizer(model.encode, tokens)


class Alignment(NamedTuple):
    """Ids of both; group g has the ids from ``a_cuts[g - 1]`` to ``a_cuts[g]``; link i joins ``a_links[i]`` to ``b_links[i]`` (places)."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray


_NONE = np.zeros(0, dtype=np.int64)
NOTHING = Alignment(*[_NONE] * 6)


def align(text: str | None, first: Tokenizer, second: Tokenizer) -> Alignment:
    """Groups and links of the tokens of a text; nothing if either does not spell a blank and the text."""
    if not text:
        return NOTHING
    data, sides, ends = (" " + text).encode(), [], []
    for side in (first, second):
        ids = side.encode(text)
        if b"".join(map(side.tokens.__getitem__, ids)) != data:
            return NOTHING
        sides.append(np.array(ids, dtype=np.int64))
        ends.append(np.cumsum(side.sizes[sides[-1]]))
    a_at, b_at = (dict(zip(part.tolist(), range(len(part)), strict=True)) for part in ends)
    # Ends rise along a text, and so do the keys that both have.
    common = [end for end in a_at if end in b_at]
    cuts = [np.fromiter(map(at.__getitem__, common), np.int64, len(common)) + 1 for at in (a_at, b_at)]
    # Every end closes one overlap: that of the tokens of both in which it lies.
    marks = np.zeros((2, len(data) + 1), dtype=bool)
    marks[0, ends[0]] = marks[1, ends[1]] = True
    closes = np.flatnonzero(marks[0] | marks[1])
    return Alignment(*sides, *cuts, *(np.cumsum(mark)[closes - 1] for mark in marks))


@lru_cache(maxsize=8)
def _written(size: int, after: str) -> np.ndarray:
    """Each id in digits with a sign behind it, in eight bytes filled with zeros."""
    names = np.array([f"{i}{after}".encode() for i in range(size)], dtype="S8")
    return names.view(np.uint64)


def group_text(found: Alignment) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
    n_a, n_b = len(found.a), len(found.b)
    if not n_a:
        return b""
    out = np.empty(n_a + n_b, dtype=np.uint64)
    size_a, size_b = (1 << max(16, int(ids.max()).bit_length()) for ids in (found.a, found.b))
    a_before, b_before = (np.concatenate([[0], cuts[:-1]]) for cuts in (found.a_cuts, found.b_cuts))
    # Before the ids of a group come those of both sides in all earlier groups.
    a_places = np.arange(n_a) + np.repeat(b_before, found.a_cuts - a_before)
    b_places = np.arange(n_b) + np.repeat(found.a_cuts, found.b_cuts - b_before)
    out[a_places] = _written(size_a, ",")[found.a]
    out[b_places] = _written(size_b, ",")[found.b]
    out[a_places[found.a_cuts - 1]] = _written(size_a, "|")[found.a[found.a_cuts - 1]]
    out[b_places[found.b_cuts - 1]] = _written(size_b, ";")[found.b[found.b_cuts - 1]]
    signs = out.view(np.uint8)
    return signs[signs != 0].tobytes()[:-1]


_ALIGNED = pa.schema([
    ("id", pa.int64()), ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())),
    ("a_cuts", pa.list_(pa.int64())), ("b_cuts", pa.list_(pa.int64())),
    ("a_links", pa.list_(pa.int64())), ("b_links", pa.list_(pa.int64())),
])

Load = Callable[[], Tokenizer]


def alignments(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", first: Load = byte_level, second: Load = sentence_pieces
) -> DataFrame:
    """The ids of both tokenizers for each row, where the groups end in them, and the places of linked tokens."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        a, b = first(), second()
        for doc_id, text in rows_of(batches):
            yield doc_id, *(part.tolist() for part in align(text, a, b))

    small_batches(docs.sparkSession)
    names = "a_ids b_ids a_cuts b_cuts a_links b_links".split()
    return docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(
        lambda batches: batched(each(batches), _ALIGNED, 16),
        "id long, " + ", ".join(f"{name} array<long>" for name in names),
    )


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(name, pa.list_(pa.int64())) for name in _NUMBERS],
    ("digests", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("of_pair", pa.binary()), ("of_doc", pa.binary()), ("times", pa.binary()),
])
_BLOCKS_SPARK = (
    "block long, ids array<long>, " + ", ".join(f"{name} array<long>" for name in _NUMBERS)
    + ", digests array<string>, pairs array<long>, counts array<long>, of_pair binary, of_doc binary, times binary"
)


class _Block:
    """Documents whose pairs share a dictionary."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str, found: Alignment) -> None:
        written = group_text(found)
        digest = sha256(written).hexdigest() if written else ""
        numbers = len(found.a), len(found.b), len(found.a_cuts), len(found.a_links)
        pairs = (found.a[found.a_links] << _B_BITS) | found.b[found.b_links]
        self.keys.append((pairs << _DOC_BITS) | len(self.rows))
        self.rows.append((doc_id, *numbers, digest))
        self.size += len(text) + 256

    def row(self, number: int) -> tuple:
        # One sort by pair, then document, gives both dictionaries.
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        pairs, of_pair = np.unique(keys >> _DOC_BITS, return_inverse=True)
        counts = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(counts, of_pair, times)
        blobs = (of_pair, keys & ((1 << _DOC_BITS) - 1), times)
        return (
            number, *map(list, zip(*self.rows, strict=True)), pairs, counts,
            *(blob.astype("<i4").tobytes() for blob in blobs),
        )


def _blocks(first: Load, second: Load, block_bytes: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        a, b = first(), second()
        if max(len(a.tokens), len(b.tokens)) > 1 << _B_BITS:
            raise ValueError("a vocabulary is too large for the keys of pairs")
        block, number = _Block(), TaskContext.get().partitionId() << 33
        for doc_id, text in rows_of(batches):
            block.add(doc_id, text, align(text, a, b))
            if block.size >= block_bytes:
                yield block.row(number)
                block, number = _Block(), number + 1
        if block.rows:
            yield block.row(number)

    return lambda batches: batched(each(batches), _BLOCKS, 1)


_DONE = pa.schema([
    ("id", pa.int64()), *[(name, pa.int64()) for name in _NUMBERS], ("n_best", pa.int64()), ("count_sum", pa.int64()),
    ("groups_sha256", pa.string()),
])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in batches:
        for at in range(block.num_rows):
            row = {name: block.column(name)[at] for name in block.schema.names}
            told = row["told"].values
            docs = len(row["ids"])
            totals, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
            if told is not None and len(told):
                places = told.field("place").to_numpy()
                totals[places] = told.field("total").to_numpy()
                best[places] = told.field("best").to_numpy(zero_copy_only=False)
            of_pair, of_doc, times = (
                np.frombuffer(row[name].as_py(), "<i4").astype(np.int64) for name in ("of_pair", "of_doc", "times")
            )
            n_best, sums = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            np.add.at(n_best, of_doc, times * best[of_pair])
            np.add.at(sums, of_doc, times * totals[of_pair])
            yield pa.RecordBatch.from_arrays([
                row["ids"].values, *(row[name].values for name in _NUMBERS), pa.array(n_best), pa.array(sums),
                row["digests"].values,
            ], schema=_DONE)


def linked_documents(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", first: Load = byte_level,
    second: Load = sentence_pieces, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row.

    The count of an id pair is how many links of the corpus hold it; ``count_sum`` adds it over the links of the
    row, ``n_best`` counts the links whose pair has the highest count of its second id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    blocks = cut_lineage(rows.mapInArrow(_blocks(first, second, block_bytes), _BLOCKS_SPARK), "token-blocks", "zstd")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("count")
    )
    totals = cut_lineage(
        held.groupBy("pair").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("blocks"))
        .withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))), "pair-counts",
    )
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    known = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    met = lookup_join(held.drop("count"), known, ["pair"], counts=totals, count_col="blocks", spread=["block"])
    told = met.groupBy("block").agg(F.collect_list(F.struct("place", "total", "best")).alias("told"))
    # Blocks whose texts have no tokens have no pairs, and nothing is told of them.
    names = ["ids", *_NUMBERS, "digests", "pairs", "of_pair", "of_doc", "times", "told"]
    with_told = blocks.join(told, "block", "left").withColumn(
        "told", F.coalesce("told", F.array().cast("array<struct<place:int,total:bigint,best:boolean>>"))
    )
    return with_told.select(*names).mapInArrow(
        _score,
        "id long, " + ", ".join(f"{name} long" for name in _NUMBERS)
        + ", n_best long, count_sum long, groups_sha256 string",
    )

"""Removal of byte strings that occur more than once, with a difference cover as in blockwise suffix sorting.

A suffix is known here by its first ``length`` bytes (a window), as only equality to that depth counts. A difference cover
of period v has, for any two positions, an offset below v at which both are in the cover. So two equal windows
meet at a cover position of both, at which the same ``length - v + 1`` bytes stand, and the cover samples
(9 of 73 positions) are all that has to be compared at large:

1. Anchors. The smallest hash of the short strings in a window is found; a window whose smallest hash is at one
   place only cannot repeat. What is left are stretches of possible repeats.
2. Cover samples of the stretches get the rank (a 64-bit name) of the bytes behind them, and a second one (of 128 bits) of all
   windows that meet them. Samples with the same second rank are long ties: all their windows repeat, and are
   resolved here without a look at single suffixes. Samples without partner say that nothing repeats there. (Equal
   first ranks of different bytes only add windows to compare.)
3. Where samples tie at first and part within the windows, the suffixes around one sample of each kind are dealt into
   buckets by their ranks; each bucket is aggregated by one task, and a suffix repeats if its bucket has
   its rank twice.

No step holds more than one text block, or the stretches of one text, in memory; equal texts are folded first and keys with very many
rows are dealt over several tasks.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; strings that overlap
themselves count as repeated; copies of a text of at least ``length`` bytes are removed whole; repeated rows and null ids give
rows like any other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches, text_of
from venuesift.operators.lookup import lookup_join
from venuesift.session import cut_lineage, remove_tables

LENGTH = 200
#: Window starts that are worked on at once.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_ROWS = 1 << 16


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` is one of two of them.

    73 = 8 * 8 + 8 + 1 has a perfect cover of nine, the powers of two; for others small steps
    and large steps together do.
    """
    if period == 73:
        return sorted(pow(2, e, 73) for e in range(9))
    step = int(np.ceil(np.sqrt(period)))
    return sorted({*range(min(step, period)), *range(step, period, step), *[0] * (period > 0)})


def period_for(length: int) -> int:
    return 73 if length >= 2 * 73 else max(1, length // 2)


@lru_cache(maxsize=3)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, as many as a piece may have bytes."""
    def powers(of: int) -> np.ndarray:
        steps = np.full(BLOCK + (1 << 16), of, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return powers(base), powers(pow(base, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes; equal strings have equal hashes."""
    up, down = _powers(_BASE)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_digits()[0][data] * up[:len(data)], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each ``width`` values in a row, by bests of twice as many at each step."""
    reach = 1
    while 2 * reach <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    return best(values[:-(width - reach)], values[width - reach:]) if width > reach else values


def _gram(length: int) -> int:
    return max(1, 2 * length // 5)


def _blocks(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of the text with ``BLOCK`` windows each, and where they begin."""
    data = np.frombuffer(text, dtype=np.uint8)
    for start in range(0, len(text) - length + 1, BLOCK):
        yield start, data[start:start + BLOCK + length - 1]


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each window the smallest hash of its short strings."""
    gram = _gram(length)
    return _sliding(gram_hashes(data, gram), length - gram + 1, np.minimum)


def chosen_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The hashes that are the smallest of some window around them, place by place."""
    gram = _gram(length)
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    least = _sliding(hashes, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return hashes[hashes == _sliding(around, width, np.maximum)]


_ANCHORS = pa.schema([("hash", pa.int64()), ("text_id", pa.int64())])


def _anchors(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for text_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for _, data in _blocks(text, length):
                    found.append(chosen_hashes(data, length).view(np.int64))
                    owner.append(np.full(len(found[-1]), text_id, dtype=np.int64))
            if found:
                columns = [pa.array(np.concatenate(found)), pa.array(np.concatenate(owner))]
                whole = pa.RecordBatch.from_arrays(columns, schema=_ANCHORS)
                yield from (whole.slice(at, _ROWS) for at in range(0, whole.num_rows, _ROWS))

    return run


def runs_of(mask: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values, as rows of two."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2) - [0, 1]


_STRETCHES = pa.schema([("text_id", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])


def _stretches(length: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text_id, text, single in rows_of(batches):
            alone = np.sort(np.array(single or [], dtype=np.int64)).view(np.uint64)
            alone.sort()
            for start, data in _blocks(text, length):
                least = least_hashes(data, length)
                heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                values = least[heads]
                at = np.searchsorted(alone, values)
                free = np.concatenate([alone, [np.uint64(0)]])[at] == values if len(alone) else np.zeros(len(values), bool)
                free &= at < len(alone)
                open_ = np.repeat(~free, np.diff(np.concatenate([heads, [len(least)]])))
                for first, last in runs_of(open_):
                    yield text_id, start + int(first), data[first:last + length].tobytes()

    return lambda batches: batched(each(batches), _STRETCHES)


class Names:
    """128-bit names of any substrings of a piece: two polynomials over random numbers for the bytes, from prefix sums.

    Sums are modulo 2^64, where only strings of two thousand bytes and more can be made to agree in every base; the
    substrings named here are far shorter.
    """

    BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    def __init__(self, piece: bytes):
        self.data = np.frombuffer(piece, dtype=np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    def half(self, which: int, first: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """One half of the names of the bytes from ``first`` to ``end``; a different ``salt`` gives other names to equal bytes."""
        base = self.BASES[which]
        if which not in self.sums:
            self.sums[which] = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_digits()[which][self.data] * _powers(base)[0][:len(self.data)], out=self.sums[which][1:])
        hashes = (self.sums[which][end] - self.sums[which][first]) * _powers(base)[1][first]
        hashes ^= hashes >> np.uint64(32)
        salted = np.asarray(salt, dtype=np.uint64) * np.uint64(_BASE)
        return (hashes * np.uint64(0xBF58476D1CE4E5B9) + salted).view(np.int64)

    def of(self, first: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Names of the bytes from ``first`` to ``end``, in two halves."""
        return self.half(0, first, end, salt), self.half(1, first, end, salt)


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """A number of 64 bits for each byte, for each of the two polynomials."""
    chosen = np.random.default_rng(11).integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
    return chosen[0], chosen[1]


_SAMPLES = pa.schema([
    ("rank", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()),
    ("text_id", pa.int64()), ("start", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
])


@lru_cache(maxsize=4)
def _cover(period: int) -> np.ndarray:
    return np.array(difference_cover(period))


def cover_samples(piece: bytes, length: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cover positions of a stretch, with the first and last window that each one meets."""
    last = len(piece) - length
    places = np.add.outer(np.arange(0, last + period, period), _cover(period)).ravel()
    places = places[:np.searchsorted(places, last + period)]
    return places, np.maximum(places - period + 1, 0), np.minimum(places, last)


def _samples(length: int, period: int) -> Callable:
    depth = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text_id, start, piece in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                places, low, high = cover_samples(piece, length, period)
                names = Names(piece)
                rank = names.half(0, places, places + depth)
                # Where the sample stands among its windows belongs to the name, so that equal names mean equal windows.
                wide = names.of(low, high + length, (places - low) * (period + 1) + (high - low))
                same = [np.full(len(places), value, dtype=np.int64) for value in (text_id, start)]
                parts.append((rank, *wide, *same, low, high))
            if parts:
                columns = [pa.array(np.concatenate(column)) for column in zip(*parts, strict=True)]
                whole = pa.RecordBatch.from_arrays(columns, schema=_SAMPLES)
                yield from (whole.slice(at, _ROWS) for at in range(0, whole.num_rows, _ROWS))

    return run


def judged_samples(samples: DataFrame) -> DataFrame:
    """Samples with something to tell: ``ties`` (all windows repeat), ``speaks`` (its windows are compared one by one).

    Of the samples with the same wide name one speaks for all (or several, if their hashes are equal), and only where
    others with the same rank differ from them and have no tie. ``samples`` are made twice, which is cheaper than a table of them.
    """
    rank, wide = ["rank"], ["w1", "w2"]
    places = samples.withColumn("place", F.xxhash64("text_id", "start", "low"))
    kinds = cut_lineage(
        places.groupBy(*rank, *wide).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("speaker")), "sample-kinds"
    )
    by_rank = cut_lineage(kinds.groupBy(*rank).agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single")
    ).filter("all > 1"), "sample-ranks")
    # Where every kind has two samples or more, all windows are resolved already.
    compared = (F.col("kinds") > 1) & (F.col("single") > 0)
    told = lookup_join(kinds, by_rank, rank, counts=by_rank, count_col="kinds", spread=wide)
    verdicts = cut_lineage(
        told.select(*wide, "n", (F.col("n") > 1).alias("ties"), F.when(compared, F.col("speaker")).alias("speaker"))
        .filter("ties OR speaker IS NOT NULL"),
        "sample-verdicts",
    )
    remove_tables(kinds, by_rank)
    met = lookup_join(places.drop(*rank), verdicts.drop("n"), wide, counts=verdicts, spread=["text_id", "start", "low"])
    speaks = F.coalesce(F.col("place") == F.col("speaker"), F.lit(False))
    judged = cut_lineage(
        met.select("text_id", "start", "low", "high", "ties", speaks.alias("speaks")).filter("ties OR speaks"),
        "judged-samples",
    )
    remove_tables(verdicts)
    return judged


_FOUND = pa.schema([
    ("w1", pa.int64()), ("w2", pa.int64()), ("text_id", pa.int64()), ("from", pa.int64()), ("to", pa.int64()),
    ("open", pa.bool_()),
])


def _covered(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """True from each first to each last place."""
    steps = np.bincount(first, minlength=size + 1) - np.bincount(last + 1, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def _suffixes(length: int) -> Callable:
    """Spans that are resolved, and the windows that have to be compared, with their ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = batch.column("samples")
            ends = samples.offsets.to_numpy()
            low, high, ties, speaks = (samples.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ids, starts = (batch.column(name).to_numpy() for name in ("text_id", "start"))
            names, parts = ("w1", "w2", "text_id", "from", "to", "open"), []
            for row in range(batch.num_rows):
                own = slice(ends[row], ends[row + 1])
                piece = batch.column("piece")[row].as_py()
                size, tie, speak = len(piece) - length + 1, ties[own], speaks[own]
                tied = _covered(low[own][tie], high[own][tie], size)
                spans = runs_of(tied)
                asked = np.flatnonzero(_covered(low[own][speak], high[own][speak], size))
                ranks = Names(piece).of(asked, asked + length) if len(asked) else (asked, asked)
                # Spans first, without ranks; suffixes have one length and are written without their ends.
                parts.append((
                    len(spans), *(np.concatenate([np.zeros(len(spans), np.int64), rank]) for rank in ranks),
                    np.full(len(spans) + len(asked), ids[row]), starts[row] + np.concatenate([spans[:, 0], asked]),
                    starts[row] + np.concatenate([spans[:, 1], asked]) + length,
                    np.concatenate([np.zeros(len(spans), bool), ~tied[asked]]),
                ))
                if sum(len(part[1]) for part in parts) >= _ROWS or row + 1 == batch.num_rows:
                    nameless = np.concatenate([np.arange(len(part[1])) < part[0] for part in parts])
                    columns = dict(zip(names, (np.concatenate(column) for column in list(zip(*parts, strict=True))[1:]), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[name], mask={"w1": nameless, "w2": nameless, "to": ~nameless}.get(name)) for name in names],
                        schema=_FOUND,
                    )
                    parts = []

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``text_id, from, to``: bytes of ``texts`` (``text_id, data``, different texts) in repeated strings; spans may overlap."""
    small_batches(texts.sparkSession)
    period = period_for(length)
    long = texts.filter(F.octet_length("data") >= length)
    anchors = long.select("text_id", "data").mapInArrow(_anchors(length), "hash long, text_id long")
    alone = anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("text_id")).filter("n = 1")
    by_text = cut_lineage(alone.groupBy("text_id").agg(F.collect_list("hash").alias("single")), "single-anchors")
    stretches = cut_lineage(
        long.join(by_text, "text_id", "left").select("text_id", "data", "single")
        .mapInArrow(_stretches(length), "text_id long, start long, piece binary"),
        "stretches", "zstd",
    )
    remove_tables(by_text)
    judged = judged_samples(stretches.mapInArrow(
        _samples(length, period), "rank long, w1 long, w2 long, text_id long, start long, low long, high long"
    ))
    by_stretch = judged.groupBy("text_id", "start").agg(
        F.collect_list(F.struct("low", "high", "ties", "speaks")).alias("samples")
    )
    found = cut_lineage(
        stretches.join(by_stretch, ["text_id", "start"]).select("text_id", "start", "piece", "samples")
        .mapInArrow(_suffixes(length), "w1 long, w2 long, text_id long, from long, to long, open boolean"),
        "suffixes", "zstd",
    )
    remove_tables(stretches, judged)
    suffixes = found.filter("w1 IS NOT NULL")
    twice = cut_lineage(suffixes.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-ranks")
    more = lookup_join(suffixes.filter("open").select("w1", "w2", "text_id", "from"), twice.drop("n"), ["w1", "w2"], counts=twice, spread=["text_id", "from"])
    ends = (F.col("from") + length).alias("to")
    spans = found.filter("w1 IS NULL").select("text_id", "from", "to").unionByName(more.select("text_id", "from", ends))
    written = cut_lineage(spans, "repeated-spans")
    remove_tables(found, twice)
    return written


_CUT = pa.schema([
    ("text_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept", pa.binary()), ("kept_sha256", pa.string()),
])


def _cut(keep_bytes: bool) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text_id, text, repeated, spans in rows_of(batches):
            gone = [[0, len(text)]] if repeated else []
            for first, last in [] if repeated else sorted((s["from"], s["to"]) for s in spans or []):
                if gone and first <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], last)
                else:
                    gone.append([first, last])
            kept, at = [], 0
            for first, last in gone:
                kept.append(text[at:first])
                at = last
            left = b"".join([*kept, text[at:]])
            removed = len(text) - len(left)
            yield text_id, len(text), removed, len(gone), left if keep_bytes else None, sha256(left).hexdigest()

    return lambda batches: batched(each(batches), _CUT)


def remove_repeats(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, keep_bytes: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes, n_removed, n_spans, kept, kept_sha256``.

    ``kept`` holds the bytes that stay (null unless ``keep_bytes``); a cut may part a character.
    """
    whole = docs.select(text_of(docs, text_col).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = cut_lineage(
        whole.select(
            F.monotonically_increasing_id().alias("text_id"), F.encode("text", "utf-8").alias("data"),
            F.sha2("text", 256).alias("digest"), "copies",
        ), "texts", "zstd",
    )
    repeated = repeated_spans(texts, length)
    spans = repeated.groupBy("text_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    several = (F.col("copies") > 1) & (F.octet_length("data") >= length)
    cut = texts.join(spans, "text_id", "left").select("text_id", "data", several.alias("several"), "spans").mapInArrow(
        _cut(keep_bytes),
        "text_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )
    named = cut_lineage(texts.select("text_id", "digest", "copies").join(cut, "text_id").drop("text_id"), "cut-texts")
    remove_tables(texts, repeated)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.sha2(text_of(docs, text_col), 256).alias("digest"))
    each = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows"))
    met = lookup_join(each, named.drop("copies"), ["digest"], counts=named, count_col="copies", spread=["id"])
    return met.select(
        F.explode(F.array_repeat(F.struct("id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"), F.col("rows").cast("int"))).alias("r")
    ).select("r.*")

"""Phrases whose words keep together, from exact counts of all words and phrases that are frequent.

Words and phrases of up to four words are frequent from ``min_count`` occurrences on. They are found in two passes over the
documents:

1. All words and phrases are counted by 64-bit keys. A task counts a stretch of its words in arrays and sends the keys and
   their counts as bytes, one row for each range of keys; a range is summed up by one task, and there are as many ranges as the
   texts need. A frequent phrase has a frequent key.
2. The frequent keys set bits in a table that the tasks get, ``KEY_BITS`` bits for each key and of at most ``KNOWN_KEYS`` times
   as many. Words and phrases whose bit is set, and whose first and last words (all but one) have theirs set, are counted by
   language and text.

Keys and bits only decide what is counted by its text, so equal keys and shared bits add rows that the count drops, and never
change a result.

Defined results: a null text is empty, a null language is ``und``; texts without words add nothing; repeated
rows and null ids count like other rows; ties go to the larger count, then to the smaller phrase by its bytes; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches, text_of
from venuesift.operators.lookup import lookup_join
from venuesift.operators.ordering import rank_rows
from venuesift.session import cut_lineage, remove_tables

MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2000
#: Without effect: all documents are counted, and callers that name a sample get the same result.
SAMPLE_OF = 8
#: Words that a task counts at once.
STRETCH = 1 << 20
#: Bytes of text for each range of keys, and the most ranges as a power of two.
RANGE_BYTES, MOST_RANGES = 1 << 22, 16
#: Bits of the table for each frequent key, and keys that the table grows for (at 64 million it has 128 MB).
KEY_BITS, KNOWN_KEYS = 16, 64 << 20
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a batch of counts.
_ROWS = 1 << 15
#: Bits of a block of ``bitmap_construct_agg`` as a power of two.
_BLOCK_BITS = 15

_COUNTS = pa.schema([
    ("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("key", pa.int64()), ("f", pa.int64()),
])
_COUNTS_SPARK = "lang string, phrase string, words int, key long, f long"
_KEYS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of phrases from those of their first words and of their last word."""
    mixed = (first ^ (first >> np.uint64(29))) * _STEP + second
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class Known:
    """A table of bits, one of which is set by the first bits of each frequent key."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.shift = table, np.uint64(64 - bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        places = keys >> self.shift
        return (self.table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Stretch:
    """Words of one language in reading order, with a break after each piece."""

    def __init__(self, lang: str):
        self.lang, self.found = lang, []
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        # What is between two blanks in a row, and a break.
        self.ids[b""], self.ids[b"\n"] = 0, 1

    def add(self, text: bytes) -> None:
        marked = text.lower().translate(_BREAKS).replace(b"\n", b" \n ")
        self.found += map(self.ids.__getitem__, marked.split(b" "))
        self.found.append(1)

    def phrases(self, most_words: int, known: Known | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words the places where a phrase begins, their keys, and the words of all places.

        With ``known`` only phrases whose bit is set, and so are those of all their parts.
        """
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        singles = np.fromiter((xxhash.xxh64_intdigest(word, seed) for word in self.ids), np.uint64, len(self.ids))
        held = known.holds(singles) if known else np.ones(len(singles), dtype=bool)
        held[:2] = False
        places = np.array(self.found, dtype=np.int32)
        places = places[places > 0]
        good, keys = held[places], singles[places]
        for size in range(1, most_words + 1):
            if size > 1:
                # The phrase that begins here, of the one that begins here and the word behind it.
                good = good[:-1] & good[1:]
                at = np.flatnonzero(good)
                found = _joined(keys[at], singles[places[at + size - 1]])
                if known:
                    stays = known.holds(found)
                    good[at[~stays]] = False
                    at, found = at[stays], found[stays]
                keys = np.zeros(len(good), dtype=np.uint64)
                keys[at] = found
            at = np.flatnonzero(good)
            yield size, at, keys[at], places

    def counts(self, most_words: int, known: Known) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases that ``known`` holds, and of all words as a phrase of none."""
        words = [word.decode("utf-8", "surrogatepass") for word in self.ids]
        total = sum(1 for place in self.found if place > 1)
        if total:
            yield self._batch([""], 0, np.zeros(1, np.int64), np.array([total]))
        for size, at, keys, places in self.phrases(most_words, known):
            first, counts = _distinct(keys, [places[at + i] for i in range(size)])
            for k in range(0, len(first), _ROWS):
                part = slice(k, k + _ROWS)
                spelled = [[words[i] for i in places[at[first[part]] + n].tolist()] for n in range(size)]
                names = spelled[0] if size == 1 else list(map(" ".join, zip(*spelled, strict=True)))
                yield self._batch(names, size, keys[first[part]].view(np.int64), counts[part])

    def _batch(self, names: list[str], size: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([self.lang] * len(names), pa.string()), pa.array(names, pa.string()),
            pa.array(np.full(len(names), size, np.int32)), pa.array(keys), pa.array(counts, pa.int64()),
        ], schema=_COUNTS)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin in sorted ``keys``, and their lengths."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def _distinct(keys: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of places of each different row of ``words``, whose rows have these keys.

    Equal keys of different rows are seen by comparing all rows with the first of their key; then the rows themselves are
    sorted.
    """
    order = np.argsort(keys)
    starts, counts = _runs(keys[order])
    first = order[starts]
    if all((column[order] == np.repeat(column[first], counts)).all() for column in words):
        return first, counts
    _, first, counts = np.unique(np.stack(words, axis=1), axis=0, return_index=True, return_counts=True)
    return first, counts


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Stretch]]:
    """The texts of a task as stretches of each language, as many at once as ``STRETCH`` words take."""
    stretches: dict[str, Stretch] = {}
    held = 0
    for lang, text in rows_of(batches):
        stretch = stretches.setdefault(lang, Stretch(lang))
        before = len(stretch.found)
        stretch.add(text)
        held += len(stretch.found) - before
        if held >= STRETCH:
            yield list(stretches.values())
            stretches, held = {}, 0
    if stretches:
        yield list(stretches.values())


def _key_counts(most_words: int, bits: int) -> Callable:
    """Keys of all phrases and their counts, as bytes for each of ``1 << bits`` ranges of keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits if bits else 0)
        for stretches in _stretches(batches):
            keys = np.empty(most_words * sum(len(each.found) for each in stretches), dtype=np.uint64)
            end = 0
            for each in stretches:
                for _, _, found, _ in each.phrases(most_words):
                    keys[end:end + len(found)] = found
                    end += len(found)
            keys = keys[:end]
            keys.sort()
            starts, counts = _runs(keys)
            keys, counts = keys[starts], counts.astype(np.uint32)
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            rows = ((part, *(column[cuts[part]:cuts[part + 1]].tobytes() for column in (keys, counts)))
                    for part in np.flatnonzero(np.diff(cuts)).tolist())
            yield from batched(rows, _KEYS, 16)

    return run


def _summed(min_count: int) -> Callable:
    """The keys of a range that occur ``min_count`` times."""
    def run(range_: pa.Table) -> pa.Table:
        keys, counts = (
            np.concatenate([np.frombuffer(blob, kind) for blob in range_.column(name).to_pylist()])
            for name, kind in (("keys", np.uint64), ("counts", np.uint32))
        )
        order = np.argsort(keys)
        starts, _ = _runs(keys[order])
        sums = np.add.reduceat(counts[order], starts, dtype=np.int64)
        return pa.table({"key": keys[order[starts[sums >= min_count]]].view(np.int64)})

    return run


def _counts(most_words: int, shared) -> Callable:
    """``shared`` is a broadcast of a table of bits and the power of two of its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(*shared.value)
        for stretches in _stretches(batches):
            for each in stretches:
                yield from each.counts(most_words, known)

    return run


def key_table(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A table of bits for a written table of keys, and the power of two of its size."""
    room = KEY_BITS * min(keys.count(), KNOWN_KEYS)
    bits = max(_BLOCK_BITS, room.bit_length())
    place = F.shiftrightunsigned("key", 64 - bits) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("set")
    ).collect()  # 4 KB each, 128 MB at most
    table = np.zeros((1 << (bits - _BLOCK_BITS), 1 << (_BLOCK_BITS - 3)), dtype=np.uint8)
    for block, set_bits in blocks:
        table[block - 1] = np.frombuffer(set_bits, np.uint8)
    return table.ravel(), bits


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most_words: int = MOST_WORDS,
    sample_of: int = SAMPLE_OF,
) -> tuple[DataFrame, DataFrame]:
    """Phrases with their exact counts (``lang, phrase, words, key, f``), and the words of each language (``lang, n``)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = text_of(docs, text_col)
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.encode(text, "utf-8").alias("data"))
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = min(MOST_RANGES, (size // RANGE_BYTES).bit_length())
    ranges = rows.mapInArrow(_key_counts(most_words, bits), "part int, keys binary, counts binary")
    keys = cut_lineage(ranges.groupBy("part").applyInArrow(_summed(min_count), "key long"), "frequent-keys")
    shared = spark.sparkContext.broadcast(key_table(keys))
    counted = rows.mapInArrow(_counts(most_words, shared), _COUNTS_SPARK).groupBy("lang", "phrase", "words").agg(
        F.sum("f").alias("f"), F.min("key").alias("key")
    )
    exact = cut_lineage(counted.filter((F.col("words") == 0) | (F.col("f") >= min_count)), "phrase-counts")
    shared.destroy()
    remove_tables(keys)
    return exact.filter("words > 0"), exact.filter("words = 0").select("lang", F.col("f").alias("n"))


def _part(phrase: Column, first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most_words: int = MOST_WORDS,
    top: int = TOP, sample_of: int = SAMPLE_OF,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase scores floor(2,000,000 a / (l + r)) at its weakest cut into a part that occurs l times and one that occurs
    r times; phrases that mostly occur inside a longer one are left out.
    """
    return scored(*frequent_phrases(docs, text_col, lang_col, min_count, most_words, sample_of), top)


def scored(frequent: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Scores and ranks from all frequent phrases, single words among them, and the words of each language."""
    phrases = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    counts = frequent.select("lang", "phrase", "f")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "*", _part(F.col("phrase"), 1, F.col("k")).alias("left_part"),
        _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right_part"),
    )
    # Parts of a frequent phrase are frequent, so all of them are found.
    for side, name in (("left_part", "l"), ("right_part", "r")):
        table = counts.withColumnsRenamed({"phrase": side, "f": name})
        cuts = lookup_join(cuts, table, ["lang", side], spread=["phrase", "k"])

    def big(column: str) -> Column:
        return F.col(column).cast("decimal(20,0)")

    both = big("l") + big("r")
    score = F.floor(F.try_divide(big("a") * 2_000_000 - F.pmod(big("a") * 2_000_000, both), both)).cast("long")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inside = phrases.filter("words > 2").withColumn("size", F.explode(sizes)).withColumn(
        "first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1))
    ).select("lang", _part(F.col("phrase"), F.col("first"), F.col("size")).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    swallowed = F.coalesce(big("longer") * 100 >= big("a") * 80, F.lit(False))
    kept = weakest.join(longest, ["lang", "phrase"], "left").filter(~swallowed)
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = rank_rows(kept, ["lang"], order).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )

"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is cut into segments so few that two fingerprints within the allowed distance are
within one bit of each other in some segment (64 bits, distance 3: two halves). Each different
fingerprint is put into a table once per segment; for every segment the ball of radius one around
its value is enumerated and looked up there, and the complete distance of what is found is checked.
A ball only lists the values with one bit more, so that a pair is found from one side.

Linked fingerprints become components by alternating star contraction, whose edges are written
to the shared folder after each round. All of it works on different fingerprints: copies are
folded before, and only rows with an id and a fingerprint are joined to the result.

Defined results: a null text is empty; a text without words has fingerprint zero; one with fewer words
than a shingle is hashed whole; a null id is never the name of a component unless no member
has an id; repeated rows give repeated rows. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches, text_of
from venuesift.llm.graph import components
from venuesift.operators.lookup import hashable_columns, lookup_join
from venuesift.session import cut_lineage

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
MAX_DISTANCE = 3
#: A ball of radius three in 32 bits has 5,489 members; beyond that it is the shorter way.
DENSE_ROWS = 5_489
_HASHES_AT_ONCE = 1 << 14


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is set in over half the hashes of the word shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    total = max(1, len(found) - words + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, _HASHES_AT_ONCE):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(found[i:i + words]), seed)
             for i in range(start, min(start + _HASHES_AT_ONCE, total))),
            dtype=">u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


_SCHEMA = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, digest, fp`` of each row; ``fp`` holds the 64 bits as a signed number, ``digest``
    a hash of the unchanged text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for doc_id, digest, text in rows_of(batches):
                bits = fingerprint(text)
                yield doc_id, digest, bits - (1 << BITS) if bits >> (BITS - 1) else bits

        return batched(each(), _SCHEMA, 4096)

    small_batches(docs.sparkSession)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "id long, digest long, fp long")


def _segment(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at * width).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints at most ``max_distance`` bits apart.

    ``fps`` holds each fingerprint once, as ``fp``. A segment value that very many fingerprints
    share is not looked up, as that would meet all its pairs: there the ball is enumerated in the other
    bits too, and whole fingerprints are looked up. Both ways find the same pairs.
    """
    segments = (max_distance + 2) // 2
    width = BITS // segments
    if width * segments != BITS:
        raise ValueError("segments must share the bits equally")
    fp = F.col("fp")
    parts = F.array(*[
        F.struct(F.lit(i).alias("part"), _segment(fp, i, width).alias("value")) for i in range(segments)
    ])
    table = fps.select("fp", F.explode(parts).alias("at")).select(
        F.col("at.part").alias("part"), F.col("at.value").alias("value"), F.col("fp").alias("b")
    )
    ball = (
        table.withColumnRenamed("b", "a")
        .withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))))
        .withColumn("flip", F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(_bit(F.greatest("bit", F.lit(0)))))
        .filter(F.col("value").bitwiseAND(F.col("flip")) == 0)
        .select("part", (F.col("value") + F.col("flip")).alias("value"), "a", "bit")
    )
    keys = ["part", "value"]
    dense = cut_lineage(
        table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense_rows).select(*keys), "dense"
    )
    fp_a, fp_b = F.col("a"), F.col("b")
    if dense.isEmpty():
        found = ball.join(table, keys).select("a", "b", "bit")
    else:
        sparse = ball.join(dense, keys, "left_anti").join(table, keys).select("a", "b", "bit")
        balls = _full_balls(ball.join(dense, keys, "left_semi"), width, segments, max_distance)
        found = sparse.unionByName(balls.join(fps.select(fp.alias("b")), "b").select("a", "b", "bit"))
    near = F.bit_count(fp_a.bitwiseXOR(fp_b)) <= max_distance
    once = (F.col("bit") >= 0) | (fp_a < fp_b)
    return found.filter(once & (fp_a != fp_b) & near).select("a", "b")


def _full_balls(entries: DataFrame, width: int, segments: int, max_distance: int) -> DataFrame:
    """For entries ``part, value, a, bit`` all fingerprints ``b`` with that value in that segment and
    few enough other bits changed.

    The changed bits are listed in rising order; the number of all bits stands for none.
    """
    others, at, mask, changed = BITS - width, F.lit(-1), F.lit(0).cast("long"), F.lit(0)
    rows = entries
    for step in range(max_distance):
        name = f"p{step}"
        rows = rows.withColumn(name, F.explode(F.sequence(F.least(at + 1, F.lit(others)), F.lit(others))))
        at = F.col(name)
        # Positions above the segment are behind it in the word.
        place = F.when(at >= F.col("part") * width, at + width).otherwise(at)
        mask = mask.bitwiseOR(F.when(at < others, _bit(place)).otherwise(F.lit(0).cast("long")))
        changed = changed + (at < others).cast("int")
    allowed = F.lit(max_distance) - (F.col("bit") >= 0).cast("int")
    own = F.lit((1 << width) - 1).cast("long")
    shift = F.col("part") * width
    cleared = F.col("a").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", own, shift)))
    moved = cleared.bitwiseOR(F.call_function("shiftleft", F.col("value").cast("long"), shift))
    return rows.filter(changed <= allowed).select("a", "bit", moved.bitwiseXOR(mask).alias("b"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, digest, fp, component, stays`` of each row.

    ``component`` is the smallest id of the component; ``stays`` marks the row (or the equal
    rows) with that id and, among these, the smallest digest.
    """
    rows = cut_lineage(fingerprints(docs, text_col, id_col), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    fps = cut_lineage(rows.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "different-fingerprints")
    labels = components(links(fps.select("fp")))
    named = cut_lineage(fps.join(labels, fps["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    ), "named-fingerprints")
    smallest = cut_lineage(
        named.groupBy("label").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")), "component-firsts"
    )
    # One component may hold most fingerprints, and one fingerprint most rows.
    by_fp = lookup_join(named.drop("first"), smallest.drop("n"), ["label"], counts=smallest, spread=["fp"]).drop("label")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    return lookup_join(rows, by_fp, ["fp"], counts=fps, spread=["id", "digest"]).select(
        "id", "digest", "fp", F.col("first.id").alias("component"), stays.alias("stays")
    )


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component, with its own columns.

    Rows are told apart by id and text; of equal ones the first stays.
    """
    def key(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("none")).alias("id_key")

    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), key(docs[id_col]),
        F.xxhash64(text_of(docs, text_col)).alias("digest"),
    )
    repeats = Window.partitionBy("id_key", "digest").orderBy(F.xxhash64(*[F.col("row")[c] for c in hashable_columns(docs)]))
    once = rows.withColumn("nth", F.row_number().over(repeats)).filter(F.col("nth") == 1)
    gone = near_groups(docs, text_col, id_col).filter(~F.col("stays")).select(key(F.col("id")), "digest")
    return once.join(gone, ["id_key", "digest"], "left_anti").select("row.*")

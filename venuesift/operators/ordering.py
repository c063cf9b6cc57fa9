"""Limits and ranks that stay spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuesift.session import cut_lineage

#: Blocks that are counted at once, and rows of the last block that are sorted.
_BLOCKS, _LAST_ROWS = 1 << 16, 1 << 17


def limit_records(df: DataFrame, n: int, seq_col: str = "seq") -> DataFrame:
    """The first ``n`` rows in input order; ``seq_col`` must be unique.

    A plain top-n would send up to ``n`` whole rows of every task to one task. Here the range of
    sequence numbers is cut into at most 65,536 blocks, whose counts find the block with the
    boundary; that block is cut again until few rows are left in it. Earlier blocks pass a filter where
    they are, and only rows of the last block are sorted.
    """
    if n < 0:
        raise ValueError("limit must not be negative")
    if n == 0:
        return df.limit(0)

    seq = F.col(seq_col)
    low, high, inside = df.agg(F.min(seq), F.max(seq), F.count(seq)).first()
    if inside <= n:
        return df
    before = 0
    while inside > _LAST_ROWS and low < high:
        shift = max(0, (high - low).bit_length() - _BLOCKS.bit_length() + 2)
        counts = (
            df.filter(seq.between(low, high)).groupBy(F.shiftright(seq, shift).alias("block"))
            .agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65,536 pairs of numbers
        )
        for block, inside in sorted(map(tuple, counts)):
            if before + inside >= n:
                low, high = max(low, block << shift), min(high, ((block + 1) << shift) - 1)
                break
            before += inside
    head = df.filter(seq < low)
    tail = df.filter(seq.between(low, high)).orderBy(seq).limit(n - before)
    return head.unionByName(tail)


def rank_rows(
    df: DataFrame, group: list[str], order: list[str] | list[Column], out: str = "rank"
) -> DataFrame:
    """Number the rows of each group from 1 by ``order``, which must be a total order.

    A window would put a whole group into one task. Here one range-partitioned sort by
    group and order splits a large group over many tasks; the sorted rows are
    written once, and the rank is the place in the own partition plus the rows of the
    group in earlier partitions.
    """
    placed = cut_lineage(
        df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_part", F.shiftright(F.col("_at"), 33))
    runs = placed.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start")
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        placed.join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_at") - F.col("_start") + F.col("_before") + 1)
        .drop("_at", "_part", "_start", "_before")
    )

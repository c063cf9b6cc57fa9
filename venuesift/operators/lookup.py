"""A join that looks keys up in a table with one row for each key, whatever the skew of the keys.

Adaptive execution splits a large partition only where both sides of a join come straight from
shuffles. The table of a lookup is mostly an aggregate by the same key, and then one key is one task. Here
the keys that hold more than a task's share of all rows are found by counting. Their rows are dealt
into several parts for each share they hold, and only their rows of the table are repeated for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from venuesift.session import cut_lineage

#: Keys with fewer rows are never dealt into parts.
LEAST_ROWS = 64
#: Parts for each share of a hot key: many small parts spread more evenly than few large ones.
FINENESS = 8
#: No key is dealt into more parts.
MOST_PARTS = 1 << 16
_COUNT, _PARTS, _PART = "_lookup_rows", "_lookup_parts", "_lookup_part"


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(field.dataType) for field in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def hashable_columns(df: DataFrame) -> list[str]:
    """Columns Spark can hash: all but those with maps or variants in them."""
    return [field.name for field in df.schema if _hashable(field.dataType)]


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, total: int | None = None) -> DataFrame | None:
    """Keys with more than a task's share of the rows, with the number of their parts; None if there are none.

    ``counts`` has one row for each key and is read twice, so it should be a written table; ``total`` are all rows, where
    it leaves keys out. At most as many keys as there are shuffle partitions can pass, so the result is small enough to be broadcast.
    """
    shares = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted, most = counts.agg(F.sum(count_col), F.max(count_col)).first()
    total = counted if total is None else total
    share = max(LEAST_ROWS, (total or 0) / shares)
    if not counted or most <= share:
        return None
    parts = F.least(F.ceil(F.col(count_col) * FINENESS / F.lit(float(share))), F.lit(MOST_PARTS)).cast("int")
    return counts.filter(F.col(count_col) > share).select(*keys, parts.alias(_PARTS))


def _counted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """A written table of the rows of each key that may be hot, and the number of all rows."""
    seen = Observation()
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(_COUNT))
    many = cut_lineage(each.observe(seen, F.sum(_COUNT).alias("total")).filter(F.col(_COUNT) >= LEAST_ROWS), "key-counts")
    return many, seen.get["total"] or 0


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner",
    counts: DataFrame | None = None, count_col: str = "n", spread: list[str] | None = None,
) -> DataFrame:
    """``rows`` joined to ``table``, which has each of ``keys`` at most once.

    ``how``: inner, left, left_semi or left_anti. ``counts`` gives the rows of each key in ``count_col`` where the
    caller knows them; else they are counted. Rows of a hot key are dealt by a hash of the columns
    ``spread`` (all that can be hashed, if not given), so a lost task deals them the same way again; rows that
    agree in all of these stay together. Null keys meet nothing, as in any join.
    """
    total = None
    if counts is None:
        (counts, total), count_col = _counted(rows, keys), _COUNT
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    hot = hot_keys(counts, keys, count_col, total)
    if hot is None:
        return rows.join(table, keys, how)
    hot = hot.filter(known)
    named = spread or hashable_columns(rows)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(_PART, _part_of(F.col(_PARTS), named)).drop(_PARTS)
    repeated = table.join(F.broadcast(hot), keys, "left").withColumn(
        _PART, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_PARTS), F.lit(1)) - 1))
    ).drop(_PARTS)
    met = dealt.join(repeated, [*keys, _PART], how).drop(_PART)
    left = [*keys, *[c for c in rows.columns if c not in keys]]
    if how in ("left_semi", "left_anti"):
        return met.select(*left)
    return met.select(*left, *[c for c in table.columns if c not in keys])


def _part_of(parts: Column, spread: list[str]) -> Column:
    return F.when(parts.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), parts.cast("long")).cast("int"))

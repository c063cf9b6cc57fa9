from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from venuesift.operators import lookup
from venuesift.operators.lookup import hot_keys, lookup_join
from venuesift.session import session_values


def skewed(spark, n=4000):
    """Half of the rows have key 1; nulls and keys without an entry are there too."""
    key = F.when(F.col("id") % 2 == 0, F.lit(1)).when(F.col("id") % 101 == 1, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(n).select(key.cast("long").alias("k"), F.col("id").alias("v"))


def entries(spark):
    return spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_a_plain_join(spark, how):
    rows, table = skewed(spark), entries(spark)
    got, plain = lookup_join(rows, table, ["k"], how), rows.join(table, "k", how)
    assert got.columns == plain.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_half_of_the_rows_on_one_key_leave_no_large_task(spark):
    with session_values(spark, {
        "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }):
        sizes = [
            r["n"] for r in lookup_join(skewed(spark, 64_000), entries(spark), ["k"])
            .groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
        ]
        plain = [
            r["n"] for r in skewed(spark, 64_000).join(entries(spark), "k")
            .groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
        ]
    assert max(plain) >= 32_000
    assert len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]


def test_hot_keys_are_fewer_than_the_shares(spark):
    counts = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 3, 50_000).otherwise(70).alias("n"))
    found = {r["k"]: r["_lookup_parts"] for r in hot_keys(counts, ["k"], "n").collect()}
    assert set(found) == {0, 1, 2} and set(found.values()) == {15}
    assert hot_keys(counts.filter("k > 5"), ["k"], "n") is None


def test_rows_with_maps_and_empty_tables(spark):
    rows = skewed(spark).withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert lookup_join(rows, entries(spark), ["k"]).count() == skewed(spark).join(entries(spark), "k").count()
    assert lookup_join(rows.limit(0), entries(spark), ["k"]).count() == 0
    assert lookup_join(rows, entries(spark).limit(0), ["k"], "left").count() == 4000


def test_known_counts_are_taken(spark, monkeypatch):
    monkeypatch.setattr(lookup, "LEAST_ROWS", 1)
    counts = spark.createDataFrame([(1, 2000), (2, 5)], "k long, n long")
    got = lookup_join(skewed(spark), entries(spark), ["k"], counts=counts)
    assert got.count() == skewed(spark).join(entries(spark), "k").count()

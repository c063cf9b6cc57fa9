from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helpers import ODD, documents, sorted_rows
from pyspark.sql import functions as F

from venuesift.llm import mixing, topk

VECTORS = "vec_id long, embedding array<float>, label int, id string, vector string, query string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], VECTORS)


def brute(rows, divisor, k, scale=256):
    """Exact integers for every pair of usable rows."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for query_id, q in {(i, tuple(v)) for i, v in kept if i % divisor == 0}:
        found = sorted(
            (-sum(a * b for a, b in zip(q, v)), i) for i, v in kept if i != query_id and len(v) == len(q)
        )[:k]
        out += [(query_id, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def search(spark, rows, divisor=5, k=5):
    vectors = topk.usable_vectors(table_of(spark, rows))
    return sorted(map(tuple, topk.search(vectors.filter(F.col("id") % divisor == 0), vectors, k, 256).collect()))


@pytest.mark.parametrize("dims", [1, 3, 24, 64])
def test_search_as_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    centers = rng.normal(size=(6, dims))
    rows = [(i, (centers[i % 6] + rng.normal(size=dims) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    assert search(spark, rows) == brute(rows, 5, 5)


def test_search_with_odd_vectors(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(60)]  # ties everywhere
    rows += [(100, None), (101, []), (105, []), (102, [None, 1.0, 2.0]), (103, [float("nan"), 1.0, 0.0]),
             (104, [float("inf"), 1.0, 0.0]), (None, same), (110, [1.0]), (111, [2.0]), (7, same), (7, same)]
    assert search(spark, rows) == brute(rows, 5, 5)


def test_repeated_query_counts_once_and_fewer_than_k(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.25, 1.0])]
    assert search(spark, rows) == [(0, 1, 1, 32768), (0, 2, 2, 16384)]


def test_search_of_huge_components_is_exact(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [3e38, 1.0])]
    got = search(spark, rows)
    x = 2_560_000_000
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 2, x * x + 256 * 512), (0, 3, 1, x * x + 65536)]


def test_search_of_empty_table(spark):
    assert search(spark, []) == []


def test_statistics_bound_the_product():
    rng = np.random.default_rng(1)
    a, b = np.floor(256 * rng.normal(size=(50, 40))), np.floor(256 * rng.normal(size=(60, 40)))
    product, bounds = a @ b.T, []
    for segments in (1, 2, 5, 40):
        bound = topk.segment_statistics(a, segments) @ topk.segment_statistics(b, segments).T
        assert (bound >= product - 1e-6).all()
        bounds.append(bound.mean())
    assert bounds == sorted(bounds, reverse=True)


def test_targets_stop_at_the_limit_and_spread_the_rest(spark):
    sizes = spark.createDataFrame([("a", 0, 10), ("b", 1, 1000), ("c", 2, 300)], "source string, place long, words long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20.0  # its share of 1965 by weight 3 is far above
    assert got["c"] == 600.0
    assert got["b"] == pytest.approx(1965 - 620)


def test_mix_of_odd_rows(spark):
    rows = [(*row, source) for row in ODD for source in ("a", "b", None)] + [(50, "", "empty")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.copies <= 2 and 0 <= r.target <= 2 * r.words
        assert r.words > 0 or r.copies == 0
    assert {r.source for r in got} == {"a", "b", None, "empty"}


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 400)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(1500)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).select("id", "source", "size", "words", "target", "copies")
    assert sorted_rows(got) == sorted_rows(mixing.mix(docs.repartition(7)).select(*got.columns))
    sums = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("t"))
    for r in sums.collect():
        assert abs(r.taken - r.t) <= 400, r
    total = sum(len(t.split()) for _, t, _ in rows)
    assert sum(r.t for r in sums.collect()) == pytest.approx(1.5 * total)


def test_copies_are_boundaries_crossed(spark):
    """Against the definition with exact fractions."""
    rows = [(i, "w " * (i % 7 + 1), "s") for i in range(200)]
    got = sorted(mixing.mix(documents(spark, rows), budget=0.7).collect(), key=lambda r: (r.size, r.id))
    unit = 1 << 30
    step = math.floor(got[0].target / got[0].words * unit)
    offset = spark.range(1).select(mixing._offset(mixing.SEED, F.lit("s"))).first()[0]
    for i, r in enumerate(got):
        assert r.copies == ((i + 1) * step + offset) // unit - (i * step + offset) // unit


def test_mixed_rows_carry_their_columns(spark):
    docs = documents(spark, [(i, "a b c", "s") for i in range(40)] + [(99, None, None)])
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_rows(documents(spark, [])).count() == 0


def test_bounds_rule_pairs_out_on_the_table_of_the_query(spark):
    """With the k-th scores of a sample as first thresholds, the segment bounds leave well under all pairs."""
    vectors = topk.usable_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
    matrix = np.floor(256 * np.array([row["vector"] for row in vectors]))
    asked, sample = matrix[::50], matrix[::topk.SAMPLE_OF]
    floors = np.sort(asked @ sample.T, axis=1)[:, -6]  # the sixth: a query may be in the sample itself
    levels = [[topk.segment_statistics(m, s) for s in topk.RESOLUTIONS] for m in (asked, matrix)]
    pairs = topk.surviving_pairs(np.ones((len(asked), len(matrix)), bool), *levels, floors[:, None] - 1e-3)
    share = len(pairs[0]) / (len(asked) * len(matrix))
    assert share < 0.75
    scores = asked @ matrix.T
    kept = np.zeros(scores.shape, bool)
    kept[pairs] = True
    assert kept[scores >= floors[:, None]].all()

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from helpers import CLASHING, ODD, documents, sorted_rows
from pyspark.sql import functions as F

from venuesift.llm import exact, simhash
from venuesift.llm.graph import components
from venuesift.session import session_values


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, free = (max(known) if known else None), True
        for doc_id in ids:
            kept = free and doc_id == keep
            free = free and not kept
            out.append((doc_id, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def by_key(rows):
    return sorted(rows, key=str)


def test_exact_groups_of_odd_rows(spark):
    got = exact.exact_groups(documents(spark, ODD)).select("id", "keep", "n", "kept", "digest")
    assert by_key(map(tuple, got.collect())) == by_key(brute_exact(ODD))


def test_exact_repeats_beyond_one_step(spark):
    rows = spark.range(25_003).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = exact.exact_groups(rows)
    assert (got.count(), got.filter("kept").count()) == (25_003, 1)
    assert exact.drop_exact(rows).count() == 1


def test_drop_exact_keeps_rows_and_columns(spark):
    docs = documents(spark, ODD)
    left = exact.drop_exact(docs)
    assert left.columns == docs.columns
    assert sorted_rows(left.select("doc_id", "text")) == sorted_rows(spark.createDataFrame(
        [(9, "one two three four"), (2, ""), (3, " \n\t"), (7, "One two three four"), (8, "ü € 𝄞 x"), ODD[-1]],
        "doc_id long, text string",
    ))


def test_exact_empty_table(spark):
    docs = documents(spark, [])
    assert exact.exact_groups(docs).count() == 0
    assert exact.drop_exact(docs).columns == docs.columns


def test_exact_runs_no_python(spark):
    plan = exact.exact_groups(documents(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_fingerprint(text):
    words = [w for w in "".join(
        " " if c in " \t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or ""
    ).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """(doc_id, fingerprint, smallest id reachable) by flooding over all pairs."""
    prints = [brute_fingerprint(text) for _, text in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[i] < label[j]:
                    label[j] = label[i]
                    changed = True
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids) if ids else None))
    return out


def near_copies(seed, families=6, members=12):
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for _ in range(families):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(members):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            doc_id += rng.randrange(1, 5)
            rows.append((doc_id, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_groups_as_brute_force(spark, seed):
    rows = near_copies(seed) + [r for r in ODD if r[0] not in (4,)]
    got = simhash.near_groups(documents(spark, rows)).select(
        "id", simhash.fingerprint_hex(F.col("fp")), "component"
    )
    assert by_key(map(tuple, got.collect())) == by_key(brute_groups(rows))


@pytest.mark.parametrize("dense_rows", [5_489, 12, 0])
def test_links_find_every_pair_within_distance(spark, dense_rows):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for flips in (1, 2, 3, 3, 4, 5):
            prints.add(b ^ sum(1 << bit for bit in rng.sample(range(64), flips)))
    for half in (0, 32):  # values that many share, the ends of the words included
        prints |= {base[0] ^ (rng.getrandbits(4) << half) ^ (rng.getrandbits(2) << half + 30) for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), dense_rows=dense_rows).collect()
    pairs = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in got}
    assert pairs == {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3}


def test_fingerprint_of_long_text_goes_through_in_parts():
    words = [f"w{i % 977}" for i in range(40_000)]
    assert simhash.fingerprint(" ".join(words)) == brute_fingerprint(" ".join(words))


def test_drop_near_keeps_one_of_each_component(spark):
    rows = near_copies(3) + [(i if i is None else i + 10_000, text) for i, text in ODD]
    docs = documents(spark, rows)
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns
    groups = simhash.near_groups(docs)
    assert left.count() == groups.select("component", F.col("component").isNull()).distinct().count()
    assert simhash.drop_near(documents(spark, [])).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    other = " ".join(f"q{i}" for i in range(50))
    docs = documents(spark, [(1, "a b c d e"), (2, "a b c d e"), (2, other)])
    assert sorted_rows(simhash.drop_near(docs).select("doc_id", "text")) == [(1, "a b c d e"), (2, other)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)]
    edges += [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(25)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.label) for r in got.collect()} == {(x, root(x)) for x in parent}
    assert got.count() == len(parent)


def test_clashing_names_are_really_there():
    assert {"id", "row", "digest", "fp"} <= set(CLASHING)


def test_stages_take_map_columns(spark):
    """Rows are told apart by id and text; columns that cannot be hashed do not matter."""
    docs = documents(spark, ODD).withColumn("extra", F.create_map(F.lit("a"), F.col("text")))
    assert exact.drop_exact(docs).count() == exact.drop_exact(documents(spark, ODD)).count()
    assert simhash.drop_near(docs).columns == docs.columns


def test_one_text_in_half_of_the_rows(spark):
    """The ids of one text are dealt over the tasks of the lookup."""
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text")
    )
    with session_values(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        sizes = [r["n"] for r in exact.exact_groups(rows).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert exact.exact_groups(rows).filter("n = 3000 AND keep = 5998").count() == 3000
    assert simhash.near_groups(rows.limit(2000)).count() == 2000

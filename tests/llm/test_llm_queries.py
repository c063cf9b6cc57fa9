"""The registered queries: against their SQL, or against plain Python where there is none."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from test_llm_alignment import TEXTS
from test_llm_alignment import plain as plain_alignment
from test_llm_dedup import brute_groups
from test_llm_texts import brute_spans
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from check import compare, connect
from venuesift.llm import mixing, quality, secrets
from venuesift.llm.registry import ORACLES, QUERIES, table

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in table(spark, SF_DIR, "documents").collect()]


def test_queries_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries())
    assert len(QUERIES) == 13 and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, name):
    problems, rows, _ = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert not problems and rows > 0


def check_pieces(rows, expected):
    """``expected``: how often each (doc_id, ids) must come out of the windows."""
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for parts in windows.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        filled = sum(r.length for r in parts)
        assert filled == parts[0].sequence_length <= 1024
        assert parts[0].padded_length == (filled if filled & (filled - 1) == 0 else 1024)
    ids = dict(expected)
    copies = Counter(doc_id for doc_id, _ in expected)
    assert set(docs) == set(ids)
    for doc_id, parts in docs.items():
        whole = np.array(ids[doc_id], dtype="<u4")
        covered = Counter()
        for r in parts:
            assert r.doc_tokens == len(whole)
            assert zlib.crc32(whole[r.start:r.start + r.length].tobytes()) == r.ids_crc32
            covered.update(range(r.start, r.start + r.length))
        assert covered == Counter({i: copies[doc_id] for i in range(len(whole))})
    used, padded = sum(r.length for r in rows), sum(parts[0].padded_length for parts in windows.values())
    tasks = len({r.sequence_id >> 33 for r in rows})
    assert padded - used < 1024 * tasks


@lru_cache(maxsize=1)
def vocabulary():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tokens(text):
    """Ids of the unmodified tokenizer, and the end."""
    return [*vocabulary().encode(text or "", add_special_tokens=False).ids, 0]


def test_op3(spark, docs):
    check_pieces(QUERIES["op3_pack_documents"](spark, SF_DIR).collect(), [(i, tokens(t)) for i, t, _ in docs])


def test_op5(spark, docs):
    rows = QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rows) == table(spark, "/root/testdata/sf0.01", "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def plain_trees(rows, labels, rounds):
    """Cyclic boosting of single features, then of pairs, with sums over rows in loops."""
    rate, least, l2 = quality.RATE, quality._MIN_ROWS, quality._L2
    n = len(labels)
    share = (sum(labels) + 1) / (n + 2)
    total = [math.log(share / (1 - share))] * n

    def sums(members):
        grad = weight = 0.0
        for i in members:
            p = 1 / (1 + math.exp(-total[i]))
            grad, weight = grad + labels[i] - p, weight + p * (1 - p)
        return grad, weight

    def gain(members):
        grad, weight = sums(members)
        return grad * grad / (weight + l2)

    def place(value, cuts):
        return sum(cut <= value for cut in cuts)

    cuts = [quality._cuts(rows[:, f], quality.BINS) for f in range(rows.shape[1])]
    for _ in range(rounds):
        for f in range(rows.shape[1]):
            bins = [place(value, cuts[f]) for value in rows[:, f]]
            leaves = [(0, len(cuts[f]) + 1)]
            for _ in range(quality.LEAVES - 1):
                best = (1e-9, None, None)
                for low, high in leaves:
                    for at in range(low + 1, high):
                        left = [i for i in range(n) if low <= bins[i] < at]
                        right = [i for i in range(n) if at <= bins[i] < high]
                        if len(left) >= least and len(right) >= least:
                            best = max(best, (gain(left) + gain(right) - gain(left + right), (low, high), at), key=lambda b: b[0])
                if best[1] is None:
                    break
                leaves.remove(best[1])
                leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
            steps = {}
            for low, high in leaves:
                grad, weight = sums([i for i in range(n) if low <= bins[i] < high])
                steps[low, high] = rate * grad / (weight + l2)
            for i in range(n):
                total[i] += next(step for (low, high), step in steps.items() if low <= bins[i] < high)
    return [1 / (1 + math.exp(-value)) for value in total]


def test_op5_boosts_as_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 2)
    chance = np.random.default_rng(3)
    rows = np.round(chance.normal(size=(160, 4)), 1)
    labels = (rows[:, 0] + 0.5 * rows[:, 1] > 0).astype(float)
    model = quality.fit(rows, labels)
    assert np.allclose(model.score(rows), plain_trees(rows, labels, 2), atol=1e-9)


def test_op12(spark, tmp_path):
    """The registered query, over a table of its own."""
    rows = [*TEXTS, (30, None), (31, ""), (32, "mixed ▁ sign"), (None, "no id"), (1, "The cat sat on the mat, twice.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == plain_alignment(rows)


def test_op7(spark, docs):
    got = sorted(map(tuple, QUERIES["op7_simhash"](spark, SF_DIR).collect()))
    assert got == sorted(brute_groups([(i, t) for i, t, _ in docs]))


def test_op9(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op9_secret_scan"](spark, SF_DIR).collect()}
    assert set(got) == {i for i, *_ in docs}
    for doc_id, text, _ in docs:
        base = brute_spans(text or "")
        row = got[doc_id]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[2] == k for s in base) for k in secrets.KINDS[:3]]
        assert row.spans == secrets.written(secrets.find_secrets(text or ""))


def brute_targets(sizes):
    """Shares by weight, in exact fractions, the excess spread again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def brute_mix(spark, docs):
    """Copies of each document by the crossings of its source's running sum."""
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len((text or "").encode().split())
    targets, copies = brute_targets(sizes), Counter()
    unit = 1 << 30
    for source, words in sizes.items():
        own = sorted((len((t or "").encode().split()), i) for i, t, s in docs if s == source)
        step = math.floor(float(targets[source]) / words * unit) if words else 0
        offset = spark.range(1).select(mixing._offset(mixing.SEED, mixing.F.lit(source))).first()[0]
        for n, (_, doc_id) in enumerate(own):
            copies[doc_id] += ((n + 1) * step + offset) // unit - (n * step + offset) // unit
    return copies


def test_pipeline_as_a_plain_version(spark, docs):
    model = quality.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    scores = model.score(np.array([quality.features(t or "") for _, t, _ in docs]))
    kept = [d for d, score in zip(docs, scores, strict=True) if score >= quality.THRESHOLD]
    largest = {}
    for doc in kept:
        largest[doc[1] or ""] = max(largest.get(doc[1] or "", doc), doc, key=lambda d: d[0])
    kept = list(largest.values())
    groups = brute_groups([(i, t) for i, t, _ in kept])
    kept = [doc for doc, (doc_id, _, component) in zip(kept, groups, strict=True) if doc_id == component]
    copies = brute_mix(spark, kept)
    expected = [(i, tokens(t)) for i, t, _ in kept for _ in range(copies[i])]
    assert len(kept) < len(docs) and len(expected) > len(kept)
    check_pieces(corpus_pipeline.run(spark, SF_DIR).collect(), expected)


def test_stages_keep_the_columns(spark):
    frame = table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF_DIR).columns == frame.columns, name
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "mix sources", "pack"]


def test_stages_of_nothing(spark):
    frame = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF_DIR).count() == 0

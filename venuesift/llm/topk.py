"""Exact top-k search by inner product with multi-resolution segment statistics.

At each resolution a vector is cut into segments and known by the mean and the deviation of each. For
two vectors the squared distance is at least the sum over segments of length * ((difference of
means)^2 + (difference of deviations)^2); with the exact norms that is an upper bound of the
inner product: the sum of length * (product of means + product of deviations). Bounds are taken from
coarse to fine; a pair leaves as soon as its bound is below the k-th score its query already has. A first pass over a
hashed sample of the candidates gives every query such a score before the search begins.
Exact products are computed for the survivors only.

All candidates are dealt into groups of bounded size, and so are the queries; each task has one group
of each and goes through the candidates block by block. The k best of each query and group are
then ranked once more.

Defined results: a vector that is null, or holds null or non-finite components, or has no id takes no
part; vectors of different lengths are not compared; a query row that is repeated counts
once; rows with the id of a query are its own and no candidates of it; other repeated rows count one
by one; equal scores go to the smaller id; an empty table gives no rows. Scores are exact; one
that does not fit in 64 bits stops at the largest or smallest that does. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuesift.session import cut_lineage

#: Components in a group of candidates and in a group of queries.
CANDIDATE_NUMBERS, QUERY_NUMBERS = 4_000_000, 2_000_000
#: At least so many groups of candidates, to spread small tables.
LEAST_GROUPS = 48
#: Segments at each resolution.
RESOLUTIONS = (2, 8, 16, 32)
#: One in so many candidates is in the sample that gives the first k-th scores.
SAMPLE_OF = 4
_QUERY_BLOCK, _CANDIDATE_BLOCK, _PAIRS = 512, 1024, 1 << 15
#: Below this all sums of products are exact in doubles.
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, vector`` of the rows that take part, components as doubles."""
    vector = table[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.filter(table[id_col].isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        table[id_col].cast("long").alias("id"), vector.alias("vector")
    )


def _groups(df: DataFrame, numbers: int) -> int:
    total = df.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    return max(1, -(-int(total) // numbers))


_SCHEMA = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def search(queries: DataFrame, candidates: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """``query_id, rank, id, score``: the k candidates with the highest inner product.

    Both tables hold ``id, vector``; every component x counts as floor(scale * x).
    """
    once = queries.withColumn("query", F.xxhash64("vector")).dropDuplicates(["id", "query"])
    once = cut_lineage(once.select("id", "vector", "query"), "queries")
    sample = candidates.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLE_OF)) == 0)
    # The k-th score in the sample is at most the k-th of all.
    floors = cut_lineage(
        _ranked(once.withColumn("floor", F.lit(None).cast("long")), sample, k, scale).filter(F.col("rank") == k).select(
            F.col("query_id").alias("id"), "query", F.col("score").alias("floor")
        ), "first-thresholds",
    )
    ranked = _ranked(once.join(floors, ["id", "query"], "left"), candidates, k, scale)
    return ranked.select("query_id", "rank", "id", "score")


def _ranked(once: DataFrame, candidates: DataFrame, k: int, scale: float) -> DataFrame:
    """The k best of each query (``id, vector, query, floor``); what scores below ``floor`` need not be found."""
    query_groups = _groups(once, QUERY_NUMBERS)
    candidate_groups = max(LEAST_GROUPS, _groups(candidates, CANDIDATE_NUMBERS))

    def dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        return df.withColumns({
            own: F.pmod(F.xxhash64("id"), F.lit(groups)),
            other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))),
        })

    left = dealt(once, "q", query_groups, "c", candidate_groups)
    right = dealt(candidates.select("id", "vector"), "c", candidate_groups, "q", query_groups)

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = [
            _search_equal(*ours, *theirs[1:], k)
            for ours in _by_length(asked, scale, "query", "floor") for theirs in _by_length(given, scale)
            if ours[0] == theirs[0]
        ]
        columns = [np.concatenate([part[i] for part in found]) if found else [] for i in range(4)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

    best = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(
        run, "query_id long, query long, id long, score long"
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_length(table: pa.Table, scale: float, *more: str) -> list[tuple]:
    """For each length of vectors: length, matrix of floored components, ids, further columns."""
    table = table.combine_chunks()
    if not table.num_rows:
        return []
    vectors = table["vector"].chunk(0)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        matrix = flat[starts[rows][:, None] + np.arange(length)]
        out.append((int(length), matrix, *(table[c].to_numpy()[rows] for c in ("id", *more))))
    return out


def segment_statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length.

    The product of two such rows is an upper bound of the product of the vectors.
    """
    edges = np.linspace(0, matrix.shape[1], segments + 1).astype(int)
    parts = [matrix[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    roots = [np.sqrt(part.shape[1]) for part in parts]
    means = [root * part.mean(axis=1) for root, part in zip(roots, parts, strict=True)]
    spread = [root * part.std(axis=1) for root, part in zip(roots, parts, strict=True)]
    return np.stack(means + spread, axis=1)


def _exact_scores(ours: np.ndarray, theirs: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return np.einsum("ij,ij->i", ours, theirs).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(ours, theirs, strict=True))
    return np.array([min(_MOST, max(_LEAST, s)) for s in sums], dtype=np.int64)


def _search_equal(length: int, queries, query_ids, query_marks, floors, candidates, ids, k: int) -> tuple:
    """The k best of each query among vectors of its length: ids, marks, candidates' ids, scores."""
    levels = [s for s in RESOLUTIONS if s < length]
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((queries**2).sum(axis=1)), np.sqrt((candidates**2).sum(axis=1))
        exact = bool(norms[0].max(initial=0) * norms[1].max(initial=0) < _EXACT)
        ours, theirs = ([segment_statistics(m, s) for s in levels] for m in (queries, candidates))
        out = []
        for first in range(0, len(queries), _QUERY_BLOCK):
            q = slice(first, first + _QUERY_BLOCK)
            out.append(_search_block(
                queries[q], query_ids[q], query_marks[q], np.nan_to_num(floors[q].astype(float), nan=-np.inf), [x[q] for x in ours],
                norms[0][q],
                candidates, ids, theirs, norms[1], k, exact,
            ))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def surviving_pairs(open_: np.ndarray, ours: list, theirs: list, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``open_`` whose bounds reach ``need`` at every resolution, coarse to fine.

    A resolution is compared for all pairs at once while most are open, and pair by pair afterwards.
    """
    pairs = None
    for mine, other in zip(ours, theirs, strict=True):
        if pairs is None:
            open_ = open_ & ~(mine @ other.T < need)
            if open_.mean() < 0.1:
                pairs = np.nonzero(open_)
        else:
            bound = np.einsum("ij,ij->i", mine[pairs[0]], other[pairs[1]])
            stay = ~(bound < need[pairs])
            pairs = pairs[0][stay], pairs[1][stay]
    return np.nonzero(open_) if pairs is None else pairs


def _search_block(queries, query_ids, marks, floors, ours, norms, candidates, ids, theirs, their_norms, k, exact) -> tuple:
    rows, found, scores = (np.zeros(0, dtype=np.int64) for _ in range(3))
    least = floors
    for first in range(0, len(candidates), _CANDIDATE_BLOCK):
        c = slice(first, first + _CANDIDATE_BLOCK)
        open_ = query_ids[:, None] != ids[c][None, :]
        # Rounding of the bounds is far below this part of the product of the norms.
        slack = 1e-9 * norms[:, None] * their_norms[c][None, :] + 1e-6
        need = least[:, None] - slack
        pairs = surviving_pairs(open_, ours, [other[c] for other in theirs], need)
        new = np.concatenate([np.zeros(0, np.int64), *(
            _exact_scores(queries[pairs[0][at:at + _PAIRS]], candidates[c][pairs[1][at:at + _PAIRS]], exact)
            for at in range(0, len(pairs[0]), _PAIRS)
        )])
        if not len(new):
            continue
        rows, found, scores = (
            np.concatenate(x) for x in ((rows, pairs[0]), (found, ids[c][pairs[1]]), (scores, new))
        )
        order = np.lexsort((found, -scores.astype(object) if not exact else -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        starts = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - starts < k
        rows, found, scores, starts = rows[kept], found[kept], scores[kept], starts[kept]
        full = np.flatnonzero(np.bincount(rows, minlength=len(queries)) >= k)
        least = least.copy()
        least[full] = np.maximum(least[full], scores[np.searchsorted(rows, full, side="right") - 1])
    return query_ids[rows], marks[rows], found, scores

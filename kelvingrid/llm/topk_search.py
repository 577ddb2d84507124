"""Exact top-k inner-product search over an impact-ordered index, read score at a time.

Every component is an integer weight; its quantised magnitude (one of ``LEVELS`` levels) is the impact of a
posting.  A block of vectors holds its postings sorted by (dimension, sign, falling level), so a segment, all
postings of one level, is a slice.  For a query, segments are processed by falling impact |query weight| * level, in tiers.  After each tier
the best possible gain of everything unread bounds how far any score can still move.  Reading stops only when
that bound proves which vectors can be among the k best; these are rescored exactly.

Vectors with a component of ``WEIGHT_MOST`` or more are beside the index, since sums of floats are not exact for them: there,
and for queries of that kind, a sum of floats with a slack for its rounding is the bound, and what it leaves open is rescored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kelvingrid.session import cut_lineage

#: Impact levels of a block.
LEVELS = 64
#: Vectors in a block of the index, queries in a block of queries.
BLOCK, QUERY_BLOCK = 4096, 256
#: Larger weights (components of 4096 and more) would leave the whole numbers that sums of floats are exact in; their vectors are not indexed.
WEIGHT_MOST = 1 << 20
#: Stands for a missing id.
NO_ID = (1 << 63) - 1
#: Least and largest score that a long holds.
LONG_LEAST, LONG_MOST = -(1 << 63), (1 << 63) - 1
#: Reading goes on while more than this share of a block can still be among the best.
OPEN_SHARE, TIERS = 0.02, 5


class ImpactIndex:
    """Postings of one block: ``weights`` is (vectors, dimensions).

    Segment (2 * dimension + sign) lies at ``begin`` in the flat arrays, highest level first; ``reach[s, l]`` of
    its postings have level l or more.
    """

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        n, self.dims = weights.shape
        self.step = max(1, -(-int(np.abs(weights).max(initial=0)) // LEVELS))
        level = np.abs(weights) // self.step
        segment = 2 * np.arange(self.dims)[None, :] + (weights < 0)
        rows, cols = np.nonzero(level)
        order = np.lexsort((-level[rows, cols], segment[rows, cols]))
        self.ids, at = rows[order], segment[rows, cols][order]
        self.impacts = level[rows, cols][order] * self.step
        held = np.bincount(at * (LEVELS + 2) + self.impacts // self.step, minlength=2 * self.dims * (LEVELS + 2)).reshape(-1, LEVELS + 2)
        self.reach = held[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.begin = np.r_[0, self.reach[:, 0].cumsum()][:-1]

    def top(self, query: np.ndarray, k: int, skip: int | np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best of the block and all ties with the last; rows ``skip`` take no part."""
        n, every = len(self.weights), np.arange(2 * self.dims)
        force = np.repeat(np.abs(query), 2)
        turn = np.repeat(np.sign(query), 2) * np.tile([1, -1], self.dims)
        size = self.reach[:, 0]
        tops = np.where(size > 0, self.impacts[np.minimum(self.begin, max(len(self.impacts) - 1, 0))], 0) if len(self.impacts) else np.zeros(len(size), np.int64)
        most = int((force * tops).max(initial=0))
        score, read = np.zeros(n), np.zeros(2 * self.dims, np.int64)
        slack = int((np.abs(query) * (self.step - 1)).sum())  # what the quantisation hides, read or not
        keep = np.ones(n, bool)
        if skip is not None:
            keep[skip] = False
        for tier in range(1, TIERS + 1):
            floor = most * (TIERS - tier) // TIERS
            lowest = np.where(force > 0, np.clip(-(-floor // np.maximum(force * self.step, 1)), 1, LEVELS + 1), LEVELS + 1)
            end = np.maximum(self.reach[every, lowest], read)
            lengths = end - read
            picks = np.repeat(self.begin + read - np.r_[0, lengths.cumsum()[:-1]], lengths) + np.arange(lengths.sum())
            gains = self.impacts[picks] * np.repeat(force * turn, lengths)
            score += np.bincount(self.ids[picks], gains, n)  # whole numbers below 2 ** 53
            read = end
            unread = np.where((end < size) & (force > 0), force * self.impacts[np.minimum(self.begin + end, max(len(self.impacts) - 1, 0))], 0) if len(self.impacts) else 0 * size
            # a vector has one posting per dimension, of one sign
            ups = np.where(turn > 0, unread, 0).reshape(-1, 2).max(axis=1).sum()
            downs = np.where(turn < 0, unread, 0).reshape(-1, 2).max(axis=1).sum()
            if keep.sum() <= k:
                break
            kth = np.partition(score[keep], -k)[-k] - downs - slack
            keep &= score + ups + slack >= kth  # proven: the others can't be among the best
            if keep.sum() <= max(4 * k, OPEN_SHARE * n):
                break
        rows = np.flatnonzero(keep)
        exact = self.weights[rows] @ query
        if len(rows) > k:
            last = np.partition(exact, -k)[-k]
            rows, exact = rows[exact >= last], exact[exact >= last]
        return rows, exact


def _best_rows(rows: np.ndarray, exact: list[int], k: int) -> tuple[np.ndarray, list[int]]:
    """Of (rows, scores) the k best and all ties with the last."""
    if len(rows) <= k:
        return rows, exact
    last = sorted(exact)[-k]
    keep = [j for j, s in enumerate(exact) if s >= last]
    return rows[keep], [exact[j] for j in keep]


def wide_top(weights: np.ndarray, query: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, list[int]]:
    """As ``ImpactIndex.top`` for whole numbers of any size, given as floats; scores are Python ints."""
    open_rows = np.ones(len(weights), bool)
    if skip is not None:
        open_rows[skip] = False
    with np.errstate(over="ignore", invalid="ignore"):
        about = weights @ query
        slack = (np.abs(weights) @ np.abs(query)) * (weights.shape[1] + 4) * 2.0**-52
        low, high = about - slack, about + slack
    if np.isfinite(low).all() and np.isfinite(high).all() and open_rows.sum() > k:
        open_rows &= high >= np.partition(low[open_rows], -k)[-k]
    rows = np.flatnonzero(open_rows)
    at = np.flatnonzero(query)
    ints = [int(x) for x in query[at].tolist()]
    exact = [sum(a * int(b) for a, b in zip(ints, w)) for w in weights[np.ix_(rows, at)].tolist()]
    return _best_rows(rows, exact, k)


class Block:
    """Vectors of one block: the narrow ones in an index, the wide ones beside it."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        wide = np.abs(weights).max(axis=1, initial=0) >= WEIGHT_MOST
        self.narrow, self.wide = np.flatnonzero(~wide), np.flatnonzero(wide)
        self.index = ImpactIndex(weights[self.narrow].astype(np.int64)) if len(self.narrow) else None

    def top(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(rows, scores) that hold the k best of the block and all ties with the last; rows ``skip`` take no part."""
        if np.abs(query).max(initial=0) >= WEIGHT_MOST:
            return wide_top(self.weights, query, k, skip)
        rows, scores = np.zeros(0, np.int64), []
        if self.index is not None:
            found, exact = self.index.top(query.astype(np.int64), k, np.flatnonzero(np.isin(self.narrow, skip)))
            rows, scores = self.narrow[found], exact.tolist()
        if len(self.wide):
            found, exact = wide_top(self.weights[self.wide], query, k, np.flatnonzero(np.isin(self.wide, skip)))
            rows, scores = np.r_[rows, self.wide[found]], scores + exact
        return _best_rows(rows, scores, k)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, w array<double>): floor(scale * x), x as double; vectors null, or with null or non-finite components are left out.

    Every other row stays, also one that repeats an id; a missing id becomes ``NO_ID``, the largest one.
    A finite component that leaves the doubles when scaled raises.
    """
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is above infinity
    # from 2 ** 53 on, doubles are whole numbers
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).when(F.abs(v) < float("inf"), v).otherwise(F.raise_error(F.lit("a scaled component is beyond the doubles")).cast("double"))
    good = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.col("x").isNotNull() & finite)
    return good.select("vec_id", F.transform("x", lambda v: whole(v * scale)).alias("w"))


def _stack(lists: Iterable[list[float]], dims: int) -> np.ndarray:
    lists = list(lists)
    out = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best integer inner products of every query row, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows with another id or none; each
    is a candidate of its own, so an id that repeats can be given out more than once, and rows without an id come last among
    ties.  Queries that share an id are answered together.  Vectors of
    unequal length are compared as if the shorter one ended in zeros; an empty vector scores 0.  Fewer than k
    candidates: all of them.  An empty table gives no rows.  A score that is given out and does not fit a long raises.  Vectors are dealt over blocks of about ``BLOCK`` by a
    hash of their id; each block meets every block of queries by an equi-join on the query block, and keeps k rows (and ties) a query.
    """
    w = cut_lineage(integer_vectors(vectors, id_col, vector_col))
    is_query = (F.col("vec_id") != NO_ID) & (F.pmod(F.col("vec_id"), F.lit(query_every)) == 0)
    n, asked, dims = w.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("w")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    spread = F.xxhash64("vec_id")
    queries = w.filter(is_query).select(F.pmod(spread, F.lit(query_blocks)).alias("q"), "vec_id", "w")
    queries = queries.groupBy("q").agg(F.collect_list(F.struct("vec_id", "w")).alias("queries"))  # about QUERY_BLOCK rows
    # by the vector as well, so that rows of one id are spread
    data = w.select(F.pmod(F.xxhash64("vec_id", "w"), F.lit(blocks)).alias("b"), "vec_id", "w").groupBy("b").agg(F.collect_list(F.struct("vec_id", "w")).alias("rows"))  # about BLOCK rows
    met = data.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("q", F.col("q").cast("long")).join(queries, "q")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None  # the index of a block serves all blocks of queries
        for batch in batches:
            for i in range(batch.num_rows):
                rows, asked_rows = batch.column("rows")[i].values, batch.column("queries")[i].values
                ids = rows.field("vec_id").to_numpy()
                if batch.column("b")[i].as_py() != held:
                    held, block = batch.column("b")[i].as_py(), Block(_stack(rows.field("w").to_pylist(), dims))
                out_q, out_v, out_s, out_b = [], [], [], []
                asked_ids = asked_rows.field("vec_id").to_pylist()
                for qid, q in zip(asked_ids, _stack(asked_rows.field("w").to_pylist(), dims)):
                    found, scores = block.top(q, k, np.flatnonzero(ids == qid))
                    for s, v in sorted((-s, v) for s, v in zip(scores, ids[found].tolist()))[:k]:
                        out_q.append(qid)
                        out_v.append(v)
                        out_s.append(min(max(-s, LONG_LEAST), LONG_MOST))
                        out_b.append((-s > LONG_MOST) - (-s < LONG_LEAST))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_q, out_v, out_s, out_b)], schema=schema)

    best = met.select("b", "q", "rows", "queries").repartition(max(1, min(blocks, 4096)), "b").sortWithinPartitions("b", "q").mapInArrow(search, "query_id long, vec_id long, score long, beyond long")
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")  # NO_ID is the largest
    told = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), told.alias("score"))

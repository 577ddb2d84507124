"""Size-balanced shards by sampled splitters.

Records are ordered by (hash of the text, document id), so equal texts are neighbours.  A size-weighted
sample of these composite keys gives quantile boundaries; ranges that still turn out overfull are divided
again at sampled keys of their own.  Prefix sums over the ranges place every record on the byte axis, and
the shard borders are cut on that axis.  The shard of a record depends on the whole order, never on the
sample, so a repeated run or a recomputed partition gives the same shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelvingrid.session import cut_lineage

#: Rows that a range is meant to hold, the most ranges there are (beyond it they hold more), and sampled keys a range.
RANGE_ROWS, RANGES_MOST, OVERSAMPLE = 1 << 18, 1 << 16, 24
#: A record is large when it holds more than this share of a shard; there are at most shards / LARGE of them.
LARGE = 1 / 64


def _sampled(df: DataFrame, key: str, tie: str, size: str, parts: int, total: int, seed: int) -> list[tuple[int, int]]:
    """About ``OVERSAMPLE * parts`` keys, drawn with a chance in proportion to size; the draw is a hash of the record."""
    u = F.pmod(F.xxhash64(F.col(key), F.col(tie), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.col(size) * F.lit(OVERSAMPLE * parts / max(total, 1))
    return sorted((r[0], r[1]) for r in df.filter(u < chance).select(key, tie).collect())


def sampled_splitters(df: DataFrame, key: str, tie: str, size: str, parts: int, total: int, seed: int = 0) -> list[tuple[int, int]]:
    """At most ``parts - 1`` composite boundaries at the quantiles of a size-weighted sample."""
    drawn = _sampled(df, key, tie, size, parts, total, seed)
    picks = {drawn[len(drawn) * i // parts] for i in range(1, parts)} if drawn else set()
    return sorted(picks)


def range_of(splitters: list[tuple[int, int]], key: str, tie: str) -> Column:
    """Number of splitters that are not above the record's (key, tie)."""
    keys, ties = np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)

    def place(k, t):
        k, t = k.to_numpy(np.int64), t.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for at in np.unique(low[high > low]):  # keys that are splitters themselves are divided by the tie
            rows = np.flatnonzero((low == at) & (high > low))
            out[rows] = at + np.searchsorted(ties[at : high[rows[0]]], t[rows], "right")
        return pd.Series(out.astype(np.int64))

    return F.pandas_udf(place, "long")(F.col(key), F.col(tie))


def level_loads(large: list[tuple[int, int]], small_total: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """Shard of each large record (largest first, into the lightest shard) and the bytes of small records each shard still takes."""
    heap, where, loads = [(0, s) for s in range(shards)], {}, [0] * shards
    for size, record in sorted(large, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        where[record], loads[s] = s, load + size
        heapq.heappush(heap, (load + size, s))
    left, open_shards = small_total, sorted(range(shards), key=lambda s: (loads[s], s))
    level = 0.0
    for n in range(1, shards + 1):  # fill the lightest shards up to one level
        level = (left + sum(loads[s] for s in open_shards[:n])) / n
        if n == shards or level <= loads[open_shards[n]]:
            break
    return where, [max(0.0, level - x) for x in loads]


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slim records (doc_id, size, text_crc32, key, tie): the text itself is never shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("tie"),
    )


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): ``shard`` from 0 to shards - 1, ``slot`` gapless from 0 in each shard.

    Size is the UTF-8 length plus 8; a null text counts as empty.  Law: ``bytes``.  Every shard ends up within
    ``LARGE`` of the mean size, unless one record alone is larger than a shard.  Equal texts are neighbours in the order;
    a group is cut only where a shard's border falls into it, so a group of a third of all rows is spread over a
    third of the shards.  Null ids sort first in their group; repeated (id, text) rows each get a slot of their
    own; an empty table gives no rows.  Other columns are not carried.  What reaches the driver is bounded by
    parameters: sampled keys (``OVERSAMPLE`` a range), at most ``RANGES_MOST`` ranges (one row each), and at most
    shards / ``LARGE`` large records.
    """
    base = cut_lineage(records_of(docs, id_col, text_col))
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cut = total / shards * LARGE
    range_rows = max(RANGE_ROWS, -(-n // RANGES_MOST))
    parts = max(4 * shards, -(-n // range_rows))
    splitters = sampled_splitters(base, "key", "tie", "size", parts, total, seed)
    is_large = F.col("size") > F.lit(cut)
    placed = base.withColumn("large", is_large).withColumn("range", range_of(splitters, "key", "tie"))

    def sums(df):
        return df.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("large"), F.col("size")).otherwise(0)).alias("bytes"), F.sum(F.when(~F.col("large"), 1).otherwise(0)).alias("small"))

    held = sums(placed).collect()
    over = [r["range"] for r in held if r["n"] > 2 * range_rows]
    if over:  # overfull ranges get boundaries of their own
        inside = placed.filter(F.col("range").isin(over)).withColumn("one", F.lit(1))
        more = sampled_splitters(inside, "key", "tie", "one", 2 * sum(r["n"] for r in held if r["n"] > 2 * range_rows) // range_rows, sum(r["n"] for r in held if r["range"] in set(over)), seed + 1)
        splitters = sorted({*splitters, *more})
        placed = base.withColumn("large", is_large).withColumn("range", range_of(splitters, "key", "tie"))
        held = sums(placed).collect()
    held.sort(key=lambda r: r["range"])
    before = {r["range"]: (b, k) for r, b, k in zip(held, accumulate((r["bytes"] for r in held), initial=0), accumulate((r["small"] for r in held), initial=0))}
    small_bytes, small_rows = sum(r["bytes"] for r in held), sum(r["small"] for r in held)

    large = placed.filter("large").select("size", "key", "tie").collect()
    large.sort(key=lambda r: (-r["size"], r["key"], r["tie"]))
    where, room = level_loads([(r["size"], i) for i, r in enumerate(large)], small_bytes, shards)
    spare = sum(room) or 1.0
    borders = np.array(list(accumulate(x * small_bytes / spare for x in room))[:-1])
    at_large: dict[tuple[int, int, int], list[int]] = {}
    for i, r in enumerate(large):
        at_large.setdefault((r["key"], r["tie"], r["size"]), []).append(where[i])

    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("key", pa.int64()), ("tie", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("rank", pa.int64()), ("large", pa.bool_())])

    def cut_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, seen = None, 0, 0
        taken: dict[tuple[int, int, int], int] = {}
        for b in batches:
            rng, size, big = (b.column(c).to_numpy(zero_copy_only=False) for c in ("range", "size", "large"))
            key, tie = b.column("key").to_numpy(), b.column("tie").to_numpy()
            shard, rank = np.zeros(len(rng), np.int32), np.zeros(len(rng), np.int64)
            starts = np.flatnonzero(np.r_[True, rng[1:] != rng[:-1]]) if len(rng) else []
            for lo, hi in zip(starts, [*starts[1:], len(rng)]):
                if at != rng[lo]:
                    at = rng[lo]
                    used, seen = before[int(at)]
                small = np.where(big[lo:hi], 0, size[lo:hi])
                ends = used + np.cumsum(small)
                shard[lo:hi] = np.searchsorted(borders, ends - small / 2, "right")
                counts = np.cumsum(~big[lo:hi])
                rank[lo:hi] = seen + counts - 1
                used, seen = int(ends[-1]), int(seen + counts[-1])
            for i in np.flatnonzero(big):
                k = (int(key[i]), int(tie[i]), int(size[i]))
                j = taken.get(k, 0)
                taken[k] = j + 1
                shard[i] = at_large[k][min(j, len(at_large[k]) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("size"), b.column("key"), b.column("tie"), b.column("text_crc32"), pa.array(shard), pa.array(rank), b.column("large")], schema=schema)

    ordered = placed.repartition("range").sortWithinPartitions("range", "key", "tie", "size")
    out = ordered.mapInArrow(cut_ranges, "doc_id long, size long, key long, tie long, text_crc32 long, shard int, rank long, large boolean")
    out = cut_lineage(out)
    # ranks run through all small records in order: a shard's first one is its slot 0; large records follow them
    first = out.filter(~F.col("large")).groupBy("shard").agg(F.min("rank").alias("first"), F.count("*").alias("n_small"))
    small = out.filter(~F.col("large")).join(F.broadcast(first.select("shard", "first")), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
    w = Window.partitionBy("shard").orderBy(F.desc("size"), "key", "tie")
    big = (
        out.filter("large").join(F.broadcast(first.select("shard", "n_small")), "shard", "left")
        .select("doc_id", "size", "text_crc32", "shard", (F.coalesce(F.col("n_small"), F.lit(0)) + F.row_number().over(w) - 1).alias("slot"))
    )
    return small.unionByName(big)

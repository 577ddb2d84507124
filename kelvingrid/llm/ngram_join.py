"""N-gram Jaccard join: size-banded tiles with bitmap signatures, then exact intersection of sorted arrays.

1. Every text becomes a sorted array of distinct shingle hashes.  Equal sets are one class, named by its smallest
   document; only classes are compared.
2. Seeds: classes that share one of a few minimum hashes are paired with one of them (a star, never all pairs) and
   verified; a few rounds with other centres join what the first left apart.  This joins nearly all of a large
   group of near copies with a number of pairs that is linear.
3. Completeness: two sets that reach the threshold share a token among the first of each, in any one order of all
   tokens (prefix filter); the order puts tokens of frequent hash buckets last, so passages that many documents
   share stay out of the prefixes.  Tiles are keyed by (token, size band): a set can only match sets of its own band or the
   next.  Inside a tile only pairs of different components are compared: sizes first, then bitmap signatures,
   whose differing bits bound the overlap from above.  Pairs that pass are verified exactly.
   Before every verification sparser signatures of the pairs' sets bound the overlap once more.
4. Components of all verified links.

Nothing is dropped: the seeds only save work, step 3 alone would find every link between components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelvingrid.llm.common import flat_utf8, frugal, mix64, spans_of
from kelvingrid.llm.components import component_labels
from kelvingrid.llm.shingles import shingle_sets
from kelvingrid.session import cut_lineage, scratch_path

#: Minimum hashes per set for the seeds, and rounds of seeds; each round draws other centres.
SEEDS, SEED_ROUNDS = 4, 2
#: Buckets of the token frequency table (fixed size, whatever the corpus) and the parts it is summed in.
FREQUENCY_BUCKETS, FREQUENCY_PARTS = 1 << 19, 32
#: Bits of a signature: the power of two from ``SPARSE`` times the set's size on, within these bounds.  Tiles with more
#: than ``CROWD`` probing rows get sparser signatures, whose bound is nearly exact, so that few pairs pass in vain.
BITS, SPARSE = (64, 4096), 1
CROWD, CROWD_BITS, CROWD_SPARSE = 64, (64, 1 << 14), 8
#: Bits of the filter that says which sets a verification needs (1 MB, whatever the corpus).
FILTER_BITS = 1 << 23
#: Probing rows of a tile that one task holds; a larger tile is divided.
TILE_ROWS = 2048
#: Pairs that are compared at a time, and pairs whose signatures come with them.
PAIR_ROWS, BOUND_ROWS = 1 << 18, 1 << 12
MISSING_ID = (1 << 63) - 1


def popcounts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def sizes_fit(self, small, large):
        return small * self.den >= large * self.num

    def least_overlap(self, a, b):
        """Smallest intersection that reaches the threshold: ceil(num (a + b) / (num + den))."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def probe_prefix(self, n):
        """Tokens of a set that meet any partner's prefix (overlap of at least ceil(num n / den))."""
        return n + (-self.num * n) // self.den + 1

    def index_prefix(self, n):
        """Tokens of a set that meet the probe prefix of a partner that is not smaller."""
        return n + (-2 * self.num * n) // (self.num + self.den) + 1

    def band(self, n: np.ndarray) -> np.ndarray:
        """Size band: a set matches sets of its own and the neighbouring bands only."""
        return np.floor(np.log(np.maximum(n, 1)) / np.log(self.den / self.num) + 1e-9).astype(np.int32)


def signatures(hashes: np.ndarray, offsets: np.ndarray, sparse: int = SPARSE, bounds: tuple[int, int] = BITS) -> list[bytes]:
    """Bitmap of each set; a bit is the low end of the hash, so a wide bitmap folds onto a narrow one."""
    n = np.diff(offsets)
    width = np.clip(1 << np.ceil(np.log2(sparse * np.maximum(n, 1))).astype(np.int64), *bounds)
    begin = np.r_[0, np.cumsum(width)]
    bits = np.zeros(begin[-1], bool)
    owner = np.repeat(np.arange(len(n)), n)
    bits[begin[owner] + ((hashes >> np.uint64(7)).astype(np.int64) & (width[owner] - 1))] = True
    packed = np.packbits(bits).tobytes()
    at = (begin // 8).tolist()
    return [packed[a:b] for a, b in zip(at, at[1:])]


def stack_signatures(blobs: list[bytes], width: int) -> np.ndarray:
    """Signatures as 64-bit words, folded to ``width`` bits."""
    out = np.zeros((len(blobs), width // 8), np.uint8)
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, np.uint8)
        out[i] = x if len(x) * 8 == width else np.bitwise_or.reduce(x.reshape(-1, width // 8), axis=0)
    return out.view(np.uint64)


def overlap_at_most(a: np.ndarray, b: np.ndarray, na, nb):
    """Bound from above: each differing bit needs an element that only one of the sets has."""
    return (na + nb - popcounts(a ^ b)) // 2


def _grouped_min(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros(len(offsets) - 1, values.dtype)
    if len(full):
        out[full] = np.minimum.reduceat(values, offsets[full])
    return out


def _grouped_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]


def digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    first = mix64(_grouped_sum(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), offsets))
    second = mix64(_grouped_sum(mix64(hashes ^ np.uint64(0x14057B7EF767814F)), offsets))
    return first.view(np.int64), second.view(np.int64)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MISSING_ID)).alias("doc_id"), F.col(text_col).alias("text"))


def _sets(batch: pa.RecordBatch, n_words: int, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, offsets) of a batch, a bounded part at a time."""
    if keep is not None:
        batch = batch.filter(pa.array(keep))
    data, offsets = flat_utf8(batch.column(1))
    ids = batch.column(0).to_numpy()
    for lo, hi in spans_of(offsets, 8 << 20):
        yield ids[lo:hi], *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n_words)


SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())]
)
SKETCH_DDL = "doc_id long, n long, d1 long, d2 long, keys array<long>, bits binary, part int, counts binary"


def sketches(rows: DataFrame, n_words: int) -> DataFrame:
    """One row per document (size, digest, minimum hashes, signature), and the task's token counts per bucket in a few more rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FREQUENCY_BUCKETS, np.uint32)
        for b in batches:
            for ids, hashes, offsets in _sets(b, n_words):
                counts += np.bincount((hashes >> np.uint64(45)).astype(np.int64), minlength=FREQUENCY_BUCKETS).astype(np.uint32)
                d1, d2 = digests(hashes, offsets)
                keys = np.stack([_grouped_min(mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))), offsets) for k in range(SEEDS)], axis=1)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SEEDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                none = pa.nulls(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.diff(offsets)), pa.array(d1), pa.array(d2), keys, pa.array(signatures(hashes, offsets), pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                    schema=SKETCH,
                )
        parts = [p.tobytes() for p in counts.astype("<u4").reshape(FREQUENCY_PARTS, -1)]
        none = pa.nulls(FREQUENCY_PARTS)
        yield pa.RecordBatch.from_arrays([*(none.cast(f.type) for f in list(SKETCH)[:6]), pa.array(range(FREQUENCY_PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=SKETCH)

    return rows.mapInArrow(frugal(run), SKETCH_DDL)


def frequency_classes(sketched: DataFrame) -> np.ndarray:
    """For each bucket of tokens the class of its count (two per doubling): a table of fixed size."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob, "<u4").astype(np.float64)
        for part, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.rint(2 * np.log2(1 + v)).astype(np.uint8).tobytes()], pa.binary())], names=["part", "classes"])

    rows = sketched.filter("part is not null").select("part", "counts").repartition(FREQUENCY_PARTS, "part").mapInArrow(add, "part int, classes binary").collect()
    out = np.zeros((FREQUENCY_PARTS, FREQUENCY_BUCKETS // FREQUENCY_PARTS), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["classes"], np.uint8)
    return out.ravel()


def prefix_tokens(rows: DataFrame, ids: DataFrame, classes, n_words: int, limit: Threshold) -> DataFrame:
    """(token, who): the prefix of every set in the order (class of the bucket, hash), from the documents with these ids (and a few others).

    ``who`` is the upper 63 bits of the set's first digest, then one bit that marks the index prefix: two longs a row, as
    this is the largest shuffle.  Sets that agree in these bits would only be compared once more than needed.
    """
    bits = rows.sparkSession.sparkContext.broadcast(_needed(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for b in batches:
            for _, hashes, offsets in _sets(b, n_words, _held(b, bits)):
                n = np.diff(offsets)
                d1, _ = digests(hashes, offsets)
                rank = table[(hashes >> np.uint64(45)).astype(np.int64)]
                probe, index = np.where(n > 0, limit.probe_prefix(n), 0), limit.index_prefix(n)
                picks = [lo + np.argsort(rank[lo:hi], kind="stable")[:p] for lo, hi, p in zip(offsets[:-1].tolist(), offsets[1:].tolist(), probe.tolist())]
                owner = np.repeat(np.arange(len(n)), probe)
                place = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(probe)][:-1], probe)
                at = np.concatenate(picks) if picks else np.zeros(0, np.int64)
                for lo in range(0, len(at), 1 << 17):
                    s = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[at[s]].view(np.int64)), pa.array((d1[owner[s]] & -2) | (place[s] < index[owner[s]]))], names=["token", "who"]
                    )

    return rows.select("doc_id", "text", _place().alias("place")).mapInArrow(frugal(run), "token long, who long")


def _shared_tokens(ordered: DataFrame) -> DataFrame:
    """The (token, who) rows of tokens that two or more sets have, without doubles; the input is sorted by both.

    A set is one row of a token once doubles are gone, so a single row is carried from batch to batch, not the run.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = None, False  # the last row so far, and whether its token is known to be shared
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            token, who = b.column("token").to_numpy(), b.column("who").to_numpy()
            same = token[1:] == token[:-1]
            fresh = np.r_[True, ~same | (who[1:] != who[:-1])]
            starts = np.flatnonzero(np.r_[True, ~same])
            shared = np.add.reduceat(np.r_[0, same & ((who[1:] >> 1) != (who[:-1] >> 1))].astype(np.int64), starts) > 0
            shared[0] |= sent
            keep = np.repeat(shared, np.diff(np.r_[starts, len(token)])) & fresh
            keep[0] &= not sent  # given out with the batch before
            if keep.any():
                yield b.filter(pa.array(keep))
            held, sent = b.slice(b.num_rows - 1, 1), bool(shared[-1])

    return ordered.mapInArrow(run, "token long, who long")


def _needed(ids: DataFrame) -> bytes:
    """A filter of ``FILTER_BITS`` bits that holds every id; others pass by chance only."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # these functions count places from 1
    parts = ids.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in parts.collect():  # FILTER_BITS / 32768 rows
        out[(r["b"] - 1) % len(out)] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def _place() -> Column:
    """Bit of a document in the filter."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))


def _held(batch: pa.RecordBatch, bits) -> np.ndarray:
    """Which rows (doc_id, text, place) the filter lets pass."""
    place, held = batch.column(2).to_numpy(), np.frombuffer(bits.value, np.uint8)
    return ((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _sets_of(ids: DataFrame, rows: DataFrame, n_words: int, crowd: bool = False) -> DataFrame:
    """(id, n, set): sorted hashes, or with ``crowd`` sparse signatures, of the documents with these ids (and of a few others).

    Sets are made again from the texts; a fixed-size filter keeps other texts out of what is shuffled next.
    """
    bits = rows.sparkSession.sparkContext.broadcast(_needed(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found, hashes, offsets in _sets(b, n_words, _held(b, bits)):
                if crowd:
                    blobs = signatures(hashes, offsets, CROWD_SPARSE, CROWD_BITS)
                else:
                    raw, at = hashes.tobytes(), (8 * offsets).tolist()
                    blobs = [raw[x:y] for x, y in zip(at, at[1:])]
                for lo in range(0, len(blobs), 1024):
                    part = slice(lo, lo + 1024)
                    yield pa.RecordBatch.from_arrays([pa.array(found[part]), pa.array(np.diff(offsets)[part].astype(np.int32)), pa.array(blobs[part], pa.binary())], names=["id", "n", "set"])

    return rows.select("doc_id", "text", _place().alias("place")).mapInArrow(frugal(run), "id long, n int, set binary")


def verified(pairs: DataFrame, rows: DataFrame, n_words: int, limit: Threshold) -> DataFrame:
    """The (a, b) pairs of document ids whose sets reach the threshold, by intersection of their sorted arrays."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), rows, n_words)
    side = lambda name: sets.select(F.col("id").alias(name), F.col("set").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")

    def intersect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            last, x = None, None
            for i, (p, q) in enumerate(zip(b.column(2), b.column(3))):
                p, y = p.as_buffer(), np.frombuffer(q.as_buffer(), np.uint64)
                if last is None or p.address != last:
                    x, last = np.frombuffer(p, np.uint64), p.address
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                if len(short) and limit.sizes_fit(len(short), len(long)):
                    at = np.searchsorted(long, short)
                    common = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                    keep[i] = common >= limit.least_overlap(len(x), len(y))
            out = b.select(["a", "b"]).filter(pa.array(keep))
            if out.num_rows:
                yield out

    return both.mapInArrow(intersect, "a long, b long")


def bounded(pairs: DataFrame, rows: DataFrame, n_words: int, limit: Threshold) -> DataFrame:
    """The (a, b) pairs of document ids that sparse signatures of both sets do not rule out.

    A signature has an eighth of a set's bytes at most, so that whole sets are shuffled for few pairs in vain.
    """
    marks = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), rows, n_words, crowd=True)
    side = lambda name: marks.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("set").alias(f"bits_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BOUND_ROWS):
                part = b.slice(lo, BOUND_ROWS)
                n = np.concatenate([part.column(c).to_numpy() for c in ("n_a", "n_b")]).astype(np.int64)
                signed = Signatures(part.column("bits_a").to_pylist() + part.column("bits_b").to_pylist())
                x, y = np.arange(part.num_rows), np.arange(part.num_rows, 2 * part.num_rows)
                x, y = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
                keep = signed.overlap_at_most(x, y, n) >= limit.least_overlap(n[x], n[y])
                yield part.select(["a", "b"]).filter(pa.array(keep))

    # sizes that fit have signatures of one width or of neighbouring ones
    return both.filter(small * limit.den >= large * limit.num).mapInArrow(frugal(run), "a long, b long")


class Signatures:
    """Signatures of a batch of rows, by width; a row is held at its own width and folded once."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([8 * len(b) for b in blobs], np.int64)
        self.place, self.words = {}, {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            self.place[w] = np.full(len(blobs), -1)
            self.place[w][rows] = np.arange(len(rows))
            self.words[w] = stack_signatures([blobs[i] for i in rows], w)

    def overlap_at_most(self, index: np.ndarray, probe: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bound for pairs of rows; a partner is not smaller, so its signature is as wide or twice as wide."""
        out = np.empty(len(index), np.int64)
        for w in np.unique(self.width[index]).tolist():
            at = np.flatnonzero(self.width[index] == w)
            x, y, words, place = index[at], probe[at], self.words[w], self.place[w]
            out[at] = overlap_at_most(words[place[x]], words[place[y]], n[x], n[y])
        return out


def _tile_pairs(tiled: DataFrame, limit: Threshold) -> DataFrame:
    """Candidate pairs (a, b) of the tiles: different components, sizes that fit, and a signature bound that reaches the threshold.

    Rows are sorted by tile with the probing rows (about ``TILE_ROWS`` at most) first; index rows are streamed past
    them.  All tiles of a batch are compared at once, ``PAIR_ROWS`` pairs at a time.
    """

    def pairs(tile: np.ndarray, index: np.ndarray, table: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rep, comp, n = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "comp", "n"))
        signed = Signatures(table.column("bits").to_pylist())
        first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        probes = np.add.reduceat((~index).astype(np.int64), first)
        rows = np.flatnonzero(index)
        own = np.searchsorted(first, rows, "right") - 1
        begin, held = first[own], probes[own]
        ends = np.cumsum(held)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIR_ROWS, "right")))
            count = held[lo:hi]
            x = np.repeat(rows[lo:hi], count)
            y = np.repeat(begin[lo:hi], count) + np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)][:-1], count)
            fit = (comp[x] != comp[y]) & ((n[y] > n[x]) | ((n[y] == n[x]) & (rep[y] > rep[x]))) & limit.sizes_fit(n[x], n[y])
            x, y = x[fit], y[fit]
            if len(x):
                keep = signed.overlap_at_most(x, y, n) >= limit.least_overlap(n[x], n[y])
                if keep.any():
                    yield rep[x[keep]], rep[y[keep]]
            lo = hi

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # probing rows of the last tile, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            if carried is not None:
                b = pa.Table.from_batches([carried, b]).combine_chunks().to_batches()[0]
            keys = [b.column(c).to_numpy() for c in ("token", "tile_band", "salt")]
            changed = np.r_[False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
            tile = np.cumsum(changed)
            index = b.column("index").to_numpy(zero_copy_only=False)
            found = list(pairs(tile, index, b))
            if found:
                both = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            carried = b.filter(pa.array((tile == tile[-1]) & ~index))

    return tiled.mapInArrow(frugal(run), "a long, b long")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, which takes far less room than a checkpoint of the same rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _seed_round(nodes: DataFrame, reps: DataFrame, rows: DataFrame, n_words: int, limit: Threshold, number: int) -> DataFrame:
    """``nodes`` (d1, n, rep, comp) after one round: for every minimum hash a star around one drawn class, across components only."""
    keyed = nodes.select("rep", "n", "comp").join(reps.select("rep", "keys"), "rep").select("rep", "n", "comp", F.posexplode("keys").alias("k", "key"))
    draw = F.xxhash64("rep", F.lit(number)) if number else F.col("rep")  # the first document of a group is often what the others were made from
    centre = F.min(F.struct(draw.alias("draw"), "rep", "n", "comp"))
    hubs = keyed.groupBy("k", "key").agg(centre.alias("hub"), F.count("*").alias("c")).filter("c > 1").select("k", "key", "hub")
    stars = keyed.join(hubs, ["k", "key"]).filter(F.col("hub.comp") != F.col("comp"))
    small, large = F.least("hub.n", "n"), F.greatest("hub.n", "n")
    stars = stars.filter(small * limit.den >= large * limit.num).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(_kept(bounded(_kept(stars, "stars"), rows, n_words, limit), "bounded"), rows, n_words, limit)
    return cut_lineage(_united(nodes, links))


def _united(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the components that the links (a, b) of classes join."""
    comp = nodes.select("rep", "comp")
    edges = links.join(comp.select(F.col("rep").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("rep").alias("b"), F.col("comp").alias("v")), "b").select("u", "v")
    merged = component_labels(edges)
    joined = nodes.join(merged, nodes["comp"] == merged["node"], "left")
    return joined.select(*(c for c in nodes.columns if c != "comp"), F.coalesce("label", "comp").alias("comp"))


def similar_components(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one per input row.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of ``n_words``-word shingles;
    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links, itself included.
    Texts that are null, empty or without words have an empty set and link with nothing.  Rows that share an id are
    one node; a null id stays null and names a component only if it has no other.  Very long texts are used
    whole.  An empty table gives no rows.  Sets are compared by 64-bit shingle hashes, classes by (size, 128 bits).
    """
    limit = Threshold(*threshold)
    spark = docs.sparkSession
    rows = _slim(docs, id_col, text_col)
    sketched = cut_lineage(sketches(rows, n_words))
    members = sketched.filter("part is null").select("doc_id", "n", "d1", "d2", "keys", "bits")
    reps = members.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    reps = cut_lineage(reps)

    nodes = reps.select("d1", "n", "rep", F.col("rep").alias("comp"))
    for r in range(SEED_ROUNDS):
        nodes = _seed_round(nodes, reps, rows, n_words, limit, r)

    # completeness: tokens that two components share
    classes = spark.sparkContext.broadcast(frequency_classes(sketched).tobytes())
    tokens = prefix_tokens(rows, reps.select(F.col("rep").alias("id")), classes, n_words, limit).repartition("token").sortWithinPartitions("token", "who")
    shared = _shared_tokens(tokens)
    named = nodes.select(F.shiftright("d1", 1).alias("set"), F.col("n").cast("int").alias("n"), "rep", "comp")
    placed = shared.withColumn("set", F.shiftright("who", 1)).join(named, "set").select("token", "comp", "rep", "n", (F.col("who") % 2 != 0).alias("first"))
    by_token = Window.partitionBy("token")
    placed = placed.withColumns({"lo": F.min("comp").over(by_token), "hi": F.max("comp").over(by_token)})
    live = _kept(placed.filter("lo <> hi").drop("lo", "hi"), "live")

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(limit.den / limit.num)) + 1e-9).cast("int")
    probe = live.select("token", "rep", "comp", "n", band.alias("tile_band"), F.lit(False).alias("index"))
    index = live.filter("first").select("token", "rep", "comp", "n", F.explode(F.array(band, band + 1)).alias("tile_band"), F.lit(True).alias("index"))
    tiled = probe.unionByName(index)
    # only tiles where an index row meets a probing row of another component; a large tile is divided
    tiles = tiled.groupBy("token", "tile_band").agg(F.count_if(~F.col("index")).alias("probes"), F.count_if("index").alias("indexed"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    tiles = tiles.filter("probes > 0 and indexed > 0 and lo <> hi").select("token", "tile_band", F.ceil(F.col("probes") / TILE_ROWS).cast("int").alias("salts"), (F.col("probes") > CROWD).alias("crowd"))
    tiled = tiled.join(tiles, ["token", "tile_band"])
    salt = F.when(F.col("index"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")))
    tiled = _kept(tiled.withColumn("salt", F.explode(salt)).drop("salts"), "tiles")
    crowded = _sets_of(tiled.filter("crowd").select(F.col("rep").alias("id")).distinct(), rows, n_words, crowd=True)
    signed = reps.select("rep", F.col("n").cast("int").alias("n"), F.lit(False).alias("crowd"), "bits")
    signed = signed.unionByName(crowded.select(F.col("id").alias("rep"), "n", F.lit(True).alias("crowd"), F.col("set").alias("bits")))
    tiled = tiled.join(signed, ["rep", "n", "crowd"]).select("token", "tile_band", "salt", "index", "rep", "comp", "n", "bits")
    tiled = tiled.repartition("token", "tile_band", "salt").sortWithinPartitions("token", "tile_band", "salt", "index")
    candidates = _kept(_tile_pairs(tiled, limit).distinct(), "candidates")
    links = verified(_kept(bounded(candidates, rows, n_words, limit), "bounded"), rows, n_words, limit)
    final = _united(nodes, links).select("rep", F.col("comp").alias("component_id"))
    out = members.join(reps.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"], "left").select("doc_id", "n", "rep")
    out = out.join(final.select("rep", "component_id").distinct(), "rep", "left")
    back = lambda c: F.nullif(c, F.lit(MISSING_ID))
    return out.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("rep", "doc_id")).alias("class_id"), back(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """The documents (all their columns) whose id names their component: one of every group stays.

    Texts without words are in no group and stay, and so do rows without an id; of rows that repeat an id and
    its text one stays.  One shuffle of the texts, by id.
    """
    kept = similar_components(docs, n_words, threshold).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    same = Window.partitionBy("doc_id", "__text").orderBy("__text")
    named = docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi").withColumn("__text", F.xxhash64("text"))
    named = named.withColumn("__copy", F.row_number().over(same)).filter("__copy = 1").drop("__text", "__copy")
    return named.unionByName(docs.filter("doc_id is null"))

"""Near-duplicate groups by HyperMinHash sketches: banded compressed registers, collision-corrected estimates, exact checks.

A set's shingle hashes fall into ``BUCKETS`` buckets; of each bucket's least hash a register keeps the number of leading
zeros and the next ``MANTISSA`` bits, 16 bits in all.  Equal sets are one class; only classes are compared.

1. Bands of ``ROWS`` registers give keys; classes that share a key are candidates.  At the threshold of 0.85 a pair of
   large sets misses all of the ``BUCKETS / ROWS`` bands with probability (1 - 0.85^6)^42 = 2.3e-9; of small sets most
   bands hold no differing shingle at all.
2. Rounds of stars: every bucket of a third of the bands draws one member, and a class is paired with one of the members
   its buckets drew, unless both are in one component already.  This joins groups of thousands with at most one pair per
   class and round.
3. Completeness: buckets of all bands that still hold two components are compared in full across components, in tiles; a
   pair is looked at in its first common band only.  A class that fits no size in its bucket stays out of the tiles.
4. A candidate's similarity is estimated from the registers that agree, less those that agree by collision.  It is
   dropped only where so low a share of agreeing registers has a probability below e^-``DOUBT`` at the threshold
   (Chernoff bound).  All others are verified on the full sets; crowds that share a passage but are not near copies fail
   before that, where the differing bits of two bitmaps prove that too little is shared.

No bucket, candidate or partner list has a cap.  Band rows are many, so they are shuffled once a step, as four numbers each: a
bucket is one partition of a window, which is sorted and spills, and nothing is built from it in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kelvingrid.llm.common import flat_utf8, mix64, spans_of
from kelvingrid.llm.components import component_labels
from kelvingrid.llm.ngram_join import Signatures, Threshold, digests, signatures, verified
from kelvingrid.llm.shingles import shingle_sets
from kelvingrid.session import written

ROWS, BANDS, MANTISSA = 6, 42, 10
BUCKETS = ROWS * BANDS
#: A candidate is dropped where its estimate has a probability below e^-DOUBT at the threshold.
DOUBT = 20.0
STAR_ROUNDS = 2
#: A round of stars takes every so-manieth band, each round others.
STAR_STRIDE = 3
#: Bits of a class's bitmap: the power of two from 8 times its size on, within these bounds.
SPARSE, BITS = 8, (64, 1 << 14)
#: Probing rows of a tile that one task holds, and pairs compared at a time.
TILE_ROWS, PAIR_ROWS = 2048, 1 << 14
#: Stands for a missing id.
NO_ID = (1 << 63) - 1


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BUCKETS) registers of 16 bits: leading zeros + 1 of the bucket's least value, then its mantissa; 0 where empty."""
    sets = len(offsets) - 1
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(sets * BUCKETS, empty)
    np.minimum.at(least, owner * BUCKETS + bucket, mix64(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
    filled = least != empty
    return np.where(filled, compressed(np.where(filled, least, np.uint64(1))), 0).astype(np.uint16).reshape(sets, BUCKETS)


def compressed(value: np.ndarray) -> np.ndarray:
    """Register of a 64-bit value: leading zeros + 1 (6 bits), then the ``MANTISSA`` bits after the first one bit."""
    _, exponent = np.frexp(value.astype(np.float64))
    # rounding to a double can only reach the next power of two
    top = np.minimum(exponent.astype(np.int64), 64)
    top -= (top > 0) & ((value >> np.maximum(top - 1, 0).astype(np.uint64)) == 0)
    zeros = np.minimum(64 - top, 62)
    after = np.where(zeros < 63, value << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0))
    return ((zeros + 1) << MANTISSA) | (after >> np.uint64(64 - MANTISSA)).astype(np.int64)


def collision_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that the registers of one bucket agree although the least values differ, for sets of sizes a and b.

    The least of n values in a bucket is nearly exponential with rate n / BUCKETS; agreement means to fall into the same
    cell, whose width is 2^-MANTISSA of its power of two.
    """
    x, y = a / BUCKETS, b / BUCKETS
    both = x + y
    out = np.zeros(np.shape(both))
    for z in range(1, 40):
        width = 0.5**z
        out += width * (np.exp(-both * width) - np.exp(-2 * both * width))
    return out * x * y / both / (1 << MANTISSA)


def estimates(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, registers it rests on) of pairs of register rows."""
    used = ((x > 0) | (y > 0)).sum(1)
    equal = ((x == y) & (x > 0)).sum(1)
    chance = collision_share(nx.astype(float), ny.astype(float))
    return np.clip((equal / np.maximum(used, 1) - chance) / (1 - chance), 0.0, 1.0), used


def plausible(estimate: np.ndarray, used: np.ndarray, least: float) -> np.ndarray:
    """False where ``used`` registers would show so low a share with probability below e^-DOUBT at similarity ``least``."""
    e = np.clip(estimate, 1e-12, 1 - 1e-12)
    divergence = e * np.log(e / least) + (1 - e) * np.log((1 - e) / (1 - least))
    return (estimate >= least) | (used * divergence <= DOUBT)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BUCKETS)


NAMES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
SKETCH = pa.schema([*NAMES, ("registers", pa.binary()), ("bits", pa.binary())])


def set_names(rows: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, n, d1, d2) per document: set size and a digest of 128 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat_utf8(b.column(1))
            for lo, hi in spans_of(offsets, 4 << 20):
                hashes, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n_words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, (np.diff(at), *digests(hashes, at)))], schema=NAMES)

    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def sketches(rows: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, n, d1, d2, registers, bits) per document: set size, a digest of 128 bits, registers (null for an empty set), bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat_utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for lo, hi in spans_of(offsets, 4 << 20):
                hashes, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n_words)
                n = np.diff(at)
                d1, d2 = digests(hashes, at)
                for x in range(0, len(n), 1024):
                    y = min(x + 1024, len(n))
                    part, bounds = hashes[at[x] : at[y]], at[x : y + 1] - at[x]
                    raw = registers(part, bounds).astype("<u2").tobytes()
                    blobs = [raw[i * 2 * BUCKETS : (i + 1) * 2 * BUCKETS] if n[x + i] else None for i in range(y - x)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[lo + x : lo + y], n[x:y], d1[x:y], d2[x:y])] + [pa.array(v, pa.binary()) for v in (blobs, signatures(part, bounds, SPARSE, BITS))], schema=SKETCH)

    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, registers binary, bits binary")


def band_keys(x: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of 64 bits, the last 6 of which are the band's number from 1 on; 0 for a band without a filled register."""
    parts = x.reshape(len(x), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mix64(key ^ (parts[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
    return np.where(parts.any(2), key >> np.uint64(6) << np.uint64(6) | np.arange(1, BANDS + 1, dtype=np.uint64), 0)


def banded(nodes: DataFrame, bands: range = range(BANDS)) -> DataFrame:
    """(rep, n, comp, key) for every one of the bands that has a filled register."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                keys = band_keys(_rows(part.column("registers")))[:, bands.start : bands.stop : bands.step]
                at, band = np.nonzero(keys)
                same = [pa.array(part.column(c).to_numpy()[at]) for c in ("rep", "n", "comp")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(keys[at, band].view(np.int64))], names=["rep", "n", "comp", "key"])

    return nodes.select("rep", "n", "comp", "registers").mapInArrow(run, "rep long, n long, comp long, key long")


def _estimated(pairs: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
    """The (a, b) pairs of classes whose estimate does not rule them out."""
    side = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PAIR_ROWS):
                part = b.slice(lo, PAIR_ROWS)
                e, used = estimates(_rows(part.column("r_a")), _rows(part.column("r_b")), part.column("n_a").to_numpy(), part.column("n_b").to_numpy())
                yield part.select(["a", "b"]).filter(pa.array(plausible(e, used, limit.num / limit.den)))

    return both.filter(small * limit.den >= large * limit.num).mapInArrow(run, "a long, b long")


def _united(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (rep, n, comp) with the components that the links (a, b) join."""
    comp = nodes.select("rep", "comp")
    edges = links.join(comp.select(F.col("rep").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("rep").alias("b"), F.col("comp").alias("v")), "b")
    merged = component_labels(edges.select("u", "v"))
    return nodes.join(merged, nodes["comp"] == merged["node"], "left").select("rep", "n", F.coalesce("label", "comp").alias("comp"))


def _stars(named: DataFrame, limit: Threshold, number: int) -> DataFrame:
    """(a, b): every class with one drawn member of its band buckets, if that is of another component.

    Each bucket draws one member; of the members its buckets drew, a class takes the one drawn first.  So there are at most
    as many pairs as classes, whatever the sizes of the groups.
    """
    draw = F.xxhash64("rep", F.lit(number)) if number else F.col("rep")  # the first document is often what the others were made from
    hub = F.first(F.struct("draw", "rep", "n", "comp")).over(Window.partitionBy("key").orderBy("draw", "rep"))
    met = named.withColumn("draw", draw).withColumn("hub", hub).filter(F.col("hub.comp") != F.col("comp"))
    small, large = F.least("hub.n", "n"), F.greatest("hub.n", "n")
    chosen = met.filter(small * limit.den >= large * limit.num).groupBy("rep").agg(F.min("hub").alias("hub"))
    return chosen.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))


def _tiles(named: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
    """Rows of the band buckets that hold two components: as probes of one tile each, as partners of all tiles of the bucket.

    Where neither the next smaller nor the next larger set of the bucket fits in size, none does.
    """
    by_size = Window.partitionBy("key").orderBy("n")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = named.select("*", F.min("comp").over(whole).alias("lo"), F.max("comp").over(whole).alias("hi"), F.count("*").over(whole).alias("c"), F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"))
    fits = (F.col("below") * limit.den >= F.col("n") * limit.num) | (F.col("n") * limit.den >= F.col("above") * limit.num)
    held = seen.filter("lo <> hi").filter(fits).select("rep", "n", "comp", "key", F.ceil(F.col("c") / TILE_ROWS).cast("int").alias("tiles"))
    place = lambda tile, partner: F.struct(tile.alias("tile"), F.lit(partner).alias("partner"))
    own = place(F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"), False)
    every = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: place(t, True))
    dealt = held.withColumn("_place", F.explode(F.concat(F.array(own), every)))
    return dealt.select("rep", "n", "comp", "key", "_place.*").join(classes.select("rep", "registers", "bits"), "rep")


def _tile_pairs(tiles: DataFrame, limit: Threshold) -> DataFrame:
    """Candidate pairs (a, b) of the tiles: different components, sizes that fit, first common band, a plausible estimate,
    bitmaps that leave room for the overlap.

    Rows are sorted by tile with its probes (about ``TILE_ROWS``) first; partners stream past them, ``PAIR_ROWS`` pairs at a time.
    """

    def pairs(tile: np.ndarray, partner: np.ndarray, table: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rep, n, comp, key = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "comp", "key"))
        band = (key & 63) - 1
        held, bitmaps = _rows(table.column("registers")), Signatures(table.column("bits").to_pylist())
        first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        probes = np.add.reduceat((~partner).astype(np.int64), first)
        rows = np.flatnonzero(partner)
        own = np.searchsorted(first, rows, "right") - 1
        begin, count = first[own], probes[own]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 16 * PAIR_ROWS, "right")))
            c = count[lo:hi]
            x = np.repeat(rows[lo:hi], c)
            y = np.repeat(begin[lo:hi], c) + np.arange(c.sum()) - np.repeat(np.r_[0, np.cumsum(c)][:-1], c)
            fit = (comp[x] != comp[y]) & ((n[y] > n[x]) | ((n[y] == n[x]) & (rep[y] > rep[x]))) & limit.sizes_fit(n[x], n[y])
            x, y = x[fit], y[fit]
            for at in range(0, len(x), PAIR_ROWS):
                p, q = x[at : at + PAIR_ROWS], y[at : at + PAIR_ROWS]
                u, v = held[p], held[q]
                shared = ((u == v).reshape(len(p), BANDS, ROWS).all(2) & u.reshape(len(p), BANDS, ROWS).any(2)).argmax(1) == band[p]
                e, used = estimates(u, v, n[p], n[q])
                keep = shared & plausible(e, used, limit.num / limit.den)
                p, q = p[keep], q[keep]
                if len(p):
                    keep = bitmaps.overlap_at_most(p, q, n) >= limit.least_overlap(n[p], n[q])
                    yield rep[p[keep]], rep[q[keep]]
            lo = hi

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # probes of the last tile, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            if carried is not None:
                b = pa.Table.from_batches([carried, b]).combine_chunks().to_batches()[0]
            keys = [b.column(c).to_numpy() for c in ("key", "tile")]
            tile = np.cumsum(np.r_[False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            partner = b.column("partner").to_numpy(zero_copy_only=False)
            for a, c in pairs(tile, partner, b):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
            carried = b.filter(pa.array((tile == tile[-1]) & ~partner))

    ordered = tiles.repartition("key", "tile").sortWithinPartitions("key", "tile", "partner")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n_words: int = 3, threshold: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id, kept), one per input row.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of ``n_words``-word shingles, confirmed on the
    full sets.  ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links, itself
    included, ``kept`` whether the document names its component.  Texts that are null, empty or without words have an
    empty set, link with nothing and are kept.  Rows that share an id are one node; a null id stays null and names a
    component (is kept) only if it has no other.  Very long texts are used whole; other columns are ignored; an empty table gives
    no rows.  Sets are compared by 64-bit shingle hashes, classes by (size, 128 bits).
    """
    limit = Threshold(*threshold)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    classes = sketches(rows, n_words).filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.first("bits").alias("bits"))
    classes = written(classes, "classes")
    nodes, known = classes.select("rep", "n", F.col("rep").alias("comp")), classes.withColumn("comp", F.col("rep"))
    for number in range(STAR_ROUNDS):
        named = banded(known, range(number % STAR_STRIDE, BANDS, STAR_STRIDE))
        pairs = written(_estimated(_stars(named, limit, number), classes, limit), "stars")
        nodes = written(_united(nodes, verified(pairs, rows, n_words, limit)), "nodes")
        known = nodes.join(classes.select("rep", "registers"), "rep")
    pairs = written(_tile_pairs(_tiles(banded(known), classes, limit), limit), "pairs")
    nodes = written(_united(nodes, verified(pairs, rows, n_words, limit)), "nodes")

    # names are made again here, as sketches of all rows would have to be kept for them
    out = set_names(rows, n_words).join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"], "left")
    # rows that share an id but not their sets may stand in several classes and components
    ids = nodes.groupBy("rep").agg(F.min("comp").alias("comp"))
    out = out.join(ids, "rep", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("comp", "doc_id").alias("comp"))
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("rep").alias("class_id"), back("comp").alias("component_id"), (F.col("doc_id") == F.col("comp")).alias("kept"))

"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every window of three bytes is hashed into one of ``BUCKETS`` buckets.  A bucket is coded with two bits, the
quartile its count falls into among all buckets of the document.  The digest holds a length code (logarithmic),
the ratios of the quartiles and the bucket codes.  Two digests are compared by a difference score that is
bounded by ``BOUND``, read as a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kelvingrid.llm.common import flat_utf8, spans_of
from kelvingrid.llm.sharding import range_of, sampled_splitters
from kelvingrid.session import cut_lineage

BUCKETS = 256
#: The difference of unrelated digests: a bucket pair differs by 1.625 on average.
BOUND = 416.0
#: Cost of codes that lie 0 to 3 quartiles apart; a full swing counts double.
STEP_COST = np.array([0, 1, 2, 6], np.int64)
LENGTH_STEPS, LENGTH_COST_MOST, RATIO_COST = 16, 64, 2
#: Bytes of text in one range of neighbouring documents, and the most ranges there are; a range is streamed, so it may be larger.
RANGE_BYTES, RANGES_MOST = 16 << 20, 1 << 16


def digest_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: length code (2 bytes), two quartile ratios, and the packed bucket codes."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, 4 + BUCKETS // 4), np.uint8)
    code = np.rint(LENGTH_STEPS * np.log2(1.0 + lengths)).astype(np.int64)
    out[:, 0], out[:, 1] = code >> 8, code & 255
    for lo, hi in spans_of(offsets):
        part = data[offsets[lo] : offsets[hi]].astype(np.uint32)
        if len(part) < 3:
            continue
        triple = (part[:-2] | (part[1:-1] << np.uint32(8)) | (part[2:] << np.uint32(16))) * np.uint32(2654435761)
        triple ^= triple >> np.uint32(15)
        bucket = ((triple * np.uint32(2246822519)) >> np.uint32(24)).astype(np.int64)
        owner = np.repeat(np.arange(hi - lo), lengths[lo:hi])
        whole = owner[:-2] == owner[2:]  # no triplet reaches into the next text
        counts = np.bincount((owner[:-2] * BUCKETS + bucket)[whole], minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        ranked = np.sort(counts, axis=1)
        q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
        quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
        four = quartile.reshape(hi - lo, BUCKETS // 4, 4)
        out[lo:hi, 4:] = four[:, :, 0] | (four[:, :, 1] << 2) | (four[:, :, 2] << 4) | (four[:, :, 3] << 6)
        top = np.maximum(q3[:, 0], 1)
        out[lo:hi, 2], out[lo:hi, 3] = q1[:, 0] * 255 // top, q2[:, 0] * 255 // top
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for digests that differ by ``BOUND`` or more; a and b hold one digest per row."""
    shifts = np.array([0, 2, 4, 6], np.uint8)
    apart = np.abs(((a[:, 4:, None] >> shifts) & 3).astype(np.int64) - ((b[:, 4:, None] >> shifts) & 3))
    score = STEP_COST[apart].sum(axis=(1, 2)).astype(np.float64)
    length = np.abs((a[:, 0].astype(np.int64) * 256 + a[:, 1]) - (b[:, 0].astype(np.int64) * 256 + b[:, 1]))
    ratios = np.abs(a[:, 2:4].astype(np.int64) - b[:, 2:4]).sum(axis=1) / 16
    score += np.minimum(length, LENGTH_COST_MOST) + RATIO_COST * ratios
    return 1.0 - np.minimum(score, BOUND) / BOUND


def fingerprint_texts(texts: pa.Array) -> list[str]:
    return [r.tobytes().hex() for r in digest_codes(*flat_utf8(texts))]


def compare_fingerprints(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Likeness of two columns of hex fingerprints; null beside null is 1, null beside a fingerprint 0."""
    x, y = a.to_pylist(), b.to_pylist()
    blank = "00" * (4 + BUCKETS // 4)
    rows = lambda v: np.array([np.frombuffer(bytes.fromhex(s or blank), np.uint8) for s in v]).reshape(len(v), -1)
    out = likeness(rows(x), rows(y)) if x else np.zeros(0)
    return np.where([(p is None) != (q is None) for p, q in zip(x, y)], 0.0, out)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row; a null text counts as empty, an empty text has the all-zero fingerprint."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_texts(b.column(1)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def neighbour_ranges(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(bucket, halo, tie, doc_id, text): id ranges of about ``RANGE_BYTES``; each also gets the row that follows its last one.

    The order is descending id, then text; after the last row comes the first.  Null ids come last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sizes = cut_lineage(rows.select("doc_id", "tie", F.lit(0).cast("long").alias("zero"), (F.octet_length("text").cast("long") + 8).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # the id is the key here; documents that share one id stay together
    picked = sampled_splitters(sizes, "tie", "zero", "size", max(1, min(RANGES_MOST, -(-total // RANGE_BYTES))), total, seed)
    splitters = [(k, 0) for k in sorted({k for k, _ in picked})]
    bucket = range_of(splitters, "tie", "zero")
    tops = sizes.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("tie").alias("top")).collect()  # a row per range
    tops = sorted((r["bucket"], r["top"]) for r in tops)
    halo = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]  # the lowest range is followed by the highest id
    spark = docs.sparkSession
    wanted = spark.createDataFrame(halo, "tie long, bucket long")  # at most RANGES_MOST rows
    own = rows.withColumn("zero", F.lit(0).cast("long")).withColumn("bucket", bucket).select("bucket", F.lit(False).alias("halo"), "tie", "doc_id", "text")
    after = rows.join(F.broadcast(wanted), "tie").select("bucket", F.lit(True).alias("halo"), "tie", "doc_id", "text")
    return own.unionByName(after)


def edited_fingerprints(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Fingerprints of every text and of its edited twin, with their likeness and that to the next document.

    The edited text is the text with its last floor(n / 3) code points replaced by the first as many (or all) of
    the next document in descending doc_id order; the first follows the last.  Null text: empty.  Repeated ids
    are ordered by text.  An empty table gives no rows; a single document is its own next.  Whole texts are
    used.  One shuffle of the texts by id range, then one streaming pass with a batch in memory.
    """
    ranges = neighbour_ranges(docs, seed)
    ordered = ranges.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc("tie"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, halo, id, text, digest of the row before
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text").to_pylist()
            digests = digest_codes(*flat_utf8(b.column("text")))
            buckets, halos, ids = b.column("bucket").to_pylist(), b.column("halo").to_pylist(), b.column("doc_id").to_pylist()
            if last is not None:
                buckets, halos, ids, texts = [last[0], *buckets], [last[1], *halos], [last[2], *ids], [last[3], *texts]
                digests = np.vstack([last[4][None], digests])
            last = (buckets[-1], halos[-1], ids[-1], texts[-1], digests[-1])
            at = [i for i in range(len(ids) - 1) if not halos[i] and buckets[i] == buckets[i + 1]]
            for lo in range(0, len(at), 2048):
                yield pairs(at[lo : lo + 2048], ids, texts, digests)

    def pairs(at, ids, texts, digests) -> pa.RecordBatch:
        edited = []
        for i in at:
            k = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
        raw = [e.encode() for e in edited]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        own, following = digests[at], digests[[i + 1 for i in at]]
        new = digest_codes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        columns = [
            [ids[i] for i in at], [len(texts[i]) for i in at], [hashlib.sha256(r).hexdigest() for r in raw],
            [d.tobytes().hex() for d in own], [d.tobytes().hex() for d in new], likeness(own, new), likeness(own, following),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT)], schema=OUT)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Quality classifier: regularised quadratic discriminant analysis on transformed document statistics.

Class means and covariances come from sums over all labelled training rows (never from a sample).  Covariances
are shrunk to the pooled diagonal; their Cholesky factors are computed once and kept in the model, so a score
is two triangular products a row: the difference of the Mahalanobis log-densities, squashed to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kelvingrid.llm.common import flat_utf8, frugal, spans_of
from kelvingrid.session import cut_lineage

#: Byte classes whose shares are features: a name and the bytes in it; what is left over is "control".
CLASSES = [
    ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", bytes(range(48, 58))), ("space", b" \t"), ("newline", b"\n\r"),
    ("stop", b".?"), ("comma", b",;:"), ("quote", b"'\"()-"), ("shout", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@^~+=_/\\"), ("bracket", b"<>{}[]`"),
    ("wide", bytes(range(128, 256))),
]
NAMES = [*(n for n, _ in CLASSES), "control", "log_bytes", "word_mean", "word_spread", "long_words", "triples", "log_line", "upper_words", "echoes"]
D = len(NAMES)


def _class_table() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    for i, (_, members) in enumerate(CLASSES):
        out[list(members)] = i
    return out


CLASS_OF = _class_table()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``D`` transformed statistics per text: square roots of shares, logarithms of sizes.  All 0 for an empty text."""
    n, k = len(offsets) - 1, len(CLASSES) + 1
    out = np.zeros((n, D))
    for lo, hi in spans_of(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if not len(part):
            continue
        m, lengths = hi - lo, np.diff(offsets[lo : hi + 1])
        owner = np.repeat(np.arange(m), lengths)
        kind = CLASS_OF[part]
        shares = np.bincount(owner * k + kind, minlength=m * k).reshape(m, k)
        size = np.maximum(lengths, 1)[:, None]
        rows = out[lo:hi]
        rows[:, :k] = np.sqrt(shares / size)
        rows[:, k] = np.log1p(lengths) / 4
        blank = (kind == 3) | (kind == 4)
        edge = np.r_[True, owner[1:] != owner[:-1]]
        starts = np.flatnonzero(~blank & (edge | np.r_[True, blank[:-1]]))
        ends = np.flatnonzero(~blank & (np.r_[edge[1:], True] | np.r_[blank[1:], True])) + 1
        long, whose = (ends - starts).astype(np.float64), owner[starts]
        words = np.maximum(np.bincount(whose, minlength=m), 1)
        mean = np.bincount(whose, long, m) / words
        rows[:, k + 1] = np.log1p(mean)
        rows[:, k + 2] = np.log1p(np.sqrt(np.maximum(np.bincount(whose, long * long, m) / words - mean * mean, 0)))
        rows[:, k + 3] = np.sqrt(np.bincount(whose, long > 12, m) / words)
        same = (part[2:] == part[1:-1]) & (part[1:-1] == part[:-2]) & (owner[2:] == owner[:-2])
        rows[:, k + 4] = np.sqrt(np.bincount(owner[2:][same], minlength=m) / size[:, 0])
        rows[:, k + 5] = np.log1p(lengths / (shares[:, 4] + 1)) / 4
        total = np.r_[0, np.cumsum(part.astype(np.int64) * (part.astype(np.int64) + 7))]
        mark = total[ends] - total[starts]  # equal for equal words
        echo = (mark[1:] == mark[:-1]) & (long[1:] == long[:-1]) & (whose[1:] == whose[:-1])
        rows[:, k + 7] = np.sqrt(np.bincount(whose[1:][echo], minlength=m) / words)
        rows[:, k + 6] = np.sqrt(np.bincount(whose, kind[starts] == 1, m) / words)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one pass over the whole texts; null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*flat_utf8(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The rows that labels are never learnt from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor of the shrunk covariance, log-determinant, log prior."""

    means: np.ndarray
    whiten: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    constant: float | None = None
    temper: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [
            self.log_priors[k] - 0.5 * self.log_dets[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)
        ]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temper, -60, 60)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, floor: float = 1e-4, temper: float = 4.0) -> Discriminant:
    """From (count, sum, sum of outer products) per class.  With a class missing the score is the share of label 1 (0.5 without labels)."""
    counts = [moments[k][0] if k in moments else 0 for k in (0, 1)]
    if min(counts) < 2:
        share = counts[1] / sum(counts) if sum(counts) else 0.5
        return Discriminant(np.zeros((2, D)), np.zeros((2, D, D)), np.zeros(2), np.zeros(2), share)
    means = np.array([moments[k][1] / counts[k] for k in (0, 1)])
    covs = [moments[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(c * n for c, n in zip(covs, counts)) / sum(counts)
    target = np.diag(np.maximum(np.diag(pooled), floor))
    factors = [np.linalg.cholesky((1 - shrink) * c + shrink * target + floor * 0.1 * np.eye(D)) for c in covs]
    return Discriminant(
        means, np.array([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(np.diag(f)).sum() for f in factors]),
        np.log(np.array(counts) / sum(counts)), None, temper,
    )


def class_moments(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over all labelled rows outside the held-out fold; partial sums per partition, then per position."""
    train = stats.filter(~held_out(F.col("doc_id"))).join(labels, "doc_id").filter(F.col("label").isin(0, 1)).select("label", "x")

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            for k in np.unique(y):
                rows = x[y == k]
                sums[int(k)] = sums.get(int(k), 0) + np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["label", "v"])

    parts = train.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(partial, "label int, v array<double>")
    totals = parts.select("label", F.posexplode("v").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 (1 + D + D * D) rows
    out = {}
    for k in {r["label"] for r in totals}:
        v = np.zeros(1 + D + D * D)
        for r in totals:
            if r["label"] == k:
                v[r["at"]] = r["v"]
        out[k] = (v[0], v[1 : 1 + D], v[1 + D :].reshape(D, D))
    return out


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """The model of the labelled rows among ``stats``; labels that are null or not 0 or 1 are skipped."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return fit(class_moments(stats, named))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted): one per document, scores from the whole text alone.

    ``labels`` holds (doc_id, ``label_col`` 0 or 1); null or other labels are skipped, repeated label rows count
    each, ids without a document are ignored.  Null and empty texts get the score of an all-zero statistics
    row; repeated documents get one row each; empty tables give no rows.  Extra columns are not read.  The texts are
    read once; only the statistics (``D`` numbers a document) are joined with the labels.
    """
    stats = cut_lineage(document_statistics(docs))
    model = train(stats, labels, label_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """The documents (all their columns) that are not rejected: score at least ``threshold``.

    Whole rows pass through the workers as Arrow batches and are filtered there, a bounded part at a time; texts are
    neither shuffled nor turned into Python strings.
    """
    model = train(cut_lineage(document_statistics(docs)), labels, label_col)
    place = docs.columns.index("text")

    def good(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat_utf8(b.column(place))
            for lo, hi in spans_of(offsets):
                keep = model.scores(statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) >= threshold
                yield b.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(frugal(good), docs.schema)

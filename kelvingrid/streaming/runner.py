"""Running a streaming plan over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kelvingrid.session import scratch_path


#: Files of a micro-batch when a backlog is replayed (in time order: of one time range, about).
FILES_PER_BATCH = 64
#: Seconds between two looks at the reports of a running stream.
REPORT_SECONDS = 2


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """File stream with a declared schema; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


#: Counts of a micro-batch: its number, rows read, rows that its stateful operators left out as later than the watermark.
PROGRESS = "run string, batch bigint, n_in bigint, n_late bigint"


def drain(stream: DataFrame, out: str, checkpoint: str) -> list[tuple[str, int, int, int]]:
    """Process everything available, exactly once, into the parquet table ``out``; returns the ``PROGRESS`` rows of this run.

    Spark keeps the reports of the latest micro-batches only, so they are gathered while the run goes on.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    found: dict[tuple[str, int], tuple[int, int]] = {}
    done = False
    while not done:
        done = query.awaitTermination(REPORT_SECONDS)
        for p in query.recentProgress:
            # a batch may report more than once: its last report counts
            found[str(p["runId"]), p["batchId"]] = (p["numInputRows"], sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]))
    return [(*key, *counts) for key, counts in sorted(found.items())]


def drained(stream: DataFrame, label: str) -> DataFrame:
    """``drain`` into a new folder of the shared scratch space and read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    drain(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def time_ranges(rows: DataFrame, order: str, files_per_batch: int) -> list[DataFrame]:
    """Stored ``rows`` in adjoining ranges of ``order``, oldest first, each of about ``files_per_batch`` files; nulls are in the first."""
    n = -(-len(rows.inputFiles()) // files_per_batch)
    cuts = sorted(set(rows.approxQuantile(order, [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    c = F.col(order)
    # part 0 lies below the first cut
    ends = [(c >= lo if lo is not None else F.lit(True)) & (c < hi if hi is not None else F.lit(True)) for lo, hi in zip([None, *cuts], [*cuts, None])]
    return [rows.filter(end | c.isNull() if k == 0 else end) for k, end in enumerate(ends)]


def replayed(
    arrivals: Iterable[DataFrame],
    plan: Callable[[DataFrame], DataFrame],
    label: str,
    files_per_batch: int = FILES_PER_BATCH,
    order: str | None = "slot",
    progress: list | None = None,
) -> DataFrame:
    """Let tables arrive one after another and drain after each arrival.

    One checkpoint serves all rounds, so state and progress carry over.  A large arrival is handed on by ranges of ``order``,
    oldest first, and a range is one micro-batch: files are not in time order, so a split by files would move the watermark past
    rows of the same arrival.  ``order`` None is for plans without a watermark.
    The ``PROGRESS`` rows of all rounds, one per micro-batch, are added to ``progress``.
    """
    base, out = None, None
    for k, part in enumerate(arrivals):
        spark = part.sparkSession
        if base is None:
            base = scratch_path(spark, label)
        if order is None:
            pieces = [part]
        else:
            part.write.parquet(f"{base}/arrived/{k}")
            pieces = time_ranges(spark.read.schema(part.schema).parquet(f"{base}/arrived/{k}"), order, files_per_batch)
        for piece in pieces:
            piece.write.mode("append").parquet(f"{base}/in")
            stream = plan(table_stream(spark, f"{base}/in", part.schema, files_per_batch=None if order else files_per_batch))
            reports = drain(stream, f"{base}/out", f"{base}/state")
            if progress is not None:
                progress.extend(reports)
            out = stream.schema
    return spark.read.schema(out).parquet(f"{base}/out")


def late_counts(spark: SparkSession, progress: list) -> DataFrame:
    """(n_in, n_late, n_batches) over the micro-batches of ``drain`` or ``replayed``.

    ``n_late`` counts rows as the stateful operator meets them: input rows for de-duplication and custom state, partial
    aggregates for windowed aggregations.
    """
    rows = spark.createDataFrame(progress, PROGRESS)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.agg(total("n_in"), total("n_late"), F.count_if(F.col("n_in") > 0).alias("n_batches"))


def in_time_order(obs: DataFrame, cuts: list[int]) -> list[DataFrame]:
    """Parts of ``obs`` between the given slots (first cut exclusive upper bound of the first part)."""
    edges = [None, *cuts, None]
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        part = obs
        if lo is not None:
            part = part.filter(F.col("slot") >= lo)
        if hi is not None:
            part = part.filter(F.col("slot") < hi)
        parts.append(part)
    return parts


def with_stragglers(obs: DataFrame, cuts: list[int], late_slots: int) -> list[DataFrame]:
    """As ``in_time_order``, but every third of the last ``late_slots`` slots before a cut arrives with the next part."""
    slot = F.col("slot")
    part = F.lit(0)
    for c in cuts:
        part = part + F.when(slot >= c, 1).when((slot >= c - late_slots) & (F.pmod(slot, F.lit(3)) == 1), 1).otherwise(0)
    return [obs.filter(part == k) for k in range(len(cuts) + 1)]

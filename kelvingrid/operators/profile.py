"""Table and column profiles, grid validation, run-against-run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from kelvingrid.functions.quantiles import exact_quantiles
from kelvingrid.functions.scalars import pct_change
from kelvingrid.functions.timeaxis import TimeAxis

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def melt_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.column", "_p.x")


def column_profile(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """count, missing, mean, median, sample std, min, q25, q75, max per numeric column."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in keys])
    long = melt_numeric(df, columns, keys)
    by = [*keys, "column"]
    basic = {
        "count": F.count("_x"),
        "missing": F.count_if(F.col("_x").isNull()),
        "mean": F.avg("_x"),
        "std": F.stddev_samp("_x"),
        "min": F.min("_x"),
        "max": F.max("_x"),
    }
    q = exact_quantiles(long, by, "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}, extras=basic)
    return q.select(*by, "count", "missing", "mean", "median", "std", "min", "q25", "q75", "max")


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and rows that repeat an earlier row."""
    missing = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(missing * F.col("_c")), F.lit(0)).alias("missing_values_total"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def usable_groups(df: DataFrame, candidates: Sequence[str], max_categories: int | None = None) -> list[str]:
    """Candidate columns that are present; with ``max_categories`` those with at most as many distinct values (null counts)."""
    found = [c for c in candidates if c in df.columns]
    if not found or max_categories is None:
        return found
    counts = df.agg(
        *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in found]
    ).first()
    return [c for c in found if (counts[c] or 0) <= max_categories]


def grouped_profile(df: DataFrame, candidates: Sequence[str], max_categories: int | None = None) -> DataFrame:
    """(group_column, group_value, column, mean, median, std) for all usable groups in one pass."""
    groups = usable_groups(df, candidates, max_categories)
    if not groups:
        raise ValueError("no column to group by")
    numeric = [c for c in numeric_columns(df) if c not in groups]
    tags = F.array(*[F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("group_value")) for g in groups])
    tagged = df.select(*numeric, F.explode(tags).alias("_g")).select(*numeric, "_g.*")
    prof = column_profile(tagged, ["group_column", "group_value"], numeric)
    return prof.select("group_column", "group_value", "column", "mean", "median", "std")


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common numeric columns of two runs side by side."""
    common = sorted(set(numeric_columns(left)) & set(numeric_columns(right)))
    both = left.select(F.lit("a").alias("run"), *common).unionByName(right.select(F.lit("b").alias("run"), *common))
    prof = column_profile(both, ["run"], common)
    at = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    wide = prof.groupBy("column").agg(
        *[at(r, c).alias(f"{r}_{c}") for c in ("mean", "median", "std", "missing") for r in ("a", "b")]
    )
    diff = lambda c: (F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_difference")
    return wide.select(
        "column",
        *[x for c in ("mean", "median", "std") for x in (F.col(f"a_{c}"), F.col(f"b_{c}"), diff(c))],
        "a_missing",
        "b_missing",
        pct_change(F.col("a_mean"), F.col("b_mean")).alias("mean_pct_change"),
    )


def largest_changes(comparison: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` columns by absolute and by percent change of the mean."""

    def top(kind: str, col: str) -> DataFrame:
        return (
            comparison.filter(F.col(col).isNotNull())
            .orderBy(F.abs(F.col(col)).desc(), "column")
            .limit(n)
            .select(F.lit(kind).alias("kind"), "column", "mean_difference", "mean_pct_change")
        )

    return top("largest_mean_difference", "mean_difference").unionByName(
        top("largest_percentage_change", "mean_pct_change")
    )


def _column_fill(df: DataFrame, side: str) -> DataFrame:
    """(column, n_<side>) with the number of non-null values of every column."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(f"n_{side}")) for c in df.columns])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def compare_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column, side, n_left, n_right), side = only_left / only_right / common."""
    a, b = _column_fill(left, "left"), _column_fill(right, "right")
    side = (
        F.when(F.col("n_right").isNull(), "only_left").when(F.col("n_left").isNull(), "only_right").otherwise("common")
    )
    return a.join(b, "column", "full").select("column", side.alias("side"), "n_left", "n_right")


def column_listing(df: DataFrame) -> DataFrame:
    """Columns with type, row count and estimated bytes of the fixed-width part."""
    spark = df.sparkSession
    width = {"double": 8, "bigint": 8, "timestamp_ntz": 8, "timestamp": 8, "int": 4, "float": 4, "boolean": 1}
    listing = spark.createDataFrame(
        [(i, n, t, width.get(t)) for i, (n, t) in enumerate(df.dtypes)], "pos int, column string, type string, width int"
    )
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return listing.select("pos", "column", "type", rows.alias("n_rows"), (rows * F.col("width")).alias("n_bytes"))


def null_profile(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.count("v").alias("n_valid"),
        F.try_divide(F.count_if(F.col("v").isNull()) * 100.0, F.count(F.lit(1))).alias("pct_missing"),
    )


def timeline_profile(obs: DataFrame) -> DataFrame:
    return obs.agg(
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots")
    )


def wide_table(obs: DataFrame, pixels: Sequence[str]) -> DataFrame:
    """One column per listed pixel, one row per slot."""
    return (
        obs.filter(F.col("pixel_id").isin(list(pixels)))
        .groupBy("slot")
        .pivot("pixel_id", list(pixels))
        .agg(F.first("v", ignorenulls=True))
        .select("slot", *[F.col(p).alias(f"p_{p}") for p in pixels])
    )


def preview(obs: DataFrame, pixels: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` slots of a few pixels; only those rows are pivoted."""
    head = obs.select("slot").distinct().orderBy("slot").limit(n)
    last = head.agg(F.max("slot")).scalar()
    return wide_table(obs.filter(F.col("slot") <= last), pixels)


def validate_grid(grid: DataFrame, pixel_dim: DataFrame, axis: TimeAxis, ts: str = "ts") -> DataFrame:
    """(name, ok, detail) for the rules a stored grid must meet.

    Slots are taken from the stored timestamps.  A constant step needs no
    ordering: slots are unique, on the axis, and span exactly their count.
    """
    on = axis.on_grid(F.col(ts))
    per_slot = grid.groupBy(ts).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("pixel_id").alias("pixels"),
        F.min(on).alias("on"),
    )
    dims = pixel_dim.agg(F.count(F.lit(1)).alias("np"), F.count_distinct("pixel_id").alias("nu"))
    slot = axis.slot(F.col(ts))
    stat = per_slot.agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("pixels")), F.lit(0)).alias("n_dups"),
        F.min("pixels").alias("min_p"),
        F.max("pixels").alias("max_p"),
        F.count_if(~F.col("on")).alias("n_off"),
        (F.max(slot) - F.min(slot) + 1).alias("n_span"),
    ).select("*", dims.select("np").scalar().alias("np"), dims.select("nu").scalar().alias("nu"))
    rule = lambda name, ok, detail: F.struct(
        F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("bigint").alias("detail")
    )
    c = F.col
    rules = F.array(
        rule("not_empty", (c("n_slots") > 0) & (c("np") > 0), c("n_rows")),
        rule("one_row_per_cell", c("n_dups") == 0, c("n_dups")),
        rule("all_pixels_each_time", (c("min_p") == c("np")) & (c("max_p") == c("np")), c("min_p")),
        rule("on_axis", c("n_off") == 0, c("n_off")),
        rule("constant_step", (c("n_off") == 0) & (c("n_span") == c("n_slots")), c("n_span")),
        rule("unique_pixels", c("nu") == c("np"), c("nu")),
    )
    return stat.select(F.explode(rules).alias("r")).select("r.*")


def bias_by_hour(detail: DataFrame, axis_time: str = "target_time", first: int = 12, last: int = 18, models=None,
                 label: str = "label") -> DataFrame:
    """Signed bias, MAE and count per (label, model, local hour) in a step range."""
    from kelvingrid.functions.scalars import local_hour

    rows = detail.filter(F.col("step").between(first, last))
    if models is not None:
        rows = rows.filter(F.col("model").isin(list(models)))
    return rows.groupBy(label, "model", local_hour(F.col(axis_time)).alias("hour_wib")).agg(
        F.avg(F.col("y_pred") - F.col("y_true")).alias("bias"),
        F.avg("abs_error").alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


def worst_hours(bias: DataFrame, n: int = 3, label: str = "label") -> DataFrame:
    """The ``n`` hours with the largest absolute bias per (label, model); a group has 24 rows."""
    w = Window.partitionBy(label, "model").orderBy(F.abs("bias").desc(), "hour_wib")
    return bias.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def bias_pivot(bias: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    return (
        bias.groupBy("model", "hour_wib")
        .pivot(label, list(labels))
        .agg(F.avg("bias"))
        .select("model", "hour_wib", *[F.col(f"`{x}`").alias("bias_" + x.replace("=", "_").replace(".", "_")) for x in labels])
    )

"""Per-series windows that never put a whole series into one task.

A series (one pixel) can be arbitrarily long, so the window operators do not
partition by pixel alone.  Time is cut into blocks of slots; a row is copied to
each block whose frames reach it (the *halo*, a few slots), and the window runs
per (pixel, block).  Anything cumulative over a whole series is a two-level
scan: running values inside a block plus the total of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLOCK = 8192
KEYS = ("pixel_id",)


def block_of(slot: Column, block: int = BLOCK) -> Column:
    return F.floor(slot / F.lit(block))


def with_halo(df: DataFrame, back: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Rows copied to every block whose frames [slot-back, slot+ahead] touch them.

    ``_own`` marks the copy in the row's home block; only those are kept in results.
    """
    slot = F.col("slot")
    touched = F.sequence(block_of(slot - F.lit(ahead), block), block_of(slot + F.lit(back), block))
    return df.select("*", F.explode(touched).alias("_block")).withColumn(
        "_own", F.col("_block") == block_of(slot, block)
    )


def framed(
    df: DataFrame,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    block: int = BLOCK,
    keep: Column | None = None,
    number: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``back``/``ahead`` slots in a series.

    ``columns`` gets the window (ordered by slot) and returns named expressions,
    so all of them share one shuffle and one sort.  ``keep`` filters the result.
    ``number`` adds, per name, the 0-based position of a row among the rows of
    its series that meet the condition (which must imply ``keep``): counted in
    the blocks on the same partitioning, carried across blocks by a join with
    one row per (series, block).
    """
    keys = list(keys)
    window = Window.partitionBy(*keys, "_block").orderBy("slot")
    added = [expr.alias(name) for name, expr in columns(window).items()]
    out = with_halo(df, back, ahead, block).select("*", *added)
    number = dict(number or {})
    if number:
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.select(
            "*",
            *[F.sum(F.when(F.col("_own") & c, 1).otherwise(0)).over(upto).alias(f"_run_{n}") for n, c in number.items()],
        )
    out = out.filter(F.col("_own") if keep is None else F.col("_own") & keep)
    if number:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            out.groupBy(*keys, "_block")
            .agg(*[F.max(f"_run_{n}").alias(f"_run_{n}") for n in number])
            .select(
                *keys,
                "_block",
                *[F.coalesce(F.sum(f"_run_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in number],
            )
        )
        out = out.join(carried, [*keys, "_block"])
        out = out.withColumns({n: F.col(f"_before_{n}") + F.col(f"_run_{n}") - 1 for n in number})
        out = out.drop(*[f"_{x}_{n}" for n in number for x in ("run", "before")])
    return out.drop("_block", "_own")


def series_scan(
    df: DataFrame,
    running: Mapping[str, Column],
    totals: Mapping[str, Column] | None = None,
    keys: Sequence[str] = KEYS,
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running sums (``running``) and whole-series sums (``totals``).

    The block totals are one row per (series, block); only they are ever ordered
    along a whole series.
    """
    totals = dict(totals or {})
    keys = list(keys)
    home = df.withColumn("_block", block_of(F.col("slot"), block))
    per_block = home.groupBy(*keys, "_block").agg(
        *[F.sum(e).alias(f"_r_{n}") for n, e in running.items()],
        *[F.sum(e).alias(f"_t_{n}") for n, e in totals.items()],
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys,
        "_block",
        *[F.sum(f"_r_{n}").over(before).alias(f"_b_{n}") for n in running],
        *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals],
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy("slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = home.select("*", *[F.sum(e).over(inside).alias(f"_l_{n}") for n, e in running.items()])
    joined = local.join(carried, [*keys, "_block"])
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_b_{n}"), zero) + F.coalesce(F.col(f"_l_{n}"), zero)).alias(n) for n in running],
        *totals,
    )


def asof_join(
    requests: DataFrame,
    events: DataFrame,
    payload: Sequence[str],
    keys: Sequence[str] = KEYS,
    block: int = BLOCK,
) -> DataFrame:
    """Latest event at or before each request's slot.

    ``requests`` has keys and ``slot``; ``events`` has keys, ``slot`` and the
    payload columns.  Result: request columns + ``event_slot`` + payload, null
    where a series has no event yet.  Same two-level scan as the sums, with
    "last event" in place of "+".
    """
    keys = list(keys)
    found = F.struct(F.col("slot").alias("event_slot"), *payload)
    ev = events.select(*keys, "slot", F.lit(0).alias("_kind"), found.alias("_hit"))
    extra = [c for c in requests.columns if c not in (*keys, "slot")]
    both = requests.select(
        *keys, "slot", F.lit(1).alias("_kind"), F.struct(F.lit(True).alias("_r"), *extra).alias("_req")
    ).unionByName(ev, allowMissingColumns=True)
    both = both.withColumn("_block", block_of(F.col("slot"), block))
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy("slot", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = both.withColumn("_in", F.last("_hit", ignorenulls=True).over(inside)).filter("_kind = 1")
    ends = ev.groupBy(*keys, block_of(F.col("slot"), block).alias("_block")).agg(
        F.max_by("_hit", "slot").alias("_end")
    )
    asked = requests.select(*keys, block_of(F.col("slot"), block).alias("_block")).distinct()
    along = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        asked.join(ends, [*keys, "_block"], "full")
        .select(*keys, "_block", F.last("_end", ignorenulls=True).over(along).alias("_before"))
    )
    hit = F.coalesce("_in", "_before")
    return local.join(carried, [*keys, "_block"], "left").select(
        *keys,
        "slot",
        *[F.col(f"_req.{c}").alias(c) for c in extra],
        *[hit[c].alias(c) for c in ("event_slot", *payload)],
    )

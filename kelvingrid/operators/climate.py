"""Climatology: local-time cycle, risk shares, onset events, distribution, autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec, functions as F

from kelvingrid.functions.scalars import CLEAR_LIMIT, COLD_LIMIT, local_hour, risk_code
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators.blocks import BLOCK, framed, series_scan
from kelvingrid.operators.samples import valid_rows


def diurnal_cycle(obs: DataFrame, axis: TimeAxis) -> DataFrame:
    """Mean over pixels per slot first, then mean / sample std / count per local hour."""
    per_slot = obs.groupBy("slot").agg(F.avg("v").alias("m"))
    hour = local_hour(axis.time(F.col("slot")))
    return per_slot.groupBy(hour.alias("hour_wib")).agg(
        F.avg("m").alias("mean_ctt"), F.stddev_samp("m").alias("std_ctt"), F.count("m").alias("n_obs")
    )


def coldest_hour(profile: DataFrame) -> DataFrame:
    """Hour with the lowest mean; the earlier hour wins a tie."""
    best = profile.agg(F.min(F.struct("mean_ctt", "hour_wib")).alias("b"))
    return best.select(F.col("b.hour_wib").alias("hour_wib"), F.col("b.mean_ctt").alias("mean_ctt"))


def risk_shares(obs: DataFrame, low: float = COLD_LIMIT, high: float = CLEAR_LIMIT, by: tuple = ()) -> DataFrame:
    """Shares of the three half-open classes over non-null values."""
    v = F.col("v")
    share = lambda c: F.avg(c.cast("double"))
    return obs.groupBy(*by).agg(
        share(v < low).alias("deep_convective"),
        share((v >= low) & (v < high)).alias("moderate_cloud"),
        share(v >= high).alias("clear"),
        F.count("v").alias("n_obs"),
    )


def status_counts(forecast: DataFrame, low: float = COLD_LIMIT, high: float = CLEAR_LIMIT) -> DataFrame:
    """Safe / watch / danger pixel counts and MAE per step."""
    code = risk_code(F.col("y_pred"), low, high)
    return forecast.groupBy("step").agg(
        F.count_if(code == 0).alias("n_safe"),
        F.count_if(code == 1).alias("n_watch"),
        F.count_if(code == 2).alias("n_danger"),
        F.avg("abs_error").alias("mae_step"),
    )


def onset_events(obs: DataFrame, drop: float = 15.0, steps: int = 3, block: int = BLOCK) -> DataFrame:
    """Slots whose value fell by at least ``drop`` against ``steps`` slots earlier."""

    def columns(w: WindowSpec):
        # exactly one slot can match, so max() picks it
        return {"ctt_before": F.max("v").over(w.rangeBetween(-steps, -steps))}

    rows = valid_rows(obs).select("pixel_id", "slot", "v")
    seen = framed(rows, columns, steps, 0, block=block)
    return seen.filter(F.col("v") - F.col("ctt_before") <= -drop).select(
        "pixel_id",
        F.col("slot").alias("onset_slot"),
        "ctt_before",
        F.col("v").alias("ctt_after"),
        (F.col("ctt_before") - F.col("v")).alias("drop_k"),
    )


def onset_counts(events: DataFrame) -> DataFrame:
    """Events per pixel and in total (pixel_id null); the total is there, as 0, without any event too."""
    per_pixel = events.groupBy("pixel_id").agg(F.count(F.lit(1)).alias("n_events"))
    total = per_pixel.agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))
    return per_pixel.unionByName(total, allowMissingColumns=True)


def distribution(obs: DataFrame) -> DataFrame:
    """Mean, population std, biased skewness, excess kurtosis, extremes, count."""
    rows = valid_rows(obs)
    return rows.agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.skewness("v").alias("skewness"),
        F.kurtosis("v").alias("kurtosis"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.count("v").alias("n_obs"),
    )


def compacted(obs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Gap-free numbering of each series: ``slot`` is the position among non-null
    rows, with the series' count and mean attached (one scan, no second pass)."""
    one = F.lit(1)
    rows = series_scan(
        valid_rows(obs).select("pixel_id", "slot", "v"),
        {"_pos": one},
        {"series_n": one, "series_sum": F.col("v")},
        block=block,
    )
    return rows.select(
        "pixel_id",
        (F.col("_pos") - 1).cast("bigint").alias("slot"),
        "v",
        F.col("series_n").cast("bigint").alias("series_n"),
        (F.col("series_sum") / F.col("series_n")).alias("series_mean"),
    )


def _centered(obs: DataFrame, gap_aware: bool, block: int) -> DataFrame:
    if gap_aware:
        rows = series_scan(
            valid_rows(obs).select("pixel_id", "slot", "v"),
            {},
            {"series_n": F.lit(1), "_sum": F.col("v")},
            block=block,
        ).withColumn("series_mean", F.col("_sum") / F.col("series_n"))
    else:
        rows = compacted(obs, block)
    return rows.withColumn("d", F.col("v") - F.col("series_mean"))


def autocovariance(obs: DataFrame, n_lags: int = 24, gap_aware: bool = False, block: int = BLOCK) -> DataFrame:
    """Per pixel: n and the array of sums d_i * d_(i-k), k = 0..n_lags.

    By default nulls are dropped and neighbours joined across gaps;
    ``gap_aware`` pairs rows by time distance instead.
    """
    d = F.col("d")

    def columns(w: WindowSpec):
        if gap_aware:
            lag = lambda k: F.max("d").over(w.rangeBetween(-k, -k))
        else:
            lag = lambda k: F.lag("d", k).over(w)
        return {f"c{k}": d * (d if k == 0 else lag(k)) for k in range(n_lags + 1)}

    rows = _centered(obs, gap_aware, block).select("pixel_id", "slot", "d")
    sums = (
        framed(rows, columns, n_lags, 0, block=block)
        .groupBy("pixel_id")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(n_lags + 1)])
    )
    return sums.select("pixel_id", "n", F.array(*[f"c{k}" for k in range(n_lags + 1)]).alias("sums"))


def acf_pacf(obs: DataFrame, n_lags: int = 24, gap_aware: bool = False, block: int = BLOCK) -> DataFrame:
    """(pixel_id, lag, acf, pacf) for every pixel, lags capped at n - 1.

    ACF uses the biased autocovariance; PACF solves Yule-Walker with
    sample-size adjusted autocovariances by the Durbin-Levinson recursion.
    """
    from kelvingrid.functions.arrays import durbin_levinson

    cov = autocovariance(obs, n_lags, gap_aware, block)
    usable = F.slice("sums", 1, F.least(F.col("n"), F.lit(n_lags + 1)).cast("int"))
    rows = cov.select("pixel_id", "n", usable.alias("sums"))
    acf = F.transform("sums", lambda s: F.try_divide(s, F.element_at("sums", 1)))
    rows = rows.withColumn("acf", acf).withColumn("pacf", durbin_levinson("sums", "n"))
    return rows.select(
        "pixel_id", F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "_z")
    ).select("pixel_id", "lag", "_z.acf", "_z.pacf")

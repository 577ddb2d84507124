"""Streaming operators on data that arrives in parts."""

from pyspark.sql import functions as F

from kelvingrid.operators.rollout import window_mean
from kelvingrid.registry.base import BOUNDS_SQL, GRID_SQL, R, T_, ctes, ev5, query
from kelvingrid.registry.evaluation_queries import rolled_sql
from kelvingrid.registry.ingest_queries import FILES_SQL, scene_files
from kelvingrid.registry.window_queries import lags_sql, span_sql
from kelvingrid.streaming import operators as so
from kelvingrid.streaming.runner import drained, in_time_order, late_counts, replayed, table_stream, with_stragglers

E = ev5()
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _plain_stream(spark, sf):
    rows = table_stream(spark, sf, _EVENTS, "events.parquet")
    return rows.select(
        F.col("event_type").alias("pixel_id"),
        E.axis.slot(F.col("ts")).alias("slot"),
        F.col("value").alias("v"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def _event_stream(spark, sf):
    return _plain_stream(spark, sf).withWatermark("event_time", "3 hours")


def _parts(spark, sf):
    obs = E.obs(spark, sf)
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    return in_time_order(obs, [lo + (hi - lo + 1) // 2])


def _late_parts(spark, sf):
    obs = E.obs(spark, sf)
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    return with_stragglers(obs, [lo + (hi - lo + 1) * k // 4 for k in (1, 2, 3)], 12)


@query(
    "k01_incremental_ingest",
    ctes(FILES_SQL, final="SELECT dir, file_name, count(*) AS n FROM fi WHERE contains(file_name, 'R21_FLDK.02801_02401') AND suffix(file_name, '.nc') AND length >= 10000 GROUP BY 1, 2"),
)
def ingest(spark, sf):
    """Two arrivals, two drains on one checkpoint: every file is seen once."""
    files = scene_files(spark, sf)
    parts = [files.filter("length % 2 = 0"), files.filter("length % 2 = 1")]
    seen = replayed(parts, so.incremental_ingest, "ingest", order=None)
    return seen.groupBy("dir", "file_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k02_unique_observations",
    "SELECT DISTINCT event_type AS pixel_id, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) // 3600000000 AS slot FROM events",
)
def unique(spark, sf):
    rows = _plain_stream(spark, sf).drop("event_time")
    timed = so.with_event_time(rows, E.axis, "18 hours")
    return drained(so.unique_observations(timed).select("pixel_id", "slot"), "unique")


_CUTS = [f"lo + (hi - lo + 1) * {k} // 4" for k in (1, 2, 3)]
_ARRIVAL = " + ".join(f"(CASE WHEN slot >= {c} OR (slot >= {c} - 12 AND slot % 3 = 1) THEN 1 ELSE 0 END)" for c in _CUTS)


@query(
    "k02_late_row_counts",
    ctes(
        E.sql,
        "ends AS (SELECT min(slot) AS lo, max(slot) AS hi FROM obs)",
        f"arrived AS (SELECT slot, {_ARRIVAL} AS part FROM obs, ends)",
        "tops AS (SELECT part, max(max(slot)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arrived GROUP BY part)",
        final="SELECT count(*) AS n_in, count_if(coalesce(slot <= top - 4, false)) AS n_late, count_if(NOT coalesce(slot <= top - 4, false)) AS n_unique FROM arrived JOIN tops USING (part)",
    ),
)
def late_rows(spark, sf):
    """Rows up to 12 slots late against a watermark of 4: those behind it are left out and counted."""
    progress = []
    plan = lambda rows: so.unique_observations(so.with_event_time(rows, E.axis, "4 hours")).select("pixel_id", "slot")
    kept = replayed(_late_parts(spark, sf), plan, "late", progress=progress).agg(F.count("*").alias("n_unique"))
    return late_counts(spark, progress).select("n_in", "n_late", kept.scalar().alias("n_unique"))


_CLOSED = "(SELECT max(ts) - INTERVAL 3 HOUR FROM events)"
_SHARES = f"""{R('avg(CASE WHEN v < 10 THEN 1.0 ELSE 0.0 END)')} AS deep_convective, {R('avg(CASE WHEN v >= 10 AND v < 60 THEN 1.0 ELSE 0.0 END)')} AS moderate_cloud,
  {R('avg(CASE WHEN v >= 60 THEN 1.0 ELSE 0.0 END)')} AS clear, {R('avg(v)')} AS mean_v, count(v) AS n_obs"""


@query(
    "k03_hourly_shares",
    f"SELECT {T_('w')} AS window_start, {_SHARES} FROM (SELECT date_trunc('hour', ts) AS w, value AS v FROM events) WHERE w + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY w",
)
def hourly(spark, sf):
    return drained(so.windowed_shares(_event_stream(spark, sf), low=10.0, high=60.0), "hourly")


@query(
    "k03_sliding_shares",
    f"""SELECT {T_('w')} AS window_start, {_SHARES} FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(10 * k AS BIGINT)) AS w, value AS v
    FROM events CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS k)) WHERE w + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY w""",
)
def sliding(spark, sf):
    return drained(so.windowed_shares(_event_stream(spark, sf), "1 hour", "10 minutes", 10.0, 60.0), "sliding")


@query(
    "k04_onset_alerts",
    ctes(
        E.sql,
        final=f"SELECT a.pixel_id, a.slot AS onset_slot, {R('p.v')} AS ctt_before, {R('a.v')} AS ctt_after, {R('p.v - a.v')} AS drop_k FROM obs a JOIN obs p ON a.pixel_id = p.pixel_id AND p.slot = a.slot - 3 WHERE p.v - a.v >= 15",
    ),
)
def onset(spark, sf):
    """Four parts; rows of the last twelve slots before a cut come late and out of order."""
    return replayed(_late_parts(spark, sf), lambda rows: so.onset_alerts(rows, E.axis), "onset")


@query(
    "k05_rolling_forecast",
    ctes(
        E.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(3, 0, lags_sql(4)),
        "fr AS (SELECT * FROM w WHERE filled = 4)",
        final=f"SELECT pixel_id, slot + step AS target_slot, step, {R('CASE step WHEN 1 THEN p_1 WHEN 2 THEN p_2 ELSE p_3 END')} AS y_pred FROM ({rolled_sql('window_mean', 4, 3)}) CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS step)",
    ),
)
def rolling(spark, sf):
    plan = lambda rows: so.rolling_forecast(rows, 4, window_mean(), 3, E.axis)
    return replayed(_late_parts(spark, sf), plan, "rolling").select("pixel_id", "target_slot", "step", "y_pred")


@query(
    "k06_verified_forecasts",
    ctes(
        E.sql,
        final=f"SELECT f.pixel_id, f.slot + k AS target_slot, k AS step, {R('f.v')} AS y_pred, {R('o.v')} AS y_true, {R('abs(f.v - o.v)')} AS abs_error FROM obs f CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS k) JOIN obs o ON o.pixel_id = f.pixel_id AND o.slot = f.slot + k",
    ),
)
def verify(spark, sf):
    """Persistence forecasts met by the observations of the next three slots."""

    def plan(rows):
        obs = so.with_event_time(rows, E.axis, "18 hours")
        made = so.with_event_time(rows, E.axis, "18 hours", name="made_at")
        forecasts = made.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
            "pixel_id", "made_at", (F.col("slot") + F.col("step")).alias("target_slot"), "step", F.col("v").alias("y_pred")
        )
        return so.verified(forecasts, obs, "3 HOURS")

    return replayed(_parts(spark, sf), plan, "verify")


@query(
    "k07_gap_free_runs",
    ctes(
        E.sql,
        "n AS (SELECT pixel_id, slot, slot - row_number() OVER (PARTITION BY pixel_id ORDER BY slot) AS island FROM obs)",
        "r AS (SELECT pixel_id, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n_slots FROM n GROUP BY pixel_id, island)",
        final=f"""SELECT pixel_id, first_slot, n_slots, greatest(n_slots - 5, 0) AS n_anchors FROM r
        WHERE {E.time_sql('last_slot')} + INTERVAL 90 MINUTE <= {E.time_sql('(SELECT max(slot) FROM obs)')} - INTERVAL 18 HOUR""",
    ),
)
def runs(spark, sf):
    plan = lambda rows: so.gap_free_runs(so.with_event_time(rows, E.axis, "18 hours"), E.axis, 6)
    return replayed(_parts(spark, sf), plan, "runs")

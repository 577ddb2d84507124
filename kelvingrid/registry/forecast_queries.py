"""Forecast table, joins with observations, selections."""

from pyspark.sql import functions as F

from kelvingrid.functions.scalars import compact_time
from kelvingrid.operators import evaluate, forecast as fc, rollout, samples
from kelvingrid.plans import stages
from kelvingrid.registry.base import BOUNDS_SQL, DIM_SQL, GRID_SQL, ORACLES, R, T_, ctes, dim_of, ev5, g35, query, suppliers, table
from kelvingrid.registry.evaluation_queries import rolled_sql
from kelvingrid.registry.window_queries import lags_sql, span_sql
from kelvingrid.session import scratch_path
from kelvingrid.sources import geojson, tables

E = ev5()
G = g35()
S = suppliers()
W, H = 6, 12


def forecast_sql(fx, model: str, window: int, horizon: int) -> list[str]:
    """CTEs up to ``fo``: latest window per pixel that leaves the horizon to the observations, rolled out, joined to observations."""
    step = "CASE step " + " ".join(f"WHEN {k} THEN p_{k}" for k in range(1, horizon + 1)) + " END"
    return [
        fx.sql,
        BOUNDS_SQL,
        GRID_SQL,
        DIM_SQL,
        span_sql(window - 1, 0, lags_sql(window)),
        f"""fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY slot DESC) AS rn FROM w WHERE filled = {window} AND slot <= (SELECT hi FROM b) - {horizon}) WHERE rn = 1)""",
        f"p AS (SELECT pixel_id, slot, step, slot + step AS target_slot, {step} AS y_pred FROM ({rolled_sql(model, window, horizon)}) CROSS JOIN (SELECT unnest(generate_series(1, {horizon})) AS step))",
        "fo AS (SELECT p.*, o.v AS y_true, abs(p.y_pred - o.v) AS abs_error FROM p LEFT JOIN obs o ON o.pixel_id = p.pixel_id AND o.slot = p.target_slot)",
    ]


def newest(fx, spark, sf, window=W, horizon=H):
    obs = fx.obs(spark, sf)
    t0 = obs.agg(F.max("slot") - F.lit(horizon)).scalar()
    return obs, samples.latest_windows(obs, window, t0, 64)


def forecast(fx, spark, sf, model, window=W, horizon=H):
    obs, win = newest(fx, spark, sf, window, horizon)
    return obs, rollout.forecast_rows(rollout.rollout_linear(win, model, horizon, fx.axis), fx.axis)


_P = forecast_sql(E, "window_mean", W, H)


@query("j13_forecast_rows", ctes(*_P, final=f"SELECT pixel_id, step, {T_(E.time_sql('slot'))} AS window_end_time, {T_(E.time_sql('target_slot'))} AS target_time, {R('y_pred')} AS y_pred FROM fo"))
def forecast_rows(spark, sf):
    _, f = forecast(E, spark, sf, rollout.window_mean())
    return f.drop("target_slot")


@query("b06_step_range", ctes(*_P, final=f"SELECT pixel_id, step, {R('y_pred')} AS y_pred FROM fo WHERE step BETWEEN 3 AND 9"))
def step_range(spark, sf):
    _, f = forecast(E, spark, sf, rollout.window_mean())
    return fc.steps_between(f, 3, 9).select("pixel_id", "step", "y_pred")


@query("g03_forecast_with_actuals", ctes(*_P, final=f"SELECT pixel_id, step, target_slot, {R('y_pred')} AS y_pred, {R('y_true')} AS y_true, {R('abs_error')} AS abs_error FROM fo"))
def with_actuals(spark, sf):
    obs, f = forecast(E, spark, sf, rollout.window_mean())
    return fc.with_actuals(f, obs).drop("window_end_time", "target_time")


@query("g03_match_counts", ctes(*_P, final="SELECT count(*) AS n_rows, count(y_true) AS n_matched FROM fo"))
def match_counts(spark, sf):
    obs, f = forecast(E, spark, sf, rollout.window_mean())
    return fc.match_counts(fc.with_actuals(f, obs))


@query(
    "g08_observations_in_span",
    ctes(*_P, final=f"SELECT pixel_id, slot, {R('v')} AS v FROM obs WHERE slot BETWEEN (SELECT min(target_slot) FROM p) AND (SELECT max(target_slot) FROM p)"),
)
def in_span(spark, sf):
    obs, f = forecast(E, spark, sf, rollout.window_mean())
    return fc.observations_in_span(obs, f)


@query("g04_input_snapshot", ctes(*_P, final=f"SELECT fr.pixel_id, fr.slot, {R('o.v')} AS v FROM fr JOIN obs o ON o.pixel_id = fr.pixel_id AND o.slot = fr.slot"))
def snapshot(spark, sf):
    obs, win = newest(E, spark, sf)
    return fc.input_snapshot(win, obs)


_PS = forecast_sql(S, "window_mean", 3, 4)


@query("g02_first_vs_last_step", ctes(*_PS, final=f"SELECT a.pixel_id, {R('a.y_pred')} AS y_first, {R('b.y_pred')} AS y_last, {R('b.y_pred - a.y_pred')} AS change FROM fo a JOIN fo b ON a.pixel_id = b.pixel_id AND a.step = 1 AND b.step = 4"))
def first_vs_last(spark, sf):
    _, f = forecast(S, spark, sf, rollout.window_mean(), 3, 4)
    return evaluate.first_vs_last(f, 4)


@query("f31_realized_error", ctes(*_PS, final=f"SELECT step, {R('avg(abs_error)')} AS mae, count(*) AS n_pixel FROM fo WHERE y_true IS NOT NULL GROUP BY 1"))
def realized(spark, sf):
    obs, f = forecast(S, spark, sf, rollout.window_mean(), 3, 4)
    return evaluate.realized_error(fc.with_actuals(f, obs))


@query(
    "f33_value_ranges",
    ctes(
        *_PS,
        "sn AS (SELECT min(o.v) AS lo, max(o.v) AS hi FROM fr JOIN obs o ON o.pixel_id = fr.pixel_id AND o.slot = fr.slot)",
        final=f"""SELECT step, {R('least(min(y_pred), min(y_true), min(lo))')} AS vmin, {R('greatest(max(y_pred), max(y_true), max(hi))')} AS vmax,
        {R('CASE WHEN count(abs_error) > 0 THEN 0 END')} AS err_min, {R('max(abs_error)')} AS err_max FROM fo CROSS JOIN sn GROUP BY 1""",
    ),
)
def ranges(spark, sf):
    obs, win = newest(S, spark, sf, 3, 4)
    f = rollout.forecast_rows(rollout.rollout_linear(win, rollout.window_mean(), 4, S.axis), S.axis)
    return fc.value_ranges(fc.with_actuals(f, obs), fc.input_snapshot(win, obs))


_TABLE = f"""pixel_id, lat_idx, lon_idx, {R('latitude')} AS latitude, {R('longitude')} AS longitude, {T_(S.time_sql('slot'))} AS window_end_time, step,
  {T_(S.time_sql('target_slot'))} AS target_time, {R('y_pred')} AS y_pred, {R('y_true')} AS y_true, {R('abs_error')} AS abs_error"""


def _table(spark, sf):
    obs, win = newest(S, spark, sf, 3, 4)
    rolled = rollout.rollout_linear(win, rollout.window_mean(), 4, S.axis)
    return stages.forecast_table(rolled, obs, S.axis, dim_of(obs), "window_mean", 3, False)


@query("j14_forecast_table", ctes(*_PS, final=f"""SELECT {_TABLE}, 'window_mean' AS model_name, CAST(3 AS BIGINT) AS "window" FROM fo JOIN dim USING (pixel_id)"""))
def forecast_table(spark, sf):
    return _table(spark, sf)


@query(
    "a14_geojson_features",
    ctes(
        *_PS,
        final=f"""SELECT pixel_id, 'Feature' AS kind, {R('longitude', 4)} AS lon, {R('latitude', 4)} AS lat, count(*) AS n_steps, strftime({S.time_sql('min(slot)')}, '%Y-%m-%dT%H:%M:%S') AS window_end_time,
        strftime({S.time_sql('min(target_slot)')}, '%Y-%m-%dT%H:%M:%S') AS first_target, {R('min_by(y_pred, step)', 4)} AS first_pred, {R('max_by(y_pred, step)', 4)} AS last_pred
        FROM fo JOIN dim USING (pixel_id) GROUP BY pixel_id, longitude, latitude""",
    ),
    digits=4,
)
def geojson_features(spark, sf):
    """Written as text and read back with a declared schema."""
    path = scratch_path(spark, "features")
    geojson.write_features(_table(spark, sf), path)
    schema = (
        "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<pixel_id: string, "
        "window_end_time: string, forecast: array<struct<step: int, target_time: string, y_pred: double, y_true: double>>>"
    )
    f = spark.read.schema(schema).json(path)
    series = F.col("properties.forecast")
    return f.select(
        "properties.pixel_id",
        F.col("type").alias("kind"),
        F.col("geometry.coordinates")[0].alias("lon"),
        F.col("geometry.coordinates")[1].alias("lat"),
        F.size(series).alias("n_steps"),
        "properties.window_end_time",
        F.element_at(series, 1)["target_time"].alias("first_target"),
        F.element_at(series, 1)["y_pred"].alias("first_pred"),
        F.element_at(series, -1)["y_pred"].alias("last_pred"),
    )


@query(
    "a14_feature_collection",
    ctes(
        *_PS,
        final=f"""SELECT 'window_mean' AS model_name, CAST(3 AS BIGINT) AS "window", '2026-01-01T00:00:00' AS generated_at, pixel_id, {R('longitude', 4)} AS lon, count(*) AS n_steps,
        {R('max_by(y_pred, step)', 4)} AS last_pred FROM fo JOIN dim USING (pixel_id) GROUP BY pixel_id, longitude""",
    ),
    digits=4,
)
def feature_collection(spark, sf):
    """One document with its envelope, written by all tasks and read back."""
    path = scratch_path(spark, "collection")
    geojson.write_collection(_table(spark, sf), path, "window_mean", 3, "2026-01-01T00:00:00")
    feature = "struct<geometry: struct<coordinates: array<double>>, properties: struct<pixel_id: string, forecast: array<struct<y_pred: double>>>>"
    series = F.col("feature.properties.forecast")
    return geojson.read_collection(spark, path, feature).select(
        "model_name", "window", "generated_at", "feature.properties.pixel_id", F.col("feature.geometry.coordinates")[0].alias("lon"),
        F.size(series).alias("n_steps"), F.element_at(series, -1)["y_pred"].alias("last_pred"),
    )


@query(
    "a15_run_folders",
    ctes(
        *_PS,
        final=f"""SELECT 'window_mean' AS model_name, CAST(3 AS BIGINT) AS "window", strftime({S.time_sql('(SELECT max(slot) FROM fr)')}, '%Y%m%d_%H%M') AS t0, run, count(*) AS n, {R('avg(y_pred)')} AS mean_pred
        FROM fo CROSS JOIN (SELECT unnest(['20260101_0000', '20260101_0010']) AS run) GROUP BY run""",
    ),
)
def run_folders(spark, sf):
    """Two runs side by side; the folders come back as columns."""
    rows = _table(spark, sf)
    path = scratch_path(spark, "runs")
    t0 = rows.agg(compact_time(F.max("window_end_time"))).first()[0]
    for run in ("20260101_0000", "20260101_0010"):
        tables.write_forecast(rows, path, "window_mean", 3, t0, run)
    back = spark.read.parquet(path)
    return back.groupBy("model_name", "window", "t0", "run").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred")
    )


@query(
    "b09_window_overrides",
    """WITH m AS (SELECT DISTINCT p_type AS model FROM part), be AS (SELECT p_type AS model, max(p_size) AS w FROM part WHERE p_retailprice > 1500 GROUP BY 1)
    SELECT m.model, CAST(coalesce(CASE m.model WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 9 END, be.w, 6) AS BIGINT) AS "window" FROM m LEFT JOIN be ON m.model = be.model""",
)
def overrides(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_type", "model")
    best = part.filter("p_retailprice > 1500").groupBy("model").agg(F.max("p_size").alias("window"))
    return fc.resolve_windows(part.select("model").distinct(), best, {"PROMO": 3, "ECONOMY": 9}, 6)


@query(
    "h03_best_row_per_group",
    """SELECT p_brand AS model, CAST(p_size AS BIGINT) AS "window", (round(p_retailprice, 6) + 0.0) AS mae_avg_all_steps FROM
    (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size) AS rn FROM (SELECT DISTINCT p_brand, p_size, p_retailprice FROM part)) WHERE rn = 1""",
)
def best_row(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.col("p_size").alias("window"), F.col("p_retailprice").alias("mae_avg_all_steps")
    )
    return fc.best_window_per_model(rows.distinct())


_LOW, _HIGH = 37000.0, 39000.0
_CODE = "CASE WHEN {0} < 37000 THEN 2 WHEN {0} <= 39000 THEN 1 WHEN {0} > 39000 THEN 0 END"


def frames_of(spark, sf):
    """The tables of stage 08 for a forecast of every supplier."""
    obs, win = newest(S, spark, sf, 3, 4)
    rolled = rollout.rollout_linear(win, rollout.window_mean(), 4, S.axis)
    dim = dim_of(obs)
    return stages.frame_tables(stages.forecast_table(rolled, obs, S.axis, dim, "window_mean", 3, False), obs, S.axis, dim, low=_LOW, high=_HIGH)


@query(
    "g04_frame_cells",
    ctes(
        *_PS,
        final=f"""SELECT pixel_id, step, {T_(S.time_sql("fo.slot"))} AS window_end_time, {T_(S.time_sql("target_slot"))} AS target_time, {R("y_pred")} AS y_pred,
        {R("y_true")} AS y_true, {R("abs_error")} AS abs_error, lat_idx, lon_idx, CAST({_CODE.format("y_pred")} AS BIGINT) AS code_pred,
        CAST({_CODE.format("y_true")} AS BIGINT) AS code_true FROM fo JOIN dim USING (pixel_id)""",
    ),
)
def frame_cells(spark, sf):
    return frames_of(spark, sf)["cells"]


@query(
    "f33_frame_steps",
    f"""SELECT * FROM ({ORACLES["f33_value_ranges"]}) JOIN ({ctes(
        *_PS,
        final=f"""SELECT step, count(*) FILTER (y_pred > 39000) AS n_safe, count(*) FILTER (y_pred BETWEEN 37000 AND 39000) AS n_watch,
        count(*) FILTER (y_pred < 37000) AS n_danger, {R("avg(abs_error)")} AS mae_step FROM fo GROUP BY 1""",
    )}) USING (step)""",
)
def frame_steps(spark, sf):
    return frames_of(spark, sf)["steps"]


@query(
    "c11_frame_gaps",
    ctes(
        *_PS, "e AS (SELECT max(lat_idx) AS a, max(lon_idx) AS b FROM dim)",
        final="""SELECT concat(CAST(i AS VARCHAR), '_', CAST(j AS VARCHAR)) AS pixel_id, i AS lat_idx, j AS lon_idx FROM (SELECT unnest(generate_series(0, a)) AS i, b FROM e), LATERAL (SELECT unnest(generate_series(0, b)) AS j)
        WHERE (i, j) NOT IN (SELECT (lat_idx, lon_idx) FROM fo JOIN dim USING (pixel_id))""",
    ),
)
def frame_gaps(spark, sf):
    return frames_of(spark, sf)["missing"]

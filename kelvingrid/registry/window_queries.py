"""Lag windows, anchors, frames, onset, prefix sums, expanding features, folds."""

from pyspark.sql import functions as F

from kelvingrid.functions.scalars import array_mean
from kelvingrid.operators import blocks, climate, expanding, grid, samples, split
from kelvingrid.registry.base import BOUNDS_SQL, DIM_SQL, GRID_SQL, ORACLES, R, T_, ctes, dim_of, ev5, g35, query, suppliers
from kelvingrid.session import scratch_path
from kelvingrid.sources import tables

G = g35()
GK = g35(kelvin=True)
E = ev5()
S = suppliers()
# small blocks, so that the halo and the carry are exercised on the given tables
BLOCK = 64


def span_sql(back: int, ahead: int, extra: str = "", keys: str = "pixel_id", src: str = "grid", name: str = "w") -> str:
    """Rows with the count of non-null values over [-back, +ahead]."""
    return f"""{name} AS (SELECT *, count(v) OVER (PARTITION BY {keys} ORDER BY slot ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) AS filled{extra}
      FROM {src})"""


def lags_sql(window: int, keys: str = "pixel_id") -> str:
    return "".join(
        f", lag(v, {k}) OVER (PARTITION BY {keys} ORDER BY slot) AS lag_{k + 1}" for k in range(window)
    )


def leads_sql(horizon: int, keys: str = "pixel_id") -> str:
    return "".join(
        f", lead(v, {k}) OVER (PARTITION BY {keys} ORDER BY slot) AS f_{k}" for k in range(1, horizon + 1)
    )


def frames_sql(fx, window: int, horizon: int) -> list[str]:
    """CTEs up to ``fr``: one row per anchor with lag_1..lag_w and f_1..f_h."""
    return [
        fx.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(window - 1, horizon, lags_sql(window) + leads_sql(horizon)),
        f"fr AS (SELECT * FROM w WHERE filled = {window + horizon})",
    ]


def exploded(df, *arrays):
    """Array columns as (k, a, b ...) rows."""
    plain = [c for c in df.columns if c not in arrays]
    return df.select(*plain, F.posexplode(F.arrays_zip(*arrays)).alias("k", "_z")).select(
        *plain, (F.col("k") + 1).alias("k"), *[F.col(f"_z.{a}").alias(a) for a in arrays]
    )


_LAGS6 = ", ".join(R(f"lag_{k}") + f" AS lag_{k}" for k in range(1, 7))


@query(
    "d01_lag_features",
    ctes(G.sql, BOUNDS_SQL, GRID_SQL, span_sql(5, 1, lags_sql(6)), final=f"SELECT pixel_id, slot, {_LAGS6} FROM w WHERE filled = 7"),
)
def lag_features(spark, sf):
    return samples.window_samples(G.obs(spark, sf), 6, BLOCK).select("pixel_id", "slot", *samples.lag_columns(6))


@query(
    "d02_one_step_target",
    ctes(G.sql, BOUNDS_SQL, GRID_SQL, span_sql(5, 1, leads_sql(1)), final=f"SELECT pixel_id, slot, {R('f_1')} AS target_tbb FROM w WHERE filled = 7"),
)
def one_step_target(spark, sf):
    return samples.window_samples(G.obs(spark, sf), 6, BLOCK).select("pixel_id", "slot", "target_tbb")


@query(
    "d03_complete_windows",
    ctes(E.sql, BOUNDS_SQL, GRID_SQL, span_sql(23, 1), final="SELECT pixel_id, count(*) AS n_complete FROM w WHERE filled = 25 GROUP BY 1"),
)
def complete(spark, sf):
    return samples.anchors(E.obs(spark, sf), 24, 1, block=BLOCK).groupBy("pixel_id").agg(
        F.count(F.lit(1)).alias("n_complete")
    )


_TM = lambda t: f"(hour({t} + INTERVAL 7 HOUR) * 60 + minute({t} + INTERVAL 7 HOUR)) * 2 * pi() / 1440"


@query(
    "d04_window_dataset",
    ctes(
        E.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(3, 1, lags_sql(4) + leads_sql(1)),
        f"s AS (SELECT *, {E.time_sql('slot')} AS t0, {E.time_sql('slot + 1')} AS t1 FROM w WHERE filled = 5)",
        final="SELECT pixel_id, slot, "
        + ", ".join(R(f"lag_{k}") + f" AS lag_{k}" for k in range(1, 5))
        + f", {R(f'sin({_TM('t1')})')} AS hour_sin, {R(f'cos({_TM('t1')})')} AS hour_cos, {T_('t0')} AS anchor_time, {T_('t1')} AS target_time, {R('f_1')} AS target_tbb FROM s",
    ),
)
def window_dataset(spark, sf):
    return samples.window_dataset(E.obs(spark, sf), 4, E.axis, block=BLOCK)


@query(
    "d04_window_dataset_suppliers",
    ctes(
        S.sql,
        BOUNDS_SQL,
        GRID_SQL,
        DIM_SQL,
        span_sql(5, 1, lags_sql(6) + leads_sql(1)),
        final=f"SELECT w.pixel_id, slot, {_LAGS6}, {R('f_1')} AS target_tbb, {R('latitude')} AS latitude, {R('longitude')} AS longitude FROM w JOIN dim d ON w.pixel_id = d.pixel_id WHERE filled = 7",
    ),
)
def window_dataset_suppliers(spark, sf):
    obs = S.obs(spark, sf)
    return samples.window_dataset(obs, 6, S.axis, dim_of(obs)).drop("hour_sin", "hour_cos", "anchor_time", "target_time")


@query(
    "d05_feature_order",
    ctes(
        E.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(1, 1, lags_sql(2) + leads_sql(1)),
        f"s AS (SELECT *, {E.time_sql('slot + 1')} AS t1 FROM w WHERE filled = 3)",
        final=f"SELECT pixel_id, slot, k, {R('CASE k WHEN 1 THEN lag_1 WHEN 2 THEN lag_2 WHEN 3 THEN sin(' + _TM('t1') + ') ELSE cos(' + _TM('t1') + ') END')} AS x FROM s CROSS JOIN (SELECT unnest(generate_series(1, 4)) AS k)",
    ),
)
def feature_order(spark, sf):
    ds = samples.window_dataset(E.obs(spark, sf), 2, E.axis, block=BLOCK)
    rows = ds.select("pixel_id", "slot", F.array(*samples.feature_columns(2)).alias("x"))
    return exploded(rows, "x")


@query("d06_full_horizon_anchors", ctes(G.sql, BOUNDS_SQL, GRID_SQL, span_sql(5, 18), final="SELECT pixel_id, slot FROM w WHERE filled = 24"))
def anchors(spark, sf):
    return samples.anchors(G.obs(spark, sf), 6, 18, block=BLOCK)


@query("d07_valid_span_starts", ctes(G.sql, BOUNDS_SQL, GRID_SQL, span_sql(0, 23), final="SELECT pixel_id, slot FROM w WHERE filled = 24"))
def span_starts(spark, sf):
    return samples.span_starts(G.obs(spark, sf), 24, block=BLOCK)


@query(
    "d08_positional_stride",
    ctes(
        G.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(5, 18),
        final="SELECT pixel_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY slot) - 1 AS rn FROM w WHERE filled = 24) WHERE rn % 6 = 0",
    ),
)
def stride(spark, sf):
    return samples.anchors(G.obs(spark, sf), 6, 18, stride=6, block=BLOCK)


def _unpivot(n: int, p: str) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {p}_{i}" for i in range(1, n + 1)) + " END"


@query(
    "d09_rollout_frames",
    ctes(
        *frames_sql(G, 6, 6),
        final=f"SELECT pixel_id, slot, k, {R(_unpivot(6, 'lag'))} AS lags, {R(_unpivot(6, 'f'))} AS future FROM fr CROSS JOIN (SELECT unnest(generate_series(1, 6)) AS k)",
    ),
)
def rollout_frames(spark, sf):
    return exploded(samples.rollout_frames(G.obs(spark, sf), 6, 6, block=BLOCK), "lags", "future")


@query(
    "d09_rollout_frames_suppliers",
    ctes(
        *frames_sql(S, 3, 3),
        final=f"SELECT pixel_id, slot, k, {R(_unpivot(3, 'lag'))} AS lags, {R(_unpivot(3, 'f'))} AS future FROM fr CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS k)",
    ),
)
def rollout_frames_suppliers(spark, sf):
    return exploded(samples.rollout_frames(S.obs(spark, sf), 3, 3), "lags", "future")


@query(
    "d10_frames_at_anchors",
    ctes(
        *frames_sql(G, 2, 2),
        final=f"SELECT pixel_id, slot, k, {R(_unpivot(2, 'lag'))} AS lags, {R(_unpivot(2, 'f'))} AS future FROM fr CROSS JOIN (SELECT unnest(generate_series(1, 2)) AS k) WHERE (pixel_id, slot) IN (SELECT (pixel_id, slot) FROM obs WHERE v > 30)",
    ),
)
def frames_at(spark, sf):
    obs = G.obs(spark, sf)
    return exploded(samples.frames_at(obs, obs.filter("v > 30"), 2, 2, BLOCK), "lags", "future")


@query(
    "d11_earliest_anchor_times",
    ctes(*frames_sql(G, 2, 3), final="SELECT pixel_id, slot FROM fr WHERE slot IN (SELECT DISTINCT slot FROM fr ORDER BY slot LIMIT 40)"),
)
def earliest(spark, sf):
    return samples.earliest_anchor_times(samples.anchors(G.obs(spark, sf), 2, 3, block=BLOCK), 40)


@query(
    "d12_latest_complete_window",
    ctes(E.sql, BOUNDS_SQL, GRID_SQL, span_sql(11, 0), final="SELECT pixel_id, max(slot) AS slot, max(slot) - 11 AS start_slot FROM w WHERE filled = 12 AND slot <= 500 GROUP BY 1"),
)
def latest(spark, sf):
    w = samples.latest_windows(E.obs(spark, sf), 12, 500, BLOCK)
    return w.select("pixel_id", "slot", (F.col("slot") - 11).alias("start_slot"))


@query("d12_latest_window_backward", ORACLES["d12_latest_complete_window"])
def latest_backward(spark, sf):
    """The same windows from a grid stored by date, its folders read from the newest on."""
    obs = E.obs(spark, sf)
    path = scratch_path(spark, "grid")
    tables.write_grid(obs, E.axis, path)
    w = samples.newest_windows(tables.read_grid(spark, path), 12, E.axis, obs.select("pixel_id").distinct(), 500, BLOCK)
    return w.select("pixel_id", "slot", (F.col("slot") - 11).alias("start_slot"))


@query(
    "d12_pixels_without_window",
    ctes(
        S.sql,
        BOUNDS_SQL,
        GRID_SQL,
        DIM_SQL,
        span_sql(39, 0),
        final="SELECT pixel_id, lat_idx, lon_idx FROM dim WHERE pixel_id NOT IN (SELECT pixel_id FROM w WHERE filled = 40 AND slot <= 60)",
    ),
)
def skipped(spark, sf):
    obs = S.obs(spark, sf)
    w = samples.latest_windows(obs, 40, 60)
    return samples.skipped_pixels(dim_of(obs), w).select("pixel_id", "lat_idx", "lon_idx")


@query(
    "d13_initial_lags",
    ctes(
        E.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(11, 0, lags_sql(12)),
        final=f"SELECT pixel_id, slot, k, {R(_unpivot(12, 'lag'))} AS lags FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY slot DESC) AS rn FROM w WHERE filled = 12 AND slot <= 500) CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS k) WHERE rn = 1",
    ),
)
def initial_lags(spark, sf):
    return exploded(samples.latest_windows(E.obs(spark, sf), 12, 500, BLOCK), "lags")


@query(
    "d14_onset_events",
    ctes(
        GK.sql,
        final=f"SELECT a.pixel_id, a.slot AS onset_slot, {R('p.v')} AS ctt_before, {R('a.v')} AS ctt_after, {R('p.v - a.v')} AS drop_k FROM obs a JOIN obs p ON a.pixel_id = p.pixel_id AND p.slot = a.slot - 3 WHERE a.v - p.v <= -15",
    ),
)
def onset(spark, sf):
    return climate.onset_events(GK.obs(spark, sf), block=BLOCK)


_PS = "OVER (PARTITION BY pixel_id ORDER BY slot ROWS UNBOUNDED PRECEDING)"


@query(
    "d15_prefix_sums",
    ctes(
        E.sql,
        BOUNDS_SQL,
        GRID_SQL,
        final=f"SELECT pixel_id, slot, {R(f'sum(coalesce(v, 0)) {_PS}', 3, 3.1e-7)} AS sum_y, {R(f'sum(coalesce(v * v, 0)) {_PS}', 3, 3.1e-7)} AS sum_y2, {R(f'sum(coalesce(slot * v, 0)) {_PS}', 3, 3.1e-7)} AS sum_ty FROM grid",
    ),
    digits=3,
    nudge=3.1e-7,  # the sums reach 1e6, where rounding noise is larger
)
def prefix_sums(spark, sf):
    obs = E.obs(spark, sf)
    g = grid.dense_grid(obs, obs.select("pixel_id").distinct())
    return expanding.prefix_sums(g, BLOCK).drop("v")


@query(
    "d16_sum_of_squares",
    ctes(E.sql, final="SELECT pixel_id, slot, CAST((SELECT coalesce(sum(i * i), 0) FROM (SELECT unnest(generate_series(0, 800)) AS i) WHERE i <= o.slot) AS BIGINT) AS s2 FROM obs o"),
)
def sum_of_squares(spark, sf):
    return E.obs(spark, sf).select("pixel_id", "slot", expanding.sum_of_squares_to(F.col("slot")).cast("bigint").alias("s2"))


def _span_cte(span: int) -> list[str]:
    lead = "".join(f", lead(v, {k}) OVER (PARTITION BY pixel_id ORDER BY slot) AS y_{k}" for k in range(1, span))
    return [
        G.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(0, span - 1, ", v AS y_0" + lead),
        "sp AS (SELECT pixel_id, slot, ["
        + ", ".join(f"y_{k}" for k in range(span))
        + f"] AS y FROM w WHERE filled = {span})",
    ]


@query(
    "d17_running_extremes",
    ctes(
        *_span_cte(24),
        final=f"SELECT pixel_id, slot, n, {R('list_min(y[1:n])')} AS min_window, {R('list_max(y[1:n])')} AS max_window FROM sp CROSS JOIN (SELECT unnest(generate_series(6, 23)) AS n)",
    ),
)
def extremes(spark, sf):
    spans = expanding.anchored_spans(G.obs(spark, sf), 24, block=BLOCK)
    return expanding.running_extremes(spans, "span_values", 6, 23).drop("span_values")


_FEATS = f"""{R('avg(x)')} AS mean_window, {R('stddev_pop(x)')} AS std_window, {R('min(x)')} AS min_window, {R('max(x)')} AS max_window,
  {R('min_by(x, t)')} AS first_value, {R('max_by(x, t)')} AS last_value, {R('max_by(x, t) - min_by(x, t)')} AS delta_first_last,
  {R('coalesce(regr_slope(x, t), 0)')} AS slope, CAST(count(x) AS DOUBLE) AS n_points"""


@query(
    "d18_window_features",
    ctes(
        G.sql,
        "wi AS (SELECT pixel_id, slot AS start_slot, slot + 3 + slot % 11 AS end_slot FROM obs)",
        "x AS (SELECT w.pixel_id, start_slot, end_slot, o.slot AS t, o.v AS x FROM wi w JOIN obs o ON o.pixel_id = w.pixel_id AND o.slot BETWEEN start_slot AND end_slot)",
        final=f"SELECT pixel_id, start_slot, end_slot, {_FEATS} FROM x GROUP BY 1, 2, 3 HAVING count(x) = end_slot - start_slot + 1",
    ),
)
def window_features(spark, sf):
    obs = G.obs(spark, sf)
    wanted = obs.select(
        "pixel_id", F.col("slot").alias("start_slot"), (F.col("slot") + 3 + F.col("slot") % 11).alias("end_slot")
    )
    return expanding.windowed_features(obs, wanted, BLOCK)


@query(
    "d19_gathered_window_features",
    ctes(
        *_span_cte(8),
        "x AS (SELECT pixel_id, slot, unnest(generate_series(0, 7)) AS t, unnest(y) AS x FROM sp)",
        final=f"SELECT pixel_id, slot, {_FEATS} FROM x GROUP BY 1, 2",
    ),
)
def gathered(spark, sf):
    spans = expanding.anchored_spans(G.obs(spark, sf), 8, block=BLOCK)
    feats = expanding.array_features(F.col("span_values"))
    return spans.select("pixel_id", "slot", *[c.alias(k) for k, c in feats.items()])


def _expanding_sql(fx, horizon: int, offset: int, stride: int, dim: bool = False) -> str:
    span = horizon + offset + 2
    base = _span_cte(span)
    base[0] = fx.sql
    return ctes(
        *base,
        f"st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY slot) - 1 AS rn FROM sp) WHERE rn % {stride} = 0)",
        f"x AS (SELECT pixel_id, slot, step, y[step + {offset + 2}] AS target, unnest(generate_series(0, step + {offset})) AS t, unnest(y[1:step + {offset + 1}]) AS x FROM st CROSS JOIN (SELECT unnest(generate_series(1, {horizon})) AS step))",
        *([DIM_SQL] if dim else []),
        final=f"""SELECT x.pixel_id, slot, step, {T_(fx.time_sql('slot'))} AS anchor_t0, {T_(fx.time_sql(f'slot + step + {offset + 1}'))} AS target_time,
        {_FEATS}, {R('max(target)')} AS target_tbb_13{', ' + R('max(latitude)') + ' AS latitude, ' + R('max(longitude)') + ' AS longitude' if dim else ''}
        FROM x {'JOIN dim d ON x.pixel_id = d.pixel_id' if dim else ''} GROUP BY x.pixel_id, slot, step""",
    )


@query("d20_expanding_samples", _expanding_sql(G, 18, 4, 6))
def expanding_samples(spark, sf):
    return expanding.expanding_samples(G.obs(spark, sf), G.axis, 18, 4, 6, block=BLOCK)


@query("d21_expanding_dataset", _expanding_sql(S, 6, 2, 1, dim=True))
def expanding_dataset(spark, sf):
    obs = S.obs(spark, sf)
    dim = dim_of(obs)
    return expanding.expanding_samples(grid.dense_grid(obs, dim), S.axis, 6, 2, 1, dim)


_FOLD = """fo AS (SELECT k + 1 AS fold, lo + k * ((hi - lo + 1) // 5) AS val_start,
  CASE WHEN k = 4 THEN hi + 1 ELSE lo + (k + 1) * ((hi - lo + 1) // 5) END AS val_end
  FROM b CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS k))"""


@query(
    "d22_blocked_folds",
    ctes(E.sql, BOUNDS_SQL, _FOLD, final="SELECT fold, val_start, val_end, count(o.v) AS n_rows, min(o.slot) AS first_slot, max(o.slot) AS last_slot FROM fo JOIN obs o ON o.slot >= val_start AND o.slot < val_end GROUP BY 1, 2, 3"),
)
def folds(spark, sf):
    obs = E.obs(spark, sf)
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    named = obs.withColumn("fold", split.fold_of(F.col("slot"), F.lit(lo), F.lit(hi), 5))
    g = named.groupBy("fold").agg(
        F.count("v").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )
    return split.fold_table(lo, hi, 5, spark).join(g, "fold")


@query(
    "d23_purged_roles",
    ctes(
        E.sql,
        BOUNDS_SQL,
        _FOLD,
        final="""SELECT fold, o.pixel_id, o.slot, CASE WHEN o.slot >= val_start AND o.slot < val_end THEN 'val' ELSE 'train' END AS role
        FROM fo CROSS JOIN obs o WHERE (o.slot >= val_start AND o.slot < val_end) OR o.slot < val_start - 24 OR o.slot >= val_end + 24""",
    ),
)
def purged(spark, sf):
    obs = E.obs(spark, sf)
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    tagged = split.with_fold_roles(obs, split.fold_table(lo, hi, 5, spark), 24, 5)
    return tagged.select("fold", "pixel_id", "slot", "role")


@query(
    "g07_asof_window_ends",
    ctes(
        E.sql,
        BOUNDS_SQL,
        GRID_SQL,
        span_sql(5, 0, lags_sql(6)),
        "ev AS (SELECT pixel_id, slot, (lag_1 + lag_2 + lag_3 + lag_4 + lag_5 + lag_6) / 6 AS m FROM w WHERE filled = 6)",
        "rq AS (SELECT pixel_id, slot, v FROM grid WHERE v IS NULL OR v > 60)",
        final=f"SELECT r.pixel_id, r.slot, {R('r.v')} AS v, e.slot AS event_slot, {R('e.m')} AS m FROM rq r ASOF LEFT JOIN ev e ON r.pixel_id = e.pixel_id AND r.slot >= e.slot",
    ),
)
def asof(spark, sf):
    obs = E.obs(spark, sf)
    ends = samples.rollout_frames(obs, 6, 0, block=BLOCK).select("pixel_id", "slot", array_mean(F.col("lags")).alias("m"))
    asked = grid.dense_grid(obs, obs.select("pixel_id").distinct()).filter("v is null or v > 60")
    return blocks.asof_join(asked, ends, ["m"], block=BLOCK)


@query(
    "g05_semi_join_keys",
    ctes(G.sql, final=f"SELECT pixel_id, slot, {R('v')} AS v FROM obs WHERE slot IN (SELECT slot FROM obs WHERE pixel_id = '0_0' AND v > 25)"),
)
def semi(spark, sf):
    obs = G.obs(spark, sf)
    return obs.join(obs.filter("pixel_id = '0_0' and v > 25").select("slot"), "slot", "left_semi")


@query("i03_distinct_anchor_times", ctes(*frames_sql(G, 6, 18), final="SELECT DISTINCT slot FROM fr"))
def distinct_times(spark, sf):
    return samples.anchors(G.obs(spark, sf), 6, 18, block=BLOCK).select("slot").distinct()

"""Time grid, scalar expressions, predicates."""

from pyspark.sql import functions as F

from kelvingrid.functions import scalars
from kelvingrid.operators import grid, samples, split
from kelvingrid.registry.base import BOUNDS_SQL, DIM_SQL, GRID_SQL, R, T_, ctes, dim_of, ev5, g35, query, table

G = g35()
GK = g35(kelvin=True)
E = ev5()


@query(
    "c01_uniform_timeline",
    ctes(E.sql, BOUNDS_SQL, final=f"SELECT slot, {T_(E.time_sql('slot'))} AS ts FROM (SELECT unnest(generate_series(lo, hi)) AS slot FROM b)"),
)
def timeline(spark, sf):
    t = grid.timeline(E.obs(spark, sf))
    return t.select("slot", E.axis.time(F.col("slot")).alias("ts"))


@query("c02_dense_grid", ctes(G.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT pixel_id, slot, {R('v')} AS v FROM grid"))
def dense_grid(spark, sf):
    obs = G.obs(spark, sf)
    return grid.dense_grid(obs, dim_of(obs))


_MIN = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"


@query(
    "c03_off_grid_rows",
    "SELECT count(*) FILTER (WHERE o_orderdate = date_trunc('day', o_orderdate) AND "
    "date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) % 7 = 0) AS n_on_grid, "
    "count(*) FILTER (WHERE NOT (o_orderdate = date_trunc('day', o_orderdate) AND "
    "date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) % 7 = 0)) AS n_off_grid FROM orders",
)
def off_grid(spark, sf):
    obs = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    return grid.off_grid_count(obs, G.axis)


@query(
    "c03_snapped_rows",
    "SELECT o_orderpriority AS pixel_id, date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) // 7 AS slot, "
    "count(*) AS n FROM orders WHERE date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) % 7 = 0 GROUP BY 1, 2",
)
def snapped(spark, sf):
    obs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pixel_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v")
    )
    return grid.slotted(obs, G.axis).groupBy("pixel_id", "slot").agg(F.count("v").alias("n"))


@query(
    "c04_latest_entry_wins",
    "SELECT o_orderpriority AS pixel_id, CAST(floor(date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) / 7.0) AS BIGINT) AS slot, "
    f"{R('max_by(o_totalprice, o_orderkey)')} AS v FROM orders GROUP BY 1, 2",
)
def latest_wins(spark, sf):
    obs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pixel_id"),
        G.axis.slot(F.col("o_orderdate")).alias("slot"),
        F.col("o_totalprice").alias("v"),
        F.col("o_orderkey").alias("path"),
    )
    return grid.latest_wins(obs, "path")


@query(
    "c05_pixel_dimension",
    f"""WITH h AS (SELECT DISTINCT l_partkey % 35 // 7 AS i FROM lineitem), w AS (SELECT DISTINCT l_partkey % 7 AS j FROM lineitem)
    SELECT concat(CAST(i AS VARCHAR), '_', CAST(j AS VARCHAR)) AS pixel_id, i AS lat_idx, j AS lon_idx,
    {R('CAST(-6.8 AS DOUBLE) - i * CAST(0.05 AS DOUBLE)')} AS latitude, {R('CAST(107.5 AS DOUBLE) + j * CAST(0.05 AS DOUBLE)')} AS longitude FROM h CROSS JOIN w""",
)
def pixel_dimension(spark, sf):
    li = table(spark, sf, "lineitem")
    scene = li.agg(
        F.array_sort(F.collect_set(F.floor(F.col("l_partkey") % 35 / 7))).alias("i"),
        F.array_sort(F.collect_set(F.col("l_partkey") % 7)).alias("j"),
    ).select(
        F.transform("i", lambda x: F.lit(-6.8) - x * 0.05).alias("latitude"),
        F.transform("j", lambda x: F.lit(107.5) + x * 0.05).alias("longitude"),
    )
    return grid.pixel_dimension(scene)


@query(
    "g11_attach_pixels",
    ctes(G.sql, DIM_SQL, final=f"SELECT o.pixel_id, slot, {R('v')} AS v, {R('latitude')} AS latitude, {R('longitude')} AS longitude FROM obs o LEFT JOIN dim d ON o.pixel_id = d.pixel_id"),
)
def attach(spark, sf):
    obs = G.obs(spark, sf)
    return grid.attach_pixels(obs, dim_of(obs))


@query(
    "g09_slots_by_pixels",
    ctes(E.sql, BOUNDS_SQL, GRID_SQL, final="SELECT pixel_id, count(*) AS n_slots, count(v) AS n_filled FROM grid GROUP BY 1"),
)
def slots_by_pixels(spark, sf):
    obs = E.obs(spark, sf)
    g = grid.dense_grid(obs, obs.select("pixel_id").distinct())
    return g.groupBy("pixel_id").agg(F.count(F.lit(1)).alias("n_slots"), F.count("v").alias("n_filled"))


@query(
    "c12_grid_geometry",
    ctes(
        G.sql,
        DIM_SQL,
        final=f"""SELECT {R('(max(latitude)-min(latitude))/max(lat_idx)')} AS lat_step, {R('(max(longitude)-min(longitude))/max(lon_idx)')} AS lon_step,
        {R('min(longitude) - (max(longitude)-min(longitude))/max(lon_idx)/2')} AS west, {R('max(longitude) + (max(longitude)-min(longitude))/max(lon_idx)/2')} AS east,
        {R('min(latitude) - (max(latitude)-min(latitude))/max(lat_idx)/2')} AS south, {R('max(latitude) + (max(latitude)-min(latitude))/max(lat_idx)/2')} AS north,
        {R('(min(latitude)+max(latitude))/2')} AS lat_center FROM dim""",
    ),
)
def geometry(spark, sf):
    return grid.grid_geometry(dim_of(G.obs(spark, sf)))


@query(
    "c11_missing_pixels",
    """WITH have AS (SELECT DISTINCT c_nationkey AS i, c_custkey % 997 AS j FROM customer),
    want AS (SELECT i, j FROM (SELECT unnest(generate_series(0, 24)) AS i) CROSS JOIN (SELECT unnest(generate_series(0, 996)) AS j))
    SELECT concat(CAST(w.i AS VARCHAR), '_', CAST(w.j AS VARCHAR)) AS pixel_id, w.i AS lat_idx, w.j AS lon_idx
    FROM want w LEFT JOIN have h ON w.i = h.i AND w.j = h.j WHERE h.i IS NULL""",
)
def missing_pixels(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("lat_idx"), (F.col("c_custkey") % 997).alias("lon_idx")
    )
    return grid.missing_pixels(rows, 25, 997)


@query(
    "c13_grid_rows",
    ctes(
        G.sql,
        DIM_SQL,
        final="SELECT slot AS step, lat_idx, "
        + ", ".join(f"{R(f'max(v) FILTER (WHERE lon_idx = {j})')} AS lon_{j}" for j in range(7))
        + " FROM obs o JOIN dim d ON o.pixel_id = d.pixel_id GROUP BY 1, 2",
    ),
)
def grid_rows(spark, sf):
    obs = G.obs(spark, sf)
    rows = grid.attach_pixels(obs, dim_of(obs), ("lat_idx", "lon_idx")).withColumnRenamed("slot", "step")
    return grid.grid_rows(rows, "v", 5, 7)


# predicates and splits


@query(
    "b01_bounding_box",
    ctes(
        G.sql,
        DIM_SQL,
        final=f"SELECT pixel_id, {R('latitude')} AS latitude, {R('longitude')} AS longitude, count(*) OVER () > 0 AS any_left FROM dim WHERE round(latitude, 6) BETWEEN -7.0 AND -6.8 AND round(longitude, 6) BETWEEN 107.5 AND 107.7",
    ),
)
def bounding_box(spark, sf):
    dim = dim_of(G.obs(spark, sf))
    box = grid.bounding_box(dim, -7.0, -6.8, 107.5, 107.7).select("pixel_id", "latitude", "longitude")
    return box.withColumn("any_left", grid.any_left(box).scalar())


@query("b01_empty_box", ctes(G.sql, DIM_SQL, final="SELECT count(*) > 0 AS any_left FROM dim WHERE latitude BETWEEN 10.0 AND 11.0"))
def empty_box(spark, sf):
    return grid.any_left(grid.bounding_box(dim_of(G.obs(spark, sf)), 10.0, 11.0, 107.5, 107.7))


def _bounds(obs):
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    total = hi - lo + 1
    return lo, lo + int(total * 0.7), lo + int(total * 0.85), hi


_CUT = """cut AS (SELECT lo, hi, lo + CAST(floor((hi - lo + 1) * 0.7) AS BIGINT) AS a, lo + CAST(floor((hi - lo + 1) * 0.85) AS BIGINT) AS c FROM b)"""


@query(
    "b02_chronological_split",
    ctes(
        G.sql,
        BOUNDS_SQL,
        _CUT,
        final=f"""SELECT CASE WHEN slot <= a THEN 'train' ELSE 'test' END AS side, pixel_id, slot, {R('v')} AS v
        FROM obs CROSS JOIN cut WHERE slot <= a OR slot >= c""",
    ),
)
def chronological(spark, sf):
    obs = G.obs(spark, sf)
    _, a, c, hi = _bounds(obs)
    train, test = split.chronological_split(obs, a, c, hi)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(
    "b03_time_slice",
    ctes(E.sql, final=f"SELECT pixel_id, slot, {R('v')} AS v FROM obs WHERE hour({E.time_sql('slot')} + INTERVAL 7 HOUR) BETWEEN 6 AND 17"),
)
def time_slice(spark, sf):
    """Daytime rows."""
    return E.obs(spark, sf).filter(scalars.local_hour(E.axis.time(F.col("slot"))).between(6, 17))


@query(
    "b04_fit_validation_split",
    ctes(
        G.sql,
        BOUNDS_SQL,
        _CUT,
        final="""SELECT CASE WHEN slot <= a THEN 'train' WHEN slot >= a + 1 AND slot <= c - 1 THEN 'test' END AS split,
        count(*) AS n, min(slot) AS first_slot, max(slot) AS last_slot FROM obs CROSS JOIN cut GROUP BY 1""",
    ),
)
def fit_validation(spark, sf):
    obs = G.obs(spark, sf)
    _, a, c, _ = _bounds(obs)
    part = split.split_label(F.col("slot"), a, a + 1, c - 1)
    return obs.groupBy(part.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


@query(
    "b07_drop_null_target",
    ctes(G.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT pixel_id, slot, {R('v')} AS y_true FROM grid WHERE v IS NOT NULL"),
)
def drop_null(spark, sf):
    obs = G.obs(spark, sf)
    return grid.dense_grid(obs, dim_of(obs)).withColumnRenamed("v", "y_true").na.drop(subset=["y_true"])


@query(
    "b08_time_range_read",
    f"SELECT event_id, event_type, {R('value')} AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'",
)
def time_range(spark, sf):
    t = lambda x: F.to_timestamp_ntz(F.lit(x))
    ev = table(spark, sf, "events")
    return ev.filter(F.col("ts").between(t("2024-01-10 06:00:00"), t("2024-01-12 18:00:00"))).select(
        "event_id", "event_type", "value"
    )


@query(
    "b10_narrow_and_widen",
    f"SELECT event_id, {R('CAST(CAST(value AS FLOAT) AS DOUBLE)', 4)} AS v, CAST(CAST(event_id AS INTEGER) AS BIGINT) AS id32 FROM events",
    digits=4,
)
def narrow(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("value").cast("float").cast("double").alias("v"), F.col("event_id").cast("int").alias("id32")
    )


# scalar expressions


@query(
    "e01_local_time",
    f"SELECT event_id, {T_('ts + INTERVAL 7 HOUR')} AS local_ts FROM events",
)
def local_time(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.to_local(F.col("ts")).alias("local_ts"))


_L = "(ts + INTERVAL 7 HOUR)"


@query(
    "e02_local_minute_hour",
    f"SELECT event_id, CAST(hour({_L}) * 60 + minute({_L}) AS BIGINT) AS minute_of_day, CAST(hour({_L}) AS BIGINT) AS hour_of_day FROM events",
)
def local_parts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", scalars.local_minute(ts).alias("minute_of_day"), scalars.local_hour(ts).alias("hour_of_day")
    )


@query(
    "e03_cyclic_time",
    f"SELECT event_id, {R(f'sin((hour({_L}) * 60 + minute({_L})) * 2 * pi() / 1440)')} AS hour_sin, {R(f'cos((hour({_L}) * 60 + minute({_L})) * 2 * pi() / 1440)')} AS hour_cos FROM events",
)
def cyclic(spark, sf):
    s, c = scalars.cyclic_time(F.col("ts"))
    return table(spark, sf, "events").select("event_id", s.alias("hour_sin"), c.alias("hour_cos"))


@query(
    "e04_target_time",
    ctes(
        E.sql,
        final=f"SELECT pixel_id, slot, k AS step, {T_(E.time_sql('slot + k'))} AS target_time FROM obs CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS k)",
    ),
)
def target_time(spark, sf):
    rows = E.obs(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.select(
        "pixel_id", "slot", "step", E.axis.offset(E.axis.time(F.col("slot")), F.col("step")).alias("target_time")
    )


@query(
    "e05_risk_class",
    ctes(GK.sql, final=f"SELECT pixel_id, slot, {R('v')} AS v, CASE WHEN v < 200 THEN 'deep_convective' WHEN v < 270 THEN 'moderate_cloud' WHEN v >= 270 THEN 'clear' END AS risk FROM obs"),
)
def risk_class(spark, sf):
    return GK.obs(spark, sf).withColumn("risk", scalars.risk_class(F.col("v")))


@query(
    "e06_risk_code",
    ctes(GK.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT pixel_id, slot, CAST(CASE WHEN v < 200 THEN 2 WHEN v <= 270 THEN 1 WHEN v > 270 THEN 0 END AS BIGINT) AS code FROM grid"),
)
def risk_code(spark, sf):
    obs = GK.obs(spark, sf)
    return grid.dense_grid(obs, dim_of(obs)).select("pixel_id", "slot", scalars.risk_code(F.col("v")).alias("code"))


@query(
    "e07_errors",
    f"SELECT l_orderkey, l_linenumber, {R('l_quantity - l_tax * 100')} AS signed_error, {R('abs(l_quantity - l_tax * 100)')} AS abs_error FROM lineitem",
)
def errors(spark, sf):
    p, t = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.signed_error(p, t).alias("signed_error"), scalars.abs_error(p, t).alias("abs_error")
    )


@query(
    "e08_damping_blend",
    f"SELECT l_orderkey, l_linenumber, {R('(1 - least(0.15 * (l_linenumber - 1), 0.6)) * l_quantity + least(0.15 * (l_linenumber - 1), 0.6) * 25.5')} AS damped FROM lineitem",
)
def damping(spark, sf):
    w = scalars.damping_weight(F.col("l_linenumber") - 1, 0.15, 0.6)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.blend(F.col("l_quantity"), F.lit(25.5), w).alias("damped")
    )


@query(
    "e09_numeric_guards",
    f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0.0 END')} AS ratio, {R('sqrt(greatest(l_tax * l_tax - l_discount * l_discount, 0.0))')} AS spread FROM lineitem",
)
def guards(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.guarded_ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"),
        scalars.clipped_std(F.col("l_tax") * F.col("l_tax"), F.col("l_discount")).alias("spread"),
    )


@query(
    "e10_pct_change",
    f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / abs(l_discount) * 100 END')} AS pct FROM lineitem",
)
def pct(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.pct_change(F.col("l_discount"), F.col("l_tax")).alias("pct")
    )


@query(
    "e11_time_formats",
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
)
def formats(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", scalars.compact_time(ts).alias("compact"), scalars.iso_time(ts).alias("iso")
    )


@query(
    "e12_path_label",
    """SELECT page_id, trim(left(spec, length(spec) - length(l) - 1)) AS path, trim(l) AS label FROM (
    SELECT page_id, spec, list_extract(string_split(spec, ':'), -1) AS l FROM (SELECT page_id, concat(url, ' : run ', CAST(page_id % 7 AS VARCHAR)) AS spec FROM pages))""",
)
def path_label(spark, sf):
    spec = F.concat(F.col("url"), F.lit(" : run "), F.col("page_id") % 7)
    path, label = scalars.split_label(spec)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), label.alias("label"))


_SZ = "CAST(n_chars AS DOUBLE) * n_chars * n_chars"


@query(
    "e13_human_size",
    f"""SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2fB', s) WHEN s / 1024 < 1024 THEN printf('%.2fKB', s / 1024)
    WHEN s / 1048576 < 1024 THEN printf('%.2fMB', s / 1048576) WHEN s / 1073741824 < 1024 THEN printf('%.2fGB', s / 1073741824)
    ELSE printf('%.2fTB', s / 1099511627776) END AS size FROM (SELECT doc_id, {_SZ} AS s FROM documents)""",
)
def human_size(spark, sf):
    n = F.col("n_chars").cast("double") * F.col("n_chars") * F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", scalars.human_size(n).alias("size"))


@query(
    "a19_first_times",
    ctes(E.sql, final=f"SELECT pixel_id, slot, {R('v')} AS v FROM obs WHERE slot IN (SELECT DISTINCT slot FROM obs ORDER BY slot LIMIT 50)"),
)
def first_times(spark, sf):
    return samples.first_times(E.obs(spark, sf), 50)


@query(
    "a20_recent_times",
    ctes(E.sql, final=f"SELECT pixel_id, slot, {R('v')} AS v FROM obs WHERE slot IN (SELECT DISTINCT slot FROM obs WHERE slot <= 600 ORDER BY slot DESC LIMIT 100)"),
)
def recent_times(spark, sf):
    return samples.recent_rows(E.obs(spark, sf), 100, 600)

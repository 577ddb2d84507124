"""Climatology, correlation, clusters, autocorrelation, unit roots, masks."""

from pyspark.sql import functions as F

from kelvingrid.operators import climate, correlation, grid, mask, unitroot
from kelvingrid.registry.base import BOUNDS_SQL, DIM_SQL, GRID_SQL, R, ctes, dim_of, ev5, g35, query, suppliers, table
from kelvingrid.registry.evaluation_queries import detail, detail_sql
from kelvingrid.sources import geojson

G = g35()
GK = g35(kelvin=True)
E = ev5()
S = suppliers()
BLOCK = 64

_HOUR = f"CAST(hour({E.time_sql('slot')} + INTERVAL 7 HOUR) AS BIGINT)"
_DIURNAL = [
    E.sql,
    BOUNDS_SQL,
    GRID_SQL,
    "sl AS (SELECT slot, avg(v) AS m FROM grid GROUP BY 1)",
    f"di AS (SELECT {_HOUR} AS hour_wib, avg(m) AS mean_ctt, stddev_samp(m) AS std_ctt, count(m) AS n_obs FROM sl GROUP BY 1)",
]


@query("f09_diurnal_cycle", ctes(*_DIURNAL, final=f"SELECT hour_wib, {R('mean_ctt')} AS mean_ctt, {R('std_ctt')} AS std_ctt, n_obs FROM di"))
def diurnal(spark, sf):
    return climate.diurnal_cycle(E.obs(spark, sf), E.axis)


@query("f10_coldest_hour", ctes(*_DIURNAL, final=f"SELECT hour_wib, {R('mean_ctt')} AS mean_ctt FROM di ORDER BY di.mean_ctt, hour_wib LIMIT 1"))
def coldest(spark, sf):
    return climate.coldest_hour(climate.diurnal_cycle(E.obs(spark, sf), E.axis))


_RISK = f"{R('avg(CASE WHEN v < 200 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END)')} AS deep_convective, {R('avg(CASE WHEN v >= 200 AND v < 270 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END)')} AS moderate_cloud, {R('avg(CASE WHEN v >= 270 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END)')} AS clear, count(v) AS n_obs"


@query("f11_risk_shares", ctes(GK.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT {_RISK} FROM grid"))
def risk(spark, sf):
    obs = GK.obs(spark, sf)
    return climate.risk_shares(grid.dense_grid(obs, dim_of(obs)))


@query("f11_risk_shares_by_pixel", ctes(GK.sql, final=f"SELECT pixel_id, {_RISK} FROM obs GROUP BY 1"))
def risk_by_pixel(spark, sf):
    return climate.risk_shares(GK.obs(spark, sf), by=("pixel_id",))


@query(
    "f12_distribution",
    ctes(
        S.sql,
        "m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM obs)",
        final=f"""SELECT {R('avg(v)', 4)} AS mean, {R('stddev_pop(v)', 4)} AS std, {R('avg(((v - mu) / sd) ** 3)', 4)} AS skewness, {R('avg(((v - mu) / sd) ** 4) - 3', 4)} AS kurtosis,
        {R('min(v)', 4)} AS min, {R('max(v)', 4)} AS max, count(*) AS n_obs FROM obs CROSS JOIN m""",
    ),
    digits=4,
)
def distribution(spark, sf):
    return climate.distribution(S.obs(spark, sf))


@query(
    "f13_pixel_correlation",
    ctes(
        G.sql,
        final=f"""SELECT a.pixel_id AS pixel_a, b.pixel_id AS pixel_b, count(*) AS n, {R('CASE WHEN a.pixel_id = b.pixel_id THEN 1.0 ELSE corr(a.v, b.v) END')} AS r
        FROM obs a JOIN obs b ON a.slot = b.slot GROUP BY a.pixel_id, b.pixel_id""",
    ),
)
def pixel_correlation(spark, sf):
    """Small tiles and chunks, so that the blocked product is exercised."""
    return correlation.pixel_correlation(G.obs(spark, sf), tile_pixels=16, chunk_slots=128)


@query(
    "f13_supplier_correlation",
    ctes(
        S.sql,
        final=f"""SELECT a.pixel_id AS pixel_a, b.pixel_id AS pixel_b, count(*) AS n, {R('CASE WHEN count(*) > 1 THEN corr(a.v, b.v) END')} AS r
        FROM obs a JOIN obs b ON a.slot = b.slot AND a.pixel_id < b.pixel_id GROUP BY a.pixel_id, b.pixel_id""",
    ),
)
def supplier_correlation(spark, sf):
    return correlation.pixel_correlation(S.obs(spark, sf), mirror=False)


@query(
    "f13_neighbour_correlation",
    ctes(
        S.sql, DIM_SQL, "pl AS (SELECT pixel_id, slot, v, lat_idx, lon_idx FROM obs JOIN dim USING (pixel_id))",
        final=f"""SELECT a.pixel_id AS pixel_a, b.pixel_id AS pixel_b, count(*) AS n, {R('CASE WHEN count(*) > 1 THEN corr(a.v, b.v) END')} AS r
        FROM pl a JOIN pl b ON a.slot = b.slot AND a.pixel_id < b.pixel_id AND (a.lat_idx - b.lat_idx) ** 2 + (a.lon_idx - b.lon_idx) ** 2 <= 9
        GROUP BY a.pixel_id, b.pixel_id""",
    ),
)
def neighbour_correlation(spark, sf):
    """Suppliers at most three cells apart."""
    obs = S.obs(spark, sf)
    return correlation.neighbour_correlation(obs, dim_of(obs), 3)


@query(
    "f14_onset_counts",
    ctes(
        GK.sql,
        "ev AS (SELECT a.pixel_id FROM obs a JOIN obs p ON a.pixel_id = p.pixel_id AND p.slot = a.slot - 3 WHERE a.v - p.v <= -15)",
        final="SELECT pixel_id, count(*) AS n_events FROM ev GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM ev",
    ),
)
def onset_counts(spark, sf):
    return climate.onset_counts(climate.onset_events(GK.obs(spark, sf), block=BLOCK))


def _acf(numbering: str, match: str) -> str:
    return ctes(
        E.sql,
        f"c AS (SELECT pixel_id, {numbering} AS i, v - avg(v) OVER (PARTITION BY pixel_id) AS d FROM obs)",
        "z AS (SELECT pixel_id, sum(d * d) AS s0 FROM c GROUP BY 1)",
        f"""l AS (SELECT a.pixel_id, k AS lag, sum(a.d * b.d) AS s FROM c a CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS k)
          JOIN c b ON b.pixel_id = a.pixel_id AND b.i = {match} GROUP BY 1, 2)""",
        final=f"SELECT l.pixel_id, lag, {R('s / s0')} AS acf FROM l JOIN z ON l.pixel_id = z.pixel_id",
    )


@query("f15_autocorrelation", _acf("row_number() OVER (PARTITION BY pixel_id ORDER BY slot)", "a.i - k"))
def acf(spark, sf):
    return climate.acf_pacf(E.obs(spark, sf), 12, block=BLOCK).select("pixel_id", "lag", "acf")


@query("f15_autocorrelation_gap_aware", _acf("slot", "a.i - k"))
def acf_gap_aware(spark, sf):
    return climate.acf_pacf(E.obs(spark, sf), 12, gap_aware=True, block=BLOCK).select("pixel_id", "lag", "acf")


@query("f16_partial_autocorrelation")
def pacf(spark, sf):
    return climate.acf_pacf(E.obs(spark, sf), 24).select("pixel_id", "lag", "pacf")


_PACF_3 = ctes(
    E.sql,
    "c AS (SELECT pixel_id, row_number() OVER (PARTITION BY pixel_id ORDER BY slot) AS i, v - avg(v) OVER (PARTITION BY pixel_id) AS d, count(*) OVER (PARTITION BY pixel_id) AS n FROM obs)",
    "w AS (SELECT *, lag(d, 1) OVER p AS d1, lag(d, 2) OVER p AS d2, lag(d, 3) OVER p AS d3 FROM c WINDOW p AS (PARTITION BY pixel_id ORDER BY i))",
    "s AS (SELECT pixel_id, sum(d * d) / any_value(n) AS r0, sum(d * d1) / (any_value(n) - 1) AS r1, sum(d * d2) / (any_value(n) - 2) AS r2, sum(d * d3) / (any_value(n) - 3) AS r3 FROM w GROUP BY 1)",
    "q AS (SELECT pixel_id, r1 / r0 AS a, r2 / r0 AS b, r3 / r0 AS c FROM s)",
    "t AS (SELECT pixel_id, a AS p1, (b - a * a) / (1 - a * a) AS p2, (c - 2 * a * b + a * a * a - a * a * c + a * b * b) / (1 - 2 * a * a - b * b + 2 * a * a * b) AS p3 FROM q)",
    "u AS (SELECT pixel_id, unnest([1, 2, 3]) AS lag, unnest([p1, p2, p3]) AS p FROM t)",
    final=f"SELECT pixel_id, lag, {R('p')} AS pacf FROM u",
)


@query("f16_partial_autocorrelation_first_lags", _PACF_3)
def pacf_first(spark, sf):
    """Lags 1 to 3, whose Yule-Walker systems have a solution in closed form."""
    return climate.acf_pacf(E.obs(spark, sf), 3, block=BLOCK).filter("lag > 0").select("pixel_id", "lag", "pacf")


_DICKEY_FULLER = [
    E.sql,
    "c AS (SELECT pixel_id, slot, v, lag(v) OVER (PARTITION BY pixel_id ORDER BY slot) AS y, count(*) OVER (PARTITION BY pixel_id) AS n FROM obs)",
    """r AS (SELECT pixel_id, any_value(n) AS n, regr_slope(v - y, y) AS b, regr_sxx(v - y, y) AS sxx, regr_syy(v - y, y) AS syy, regr_count(v - y, y) AS k
      FROM c GROUP BY 1)""",
    f"t AS (SELECT pixel_id, n, CASE WHEN n >= {unitroot.MIN_POINTS} THEN b / sqrt((syy - b * b * sxx) / (k - 2) / sxx) END AS stat FROM r)",
]


@query("f17_unit_root_no_lags", ctes(*_DICKEY_FULLER, final=f"SELECT pixel_id, {R('stat')} AS adf_stat, n AS n_obs_used FROM t"))
def unit_root_no_lags(spark, sf):
    """The test without lagged differences, a regression on one value."""
    return unitroot.unit_root(E.obs(spark, sf), max_lag=0, block=BLOCK).select("pixel_id", "adf_stat", "n_obs_used")


@query("f17_unit_root")
def unit_root(spark, sf):
    return unitroot.unit_root(G.obs(spark, sf))


@query("f18_stationary_count")
def stationary(spark, sf):
    return unitroot.stationary_count(unitroot.unit_root(E.obs(spark, sf)))


_LINKAGE = ctes(
    G.sql,
    "px AS MATERIALIZED (SELECT DISTINCT pixel_id FROM obs)",
    """known AS MATERIALIZED (SELECT a.pixel_id AS a, b.pixel_id AS b, 1 - corr(a.v, b.v) AS d
        FROM obs a JOIN obs b ON a.slot = b.slot AND a.pixel_id <> b.pixel_id GROUP BY 1, 2 HAVING count(*) > 1)""",
    """dist AS MATERIALIZED (SELECT x.pixel_id AS a, y.pixel_id AS b, coalesce(CASE WHEN isfinite(k.d) THEN k.d END, 2.0) AS d
        FROM px x JOIN px y ON x.pixel_id <> y.pixel_id LEFT JOIN known k ON k.a = x.pixel_id AND k.b = y.pixel_id)""",
    # one merge a step: the pair of clusters with the least mean distance becomes the one with the smaller name
    """steps AS (SELECT 0 AS i, pixel_id, pixel_id AS c FROM px
        UNION ALL
        SELECT m.i + 1, m.pixel_id, CASE WHEN m.c = best.b THEN best.a ELSE m.c END
        FROM steps m, (SELECT p.c AS a, q.c AS b FROM steps p JOIN dist ON dist.a = p.pixel_id JOIN steps q ON q.pixel_id = dist.b
            WHERE p.c < q.c GROUP BY 1, 2 ORDER BY avg(d), 1, 2 LIMIT 1) best
        WHERE (SELECT count(DISTINCT c) FROM steps) > 4)""",
    "final AS (SELECT pixel_id, c FROM steps WHERE i = (SELECT max(i) FROM steps))",
    DIM_SQL,
    final=f"""SELECT pixel_id, {R("latitude")} AS latitude, {R("longitude")} AS longitude, dense_rank() OVER (ORDER BY c) AS cluster_id FROM final JOIN dim USING (pixel_id)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("j17_pixel_clusters", _LINKAGE)
def clusters(spark, sf):
    obs = G.obs(spark, sf)
    return correlation.pixel_clusters(obs, dim_of(obs), 4)


_STATUS = ctes(
    *detail_sql(GK, 3, 3, ("persistence", "window_mean")),
    final=f"""SELECT step, count(*) FILTER (WHERE y_pred > 270) AS n_safe, count(*) FILTER (WHERE y_pred >= 200 AND y_pred <= 270) AS n_watch,
    count(*) FILTER (WHERE y_pred < 200) AS n_danger, {R('avg(abs_error)')} AS mae_step FROM (SELECT step, abs_error, {R('y_pred')} AS y_pred FROM detail) GROUP BY 1""",
)


@query("f32_status_counts", _STATUS)
def status_counts(spark, sf):
    from kelvingrid.registry.base import settle

    d = detail(GK.obs(spark, sf), ("persistence", "window_mean"), 3, 3)
    return climate.status_counts(d.withColumn("y_pred", settle(F.col("y_pred"))))


# boundary polygons derived from the supplier table: one slanted quadrilateral each,
# every third one as part of a MultiPolygon


def _ring(x, y):
    point = lambda dx, dy: F.array(x + dx, y + dy)
    return F.array(point(-0.031, -0.017), point(0.043, -0.023), point(0.037, 0.029), point(-0.027, 0.021))


def _centers(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.lit(107.4571) + (k % 17) * 0.0133).alias("x"),
        (F.lit(-7.0313) + (k % 13) * 0.0191).alias("y"),
    )


def boundary_documents(spark, sf):
    ring = _ring(F.col("x"), F.col("y"))
    multi = F.col("s_suppkey") % 3 == 0
    coords = F.when(multi, F.to_json(F.array(F.array(ring)))).otherwise(F.to_json(F.array(ring)))
    kind = F.when(multi, "MultiPolygon").otherwise("Polygon")
    text = F.format_string(
        '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"%s","coordinates":%s}},'
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]}}]}',
        kind,
        coords,
    )
    broken = F.when(F.col("s_suppkey") % 7 == 0, F.lit("{not json")).otherwise(text)
    return _centers(spark, sf).select(F.col("s_suppkey").alias("doc_id"), broken.alias("text"))


_CENTERS = """ce AS (SELECT s_suppkey, CAST(107.4571 AS DOUBLE) + (s_suppkey % 17) * CAST(0.0133 AS DOUBLE) AS x,
  CAST(-7.0313 AS DOUBLE) + (s_suppkey % 13) * CAST(0.0191 AS DOUBLE) AS y FROM supplier WHERE s_suppkey % 7 <> 0)"""
_CORNERS = "co AS (SELECT * FROM (VALUES (0, -0.031, -0.017), (1, 0.043, -0.023), (2, 0.037, 0.029), (3, -0.027, 0.021)) t(i, dx, dy))"


@query(
    "a18_polygon_rings",
    ctes(
        _CENTERS,
        _CORNERS,
        final=f"SELECT concat(CAST(s_suppkey AS VARCHAR), '/0/0') AS ring_id, CAST(i AS BIGINT) AS i, {R('x + dx')} AS lon, {R('y + dy')} AS lat FROM ce CROSS JOIN co",
    ),
)
def polygon_rings(spark, sf):
    rings = geojson.outer_rings(boundary_documents(spark, sf))
    return rings.select("ring_id", F.posexplode("ring").alias("i", "p")).select(
        "ring_id", "i", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")
    )


_LAT = "CAST(-6.8 AS DOUBLE) - lat_idx * CAST(0.05 AS DOUBLE)"
_INSIDE = [
    G.sql,
    DIM_SQL,
    _CENTERS,
    _CORNERS,
    """ed AS (SELECT s_suppkey, x + a.dx AS x1, y + a.dy AS y1, x + b.dx AS x2, y + b.dy AS y2 FROM ce CROSS JOIN co a JOIN co b ON b.i = (a.i + 1) % 4)""",
    """pt AS (SELECT pixel_id, i, j, longitude - 0.025 + j * CAST(0.05 AS DOUBLE) / 6 AS px, latitude - 0.025 + i * CAST(0.05 AS DOUBLE) / 6 AS py
      FROM dim CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS i) CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS j))""",
    """hit AS (SELECT DISTINCT pixel_id FROM (SELECT pixel_id, i, j, s_suppkey FROM pt CROSS JOIN ed
      WHERE (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1))""",
]


def _mask(spark, sf, obs):
    return mask.boundary_mask(dim_of(obs), geojson.outer_rings(boundary_documents(spark, sf)), 0.05, 0.05)


@query("c14_boundary_mask", ctes(*_INSIDE, final="SELECT pixel_id, pixel_id IN (SELECT pixel_id FROM hit) OR NOT EXISTS (SELECT 1 FROM ce) AS inside FROM dim"))
def boundary_mask(spark, sf):
    return _mask(spark, sf, G.obs(spark, sf))


@query("b11_masked_values", ctes(*_INSIDE, final=f"SELECT pixel_id, slot, CASE WHEN pixel_id IN (SELECT pixel_id FROM hit) OR NOT EXISTS (SELECT 1 FROM ce) THEN {R('v')} END AS v FROM obs"))
def masked(spark, sf):
    obs = G.obs(spark, sf)
    return mask.masked(obs, _mask(spark, sf, obs))


@query("b11_kept_pixels", ctes(*_INSIDE, final="SELECT pixel_id FROM dim WHERE pixel_id IN (SELECT pixel_id FROM hit) OR NOT EXISTS (SELECT 1 FROM ce)"))
def kept(spark, sf):
    return mask.kept_pixels(_mask(spark, sf, G.obs(spark, sf)))

"""Catalog, ledger, tally, scene quality, storage round trips."""

from pyspark.sql import functions as F

from kelvingrid.operators import grid, split
from kelvingrid.registry.base import BOUNDS_SQL, GRID_SQL, R, T_, ctes, ev5, g35, query, table
from kelvingrid.registry.evaluation_queries import detail, detail_sql
from kelvingrid.session import scratch_path
from kelvingrid.sources import catalog, tables

G = g35()
M = g35(28)
E = ev5()


def scene_files(spark, sf):
    """One file entry per order: directory by priority, name by time, some names and sizes bad."""
    k = F.col("o_orderkey")
    at = F.timestamp_add("MINUTE", (k % 144) * 10, F.col("o_orderdate"))
    name = F.concat(
        F.lit("subset_"),
        F.when(k % 13 == 0, "NCH09").otherwise("NC_H09"),
        F.lit("_"),
        F.date_format(at, "yyyyMMdd_HHmm"),
        F.when(k % 9 == 0, "_R21_FLDK.06001_06001").otherwise("_R21_FLDK.02801_02401"),
        F.when(k % 11 == 0, ".tmp").otherwise(".nc"),
    )
    rows = table(spark, sf, "orders").select(
        F.lower(F.substring("o_orderpriority", 1, 1)).alias("dir"),
        name.alias("file_name"),
        F.floor(F.col("o_totalprice") / 10).cast("bigint").alias("length"),
        "o_orderkey",
        "o_orderstatus",
    )
    return rows.withColumn("path", F.concat_ws("/", "dir", "file_name"))


FILES_SQL = """fi AS (SELECT *, concat(dir, '/', file_name) AS path FROM (SELECT lower(substr(o_orderpriority, 1, 1)) AS dir,
  concat('subset_', CASE WHEN o_orderkey % 13 = 0 THEN 'NCH09' ELSE 'NC_H09' END, '_', strftime(o_orderdate + to_minutes(CAST(o_orderkey % 144 * 10 AS BIGINT)), '%Y%m%d_%H%M'),
  CASE WHEN o_orderkey % 9 = 0 THEN '_R21_FLDK.06001_06001' ELSE '_R21_FLDK.02801_02401' END, CASE WHEN o_orderkey % 11 = 0 THEN '.tmp' ELSE '.nc' END) AS file_name,
  CAST(floor(o_totalprice / 10) AS BIGINT) AS length, o_orderkey, o_orderstatus FROM orders))"""
_TIME = "CASE WHEN regexp_matches(file_name, 'NC_H\\d+_\\d{8}_\\d{4}_') THEN strptime(regexp_extract(file_name, 'NC_H\\d+_(\\d{8}_\\d{4})_', 1), '%Y%m%d_%H%M') END"


@query("a01_file_catalog", ctes(FILES_SQL, final=f"SELECT * FROM (SELECT path, file_name, length, {T_(_TIME)} AS obs_time FROM fi) WHERE obs_time IS NOT NULL"))
def file_catalog(spark, sf):
    return catalog.catalog_of(scene_files(spark, sf).select("path", "length"))


@query("a01_unparsed_names", ctes(FILES_SQL, final=f"SELECT path, length FROM fi WHERE {_TIME} IS NULL"))
def unparsed_names(spark, sf):
    return catalog.unparsed(scene_files(spark, sf).select("path", "length"))


@query(
    "a01_listing_of_written_files",
    ctes(E.sql, final="SELECT TRUE AS filled, count(DISTINCT slot // 24) AS n_files, CAST(0 AS BIGINT) AS n_catalogued FROM obs"),
)
def listing(spark, sf):
    """A recursive listing of real files, one small text part per day of EV5; their names hold no time, so the catalog drops them all."""
    base = scratch_path(spark, "listing")
    days = E.obs(spark, sf).groupBy(F.floor(F.col("slot") / 24).alias("day")).agg(F.count("v").alias("n"))
    days.repartition("day").write.partitionBy("day").json(base)
    kept = catalog.file_catalog(spark, base, "*.json").agg(F.count(F.lit(1))).scalar()
    dropped = catalog.unparsed(catalog.file_listing(spark, base, "*.json"))
    return dropped.groupBy((F.col("length") > 0).alias("filled")).agg(F.count(F.lit(1)).alias("n_files")).withColumn("n_catalogued", kept)


@query("a02_name_filter", ctes(FILES_SQL, final="SELECT dir, file_name FROM fi WHERE contains(file_name, 'R21_FLDK.02801_02401') AND suffix(file_name, '.nc')"))
def name_filter(spark, sf):
    return catalog.wanted_names(scene_files(spark, sf)).select("dir", "file_name")


@query("a03_time_from_name", ctes(FILES_SQL, final=f"SELECT o_orderkey, {T_(_TIME)} AS obs_time FROM fi"))
def time_from_name(spark, sf):
    return scene_files(spark, sf).select("o_orderkey", catalog.scene_time(F.col("file_name")).alias("obs_time"))


@query("a04_size_filter", ctes(FILES_SQL, final="SELECT dir, file_name, length FROM fi WHERE length >= 10000"))
def size_filter(spark, sf):
    return catalog.large_enough(scene_files(spark, sf)).select("dir", "file_name", "length")


_LEDGER = "SELECT dir, file_name FROM fi WHERE o_orderstatus = 'F'"


@query("a05_ledger_unchecked", ctes(FILES_SQL, final=f"SELECT DISTINCT dir, file_name FROM fi EXCEPT {_LEDGER}"))
def unchecked(spark, sf):
    files = scene_files(spark, sf)
    return catalog.unchecked(files, files.filter("o_orderstatus = 'F'")).select("dir", "file_name")


@query("i04_ledger_round_trip", ctes(FILES_SQL, final="SELECT DISTINCT dir, file_name FROM fi WHERE o_orderstatus IN ('F', 'O')"))
def ledger(spark, sf):
    """Two overlapping appends; the ledger reads back as a set."""
    files = scene_files(spark, sf)
    path = scratch_path(spark, "ledger")
    catalog.append_ledger(files.filter("o_orderstatus = 'F'"), path)
    catalog.append_ledger(files.filter("o_orderstatus in ('F', 'O')"), path)
    return catalog.read_ledger(spark, path)


@query("g06_not_yet_processed", ctes(FILES_SQL, final=f"SELECT dir, count(*) AS n FROM (SELECT DISTINCT dir, file_name FROM fi EXCEPT {_LEDGER}) GROUP BY 1"))
def not_processed(spark, sf):
    files = scene_files(spark, sf)
    left = catalog.unchecked(files, files.filter("o_orderstatus = 'F'"))
    return left.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


_STATUS_SQL = "ou AS (SELECT dir, file_name, CASE WHEN length < 10000 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'skipped' WHEN o_orderkey % 4 = 0 THEN 'without_data' WHEN o_orderkey % 4 = 1 THEN 'retried' ELSE 'with_data' END AS status FROM fi)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in catalog.STATUSES) + ", count(*) FILTER (WHERE NOT status IN ('" + "', '".join(catalog.STATUSES) + "')) AS other"


def _outcomes(spark, sf):
    status = (
        F.when(F.col("length") < 10000, "failed")
        .when(F.col("o_orderstatus") == "F", "skipped")
        .when(F.col("o_orderkey") % 4 == 0, "without_data")
        .when(F.col("o_orderkey") % 4 == 1, "retried")
        .otherwise("with_data")
    )
    return scene_files(spark, sf).withColumn("status", status)


@query("a06_outcome_tally", ctes(FILES_SQL, _STATUS_SQL, final=f"SELECT dir, {_COUNTS} FROM ou GROUP BY ROLLUP (dir)"))
def tally(spark, sf):
    return catalog.outcome_tally(_outcomes(spark, sf))


@query("a06_failed_files", ctes(FILES_SQL, _STATUS_SQL, final="SELECT dir, file_name FROM ou WHERE status = 'failed'"))
def failed(spark, sf):
    return catalog.failed_files(_outcomes(spark, sf))


_SCENES = f"""sc AS (SELECT slot AS scene, slot, pixel_id, CAST(split_part(pixel_id, '_', 1) AS BIGINT) AS lat_idx, CAST(split_part(pixel_id, '_', 2) AS BIGINT) AS lon_idx,
  CASE WHEN slot % 10 <> 3 THEN v END AS tbb_13, slot % 17 = 5 AS unreadable FROM obs)"""
_QUALITY = """qu AS (SELECT scene, CASE WHEN bool_or(unreadable) THEN 'error' WHEN count(tbb_13) = 0 THEN 'missing_channel'
  WHEN count(*) <> 35 OR max(lat_idx) <> 4 OR max(lon_idx) <> 6 THEN 'shape_mismatch' ELSE 'ok' END AS status FROM sc GROUP BY 1)"""


def _scenes(spark, sf):
    obs = G.obs(spark, sf)
    return obs.select(
        F.col("slot").alias("scene"),
        "slot",
        "pixel_id",
        F.substring_index("pixel_id", "_", 1).cast("int").alias("lat_idx"),
        F.substring_index("pixel_id", "_", -1).cast("int").alias("lon_idx"),
        F.when(F.col("slot") % 10 != 3, F.col("v")).alias("tbb_13"),
        (F.col("slot") % 17 == 5).alias("unreadable"),
    )


@query("a07_scene_quality", ctes(G.sql, _SCENES, _QUALITY, final="SELECT status, count(*) AS n_scenes FROM qu GROUP BY 1"))
def quality(spark, sf):
    q = catalog.scene_quality(_scenes(spark, sf), "tbb_13", 5, 7)
    return q.groupBy("status").agg(F.count(F.lit(1)).alias("n_scenes"))


@query("a07_channel_grid", ctes(G.sql, _SCENES, _QUALITY, final=f"SELECT pixel_id, slot, CASE WHEN status = 'ok' AND tbb_13 <> 25 THEN {R('tbb_13')} END AS v FROM sc JOIN qu ON sc.scene = qu.scene"))
def channel(spark, sf):
    scenes = _scenes(spark, sf)
    return catalog.channel_grid(scenes, "tbb_13", catalog.scene_quality(scenes, "tbb_13", 5, 7), fill_value=25.0)


@query(
    "a08_stored_grid",
    ctes(E.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT pixel_id, count(*) AS n, count(v) AS n_valid, {R('avg(CAST(CAST(v AS FLOAT) AS DOUBLE))', 4)} AS mean FROM grid GROUP BY 1"),
    digits=4,
)
def stored_grid(spark, sf):
    obs = E.obs(spark, sf)
    path = scratch_path(spark, "grid")
    tables.write_grid(grid.dense_grid(obs, obs.select("pixel_id").distinct()), E.axis, path, files_per_date=1)
    return tables.read_grid(spark, path).groupBy("pixel_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.avg("v").alias("mean")
    )


@query(
    "a09_stored_grid_range",
    ctes(E.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT pixel_id, slot, {T_(E.time_sql('slot'))} AS ts, {R('CAST(CAST(v AS FLOAT) AS DOUBLE)', 3)} AS v FROM grid WHERE {E.time_sql('slot')} BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-19 17:00:00'"),
    digits=3,
)
def stored_range(spark, sf):
    obs = E.obs(spark, sf)
    path = scratch_path(spark, "grid")
    tables.write_grid(grid.dense_grid(obs, obs.select("pixel_id").distinct()), E.axis, path, files_per_date=1)
    part = tables.read_range(tables.read_grid(spark, path), "2024-01-05 06:00:00", "2024-01-19 17:00:00")
    return part.select("pixel_id", "slot", "ts", "v")


@query(
    "a11_delimited_round_trip",
    ctes(*detail_sql(M, 2, 3, ("persistence",)), final=f"SELECT model, pixel_id, step, {T_(M.time_sql('slot + step'))} AS target_time, {R('y_true', 5)} AS y_true, {R('y_pred', 5)} AS y_pred FROM detail"),
    digits=5,
)
def delimited(spark, sf):
    path = scratch_path(spark, "detail")
    tables.write_csv(detail(M.obs(spark, sf), ("persistence",), 2, 3, axis=M.axis).drop("slot"), path)
    back = tables.read_csv(spark, path, tables.DETAIL_SCHEMA)
    return back.select("model", "pixel_id", "step", "target_time", "y_true", "y_pred")


@query(
    "a12_split_metadata",
    ctes(
        G.sql,
        BOUNDS_SQL,
        "cut AS (SELECT lo, hi, lo + CAST(floor((hi - lo + 1) * 0.7) AS BIGINT) AS a FROM b)",
        final="""SELECT 'chronological' AS method, CAST(10080 AS BIGINT) AS frequency_minutes, min(slot) FILTER (WHERE slot <= a) AS train_start, max(slot) FILTER (WHERE slot <= a) AS train_end,
        count(DISTINCT slot) FILTER (WHERE slot <= a) AS n_train_timesteps, count(DISTINCT pixel_id) FILTER (WHERE slot <= a) AS n_train_pixels,
        min(slot) FILTER (WHERE slot > a) AS test_start, max(slot) FILTER (WHERE slot > a) AS test_end, count(DISTINCT slot) FILTER (WHERE slot > a) AS n_test_timesteps,
        count(DISTINCT pixel_id) FILTER (WHERE slot > a) AS n_test_pixels FROM obs CROSS JOIN cut""",
    ),
)
def split_metadata(spark, sf):
    obs = G.obs(spark, sf)
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    a = lo + int((hi - lo + 1) * 0.7)
    train, test = split.chronological_split(obs, a, a + 1, hi)
    meta = split.split_metadata(train, test, G.axis.step_seconds)
    path = scratch_path(spark, "meta")
    tables.write_document(meta, path)
    doc = spark.read.schema("value string").text(path)
    return doc.select(F.from_json("value", meta.schema).alias("m")).select("m.*")


_FOLDER = """concat(CASE o_orderkey % 3 WHEN 0 THEN 'gbt' WHEN 1 THEN 'linear' ELSE 'bad-name' END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('_w', CAST(o_orderkey % 24 + 1 AS VARCHAR)) END,
  '_t0', strftime(o_orderdate, '%Y%m%d_%H%M'), '_run', strftime(o_orderdate + to_minutes(CAST(o_orderkey % 600 AS BIGINT)), '%Y%m%d_%H%M'))"""


@query(
    "a16_run_catalog",
    f"""WITH f AS (SELECT {_FOLDER} AS folder FROM orders), p AS (SELECT folder, regexp_extract(folder, '^([A-Za-z0-9]+)_w(\\d+)_t0(\\d{{8}}_\\d{{4}})_run(\\d{{8}}_\\d{{4}})$', ['m', 'w', 't', 'r']) AS g FROM f)
    SELECT folder, g.m AS model_name, CAST(g.w AS BIGINT) AS "window", g.t AS t0_str, g.r AS run_str, {T_("strptime(g.t, '%Y%m%d_%H%M')")} AS t0_ts, {T_("strptime(g.r, '%Y%m%d_%H%M')")} AS run_ts FROM p WHERE g.m <> ''""",
)
def run_catalog(spark, sf):
    k = F.col("o_orderkey")
    folder = F.concat(
        F.when(k % 3 == 0, "gbt").when(k % 3 == 1, "linear").otherwise("bad-name"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_w"), k % 24 + 1)),
        F.lit("_t0"),
        F.date_format("o_orderdate", "yyyyMMdd_HHmm"),
        F.lit("_run"),
        F.date_format(F.timestamp_add("MINUTE", k % 600, F.col("o_orderdate")), "yyyyMMdd_HHmm"),
    )
    return catalog.run_catalog(table(spark, sf, "orders").select(folder.alias("folder")))



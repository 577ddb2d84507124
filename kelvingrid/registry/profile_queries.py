"""Profiles, validation, run comparison, bias by hour."""

from pyspark.sql import functions as F

from kelvingrid.operators import grid, profile
from kelvingrid.registry.base import BOUNDS_SQL, DIM_SQL, GRID_SQL, R, ctes, dim_of, ev5, g35, query, table
from kelvingrid.registry.evaluation_queries import MODELS, detail, detail_sql

G = g35()
E = ev5()


@query(
    "c06_grid_validation",
    ctes(
        G.sql,
        BOUNDS_SQL,
        DIM_SQL,
        GRID_SQL,
        "ps AS (SELECT slot, count(*) AS n, count(DISTINCT pixel_id) AS p FROM grid GROUP BY 1)",
        "st AS (SELECT count(*) AS n_slots, sum(n) AS n_rows, sum(n - p) AS n_dups, min(p) AS lo, max(p) AS hi, max(slot) - min(slot) + 1 AS span, (SELECT count(*) FROM dim) AS np FROM ps)",
        final="""SELECT 'not_empty' AS name, n_slots > 0 AND np > 0 AS ok, CAST(n_rows AS BIGINT) AS detail FROM st
        UNION ALL SELECT 'one_row_per_cell', n_dups = 0, CAST(n_dups AS BIGINT) FROM st
        UNION ALL SELECT 'all_pixels_each_time', lo = np AND hi = np, lo FROM st
        UNION ALL SELECT 'on_axis', TRUE, 0 FROM st
        UNION ALL SELECT 'constant_step', span = n_slots, span FROM st
        UNION ALL SELECT 'unique_pixels', TRUE, np FROM st""",
    ),
)
def validation(spark, sf):
    obs = G.obs(spark, sf)
    dim = dim_of(obs)
    g = grid.dense_grid(obs, dim).withColumn("ts", G.axis.time(F.col("slot")))
    return profile.validate_grid(g, dim, G.axis)


@query(
    "c07_null_profile",
    ctes(E.sql, BOUNDS_SQL, GRID_SQL, final=f"SELECT count(*) AS n_cells, count(*) - count(v) AS n_missing, count(v) AS n_valid, {R('(count(*) - count(v)) * 100.0 / count(*)')} AS pct_missing FROM grid"),
)
def null_profile(spark, sf):
    obs = E.obs(spark, sf)
    return profile.null_profile(grid.dense_grid(obs, obs.select("pixel_id").distinct()))


@query("c08_timeline_profile", ctes(E.sql, final="SELECT min(slot) AS first_slot, max(slot) AS last_slot, count(DISTINCT slot) AS n_slots FROM obs"))
def timeline_profile(spark, sf):
    return profile.timeline_profile(E.obs(spark, sf))


@query(
    "c09_column_listing",
    """SELECT CAST(pos AS BIGINT) AS pos, "column", type, n AS n_rows, n * width AS n_bytes FROM (VALUES
    (0, 'l_orderkey', 'bigint', 8), (1, 'l_partkey', 'bigint', 8), (2, 'l_suppkey', 'bigint', 8), (3, 'l_linenumber', 'int', 4),
    (4, 'l_quantity', 'double', 8), (5, 'l_extendedprice', 'double', 8), (6, 'l_discount', 'double', 8), (7, 'l_tax', 'double', 8),
    (8, 'l_returnflag', 'string', NULL), (9, 'l_linestatus', 'string', NULL), (10, 'l_shipdate', 'timestamp_ntz', 8)) t(pos, "column", type, width)
    CROSS JOIN (SELECT count(*) AS n FROM lineitem)""",
)
def column_listing(spark, sf):
    return profile.column_listing(table(spark, sf, "lineitem"))


_PIX = ["0_0", "1_3", "4_6"]
_WIDE = "SELECT slot, " + ", ".join(f"{R(f'''max(v) FILTER (WHERE pixel_id = '{p}')''')} AS \"p_{p}\"" for p in _PIX)


@query(
    "c10_wide_preview",
    ctes(G.sql, final=_WIDE + " FROM obs WHERE pixel_id IN ('0_0', '1_3', '4_6') AND slot IN (SELECT DISTINCT slot FROM obs ORDER BY slot LIMIT 10) GROUP BY 1"),
)
def preview(spark, sf):
    return profile.preview(G.obs(spark, sf), _PIX, 10)


@query("a17_wide_table", ctes(G.sql, final=_WIDE + " FROM obs WHERE pixel_id IN ('0_0', '1_3', '4_6') GROUP BY 1"))
def wide(spark, sf):
    return profile.wide_table(G.obs(spark, sf), _PIX)


_STATS = f"""count(x) AS "count", count(*) - count(x) AS missing, {R('avg(x)')} AS mean, {R('quantile_cont(x, 0.5)')} AS median, {R('stddev_samp(x)')} AS std,
  {R('min(x)')} AS min, {R('quantile_cont(x, 0.25)')} AS q25, {R('quantile_cont(x, 0.75)')} AS q75, {R('max(x)')} AS max"""


def _melt(src: str, cols: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols)


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("f22_column_profile", ctes(f"m AS ({_melt('lineitem', _LI)})", final=f'SELECT "column", {_STATS} FROM m GROUP BY 1'))
def column_profile(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem").select(*_LI))


@query(
    "f23_table_profile",
    """WITH g AS (SELECT l_suppkey, l_quantity, nullif(l_tax, 0) AS tax, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL)
    SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(4 AS BIGINT) AS columns, CAST(sum(CASE WHEN tax IS NULL THEN c ELSE 0 END) AS BIGINT) AS missing_values_total,
    CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def table_profile(spark, sf):
    li = table(spark, sf, "lineitem")
    return profile.table_profile(
        li.select("l_suppkey", "l_quantity", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"), "l_returnflag")
    )


_NUM = ["step", "y_true", "y_pred", "abs_error"]
_GROUPED = f"""{R('avg(x)')} AS mean, {R('quantile_cont(x, 0.5)')} AS median, {R('stddev_samp(x)')} AS std"""


@query(
    "f24_grouped_profile",
    ctes(
        *detail_sql(G, 3, 4),
        "dd AS (SELECT *, CASE WHEN step > 1 THEN concat('h', CAST(step AS VARCHAR)) END AS horizon FROM detail)",
        f"m AS ({_melt('dd', _NUM, 'model, horizon, ')})",
        final=f"""SELECT 'model' AS group_column, model AS group_value, "column", {_GROUPED} FROM m GROUP BY 1, 2, 3
        UNION ALL SELECT 'horizon', horizon, "column", {_GROUPED} FROM m GROUP BY 1, 2, 3""",
    ),
)
def grouped_profile(spark, sf):
    d = detail(G.obs(spark, sf), MODELS, 3, 4).select("model", "pixel_id", *_NUM)
    d = d.withColumn("horizon", F.when(F.col("step") > 1, F.concat(F.lit("h"), "step")))
    return profile.grouped_profile(d, ["model", "horizon"])


def _runs_sql() -> list[str]:
    a = detail_sql(E, 4, 6, ("persistence", "window_mean"))
    b = detail_sql(E, 4, 6, ("persistence", "window_mean"), rate=0.05)[-1].replace("detail AS", "damped AS", 1)
    return [*a, b]


def _runs(spark, sf):
    obs = E.obs(spark, sf)
    models = ("persistence", "window_mean")
    return detail(obs, models, 4, 6, axis=E.axis), detail(obs, models, 4, 6, rate=0.05, axis=E.axis)


_CMP = [
    *_runs_sql(),
    f"m AS ({_melt('detail', _NUM[1:], '0 AS run, ')} UNION ALL {_melt('damped', _NUM[1:], '1 AS run, ')})",
    """pr AS (SELECT run, "column", avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, count(*) - count(x) AS missing FROM m GROUP BY 1, 2)""",
    """cm AS (SELECT a."column", a.mean AS a_mean, b.mean AS b_mean, b.mean - a.mean AS mean_difference, a.median AS a_median, b.median AS b_median, b.median - a.median AS median_difference,
      a.std AS a_std, b.std AS b_std, b.std - a.std AS std_difference, a.missing AS a_missing, b.missing AS b_missing, CASE WHEN a.mean <> 0 THEN (b.mean - a.mean) / abs(a.mean) * 100 END AS mean_pct_change
      FROM pr a JOIN pr b ON a."column" = b."column" AND a.run = 0 AND b.run = 1)""",
]
_CMP_COLS = "a_mean b_mean mean_difference a_median b_median median_difference a_std b_std std_difference mean_pct_change".split()


@query("f25_run_comparison", ctes(*_CMP, final='SELECT "column", a_missing, b_missing, ' + ", ".join(f"{R(c)} AS {c}" for c in _CMP_COLS) + " FROM cm"))
def run_comparison(spark, sf):
    a, b = _runs(spark, sf)
    return profile.compare_runs(a.select(*_NUM[1:]), b.select(*_NUM[1:]))


@query(
    "f26_largest_changes",
    ctes(
        *_CMP,
        final=f"""SELECT 'largest_mean_difference' AS kind, * FROM (SELECT "column", {R('mean_difference')} AS mean_difference, {R('mean_pct_change')} AS mean_pct_change FROM cm ORDER BY abs(cm.mean_difference) DESC LIMIT 20)
        UNION ALL SELECT 'largest_percentage_change', * FROM (SELECT "column", {R('mean_difference')}, {R('mean_pct_change')} FROM cm ORDER BY abs(cm.mean_pct_change) DESC LIMIT 20)""",
    ),
)
def largest_changes(spark, sf):
    a, b = _runs(spark, sf)
    return profile.largest_changes(profile.compare_runs(a.select(*_NUM[1:]), b.select(*_NUM[1:])))


@query(
    "f27_column_sets",
    """SELECT 'k' AS "column", 'common' AS side, (SELECT count(o_orderkey) FROM orders) AS n_left, (SELECT count(l_orderkey) FROM lineitem) AS n_right
    UNION ALL SELECT 'o_totalprice', 'only_left', (SELECT count(o_totalprice) FROM orders), NULL
    UNION ALL SELECT 'l_quantity', 'only_right', NULL, (SELECT count(l_quantity) FROM lineitem)""",
)
def column_sets(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    return profile.compare_columns(a, b)


@query(
    "i02_name_sets",
    """SELECT 'both' AS side, pixel_id FROM (SELECT DISTINCT event_type AS pixel_id FROM events WHERE value > 150 INTERSECT SELECT event_type FROM events WHERE value < 1)
    UNION ALL SELECT 'large_only', uid FROM (SELECT CAST(user_id AS VARCHAR) AS uid FROM events WHERE value > 60 EXCEPT SELECT CAST(user_id AS VARCHAR) FROM events WHERE value < 3)""",
)
def name_sets(spark, sf):
    ev = table(spark, sf, "events")
    types = lambda c: ev.filter(c).select(F.col("event_type").alias("pixel_id"))
    users = lambda c: ev.filter(c).select(F.col("user_id").cast("string").alias("pixel_id"))
    both = types("value > 150").intersect(types("value < 1")).withColumn("side", F.lit("both"))
    only = users("value > 60").subtract(users("value < 3")).withColumn("side", F.lit("large_only"))
    return both.unionByName(only)


_BIAS = [
    *_runs_sql(),
    "al AS (SELECT 'damping=0.0' AS label, * FROM detail UNION ALL SELECT 'damping=0.05' AS label, * FROM damped)",
    f"""bi AS (SELECT label, model, CAST(hour({E.time_sql('slot + step')} + INTERVAL 7 HOUR) AS BIGINT) AS hour_wib, avg(y_pred - y_true) AS bias, avg(abs_error) AS mae, count(*) AS n
      FROM al WHERE step BETWEEN 3 AND 6 GROUP BY 1, 2, 3)""",
]


def _bias(spark, sf):
    a, b = _runs(spark, sf)
    both = a.withColumn("label", F.lit("damping=0.0")).unionByName(b.withColumn("label", F.lit("damping=0.05")))
    return profile.bias_by_hour(both, first=3, last=6)


@query("f28_bias_by_hour", ctes(*_BIAS, final=f"SELECT label, model, hour_wib, {R('bias')} AS bias, {R('mae')} AS mae, n FROM bi"))
def bias_by_hour(spark, sf):
    return _bias(spark, sf)


@query(
    "f29_worst_hours",
    ctes(*_BIAS, final=f"SELECT label, model, hour_wib, {R('bias')} AS bias, {R('mae')} AS mae, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, model ORDER BY abs(bias) DESC, hour_wib) AS rank FROM bi) WHERE rank <= 3"),
)
def worst_hours(spark, sf):
    return profile.worst_hours(_bias(spark, sf))


@query(
    "f30_bias_pivot",
    ctes(*_BIAS, final=f"""SELECT model, hour_wib, {R("avg(bias) FILTER (WHERE label = 'damping=0.0')")} AS bias_damping_0_0, {R("avg(bias) FILTER (WHERE label = 'damping=0.05')")} AS bias_damping_0_05 FROM bi GROUP BY 1, 2"""),
)
def bias_pivot(spark, sf):
    return profile.bias_pivot(_bias(spark, sf), ["damping=0.0", "damping=0.05"])


@query(
    "j18_run_comparison_by_model",
    ctes(
        *_runs_sql(),
        "al AS (SELECT 'damping=0.0' AS label, * FROM detail UNION ALL SELECT 'damping=0.05' AS label, * FROM damped)",
        f"m AS ({_melt('al', _NUM[1:], 'label, model, ')})",
        final=f'SELECT label, model, "column", {_STATS} FROM m GROUP BY 1, 2, 3',
    ),
)
def run_comparison_by_model(spark, sf):
    a, b = _runs(spark, sf)
    both = a.withColumn("label", F.lit("damping=0.0")).unionByName(b.withColumn("label", F.lit("damping=0.05")))
    return profile.column_profile(both.select("label", "model", *_NUM[1:]), ["label", "model"])


@query(
    "f34_duplicate_keys",
    "SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    from kelvingrid.operators.forecast import duplicate_keys as dup

    return dup(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "b05_model_filter",
    ctes(*detail_sql(G, 3, 3), final=f"SELECT model, step, count(*) AS n FROM detail WHERE model IN ('ar1', 'persistence') GROUP BY 1, 2"),
)
def model_filter(spark, sf):
    from kelvingrid.operators.forecast import pick_models

    return pick_models(detail(G.obs(spark, sf), MODELS, 3, 3), ["ar1", "persistence"]).groupBy("model", "step").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "h01_ordered_summary",
    ctes(*detail_sql(G, 3, 3), final=f"SELECT row_number() OVER (ORDER BY model, step) AS pos, model, step, {R('avg(abs_error)')} AS mae FROM detail GROUP BY model, step"),
)
def ordered_summary(spark, sf):
    from pyspark.sql import Window

    from kelvingrid.operators import evaluate

    s = evaluate.step_errors(detail(G.obs(spark, sf), MODELS, 3, 3)).select("model", "step", "mae")
    # models x horizon rows
    return s.withColumn("pos", F.row_number().over(Window.orderBy("model", "step")))


@query(
    "h02_largest_errors",
    ctes(
        *detail_sql(G, 3, 3, ("persistence",)),
        final=f"SELECT pixel_id, slot, step, {R('abs_error')} AS abs_error FROM detail ORDER BY detail.abs_error DESC, pixel_id, slot, step LIMIT 20",
    ),
)
def largest_errors(spark, sf):
    d = detail(G.obs(spark, sf), ("persistence",), 3, 3)
    return d.orderBy(F.desc("abs_error"), "pixel_id", "slot", "step").limit(20).select(
        "pixel_id", "slot", "step", "abs_error"
    )


@query(
    "i01_union_of_models",
    ctes(*detail_sql(G, 3, 3), final="SELECT model, pixel_id, count(*) AS n FROM detail GROUP BY 1, 2"),
)
def union_of_models(spark, sf):
    obs = G.obs(spark, sf)
    parts = [detail(obs, (m,), 3, 3) for m in MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("model", "pixel_id").agg(
        F.count(F.lit(1)).alias("n")
    )

"""Rollouts of the closed-form models, metrics, k-fold, significance."""

from pyspark.sql import functions as F

from kelvingrid.operators import evaluate, forecast as fc, rollout, samples, significance
from kelvingrid.plans import stages
from kelvingrid.registry.base import BOUNDS_SQL, GRID_SQL, R, T_, ctes, ev5, g35, query, suppliers
from kelvingrid.registry.window_queries import frames_sql, lags_sql, leads_sql, span_sql

G = g35()
E = ev5()
S = suppliers()
W, H = 6, 6
MODELS = ("persistence", "window_mean", "ar1")
# AR(1) forecasts turn flat within a few steps; a correlation with a flat field is
# rounding noise, so spatial metrics are compared on the other two.
SPATIAL = ("persistence", "window_mean")


def rolled_sql(model: str, window: int, horizon: int, rate: float = 0.0, cap: float = 0.6, src: str = "fr") -> str:
    """SELECT over ``src`` with p_1..p_h; AR(1) reads columns ar1_a and ar1_b."""
    state = [f"lag_{k}" for k in range(1, window + 1)]
    reference = "((" + " + ".join(state) + f") / {window})"
    sql = f"SELECT * FROM {src}"
    for k in range(1, horizon + 1):
        if model == "persistence":
            raw = state[0]
        elif model == "ar1":
            raw = f"ar1_a + ar1_b * {state[0]}"
        else:
            raw = "(" + " + ".join(state) + f") / {window}"
        alpha = min(rate * (k - 1), cap)
        pred = f"{1 - alpha!r}::DOUBLE * ({raw}) + {alpha!r}::DOUBLE * {reference}" if alpha > 0 else raw
        sql = f"SELECT *, {pred} AS p_{k} FROM ({sql})"
        state = [f"p_{k}"] + state[:-1]
    return sql


def ar1_sql(window: int, keys: str = "", src: str = "grid", name: str = "ab") -> list[str]:
    """CTE with the AR(1) fit on complete windows + target."""
    by = ("pixel_id, " + keys) if keys else "pixel_id"
    return [
        span_sql(window - 1, 1, lags_sql(1, by) + leads_sql(1, by), keys=by, src=src, name=f"s_{name}"),
        f"""{name} AS (SELECT {keys + ', ' if keys else ''}regr_intercept(f_1, lag_1) AS ar1_a, regr_slope(f_1, lag_1) AS ar1_b, count(*) AS n_train
            FROM s_{name} WHERE filled = {window + 1} {'GROUP BY ' + keys if keys else ''})""",
    ]


def detail_sql(fx, window: int, horizon: int, models=MODELS, rate: float = 0.0, stride: int = 1, label: str = "") -> list[str]:
    """CTEs up to ``detail`` (model, pixel_id, slot, step, y_true, y_pred, abs_error)."""
    parts = [
        *frames_sql(fx, window, horizon),
        *ar1_sql(window),
        f"fs AS (SELECT * FROM (SELECT fr.*, row_number() OVER (PARTITION BY pixel_id ORDER BY slot) - 1 AS rn FROM fr) WHERE rn % {stride} = 0)",
        "fa AS (SELECT * FROM fs CROSS JOIN ab)",
    ]
    return parts + [detail_cte(models, window, horizon, rate)]


def detail_cte(models, window, horizon, rate=0.0, src="fa", extra="", name="detail", cap=0.6) -> str:
    step = lambda p: "CASE step " + " ".join(f"WHEN {k} THEN {p}_{k}" for k in range(1, horizon + 1)) + " END"
    one = [
        f"SELECT {extra}'{m}' AS model, pixel_id, slot, step, {step('f')} AS y_true, {step('p')} AS y_pred, abs({step('p')} - {step('f')}) AS abs_error "
        f"FROM ({rolled_sql(m, window, horizon, rate, cap, src)}) CROSS JOIN (SELECT unnest(generate_series(1, {horizon})) AS step)"
        for m in models
    ]
    return f"{name} AS ({' UNION ALL '.join(one)})"


def spatial_sql(keys: str) -> str:
    """Per (keys, anchor) spatial metrics with at least two pixels."""
    return f"""sp AS (SELECT {keys}, slot, count(*) AS n, stddev_pop(y_pred) / (stddev_pop(y_true) + 1e-6) AS cr,
      CASE WHEN stddev_pop(y_pred) < 1e-9 OR stddev_pop(y_true) < 1e-9 THEN 0 ELSE corr(y_pred, y_true) END AS co
      FROM detail GROUP BY {keys}, slot HAVING count(*) >= 2)"""


def summary_sql(keys: str) -> list[str]:
    on = " AND ".join(f"a.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return [
        spatial_sql(keys),
        f"sq AS (SELECT {keys}, avg(cr) AS cr, avg(co) AS co, count(*) AS ng FROM sp GROUP BY {keys})",
        f"""ba AS (SELECT {keys}, avg(abs_error) AS mae, sqrt(avg(abs_error * abs_error)) AS rmse, count(*) AS n_samples,
          stddev_samp(y_pred) AS pred_std, stddev_samp(y_true) AS true_std,
          1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*) + 1e-12) AS r2 FROM detail GROUP BY {keys})""",
        f"summary AS (SELECT a.*, s.cr, s.co, s.ng FROM ba a LEFT JOIN sq s ON {on})",
    ]


BASIC_OUT = f"{R('mae')} AS mae, {R('rmse')} AS rmse, n_samples, {R('pred_std')} AS pred_std, {R('true_std')} AS true_std, {R('r2')} AS r2"
SUMMARY_OUT = f"""{R('mae')} AS mae, {R('rmse')} AS rmse, n_samples, {R('pred_std')} AS pred_std, {R('true_std')} AS true_std, {R('r2')} AS r2,
  {R('cr')} AS spatial_collapse_ratio, {R('co')} AS spatial_correlation, ng AS n_t0_groups"""


def detail(obs, models=MODELS, window=W, horizon=H, rate=0.0, stride=1, axis=G.axis, cap=0.6):
    """Detail rows of several baselines from one read of the frames."""
    frames = samples.rollout_frames(obs, window, horizon, stride)
    steps = {"persistence": rollout.persistence(), "window_mean": rollout.window_mean()}
    if "ar1" in models:
        frames, steps["ar1"] = rollout.with_ar1(frames, rollout.fit_ar1(samples.window_samples(obs, window)))
    rolled = rollout.rollout_many(frames, {m: steps[m] for m in models}, horizon, axis, rate, cap)
    return rollout.detail_rows(rolled, F.col("model"), axis)


_DETAIL_OUT = f"model, pixel_id, slot, step, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred, {R('abs_error')} AS abs_error"


@query("j03_closed_form_models", ctes(*detail_sql(G, W, 3), final=f"SELECT {_DETAIL_OUT} FROM detail WHERE step = 1"))
def closed_form(spark, sf):
    """One-step predictions of the three baselines."""
    return detail(G.obs(spark, sf), horizon=3).filter("step = 1").drop("anchor_t0", "target_time")


@query("j04_recursive_rollout", ctes(*detail_sql(G, W, H, ("ar1", "window_mean")), final=f"SELECT model, pixel_id, slot, step, {R('y_pred')} AS y_pred FROM detail"))
def recursive(spark, sf):
    return detail(G.obs(spark, sf), ("ar1", "window_mean")).select("model", "pixel_id", "slot", "step", "y_pred")


@query("j05_damped_rollout", ctes(*detail_sql(G, W, H, rate=0.15), final=f"SELECT model, pixel_id, slot, step, {R('y_pred')} AS y_pred FROM detail"))
def damped(spark, sf):
    return detail(G.obs(spark, sf), rate=0.15).select("model", "pixel_id", "slot", "step", "y_pred")


@query(
    "j06_rollout_metrics",
    ctes(*detail_sql(S, 3, 3), *summary_sql("model, step"), final=f"SELECT model, step, {R('mae')} AS mae, {R('r2')} AS r2 FROM summary"),
)
def rollout_metrics(spark, sf):
    d = detail(S.obs(spark, sf), window=3, horizon=3, axis=S.axis)
    return evaluate.summarize_by_step(d).select("model", "step", "mae", "r2")


@query(
    "j07_detail_rows",
    ctes(
        *detail_sql(E, 4, 4, ("persistence",)),
        final=f"SELECT {_DETAIL_OUT}, {T_(E.time_sql('slot'))} AS anchor_t0, {T_(E.time_sql('slot + step'))} AS target_time FROM detail",
    ),
)
def detail_rows(spark, sf):
    return detail(E.obs(spark, sf), ("persistence",), 4, 4, axis=E.axis)


@query("f01_step_errors", ctes(*detail_sql(G, W, H), *summary_sql("model, step"), final=f"SELECT model, step, {R('mae')} AS mae, {R('rmse')} AS rmse, n_samples, {R('pred_std')} AS pred_std, {R('true_std')} AS true_std FROM summary"))
def step_errors(spark, sf):
    return evaluate.step_errors(detail(G.obs(spark, sf)))


@query("f02_r2_by_group", ctes(*detail_sql(G, W, H), *summary_sql("model, step"), final=f"SELECT model, step, {R('r2')} AS r2 FROM summary"))
def r2(spark, sf):
    return evaluate.r2_by_group(detail(G.obs(spark, sf)))


@query("f03_r2_per_step", ctes(*detail_sql(E, 4, 12, ("ar1",)), *summary_sql("step"), final=f"SELECT step, {R('r2')} AS r2 FROM summary"))
def r2_step(spark, sf):
    return evaluate.r2_by_group(detail(E.obs(spark, sf), ("ar1",), 4, 12, axis=E.axis), ("step",))


_SPATIAL = ctes(*detail_sql(G, W, H, SPATIAL), spatial_sql("model, step"), final=f"SELECT model, step, slot, n, {R('cr')} AS collapse_ratio, {R('co')} AS correlation FROM sp")


@query("f04_spatial_collapse", _SPATIAL.replace(f", {R('co')} AS correlation", ""))
def collapse(spark, sf):
    return evaluate.spatial_by_anchor(detail(G.obs(spark, sf), SPATIAL)).drop("correlation")


@query("f05_spatial_correlation", _SPATIAL.replace(f"{R('cr')} AS collapse_ratio, ", ""))
def correlation(spark, sf):
    return evaluate.spatial_by_anchor(detail(G.obs(spark, sf), SPATIAL)).drop("collapse_ratio")


@query(
    "f06_spatial_summary",
    ctes(*detail_sql(G, W, H, SPATIAL), *summary_sql("model, step"), final=f"SELECT model, step, {R('cr')} AS spatial_collapse_ratio, {R('co')} AS spatial_correlation, ng AS n_t0_groups FROM summary"),
)
def spatial_summary(spark, sf):
    s = evaluate.summarize_by_step(detail(G.obs(spark, sf), SPATIAL))
    return s.select("model", "step", "spatial_collapse_ratio", "spatial_correlation", "n_t0_groups")


@query("f07_step_summary", ctes(*detail_sql(G, W, H, SPATIAL), *summary_sql("model, step"), final=f"SELECT model, step, {SUMMARY_OUT} FROM summary"))
def step_summary(spark, sf):
    return evaluate.summarize_by_step(detail(G.obs(spark, sf), SPATIAL))


@query("g01_summary_by_model_step", ctes(*detail_sql(S, 3, 3, SPATIAL), *summary_sql("model, step"), final=f"SELECT model, step, {SUMMARY_OUT} FROM summary"))
def step_summary_suppliers(spark, sf):
    return evaluate.summarize_by_step(detail(S.obs(spark, sf), SPATIAL, window=3, horizon=3, axis=S.axis))


@query(
    "f08_step_average",
    ctes(*detail_sql(G, W, H), *summary_sql("model, step"), final=f"SELECT model, {R('avg(mae)')} AS mae_avg_all_steps, {R('avg(rmse)')} AS rmse_avg_all_steps, {R('avg(r2)')} AS r2_avg_all_steps FROM summary GROUP BY 1"),
)
def step_average(spark, sf):
    return evaluate.step_average(evaluate.summarize_by_step(detail(G.obs(spark, sf))))


@query(
    "j11_test_evaluation",
    ctes(
        G.sql,
        BOUNDS_SQL,
        GRID_SQL,
        "cutoff AS (SELECT lo + CAST(floor((hi - lo + 1) * 0.85) AS BIGINT) AS c FROM b)",
        "gtr AS (SELECT * FROM grid WHERE slot < (SELECT c FROM cutoff))",
        "gte AS (SELECT * FROM grid WHERE slot >= (SELECT c FROM cutoff))",
        span_sql(W - 1, H, lags_sql(W) + leads_sql(H), src="gte", name="vt"),
        *ar1_sql(W, src="gtr", name="abt"),
        f"fa AS (SELECT * FROM vt CROSS JOIN abt WHERE filled = {W + H})",
        detail_cte(MODELS, W, H),
        *summary_sql("model, step"),
        final=f"SELECT model, step, {BASIC_OUT} FROM summary",
    ),
)
def test_evaluation(spark, sf):
    """Models fitted on the first 85 % of the axis, scored on the rest."""
    obs = G.obs(spark, sf)
    cut = obs.agg((F.min("slot") + F.floor((F.max("slot") - F.min("slot") + 1) * 0.85)).alias("c")).scalar()
    train, test = obs.filter(F.col("slot") < cut), obs.filter(F.col("slot") >= cut)
    fit = rollout.fit_ar1(samples.window_samples(train, W))
    with_fit, ar1 = rollout.with_ar1(samples.rollout_frames(test, W, H), fit)
    steps = {"persistence": rollout.persistence(), "window_mean": rollout.window_mean(), "ar1": ar1}
    rolled = rollout.rollout_many(with_fit, steps, H, G.axis)
    return evaluate.summarize_by_step(rollout.detail_rows(rolled, F.col("model"), G.axis)).drop(
        "spatial_collapse_ratio", "spatial_correlation", "n_t0_groups"
    )


_SEARCH_W = (1, 2, 3, 6)


def _search_sql() -> list[str]:
    parts = [G.sql, BOUNDS_SQL, GRID_SQL, "cu AS (SELECT lo + CAST(floor((hi - lo + 1) * 0.7) AS BIGINT) AS a FROM b)",
             "gfit AS (SELECT * FROM grid WHERE slot <= (SELECT a FROM cu))", "gval AS (SELECT * FROM grid WHERE slot > (SELECT a FROM cu))"]
    details = []
    for w in _SEARCH_W:
        parts += [
            span_sql(w - 1, H, lags_sql(w) + leads_sql(H), src="gval", name=f"v{w}"),
            *ar1_sql(w, src="gfit", name=f"ab{w}"),
            f"""fa{w} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY slot) - 1 AS rn FROM v{w} WHERE filled = {w + H})
                CROSS JOIN ab{w} WHERE rn % 6 = 0)""",
            detail_cte(MODELS, w, H, src=f"fa{w}", extra=f"{w} AS win, ", name=f"de{w}"),
        ]
        details.append(f"SELECT * FROM de{w}")
    parts.append(f"detail AS ({' UNION ALL '.join(details)})")
    parts.append("""st AS (SELECT model, win, step, count(*) AS n, avg(abs_error) AS mae,
        1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*) + 1e-12) AS r2 FROM detail GROUP BY 1, 2, 3)""")
    parts.append("""sr AS (SELECT model, CAST(win AS BIGINT) AS "window", max(n) AS n_val_anchors, avg(mae) AS mae_avg_all_steps, avg(r2) AS r2_avg_all_steps FROM st GROUP BY 1, 2)""")
    return parts


_SEARCH_OUT = f"""model, "window", n_val_anchors, {R('mae_avg_all_steps')} AS mae_avg_all_steps, {R('r2_avg_all_steps')} AS r2_avg_all_steps"""


def _search(spark, sf):
    obs = G.obs(spark, sf)
    lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
    a = lo + int((hi - lo + 1) * 0.7)
    return stages.search_closed_form(
        obs.filter(F.col("slot") <= a), obs.filter(F.col("slot") > a), G.axis, MODELS, _SEARCH_W, H, 6
    )


@query("j08_window_search_closed_form", ctes(*_search_sql(), final=f"SELECT {_SEARCH_OUT} FROM sr"))
def window_search(spark, sf):
    return _search(spark, sf)


@query(
    "j09_best_window_per_model",
    ctes(*_search_sql(), final=f"""SELECT {_SEARCH_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(mae_avg_all_steps, 9), "window") AS rn FROM sr) WHERE rn = 1"""),
)
def best_window(spark, sf):
    found = _search(spark, sf)
    return fc.best_window_per_model(found.withColumn("mae_avg_all_steps", F.round("mae_avg_all_steps", 9)))


_RANK = ctes(*detail_sql(E, 4, 18, MODELS), *summary_sql("model, step"), final="")


@query("h04_model_ranking", _RANK + f"SELECT model, {R('avg(mae)')} AS avg_mae_priority_range FROM summary WHERE step BETWEEN 12 AND 18 GROUP BY 1")
def ranking(spark, sf):
    s = evaluate.summarize_by_step(detail(E.obs(spark, sf), MODELS, 4, 18, axis=E.axis))
    return evaluate.rank_models(s, 12, 18)


@query("j12_model_choice", _RANK + f"SELECT model, {R('avg(mae)')} AS avg_mae_priority_range FROM summary WHERE step BETWEEN 1 AND 18 GROUP BY 1 ORDER BY avg(mae), model LIMIT 1")
def choice(spark, sf):
    s = evaluate.summarize_by_step(detail(E.obs(spark, sf), MODELS, 4, 18, axis=E.axis))
    return evaluate.rank_models(s, 1, 18).limit(1)


# folds


def _kfold_sql(seam: str) -> list[str]:
    w, h, r = 3, 3, 6
    fold = """fo AS (SELECT k + 1 AS fold, lo + k * ((hi - lo + 1) // 5) AS vs,
      CASE WHEN k = 4 THEN hi + 1 ELSE lo + (k + 1) * ((hi - lo + 1) // 5) END AS ve, lo FROM b CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS k))"""
    train = f"tr AS (SELECT fold, pixel_id, slot, v FROM fo CROSS JOIN grid WHERE slot < vs - {r} OR slot >= ve + {r})"
    if seam == "time":
        # keep the purged stretch as gaps, so that no window crosses it
        train = f"tr AS (SELECT fold, pixel_id, slot, CASE WHEN slot < vs - {r} OR slot >= ve + {r} THEN v END AS v FROM fo CROSS JOIN grid)"
    return [
        G.sql,
        BOUNDS_SQL,
        GRID_SQL,
        fold,
        train,
        "va AS (SELECT fold, pixel_id, slot, v FROM fo CROSS JOIN grid WHERE slot >= vs AND slot < ve)",
        *ar1_sql(w, "fold", src="tr"),
        span_sql(w - 1, h, lags_sql(w, "pixel_id, fold") + leads_sql(h, "pixel_id, fold"), keys="pixel_id, fold", src="va"),
        f"fa AS (SELECT w.*, ab.ar1_a, ab.ar1_b, ab.n_train FROM w JOIN ab ON w.fold = ab.fold WHERE filled = {w + h})",
        detail_cte(MODELS, w, h, extra="fold, n_train, "),
        """st AS (SELECT model, fold, n_train, step, count(*) AS n, avg(abs_error) AS mae, sqrt(avg(abs_error * abs_error)) AS rmse,
          1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*) + 1e-12) AS r2 FROM detail GROUP BY 1, 2, 3, 4)""",
        "kf AS (SELECT model, fold, n_train, max(n) AS n_val, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM st GROUP BY 1, 2, 3)",
    ]


_KF_OUT = f"model, fold, n_train AS n_train_samples, n_val AS n_val_anchors, {R('mae')} AS mae_avg_all_steps, {R('rmse')} AS rmse_avg_all_steps, {R('r2')} AS r2_avg_all_steps"


def _kfold(spark, sf, seam="time"):
    return stages.blocked_kfold_closed_form(G.obs(spark, sf), G.axis, MODELS, 3, 3, 5, seam)


@query("j15_blocked_kfold", ctes(*_kfold_sql("time"), final=f"SELECT {_KF_OUT} FROM kf"))
def kfold(spark, sf):
    return _kfold(spark, sf)


@query("j15_blocked_kfold_row_seam", ctes(*_kfold_sql("row"), final=f"SELECT {_KF_OUT} FROM kf"))
def kfold_row(spark, sf):
    """Training rows joined across the purged stretch."""
    return _kfold(spark, sf, "row")


_T975 = "2.7764451051977987"


@query(
    "f19_fold_summary",
    ctes(
        *_kfold_sql("time"),
        final=f"""SELECT model, count(*) AS n_folds, {R('avg(mae)')} AS mae_mean, {R('stddev_samp(mae)')} AS mae_std, {R('stddev_samp(mae) / avg(mae) * 100')} AS mae_cv_percent,
        {R(f'avg(mae) - {_T975} * stddev_samp(mae) / sqrt(count(*))')} AS mae_ci95_low, {R(f'avg(mae) + {_T975} * stddev_samp(mae) / sqrt(count(*))')} AS mae_ci95_high,
        {R('avg(r2)')} AS r2_mean, {R('stddev_samp(r2)')} AS r2_std FROM kf GROUP BY 1""",
    ),
)
def fold_summary(spark, sf):
    return significance.summarize_folds(_kfold(spark, sf))


_PAIRS = [
    *_kfold_sql("time"),
    "pr AS (SELECT a.model AS model_a, b.model AS model_b, a.fold, a.mae - b.mae AS d FROM kf a JOIN kf b ON a.fold = b.fold AND a.model < b.model)",
]


@query("g10_model_pairs", ctes(*_PAIRS, final=f"SELECT model_a, model_b, fold, {R('d')} AS diff FROM pr"))
def model_pairs(spark, sf):
    return significance.model_pairs(_kfold(spark, sf)).select("model_a", "model_b", "fold", "diff")


@query(
    "f20_pair_statistics",
    ctes(
        *_PAIRS,
        "rk AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) AS r FROM pr)",
        final=f"""SELECT model_a, model_b, count(*) AS n, {R('avg(d)')} AS mean_diff, {R('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t_stat,
        {R('CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE)')} AS wilcoxon_stat, {R('avg(d) / stddev_samp(d)')} AS cohens_d FROM rk GROUP BY 1, 2""",
    ),
)
def pair_statistics(spark, sf):
    s = significance.pair_statistics(significance.model_pairs(_kfold(spark, sf)))
    return s.select("model_a", "model_b", "n", "mean_diff", "t_stat", "wilcoxon_stat", "cohens_d")


@query(
    "f21_pairwise_significance",
    ctes(
        *_PAIRS,
        "rk AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) AS r FROM pr)",
        """sg AS (SELECT model_a, model_b, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, avg(d) / stddev_samp(d) AS g,
          CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w FROM rk GROUP BY 1, 2)""",
        # five folds: the t law with 4 degrees of freedom in closed form, all 32 sign patterns of five ranks
        """sp AS (SELECT (b & 1) + ((b >> 1) & 1) * 2 + ((b >> 2) & 1) * 3 + ((b >> 3) & 1) * 4 + ((b >> 4) & 1) * 5 AS s FROM (SELECT unnest(generate_series(0, 31)) AS b))""",
        """pv AS (SELECT *, 2 * (0.5::DOUBLE - 0.375::DOUBLE * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12)) AS pt,
          least(1.0::DOUBLE, 2 * (SELECT count(*) FROM sp WHERE sp.s <= sg.w) / 32.0::DOUBLE) AS pw FROM sg)""",
        final=f"""SELECT model_a, model_b, {R('m')} AS mean_diff, {R('t')} AS t_stat, {R('pt')} AS p_value_ttest, {R('w')} AS wilcoxon_stat, {R('pw')} AS p_value_wilcoxon,
        {R('g')} AS cohens_d, pt < 0.05 AS significant_5pct FROM pv""",
    ),
)
def pairwise(spark, sf):
    return significance.pairwise_significance(_kfold(spark, sf))


@query(
    "s08_compare_models",
    ctes(*_kfold_sql("time"), final=f"SELECT model, count(*) AS n_folds, {R('avg(mae)')} AS mae_mean, {R('avg(r2)')} AS r2_mean FROM kf GROUP BY 1"),
)
def compare_models(spark, sf):
    """The comparison stage: its fold summary."""
    return stages.compare_models(_kfold(spark, sf))[0].select("model", "n_folds", "mae_mean", "r2_mean")

"""Fold summaries and paired model comparisons on the k-fold table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kelvingrid.functions.pvalues import t_critical, t_two_sided, wilcoxon_two_sided


def summarize_folds(folds: DataFrame) -> DataFrame:
    """Mean, sample std, CV %, 95 % t-interval of the fold MAE, plus R2 and time, best first."""
    n = F.col("n_folds")
    spread = lambda c: F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp(c)), F.lit(0.0))
    timed = "train_seconds" in folds.columns
    g = folds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("mae_avg_all_steps").alias("mae_mean"),
        spread("mae_avg_all_steps").alias("mae_std"),
        F.avg("r2_avg_all_steps").alias("r2_mean"),
        spread("r2_avg_all_steps").alias("r2_std"),
        *(
            [F.avg("train_seconds").alias("train_seconds_mean"), spread("train_seconds").alias("train_seconds_std")]
            if timed
            else []
        ),
    )
    half = t_critical(F.lit(0.975), (n - 1).cast("int")) * F.col("mae_std") / F.sqrt(n)
    out = g.withColumn("_half", half)
    return out.select(
        "model",
        "n_folds",
        "mae_mean",
        "mae_std",
        F.when(F.col("mae_mean") != 0, F.col("mae_std") / F.col("mae_mean") * 100).alias("mae_cv_percent"),
        (F.col("mae_mean") - F.col("_half")).alias("mae_ci95_low"),
        (F.col("mae_mean") + F.col("_half")).alias("mae_ci95_high"),
        "r2_mean",
        "r2_std",
        *(["train_seconds_mean", "train_seconds_std"] if timed else []),
    ).orderBy("mae_mean", "model")


def model_pairs(folds: DataFrame, metric: str = "mae_avg_all_steps") -> DataFrame:
    """(model_a, model_b, fold, diff) on identical folds, model_a < model_b.

    The join is an equi-join on the fold; a fold holds one row per model.
    """
    rows = folds.select("fold", "model", F.col(metric).alias("x")).filter("x is not null")
    a = rows.select("fold", F.col("model").alias("model_a"), F.col("x").alias("xa"))
    b = rows.select("fold", F.col("model").alias("model_b"), F.col("x").alias("xb"))
    return a.join(b, "fold").filter("model_a < model_b").withColumn("diff", F.col("xa") - F.col("xb"))


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Paired t, signed-rank statistic and effect size per model pair (at least two folds)."""
    by = ["model_a", "model_b"]
    size = Window.partitionBy(*by, F.abs("diff"))
    order = Window.partitionBy(*by, F.col("diff") == 0).orderBy(F.abs("diff"))
    tie = F.count(F.lit(1)).over(size)
    ranked = pairs.select(
        *by,
        "diff",
        tie.alias("tie"),
        F.when(F.col("diff") != 0, F.rank().over(order) + (tie - 1) / 2).alias("r"),
    )
    nonzero = F.col("diff") != 0
    g = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("sd"),
        F.count_if(nonzero).alias("n_nonzero"),
        F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.max(F.when(nonzero, F.col("tie")).otherwise(1)).alias("max_tie"),
        F.sum(F.when(nonzero, F.col("tie") * F.col("tie") - 1).otherwise(0)).alias("tie_term"),
    ).filter("n >= 2")
    sd = F.when(F.col("sd") > 0, F.col("sd"))
    return g.select(
        *by,
        "n",
        "mean_diff",
        (F.col("mean_diff") / (sd / F.sqrt("n"))).alias("t_stat"),
        F.when(F.col("n_nonzero") > 0, F.least("w_plus", "w_minus")).alias("wilcoxon_stat"),
        (F.col("mean_diff") / sd).alias("cohens_d"),
        "n_nonzero",
        ((F.col("max_tie") > 1) | (F.col("n_nonzero") < F.col("n"))).alias("ties"),
        "tie_term",
    )


def pairwise_significance(folds: DataFrame, metric: str = "mae_avg_all_steps") -> DataFrame:
    s = pair_statistics(model_pairs(folds, metric))
    known = lambda c: F.when(~F.isnan(c), c)
    p_t = known(t_two_sided("t_stat", (F.col("n") - 1).cast("int")))
    p_w = known(wilcoxon_two_sided("wilcoxon_stat", "n_nonzero", "ties", F.col("tie_term").cast("double")))
    return (
        s.withColumn("p_value_ttest", p_t)
        .withColumn("p_value_wilcoxon", p_w)
        .select(
            "model_a",
            "model_b",
            "mean_diff",
            "t_stat",
            "p_value_ttest",
            "wilcoxon_stat",
            "p_value_wilcoxon",
            "cohens_d",
            F.coalesce(F.col("p_value_ttest") < 0.05, F.lit(False)).alias("significant_5pct"),
        )
    )

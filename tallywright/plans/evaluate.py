"""Orchestration: scorecards, folded evaluation, evidence gates, run manifests."""

from __future__ import annotations

import hashlib
import json
import platform

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators import metrics as M
from tallywright.operators.resample import fold_ci


def scorecard(df: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """(keys, metric, value, status, reason) in long form; one plan for every slice and scorer."""
    r = M.ranking(df, keys).join(M.brier(df, keys), keys).join(M.ece_family(M.equal_width_bins(df, keys, n_bins), keys).select(*keys, "ece", "mce"), keys)
    names = ("pr_auc", "roc_auc", "brier", "ece", "mce")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("x")
    out = r.select(*keys, pairs).select(*keys, "x.metric", "x.value")
    return out.withColumn("status", F.when(F.col("value").isNull(), "skipped").otherwise("ok")).withColumn("reason", F.when(F.col("value").isNull(), "single_class"))


def evaluate_folded(df: DataFrame, keys: list[str], fold: str = "fold") -> DataFrame:
    """(keys, metric, mean, ci_low, ci_high, k): the scorecard of every fold, summarised; all folds in one plan."""
    return fold_ci(scorecard(df, [*keys, fold]), [*keys, "metric"], "value")


def gates(card: DataFrame, keys: list[str], metric: str, least: float) -> DataFrame:
    """(keys, gate, passed, severity, message): a metric threshold as an evidence gate; a missing value fails."""
    c = card.where(F.col("metric") == metric)
    ok = F.coalesce(F.col("value") >= least, F.lit(False))
    return c.select(*keys, F.lit(f"metric_threshold:{metric}").alias("gate"), ok.alias("passed"), F.when(ok, "info").otherwise("error").alias("severity"), F.when(F.col("value").isNull(), "missing").when(~ok, "below").otherwise("ok").alias("message"))


def low_fpr_feasible(df: DataFrame, keys: list[str], max_fpr: float, z: float = M.Z95) -> DataFrame:
    """(keys, n_neg, bound, passed): whether zero false positives would prove the rate (Wilson upper bound of 0 of n)."""
    g = df.groupBy(*keys).agg(F.count_if(F.col("y") == 0).alias("n_neg"))
    bound = z * z / (F.col("n_neg") + z * z)
    return g.select(*keys, "n_neg", bound.alias("bound"), (bound <= max_fpr).alias("passed"))


def minimum_size(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("passed", F.col("n") >= least)


def manifest(config: dict, hashes: DataFrame | None = None) -> dict:
    """Versions, canonical configuration hash and data hashes of a run."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)
    return {
        "schema_version": 3, "config_hash": hashlib.sha256(text.encode()).hexdigest(), "environment": {"python": platform.python_version(), "spark": pyspark.__version__},
        "data_hashes": {r["path"]: r["sha256"] for r in hashes.toLocalIterator()} if hashes is not None else {}, "contamination_flags": [],
    }


def headline(df: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row a key: sizes, areas, operating points of best F1 and of 0.9 and 0.95 recall, both ECEs, precision at priors.

    The parts share the histogram of distinct scores; keys of one class have
    null areas and thresholds.
    """
    from tallywright.operators import select as S

    out = M.ranking(df, keys).join(M.brier(df, keys), keys)
    ece = M.ece_family(M.equal_width_bins(df, keys), keys).select(*keys, "ece")
    best = S.max_f1(df, keys).select(*keys, F.col("t").alias("t_max_f1"), F.col("f1").alias("max_f1"))
    r90, r95 = (S.target_recall(df, keys, r).withColumnRenamed("t", name) for r, name in ((0.9, "t_recall_90"), (0.95, "t_recall_95")))
    for part in (ece, best, r90, r95):
        out = out.join(part, keys, "left")
    return out


def role_conflicts(records: DataFrame, required: list[str]) -> DataFrame:
    """(source, role, problem): repeated (source, role) records, and required roles that no record has."""
    twice = records.groupBy("source", "role").agg(F.count("*").alias("n")).where("n > 1").select("source", "role", F.lit("repeated").alias("problem"))
    want = records.sparkSession.createDataFrame([(r,) for r in required], "role string")
    return twice.unionByName(want.join(records.select("role").distinct(), "role", "left_anti").select(F.lit(None).cast("string").alias("source"), "role", F.lit("missing").alias("problem")))


def slice_heatmap(card: DataFrame, slice_col: str, metric: str, scorers: list[str], scorer: str = "scorer") -> DataFrame:
    """Grid of one metric by slice and scorer: what a heat map shows."""
    return card.where(F.col("metric") == metric).groupBy(slice_col).pivot(scorer, scorers).agg(F.first("value"))

"""Threshold selection over curves of distinct scores, and operating points carried to other slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallywright.operators.metrics import confusion_at, curve, range_offsets, score_range, wilson


def pr_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, precision, recall) at every distinct score of keys that have positives."""
    c = curve(df, keys).where("pos > 0")
    return c.select(*keys, F.col("s").alias("t"), (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))


def roc_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, fpr, tpr) by descending score, collinear points dropped, for keys with both classes."""
    c = curve(df, keys).where("pos > 0 and pos < tot").withColumn("_range", score_range())
    # the next score is in the row's range, or the first one of the next range that has any
    own = F.struct("n", "p")
    first = c.groupBy(*keys, "_range").agg(F.max_by(own, "s").alias("_first"))
    first = first.select(*keys, "_range", F.lead("_first").over(W.partitionBy(*keys).orderBy(F.desc("_range"))).alias("_next"))
    c = c.withColumn("_then", F.lead(own).over(W.partitionBy(*keys, "_range").orderBy(F.desc("s")))).join(first, [*keys, "_range"])
    then = F.coalesce("_then", "_next")
    # a point lies on a line if the next step goes as far in both directions as the last
    return c.where(then.isNull() | (then != own)).select(
        *keys, F.col("s").alias("t"), ((F.col("k") - F.col("tp")) / (F.col("tot") - F.col("pos"))).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr")
    )


def _best(points: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first point of each key by order (columns ascending), by partial aggregation."""
    return points.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in points.columns if c not in keys]), F.struct(*order)).alias("_best")).select(*keys, "_best.*")


def max_f1(df: DataFrame, keys: list[str]) -> DataFrame:
    p = pr_points(df, keys)
    p = p.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))
    return _best(p, keys, -F.round("f1", 12), F.col("t")).select(*keys, "t", "f1")


def target_recall(df: DataFrame, keys: list[str], recall: float) -> DataFrame:
    return pr_points(df, keys).where(F.col("recall") >= recall).groupBy(*keys).agg(F.max("t").alias("t"))


def target_precision(df: DataFrame, keys: list[str], precision: float) -> DataFrame:
    return pr_points(df, keys).where(F.col("precision") >= precision).groupBy(*keys).agg(F.min("t").alias("t"))


def target_fpr(df: DataFrame, keys: list[str], fpr: float) -> DataFrame:
    return roc_points(df, keys).where(F.col("fpr") <= fpr).groupBy(*keys).agg(F.min("t").alias("t"))


def youden_j(df: DataFrame, keys: list[str]) -> DataFrame:
    p = roc_points(df, keys).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return _best(p, keys, -F.col("j"), -F.col("t")).select(*keys, "t", "j")


def recall_at_fpr(df: DataFrame, keys: list[str], fpr: float) -> DataFrame:
    """threshold, recall and actual fpr at the lowest threshold within the target; infeasible keys get zeros and an infinite threshold."""
    c = curve(df, keys).where("pos > 0 and pos < tot").withColumn("neg", F.col("tot") - F.col("pos")).withColumn("fp", F.col("k") - F.col("tp"))
    ok = F.col("fp") / F.col("neg") <= fpr
    g = c.groupBy(*keys).agg(F.max_by(F.struct("s", "tp", "fp"), F.when(ok, F.col("k"))).alias("b"), F.first("pos").alias("pos"), F.first("neg").alias("n_neg"))
    return g.select(
        *keys, F.coalesce("b.s", F.lit(float("inf"))).alias("t"), F.coalesce(F.col("b.tp") / F.col("pos"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("b.fp") / F.col("n_neg"), F.lit(0.0)).alias("actual_fpr"), "n_neg", F.coalesce("b.fp", F.lit(0)).alias("fp"),
        (F.col("n_neg") - F.coalesce("b.fp", F.lit(0))).alias("tn"),
    )


def ci_safe(df: DataFrame, keys: list[str], max_fpr: float, max_fpr_high: float, min_recall: float, min_recall_low: float) -> DataFrame:
    """Best accepted threshold by recall, fpr bound, fpr, threshold, with the number of candidates and of accepted ones."""
    c = curve(df, keys).where("pos > 0 and pos < tot").withColumn("neg", F.col("tot") - F.col("pos")).withColumn("fp", F.col("k") - F.col("tp"))
    c = c.withColumn("recall", F.col("tp") / F.col("pos")).withColumn("fpr", F.col("fp") / F.col("neg"))
    c = c.withColumn("recall_low", wilson(F.col("tp"), F.col("pos"), clip=True)[0]).withColumn("fpr_high", wilson(F.col("fp"), F.col("neg"), clip=True)[1])
    c = c.withColumn("rejections", F.filter(F.array(
        F.when(F.col("fpr") > max_fpr, F.lit("fpr")), F.when(F.col("fpr_high") > max_fpr_high, F.lit("fpr_ci")),
        F.when(F.col("recall") < min_recall, F.lit("recall")), F.when(F.col("recall_low") < min_recall_low, F.lit("recall_ci")),
    ), lambda x: x.isNotNull())).withColumn("ok", F.size("rejections") == 0)
    count = c.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if("ok").alias("accepted"))
    best = _best(c.where("ok"), keys, -F.round("recall", 12), F.round("fpr_high", 12), F.round("fpr", 12), -F.col("s")).select(*keys, F.col("s").alias("t"), "recall", "fpr_high")
    return count.join(best, keys, "left")


def transfer(fitted: DataFrame, df: DataFrame, fit_keys: list[str], keys: list[str]) -> DataFrame:
    """Operating points (fit_keys, t) applied to all keys: an equi-join on the scorer, then counts."""
    return confusion_at(df.join(fitted, fit_keys), keys)


def pareto(df: DataFrame, cost: str, metric: str) -> DataFrame:
    """Rows better in metric than all cheaper ones; ties in cost by the metric. One row a model, so one partition."""
    w = W.orderBy(F.asc(cost), F.desc(metric)).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("best", F.max(metric).over(w)).where(F.col("best").isNull() | (F.col(metric) > F.col("best"))).drop("best")


def adjust_p(df: DataFrame, keys: list[str], p: str = "p", method: str = "bh") -> DataFrame:
    """df with q: Benjamini-Hochberg, Bonferroni or unadjusted p-values within keys; null p stay null."""
    if method == "none":
        return df.withColumn("q", F.col(p))
    if method == "bonferroni":
        return df.join(df.groupBy(*keys).agg(F.count(p).alias("_n")), keys).withColumn("q", F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_n")
    if method != "bh":
        raise ValueError(f"unknown method {method}")
    # ranks and running minima within ranges of p, added to those of the ranges ahead
    known = df.where(F.col(p).isNotNull()).withColumn("_range", score_range(p))
    off = range_offsets(known.withColumn("_one", F.lit(1)), keys, {"_n0": "_one"}, descending=False)
    up = W.partitionBy(*keys, "_range").orderBy(p)
    r = known.withColumn("_r", F.row_number().over(up)).join(off, [*keys, "_range"]).withColumn("_v", F.col(p) * F.col("_n0_all") / (F.col("_r") + F.col("_n0")))
    least = r.groupBy(*keys, "_range").agg(F.min("_v").alias("_m"))
    later = W.partitionBy(*keys).orderBy("_range").rowsBetween(1, W.unboundedFollowing)
    least = least.select(*keys, "_range", F.min("_m").over(later).alias("_m"))
    q = F.least(F.min("_v").over(up.rowsBetween(0, W.unboundedFollowing)), F.col("_m"), F.lit(1.0))
    done = r.join(least, [*keys, "_range"]).withColumn("q", q).select(*df.columns, "q")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))

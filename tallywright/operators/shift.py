"""Domain shift, stacked scores and simple text baselines: fitted linear models over distributed data."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.metrics import hash_unit, histogram, ranking


def proxy_a_distance(df: DataFrame, row_id: str, vector: str, domain: str, folds: int = 5, c: float = 0.1) -> DataFrame:
    """(error, distance): 2 (1 - 2 error) of a linear separator of domains 0 and 1 over hashed folds, clamped to [0, 2]."""
    d = df.where(F.col(vector).isNotNull() & F.col(domain).isin(0, 1)).select(
        F.col(row_id).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(domain).cast("double").alias("label")
    )
    d = d.withColumn("fold", F.floor(hash_unit("pad", F.col("id")) * folds))
    parts = None
    for f in range(folds):
        train = d.where(F.col("fold") != f)
        model = LinearSVC(regParam=1.0 / (c * max(train.count(), 1)), maxIter=50).fit(train)
        p = model.transform(d.where(F.col("fold") == f)).select((F.col("prediction") != F.col("label")).cast("double").alias("wrong"))
        parts = p if parts is None else parts.unionByName(p)
    g = parts.agg(F.avg("wrong").alias("error"))
    return g.select("error", F.least(F.greatest(2 * (1 - 2 * F.col("error")), F.lit(0.0)), F.lit(2.0)).alias("distance"))


def stack(df: DataFrame, key: str, scorer: str, scorers: list[str], folds: int = 2) -> DataFrame:
    """(key, y, s): a balanced logistic stack of several scorers over rows that all of them scored; every row is scored by a model fitted without it (hashed folds). Null scores where a fit lacks a class."""
    wide = df.where(F.col(scorer).isin(scorers)).groupBy(key, "y").pivot(scorer, scorers).agg(F.avg("s")).dropna()
    x = VectorAssembler(inputCols=scorers, outputCol="features").transform(wide).withColumn("label", F.col("y").cast("double"))
    x = x.withColumn("fold", F.floor(hash_unit("stack", F.col(key)) * folds))
    out = None
    for f in range(folds):
        train, held = x.where(F.col("fold") != f), x.where(F.col("fold") == f)
        n = train.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
        if not n["n"] or n["p"] in (0, n["n"]):
            part = held.select(key, "y", F.lit(None).cast("double").alias("s"))
        else:
            w = F.when(F.col("label") == 1, n["n"] / (2 * n["p"])).otherwise(n["n"] / (2 * (n["n"] - n["p"])))
            model = LogisticRegression(weightCol="w", regParam=1.0 / n["n"], maxIter=50, standardization=False).fit(train.withColumn("w", w))
            part = model.transform(held.withColumn("w", w)).select(key, "y", vector_to_array("probability")[1].alias("s"))
        out = part if out is None else out.unionByName(part)
    return out


def competency_baselines(df: DataFrame, row_id: str, text: str, label: str, buckets: int = 4096) -> DataFrame:
    """(baseline, n, n_positive, pr_auc, roc_auc) of length and bag-of-words models, held out by hash."""
    d = df.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(
        F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(label).cast("double").alias("label"), F.array(F.length(text).cast("double")).alias("len")
    )
    d = d.withColumn("held", hash_unit("base", F.col("id")) < 0.3)
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    out = None
    for name in ("length", "bag_of_words"):
        x = d.withColumn("features", array_to_vector("len")) if name == "length" else HashingTF(inputCol="words", outputCol="features", numFeatures=buckets).transform(words.transform(d))
        model = LogisticRegression(maxIter=30, regParam=0.01).fit(x.where("not held"))
        s = model.transform(x.where("held")).select(F.lit(name).alias("baseline"), F.col("label").cast("int").alias("y"), F.round(vector_to_array("probability")[1], 9).alias("s"))
        r = ranking(s, ["baseline"])
        out = r if out is None else out.unionByName(r)
    return out


def recall_at_low_fpr_loss(df: DataFrame, keys: list[str], max_fpr: float = 0.01, sharpness: float = 20.0) -> DataFrame:
    """(keys, loss): 1 - soft recall above the (1 - max_fpr) quantile of the negatives' scores; null without both classes."""
    h = histogram(df, keys)
    cut = df.where("y = 0").groupBy(*keys).agg(F.percentile("s", 1 - max_fpr).alias("cut"))
    soft = 1 / (1 + F.exp(-sharpness * (F.col("s") - F.col("cut"))))
    g = h.join(cut, keys).groupBy(*keys).agg(F.sum(F.col("p") * soft).alias("a"), F.sum("p").alias("b"))
    return g.select(*keys, (1 - F.try_divide("a", "b")).alias("loss"))


def median_bandwidth(df: DataFrame, row_id: str, vector: str, most: int = 1000) -> DataFrame:
    """(bandwidth): median Euclidean distance between pairs of a hashed sample of at most ``most`` rows (a documented bound); null for fewer than two rows."""
    import numpy as np
    import pandas as pd

    s = df.where(F.col(vector).isNotNull()).orderBy(F.md5(F.col(row_id).cast("string")), row_id).limit(most).select(F.col(vector).cast("array<double>").alias("v"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        if len(x) < 2:
            return pd.DataFrame({"bandwidth": [None]})
        v = np.stack(x["v"].to_numpy())
        square = (v**2).sum(1)
        d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * v @ v.T, 0))
        return pd.DataFrame({"bandwidth": [float(np.median(d[np.triu_indices(len(v), 1)]))]})

    return s.groupBy().applyInPandas(run, "bandwidth double")


def distribution_shift(df: DataFrame, row_id: str, vector: str, domain: str) -> DataFrame:
    """(pad, domain_classifier_error, mmd_squared, bandwidth, p_value, mean_purity, n_a, n_b) of domains 0 and 1."""
    from tallywright.operators.eda import knn_purity, maximum_mean_discrepancy

    width = median_bandwidth(df, row_id, vector).first()
    width = width[0] if width is not None else None
    pad = proxy_a_distance(df, row_id, vector, domain).select(F.col("distance").alias("pad"), F.col("error").alias("domain_classifier_error"))
    mmd = maximum_mean_discrepancy(df, row_id, vector, domain, width or 1.0).select("mmd_squared", F.lit(width).cast("double").alias("bandwidth"), "p_value", "n_a", "n_b")
    # one row each, set side by side
    one = lambda x: x.withColumn("_row", F.lit(1))
    return one(pad).join(one(mmd), "_row").join(one(knn_purity(df, row_id, vector, domain).select("mean_purity")), "_row").drop("_row")

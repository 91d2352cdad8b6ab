"""Ranking, threshold and calibration metrics of scores against binary labels, for every key at once.

Input of all operators: a DataFrame with key columns (slice, scorer, ...),
``y`` (0/1) and ``s`` (a finite score), as ``validated`` gives it. Rows are first
collapsed to a histogram of distinct scores, which partial aggregation does
before any shuffle. Running counts over scores are taken within score ranges (a
few thousand a key, finer towards 0 and 1) and added to the counts of the ranges
ahead, so that no task sorts all scores of a key. Metrics that a key does not
define (one class only) are null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallywright.session import cut

#: Names of computed columns, which keys cannot have.
RESERVED = frozenset(("s", "y", "p", "n", "k", "tp", "pos", "tot", "rep", "bin", "w", "t", "_range"))


def validated(df: DataFrame, keys: list[str], label: str = "label", score: str = "score", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows with non-null keys, a 0/1 label and a finite score in [0, 1], as keys, y, s and extra columns."""
    ok = F.col(label).isin(0, 1) & F.col(score).between(0.0, 1.0) & ~F.isnan(score)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return df.where(ok).select(*keys, F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"), *extra)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows equal in keys the last by order; rows with a null key are no repeats of each other and all stay."""
    rest = [c for c in df.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")  # aggregated before the shuffle
    got = df.where(known).groupBy(*keys).agg(last).select(*keys, "_row.*").select(*df.columns)
    return got.unionByName(df.where(~known))


def invalid_counts(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Input validation: rows a key has, and how many break which rule."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(~F.col(label).isin(0, 1), F.lit(True))).alias("bad_label"),
        F.count_if(F.col(score).isNull() | F.isnan(score) | F.abs(score).isin(float("inf"))).alias("bad_score"),
        F.count_if(~F.isnan(score) & ~F.col(score).between(0.0, 1.0)).alias("out_of_unit"),
    )


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, p, n): positives and rows at every distinct score."""
    if clash := RESERVED & set(keys):
        raise ValueError(f"keys must not be named {sorted(clash)}")
    return df.groupBy(*keys, "s").agg(F.sum("y").cast("bigint").alias("p"), F.count("*").alias("n"))


#: Ranges an octave of s (or of 1 - s), and octaves told apart.
RANGES, OCTAVES = 64, 40


def score_range(s: str = "s") -> Column:
    """An integer that rises with the score: 64 ranges for each halving of the distance to 0 or 1."""
    near = lambda x: F.floor(F.log2(F.greatest(x, F.lit(2.0**-OCTAVES))) * RANGES).cast("int")
    return F.when(F.col(s) < 0.5, near(F.col(s))).otherwise(-near(1 - F.col(s)))


def range_offsets(counts: DataFrame, keys: list[str], sums: dict[str, str], descending: bool) -> DataFrame:
    """(keys, _range, and for each name: what the ranges ahead hold of a column, and name_all: what the key holds). At most a few thousand rows a key."""
    g = counts.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    w = W.partitionBy(*keys)
    ahead = w.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(W.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(n) for n in sums] + [F.sum(f"_{n}").over(w).alias(f"{n}_all") for n in sums]
    return g.select(*keys, "_range", *out)


def curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram with cumulative tp and k (rows at or above s) and the key's totals pos and tot."""
    h = histogram(df, keys).withColumn("_range", score_range())
    w = W.partitionBy(*keys, "_range").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    before = range_offsets(h, keys, {"_p0": "p", "_n0": "n"}, descending=True)
    return h.withColumns({"tp": F.sum("p").over(w), "k": F.sum("n").over(w)}).join(before, [*keys, "_range"]).select(
        *keys, "s", "p", "n", (F.col("tp") + F.col("_p0")).alias("tp"), (F.col("k") + F.col("_n0")).alias("k"), F.col("_p0_all").alias("pos"), F.col("_n0_all").alias("tot")
    )


def ranking(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_positive, pr_auc, roc_auc): step-wise average precision and tie-corrected ROC area."""
    c = curve(df, keys)
    neg = F.col("n") - F.col("p")
    both = (F.first("pos") > 0) & (F.first("pos") < F.first("tot"))
    return c.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("p").alias("n_positive"),
        F.when(both, F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("k")), F.sum("p"))).alias("pr_auc"),
        F.when(both, F.try_divide(F.sum(neg * (F.col("tp") - F.col("p") + F.col("p") / 2.0)), F.sum("p") * F.sum(neg))).alias("roc_auc"),
    )


def rates() -> dict[str, Column]:
    """Metrics of confusion counts tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn),
        "accuracy": (tp + tn) / (tp + fp + fn + tn), "fpr": fp / F.greatest(fp + tn, F.lit(1.0)), "fnr": fn / F.greatest(fn + tp, F.lit(1.0)),
    }


def confusion_at(df: DataFrame, keys: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """Confusion counts and rates at thresholds (s >= t, inclusive), in one pass for all; or at a column t of df."""
    if thresholds is not None:
        df = df.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.col("s") >= F.col("t")
    yes = F.col("y") == 1
    return df.groupBy(*keys, "t").agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn")
    ).withColumns(rates())


def single_class_at(df: DataFrame, keys: list[str], t: float) -> DataFrame:
    """Recall of all-positive keys; fpr and specificity of all-negative ones; mixed keys are left out."""
    c = confusion_at(df, keys, [t])
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return c.where((pos == 0) | (neg == 0)).select(
        *keys, F.when(neg == 0, F.try_divide(F.col("tp"), pos)).alias("recall"), F.when(pos == 0, F.try_divide(F.col("fp"), neg)).alias("fpr"), F.when(pos == 0, F.try_divide(F.col("tn"), neg)).alias("specificity")
    )


Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95, clip: bool = False) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null for n = 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, zz = k / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = mid - half, mid + half
    return (F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))) if clip else (low, high)


def stratified_recall(df: DataFrame, keys: list[str], stratum: str, t: float) -> DataFrame:
    """(keys, stratum, n_positive, n_hit, recall, ci_low, ci_high) among positives; null strata are 'unlabeled'."""
    g = df.where("y = 1").groupBy(*keys, F.coalesce(F.col(stratum).cast("string"), F.lit("unlabeled")).alias("stratum")).agg(
        F.count("*").alias("n_positive"), F.count_if(F.col("s") >= t).alias("n_hit")
    )
    low, high = wilson(F.col("n_hit"), F.col("n_positive"))
    return g.withColumns({"recall": F.col("n_hit") / F.col("n_positive"), "ci_low": low, "ci_high": high})


def equal_width_bin(n_bins: int, s: str = "s") -> Column:
    """Bin by linspace edges, right-open, the last closed; exact at float edges."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, n_bins + 1)])
    return F.least(F.size(F.filter(edges, lambda e: e <= F.col(s))) - 1, F.lit(n_bins - 1))


def units(s: str = "s") -> Column:
    """The score in 1e-12 as a whole number: sums of it don't depend on their order."""
    return F.round(F.col(s) * 1e12).cast("decimal(14,0)")


def equal_width_bins(df: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """(keys, bin, n, conf, freq, units) of non-empty bins; units is the sum of the scores in 1e-12."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    h = histogram(df, keys).withColumn("bin", equal_width_bin(n_bins))
    g = h.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum(units() * F.col("n").cast("decimal(18,0)")).alias("units"), F.sum("p").alias("p"))
    return g.select(*keys, "bin", "n", (F.col("units").cast("double") / 1e12 / F.col("n")).alias("conf"), (F.col("p") / F.col("n")).alias("freq"), "units")


def equal_mass_ranks(df: DataFrame, keys: list[str], n_bins: int, tie: str) -> DataFrame:
    """df with the equal-mass bin of each row: as many rows a bin as possible, by score, then by ``tie`` (an integer); keys of fewer rows than bins are left out.

    A row's rank is the number of rows in lower score ranges, in lower cells
    of its range (a score and 65,536 values of the tie), and ahead of it in its
    cell, so the rows of one hot score are ranked by many tasks.
    """
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    r = df.withColumns({"_range": score_range(), "_cell": F.shiftright(F.col(tie).cast("bigint"), 16)})
    cells = r.groupBy(*keys, "_range", "s", "_cell").agg(F.count("*").alias("_c"))
    lower = W.partitionBy(*keys, "_range").orderBy("s", "_cell").rowsBetween(W.unboundedPreceding, -1)
    before = range_offsets(cells, keys, {"_n0": "_c"}, descending=False)
    cells = cells.withColumn("_in", F.coalesce(F.sum("_c").over(lower), F.lit(0))).join(before, [*keys, "_range"]).where(F.col("_n0_all") >= n_bins)
    cells = cells.select(*keys, "s", "_cell", (F.col("_n0") + F.col("_in")).alias("_before"), F.col("_n0_all").alias("tot"))
    inside = F.row_number().over(W.partitionBy(*keys, "s", "_cell").orderBy(tie)) - 1
    r = r.withColumn("_inside", inside).join(cells, [*keys, "s", "_cell"]).withColumn("rank", F.col("_before") + F.col("_inside"))
    edge = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda b: F.floor(b * (F.col("tot") / F.lit(float(n_bins)))))
    return r.withColumn("bin", F.least(F.size(F.filter(edge, lambda e: e <= F.col("rank"))) - 1, F.lit(n_bins - 1))).select(*df.columns, "bin", "tot")


def equal_mass_bins(df: DataFrame, keys: list[str], n_bins: int = 10, tie: str = "row_id") -> DataFrame:
    """(keys, bin, n, conf, freq) of equal-mass bins."""
    exact = (F.sum(units()).cast("double") / 1e12 / F.count("*")).alias("conf")
    return equal_mass_ranks(df, keys, n_bins, tie).groupBy(*keys, "bin").agg(F.count("*").alias("n"), exact, F.avg("y").alias("freq"))


def ece_family(bins: DataFrame, keys: list[str]) -> DataFrame:
    """ece, l2, debiased l2 (less the variance that labels drawn at the bin's mean score would have) and maximum calibration error of binned scores."""
    tot = F.sum("n").over(W.partitionBy(*keys))
    b = bins.withColumn("w", F.col("n") / tot).withColumn("gap", F.abs(F.col("conf") - F.col("freq")))
    noise = F.col("w") * F.col("conf") * (1 - F.col("conf")) / F.col("n")
    return b.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("gap")).alias("ece"), F.sqrt(F.sum(F.col("w") * F.col("gap") * F.col("gap"))).alias("ece_l2"),
        F.sqrt(F.greatest(F.sum(F.col("w") * F.col("gap") * F.col("gap")) - F.sum(noise), F.lit(0.0))).alias("ece_l2_debiased"),
        F.max("gap").alias("mce"),
    )


def hash_unit(*parts: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) of the parts; the same in any engine with md5."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *cols)), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Modulus of the draws: x * x stays below 2^62 in any engine.
PRIME = 2147483647


def draws(unit: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """Reproducible numbers below PRIME for each unit (rows) and repetition (columns); integer arithmetic any SQL engine has."""
    u = (unit.astype(np.int64) % PRIME + PRIME) % PRIME
    x = (u[:, None] * 48271 + rep[None, :].astype(np.int64) * 69621 + seed) % PRIME
    x = (x * x + rep[None, :]) % PRIME
    return (x * x + u[:, None]) % PRIME


def ece_debiased(df: DataFrame, keys: list[str], n_bins: int = 10, sweeps: int = 200, tie: str = "row_id", seed: int = 1) -> DataFrame:
    """Equal-mass ECE less its mean over sweeps of labels drawn from the scores, at least 0.

    Bins don't depend on labels, so a sweep is one sum a bin: an Arrow kernel
    sums the drawn labels of all sweeps for each key and bin before the shuffle.
    """
    ranked = cut(equal_mass_ranks(df, keys, n_bins, tie))
    kinds = dict(df.dtypes)
    sweep = np.arange(1, sweeps + 1)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            # rows of a few hundred KB of draws at a time
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo : lo + 4096]
                y = draws(part[tie].to_numpy(), sweep, seed) < (part["s"].to_numpy() * PRIME)[:, None]
                groups = part.groupby([*keys, "bin"], sort=False).indices
                for k, rows in groups.items():
                    k = k if isinstance(k, tuple) else (k,)
                    yield pd.DataFrame([[*k, y[rows].sum(0).tolist()]], columns=[*keys, "bin", "hits"])

    cols = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "bin int", "hits array<bigint>"])
    bins = ranked.groupBy(*keys, "bin").agg(F.count("*").alias("n"), (F.sum(units()).cast("double") / 1e12).alias("sum_s"), F.sum("y").alias("sum_y"))
    tot = F.sum("n").over(W.partitionBy(*keys))
    plug = bins.withColumn("tot", tot).groupBy(*keys).agg((F.sum(F.abs(F.col("sum_s") - F.col("sum_y"))) / F.first("tot")).alias("ece"))
    drawn = ranked.select(*keys, "s", tie, F.col("bin").cast("int").alias("bin")).mapInPandas(run, cols)
    drawn = drawn.select(*keys, "bin", F.posexplode("hits").alias("sweep", "hits")).groupBy(*keys, "bin", "sweep").agg(F.sum("hits").alias("hits"))
    null = drawn.join(bins.select(*keys, "bin", "sum_s", "n"), [*keys, "bin"]).groupBy(*keys, "sweep").agg((F.sum(F.abs(F.col("sum_s") - F.col("hits"))) / F.sum("n")).alias("e"))
    null = null.groupBy(*keys).agg(F.avg("e").alias("null_ece"))
    return plug.join(null, keys).withColumn("ece_debiased", F.greatest(F.col("ece") - F.col("null_ece"), F.lit(0.0)))


def brier(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("brier"))


def brier_decomposition(df: DataFrame, keys: list[str], n_bins: int = 10, tie: str = "row_id") -> DataFrame:
    """brier, reliability, resolution, uncertainty over equal-mass bins."""
    b = equal_mass_bins(df, keys, n_bins, tie)
    tot, mean = F.sum("n").over(W.partitionBy(*keys)), F.sum(F.col("n") * F.col("freq")).over(W.partitionBy(*keys))
    b = b.withColumn("w", F.col("n") / tot).withColumn("mean", mean / tot)
    parts = b.groupBy(*keys).agg(
        F.sum(F.col("w") * F.pow(F.col("conf") - F.col("freq"), 2)).alias("reliability"), F.sum(F.col("w") * F.pow(F.col("freq") - F.col("mean"), 2)).alias("resolution"),
        (F.first("mean") * (1 - F.first("mean"))).alias("uncertainty"),
    )
    return brier(df, keys).join(parts, keys)


def score_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean (of the scores as written), std and quartiles between the two scores next to their place.

    The weighted sum of the two is fused (rounded once), as it is in SQL's quantile_cont.
    """
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    first, last = F.col("tot") - F.col("k"), F.col("tot") - F.col("k") + F.col("n") - 1  # places of a score's rows, from 0
    place = {c: (F.col("tot") - 1) * q for c, q in shares.items()}
    at = lambda i, name: F.max(F.when(i.between(first, last), F.col("s"))).alias(name)
    ends = [e for c in shares for e in (at(F.floor(place[c]), f"_a_{c}"), at(F.ceil(place[c]), f"_b_{c}"))]
    q = curve(df, keys).groupBy(*keys).agg(F.first("tot").alias("tot"), *ends)
    fused = lambda x, y, z: F.java_method(F.lit("java.lang.Math"), F.lit("fma"), x, y, z).cast("double")
    part = {c: place[c] - F.floor(place[c]) for c in shares}
    between = [fused(F.col(f"_a_{c}"), 1 - part[c], F.col(f"_b_{c}") * part[c]).alias(c) for c in shares]
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("s").cast("decimal(30,18)")).cast("double").alias("mean"), F.stddev_pop("s").alias("std"))
    return g.join(q.select(*keys, *between), keys).select(*keys, "n", "mean", "std", *shares)


def precision_at_prior(df: DataFrame, keys: list[str], t: float, priors: list[float]) -> DataFrame:
    """Precision that a threshold would have at assumed priors."""
    c = confusion_at(df, keys, [t]).withColumn("prior", F.explode(F.array(*[F.lit(p) for p in priors])))
    a, b = F.col("prior") * F.col("recall"), (1 - F.col("prior")) * F.col("fpr")
    return c.select(*keys, "prior", (a / F.greatest(a + b, F.lit(1e-12))).alias("precision_at_prior"))


def quantile_stratified(df: DataFrame, keys: list[str], by: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """pr_auc of all rows, of those within the quantile window of ``by``, their gap (full less trimmed), and whether it is above 0.05."""
    q = df.groupBy(*keys).agg(F.percentile(by, F.array(F.lit(low), F.lit(high))).alias("q"))
    inside = df.join(q, keys).where(F.col(by).between(F.col("q")[0], F.col("q")[1]))
    full = ranking(df, keys).select(*keys, F.col("pr_auc").alias("full"))
    trimmed = ranking(inside, keys).where("n_positive >= 10 and n - n_positive >= 10").select(*keys, F.col("pr_auc").alias("trimmed"))
    out = full.join(trimmed, keys).withColumn("gap", F.col("full") - F.col("trimmed"))
    return out.withColumn("gap_flag", F.col("gap") > 0.05)


def expected_cost(df: DataFrame, keys: list[str], c_fp: float, c_fn: float) -> DataFrame:
    """Cost a row at the Bayes threshold of each key's own prior."""
    prior = df.groupBy(*keys).agg(F.avg("y").alias("prior"))
    t = F.when(F.col("prior") <= 0, 1.0).when(F.col("prior") >= 1, 0.0).otherwise(
        c_fp * (1 - F.col("prior")) / (c_fp * (1 - F.col("prior")) + c_fn * F.col("prior"))
    )
    c = confusion_at(df.join(prior.withColumn("t", t).drop("prior"), keys), keys)
    return c.select(*keys, "t", ((F.col("fp") * c_fp + F.col("fn") * c_fn) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("cost"))

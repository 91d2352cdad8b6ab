"""Bootstrap intervals, paired comparisons, DeLong, fold summaries and detectable effects.

Replicates use Poisson(1) weights drawn from integer arithmetic on (seed,
replicate, unit): every engine and every partitioning draws the same, and units
weigh the same for all scorers of a slice, so scorers are compared in pairs
without a join. A unit is a row, or a group for the clustered form.

All replicates are computed in one pass: the rows of a key, in blocks of score
ranges, stream through an Arrow kernel by falling score, which keeps the running
weights of all replicates and never a whole group. Blocks of one key are joined
by the weights of the blocks ahead. Replicates that lack a class are left out
and counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallywright.operators.metrics import PRIME, RESERVED, curve, draws, equal_width_bin, range_offsets, ranking, score_range

#: Cumulative Poisson(1) probabilities 0..7 (fixed values).
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
#: The same as bounds of the draws.
BOUNDS = [math.ceil(p * PRIME) for p in POISSON]
#: Rows a block of score ranges should have; rows and replicates handled at a time.
BLOCK_ROWS, CHUNK_CELLS = 1_000_000, 2_000_000


def weights(unit: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of units (rows) in replicates 1..reps (columns)."""
    x = draws(unit, np.arange(1, reps + 1), seed)
    return np.searchsorted(np.array(BOUNDS), x.reshape(-1), side="right").astype(np.int64).reshape(x.shape)


def _blocks(df: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """df with _block, consecutive score ranges of about BLOCK_ROWS rows from the highest; whether any key has more than one."""
    r = df.withColumn("_range", score_range())
    counts = r.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    off = range_offsets(counts, keys, {"_n0": "_c"}, descending=True).select(*keys, "_range", F.floor(F.col("_n0") / BLOCK_ROWS).cast("int").alias("_block"), "_n0_all")
    most = off.agg(F.max("_n0_all")).first()[0] or 0
    if most <= BLOCK_ROWS:
        return r.drop("_range").withColumn("_block", F.lit(0)), False
    return r.join(off.drop("_n0_all"), [*keys, "_range"]).drop("_range"), True


def _stream(keys: list[str], reps: int, seed: int, offsets: bool, best: bool = False):
    """Arrow kernel over rows sorted by key, block and falling score: one row a key, block and replicate.

    Columns: keys, _block, s, y, unit; with offsets also _p0 and _n0, the
    weights ahead of the block, and for the threshold of best F1 _pos, all
    positive weights of the key (arrays over replicates).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, state = None, None, None

        def start(b: pa.RecordBatch, at: int) -> dict:
            z = lambda: np.zeros(reps)
            p0, n0 = (np.array(b.column(b.schema.get_field_index(c))[at].as_py(), float) if offsets else z() for c in ("_p0", "_n0"))
            every = np.array(b.column(b.schema.get_field_index("_pos"))[at].as_py(), float) if best else None
            return {"tp": p0, "k": n0, "pos": z(), "tot": z(), "a": z(), "b": z(), "s": None, "p": z(), "n": z(), "every": every, "f1": z() - 1, "t": z()}

        def close(x: dict) -> None:
            """Adds the scores that were held back: the last group of equal scores."""
            if x["s"] is not None:
                add(x, x["p"][None, :], x["n"][None, :], np.array([x["s"]]))
                x["p"], x["n"] = np.zeros(reps), np.zeros(reps)

        def add(x: dict, p: np.ndarray, n: np.ndarray, score: np.ndarray) -> None:
            tp, k = x["tp"] + np.cumsum(p, 0), x["k"] + np.cumsum(n, 0)
            if best:  # of equal ones the lowest score, which comes last
                f1 = np.round(2 * tp / np.maximum(k + x["every"], 1), 12)
                at = len(f1) - 1 - np.argmax(f1[::-1], axis=0)
                top = f1[at, np.arange(reps)]
                x["t"] = np.where(top >= x["f1"], score[at], x["t"])
                x["f1"] = np.maximum(x["f1"], top)
            x["a"] += (p * tp / np.maximum(k, 1)).sum(0)
            x["b"] += ((n - p) * (tp - p / 2)).sum(0)
            x["pos"] += p.sum(0)
            x["tot"] += n.sum(0)
            x["tp"], x["k"] = tp[-1], k[-1]

        def done() -> pa.RecordBatch:
            close(state)
            cols = [pa.array([v] * reps, t) for v, t in head]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(1, reps + 1, dtype=np.int32)), *(pa.array(state[c]) for c in ("pos", "tot", "a", "b", "f1", "t"))], [*keys, "_block", "rep", "pos", "tot", "a", "b", "f1", "t"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_pylist() for i in range(len(keys) + 1)]
            who = list(zip(*cols))
            edge = [0, *(i for i in range(1, len(who)) if who[i] != who[i - 1]), len(who)]
            s, y, unit = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("s", "y", "unit"))
            for lo, hi in zip(edge, edge[1:]):
                if who[lo] != now:
                    if state is not None:
                        yield done()
                    now, state = who[lo], start(b, lo)
                    head = [(v, b.schema.types[i]) for i, v in enumerate(now)]
                step = max(1, CHUNK_CELLS // reps)
                for at in range(lo, hi, step):
                    end = min(at + step, hi)
                    w = weights(unit[at:end], reps, seed).astype(float)
                    first = np.flatnonzero(np.append(True, s[at + 1 : end] != s[at : end - 1]))
                    n = np.add.reduceat(w, first, axis=0)
                    p = np.add.reduceat(w * y[at:end, None], first, axis=0)
                    if state["s"] is not None and state["s"] == s[at]:
                        n[0] += state["n"]
                        p[0] += state["p"]
                    else:
                        close(state)
                    if len(first) > 1:
                        add(state, p[:-1], n[:-1], s[at + first[:-1]])
                    state["s"], state["p"], state["n"] = s[end - 1], p[-1], n[-1]
        if state is not None:
            yield done()

    return run


def _streamed(df: DataFrame, keys: list[str], unit: str, reps: int, seed: int, best: bool) -> DataFrame:
    """(keys, _block, rep, pos, tot, a, b, f1, t) of all blocks."""
    if clash := RESERVED & set(keys):
        raise ValueError(f"keys must not be named {sorted(clash)}")
    d = df.where(F.col(unit).isNotNull()).select(*keys, "s", F.col("y").cast("double").alias("y"), F.col(unit).cast("bigint").alias("unit"))
    d, many = _blocks(d, keys)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_block int, rep int, pos double, tot double, a double, b double, f1 double, t double"])
    by = [*keys, "_block"]
    columns = [*by, "s", "y", "unit"]

    def stream(x: DataFrame, offsets: bool, best: bool = False) -> DataFrame:
        return x.repartition(*by).sortWithinPartitions(*by, F.desc("s")).mapInArrow(_stream(keys, reps, seed, offsets, best), schema)

    if not many and not best:
        return stream(d.select(*columns), False)
    # weights of the blocks ahead, of all replicates: one row of arrays a block
    own = stream(d.select(*columns), False).select(*by, "rep", "pos", "tot")
    of = W.partitionBy(*keys, "rep")
    ahead = of.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({"_p0": F.coalesce(F.sum("pos").over(ahead), F.lit(0.0)), "_n0": F.coalesce(F.sum("tot").over(ahead), F.lit(0.0)), "_pos": F.sum("pos").over(of)})
    own = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rep", "_p0", "_n0", "_pos"))).alias("x"))
    return stream(d.join(own.select(*by, "x._p0", "x._n0", "x._pos"), by).select(*columns, "_p0", "_n0", "_pos"), True, best)


def replicates(df: DataFrame, keys: list[str], unit: str, reps: int, seed: int = 7) -> DataFrame:
    """(keys, rep, pr_auc, roc_auc) of weighted replicates; those with one class only are left out. unit: an integer column; rows without one are left out."""
    out = _streamed(df, keys, unit, reps, seed, False)
    g = out.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in ("pos", "tot", "a", "b")]).where("pos > 0 and pos < tot")
    return g.select(*keys, "rep", (F.col("a") / F.col("pos")).alias("pr_auc"), (F.col("b") / (F.col("pos") * (F.col("tot") - F.col("pos")))).alias("roc_auc"))


def best_f1_replicates(df: DataFrame, keys: list[str], unit: str, reps: int, seed: int = 7) -> DataFrame:
    """(keys, rep, t): the threshold of best F1 (ties: the lowest) of every weighted replicate that has positives."""
    out = _streamed(df, keys, unit, reps, seed, True)
    return out.groupBy(*keys, "rep").agg(F.sum("pos").alias("pos"), F.min_by("t", F.struct(-F.col("f1"), F.col("t"))).alias("t")).where("pos > 0").select(*keys, "rep", "t")


def binned_replicates(df: DataFrame, keys: list[str], unit: str, reps: int, n_bins: int = 10, seed: int = 7) -> DataFrame:
    """(keys, rep, ece) of weighted replicates over equal-width bins: an Arrow kernel sums all replicates of a bin before the shuffle."""
    kinds = dict(df.dtypes)
    d = df.where(F.col(unit).isNotNull()).select(*keys, equal_width_bin(n_bins).cast("int").alias("_bin"), "s", F.col("y").cast("double").alias("y"), F.col(unit).cast("bigint").alias("unit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CHUNK_CELLS // reps)
        for b in batches:
            for lo in range(0, len(b), step):
                part = b.iloc[lo : lo + step]
                w = weights(part["unit"].to_numpy(), reps, seed)
                gap = w * (part["s"].to_numpy() - part["y"].to_numpy())[:, None]
                for k, rows in part.groupby([*keys, "_bin"], sort=False).indices.items():
                    yield pd.DataFrame([[*k, gap[rows].sum(0).tolist(), w[rows].sum(0).tolist()]], columns=[*keys, "_bin", "gap", "n"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_bin int, gap array<double>, n array<bigint>"])
    x = d.mapInPandas(run, schema).select(*keys, "_bin", F.posexplode(F.arrays_zip("gap", "n")).alias("rep", "v"))
    x = x.groupBy(*keys, "rep", "_bin").agg(F.sum("v.gap").alias("gap"), F.sum("v.n").alias("n"))
    return x.groupBy(*keys, "rep").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece")).where("ece is not null").withColumn("rep", F.col("rep") + 1)


def bootstrap_ci(df: DataFrame, keys: list[str], metric: str = "pr_auc", unit: str = "row_id", reps: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(keys, ci_low, ci_high, n_resamples): percentile interval; unit = a group column gives the clustered bootstrap."""
    a = (1 - confidence) / 2
    q = F.percentile(metric, F.array(F.lit(a), F.lit(1 - a)))
    g = replicates(df, keys, unit, reps).groupBy(*keys).agg(q.alias("q"), F.count("*").alias("n_resamples"))
    return g.select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_resamples")


def paired_diff(df: DataFrame, keys: list[str], scorer: str, a: str, b: str, metric: str = "pr_auc", unit: str = "row_id", reps: int = 1000) -> DataFrame:
    """(keys, ci_low, ci_high, overlaps_zero, mde, n_resamples) of metric(b) - metric(a) on shared draws; metric: pr_auc, roc_auc or ece."""
    two = df.where(F.col(scorer).isin(a, b))
    r = binned_replicates(two, [*keys, scorer], unit, reps) if metric == "ece" else replicates(two, [*keys, scorer], unit, reps)
    d = r.groupBy(*keys, "rep").agg(F.max(F.when(F.col(scorer) == b, F.col(metric))).alias("vb"), F.max(F.when(F.col(scorer) == a, F.col(metric))).alias("va"))
    q = F.percentile(F.col("vb") - F.col("va"), F.array(F.lit(0.025), F.lit(0.975)))
    g = d.where("va is not null and vb is not null").groupBy(*keys).agg(q.alias("q"), F.count("*").alias("n_resamples"))
    low, high = F.col("q")[0], F.col("q")[1]
    return g.select(*keys, low.alias("ci_low"), high.alias("ci_high"), ((low <= 0) & (high >= 0)).alias("overlaps_zero"), mde(low, high).alias("mde"), "n_resamples")


def mde(low: Column, high: Column, alpha: float = 0.05, power: float = 0.8, confidence: float = 0.95) -> Column:
    """Smallest effect an interval's width could detect."""
    n = NormalDist()
    return (high - low) * ((n.inv_cdf(1 - alpha / 2) + n.inv_cdf(power)) / (2 * n.inv_cdf(0.5 + confidence / 2)))


def fold_ci(folds: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """(keys, mean, ci_low, ci_high, k): normal interval over fold values; keys with a null fold or fewer than two are left out."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    g = folds.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("k"), F.count("*").alias("rows"))
    half = z * F.col("sd") / F.sqrt("k")
    return g.where("k >= 2 and k = rows").select(*keys, "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"), "k")


def delong(df: DataFrame, keys: list[str], scorer: str, a: str, b: str, unit: str = "row_id") -> DataFrame:
    """(keys, auc_a, auc_b, delta, variance, z): DeLong's comparison of two scorers over units both have scored once."""
    two = df.where(F.col(scorer).isin(a, b)).groupBy(*keys, unit, "y").agg(
        F.max(F.when(F.col(scorer) == a, F.col("s"))).alias("sa"), F.max(F.when(F.col(scorer) == b, F.col("s"))).alias("sb")
    ).where("sa is not null and sb is not null")
    for side in ("a", "b"):
        c = curve(two.select(*keys, "y", F.col(f"s{side}").alias("s")), keys)
        neg, all_neg = F.col("n") - F.col("p"), F.col("tot") - F.col("pos")
        pl = c.select(
            *keys, F.col("s").alias(f"s{side}"),
            ((all_neg - (F.col("k") - F.col("tp")) + neg / 2.0) / all_neg).alias(f"v1{side}"), ((F.col("tp") - F.col("p") / 2.0) / F.col("pos")).alias(f"v0{side}"),
        )
        two = two.join(pl, [*keys, f"s{side}"])
    pos, neg = F.col("y") == 1, F.col("y") == 0
    d1, d0 = F.when(pos, F.col("v1a") - F.col("v1b")), F.when(neg, F.col("v0a") - F.col("v0b"))
    g = two.groupBy(*keys).agg(
        F.avg(F.when(pos, F.col("v1a"))).alias("auc_a"), F.avg(F.when(pos, F.col("v1b"))).alias("auc_b"),
        (F.var_samp(d1) / F.count(d1) + F.var_samp(d0) / F.count(d0)).alias("variance"),
    ).withColumn("delta", F.col("auc_a") - F.col("auc_b"))
    return g.withColumn("z", F.when(F.col("variance") > 0, F.col("delta") / F.sqrt("variance"))).select(*keys, "auc_a", "auc_b", "delta", "variance", "z")


def bca_ci(df: DataFrame, keys: list[str], unit: str = "row_id", reps: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(keys, roc_auc, ci_low, ci_high, n_resamples): bias-corrected accelerated interval of the ROC area.

    The jackknife needs one value a distinct (score, label) cell, weighted by
    its count: leaving out a row changes the area by that row's placement.
    """
    c = curve(df, keys).where("pos > 1 and tot - pos > 1").withColumn("neg", F.col("tot") - F.col("pos"))
    below = F.col("neg") - (F.col("k") - F.col("tp"))  # negatives below the score
    nn = F.col("n") - F.col("p")
    c = c.withColumn("v1", (below + nn / 2.0)).withColumn("v0", F.col("tp") - F.col("p") + F.col("p") / 2.0)
    auc = ranking(df, keys).select(*keys, "roc_auc")
    c = c.join(auc, keys)
    total = F.col("roc_auc") * F.col("pos") * F.col("neg")
    j1, j0 = (total - F.col("v1")) / ((F.col("pos") - 1) * F.col("neg")), (total - F.col("v0")) / (F.col("pos") * (F.col("neg") - 1))
    c = c.withColumn("j1", j1).withColumn("j0", j0)
    mean = F.sum(F.col("p") * F.col("j1") + nn * F.col("j0")).over(W.partitionBy(*keys)) / F.col("tot")
    c = c.withColumn("d1", mean - F.col("j1")).withColumn("d0", mean - F.col("j0"))
    cube = F.sum(F.col("p") * F.pow("d1", F.lit(3)) + nn * F.pow("d0", F.lit(3)))
    square = F.sum(F.col("p") * F.pow("d1", F.lit(2)) + nn * F.pow("d0", F.lit(2)))
    acc = c.groupBy(*keys).agg((F.try_divide(cube, 6 * F.pow(square, F.lit(1.5)))).alias("acc"))
    rep = replicates(df, keys, unit, reps).join(auc.withColumnRenamed("roc_auc", "point"), keys)
    g = rep.groupBy(*keys).agg(
        F.sort_array(F.collect_list("roc_auc")).alias("v"), F.first("point").alias("roc_auc"), F.count("*").alias("n_resamples"),
        ((F.count_if(F.col("roc_auc") < F.col("point")) + F.count_if(F.col("roc_auc") == F.col("point")) / 2.0) / F.count("*")).alias("share"),
    ).join(acc, keys)

    @F.pandas_udf("array<double>")
    def bounds(v: pd.Series, share: pd.Series, a: pd.Series) -> pd.Series:
        nd, out = NormalDist(), []
        for x, s, acc_ in zip(v, share, a):
            if acc_ is None or acc_ != acc_ or not 0 < s < 1:
                out.append(None)
                continue
            z0 = nd.inv_cdf(s)
            q = []
            for p in ((1 - confidence) / 2, (1 + confidence) / 2):
                z = z0 + nd.inv_cdf(p)
                q.append(nd.cdf(z0 + z / (1 - acc_ * z)))
            out.append([float(b) for b in np.quantile(np.asarray(x, float), q)])
        return pd.Series(out)

    return g.withColumn("b", bounds("v", "share", "acc")).select(*keys, "roc_auc", F.col("b")[0].alias("ci_low"), F.col("b")[1].alias("ci_high"), "n_resamples")


def op_point_diff(val: DataFrame, test: DataFrame, keys: list[str], scorer: str, a: str, b: str, unit: str = "row_id", reps: int = 1000) -> DataFrame:
    """(keys, ci_low, ci_high, n_resamples) of F1(b) - F1(a) on weighted test rows at thresholds of best F1 refitted on weighted validation rows of the scorer.

    Thresholds of all replicates are one small array a scorer; an Arrow kernel
    counts the test rows at all of them before the shuffle.
    """
    kinds = dict(test.dtypes)
    fitted = best_f1_replicates(val.where(F.col(scorer).isin(a, b)), [scorer], unit, reps, seed=11)
    fitted = fitted.groupBy(scorer).agg(F.map_from_entries(F.collect_list(F.struct("rep", "t"))).alias("t"))
    at = {r[scorer]: np.array([r["t"].get(k, np.inf) for k in range(1, reps + 1)]) for r in fitted.collect()}
    group = [*keys, scorer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CHUNK_CELLS // reps)
        for x in batches:
            for lo in range(0, len(x), step):
                part = x.iloc[lo : lo + step]
                w = weights(part["unit"].to_numpy(), reps, 13)
                for k, rows in part.groupby(group, sort=False).indices.items():
                    hit, wk = part["s"].to_numpy()[rows, None] >= at[k[-1]][None, :], w[rows]
                    yes = part["y"].to_numpy()[rows, None] == 1
                    yield pd.DataFrame([[*k, (wk * (hit & yes)).sum(0).tolist(), (wk * hit).sum(0).tolist(), (wk * yes).sum(0).tolist()]], columns=[*group, "tp", "k", "pos"])

    d = test.where(F.col(scorer).isin(*at or [None]) & F.col(unit).isNotNull()).select(*group, "s", "y", F.col(unit).cast("bigint").alias("unit"))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in group), "tp array<bigint>, k array<bigint>, pos array<bigint>"])
    x = d.mapInPandas(run, schema).select(*group, F.posexplode(F.arrays_zip("tp", "k", "pos")).alias("rep", "v"))
    g = x.groupBy(*group, "rep").agg(F.try_divide(2.0 * F.sum("v.tp"), F.sum("v.k") + F.sum("v.pos")).alias("f1"))
    d = g.groupBy(*keys, "rep").agg((F.max(F.when(F.col(scorer) == b, F.col("f1"))) - F.max(F.when(F.col(scorer) == a, F.col("f1")))).alias("d")).where("d is not null")
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return d.groupBy(*keys).agg(q.alias("q"), F.count("*").alias("n_resamples")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_resamples")

"""Fold assignment as columns; random orders come from a hash of the row id, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shuffle_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(row_id).cast("string")))


def dealt(df: DataFrame, row_id: str, keys: list[str], seed: int) -> DataFrame:
    """df with rank (from 1) and total within keys, in hashed order: rows are ranked within slices of the hash and slices counted ahead, so no task sorts all rows of a key."""
    r = df.withColumn("_h", shuffle_key(row_id, seed)).withColumn("_slice", F.substring("_h", 1, 3))
    counts = r.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    counts = counts.select(*keys, "_slice", F.coalesce(F.sum("_c").over(w.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("total"))
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("_h", row_id))
    return r.withColumn("_in", inside).join(counts, [*keys, "_slice"]).select(*df.columns, (F.col("_before") + F.col("_in")).alias("rank"), "total")


def holdout(df: DataFrame, row_id: str, label: str, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """df with role; rows without a label are left out."""
    role = F.when(F.col("rank") <= F.round(F.col("total") * test_size), "test").otherwise("train")
    return dealt(df, row_id, [label], seed).select(*df.columns, role.alias("role"))


def stratified_kfold(df: DataFrame, row_id: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with fold; rows without a label are left out."""
    return dealt(df, row_id, [label], seed).select(*df.columns, ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def source_disjoint(df: DataFrame, source: str, k: int = 3, seed: int = 0) -> DataFrame:
    """Whole sources dealt in hashed order; null sources are left out. One row a source goes through the window."""
    s = df.where(F.col(source).isNotNull()).select(source).distinct()
    s = s.withColumn("fold", ((F.row_number().over(W.orderBy(shuffle_key(source, seed), source)) - 1) % k).cast("int"))
    return df.join(s, source)


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Groups by falling size into the lightest fold (ties: smaller group id, lower fold); null groups are left out.

    The greedy step runs in one task over one (group, size) row a group.
    """
    import pandas as pd

    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    kind = dict(df.dtypes)[group]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        heap, out = [(0, f) for f in range(k)], []
        for g, n in pdf.sort_values(["n", group], ascending=[False, True])[[group, "n"]].itertuples(index=False):
            load, f = heapq.heappop(heap)
            out.append((g, f))
            heapq.heappush(heap, (load + n, f))
        return pd.DataFrame(out, columns=[group, "fold"]).astype({group: pdf[group].dtype, "fold": "int32"})

    return df.join(sizes.groupBy().applyInPandas(deal, f"`{group}` {kind}, fold int"), group)


def ranked(df: DataFrame, time: str, row_id: str) -> DataFrame:
    """df with 0-based rank by time and the number of rows: ranks within days, days counted cumulatively, so no single task sorts all rows."""
    day = F.to_date(time)
    r = df.where(F.col(time).isNotNull()).withColumn("_day", day)
    days = r.groupBy("_day").agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).withColumn("total", F.sum("_n").over(W.partitionBy()))
    inside = F.row_number().over(W.partitionBy("_day").orderBy(time, row_id)) - 1
    return r.withColumn("_in", inside).join(days, "_day").withColumn("rank", F.col("_before") + F.col("_in")).drop("_day", "_in", "_n", "_before")


def time_series(df: DataFrame, time: str, row_id: str, k: int = 4) -> DataFrame:
    """(row_id, fold, role): expanding window with test blocks of n // (k + 1) rows."""
    r = ranked(df, time, row_id).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("total") / (k + 1))
    start = F.col("total") - (k - F.col("fold")) * size
    role = F.when(F.col("rank") < start, "train").when(F.col("rank") < start + size, "test")
    return r.withColumn("role", role).where("role is not null").select(row_id, "fold", "role")


def purged_kfold(df: DataFrame, time: str, row_id: str, k: int = 5, gap: int = 0, embargo: float = 0.0) -> DataFrame:
    """(row_id, fold, role): contiguous test folds; rows within the gap on both sides and in the embargo behind are in no role."""
    r = ranked(df, time, row_id).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    base, more = F.floor(F.col("total") / k), F.col("total") % k
    start = F.col("fold") * base + F.least(F.col("fold"), more)
    end = start + base + (F.col("fold") < more).cast("int")
    after = end + gap + F.floor(F.col("total") * embargo)
    role = F.when(F.col("rank").between(start, end - 1), "test").when((F.col("rank") < start - gap) | (F.col("rank") >= after), "train")
    return r.withColumn("role", role).where("role is not null").select(row_id, "fold", "role")


def with_pool(folds: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Folds (row_id, fold, role) with an external pool (row_id) added to every training part."""
    more = pool.select("row_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.lit("train"))
    return folds.unionByName(more)


def label_overlap(train: DataFrame, test: DataFrame, row_id: str, time: str, horizon_seconds: int) -> DataFrame:
    """(test_id, n_train): training rows less than the horizon away in time from each test row; horizon 0 gives none.

    Times are cut into cells of the horizon; a pair within it lies in the same
    or a neighbouring cell, so the range join is an equi-join on cells.
    """
    at = lambda df, i, x: df.where(F.col(time).isNotNull()).select(F.col(row_id).alias(i), F.unix_micros(time).alias(x))
    span = horizon_seconds * 1_000_000
    if span <= 0:
        return at(test, "test_id", "b").select("test_id", F.lit(0).cast("bigint").alias("n_train")).where("false")
    a = at(train, "train_id", "a").withColumn("cell", F.floor(F.col("a") / span))
    b = at(test, "test_id", "b").withColumn("cell", F.explode(F.array(*[F.floor(F.col("b") / span) + d for d in (-1, 0, 1)])))
    return b.join(a.groupBy("cell", "a").agg(F.count("*").alias("m")), "cell").where(F.abs(F.col("a") - F.col("b")) < span).groupBy("test_id").agg(F.sum("m").alias("n_train"))

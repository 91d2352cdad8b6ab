"""Samples that match target proportions by category.

Categories form a tree: a plan, its strata, and the labels of a stratum as
leaves. Quotas go top-down: every leaf gets its share of the sample (largest
remainders, never below min_rows). What a leaf cannot give is passed to its
siblings (other labels of the stratum) and, what they cannot give either, to
its cousins, in proportion to their quotas and never beyond their rows. At the
leaves the rows with the first dense ranks in a hashed permutation are drawn.

A stratum is compared without case and outer blanks, null equals null. A null
share, size or minimum counts as 0. Repeated rows are drawn as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Slices of the permutation; only the slice a quota ends in is ranked.
SLICES = 1024


def stratum_key(c: str) -> Column:
    blank = r"[\s\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]+"
    return F.lower(F.regexp_replace(F.regexp_replace(F.col(c), "^" + blank, ""), blank + "$", ""))


def needed() -> Column:
    share = F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0))).cast("bigint")
    return F.greatest(F.coalesce("min_rows", F.lit(0)), share)


def eligible_counts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with needed and eligible; rows are pre-aggregated to one count a split, stratum and label."""
    counts = (
        rows.select("split", stratum_key("stratum").alias("key"), "label").groupBy("split", "key", "label").agg(F.count("*").alias("eligible"))
    )
    t = targets.withColumn("key", stratum_key("stratum")).alias("t")
    c = counts.alias("c")
    same = F.expr("t.split <=> c.split and t.key <=> c.key and t.label <=> c.label")
    return t.join(c, same, "left").select("t.*", needed().alias("needed"), F.coalesce("c.eligible", F.lit(0)).alias("eligible"))


def _pass_on(quota: pd.Series, room: pd.Series, amount: int) -> pd.Series:
    """Hands ``amount`` to the entries with room in proportion to their quotas, by largest remainder."""
    given = pd.Series(0, index=quota.index)
    while amount > 0 and (room - given > 0).any():
        open_ = (room - given) > 0
        weight = quota.where(open_, 0) + open_ * 1e-9
        want = amount * weight / weight.sum()
        part = want.astype("int64").clip(upper=room - given)
        if part.sum() == 0:
            order = (want - want.astype("int64")).where(open_, -1).sort_values(ascending=False, kind="stable").index[: min(amount, int(open_.sum()))]
            part = part * 0
            part.loc[order] = 1
        given += part
        amount -= int(part.sum())
    return given


def allocate(plan: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one plan's leaves (as many rows as it has categories)."""
    plan = plan.assign(_key=plan.key.fillna("\x00"), _label=plan.label.fillna(-1)).sort_values(["_key", "_label"], kind="stable").reset_index(drop=True)
    size = int(plan.sample_size.fillna(0).max() or 0)
    ideal = plan.target_share.fillna(0.0) * size
    quota = ideal.astype("int64")
    rest = min(size, int(round(ideal.sum()))) - int(quota.sum())
    quota.loc[(ideal - quota).sort_values(ascending=False, kind="stable").index[: max(rest, 0)]] += 1
    floor = plan.min_rows.fillna(0).astype("int64")
    raised = quota.where(quota >= floor, floor)
    over = int(raised.sum()) - max(size, 0)
    spare = (raised - floor).clip(lower=0)
    if over > 0:
        raised = raised - _pass_on(spare, spare, min(over, int(spare.sum())))
    drawn = raised.clip(upper=plan.eligible)
    short = raised - drawn
    got = pd.Series(0, index=plan.index)
    for _, kin in plan.groupby("_key").groups.items():
        lack = int(short.loc[kin].sum())
        give = _pass_on(raised.loc[kin], (plan.eligible - drawn).loc[kin], lack)
        drawn.loc[kin] += give
        got.loc[kin] += give
    lack = max(min(int(raised.sum()), max(size, int(floor.sum()))) - int(drawn.sum()), 0)
    cousins = _pass_on(raised, plan.eligible - drawn, lack)
    drawn += cousins
    return plan.assign(quota=raised, short=short, from_siblings=got, from_cousins=cousins, drawn=drawn)


REPORT = (
    "plan_id string, split string, stratum string, key string, label int, needed bigint, eligible bigint, quota bigint, "
    "short bigint, from_siblings bigint, from_cousins bigint, drawn bigint"
)


def allocation(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: needed, eligible, quota, shortfall, what it took over, rows drawn."""
    fields = [f.split()[0] for f in REPORT.split(", ")]

    def run(plan: pd.DataFrame) -> pd.DataFrame:
        return allocate(plan)[fields]

    t = eligible_counts(rows, targets).select(
        F.col("plan_id").cast("string"), "split", "stratum", "key", F.col("label").cast("int"), "target_share", "sample_size", "min_rows", "needed", "eligible"
    )
    return t.groupBy("plan_id").applyInPandas(run, REPORT)


def unmet(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, stratum, label): targets with fewer eligible rows than needed."""
    return allocation(rows, targets).where("eligible < needed").select("plan_id", "stratum", "label")


def draw(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(plan_id, row_id, stratum, label, draw): the sample of every plan, with its rank at the leaf."""
    quotas = allocation(rows, targets).where("drawn > 0")
    order = F.xxhash64(F.lit(seed), "row_id")
    r = rows.select(
        "row_id", "split", stratum_key("stratum").alias("key"), "label", order.alias("place"), F.shiftrightunsigned(order, 54).cast("int").alias("slice")
    )
    leaf = W.partitionBy("split", "key", "label").orderBy("slice")
    before = (
        r.groupBy("split", "key", "label", "slice").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(leaf.rowsBetween(W.unboundedPreceding, -1)))
        .fillna(0, ["before"])
    )
    q, b, x = quotas.alias("q"), before.alias("b"), r.alias("r")
    parts = q.join(b, F.expr("q.split <=> b.split and q.key <=> b.key and q.label <=> b.label and b.before < q.drawn")).select(
        "q.plan_id", "q.stratum", "q.split", "q.key", "q.label", "q.drawn", "b.slice", "b.before"
    ).alias("p")
    taken = x.join(parts, F.expr("r.split <=> p.split and r.key <=> p.key and r.label <=> p.label and r.slice = p.slice"))
    rank = F.row_number().over(W.partitionBy("p.plan_id", "p.split", "p.key", "p.label", "p.slice").orderBy("place", "r.row_id"))
    return (
        taken.withColumn("draw", F.col("before") + rank).where("draw <= drawn")
        .select("p.plan_id", "r.row_id", "p.stratum", "p.label", "draw")
    )

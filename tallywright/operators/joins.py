"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], cell=None) -> DataFrame:
    """left with the values of the last row of right whose ``at`` is not after the row's own, of the same keys; nulls where there is none.

    Both sides go through one sort of (keys, at) instead of a range join. A
    ``cell`` (a function of the at column that rises with it) cuts hot keys:
    rows are sorted within cells, and the last row of the cells ahead, one row
    a cell, is carried in. Ties of right take the largest values; null keys or
    times on the left have no match.
    """
    cell = cell or (lambda c: F.lit(0))
    last = F.struct(*[F.col(v) for v in values])
    own = [c for c in left.columns]
    r = right.where(F.col(at).isNotNull())
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    r = r.groupBy(*keys, at).agg(F.max(last).alias("_v"))
    row = F.struct(*own).alias("_row")
    both = left.select(*keys, at, row, F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        r.select(*keys, at, F.lit(None).cast(left.select(row).schema["_row"].dataType).alias("_row"), "_v", F.lit(0).alias("_side"))
    ).withColumn("_cell", cell(F.col(at)))
    ends = both.where("_side = 0").groupBy(*keys, "_cell").agg(F.max_by("_v", at).alias("_end"))
    cells = both.select(*keys, "_cell").distinct().join(ends, [*keys, "_cell"], "left")
    ahead = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*keys, "_cell", F.last("_end", ignorenulls=True).over(ahead).alias("_carried"))
    inside = W.partitionBy(*keys, "_cell").orderBy(F.asc_nulls_first(at), "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_v", F.when(F.col(at).isNotNull(), F.last("_v", ignorenulls=True).over(inside))).where("_side = 1")
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_cell")]
    found = found.alias("f").join(cells.alias("c"), same, "left").select("f._row", F.when(F.col(f"f.{at}").isNotNull(), F.coalesce("f._v", "c._carried")).alias("_v"))
    return found.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def marginals(df: DataFrame, keys: list[str], measures: dict[str, object], every: bool = False) -> DataFrame:
    """Measures by all prefixes of the keys (or all subsets), with ``level``: how many keys, from the right for prefixes, are summed over as a bit mask."""
    g = df.cube(*keys) if every else df.rollup(*keys)
    return g.agg(*[c.alias(n) for n, c in measures.items()], F.grouping_id().cast("bigint").alias("level"))

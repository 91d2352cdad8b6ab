"""Leakage checks over one corpus table (row_id, split, text, label, group, time): rows each check would drop.

Every check gives (check_name, split, row_id). Null texts, splits and groups
are never affected; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from tallywright.session import cut

#: White space as Python's str.split sees it.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


@F.pandas_udf(StringType())
def nfc_lower(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower())


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def normal_text(c: str = "text"):
    return F.trim(F.regexp_replace(nfc_lower(F.col(c)), SPACE, " "))


@F.pandas_udf(StringType())
def _normal_digest(x: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = (t if t.isascii() else unicodedata.normalize("NFC", t)).lower()
        return hashlib.sha256(" ".join(t.split()).encode("utf-8", "surrogatepass")).hexdigest()

    return x.map(one)


def normal_hash(c: str = "text"):
    """SHA-256 of ``normal_text``, by one Arrow kernel."""
    return _normal_digest(F.col(c))


def keyed(rows: DataFrame, key) -> DataFrame:
    """(row_id, split, label, k) of rows with a split and a text, kept in the checkpoint folder: the key is computed once and read by both sides of a join."""
    r = rows.where("split is not null and text is not null")
    return cut(r.select("row_id", "split", F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label"), key.alias("k")))


def bare_form(c: str = "text"):
    """NFKC without control, format, surrogate, private and symbol characters, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.col(c)), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{So}]", ""), SPACE, " ")))


def _later_copies(rows: DataFrame, key, name: str, cap: int | None = None) -> DataFrame:
    """Rows behind the first of each (split, key); with cap, only the copies a capped neighbour list would reach.

    The uncapped form needs only each group's smallest id, which partial
    aggregation finds, so one hot text never meets in one task.
    """
    r = keyed(rows, key)
    if cap is None:
        first = r.groupBy("split", "k").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        out = r.join(first, ["split", "k"]).where("row_id > first")
    else:
        # the first ones of each part of a group hold the first ones of the group, so a hot text is ranked by many tasks
        part = F.pmod(F.xxhash64("row_id"), F.lit(64))
        some = r.withColumn("rn", F.row_number().over(W.partitionBy("split", "k", part).orderBy("row_id"))).where(F.col("rn") <= cap)
        out = some.withColumn("rn", F.row_number().over(W.partitionBy("split", "k").orderBy("row_id"))).where(F.col("rn").between(2, cap))
    return out.select(F.lit(name).alias("check_name"), "split", "row_id")


def exact_duplicates(rows: DataFrame, cap: int | None = None) -> DataFrame:
    return _later_copies(rows, normal_hash(), "ExactDuplicateCheck", cap)


def normalized_form(rows: DataFrame) -> DataFrame:
    return _later_copies(rows, F.sha2(bare_form(), 256), "NormalizedFormLeakageCheck")


def tokenization(rows: DataFrame, pattern: str = r"[a-z0-9']+") -> DataFrame:
    """Rows whose token sequence repeats an earlier one; the tokenizer is a pattern over lower case."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(f"({pattern})"), F.lit(1))
    return _later_copies(rows, F.sha2(F.concat_ws("\x01", tokens), 256), "TokenizationLeakageCheck")


def label_conflict(rows: DataFrame) -> DataFrame:
    """All rows of a text that stands with more than one label in any split."""
    r = keyed(rows, normal_hash())
    bad = r.groupBy("k").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("k")
    return r.join(bad, "k", "left_semi").select(F.lit("LabelConflictCheck").alias("check_name"), "split", "row_id")


def group_leak(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """All rows of a group that is in more than one split."""
    r = rows.where(F.col("split").isNotNull() & F.col(group).isNotNull())
    bad = r.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(group)
    return r.join(bad, group, "left_semi").select(F.lit("GroupLeakageCheck").alias("check_name"), "split", "row_id")


def temporal_leak(rows: DataFrame, time: str, order: list[str]) -> DataFrame:
    """Rows of a later split at or before the last time of the split ahead of it, where these overlap."""
    bound = rows.where(F.col("split").isin(order)).groupBy("split").agg(F.min(time).alias("low"), F.max(time).alias("high"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    b = bound.withColumn("at", place)
    pair = b.alias("e").join(b.alias("l"), F.expr("l.at = e.at + 1")).where("e.high > l.low").select(F.col("l.split").alias("split"), F.col("e.high").alias("until"))
    return rows.join(pair, "split").where(F.col(time) <= F.col("until")).select(F.lit("TemporalLeakageCheck").alias("check_name"), "split", "row_id")


def cross_split_exact(rows: DataFrame, train: str = "train") -> DataFrame:
    """Rows of other splits whose normal text is in train."""
    r = keyed(rows, normal_hash())
    return r.where(F.col("split") != train).join(r.where(F.col("split") == train).select("k").distinct(), "k", "left_semi").select(
        F.lit("CrossSplitExact").alias("check_name"), "split", "row_id"
    )


def report(*checks: DataFrame) -> DataFrame:
    """(check_name, split, n_affected, drop_indices)."""
    all_ = checks[0]
    for c in checks[1:]:
        all_ = all_.unionByName(c)
    return all_.groupBy("check_name", "split").agg(F.count_distinct("row_id").alias("n_affected"), F.sort_array(F.collect_set("row_id")).alias("drop_indices"))

"""Class balance, lengths, lexical association, obfuscation profile and distribution shift."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallywright.operators.leakage import nfkc
from tallywright.operators.metrics import PRIME, draws

TOKEN = r"([a-z0-9']+)"
#: Ranges of characters that do not show (fixed values).
INVISIBLE_RANGES = ((0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0xFE00, 0xFE0F), (0xE0000, 0xE007F), (0xE0100, 0xE01EF))
#: Words of which the rot13 form gives an encoded instruction away (fixed values).
MARKERS = ("ignore", "previous", "instructions", "instruction", "system", "prompt", "assistant", "command", "commands", "override", "disregard", "forget", "rules", "policy")
#: Characters that stand for letters in leet writing (fixed values).
LEET = "4315079862@!$+"
#: Least entropy in bits a character of a run of hex digits (16 or more) or base64 characters (20 or more) (fixed values).
HEX_ENTROPY, BASE64_ENTROPY = 3.5, 4.5
HEX_RUN, BASE64_RUN = "[0-9A-Fa-f]{16,}", "[A-Za-z0-9+/=]{20,}"
INVISIBLE = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in INVISIBLE_RANGES) + "]"


def class_balance(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    g = df.where(F.col(label).isin(0, 1)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label)).cast("bigint").alias("pos"))
    return g.select(
        *keys, "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), (100.0 * F.col("pos") / F.col("n")).alias("pos_pct"),
        F.when(F.col("pos") > 0, (F.col("n") - F.col("pos")) / F.col("pos")).alias("neg_pos_ratio"), ((F.col("pos") == 0) | (F.col("pos") == F.col("n"))).alias("single_class"),
    )


def length_quantiles(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """p50, p95 and maximum of characters and of blank-separated words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    d = df.where(F.col(text).isNotNull()).select(*keys, F.length(text).alias("c"), words.alias("w"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.95)))
    g = d.groupBy(*keys).agg(q("c").alias("qc"), F.max("c").alias("char_max"), q("w").alias("qw"), F.max("w").alias("word_max"))
    return g.select(*keys, F.col("qc")[0].alias("char_p50"), F.col("qc")[1].alias("char_p95"), "char_max", F.col("qw")[0].alias("word_p50"), F.col("qw")[1].alias("word_p95"), "word_max")


def log_odds(df: DataFrame, text: str, side: Column, prior_scale: float = 0.01, min_count: int = 5) -> DataFrame:
    """(token, count_a, count_b, delta, z, pmi): weighted log odds of tokens of side (true = a) with an informative prior, and smoothed information of token and side in bits.

    Totals are over all tokens, whatever min_count; they come from the token
    table, one row a token, by one aggregate. No rows if a side has no tokens.
    """
    t = df.where(side.isNotNull()).select(side.alias("a"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))).alias("token"))
    c = t.groupBy("token").agg(F.count_if("a").alias("count_a"), F.count_if(~F.col("a")).alias("count_b"))
    n = c.agg(F.sum("count_a").alias("na"), F.sum("count_b").alias("nb"))
    x = c.where(F.col("count_a") + F.col("count_b") >= min_count).join(F.broadcast(n.where("na > 0 and nb > 0"))).withColumn("prior", prior_scale * (F.col("count_a") + F.col("count_b")))
    pool = F.col("na") + F.col("nb")
    a0 = prior_scale * pool
    odds = lambda k, m: F.log((F.col(k) + F.col("prior")) / (F.col(m) + a0 - F.col(k) - F.col("prior")))
    ok = (F.col("na") + a0 - F.col("count_a") - F.col("prior") > 0) & (F.col("nb") + a0 - F.col("count_b") - F.col("prior") > 0)
    x = x.where(ok).withColumn("delta", odds("count_a", "na") - odds("count_b", "nb"))
    sd = F.sqrt(1 / (F.col("count_a") + F.col("prior")) + 1 / (F.col("count_b") + F.col("prior")))
    pmi = F.log2(((F.col("count_a") + F.col("prior")) / (F.col("na") + a0)) / ((F.col("count_a") + F.col("count_b") + 2 * F.col("prior")) / (pool + 2 * a0)))
    return x.select("token", "count_a", "count_b", "delta", (F.col("delta") / sd).alias("z"), pmi.alias("pmi"))


def leaning(association: DataFrame, k: int) -> DataFrame:
    """(side, rank, token, z): the k tokens that lean most to either side; ties by token."""
    top = lambda side, order: association.orderBy(order, "token").limit(k).select(F.lit(side).alias("side"), "token", "z")
    both = top("a", F.desc("z")).unionByName(top("b", F.asc("z")))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs("z")), "token")))


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    n = F.length(c).cast("double")
    kinds = F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    share = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n
    return F.aggregate(F.transform(kinds, share), F.lit(0.0), lambda t, p: t - p * F.log2(p))


def high_entropy_run(t: Column) -> Column:
    """Whether a run of hex digits or base64 characters is too even for words."""
    runs = lambda pattern, least: F.exists(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda x: entropy(x) >= least)
    return runs(HEX_RUN, HEX_ENTROPY) | runs(BASE64_RUN, BASE64_ENTROPY)


def obfuscation(df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """One projection: invisible characters, NFKC change and its difference in length, rot13 words, leet tokens, even runs of hex digits or base64 characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    leet = lambda x: F.length(x).between(3, 12) & x.rlike("[A-Za-z]") & (F.length(F.regexp_replace(x, f"[^{LEET}]", "")) >= 2)
    d = df.select(row_id, t.alias("t"), nfkc(t).alias("n"))
    t = F.col("t")
    tokens = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9@$!+]+)"), F.lit(1))
    return d.select(
        row_id, F.regexp_count(t, F.lit(INVISIBLE)).alias("invisible"), (F.col("n") != t).alias("nfkc_changed"), F.abs(F.length("n") - F.length(t)).alias("nfkc_delta"),
        F.lower(t).rlike("|".join(codecs.encode(m, "rot_13") for m in MARKERS)).alias("rot13"), F.size(F.filter(tokens, leet)).alias("leet_tokens"), F.size(tokens).alias("tokens"),
        high_entropy_run(t).alias("entropy_run"),
    )


def obfuscation_summary(df: DataFrame, keys: list[str], row_id: str, text: str = "text") -> DataFrame:
    """Counts, sums and rates of ``obfuscation`` by key; rates of nothing are 0. Null texts are left out."""
    d = df.where(F.col(text).isNotNull())
    x = obfuscation(d.select(F.struct(*keys, row_id).alias("_id"), text), "_id", text)
    n = F.count("*")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    parts = {"invisible_chars": F.col("invisible") > 0, "nfkc_change": F.col("nfkc_changed"), "nfkc_length_delta": F.col("nfkc_delta") > 0, "high_entropy_run": F.col("entropy_run"), "rot13_marker": F.col("rot13")}
    g = x.groupBy(*[F.col(f"_id.{k}").alias(k) for k in keys]).agg(
        n.alias("n_texts"), *[F.count_if(c).alias(f"n_with_{k}") for k, c in parts.items()], F.sum("invisible").alias("total_invisible_chars"), F.sum("nfkc_delta").alias("total_nfkc_char_delta"),
        F.sum("leet_tokens").alias("n_leeted_tokens"), F.sum("tokens").alias("n_total_alnum_tokens"),
    )
    return g.withColumns({
        "invisible_char_rate": rate(F.col("n_with_invisible_chars"), F.col("n_texts")), "nfkc_change_rate": rate(F.col("n_with_nfkc_change"), F.col("n_texts")), "high_entropy_run_rate": rate(F.col("n_with_high_entropy_run"), F.col("n_texts")),
        "rot13_marker_rate": rate(F.col("n_with_rot13_marker"), F.col("n_texts")), "leetspeak_token_rate": rate(F.col("n_leeted_tokens"), F.col("n_total_alnum_tokens")),
    })


def knn_purity(df: DataFrame, row_id: str, vector: str, domain: str, k: int = 5) -> DataFrame:
    """(mean_purity, k, n_a, n_b): share of every row's k nearest other rows (Euclidean, ties by id) that are of its domain (0 or 1).

    Every row is a query, in blocks against all rows: work grows with the square of the rows.
    """
    from tallywright.operators.similarity import nearest

    d = df.where(F.col(domain).isin(0, 1) & F.col(vector).isNotNull()).select(F.col(row_id).alias("i"), F.col(vector).alias("v"), F.col(domain).cast("int").alias("d"))
    near = nearest(d, "i", "v", lambda c: c.isNotNull(), k)
    dom = d.select("i", "d")
    x = near.join(dom.select(F.col("i").alias("query_id"), "d"), "query_id").join(dom.select(F.col("i").alias("ref_id"), F.col("d").alias("other")), "ref_id")
    n = dom.agg(F.count_if(F.col("d") == 0).alias("n_a"), F.count_if(F.col("d") == 1).alias("n_b"))
    return x.agg(F.avg((F.col("d") == F.col("other")).cast("double")).alias("mean_purity")).join(F.broadcast(n)).select("mean_purity", F.least(F.lit(k).cast("bigint"), F.col("n_a") + F.col("n_b") - 1).alias("k"), "n_a", "n_b")


def maximum_mean_discrepancy(df: DataFrame, row_id: str, vector: str, domain: str, bandwidth: float, permutations: int = 1000, seed: int = 5) -> DataFrame:
    """(mmd_squared, p_value, n_permutations, n_a, n_b): unbiased squared discrepancy of two domains (0 and 1) under an RBF kernel, and its permutation p.

    All pairs of rows count, a broadcast block of rows against all rows at a
    time: work grows with the square of the rows. A permutation draws every
    row's domain with the domains' odds, so its sizes vary a little; each is
    scaled by its own. Fewer than two rows of a domain give nulls.
    """
    from tallywright.operators.similarity import QUERY_BLOCK

    if not bandwidth > 0 or bandwidth == float("inf"):
        raise ValueError(f"bandwidth must be finite and above 0, not {bandwidth}")
    d = df.where(F.col(domain).isin(0, 1) & F.col(vector).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"), F.col(domain).cast("int").alias("d")
    )
    n = d.agg(F.count_if(F.col("d") == 0).alias("a"), F.count("*").alias("n")).first()
    odds, spark = n["a"] / max(n["n"], 1), df.sparkSession

    def labels(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.column_stack([own == 0, draws(ids, np.arange(1, permutations + 1), seed) < odds * PRIME]).astype(np.float64)

    def one_block(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, vectors, own))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, other, own = shared.value
            theirs, square = labels(ids, own), (other**2).sum(1)
            for b in batches:
                for lo in range(0, len(b), 512):
                    x = b.iloc[lo : lo + 512]
                    v = np.stack(x["v"].to_numpy())
                    k = np.exp(-np.maximum((v**2).sum(1)[:, None] + square[None, :] - 2 * v @ other.T, 0) / (2 * bandwidth**2))
                    k[x["i"].to_numpy()[:, None] == ids[None, :]] = 0  # a row with itself
                    mine = labels(x["i"].to_numpy(), x["d"].to_numpy())
                    yield pd.DataFrame({"within": [(mine * (k @ theirs)).sum(0).tolist()], "row": [(mine * k.sum(1)[:, None]).sum(0).tolist()], "size": [mine.sum(0).tolist()], "all": [k.sum()], "first": [False], "m": [len(x)]})

        return d.mapInPandas(run, "within array<double>, row array<double>, size array<double>, all double, first boolean, m bigint")

    parts, block, blocks = None, [], 0
    for r in d.orderBy("i").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part = one_block(np.array([x["i"] for x in block]), np.array([x["v"] for x in block]), np.array([x["d"] for x in block]))
            parts, block, blocks = part if parts is None else parts.unionByName(part), [], blocks + 1
    if block:
        part = one_block(np.array([x["i"] for x in block]), np.array([x["v"] for x in block]), np.array([x["d"] for x in block]))
        parts, blocks = part if parts is None else parts.unionByName(part), blocks + 1
    schema = "mmd_squared double, p_value double, n_permutations int, n_a bigint, n_b bigint"
    if parts is None or n["a"] < 2 or n["n"] - n["a"] < 2:
        return spark.createDataFrame([(None, None, permutations, n["a"], n["n"] - n["a"])], schema)
    x = parts.select(F.posexplode(F.arrays_zip("within", "row", "size")).alias("rep", "v"), "all").groupBy("rep").agg(F.sum("v.within").alias("xx"), F.sum("v.row").alias("x"), (F.sum("v.size") / blocks).alias("m"), F.sum("all").alias("t"))
    m, o = F.col("m"), n["n"] - F.col("m")
    x = x.select("rep", F.when((m > 1) & (o > 1), F.col("xx") / (m * (m - 1)) + (F.col("t") - 2 * F.col("x") + F.col("xx")) / (o * (o - 1)) - 2 * (F.col("x") - F.col("xx")) / (m * o)).alias("v"))
    g = x.agg(F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("seen"), F.collect_list(F.when(F.col("rep") > 0, F.col("v"))).alias("null"))
    p = (F.size(F.filter("null", lambda v: v >= F.col("seen"))) + 1.0) / (permutations + 1.0)
    return g.select(F.col("seen").alias("mmd_squared"), p.alias("p_value"), F.lit(permutations).alias("n_permutations"), F.lit(n["a"]).cast("bigint").alias("n_a"), F.lit(n["n"] - n["a"]).cast("bigint").alias("n_b"))


def linear_mmd(df: DataFrame, vector: str, domain: str) -> DataFrame:
    """(mmd2): squared distance of the two domains' mean vectors (linear-kernel discrepancy), by one aggregate; domain is 0/1."""
    e = df.where(F.col(domain).isin(0, 1)).select(F.col(domain).alias("d"), F.posexplode(vector).alias("i", "x"))
    m = e.groupBy("i").agg(F.avg(F.when(F.col("d") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("d") == 1, F.col("x"))).alias("b"))
    return m.agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mmd2"))

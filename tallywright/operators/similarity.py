"""Similarity joins, top-k search and greedy deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallywright.functions.text import chunks, mix64, shingle_hashes
from tallywright.session import cut


def word_ngrams(c: str, n: int):
    t = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9']+)"), F.lit(1))

    def of(t):
        grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>")))

    # the words as a lambda's variable, else they are extracted again for every gram
    return F.array_distinct(F.when(t.isNotNull(), F.transform(F.array(t), of)[0]).otherwise(F.array().cast("array<string>")))


def jaccard_pairs(df: DataFrame, row_id: str, grams, threshold: float) -> DataFrame:
    """(a, b, sim), a < b: all pairs of gram sets overlapping by the threshold or more.

    Prefix filter: of each set only its rarest n - ceil(t n) + 1 grams are
    joined, sizes must be within the threshold, and each pair is verified on
    the whole sets. Rows without grams have no partners.
    """
    s = cut(df.select(F.col(row_id).alias("id"), grams.alias("g")).where(F.size("g") > 0))
    e = s.select("id", F.size("g").alias("n"), F.explode("g").alias("x"))
    often = e.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    # grams of one row only meet nothing; they take the first places of a row's order
    shared = e.join(often, "x")
    listed = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("l"))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("l"))
    p = listed.where(room > 0).select("id", "n", F.explode(F.slice("l", F.lit(1), room.cast("int"))).alias("e")).select("id", "n", "e.x")
    near = F.expr(f"a.x = b.x and a.id < b.id and a.n >= {threshold} * b.n - 1e-9 and b.n >= {threshold} * a.n - 1e-9")
    c = p.alias("a").join(p.alias("b"), near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    both = c.join(s.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(s.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    k = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (k / (F.size("ga") + F.size("gb") - k)).alias("sim")).where(F.col("sim") >= threshold)


def shingle_sets(df: DataFrame, row_id: str, text: str, k: int = 5) -> DataFrame:
    """(id, g, key): hashes of the sets of k-word shingles of rows with words, and a hash of the whole set; one narrow Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                row, h = shingle_hashes(texts[lo:hi], k)
                n = np.bincount(row, minlength=hi - lo)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                start = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    key = mix64(np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), start[some]) + n[some].astype(np.uint64))
                g = pa.ListArray.from_arrays(pa.array(np.append(start[some], len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(some)), g, pa.array(key.view(np.int64))], ["id", "g", "key"])

    kind = dict(df.dtypes)[row_id]
    return df.where(F.col(row_id).isNotNull() & (F.length(text) > 0)).select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, g array<bigint>, key bigint")


def copy_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of all rows with grams, and (id, g) of one row a class, from ``shingle_sets``.

    Rows of the same gram set are a class, named by its smallest id. Joins run
    over classes, so the pairs don't grow with the square of the copies.
    """
    s = cut(sets)
    named = s.groupBy("key").agg(F.min("id").alias("class_id"))
    members = cut(s.select("id", "key").join(named, "key").select("id", "class_id"))
    return members, cut(s.select("id", "g").join(members.where("id = class_id").select("id"), "id", "left_semi").dropDuplicates(["id"]))


def corpus_dedup(df: DataFrame, row_id: str, text: str, threshold: float, k: int = 5) -> DataFrame:
    """(id, class_id, kept, link): one row a row with grams; greedy_kept over all pairs of the threshold or more, copies included.

    link is the smallest kept row that drops the row. The rows of a class have
    the same partners, so only its first can be kept.
    """
    members, one = copy_classes(shingle_sets(df, row_id, text, k))
    edges = cut(jaccard_pairs(one, "id", F.col("g"), threshold).select("a", "b"))
    kept = cut(greedy_kept(one.select("id"), edges))
    by = edges.join(kept.where("kept").select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("by"))
    first = kept.join(by, "id", "left").select(F.col("id").alias("class_id"), F.col("kept").alias("_k"), "by")
    own = F.col("id") == F.col("class_id")
    return members.join(first, "class_id").select("id", "class_id", (own & F.col("_k")).alias("kept"), F.when(~F.col("_k"), F.col("by")).when(~own, F.col("class_id")).alias("link"))


def tfidf(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, x, w): l2-normalised weights of words of two or more characters, smooth idf."""
    t = df.select(F.col(row_id).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))).alias("x"))
    n = df.select(F.count("*").alias("rows"))
    tf = t.groupBy("id", "x").agg(F.count("*").alias("tf"))
    d = tf.groupBy("x").agg(F.count("*").alias("df")).join(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1)
    v = tf.join(d, "x").withColumn("v", F.col("tf") * F.col("idf"))
    return v.withColumn("w", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("id")))).select("id", "x", "w")


def tfidf_top(df: DataFrame, row_id: str, text: str, queries, k: int) -> DataFrame:
    """(query_id, ref_id, sim, rank): the k most similar rows of every query row by exact cosine."""
    w = cut(tfidf(df, row_id, text))
    q = w.where(queries(F.col("id"))).select(F.col("id").alias("query_id"), "x", F.col("w").alias("wq"))
    s = q.join(w, "x").where("id <> query_id").groupBy("query_id", F.col("id").alias("ref_id")).agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("sim"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id"))).where(F.col("rank") <= k)


#: Query vectors compared in one pass (their matrix is broadcast).
QUERY_BLOCK = 4096


def cosine_top(df: DataFrame, row_id: str, vector: str, queries, k: int) -> DataFrame:
    """(query_id, ref_id, sim, rank): exact cosine top k of a stated query set against all rows; a zero vector has similarity 0."""
    return _top(df, row_id, vector, queries, k, True)


def nearest(df: DataFrame, row_id: str, vector: str, queries, k: int) -> DataFrame:
    """(query_id, ref_id, sim, rank): the k rows nearest to each row of a stated query set; sim is the squared Euclidean distance, negative."""
    return _top(df, row_id, vector, queries, k, False)


def _top(df: DataFrame, row_id: str, vector: str, queries, k: int, cosine: bool) -> DataFrame:
    """Blocks of queries against all rows. Every task keeps its own k best of a query before anything is shuffled. Null vectors are left out."""
    d = df.where(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = []
    block: list = []

    def unit(m: np.ndarray) -> np.ndarray:
        if not cosine:
            return m
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    def search(rows: list) -> DataFrame:
        ids, m = np.array([r["id"] for r in rows]), unit(np.array([r["v"] for r in rows]))
        shared = df.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, qm = shared.value
            for b in batches:
                if not len(b):
                    continue
                m = unit(np.stack(b["v"].to_numpy()))
                sim = qm @ m.T
                if not cosine:
                    sim = 2 * sim - (qm**2).sum(1)[:, None] - (m**2).sum(1)[None, :]
                sim = np.round(sim, 9)
                ref = b["id"].to_numpy()
                for i in range(len(qid)):
                    ok = np.flatnonzero(ref != qid[i])
                    best = ok[np.lexsort((ref[ok], -sim[i][ok]))[:k]]
                    yield pd.DataFrame({"query_id": qid[i], "ref_id": ref[best], "sim": sim[i][best]})

        return d.mapInPandas(run, "query_id bigint, ref_id bigint, sim double")

    for r in d.where(queries(F.col("id"))).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            parts.append(search(block))
            block = []
    if block or not parts:
        parts.append(search(block) if block else d.select(F.col("id").alias("query_id"), F.col("id").alias("ref_id"), F.lit(0.0).alias("sim")).where("false"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id"))).where(F.col("rank") <= k)


def minhash_pairs(df: DataFrame, row_id: str, grams, threshold: float, perms: int = 128, bands: int = 32) -> DataFrame:
    """(a, b, sim): candidates of MinHash bands, re-scored exactly; approximate recall."""
    s = df.select(F.col(row_id).alias("id"), grams.alias("g")).where(F.size("g") > 0)
    seeds = mix64(np.arange(1, perms + 1).astype(np.uint64))

    r = perms // bands

    def band_keys(hashes: np.ndarray) -> np.ndarray:
        low = mix64(np.asarray(hashes).view(np.uint64)[:, None] ^ seeds[None, :]).min(axis=0)[: bands * r].reshape(bands, r)
        key = np.arange(1, bands + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(r):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
        return key.view(np.int64)

    @F.pandas_udf("array<bigint>")
    def keys(hashes: pd.Series) -> pd.Series:
        return hashes.map(band_keys)

    e = s.select("id", F.transform("g", lambda x: F.xxhash64(x)).alias("h")).select("id", F.explode(keys("h")).alias("key"))
    c = e.alias("a").join(e.alias("b"), F.expr("a.key = b.key and a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    both = c.join(s.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(s.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    k = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (k / (F.size("ga") + F.size("gb") - k)).alias("sim")).where(F.col("sim") >= threshold)


def greedy_kept(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept): going up the ids, a row is kept unless a kept smaller neighbour (edge a < b) drops it.

    Solved in rounds: rows without undecided or kept smaller neighbours are
    kept, their larger neighbours dropped, until all are decided.
    """
    e = cut(edges.select("a", "b").distinct())
    dropped = None
    left = e
    while not left.isEmpty():
        blocked = left.select(F.col("b").alias("a")).distinct()
        sure = left.join(blocked, "a", "left_anti")
        gone = cut(sure.select(F.col("b").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        x = left.join(gone, left.a == gone.id, "left_anti")
        left = cut(x.join(gone, x.b == gone.id, "left_anti"))
    if dropped is None:
        return ids.select("id", F.lit(True).alias("kept"))
    d = dropped.distinct().withColumn("_d", F.lit(True))
    return ids.join(d, "id", "left").select("id", F.col("_d").isNull().alias("kept"))


def cross_pairs(one: DataFrame, info: DataFrame, threshold: float, train: str = "train") -> DataFrame:
    """(a, b, sim, relation): pairs of one (id, g) of which one row is of the training split; info: id, split, source, label."""
    pairs = jaccard_pairs(one, "id", F.col("g"), threshold)
    side = lambda x: info.select(F.col("id").alias(x), F.col("split").alias("split_" + x))
    crossing = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("split_a") == train) != (F.col("split_b") == train))
    return relations(crossing.select("a", "b", "sim"), info)


def cross_kept(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ids without an edge (a = the row)."""
    return ids.join(edges.select(F.col("a").alias("id")).distinct(), "id", "left_anti")


def relations(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges with how sources and labels of their ends relate; rows: id, source, label."""
    l, r = (rows.select(F.col("id").alias(s), F.col("source").alias("s" + s), F.col("label").alias("l" + s)) for s in ("a", "b"))
    same = lambda x: F.when(F.col(f"{x}a").isNull() | F.col(f"{x}b").isNull(), "unknown").when(F.col(f"{x}a") == F.col(f"{x}b"), "same").otherwise("cross")
    return edges.join(l, "a").join(r, "b").select("a", "b", "sim", F.concat(same("s"), F.lit("_source_"), same("l"), F.lit("_label")).alias("relation"))

"""Packing documents into containers of fixed capacity.

Documents larger than the capacity are cut into full containers and a rest.
Items are spread by hash over bundles of about BUNDLE containers, which are
packed independently. A bundle is packed by Karmarkar-Karp multiway
differencing: every item is a partial partition into k windows; the two with
the largest spread are merged, largest sum onto smallest, until one is left. k
starts at the least number possible. The windows are near equal but those of
few items may exceed the capacity; each such window then exchanges one of its
items for a smaller one (or none) of a window with room for the difference.
Where that leaves a window too large, k rises by one and the differencing is
done again, until all fit; there is no other way of packing.

Null texts are not packed; an empty text has size 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUNDLE, BUNDLE_ITEMS = 256, 8192


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items of each of at most k windows by multiway differencing."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k  # windows in which both have something
        if over <= 0:
            merged = a + b
        else:
            # descending both: a's last `over` meet b's last `over` in opposite order
            x, y = a[len(a) - over :], b[len(b) - over :]
            merged = a[: len(a) - over] + b[: len(b) - over] + [(p[0] + q[0], (p[1], q[1])) for p, q in zip(x, reversed(y))]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], serial, merged))
        serial += 1
    windows = []
    for _, members in heap[0][2] if heap else []:
        out, todo = [], [members]
        while todo:
            m = todo.pop()
            if isinstance(m, tuple):
                todo.extend(m)
            else:
                out.append(m)
        windows.append(out)
    return windows


def exchange(sizes: list[int], windows: list[list[int]], capacity: int) -> bool:
    """Relieves windows beyond the capacity by exchanges with windows that have room, in place; whether all fit then.

    An item a of a window beyond the capacity by x goes to a window of room r
    for an item b with x <= a - b <= r, or for none (b = 0): the pair that
    leaves least room.
    """
    k = len(windows)
    # an empty item a window stands for giving nothing back
    size = np.array([*sizes, *[0] * k], np.int64)
    home = np.zeros(len(size), np.int64)
    for w, members in enumerate(windows):
        home[members] = w
    home[len(sizes) :] = np.arange(k)
    load = np.bincount(home, size, minlength=k).astype(np.int64)
    for w in np.argsort(-load, kind="stable").tolist():
        excess = load[w] - capacity
        if excess <= 0:
            break
        best, room = None, capacity - load
        for a in windows[w]:
            given = size[a] - size
            ok = np.flatnonzero((given >= excess) & (given <= room[home]))
            if len(ok):
                left = room[home[ok]] - given[ok]
                at = int(np.argmin(left))
                if best is None or left[at] < best[0]:
                    best = (left[at], a, int(ok[at]))
        if best is None:
            return False
        _, a, b = best
        u = int(home[b])
        windows[w].remove(a)
        windows[u].append(a)
        home[a] = u
        if b < len(sizes):
            windows[u].remove(b)
            windows[w].append(b)
            home[b] = w
        load[w] -= size[a] - size[b]
        load[u] += size[a] - size[b]
    return True


def pack_bundle(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of one bundle of items, none larger than the capacity (no item may be)."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = difference(sizes, k)
        if exchange(sizes, windows, capacity):
            return [w for w in windows if w]
        k += 1


def pieces(documents: DataFrame, plans: DataFrame) -> DataFrame:
    """(pack_id, capacity, doc_id, piece, pieces, size): what is to be packed in each plan's scope."""
    docs = documents.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length("text").cast("bigint") + 1).alias("whole"),
        F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("of")), F.struct(F.lit(False).alias("every"), F.col("source").alias("of")))).alias("scope"),
    )
    p = plans.where("capacity > 0").select(
        "pack_id", F.col("capacity").cast("bigint").alias("capacity"), F.col("source").isNull().alias("every"), F.coalesce("source", F.lit("")).alias("of")
    )
    fit = docs.select("doc_id", "whole", "scope.every", "scope.of").join(p, ["every", "of"])
    count = F.ceil(F.col("whole") / F.col("capacity")).cast("int")
    return fit.withColumn("pieces", count).select(
        "pack_id", "capacity", "doc_id", "pieces", "whole", F.explode(F.sequence(F.lit(1), "pieces")).alias("piece")
    ).withColumn("size", F.when(F.col("piece") < F.col("pieces"), F.col("capacity")).otherwise(F.col("whole") - (F.col("pieces") - 1) * F.col("capacity"))).drop("whole")


def pack(documents: DataFrame, plans: DataFrame) -> DataFrame:
    """(pack_id, container, doc_id, piece, pieces, size, capacity): every piece with its container.

    Full pieces of a cut document are containers by themselves.
    """
    all_ = pieces(documents, plans)
    totals = all_.where("size < capacity").groupBy("pack_id").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    open_ = all_.where("size < capacity").join(totals, "pack_id")
    bundles = F.greatest(F.ceil(F.col("total") / (F.col("capacity") * BUNDLE)), F.ceil(F.col("n") / BUNDLE_ITEMS), F.lit(1)).cast("bigint")
    open_ = open_.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "piece"), bundles))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where = pd.Series(0, index=pdf.index)
        for w, members in enumerate(pack_bundle(pdf["size"].tolist(), int(pdf["capacity"].iloc[0]))):
            where.iloc[members] = w
        pdf["container"] = pdf["bundle"].astype(str) + "-" + where.astype(str)
        return pdf[["pack_id", "container", "doc_id", "piece", "pieces", "size", "capacity"]]

    schema = "pack_id string, container string, doc_id bigint, piece int, pieces int, size bigint, capacity bigint"
    # a set number of partitions: bundles are small in bytes but long in work, so they must not be put together
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * documents.sparkSession.sparkContext.defaultParallelism)
    packed = open_.repartition(parts, "pack_id", "bundle").select("pack_id", "bundle", "doc_id", "piece", "pieces", "size", "capacity").groupBy("pack_id", "bundle").applyInPandas(run, schema)
    full = all_.where("size = capacity").select(
        "pack_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "pieces", "size", "capacity"
    )
    return packed.unionByName(full)


def oversized(documents: DataFrame, plans: DataFrame) -> DataFrame:
    """(pack_id, doc_id): documents that the packing had to split."""
    return pack(documents, plans).where("pieces > 1").select("pack_id", "doc_id").distinct()


def fill(documents: DataFrame, plans: DataFrame) -> DataFrame:
    """(pack_id, containers, used, unused, least): containers of each plan, their tokens, and the least number possible."""
    per = pack(documents, plans).groupBy("pack_id", "container").agg(F.sum("size").alias("used"), F.max("capacity").alias("capacity"))
    return per.groupBy("pack_id").agg(
        F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum(F.col("capacity") - F.col("used")).alias("unused"),
        F.ceil(F.sum("used") / F.max("capacity")).alias("least"),
    )


def validity(documents: DataFrame, plans: DataFrame) -> DataFrame:
    """(pack_id, documents, used, split, overfull, needless, incomplete): what was packed, and violations (all 0): containers beyond the capacity, documents split that fit, documents whose pieces don't add up."""
    packed = pack(documents, plans)
    per_doc = packed.groupBy("pack_id", "doc_id").agg(
        F.sum("size").alias("size"), F.max("capacity").alias("capacity"), F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.count_distinct("piece").alias("kinds")
    )
    docs = per_doc.groupBy("pack_id").agg(
        F.count("*").alias("documents"), F.sum("size").alias("used"), F.count_if(F.expr("n > 1")).alias("split"), F.count_if(F.expr("n > 1 and size <= capacity")).alias("needless"),
        F.count_if(F.expr("n <> pieces or kinds <> pieces")).alias("incomplete"),
    )
    full = packed.groupBy("pack_id", "container").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity")).groupBy("pack_id").agg(F.count_if(F.expr("size > capacity")).alias("overfull"))
    return docs.join(full, "pack_id").select("pack_id", "documents", "used", "split", "overfull", "needless", "incomplete")

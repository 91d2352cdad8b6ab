"""Near-duplicate rows: an exact overlap join by a multi-index Hamming join.

A row's signature is the bit vector of its word set under a 64-bit hash, kept
sparse as the sorted positions of its set bits. Two sets that overlap by t
differ in at most ``allowed(na, nb, t)`` bits, so the overlap join is a Hamming
join under a known distance, and nothing is lost by going through signatures:

* The bit positions are split into m chunks by hash. If two signatures differ
  in at most D bits and the budgets T_i satisfy sum(T_i + 1) = D + 1, then by
  pigeonhole some chunk i holds at most T_i of the differences.
* Within such a chunk the allowed errors are enumerated: of either side's set
  bits, rarest first, the d-th rarest one in common stands among the first T_i + d.
  A rare bit is an index key by itself, a frequent one only together with its
  possible successors, until the key is expected in few rows. Chunks too thin
  to have so many bits in common get keys of their own.
* Rows meeting under a key are compared by size and by a 64-bit folded
  signature (its Hamming distance is a lower bound); what passes is checked on
  the whole word sets.

Rows of a key with very many rows (a stock phrase) are indexed again, up to
twice, under that key joined with longer keys over other chunks. A key that is
still large then is cut into parts of at most HOT_ROWS rows, and every two parts
meet in a group of their own, so many tasks share it. Groups are streamed by
size, holding only the rows whose size a later row may match. Copies of one word
set enter as one class a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.text import mix64
from tallywright.llm.wordsets import Frequency, Sets, allowed, bucket, current_thresholds, i64, reach, u64
from tallywright.operators.graph import components
from tallywright.session import broadcast_if_small, cut

#: Size regimes of word sets; pairs whose smaller side lies in a regime meet there.
REGIMES = (0, 12, 32, 1 << 40)
#: Differences a chunk should take.
ERRORS_PER_CHUNK = 3
#: A key is lengthened while its bits, taken as independent, would be found in more rows than this.
KEY_ROWS = 128
#: Most bits in a key.
MAX_DEPTH = 5


def chunk_count(regime: int, t: float, mean_words: float) -> int:
    top = max(REGIMES[regime + 1] / t if regime < len(REGIMES) - 2 else 0, 0) or max(mean_words * 1.1, 40)
    return max(1, min(8, round((int(reach(np.array([top]), t)[0]) + 1) / ERRORS_PER_CHUNK)))


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        p = np.asarray(p)
        out = mix64(np.atleast_1d(out ^ (p if p.dtype == np.uint64 else p.astype(np.uint64)))) * np.uint64(0x9E3779B97F4A7C15)
    return out


def index_keys(sets: Sets, take: np.ndarray, t: float, salt: int, freq: Frequency, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the rows in take (a mask) under threshold t; level: how often the keys are to be lengthened."""
    rows_out, keys_out = [], []
    enough = np.log(max(freq.rows / KEY_ROWS * 64.0**level, 1.0))

    def emit(rows: np.ndarray, keys: np.ndarray) -> None:
        rows_out.append(rows)
        keys_out.append(keys)

    with np.errstate(over="ignore"):
        for regime in range(len(REGIMES) - 1):
            low, high = REGIMES[regime], REGIMES[regime + 1] / t
            mine = take & (sets.n >= max(low, 1)) & (sets.n <= high)
            if not mine.any():
                continue
            m = chunk_count(regime, t, freq.mean_words)
            word = np.flatnonzero(mine[sets.row])
            row, h = sets.row[word], sets.h[word]
            chunk = ((h >> np.uint64(8 + 12 * level)) % np.uint64(m)).astype(np.int64)
            nats = freq.nats[bucket(h)]
            # by row, chunk, rarest first, hash: one integer key for the first three
            order = np.lexsort((h, -nats, row * m + chunk))
            row, h, chunk = row[order], h[order], chunk[order]
            cell = row * m + chunk
            cells = np.flatnonzero(mine)[:, None] * m + np.arange(m)[None, :]
            size = np.bincount(cell, minlength=len(sets.n) * m)
            start = np.cumsum(size) - size
            place = np.arange(len(cell)) - start[cell]
            units = reach(sets.n, t) + 1
            budget = units[:, None] // m + (np.arange(m)[None, :] < (units % m)[:, None])
            budget = (budget - 1).reshape(-1)  # T_i of each cell; -1: the chunk is left out
            base = _hash(np.uint64(salt * 8 + regime), np.arange(m).astype(np.uint64))
            thin = cells.reshape(-1)
            thin = thin[(budget[thin] >= 0) & (size[thin] <= budget[thin])]
            emit(thin // m, _hash(base[thin % m], np.uint64(1)))
            # the d-th rarest bit in common has place <= T_i + d - 1 on either side
            at = np.flatnonzero(place <= budget[cell])
            key, weight, depth = _hash(base[chunk[at]], h[at]), freq.nats[bucket(h[at])].astype(np.float64), 1
            while len(at):
                done = (weight >= enough) | (depth == MAX_DEPTH + level)
                lone = ~done & (size[cell[at]] <= budget[cell[at]] + depth)
                stop = done | lone
                emit(row[at[stop]], _hash(key[stop], np.uint64(2)))
                at, key, weight = at[~done], key[~done], weight[~done]
                room = np.minimum(size[cell[at]] - 1, budget[cell[at]] + depth) - place[at]
                room = np.maximum(room, 0)
                step = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + 1
                at = np.repeat(at, room) + step
                key = _hash(np.repeat(key, room), h[at])
                weight = np.repeat(weight, room) + freq.nats[bucket(h[at])]
                depth += 1
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(keys_out)


PAIR_SCHEMA = "kind int, code int, a bigint, b bigint, ia bigint, ib bigint"
#: Largest group compared at once; larger ones are indexed again or streamed.
HOT_ROWS = 4096
#: Rows of sorted keys handled at a time.
BLOCK_ROWS = 200_000
#: Largest number of row ids sent to all executors (8 bytes each).
BROADCAST_IDS = 1_000_000


def _keys(splits: list[str], limits: list[float], freq: Frequency, level: int):
    """Arrow kernel: (row_id, split, text[, parent]) -> index keys of each first copy within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, seen = {s: i for i, s in enumerate(splits)}, set()
        for b in batches:
            sets = Sets(b.column(2).to_pylist())
            code = np.array([code_of.get(s, -1) for s in b.column(1).to_pylist()], np.int64)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            parent = u64(b.column(3)) if level else np.zeros(len(ids), np.uint64)
            fresh = np.zeros(len(ids), bool)
            for i, k in enumerate(zip(code.tolist(), sets.ident.tolist(), parent.tolist())):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            for c, t in enumerate(limits):
                rows, keys = index_keys(sets, fresh & (code == c), t, c + 1000 * level, freq, level)
                if level:
                    with np.errstate(over="ignore"):
                        keys = _hash(keys, parent[rows])
                yield pa.RecordBatch.from_arrays(
                    [i64(keys), i64(sets.n[rows] << 16 | c), i64(sets.ident[rows]), i64(sets.sig[rows]), i64(ids[rows])],
                    ["key", "meta", "ident", "sig", "row_id"],
                )

    return run


def _batch(kind: int, code, a, b, ia, ib) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(code.astype(np.int32)), i64(a), i64(b), i64(ia), i64(ib)],
        ["kind", "code", "a", "b", "ia", "ib"],
    )


def _compare(limits: list[float], last: bool, hot_rows: int = HOT_ROWS):
    """Arrow kernel over rows sorted by key and size: pairs that may overlap enough (kind 0), rows of hot keys (kind 1)."""
    limit = np.array(limits)

    def pairs(key, meta, ident, sig, ids, new_from: int = 0) -> pa.RecordBatch:
        n, code = meta >> 16, meta & 0xFFFF
        t = limit[code]
        out = []
        live, off = np.arange(len(key) - 1), 1
        while len(live):
            live = live[live + off < len(key)]
            live = live[(key[live] == key[live + off]) & (n[live] >= t[live] * n[live + off] - 1e-9)]
            a = live[live + off >= new_from] if new_from else live
            b = a + off
            ok = (np.bitwise_count(sig[a] ^ sig[b]) <= allowed(n[a], n[b], t[a])) & (ident[a] != ident[b])
            out.append(np.stack([a[ok], b[ok]]))
            off += 1
        a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        swap = ident[a] > ident[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        pick = np.unique(np.stack([code[a].astype(np.uint64), ident[a], ident[b]]), axis=1, return_index=True)[1] if len(a) else a
        a, b = a[pick], b[pick]
        return _batch(0, code[a], ids[a], ids[b], ident[a], ident[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hot, done = None, 0

        def flush(parts: list[list[np.ndarray]], end: bool):
            """Handles all complete groups of parts; returns what belongs to the last one. The first ``done`` rows have been compared with each other."""
            nonlocal hot, done
            cols = [np.concatenate(c) for c in zip(*parts)]
            key = cols[0]
            out = []
            if hot is not None:
                mine = key == hot
                if mine.any():
                    out.append(_batch(1, cols[1][mine] & 0xFFFF, cols[4][mine], cols[0][mine].view(np.int64), cols[2][mine], cols[2][mine]))
                    cols = [c[~mine] for c in cols]
                    key = cols[0]
            if not len(key):
                return out, []
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(edge, len(key)))
            keep = len(key) if end else edge[-1]
            big = (size > hot_rows) & (not last)
            if not end and big[-1]:
                hot, keep = key[-1], len(key)
            mask = np.repeat(big, size)
            m = mask[:keep]
            if m.any():
                out.append(_batch(1, cols[1][:keep][m] & 0xFFFF, cols[4][:keep][m], cols[0][:keep][m].view(np.int64), cols[2][:keep][m], cols[2][:keep][m]))
            many = ~mask[:keep] & np.repeat(size > 1, size)[:keep]
            if many.any():
                # rows compared before come first and are all of the first group, if that ends here
                out.append(pairs(*[c[:keep][many] for c in cols], new_from=done if keep else 0))
            rest = [c[keep:] for c in cols]
            done = done if not keep else 0
            if last and len(rest[0]) > BLOCK_ROWS:
                # a group larger than a block: compare it now, keep only rows whose size later rows may match
                out.append(pairs(*rest, new_from=done))
                n = rest[1] >> 16
                near = n >= limit[rest[1] & 0xFFFF] * n[-1] - 1e-9
                rest = [c[near] for c in rest]
                done = len(rest[0])
            return out, [rest] if len(rest[0]) else []

        rows = 0
        for b in batches:
            held.append([u64(b.column(0)), b.column(1).to_numpy(), u64(b.column(2)), u64(b.column(3)), b.column(4).to_numpy()])
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                out, held = flush(held, False)
                rows = 0
                yield from out
        if held:
            yield from flush(held, True)[0]

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = Sets(b.column(1).to_pylist())
        words = pa.ListArray.from_arrays(pa.array(np.append(sets.first, len(sets.h)).astype(np.int32)), i64(sets.h))
        yield pa.RecordBatch.from_arrays([b.column(0), words], ["row_id", "words"])


def _members(splits: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = {s: i for i, s in enumerate(splits)}
        for b in batches:
            sets = Sets(b.column(2).to_pylist())
            code = np.array([code_of.get(s, -1) for s in b.column(1).to_pylist()], np.int32)
            ok = (sets.n > 0) & (code >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[ok]), i64(sets.ident[ok]), i64(b.column(0).to_numpy(zero_copy_only=False)[ok])], ["code", "ident", "row_id"]
            )

    return run


class NearDuplicates:
    """All rows of a group (split) that overlap by at least the group's threshold.

    rows: row_id BIGINT, split STRING, text STRING; other columns are ignored.
    thresholds: split -> overlap in (0, 1]; splits without one are not compared.
    Null ids, null splits and texts without words have no partners; an empty
    table gives empty results; a repeated row_id counts as one row.
    """

    def __init__(self, rows: DataFrame, thresholds: dict[str, float], row_id: str = "row_id", split: str = "split", text: str = "text", hot_rows: int = HOT_ROWS):
        if len(thresholds) >= 1 << 16:
            raise ValueError("at most 65,535 splits")
        self.spark: SparkSession = rows.sparkSession
        self.splits, self.limits = list(thresholds), [float(t) for t in thresholds.values()]
        self.rows = rows.select(
            F.col(row_id).cast("bigint").alias("row_id"), F.col(split).alias("split"), F.col(text).alias("text")
        ).where(F.col("row_id").isNotNull() & F.col("split").isin(self.splits) & (F.length("text") > 0))
        self.hot_rows = hot_rows
        self._links: DataFrame | None = None

    def candidates(self) -> DataFrame:
        """(code, a, b, ia, ib): one pair of rows for each pair of classes that may overlap enough."""
        freq = Frequency.of(self.rows.select("text"))
        source, found = self.rows, []
        for level in range(3):
            keys = source.mapInArrow(
                _keys(self.splits, self.limits, freq, level), "key bigint, meta bigint, ident bigint, sig bigint, row_id bigint"
            )
            if level == 2:
                keys = self._parts(keys)
            got = cut(
                keys.repartition("key").sortWithinPartitions("key", "meta").mapInArrow(_compare(self.limits, level == 2, self.hot_rows), PAIR_SCHEMA)
            )
            found.append(got.where("kind = 0").drop("kind"))
            hot = got.where("kind = 1").select(F.col("a").alias("row_id"), F.col("b").alias("parent"))
            if level == 2 or hot.isEmpty():
                break
            source = self.rows.join(hot, "row_id").select("row_id", "split", "text", "parent")
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        return pairs.groupBy("code", "ia", "ib").agg(F.min(F.struct("a", "b")).alias("p")).select("code", "ia", "ib", "p.a", "p.b")

    def _parts(self, keys: DataFrame) -> DataFrame:
        """Keys of more than hot_rows rows replaced by a key for every two parts of them; a row stands in as many groups as its key has parts."""
        many = keys.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > self.hot_rows)
        many = cut(many.select("key", F.ceil(F.col("_n") / self.hot_rows).cast("int").alias("_parts")))
        if many.isEmpty():
            return keys
        x = keys.join(broadcast_if_small(many, many.count(), BROADCAST_IDS), "key", "left").withColumn("_mine", F.pmod(F.xxhash64("row_id", "ident"), F.col("_parts")))
        x = x.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        shared = F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
        return x.withColumn("key", F.when(F.col("_parts").isNotNull(), shared).otherwise(F.col("key"))).select(keys.columns)

    def links(self) -> DataFrame:
        """(code, ia, ib): pairs of different word-set classes that overlap enough, checked on the whole sets."""
        if self._links is None:
            pairs = cut(self.candidates())
            ids = pairs.select(F.col("a").alias("row_id")).union(pairs.select(F.col("b").alias("row_id"))).distinct()
            ids = cut(ids)
            sets = (
                self.rows.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), "row_id", "left_semi")
                .select("row_id", "text")
                .mapInArrow(_sets_of, "row_id bigint, words array<bigint>")
            )
            limit = F.element_at(F.array(*[F.lit(t) for t in self.limits]), F.col("code") + 1)
            both = F.size(F.array_intersect("wa", "wb"))
            self._links = cut(
                pairs.join(sets.select(F.col("row_id").alias("a"), F.col("words").alias("wa")), "a")
                .join(sets.select(F.col("row_id").alias("b"), F.col("words").alias("wb")), "b")
                .withColumn("both", both)
                .where(F.col("both") / (F.size("wa") + F.size("wb") - F.col("both")) >= limit)
                .select("code", "ia", "ib")
                .distinct()
            )
        return self._links

    def members(self) -> DataFrame:
        """(code, ident, row_id): the word-set class of every row with words."""
        return self.rows.mapInArrow(_members(self.splits), "code int, ident bigint, row_id bigint")

    def pairs(self) -> DataFrame:
        """(row_id_a, row_id_b): all pairs, copies included, smaller id first."""
        members = self.members()
        copies = members.groupBy("code", "ident").agg(F.count("*").alias("n")).where("n > 1")
        links = self.links().union(copies.select("code", F.col("ident").alias("ia"), F.col("ident").alias("ib")))
        left = members.select("code", F.col("ident").alias("ia"), F.col("row_id").alias("ra"))
        right = members.select("code", F.col("ident").alias("ib"), F.col("row_id").alias("rb"))
        return (
            links.join(left, ["code", "ia"])
            .join(right, ["code", "ib"])
            .where("ia <> ib or ra < rb")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))
            .distinct()
        )

    def groups(self) -> DataFrame:
        """(row_id, split, class_id, copies, links, group_id): one row a row with words.

        class_id and group_id are the smallest row ids of the class (same words)
        and of the group (linked classes); links counts linked other classes.
        """
        members = self.members()
        classes = members.groupBy("code", "ident").agg(F.min("row_id").alias("class_id"), F.count_distinct("row_id").alias("copies"))
        links = self.links()
        named = (
            links.join(classes.select("code", F.col("ident").alias("ia"), F.col("class_id").alias("a")), ["code", "ia"])
            .join(classes.select("code", F.col("ident").alias("ib"), F.col("class_id").alias("b")), ["code", "ib"])
            .select("a", "b")
        )
        named = cut(named)
        count = named.union(named.select("b", "a")).groupBy("a").agg(F.count("*").alias("links"))
        group = components(named)
        split = F.element_at(F.array(*[F.lit(s) for s in self.splits] or [F.lit(None).cast("string")]), F.col("code") + 1)
        labelled = (
            classes.join(count, classes.class_id == count.a, "left")
            .join(group, classes.class_id == group.node, "left")
            .select("code", "ident", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class_id").alias("group_id"))
        )
        return members.distinct().join(labelled, ["code", "ident"]).select("row_id", split.alias("split"), "class_id", "copies", "links", "group_id")


def near_duplicates(rows: DataFrame, checks: DataFrame) -> NearDuplicates:
    """Near duplicates within each split of rows, at the thresholds that ``checks`` holds for NearDuplicateCheck."""
    got = current_thresholds(checks, "NearDuplicateCheck")
    for r in rows.select("split").where(F.col("split").isNotNull()).distinct().collect() if "split" in rows.columns else []:
        got.setdefault(r["split"], 0.9)
    return NearDuplicates(rows, got)

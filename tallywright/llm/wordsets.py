"""Word sets of rows: sizes, identities, signatures, global word frequency.

Shared by the near-duplicate join and the cross-split search. All of it is
exact bookkeeping: whatever the frequency table says, it only orders words, and
both sides of a pair order them alike, so no pair is lost through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import distinct_hashes, mix64

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DEFAULT_THRESHOLD = 0.9


def current_thresholds(checks: DataFrame, check_name: str) -> dict[str, float]:
    """Threshold of each split by its latest setting (ties: the largest check_id); null or NaN means 0.9.

    The result has one entry a split, so it is small whatever the table holds.
    """
    rows = (
        checks.where((F.col("check_name") == check_name) & F.col("split").isNotNull())
        .groupBy("split")
        .agg(F.max_by("threshold", F.struct("updated_at", "check_id")).alias("t"))
        .collect()
    )
    got = {r["split"]: DEFAULT_THRESHOLD if r["t"] is None or r["t"] != r["t"] else float(r["t"]) for r in rows}
    for split, t in got.items():
        if t <= 0:
            raise ValueError(f"threshold of {check_name} for {split} must be above 0, not {t}")
    return got


def reach(n: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    """Most words by which any set overlapping a set of n words by t or more can differ from it."""
    return np.floor(n * (1.0 / t - 1.0) + 1e-9).astype(np.int64)


def allowed(na: np.ndarray, nb: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    """Most words by which sets of na and nb words may differ if they overlap by t or more."""
    s = na + nb
    return s - 2 * np.ceil(s * t / (1.0 + t) - 1e-9).astype(np.int64)


class Sets:
    """Distinct words of a batch of texts: row-sorted hashes with sizes, class ids and parity signatures.

    ``sig`` is a 64-bit signature: the parity of the number of words that hash
    to each bit. The Hamming distance of two signatures never exceeds the
    number of words in which the sets differ. ``ident`` with ``sig`` and ``n``
    identifies a set.
    """

    def __init__(self, texts: list[str | None]):
        self.row, self.h = distinct_hashes(texts)
        self.n = np.bincount(self.row, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        has = np.flatnonzero(self.n)
        self.ident = np.zeros(len(texts), np.uint64)
        self.sig = np.zeros(len(texts), np.uint64)
        if len(has):
            with np.errstate(over="ignore"):
                self.ident[has] = np.add.reduceat(mix64(self.h ^ np.uint64(0x5851F42D4C957F2D)), self.first[has])
            self.sig[has] = np.bitwise_xor.reduceat(np.uint64(1) << (self.h & np.uint64(63)), self.first[has])


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        texts = b.column(0).to_pylist()
        _, h = distinct_hashes(texts)
        counts += np.bincount(bucket(h), minlength=BUCKETS)
        rows += sum(t is not None for t in texts)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(counts[some], rows))], ["bucket", "n"]
    )


class Frequency:
    """How many rows hold a word of each of 65,536 hash buckets; counted over all rows.

    The table has a fixed size (512 KB), so it may go to the driver and to every
    task. Buckets without a frequent word all hold about as many rare words, so
    that level is the noise floor; ``frequent`` are buckets well above it.
    """

    def __init__(self, counts: np.ndarray, rows: int):
        self.counts, self.rows = counts, max(rows, 1)
        self.mean_words = counts.sum() / self.rows
        self.floor = float(np.median(counts))
        self.frequent = counts > max(32.0, 3.0 * self.floor)
        share = np.where(self.frequent, counts, min(self.floor, 1.0) or 1.0) / self.rows
        self.nats = -np.log(np.minimum(share, 1.0)).astype(np.float32)

    @classmethod
    def of(cls, texts: DataFrame) -> Frequency:
        """texts: a DataFrame of one string column."""
        parts = texts.mapInArrow(_count_buckets, "bucket int, n bigint")
        got = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(BUCKETS, np.int64)
        real = got[got.bucket >= 0]
        counts[real.bucket.to_numpy()] = real.n.to_numpy()
        return cls(counts, int(got.n[got.bucket < 0].sum()))


def i64(a: np.ndarray) -> pa.Array:
    """uint64 bits as BIGINT."""
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def u64(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).view(np.uint64)

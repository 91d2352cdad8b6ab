"""Records that differ only in how they are written, collapsed to one each.

Two passes over canonical hashes. The first builds, in every task, a Bloom
filter of hashes seen once and one of hashes seen again, and merges them by
segments: what two tasks saw once each was seen again. The second lets through
the rows whose hash may have been seen again; only these are shuffled and
grouped exactly. All others are singletons.

A filter has at most MAX_BITS bits (32 MB), so the merged one may be broadcast,
and BITS_PER_ROW bits a row. Where the rows would need more, they are taken in
as many passes over ranges of the hash, one filter at a time, so the share of
singletons that are let through stays the same at any size.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import fold, mix64
from tallywright.llm.wordsets import i64, u64
from tallywright.session import cut

BITS_PER_ROW, MIN_BITS, MAX_BITS = 12, 1 << 20, 1 << 28
SEGMENT = 1 << 16  # bytes

#: Field names by which even a text of one field, or one whose values hold further lines, is known as a record (fixed values).
FIELDS = ("user", "context", "tool", "reply", "locale")
_KNOWN = "|".join(FIELDS)
_MAYBE = re.compile(r'\W*\w{1,30}["\s]*[:=]')
_LINE = re.compile(rf"^[^\S\n]*({_KNOWN})[^\S\n]*:", re.I | re.M)
_PART = re.compile(rf"(?:\A|[|;])\s*({_KNOWN})\s*=", re.I)
#: Names of any other record: a letter, then letters, digits and underscores; every line or part has one.
_ANY_LINE = re.compile(r"[^\S\n]*([^\W\d_]\w{0,29})[^\S\n]*:(?!//)(.*)")
_ANY_PART = re.compile(r"\s*([^\W\d_]\w{0,29})\s*=(.*)", re.S)


def record_fields(text: str) -> list[tuple[str, str]] | None:
    """Fields of a flat record in any of its notations, or None for a plain text.

    A JSON object is a record whatever its names. Lines and parts are one if
    they begin with a name of FIELDS, or if there are two or more, all have the
    form of a field, and no name is repeated.
    """
    if not _MAYBE.match(text):
        return None
    bare = text.strip()
    if bare.startswith("{"):
        try:
            pairs = json.loads(bare, object_pairs_hook=list, strict=False)
        except (ValueError, RecursionError):
            return None
        if not isinstance(pairs, list) or not pairs or not all(isinstance(p, tuple) for p in pairs):
            return None
        return [(k.strip().lower(), v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in pairs]
    for pattern in (_PART, _LINE):
        cuts = list(pattern.finditer(bare))
        if cuts and cuts[0].start() == 0:
            ends = [*(m.start() for m in cuts[1:]), len(bare)]
            return [(m[1].lower(), bare[m.end() : e]) for m, e in zip(cuts, ends)]
    for pattern, pieces in ((_ANY_PART, re.split("[|;]", bare)), (_ANY_LINE, [x for x in bare.splitlines() if x.strip()])):
        if len(pieces) > 1:
            found = [pattern.fullmatch(x) for x in pieces]
            if all(found) and len({m[1].lower() for m in found}) == len(found):
                return [(m[1].lower(), m[2]) for m in found]
    return None


def canonical_forms(texts: list[str | None]) -> list[bytes | None]:
    """The canonical form of each text; None where it has no words.

    Plain texts: their words without gaps. Records: their fields by name, each
    value's words without gaps.
    """
    fields = [record_fields(t) if t else None for t in texts]
    flat = iter(v.replace(b" ", b"") for v in fold([v for f in fields if f for _, v in f]))
    out: list[bytes | None] = []
    for whole, f in zip(fold(texts), fields):
        whole = whole.replace(b" ", b"")
        if f:
            parts = sorted(k.encode() + b"\x02" + next(flat) for k, _ in f)
            out.append(b"\x01".join(parts) + b"\x01")
        else:
            out.append(whole or None)
    return out


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = canonical_forms(b.column(1).to_pylist())
        keep = [i for i, f in enumerate(forms) if f is not None]
        raw = b"".join(hashlib.blake2b(forms[i], digest_size=16).digest() for i in keep)
        h = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), i64(h[:, 0].copy()), i64(h[:, 1].copy())], ["id", "h1", "h2"])


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), (mix64(h) & mask).astype(np.int64)


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

        def put(where: np.ndarray, at: np.ndarray) -> None:
            np.bitwise_or.at(where, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

        def has(where: np.ndarray, at: np.ndarray) -> np.ndarray:
            return (where[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        for b in batches:
            h, n = np.unique(u64(b.column(0)), return_counts=True)
            p, q = _probes(h, bits)
            seen = (n > 1) | (has(once, p) & has(once, q))
            put(again, p[seen])
            put(again, q[seen])
            put(once, p)
            put(once, q)
        part, a, r = [], [], []
        step = min(SEGMENT, len(once))
        for s in range(0, len(once), step):
            if once[s : s + step].any():
                part.append(s // step)
                a.append(zlib.compress(once[s : s + step].tobytes(), 1))
                r.append(zlib.compress(again[s : s + step].tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(a, pa.binary()), pa.array(r, pa.binary())], ["part", "once", "again"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by part: one merged segment of repeats each."""
    now, once, again = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([again.tobytes()], pa.binary())], ["part", "again"])

    for b in batches:
        for part, a, r in zip(*(c.to_pylist() for c in b.columns)):
            a, r = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, r))
            if part != now:
                if now is not None:
                    yield done()
                now, once, again = part, a.copy(), r.copy()
            else:
                again |= r | (once & a)
                once |= a
    if now is not None:
        yield done()


def possible_repeats(df: DataFrame, rows: int, h: str = "h1", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of df whose hash may occur more than once: all that do and a few others, kept in the checkpoint folder."""
    bits = MIN_BITS
    while bits < min(rows * BITS_PER_ROW, max_bits):
        bits *= 2
    bits = min(bits, max_bits)
    passes = max(1, -(-rows * BITS_PER_ROW // bits))
    found = None
    for k in range(passes):
        # the bits that choose the pass are not those of the probes
        mine = df.where(F.pmod(F.shiftrightunsigned(F.col(h), 36), F.lit(passes)) == k) if passes > 1 else df
        part = _possible_repeats(mine, bits, h)
        found = part if found is None else found.unionByName(part)
    return found


def _possible_repeats(df: DataFrame, bits: int, h: str) -> DataFrame:
    merged = (
        df.select(h).mapInArrow(_fill(bits), "part int, once binary, again binary")
        .repartition("part").sortWithinPartitions("part").mapInArrow(_merge, "part int, again binary")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    step = min(SEGMENT, len(bitmap))
    for r in merged.toLocalIterator():
        bitmap[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["again"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def again(x: pd.Series) -> pd.Series:
        where = shared.value
        p, q = _probes(x.to_numpy().view(np.uint64), bits)
        return pd.Series(((where[p >> 3] >> (p & 7).astype(np.uint8)) & (where[q >> 3] >> (q & 7).astype(np.uint8)) & 1).astype(bool))

    out = cut(df.where(again(F.col(h))))
    shared.unpersist()
    return out


def text_hashes(rows: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(id, h1, h2): the 128-bit hash of the canonical form of every text with words; null ids are left out."""
    found = rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and length(text) > 0")
    # 24 bytes a row are kept rather than texts read again in each pass
    return cut(found.mapInArrow(_hash_texts, "id bigint, h1 bigint, h2 bigint"))


def digest(c: str = "content_hash"):
    """The last 64 letters and digits in lower case; null where there are fewer."""
    bare = F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(bare) >= 64, F.lower(F.right(bare, F.lit(64))))


SAME = ("run_id", "scorer", "slice_name", "row_id", "label", "score", "scored_at", "digest")


def prediction_keys(predictions: DataFrame) -> DataFrame:
    """id, the columns that copies share, and a hash of them; rows without a whole digest are left out."""
    p = predictions.withColumn("digest", digest()).where("digest is not null and pred_id is not null")
    same = [F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c) if c == "score" else F.col(c) for c in SAME]
    p = p.select(F.col("pred_id").cast("bigint").alias("id"), *same)
    return p.withColumn("h1", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in SAME]))


def _groups(df: DataFrame, rows: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Possible repeats (kept in the checkpoint folder), and kept id and count of each group of them."""
    some = possible_repeats(df, rows)
    return some, some.groupBy(*keys).agg(F.min("id").alias("kept_id"), F.count_distinct("id").alias("copies"))


def _pairs(df: DataFrame, rows: int, keys: list[str], name: str) -> DataFrame:
    some, groups = _groups(df, rows, keys)
    s, g = some.alias("s"), groups.where("copies > 1").alias("g")
    same = [F.col(f"s.{k}") == F.col(f"g.{k}") if k in ("h1", "h2") else F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    return (
        s.join(g, same).where("s.id <> g.kept_id").select(F.lit(name).alias("table_name"), "g.kept_id", F.col("s.id").alias("copy_id")).distinct()
    )


TEXT_KEYS, PREDICTION_KEYS = ["h1", "h2"], ["h1", *SAME]


def copies(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """(table_name, kept_id, copy_id): each copy with the smallest id of its set; repeated ids count once."""
    return _pairs(text_hashes(rows), rows.count(), TEXT_KEYS, "eval_rows").unionByName(
        _pairs(prediction_keys(predictions), predictions.count(), PREDICTION_KEYS, "predictions")
    )


def collapsed(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """(table_name, kept_id, copies): every record once with the number of its copies, singletons included."""
    out = []
    for name, df, n, keys in (
        ("eval_rows", text_hashes(rows), rows.count(), TEXT_KEYS),
        ("predictions", prediction_keys(predictions), predictions.count(), PREDICTION_KEYS),
    ):
        some, groups = _groups(df, n, keys)
        single = df.select("id").distinct().join(some.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("kept_id"), F.lit(1).cast("bigint").alias("copies"))
        out.append(groups.select("kept_id", "copies").unionByName(single).select(F.lit(name).alias("table_name"), "kept_id", "copies"))
    return out[0].unionByName(out[1])

"""Loaders that give one DataFrame with a split column."""

from __future__ import annotations

import glob
import hashlib
import json
import math
import shutil
import tempfile
import urllib.parse
import urllib.request
import uuid
from pathlib import Path
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_frame(df: DataFrame, split_col: str) -> DataFrame:
    """Rows with a split; null splits are dropped."""
    return df.where(F.col(split_col).isNotNull()).withColumnRenamed(split_col, "split") if split_col != "split" else df.where("split is not null")


def single(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.lit("all"))


def parquet_globs(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """The files of each split's glob, with split and source file; FileNotFoundError for a glob without files."""
    parts = []
    for split, pattern in splits.items():
        files = sorted(glob.glob(pattern)) if "://" not in pattern else [pattern]
        if not files:
            raise FileNotFoundError(pattern)
        parts.append(spark.read.parquet(*files).withColumn("source_file", F.input_file_name()).withColumn("split", F.lit(split)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def map_labels(df: DataFrame, column: str, mapping: dict | None) -> DataFrame:
    """Integer labels by a map, or integral values as they are; what cannot be mapped is null, for ``unmapped`` to count."""
    if mapping is None:
        x = F.col(column).cast("double")
        return df.withColumn("label", F.when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.cast("int")))
    pairs = [F.lit(v) for kv in mapping.items() for v in (str(kv[0]), int(kv[1]))]
    return df.withColumn("label", F.create_map(*pairs)[F.col(column).cast("string")])


def unmapped(df: DataFrame) -> int:
    return df.where("label is null").count()


def refuse_unmapped(df: DataFrame, column: str) -> DataFrame:
    """df as it is if every row has a label, else ValueError naming some of the values that have none."""
    bad = [r[0] for r in df.where("label is null").select(F.col(column).cast("string")).distinct().orderBy(column).limit(5).collect()]
    if bad:
        raise ValueError(f"{column} has values without a label: {bad}")
    return df


def fetch_verified(url: str, sha256: str, cache: str) -> str:
    """The path of the content of url (a local path, file: or http(s): address) in the cache folder, by its hash; what is there already is not read again.

    A content of another hash raises ValueError and leaves nothing behind.
    """
    want = sha256.removeprefix("sha256:").lower()
    target = Path(cache) / f"{want}{Path(urllib.parse.urlparse(url).path).suffix}"
    if target.exists() and _file_hash(target) == want:
        return str(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(f".{uuid.uuid4().hex}.part")
    try:
        with urllib.request.urlopen(url if "://" in url else Path(url).resolve().as_uri()) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out)
        if (got := _file_hash(part)) != want:
            raise ValueError(f"{url} has the hash {got}, not {want}")
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)
    return str(target)


def _file_hash(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def hub(spark: SparkSession, name: str, splits: dict[str, str], **options) -> DataFrame:
    """Splits of a dataset of a public hub, read through its own library if that is installed; each split is handed over as Parquet files."""
    try:
        import datasets
    except ImportError as error:
        raise ImportError("reading from a dataset hub needs the datasets library") from error
    folder = tempfile.mkdtemp(prefix="tallywright-hub-")
    for split, theirs in splits.items():
        datasets.load_dataset(name, split=theirs, **options).to_parquet(f"{folder}/{split}.parquet")
    return parquet_globs(spark, {s: f"{folder}/{s}.parquet" for s in splits})


def read_manifest(path: str) -> dict:
    """A manifest of slices: JSON, or YAML if its library is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def frozen(config):
    """config with mappings and lists that cannot be changed."""
    if isinstance(config, dict):
        return MappingProxyType({k: frozen(v) for k, v in config.items()})
    return tuple(frozen(v) for v in config) if isinstance(config, (list, tuple)) else config


def manifest_union(spark: SparkSession, slices: dict[str, dict], folder: str) -> DataFrame:
    """text, label, source, row_id, sha of declared slices {name: {path or url and sha256, text_field, label_field, label_map?, sample_size?, seed?}}.

    A sample is drawn in hashed order, so it does not depend on partitions.
    """
    parts = []
    for name, s in slices.items():
        path = fetch_verified(s["url"], s["sha256"], folder) if "url" in s else f"{folder}/{s['path']}"
        kind = s.get("format") or Path(path).suffix.lstrip(".")
        read = {"parquet": spark.read.parquet, "pq": spark.read.parquet, "jsonl": spark.read.json, "json": spark.read.option("multiLine", True).json, "csv": spark.read.option("header", True).csv}
        d = refuse_unmapped(map_labels(read[kind](path), s["label_field"], s.get("label_map")), s["label_field"])
        d = d.select(F.col(s["text_field"]).alias("text"), "label", F.lit(name).alias("source"))
        d = d.withColumn("sha", F.concat(F.lit("sha256:"), F.sha2("text", 256))).withColumn("row_id", F.col("sha"))
        if s.get("sample_size"):
            d = d.orderBy(F.xxhash64("row_id", F.lit(s.get("seed", 0)))).limit(int(s["sample_size"]))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PREDICTION = "label int, score double, row_id string, content_hash string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or JSONL prediction artifact under a strict schema; any malformed row fails the read."""
    r = spark.read.schema(PREDICTION).option("mode", "FAILFAST")
    return r.option("header", True).option("enforceSchema", False).csv(path) if path.endswith(".csv") else r.json(path)


def strict(value):
    """value without NaN and infinities (null instead), for JSON."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    return [strict(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_json(payload, path: str) -> None:
    """RFC 8259 JSON of a small result."""
    Path(path).write_text(json.dumps(strict(payload), allow_nan=False, sort_keys=True, default=str))


def write_long(df: DataFrame, path: str) -> None:
    """A long result table as JSON lines with nulls in place of NaN and infinities."""
    cols = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)

"""Inference, sources, sinks and streaming."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallywright.operators import calibrate as C
from tallywright.operators import joins as J
from tallywright.operators import resample as R
from tallywright.operators import similarity as X
from tallywright.operators import splits as D
from tallywright.plans import evaluate as V
from tallywright.plans import harness as N
from tallywright.sources import loaders as IO
from tallywright.streaming.scores import windowed_histogram

G = "g string, row_id bigint, y int, s double"


def sample(spark, n=120, seed=0):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    s = np.clip(np.round(0.35 * y + 0.6 * r.random(n), 2), 0, 1)
    return y, s, spark.createDataFrame([("a", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], G)


def area(y, s):
    p, q = s[y == 1], s[y == 0]
    return float(((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q)))


def test_bca_and_percentile_surround_the_area(spark):
    y, s, d = sample(spark)
    b = R.bca_ci(d, ["g"], reps=60).first()
    assert abs(b.roc_auc - area(y, s)) < 1e-12 and b.ci_low < b.roc_auc < b.ci_high
    c = R.bootstrap_ci(d, ["g"], "roc_auc", reps=60).first()
    assert abs(b.ci_low - c.ci_low) < 0.05 and c.n_resamples == 60
    assert R.bootstrap_ci(d.where("y = 1"), ["g"]).count() == 0


def test_delong_matches_placements(spark):
    y, a, _ = sample(spark, 80, 1)
    b = sample(spark, 80, 2)[1]
    d = spark.createDataFrame([("g", m, i, int(y[i]), float(v[i])) for m, v in (("A", a), ("B", b)) for i in range(80)], "g string, m string, row_id bigint, y int, s double")
    r = R.delong(d, ["g"], "m", "A", "B").first()

    def placed(s):
        p, q = s[y == 1], s[y == 0]
        m = (p[:, None] > q) + (p[:, None] == q) / 2
        return m.mean(1), m.mean(0)

    (v1, v0), (w1, w0) = placed(a), placed(b)
    assert abs(r.delta - (area(y, a) - area(y, b))) < 1e-12
    assert abs(r.variance - ((v1 - w1).var(ddof=1) / len(v1) + (v0 - w0).var(ddof=1) / len(v0))) < 1e-12


def test_cosine_top_edges(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0])], "id bigint, v array<double>")
    got = [(r.ref_id, r.sim) for r in X.cosine_top(d, "id", "v", lambda c: c == 0, 2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.0)] and X.cosine_top(d, "id", "v", lambda c: c == 99, 2).count() == 0


def test_jaccard_is_all_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(i, [f"w{x}" for x in set(r.integers(0, 12, int(r.integers(0, 9))).tolist())]) for i in range(60)]
    d = spark.createDataFrame(rows, "id bigint, g array<string>")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.6}
    assert {(x.a, x.b) for x in X.jaccard_pairs(d, "id", F.col("g"), 0.6).collect()} == want


def test_purged_folds_keep_their_distance(spark):
    d = spark.range(100).select(F.col("id").alias("row_id"), F.timestamp_seconds(F.col("id") * 7000).alias("t"))
    rows = {(r.fold, r.row_id): r.role for r in D.purged_kfold(d, "t", "row_id", 4, 3, 0.05).collect()}
    for f in range(4):
        test = [i for (g, i), role in rows.items() if g == f and role == "test"]
        train = [i for (g, i), role in rows.items() if g == f and role == "train"]
        assert len(test) == 25 and not set(range(min(test) - 3, max(test) + 9)) & set(train)


def test_loaders(spark, tmp_path):
    d = spark.createDataFrame([("a", "yes"), ("b", "no"), ("c", "maybe")], "t string, l string")
    d.write.parquet(str(tmp_path / "x.parquet"))
    with pytest.raises(FileNotFoundError):
        IO.parquet_globs(spark, {"train": str(tmp_path / "none*")})
    assert IO.parquet_globs(spark, {"train": str(tmp_path / "x.parquet/*.parquet")}).select("split").distinct().first().split == "train"
    declared = {"path": "x.parquet", "text_field": "t", "label_field": "l", "label_map": {"yes": 1, "no": 0}}
    with pytest.raises(ValueError, match="maybe"):  # a value without a label is refused
        IO.manifest_union(spark, {"s": declared}, str(tmp_path))
    u = IO.manifest_union(spark, {"s": declared | {"label_map": {"yes": 1, "no": 0, "maybe": 0}}}, str(tmp_path))
    assert IO.unmapped(u) == 0 and u.count() == 3 and u.first().row_id.startswith("sha256:")
    assert IO.file_hashes(spark, str(tmp_path / "x.parquet/*.parquet")).count() >= 1


def test_artifacts_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("label,score,row_id,content_hash\n1,0.5,r1,\n")
    assert IO.read_predictions(spark, str(tmp_path / "p.csv")).first().score == 0.5
    (tmp_path / "q.csv").write_text("label,score,row_id,content_hash\nx,0.5,r1,\n")
    with pytest.raises(Exception):
        IO.read_predictions(spark, str(tmp_path / "q.csv")).collect()
    IO.write_json({"a": float("nan"), "b": [1, float("inf")]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [1, None]}
    IO.write_long(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "long"))
    assert spark.read.text(str(tmp_path / "long")).first().value == '{"x":null}'
    assert V.manifest({"b": 1, "a": 2})["config_hash"] == V.manifest({"a": 2, "b": 1})["config_hash"]


def test_streamed_histogram_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(i, i % 2, (i % 10) / 10) for i in range(50)], "i bigint, y int, s double").select(F.timestamp_seconds(F.col("i") * 60).alias("t"), F.lit("a").alias("g"), "y", "s")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = windowed_histogram(stream, "t", ["g"]).writeStream.format("memory").queryName("hist").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("hist").agg(F.sum("n"), F.sum("p")).first()
    assert (got[0], got[1]) == (50, 25)


def test_scorecard_and_gates(spark):
    _, _, d = sample(spark)
    d = d.unionByName(spark.createDataFrame([("b", 1, 1, 0.5)], G))
    c = V.scorecard(d, ["g"])
    assert {r.status for r in c.where("g = 'b' and metric = 'roc_auc'").collect()} == {"skipped"}
    assert {r.g: r.message for r in V.gates(c, ["g"], "roc_auc", 0.5).collect()} == {"a": "ok", "b": "missing"}
    roles = spark.createDataFrame([("s", "train"), ("s", "train")], "source string, role string")
    assert {(r.role, r.problem) for r in V.role_conflicts(roles, ["test"]).collect()} == {("train", "repeated"), ("test", "missing")}


def test_verified_sources(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"t": "one", "l": "yes"}\n{"t": "two", "l": "no"}\n')
    sha = hashlib.sha256(f.read_bytes()).hexdigest()
    slices = {"s": {"url": str(f), "sha256": "sha256:" + sha, "text_field": "t", "label_field": "l", "label_map": {"yes": 1, "no": 0}}}
    cache = str(tmp_path / "cache")
    assert sorted((r.text, r.label) for r in IO.manifest_union(spark, slices, cache).collect()) == [("one", 1), ("two", 0)]
    f.write_text("changed")
    assert IO.fetch_verified(str(f), sha, cache).startswith(cache)  # from the cache
    with pytest.raises(ValueError, match="hash"):
        IO.fetch_verified(str(f), "0" * 64, cache)
    assert len(list((tmp_path / "cache").iterdir())) == 1
    with pytest.raises(ValueError, match="maybe"):
        IO.refuse_unmapped(IO.map_labels(spark.createDataFrame([("yes",), ("maybe",)], "l string"), "l", {"yes": 1}), "l")
    frozen = IO.frozen({"a": [1, {"b": 2}]})
    with pytest.raises(TypeError):
        frozen["a"] = 1
    (tmp_path / "m.json").write_text('{"name": "m"}')
    assert frozen["a"][1]["b"] == 2 and IO.read_manifest(str(tmp_path / "m.json")) == {"name": "m"}


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("a", None, 3), (None, 9, 4), ("b", 7, 5), ("a", 25, 6)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", 30, 99), (None, 1, 7), ("c", 1, 1)], "k string, t int, v int")
    for cell in (None, lambda c: F.floor(c / 4)):
        got = {r.id: r.v for r in J.asof_join(left, right, ["k"], "t", ["v"], cell).collect()}
        assert got == {1: 51, 2: None, 3: None, 4: None, 5: None, 6: 51}
    assert J.asof_join(left, right.where("false"), ["k"], "t", ["v"]).where("v is null").count() == 6


def test_isotonic_transform(spark):
    fit = spark.createDataFrame([("a", 0.2, 0.3, 0.1), ("a", 0.5, 0.6, 0.5)], "k string, low double, high double, value double")
    d = spark.createDataFrame([("a", i, 0, s) for i, s in enumerate([0.1, 0.25, 0.4, 0.55, 0.9])] + [("b", 9, 0, 0.5)], "k string, id int, y int, s double")
    got = {r.id: round(r.s, 6) for r in C.apply_isotonic(d, fit, ["k"]).collect()}
    assert got == {0: 0.1, 1: 0.1, 2: 0.3, 3: 0.5, 4: 0.5}


def test_run_gates_and_audit(spark):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([("s" if i % 3 else "one", i, int(i % 3 == 0 or i % 2), float(r.random())) for i in range(300)], "slice_name string, row_id bigint, label int, x double")
    grid, failed = N.score_grid(rows, {"x": lambda d: F.col("x"), "bad": lambda d: F.col("no_such"), "half": lambda d: F.lit(0.5), "late": lambda d: F.raise_error(F.lit("boom")).cast("double")})
    assert set(failed) == {"bad", "late"} and {x.scorer for x in grid.select("scorer").distinct().collect()} == {"x", "half"}
    leak = spark.createDataFrame([("c", "s", 1), ("c", "s", 2)], "check_name string, split string, row_id bigint")
    with pytest.raises(RuntimeError):
        N.evaluate(grid, leakage=leak)
    run = N.evaluate(grid, [("x", "half")], [N.OperatingPoints("s", ("max_f1", "youden_j")), N.OperatingPoints("gone")], leak, "record", failed=failed, reps=20).cache()
    facts = {(x.section, x.slice_name, x.scorer, x.name): x for x in run.collect()}
    assert facts["size", "one", "x", "n"].value == 100 and facts["metric", "one", "x", "roc_auc"].status == "skipped" and facts["leakage", None, None, "c"].value == 2
    assert facts["metric", "s", "half", "roc_auc"].value == 0.5 and ("operating_point", "one", "x", "s:max_f1:recall") in facts and facts["operating_point", None, None, "gone"].status == "error"
    gates = [N.required_slice("s"), N.required_slice("t"), N.required_metric("one", "x", "roc_auc"), N.minimum_slice_size("one", 1, 1, 1), N.low_fpr_feasibility("s", 0.5), N.paired_diff_present("s", "x", "half"), N.no_scorer_errors(), N.no_leakage_errors(), N.strict_artifact()]
    got = {x.gate: x.passed for x in N.check_gates(run, gates).collect()}
    assert list(got.values()) == [True, False, False, False, True, True, False, False, True]
    assert {x.claim: x.supported for x in N.claim_report(run, {"a": [gates[0], gates[8]], "b": [gates[0], gates[1]]}).collect()} == {"a": True, "b": False}
    docs = spark.createDataFrame([(1, "train", "Same text", 1), (2, "test", "same  TEXT", 0), (3, "test", "other", 0), (4, "train", "x" * 99, 0), (5, None, None, 1)], "row_id bigint, split string, text string, label int")
    audit = {(x.gate, x.split): x.passed for x in N.audit_dataset(docs, 50).collect()}
    assert audit == {("class_balance", "train"): True, ("class_balance", "test"): False, ("context_window_fit", "train"): False, ("context_window_fit", "test"): True, ("no_cross_split_leakage", "train"): True, ("no_cross_split_leakage", "test"): False, ("exact_duplicates", "train"): True, ("exact_duplicates", "test"): True}
    assert N.audit_dataset(docs.where("false"), 50).count() == 0 and N.evaluate(grid.where("false")).count() == 0

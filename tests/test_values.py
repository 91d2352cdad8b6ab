"""Operators against values worked out by hand or by plain numpy from the published formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallywright.functions import transforms as T
from tallywright.operators import eda as E
from tallywright.operators import metrics as M
from tallywright.operators import resample as R
from tallywright.operators import select as S
from tallywright.operators import shift as H
from tallywright.operators import splits as D


def scores(spark, n=400, seed=3, digits=2, keys=("a", "b")):
    """Scores with many ties, near 0, 1/2 and 1 alike."""
    r = np.random.default_rng(seed)
    out = []
    for k in keys:
        s = np.round(r.beta(0.5, 0.7, n), digits)
        y = (r.random(n) < 0.2 + 0.6 * s).astype(int)
        out += [(k, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(out, "key string, row_id bigint, y int, s double"), out


def of(out, key):
    x = [(i, y, s) for k, i, y, s in out if k == key]
    return (np.array(c) for c in zip(*x))


def mass_bins(s, y, n_bins=10):
    order = np.argsort(s, kind="stable")
    edges = np.linspace(0, len(s), n_bins + 1, dtype=int)
    return [(s[order[a:b]].mean(), y[order[a:b]].mean(), b - a) for a, b in zip(edges, edges[1:]) if b > a]


def test_score_ranges_rise_with_the_score(spark):
    x = sorted([0.0, 1e-300, 1e-9, 0.001, 0.25, 0.4999999999, 0.5, 0.50000001, 0.75, 0.999, 1 - 1e-12, 1.0, *np.random.default_rng(1).random(300).tolist()])
    got = [r.r for r in spark.createDataFrame([(v,) for v in x], "s double").orderBy("s").select(M.score_range().alias("r")).collect()]
    assert got == sorted(got) and len(set(got)) > 50


def test_curve_is_cumulative_over_ranges(spark):
    df, out = scores(spark)
    for k in ("a", "b"):
        _, y, s = of(out, k)
        for r in M.curve(df, ["key"]).where(F.col("key") == k).collect():
            assert (r.tp, r.k, r.pos, r.tot) == (((s >= r.s) & (y == 1)).sum(), (s >= r.s).sum(), y.sum(), len(y))


def test_debiased_errors(spark):
    df, out = scores(spark, digits=3)
    e = {r.key: r for r in M.ece_family(M.equal_mass_bins(df, ["key"]), ["key"]).collect()}
    d = {r.key: r for r in M.ece_debiased(df, ["key"], sweeps=50).collect()}
    for k in ("a", "b"):
        _, y, s = of(out, k)
        bins, n = mass_bins(s, y), len(s)
        square = sum(m / n * (p - q) ** 2 for p, q, m in bins)
        noise = sum(m / n * p * (1 - p) / m for p, q, m in bins)  # variance at the mean score, not at the frequency
        assert e[k].ece_l2_debiased == pytest.approx(np.sqrt(max(square - noise, 0))) and e[k].ece_l2 == pytest.approx(np.sqrt(square))
        plug = sum(m / n * abs(p - q) for p, q, m in bins)
        drawn = M.draws(np.arange(n), np.arange(1, 51), 1) < (s * M.PRIME)[:, None]
        null = np.mean([sum(m / n * abs(p - q) for p, q, m in mass_bins(s, drawn[:, j])) for j in range(50)])
        assert (d[k].ece, d[k].null_ece) == (pytest.approx(plug), pytest.approx(null)) and d[k].ece_debiased == pytest.approx(max(plug - null, 0))


def test_equal_mass_ranks_of_one_hot_score(spark):
    df = spark.createDataFrame([("a", 100_000 * i, i % 2, 0.5) for i in range(25)] + [("few", 1, 1, 0.5)], "key string, row_id bigint, y int, s double")
    got = sorted((r.row_id, r.bin) for r in M.equal_mass_ranks(df, ["key"], 10, "row_id").collect())
    edges = np.linspace(0, 25, 11, dtype=int)
    assert [b for _, b in got] == [int(np.searchsorted(edges, i, side="right") - 1) for i in range(25)]


def test_gap_flag_is_signed(spark):
    r = np.random.default_rng(0)
    # the full set ranks worse than the trimmed one: the gap is far below 0
    rows = [("a", int(y), float(np.clip(y * 0.8 + r.normal(0, 0.05), 0, 1)) if 10 < i < 290 else float(1 - y), float(i)) for i, y in enumerate(r.integers(0, 2, 300))]
    got = M.quantile_stratified(spark.createDataFrame(rows, "key string, y int, s double, len double"), ["key"], "len").first()
    assert got.gap < -0.05 and not got.gap_flag


def test_draws_are_even_and_unlike():
    x = M.draws(np.arange(3000), np.arange(1, 401), 7) / M.PRIME
    assert abs(x.mean() - 0.5) < 0.005 and abs(x.var() - 1 / 12) < 0.002
    near = np.corrcoef(x[:, :40].T)[np.triu_indices(40, 1)]
    assert np.abs(near).max() < 0.1 and np.abs(np.corrcoef(x[:40])[np.triu_indices(40, 1)]).max() < 0.3
    w = R.weights(np.arange(3000), 400, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def metrics_of(w, y, s):
    order = np.argsort(-s, kind="stable")
    w, y, s = w[order], y[order], s[order]
    a = b = tp = k = 0
    best = (-1, 0)
    pos, tot = (w * y).sum(), w.sum()
    for v in sorted(set(s.tolist()), reverse=True):
        m = s == v
        p, n = (w * y)[m].sum(), w[m].sum()
        tp, k = tp + p, k + n
        a += p * tp / k if k else 0
        b += (n - p) * (tp - p / 2)
        f1 = round(2 * tp / (k + pos), 12) if k + pos else -1
        if f1 >= best[0]:
            best = (f1, v)
    return a / pos, b / (pos * (tot - pos)), best[1]


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_replicates_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    df, out = scores(spark, 150)
    got = {(r.key, r.rep): r for r in R.replicates(df, ["key"], "row_id", 12).collect()}
    best = {(r.key, r.rep): r.t for r in R.best_f1_replicates(df, ["key"], "row_id", 12).collect()}
    for k in ("a", "b"):
        i, y, s = of(out, k)
        w = R.weights(i, 12, 7)
        for j in range(12):
            ap, auc, t = metrics_of(w[:, j], y, s)
            assert got[k, j + 1].pr_auc == pytest.approx(ap) and got[k, j + 1].roc_auc == pytest.approx(auc) and best[k, j + 1] == t


def test_weighted_calibration_error_of_replicates(spark):
    df, out = scores(spark, 150)
    got = {(r.key, r.rep): r.ece for r in R.binned_replicates(df, ["key"], "row_id", 9).collect()}
    i, y, s = of(out, "a")
    w, at = R.weights(i, 9, 7), np.minimum((np.searchsorted(np.linspace(0, 1, 11), s, side="right") - 1), 9)
    for j in range(9):
        want = sum(abs((w[at == b, j] * (s - y)[at == b]).sum()) for b in range(10)) / w[:, j].sum()
        assert got["a", j + 1] == pytest.approx(want)


def test_thresholds_and_roc_points(spark):
    df, out = scores(spark, 200, digits=1)
    _, y, s = of(out, "a")
    points = [((s >= t)[y == 0].mean(), (s >= t)[y == 1].mean(), t) for t in sorted(set(s.tolist()), reverse=True)]
    kept = [p for i, p in enumerate(points) if i == len(points) - 1 or abs((points[i + 1][0] - p[0]) - (p[0] - (points[i - 1][0] if i else 0))) > 1e-12 or abs((points[i + 1][1] - p[1]) - (p[1] - (points[i - 1][1] if i else 0))) > 1e-12]
    got = sorted((r.fpr, r.tpr, r.t) for r in S.roc_points(df, ["key"]).where("key = 'a'").collect())
    assert np.allclose(got, sorted(kept))
    youden = max(points, key=lambda p: (round(p[1] - p[0], 12), p[2]))
    assert S.youden_j(df, ["key"]).where("key = 'a'").first().t == youden[2]


def test_adjusted_p_over_ranges(spark):
    r = np.random.default_rng(1)
    p = np.round(r.random(300) ** 4, 3)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(p)] + [("k", 999, None)], "key string, i int, p double")
    got = {x.i: x.q for x in S.adjust_p(df, ["key"]).collect()}
    order = np.argsort(p)
    want = np.minimum(np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1], 1)
    assert np.allclose([got[int(i)] for i in order], want) and got[999] is None


def test_log_odds_take_totals_over_all_tokens(spark):
    df = spark.createDataFrame([("x x x x x z rare", 1), ("y y y y y z z z z once", 0), (None, 1)], "text string, label int")
    got = {r.token: r for r in E.log_odds(df, "text", F.col("label") == 1).collect()}
    assert set(got) == {"x", "y", "z"}
    na, nb, a0 = 7, 10, 0.17
    odds = lambda c, n, pr: np.log((c + pr) / (n + a0 - c - pr))
    assert got["x"].delta == pytest.approx(odds(5, na, 0.05) - odds(0, nb, 0.05))
    assert got["x"].pmi == pytest.approx(np.log2((5.05 / (na + a0)) / ((5 + 0.1) / (17 + 2 * a0))))
    assert E.log_odds(df.where("label = 1"), "text", F.col("label") == 1).count() == 0
    ends = [max(got, key=lambda t: got[t].z), min(got, key=lambda t: got[t].z)]
    assert [r.token for r in E.leaning(E.log_odds(df, "text", F.col("label") == 1), 1).orderBy("side").collect()] == ends


def test_obfuscation(spark):
    cases = {
        "hello": (0, False, 0, False, 0, False), "he​llo": (1, False, 0, False, 0, False), "a\U000e0041\U000e0042b️": (3, False, 0, False, 0, False), "rtl‮ soft­": (0, False, 0, False, 0, False),
        "ﬁle": (0, True, 1, False, 0, False), "\U0001d408gnore": (0, True, 0, False, 0, False), "vtaber gur cerivbhf": (0, False, 0, True, 0, False), "h3ll0 1gn0r3 v1 h0w b2z8": (0, False, 0, False, 3, False),
        "payload AbCdEfGh12IjKlMn34OpQrSt56UvWxYz end": (0, False, 0, False, 0, True), "hash 0123456789abcdef tail": (0, False, 0, False, 0, True), "debug deadbeefcafef00d here": (0, False, 0, False, 0, False),
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaa": (0, False, 0, False, 0, False),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "row_id int, text string")
    got = {r.row_id: (r.invisible, r.nfkc_changed, r.nfkc_delta, r.rot13, r.leet_tokens, r.entropy_run) for r in E.obfuscation(df, "row_id").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == (0, False, 0, False, 0, False)
    s = E.obfuscation_summary(df, [], "row_id").first()
    assert (s.n_texts, s.n_with_invisible_chars, s.total_invisible_chars, s.n_with_nfkc_change, s.n_with_nfkc_length_delta, s.n_with_high_entropy_run, s.n_with_rot13_marker, s.n_leeted_tokens) == (12, 2, 4, 2, 1, 2, 1, 3)
    assert spark.range(1).select(E.entropy(F.lit("abcd")).alias("a"), E.entropy(F.lit("aaaa")).alias("b"), E.entropy(F.lit("")).alias("c")).first() == (2.0, 0.0, 0.0)


def test_transforms_and_fixed_tables(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.delimit(F.lit("a"), "<[(")) == "<[(a)]>" and one(T.delimit(F.lit("a"), ">>")) == ">>a>>"
    assert all(k != v and ord(v) >= 0x0400 for k, v in T.LOOKALIKES.items()) and "K" in T.LOOKALIKES and "i" not in T.LOOKALIKES


def vectors(spark, n=60, shift=0.0, seed=4):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 5))
    d = np.arange(n) % 3 == 0
    v[d] += shift
    return spark.createDataFrame([(i, [float(x) for x in row], int(k)) for i, (row, k) in enumerate(zip(v, d))] + [(998, None, 0), (999, [0.0] * 5, None)], "i bigint, v array<double>, d int"), v, d.astype(int)


@pytest.mark.parametrize("shift", [0.0, 2.0])
def test_shift_statistics(spark, shift):
    df, v, d = vectors(spark, shift=shift)
    dist = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    width = np.median(dist[np.triu_indices(len(v), 1)])
    assert H.median_bandwidth(df.where("i < 900"), "i", "v").first()[0] == pytest.approx(width)
    k = np.exp(-(dist**2) / (2 * width**2))
    a, b = d == 0, d == 1
    n, m = a.sum(), b.sum()
    want = (k[np.ix_(a, a)].sum() - n) / (n * (n - 1)) + (k[np.ix_(b, b)].sum() - m) / (m * (m - 1)) - 2 * k[np.ix_(a, b)].sum() / (n * m)
    got = E.maximum_mean_discrepancy(df, "i", "v", "d", float(width), 200).first()
    assert got.mmd_squared == pytest.approx(want) and (got.n_a, got.n_b) == (n, m) and (got.p_value < 0.02 if shift else got.p_value > 0.05)
    np.fill_diagonal(dist, np.inf)
    purity = np.mean([(d[np.lexsort((np.arange(len(v)), np.round(row**2, 9)))[:5]] == d[i]).mean() for i, row in enumerate(dist)])
    assert E.knn_purity(df, "i", "v", "d").first().mean_purity == pytest.approx(purity)
    assert E.maximum_mean_discrepancy(df.where("d = 0"), "i", "v", "d", 1.0, 10).first().mmd_squared is None


def test_ranks_by_slices(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(500)], "row_id bigint, label int")
    got = D.dealt(df, "row_id", ["label"], 0).collect()
    assert sorted(r["rank"] for r in got if r.label == 0) == list(range(1, 251)) and {r.total for r in got} == {250}


def test_score_summary_rounds_ties_as_its_sql(spark, tmp_path):
    from compare import oracle
    from tallywright.plans import catalog

    groups = {"up": [0.414571, 0.41888], "down": [0.512146, 0.514287], "quarter": [0.3, 0.260379, 0.260121, 0.28, 0.29, 0.27], "below": [0.26764, 0.267662], "one": [0.7], "equal": [0.2] * 5}
    rows = [(k, "m", i, str(i), "r", 1, x) for k, v in groups.items() for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "slice_name string, scorer string, pred_id bigint, row_id string, run_id string, label int, score double")
    d.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/predictions.parquet")
    cols = ["slice_name", "n", "mean", "std", "q25", "median", "q75"]
    got = {tuple(r) for r in catalog.queries()["score_summary"](spark, str(tmp_path)).select(*cols).collect()}
    want = set(oracle(str(tmp_path)).execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()['score_summary']})").fetchall())
    assert got == want and {(r[0], r[5]) for r in got} > {("up", 0.416726), ("down", 0.513216), ("one", 0.7), ("equal", 0.2)}

"""Hand-computed cases and edge cases of the core operators."""

import json
import math

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallywright.functions import transforms as T
from tallywright.functions.text import distinct_hashes, token_hashes, words
from tallywright.operators import calibrate as C
from tallywright.operators import leakage as L
from tallywright.operators import metrics as M
from tallywright.operators import parse as P
from tallywright.operators import select as S
from tallywright.operators import similarity as X
from tallywright.operators import splits as D
from tallywright.operators.graph import components
from tallywright.plans.catalog import scores


def frame(spark, rows, schema="g string, row_id bigint, y int, s double"):
    return spark.createDataFrame(rows, schema)


def four(spark):
    return frame(spark, [("a", i, y, s) for i, (y, s) in enumerate([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])])


def test_average_precision_is_stepwise(spark):
    r = M.ranking(four(spark), ["g"]).first()
    assert math.isclose(r.pr_auc, 5 / 6) and math.isclose(r.roc_auc, 0.75)


def test_reserved_key_names_are_refused(spark):
    with pytest.raises(ValueError):
        M.ranking(four(spark).withColumnRenamed("g", "k"), ["k"])


def test_one_class_ties_and_empty(spark):
    assert M.ranking(frame(spark, [("a", 1, 1, 0.5)]), ["g"]).first().pr_auc is None
    tied = M.ranking(frame(spark, [("a", i, i % 2, 0.5) for i in range(10)]), ["g"]).first()
    assert tied.roc_auc == 0.5 and tied.pr_auc == 0.5
    empty = four(spark).where("false")
    assert M.ranking(empty, ["g"]).count() == 0 and S.max_f1(empty, ["g"]).count() == 0
    assert M.ece_family(M.equal_width_bins(empty, ["g"]), ["g"]).count() == 0
    assert M.equal_mass_bins(four(spark), ["g"], 10).count() == 0


def test_validated_drops_dirty_rows(spark):
    d = spark.createDataFrame([("a", 1, float("nan")), ("a", 1, None), ("a", 2, 0.5), ("a", None, 0.5), (None, 1, 0.5), ("a", 1, 1.5), ("a", 1, 0.5)], "g string, label int, score double")
    assert M.validated(d, ["g"]).count() == 1


def test_bins_at_float_edges(spark):
    d = frame(spark, [("a", i, 0, s) for i, s in enumerate([0.0, 0.1, 0.3, 0.6, 0.7, 1.0])])
    got = [r.b for r in d.select(M.equal_width_bin(10).alias("b")).collect()]
    import numpy as np

    assert got == [min(int(np.digitize(s, np.linspace(0, 1, 11))) - 1, 9) for s in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0)]


def test_scores_are_the_last_ingested(spark):
    rows = [(1, "r", "x", 7, 1, 0.9, 1), (2, "r", "x", 7, 1, 0.2, 3), (3, "r", "x", 7, 1, 0.2, 3), (4, "r", "x", 7, 1, None, 9), (5, "r2", "x", 7, 1, 0.4, 1), (6, None, "x", 7, 1, 0.5, 1), (7, None, "x", 7, 1, 0.5, 1), (8, "r", "x", None, 1, 0.5, None)]
    p = spark.createDataFrame([(*r, "n") for r in rows], "pred_id bigint, run_id string, scorer string, row_id bigint, label int, score double, ingested_at int, slice_name string")
    got = scores(lambda name: p)
    assert {(r.pred_id, r.s) for r in got.collect()} == {(3, 0.2), (5, 0.4), (6, 0.5), (7, 0.5), (8, 0.5)}
    assert scores(lambda name: p.where("false")).count() == 0


def test_selectors(spark):
    d = four(spark)
    assert S.max_f1(d, ["g"]).first().t == 0.35
    assert S.target_recall(d, ["g"], 1.0).first().t == 0.35
    assert S.target_fpr(d, ["g"], 0.0).first().t == 0.8
    assert S.recall_at_fpr(frame(spark, [("a", 1, 0, 0.9), ("a", 2, 1, 0.1)]), ["g"], 0.0).first().t == float("inf")


def test_adjusted_p(spark):
    d = spark.createDataFrame([("a", p) for p in (0.01, 0.04, 0.03, None)], "g string, p double")
    q = {r.p: r.q for r in S.adjust_p(d, ["g"]).collect()}
    assert q[None] is None and math.isclose(q[0.01], 0.03) and math.isclose(q[0.04], 0.04)


def test_calibrators(spark):
    d = frame(spark, [("a", i, int((i * 37) % 100 < i), i / 100) for i in range(100)] + [("b", 1, 1, 0.5)])
    t = {r.g: r for r in C.temperature(d, ["g"]).collect()}
    assert t["a"].nll_after <= t["a"].nll_before and t["b"].temperature is None
    assert {r.g: r.a for r in C.platt(d, ["g"]).collect()}["a"] > 0
    values = [r.value for r in C.isotonic(d.where("g = 'a'"), ["g"]).orderBy("low").collect()]
    assert values == sorted(values)


def test_leakage_nulls_and_cap(spark):
    rows = [(i, "train", "same text", 0, 1) for i in range(25)] + [(30, None, "same text", 1, 1), (31, "test", None, 0, None), (32, "test", "Same  TEXT", 1, 2)]
    d = spark.createDataFrame(rows, "row_id bigint, split string, text string, label int, group_id bigint")
    assert L.exact_duplicates(d).count() == 24 and L.exact_duplicates(d, cap=20).count() == 19
    assert L.label_conflict(d).count() == 26 and L.group_leak(d).count() == 0
    assert [r.row_id for r in L.cross_split_exact(d).collect()] == [32]
    assert L.exact_duplicates(d.where("false")).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, None), (200, 200)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in range(100, 130)) and got[200] == 200
    assert components(e.where("false")).count() == 0


def test_greedy(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a bigint, b bigint")
    assert {r.id for r in X.greedy_kept(ids, e).where("kept").collect()} == {0, 2, 4}
    assert X.greedy_kept(ids, e.where("false")).where("kept").count() == 5


def test_corpus_dedup_collapses_copies(spark):
    """As going up the rows does it, with a text of which a third of the rows are copies."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{j}"] * (j % 3) + base[k:]) for j, k in enumerate([60, 58, 55, 50, 30, 59, 2])] + ["a hot text of seven words in all"] * 100 + ["short one", "Short ONE!", None, "", "--"]
    texts = texts + [x for x in texts[:5]] + [f"filler{i} a b c d e{i} f" for i in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    kept, link, sets = [], {}, []
    for i, x in enumerate(texts):
        w = words(x or "")
        g = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())
        sets.append(g)
        if not g:
            continue
        near = [k for k in kept if len(g & sets[k]) / len(g | sets[k]) >= 0.8]
        link[i] = min(near, default=None)
        if not near:
            kept.append(i)
    got = {r.id: r for r in X.corpus_dedup(d, "id", "text", 0.8).collect()}
    assert {i: r.link for i, r in got.items()} == link and [i for i, r in sorted(got.items()) if r.kept] == kept
    assert len({r.class_id for i, r in got.items() if (texts[i] or "").startswith("a hot")}) == 1
    ones = X.copy_classes(X.shingle_sets(d, "id", "text"))[1]
    assert X.minhash_pairs(ones, "id", F.col("g"), 0.8).count() <= X.jaccard_pairs(ones, "id", F.col("g"), 0.8).count() < 100


def test_group_folds_are_disjoint(spark):
    d = spark.createDataFrame([(i, i % 7) for i in range(70)] + [(99, None)], "row_id bigint, g bigint")
    f = D.group_kfold(d, "g", 3)
    assert f.count() == 70 and f.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_words():
    assert words("Ｆｕｌｌ wid​th_x, é") == ["full", "width", "x", "é"]
    assert words(None) == words("") == words(" \n--") == []
    rows, h = distinct_hashes(["b a b", None, "", "a", "x" * 100_000, "a\x00b"])
    assert rows.tolist() == [0, 0, 3, 4, 5, 5] and len(set(h[rows == 0]) & set(h[rows == 5])) == 2
    assert len(token_hashes([])[0]) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_hashes_follow_words(texts):
    rows, h = token_hashes(texts)
    of: dict = {}
    for i, t in enumerate(texts):
        w = words(t)
        mine = h[rows == i].tolist()
        assert len(w) == len(mine)
        for a, b in zip(w, mine):
            assert of.setdefault(a, b) == b


def test_transforms(spark):
    d = spark.createDataFrame([("a  b ", ), (None,), ("",)], "t string")
    assert [r.x for r in d.select(T.datamark(F.col("t"), "$").alias("x")).collect()] == ["a$  b$ ", None, ""]
    assert d.select(T.delimit(F.col("t"), "<[").alias("x")).first().x == "<[a  b ]>"
    assert d.select(T.encode64(F.lit("x" * 100)).alias("x")).first().x.count("\n") == 0
    f = T.seeded(T.PERTURBATIONS["case"])
    assert len({r.x for r in spark.createDataFrame([("same",)] * 3, "t string").select(f(F.col("t")).alias("x")).collect()}) == 1


CASES = [
    ('r1,0,0.5,,', None), ('"r1","1","1e-3",abc,"a, ""b"""', None), (" r1 , 0 ,.5,,x", None), ('r1,0,0.5,,a"b', "quoting"), ('r1,0,0.5,,"a', "quoting"),
    ('r1,0,0.5,,"a" ', "quoting"), ("r1,0,0.5,", "columns"), ("r1,0,0.5,,a,b", "columns"), ("", "columns"), ("x1,0,0.5,,", "row_id"), ("r1234567890123,0,0.5,,", "row_id"),
    ("r1,2,0.5,,", "label"), ("r1,¹,0.5,,", "label"), ("r1,0,nan,,", "score"), ("r1,0,1.0000000000000000000001,,", "score"), ("r1,0,1_0,,", "score"), ("r1,0,-0,,", None),
    ("r1,0,1e-99999999999999999999999,,", None), ("r1,0,1e99999999999999999999999,,", "score"), ("r١,0,0.5,,", "row_id"),
]


def test_csv_rules():
    assert [P.read_record(r, False)[1] for r, _ in CASES] == [x for _, x in CASES]
    assert P.read_record(None, False)[1] == "columns"


def test_json_rules():
    ok = {"row_id": "r1", "label": 1, "score": "0.5", "content_hash": None, "text": ""}
    read = lambda x: P.read_record(x if isinstance(x, str) else json.dumps(x), True)[1]
    assert read(ok) is None and read(ok | {"label": " 1 "}) is None
    assert read(ok | {"label": True}) == "label" and read(ok | {"label": 1.0}) == "label" and read(ok | {"score": None}) == "score"
    assert read(ok | {"row_id": 1}) == "row_id" and read(ok | {"x": 1}) == "columns" and read([1]) == "columns" and read("{'a': 1}") == "quoting"
    assert read('{"row_id": "r1", "label": 1, "score": NaN, "content_hash": "", "text": ""}') == "quoting"
    assert read('{"row_id": "r1", "row_id": "r1", "label": 1, "score": 1, "content_hash": "", "text": ""}') == "columns"
    assert read("[" * 100_000) in ("quoting", "columns") and read("") == "quoting"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet='ab",', max_size=14))
def test_csv_edits_cost_nothing_only_for_well_formed_cells(raw):
    cost, edits = P.cheapest_edits(raw, P.Csv)
    cells = P.split_csv(raw)
    assert (cost == 0) == (cells is not None) and len(edits) == cost
    if cells is not None:
        assert len(P.align(cells)) == abs(len(cells) - 5)


def apply(raw, edits):
    """raw with edits made, from the last to the first."""
    for e in reversed(edits):
        what, name, _, at = e.split()
        char, at = {"quote": '"', "comma": ",", "colon": ":"}.get(name), int(at)
        raw = raw[:at] + raw[at + 1 :] if what == "delete" else raw[:at] + char + raw[at:]
    return raw


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet='a",', max_size=10))
def test_csv_edits_make_a_record_well_formed(raw):
    cost, edits = P.cheapest_edits(raw, P.Csv)
    assert P.split_csv(apply(raw, edits)) is not None
    # no single edit of a quote does what takes two
    if cost > 1:
        others = [raw[:i] + raw[i + 1 :] for i, c in enumerate(raw) if c == '"'] + [raw[:i] + '"' + raw[i:] for i in range(len(raw) + 1)]
        assert all(P.split_csv(x) is None for x in others)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", ":", "{", "}", "[", "]", " ", "\n", "\\", "\\n", "\\u00e9", "a", "1", "-0.5e1", "true", "null", "01", "\x01", '{"a":1', '"b"', '["x,y"]']), max_size=9))
def test_json_costs_nothing_only_if_strict(parts):
    raw = "".join(parts)
    try:
        json.loads(raw)
        strict = True
    except ValueError:
        strict = False
    cost, edits = P.cheapest_edits(raw, P.Json)
    assert (cost == 0) == strict and bool(edits) == (not strict)


def test_edits_state_the_reason():
    assert P.read_record('r1,0,0.5,,"open', False)[1:3] == ("quoting", 1)
    assert P.read_record("r1,1,,t", False)[1:] == ("columns", 1, "insert cell label")  # 1 is a score, too
    assert P.read_record("r1,0,0.5,,t,x", False)[1:3] == ("columns", 1)
    assert P.read_record('{"row_id": "r1", "label": 0, "score": 1, "content_hash": "", "text": "",}', True)[1:] == ("quoting", 1, "delete comma at 71")
    assert P.read_record('{row_id": "r1"}', True)[1:] == ("quoting", 1, "insert quote at 1")
    assert P.read_record("r1,2,0.5,,t", False)[1:] == ("label", 1, "replace value label")


def price(edits):
    return sum(P.INVALID if e.startswith("invalid") else 1 for e in edits)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", ":", "{", "}", "[", "]", " ", "\n", "\\", "a", "1", '{"a":[', "}]", '"b"']), max_size=14), st.sampled_from([0, 500_000]))
def test_large_searches_are_as_cheap_as_the_plain_one(parts, cells):
    raw = "".join(parts)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "NODES", 10**9)
        plain = [P.cheapest_edits(raw, x)[0] for x in (P.Json, P.Csv)]
        m.setattr(P, "NODES", 0)
        m.setattr(P, "CELLS", cells)
        other = [P.cheapest_edits(raw, x) for x in (P.Json, P.Csv)]
    assert [c for c, _ in other] == plain and [price(e) for _, e in other] == plain


def test_edits_of_long_and_deep_records():
    cost, edits = P.cheapest_edits('a"b,' * 20_000, P.Csv)
    assert cost == len(edits) == 20_000 and edits[-1] == "delete quote at 79997"
    assert P.cheapest_edits("[" * 3000, P.Json) == (2, ["insert quote at 0", "insert quote at 3000"])
    cost, edits = P.cheapest_edits('["a",' * 200, P.Json)
    assert cost == len(edits) == 201 and edits.count("insert bracket at 1000") == 200
    head = '{"row_id": "r1", "label": 0, "score": 0.5, "content_hash": "", "text": '
    for depth in (100, 600, 30_000):
        values, reason, cost, edits = P.read_record(head + '[{"a": ' * depth + "1" + "}]" * depth + "}", True)
        assert (reason, cost, edits) == (None, 0, None) and P._as_text(values[4]) == "[[('a', " * depth + "'1'" + ")]]" * depth
        assert P.read_record("[" * depth + "]" * depth, True)[1:3] == ("columns", 5)
        assert P.read_record(head + "[" * depth + "1" + "]" * (depth - 1) + "}", True)[1:3] == ("quoting", 1)


def test_reasons_need_no_search():
    hostile = "[" + "}{][,:\"a1" * 20_000
    assert P.read_record(hostile, True, search=False) == (None, "quoting", None, None)
    for raw in ("r1,0,0.5,,t", "r1,0,0.5,,t,x", 'r1,0,0.5,,"open', "r1,2,0.5,,t", "", '"'):
        assert P.read_record(raw, False, search=False)[:2] == P.read_record(raw, False)[:2]
    for raw in ("[1]", "", '{"a": 1,}', '{"row_id": "r1", "label": 0, "score": 1, "content_hash": "", "text": ""}'):
        assert P.read_record(raw, True, search=False)[:2] == P.read_record(raw, True)[:2]


def test_parse_extra_columns_and_empty(spark):
    d = spark.createDataFrame([(1, "a.csv", "text/csv", 1, "r1,0,0.5,,t", "x", 9), (2, None, None, None, None, None, None)], "raw_id bigint, artifact string, media_type string, line_no bigint, raw string, reason string, label int")
    assert P.valid_records(d).first().score == 0.5 and P.faulty_records(d).first().reason == "columns" and P.parse_records(d.where("false")).count() == 0

"""Training-data operators against brute force and on edge cases."""

import textwrap

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallywright.functions.text import words
from tallywright.llm import canonical as C
from tallywright.llm import contamination as T
from tallywright.llm import neardup as ND
from tallywright.llm import packing as K
from tallywright.llm import quality as Q
from tallywright.llm import sampling as S
from tallywright.llm.crosssplit import CrossSplitOverlap, covered
from tallywright.llm.neardup import NearDuplicates
from tallywright.llm.wordsets import allowed, current_thresholds, i64

DATA = "/root/testdata/sf0.001"
ROWS = "row_id bigint, split string, text string, source string, key string, n int"


def rows(spark, seed=0, n=400):
    r = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        k = int(r.integers(0, 30))
        w = [vocab[int(x)] for x in (r.zipf(1.3, k) - 1) % 60] + [f"rare{int(x)}" for x in r.integers(0, 40, int(r.integers(0, 4)))]
        if i and r.random() < 0.5 and out[int(i * r.random())][2]:
            w = out[int(r.integers(0, i))][2] or ""
            w = [x for x in w.split() if r.random() > 0.08]
            r.shuffle(w)
        out.append((i, [None, "train", "dev", "test"][int(r.integers(0, 4))], None if r.random() < 0.02 else " ".join(w), "s", "clash", 1))
    out += [(1000 + i, "dev", "one hot text of many copies", None, None, None) for i in range(60)] + [(2000, "train", "one hot text of many copies", "s", "", 0), (None, "dev", "no id", "s", "", 0)]
    return spark.createDataFrame(out, ROWS), out


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("t", [0.9, 0.75, 0.5])
def test_near_duplicates_are_all_pairs(spark, t):
    df, out = rows(spark)
    nd = NearDuplicates(df, {"train": t, "dev": t, "test": 0.8})
    got = {tuple(r) for r in nd.pairs().collect()}
    sets = [(i, s, frozenset(words(x))) for i, s, x, *_ in out if i is not None and s]
    want = {(min(i, j), max(i, j)) for i, s, a in sets for j, u, b in sets if i < j and s == u and overlap(a, b) >= (0.8 if s == "test" else t)}
    assert got == want
    g = {r.row_id: r for r in nd.groups().collect()}
    assert all(g[a].group_id == g[b].group_id for a, b in want) and g[1000].copies == 60
    assert NearDuplicates(df.where("false"), {"train": t}).pairs().count() == 0


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_keys_are_indexed_again(spark, hot):
    df, out = rows(spark, 3)
    nd = NearDuplicates(df.coalesce(1), {"dev": 0.75}, hot_rows=hot)
    sets = [(i, frozenset(words(x))) for i, s, x, *_ in out if i is not None and s == "dev"]
    want = {(min(i, j), max(i, j)) for i, a in sets for j, b in sets if i < j and overlap(a, b) >= 0.75}
    assert {tuple(r) for r in nd.pairs().collect()} == want


def test_large_groups_are_streamed_in_blocks(monkeypatch):
    """A group of many blocks: every pair is compared once its second row comes, and only then."""
    monkeypatch.setattr(ND, "BLOCK_ROWS", 50)
    r = np.random.default_rng(1)
    n = np.sort(r.integers(20, 60, 400))
    key = np.array([1] * 5 + [2] * 380 + [3] * 15, np.uint64)
    n = np.concatenate([np.sort(n[:5]), np.sort(n[5:385]), np.sort(n[385:])])
    sig = r.integers(0, 1 << 10, 400).astype(np.uint64)
    ident = r.permutation(400).astype(np.uint64)
    cols = [i64(key), i64(n << 16), i64(ident), i64(sig), i64(np.arange(400))]
    batches = [pa.RecordBatch.from_arrays([c.slice(a, 30) for c in cols], ["key", "meta", "ident", "sig", "row_id"]) for a in range(0, 400, 30)]
    got = [tuple(sorted(x)) for b in ND._compare([0.75], True)(iter(batches)) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if key[i] == key[j] and n[i] >= 0.75 * n[j] - 1e-9 and np.bitwise_count(sig[i] ^ sig[j]) <= allowed(n[i], n[j], 0.75)}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("t", "limits"), [(0.9, {}), (0.75, {"shard_passages": 200}), (0.45, {}), (0.75, {"shard_passages": 200, "broadcast_shards": 0})])
def test_cross_split_finds_all(spark, t, limits):
    """With one shard, with several passes, and with both sides shuffled."""
    df, out = rows(spark, 1)
    c = CrossSplitOverlap(df, {"dev": t, "test": 0.8}, **limits)
    train = [frozenset(words(x)) for i, s, x, *_ in out if s == "train"]
    want = {(s, i) for i, s, x, *_ in out if i is not None and s in ("dev", "test") and any(overlap(frozenset(words(x)), b) >= (t if s == "dev" else 0.8) for b in train)}
    assert {tuple(r) for r in c.flagged().collect()} == want
    assert sum(r.n_affected for r in c.report().collect()) == len(want) and all(0 < r.mean_coverage <= 1 for r in c.report().collect())
    assert CrossSplitOverlap(df.where("split = 'dev'"), {"dev": t}).flagged().count() == 0


def test_intervals_are_merged():
    pair, word, size = np.array([0, 0, 0, 1, 1, 1, 2]), np.array([4, 0, 5, -1, -1, 9, 7]), np.array([3, 2, 4, 2, 3, 1, 2])
    assert covered(pair, word, size, 4).tolist() == [7, 6, 2, 0]


@pytest.mark.parametrize("limits", [{}, {"broadcast_shards": 0}])
def test_cross_split_finds_long_rows_of_frequent_words(spark, limits):
    """Passages that weigh more than a scanned window: the rare words differ and a word of an early passage is missing."""
    r = np.random.default_rng(5)
    out = []
    for i in range(600):
        w = [f"v{int(x)}" for x in r.choice(150, int(r.integers(30, 61)), replace=False)]
        out.append((i, "dev", " ".join([*w, f"only{i}", f"alone{i}"])))
        w.pop(int(r.integers(0, len(w))))
        out.append((1000 + i, "train", " ".join([*w, f"other{i}"] if i % 2 else w)))
    sets = [(i, s, frozenset(words(x))) for i, s, x in out]
    want = {("dev", i) for i, s, a in sets if s == "dev" and any(u == "train" and overlap(a, b) >= 0.9 for _, u, b in sets)}
    df = spark.createDataFrame(out, "row_id bigint, split string, text string")
    got = {tuple(x) for x in CrossSplitOverlap(df, {"dev": 0.9}, **limits).flagged().collect()}
    assert len(want) > 500 and got == want


def test_thresholds(spark):
    d = spark.createDataFrame([("N", "a", 0.5, 1, 1), ("N", "a", None, 2, 2), ("N", "b", 0.7, 1, 3), ("N", None, 0.1, 1, 4), ("M", "a", 0.1, 9, 5)], "check_name string, split string, threshold double, updated_at int, check_id int")
    assert current_thresholds(d, "N") == {"a": 0.9, "b": 0.7}


FORMS = ['{"user": "Hi there", "tool": "x_y"}', "tool: X y\nUSER: hi, there!", "User=HI THERE | tool=xy", "tool=x y; user=hithere"]


def test_record_notations_are_one(spark):
    assert len(set(C.canonical_forms(FORMS))) == 1
    assert C.canonical_forms(["user: a", "usera", None, " ", "a B", "A,b!"])[2:4] == [None, None]
    assert len(set(C.canonical_forms(["user: a", "usera"]))) == 2 and len(set(C.canonical_forms(["a B", "A,b!", "ａb"]))) == 1
    assert C.record_fields("user interface: a, b") is None and C.record_fields("Note: one line") is None and C.record_fields("see http://x\nand: more") is None
    # names need not be known where the notation tells
    assert len(set(C.canonical_forms(['{"name": "Ann B", "id": 7}', '{"id": "7", "NAME": "ann-b"}', "id: 7\nname: Ann B", "Name = ann b; id = 7"]))) == 1
    assert C.record_fields("note: a\nnote: b") is None and C.record_fields("name: a\nno field here") is None


def test_repeats_in_several_passes(spark):
    """Small filters force passes by hash range; the rows let through hold all repeats."""
    r = np.random.default_rng(2)
    h = r.integers(-(1 << 63), (1 << 63) - 1, 4000)
    h[1000:2000] = h[:1000]
    df = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(h)], "id bigint, h1 bigint, h2 bigint")
    for bits in (1 << 20, 1 << 12):
        got = {x.id for x in C.possible_repeats(df, len(h), max_bits=bits).collect()}
        assert set(range(2000)) <= got and len(got) < 3000


def test_copies(spark):
    texts = [*FORMS, "plain", "PLAIN.", "alone", None, "", "--"] + ["hot"] * 50
    e = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id bigint, text string, h1 string")
    h = "ab" * 32
    p = [(1, "r", "s", "n", 1, 0, 0.5, 5, h), (2, "r", "s", "n", 1, 0, 0.5, 5, "sha256:" + h.upper()), (3, "r", "s", "n", 1, 0, None, 5, h), (4, "r", "s", "n", 1, None, None, 5, h), (5, "r", "s", "n", 1, 0, None, 5, h[:2] + " " + h[2:]), (6, "r", "s", "n", 1, 0, 0.5, 5, h[:-1])]
    preds = spark.createDataFrame(p, "pred_id bigint, run_id string, scorer string, slice_name string, row_id bigint, label int, score double, scored_at bigint, content_hash string")
    got = {tuple(r) for r in C.copies(e, preds).collect()}
    assert got == {("eval_rows", 0, i) for i in (1, 2, 3)} | {("eval_rows", 4, 5)} | {("eval_rows", 10, i) for i in range(11, 60)} | {("predictions", 1, 2), ("predictions", 3, 5)}
    one = C.collapsed(e, preds).groupBy("table_name").agg(F.sum("copies").alias("n"), F.count("*").alias("k")).orderBy("table_name").collect()
    assert [(r.n, r.k) for r in one] == [(57, 4), (5, 3)]
    assert C.copies(e.where("false"), preds.where("false")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 300))
def test_packing_is_valid(sizes, capacity):
    windows = K.pack_bundle(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= capacity for w in windows)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=30), st.integers(1, 8))
def test_differencing_keeps_all_items(sizes, k):
    w = K.difference(sizes, k)
    assert len(w) <= k and sorted(i for x in w for i in x) == list(range(len(sizes)))


def test_pack_edges(spark):
    d = spark.createDataFrame([(1, "x" * 25, "a"), (2, "", None), (3, None, "a"), (4, "é" * 4, "b"), (5, "x" * 9, "b")], "doc_id bigint, text string, source string")
    p = spark.createDataFrame([("all", None, 10), ("a", "a", 10)], "pack_id string, source string, capacity bigint")
    got = K.pack(d, p).collect()
    assert sum(r["size"] for r in got if r.pack_id == "all") == 26 + 1 + 9 + 10 and {r.doc_id for r in got if r.pack_id == "a"} == {1}
    assert {tuple(r) for r in K.oversized(d, p).collect()} == {("all", 1), ("a", 1)} and K.pack(d.where("false"), p).count() == 0


def test_leaks_match_brute_force(spark):
    r = np.random.default_rng(0)
    item = [" ".join(f"w{x}" for x in r.integers(0, 50, int(r.integers(0, 25)))) for _ in range(30)]
    docs = []
    for i in range(120):
        w = [f"w{x}" for x in r.integers(0, 50, int(r.integers(0, 90)))]
        if i % 3 == 0:
            src = item[i % 30].split()
            a = int(r.integers(0, max(1, len(src) - 9)))
            w[len(w) // 2 : len(w) // 2] = src[a : a + int(r.integers(8, 12))]
        docs.append((i, " ".join(w)))
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(item)] + [("n", None), (None, "w1")], "item_id string, text string")
    d = spark.createDataFrame(docs + [(900, None), (901, ""), (None, item[0])], "doc_id bigint, text string")

    def held(doc, it):
        k = min(10, len(it))
        return k > 0 and any(doc[i : i + k] == it[j : j + k] for i in range(len(doc) - k + 1) for j in range(len(it) - k + 1))

    want = {(i, f"i{k}") for i, t in docs for k, x in enumerate(item) if held(t.split(), x.split())}
    assert {tuple(x) for x in T.leaked_items(d, items).collect()} == want and want
    assert {tuple(x) for x in T.leaked_items(d, items, shard_words=60).collect()} == want  # several passes
    assert T.leaked_items(d, items.where("false")).count() == 0


def test_sampling(spark):
    e = spark.createDataFrame([(i, "train", [" A ", "a", "B", None][i % 4], i % 2) for i in range(400)], "row_id bigint, split string, stratum string, label int")
    t = spark.createDataFrame([("p", "train", 50, "a", 0, 0.5, 5), ("p", "train", 50, "a", 1, 0.2, 5), ("p", "train", 50, "b", 0, 0.1, 0), ("p", "train", 50, "zz", 1, 0.1, 3), ("p", "train", 50, None, 1, 0.1, None)], "plan_id string, split string, sample_size bigint, stratum string, label int, target_share double, min_rows bigint")
    rep = {(r.stratum, r.label): r for r in S.allocation(e, t).collect()}
    assert rep[("zz", 1)].eligible == 0 and rep[("a", 0)].eligible == 100 and rep[(None, 1)].drawn >= 5
    drawn = S.draw(e, t).collect()
    assert len({r.row_id for r in drawn}) == len(drawn) == sum(r.drawn for r in rep.values()) == 50
    assert {r.row_id for r in S.draw(e.repartition(7), t).collect()} == {r.row_id for r in drawn}
    assert {(r.stratum, r.label) for r in S.unmet(e, t).collect()} == {("zz", 1)} and S.draw(e.where("false"), t).count() == 0


def prose(r, words):
    """Sentences in which about every other word is a common one."""
    some = "committee report member town spring river paper number station winter letter question answer harbour table engine music valley copper season".split()
    out = []
    while words > 0:
        n = int(r.integers(7, 16))
        s = [str(r.choice("the and that it was for as in had they".split() if r.random() < 0.45 else some)) for _ in range(n)]
        if n > 11:
            s[4] += ","
        out.append(" ".join(s).capitalize() + ".")
        words -= n
    return " ".join(out)


def test_quality(spark):
    r = np.random.default_rng(5)
    docs = [(i, "\n\n".join(prose(r, int(r.integers(12, 90))) for _ in range(int(r.integers(1, 5)))), "en") for i in range(400)]
    # a quarter in lines of fixed width, some with a short list
    docs = [(i, "\n".join(textwrap.wrap(t, 72)) if r.random() < 0.25 else t, k) for i, t, k in docs]
    docs = [(i, t + "\n- item one\n- item two\n" + prose(r, 80) if i % 20 == 7 else t, k) for i, t, k in docs]
    bad = [(1000, "\n".join(f"- item {i}" for i in range(20)), "en"), (1001, "\n".join(f"{i},a{i},{i * 7},x" for i in range(20)), None), (1002, "spam " * 200, "en")]
    bad += [(1003, "QUJDREVGR0hJSktMTU5PUFFSU1RVVVldYWVo" * 8, "de"), (1007, "click here\n" * 40, "en"), (1008, "#$%& {}~^ " * 30, "xx")]
    empty = [(1004, None, "en"), (1005, "", None), (1006, " \n ", "en"), (None, "no id", "en")]
    common = spark.createDataFrame([("en", w) for w in "the and that it was for as in had they".split()], "lang string, word string")
    d = spark.createDataFrame(docs + bad + empty, "doc_id bigint, text string, lang string").withColumn("kind", F.lit("clash"))
    want = {(1000, "list"), (1001, "table"), (1002, "junk"), (1003, "junk"), (1007, "junk"), (1008, "junk")}
    assert {tuple(r) for r in Q.no_prose(d, common).collect()} == want
    assert Q.statistics(d, common).where("doc_id = 0").first().word_count == len(words(docs[0][1]))
    got = Q.judged(d, common).where("doc_id is not null").collect()
    assert len(got) == len(docs) + len(bad) + 3 and all((x.distance is None) == (x.doc_id in (1004, 1005, 1006)) for x in got)
    assert all(abs(sum(x.contributions) - x.distance) < 1e-6 * (1 + x.distance) for x in got if x.distance is not None)
    assert Q.no_prose(d.where("false"), common).count() == 0
    assert [x.distance for x in Q.judged(d.where("doc_id < 5"), common).collect()] == [None] * 5  # too few to tell prose from


def test_prose_is_estimated_from_the_documents(spark):
    """Centre and spread are those of the documents, not set values."""
    r = np.random.default_rng(6)
    docs = [(i, "\n\n".join(prose(r, int(r.integers(12, 90))) for _ in range(int(r.integers(1, 5)))), "en") for i in range(300)]
    common = spark.createDataFrame([("en", w) for w in "the and that it was for as in had they".split()], "lang string, word string")
    fit = Q.fit_prose(Q.statistics(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), common))
    x = np.array([np.log1p(len(words(t))) for _, t, _ in docs])
    at = Q.STATS.index("log_words")
    assert abs(fit.center["en"][at] - x.mean()) < 0.1 and abs(fit.spread["en"][at] / x.std() - 1) < 0.2


def test_sql(spark):
    import os

    from compare import differences, oracle
    from tallywright.llm import queries, sql

    if os.path.isdir(DATA):
        for name, text in sql.oracle_sql().items():
            assert not differences(spark, oracle(DATA), DATA, name, queries.queries()[name], text)

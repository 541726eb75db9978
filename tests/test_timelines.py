"""Runs, smoothing, events and metrics against hand-computed values and against one-pass Python."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import naive
from tideframe.operators import compare, events, folds, metrics, runs, smoothing, summary, timing, windows
from tideframe.plans import further, registry

SF = os.environ.get("TIDEFRAME_TEST_SF", "/root/testdata/sf0.001")


def frames(spark, sessions, more=("y_true", "y_pred")):
    rows = [(s, i, *values) for s, columns in sessions.items() for i, values in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, ["session", "frame_index", *more])


def bits(text):
    """'0x5 1x10' -> [0]*5 + [1]*10"""
    return [int(p.split("x")[0]) for p in text.split() for _ in range(int(p.split("x")[1]))]


def pauses_of(spark, sessions, **args):
    return {r["tolerance"]: r for r in events.pause_metrics(frames(spark, sessions), **args).collect()}


def test_perfect_prediction(spark):
    y = bits("0x5 1x10 0x4 1x10 0x5")
    out = pauses_of(spark, {"a": (y, y)})
    assert {t: (r["n_true"], r["n_matched"], r["f2"]) for t, r in out.items()} == {t: (1, 1, 1.0) for t in (5, 10, 12)}
    seg = events.segment_metrics(frames(spark, {"a": (y, y)})).first()
    assert (seg["edit_score"], seg["seg_f1_50"]) == (1.0, 1.0)
    ev = events.event_metrics(frames(spark, {"a": (y, y)})).first()
    assert (ev["iou_f1"], ev["onset_f1"], ev["missed_entirely"], ev["mean_fragments"]) == (1.0, 1.0, 0, 1.0)


def test_edges_are_no_pauses(spark):
    y = bits("0x10 1x10 0x10")
    assert pauses_of(spark, {"a": (y, y)})[5]["n_true"] == 0


def test_tolerance(spark):
    out = pauses_of(spark, {"a": (bits("1x20 0x10 1x20"), bits("1x26 0x10 1x14"))})
    assert (out[5]["recall"], out[10]["recall"]) == (0.0, 1.0)


def test_short_pauses_and_sessions(spark):
    short = bits("1x10 0x2 1x10")
    assert pauses_of(spark, {"a": (short, short)})[5]["n_true"] == 0
    y = bits("1x10 0x5 1x10")
    assert pauses_of(spark, {"a": (y[:12], y[:12]), "b": (y[12:], y[12:])})[5]["n_true"] == 0


def test_segment_golden(spark):
    r = events.segment_metrics(frames(spark, {"a": (bits("0x10 1x10"), bits("0x10 1x4 0x2 1x4"))})).first()
    assert (r["edit_score"], r["seg_f1_10"], r["seg_f1_50"]) == (0.5, 0.6667, 0.3333)


def test_fragmented_prediction(spark):
    y, p = [1] * 100, [0 if i in (20, 40, 60, 80) else 1 for i in range(100)]
    df = frames(spark, {"a": (y, p)})
    assert events.segment_metrics(df).first()["edit_score"] < 0.2
    assert metrics.rates(metrics.confusion(df, "y_true", "y_pred")).first()["accuracy"] == 0.96


def test_unscored_cut(spark):
    df = frames(spark, {"a": ([1, 1, 0, 0, 1, 1], [True, True, False, False, True, True])}, ("y", "scored"))
    out = runs.split_unscored(df)
    assert sorted((r["frame_index"], r["sub"]) for r in out.collect()) == [(0, 0), (1, 0), (4, 1), (5, 1)]
    assert runs.pauses(out, "y", ["session", "sub"]).count() == 0
    starts = frames(spark, {"a": ([1, 1], [False, True])}, ("y", "scored"))
    assert runs.split_unscored(starts).first()["sub"] == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_timelines(spark, seed):
    rng = random.Random(seed)
    sessions = {}
    for s in "abcde":
        n, x = rng.randint(1, 80), 0.5
        scores, ys = [], []
        for _ in range(n):
            x = min(1.0, max(0.0, x + rng.uniform(-0.3, 0.3)))
            scores.append(None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else x)
            ys.append(int(x + rng.uniform(-0.2, 0.2) > 0.5))
        sessions[s] = (ys, scores)
    df = frames(spark, sessions, ("y", "score")).repartition(3)
    out = smoothing.least_durations(smoothing.hysteresis(df, "score", 0.4, 0.6), on=3, off=3)
    got = {s: [r["pred"] for r in sorted((r for r in out.collect() if r["session"] == s), key=lambda r: r["frame_index"])] for s in sessions}
    n_true = n_pred = n_iou = n_onset = 0
    for s, (ys, scores) in sessions.items():
        want = naive.durations(naive.hysteresis([None if x is None or x != x else x for x in scores], 0.4, 0.6), 3, 3)
        assert got[s] == want
        t, p = naive.events(ys, 2), naive.events(want, 2)
        n_true, n_pred = n_true + len(t), n_pred + len(p)
        n_iou += len(naive.match(t, p, lambda a, b: -naive.iou(a, b), lambda a, b: naive.iou(a, b) >= 0.3))
        n_onset += len(naive.match(t, p, lambda a, b: abs(a[0] - b[0]), lambda a, b: abs(a[0] - b[0]) <= 4))
    m = events.event_metrics(out, "y", "pred", iou=0.3, tolerance=4, least=2).first()
    assert (m["n_true"], m["n_pred"], m["n_iou"], m["n_onset"]) == (n_true, n_pred, n_iou, n_onset)


def test_matching_ties(spark):
    true = spark.createDataFrame([("a", 10, 20), ("a", 30, 40)], "session string, start int, end int")
    pred = spark.createDataFrame([("a", 20, 22)], "session string, start int, end int")
    got = events.matched(events.near_onsets(true, pred, 12), F.col("delta")).collect()
    assert [(r["i"], r["j"]) for r in got] == [(0, 0)]  # both 10 away: the first


def test_threshold_of_equal_f(spark):
    """12 rows found with 2 hits and 5 with 1 have the same F of 2/7: the lower threshold is taken."""
    df = spark.createDataFrame([(int(k == 0), 0.25) for k in range(7)] + [(int(k == 0), 0.75) for k in range(5)], "y int, p double")
    got = metrics.fit_threshold(df, "y", "p").first()
    assert got["threshold"] == pytest.approx(0.25) and got["score"] == 2 * 2 / (12 + 2)


@pytest.mark.parametrize("seed", [4, 5])
def test_threshold_fit(spark, seed):
    rng = random.Random(seed)
    rows = [(g, int(rng.random() < 0.4), round(rng.random(), 2)) for g in "ab" for _ in range(60)] + [("one", 1, 0.3), ("one", 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r for r in metrics.fit_threshold(df, "y", "p", "g").collect()}
    for g in "ab":
        t, f = naive.threshold([y for h, y, _ in rows if h == g], [p for h, _, p in rows if h == g])
        assert got[g]["score"] == pytest.approx(f) and got[g]["threshold"] == pytest.approx(t)
    assert got["one"]["threshold"] == 0.5 and got["one"]["score"] is None
    assert metrics.fit_threshold(df.where("g = 'one'"), "y", "p", single="median").first()["threshold"] == 0.5


def test_auc_and_precision(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.8), ("a", 0, 0.1), ("b", 0, 0.5)], "g string, y int, p double")
    auc = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "p", "g").collect()}
    assert auc == {"a": 0.875, "b": None}
    ap = {r["g"]: r["average_precision"] for r in metrics.average_precision(df, "y", "p", "g").collect()}
    assert ap["b"] == 0.0 and ap["a"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_macro_f1_of_one_class(spark):
    r = metrics.rates(metrics.confusion(spark.createDataFrame([(1, 1)], "y int, p int"), "y", "p")).first()
    assert r["f1_macro"] == 1.0
    none = metrics.rates(metrics.confusion(spark.createDataFrame([], "y int, p int"), "y", "p")).first()
    assert none["accuracy"] is None and none["tp"] == 0


def test_percentile_golden(spark):
    ref = spark.createDataFrame([(i / 10,) for i in range(101)], "r double")
    df = spark.createDataFrame([(0.0,), (2.9,), (3.0,), (7.5,), (12.0,)], "s double")
    got = {r["s"]: r["percentile"] for r in smoothing.percentile_map(df, "s", ref, "r").collect()}
    assert got[3.0] == pytest.approx(30 / 101)
    assert [got[s] >= 30 / 101 - 1e-12 for s in (0.0, 2.9, 3.0, 7.5, 12.0)] == [False, False, True, True, True]
    empty = smoothing.percentile_map(df, "s", ref.where("r < 0"), "r")
    assert {r["s"]: r["percentile"] for r in empty.collect()} == {s: s for s in (0.0, 2.9, 3.0, 7.5, 12.0)}


def test_windows(spark):
    labels = ["writing"] * 8 + ["not_writing", "unsure"] + ["writing"] * 2
    df = spark.createDataFrame([("a", i, x, x != "unsure", float(i)) for i, x in enumerate(labels)], "session string, frame_index int, label string, scored boolean, f double")
    by = lambda mode: {r["end_index"]: r for r in windows.sliding(df, ["f"], 4, 1, mode).collect()}
    last, most = by("last"), by("majority")
    assert (last[8]["y"], most[8]["y"]) == (0, 1) and 9 not in last and 9 not in most
    assert last[3]["window"] == [[0.0], [1.0], [2.0], [3.0]]
    held = windows.held(spark.createDataFrame([("a", 3, 0.1), ("a", 6, 0.2)], "session string, end_index int, score double"), "score")
    assert sorted((r["frame_index"], r["score"]) for r in held.collect()) == [(3, 0.1), (4, 0.1), (5, 0.1), (6, 0.2)]


def clock(spark, n, ms):
    return spark.createDataFrame([("a", i, i * ms) for i in range(n)], "session string, frame_index int, timestamp_ms double")


def test_resampling(spark):
    near = timing.resample(clock(spark, 100, 1000 / 29.97), 30)
    assert near.count() == 100
    slow = timing.resample(clock(spark, 100, 40.0), 30).orderBy("frame_index").collect()
    used = [r["source_frame_index"] for r in slow]
    assert len(used) > len(set(used))
    assert all(r["source_frame_index"] * 40 <= r["frame_index"] * 1000 / 30 + 1 for r in slow)
    fast = timing.resample(clock(spark, 600, 1000 / 60), 30).orderBy("frame_index").collect()
    assert 295 <= len(fast) <= 305
    steps = sorted(b["timestamp_ms"] - a["timestamp_ms"] for a, b in zip(fast, fast[1:], strict=False))
    assert steps[len(steps) // 2] in (33, 34)


def test_group_k_fold(spark):
    sizes = {"a": 9, "b": 7, "c": 5, "d": 4, "e": 3, "f": 3}
    units = spark.createDataFrame([(u, n, n // 2, 0) for u, n in sizes.items()], "unit string, n long, pos long, tie long")
    got = {r["unit"]: r["grp"] for r in folds.balanced_groups(units, 3).collect()}
    filled, want = [0, 0, 0], {}
    for u, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        want[u] = filled.index(min(filled))
        filled[want[u]] += n
    assert got == want
    table = folds.group_k_fold(units, 3)
    assert table.where("split = 'test'").groupBy("unit").count().where("count = 1").count() == 6


def test_validation_choice(spark):
    stats = {"a": (10, 5), "b": (12, 1), "c": (7, 4), "d": (9, 9), "e": (11, 3)}
    units = spark.createDataFrame([(u, n, p, 0) for u, (n, p) in stats.items()], "unit string, n long, pos long, tie long")
    got = folds.with_validation(folds.leave_one_out(units), units, 2, 0.15)
    for fold in {r["fold"] for r in got.select("fold").collect()}:
        rows = {r["unit"]: r["split"] for r in got.where(F.col("fold") == fold).collect()}
        pool = sorted(u for u, s in rows.items() if s != "test")
        n_all, p_all = sum(stats[u][0] for u in pool), sum(stats[u][1] for u in pool)
        best = (9.0, None)
        for c in folds.combos(pool, 2):
            n, p = sum(stats[u][0] for u in c), sum(stats[u][1] for u in c)
            if 0 < p < n and 0 < p_all - p < n_all - n:
                score = round(abs(p / n - p_all / n_all) + 0.5 * abs(n / n_all - 0.15), 12)
                best = min(best, (score, c))
        assert sorted(u for u, s in rows.items() if s == "val") == sorted(best[1])


def test_validation_choice_tries_every_pair(spark):
    rng = random.Random(3)
    pools = {f"f{k}": {f"{k}u{i:03d}": (n := rng.randint(20, 900), rng.randint(1, n - 1)) for i in range(120)} for k in range(4)}
    units = spark.createDataFrame([(u, n, p, 0) for stats in pools.values() for u, (n, p) in stats.items()], "unit string, n long, pos long, tie long")
    table = spark.createDataFrame([(f, 1, u, "train") for f, stats in pools.items() for u in stats], folds.FOLDS)
    got = folds.with_validation(table, units, 2, 0.15).collect()
    for fold, stats in pools.items():
        n_all, p_all = sum(n for n, _ in stats.values()), sum(p for _, p in stats.values())
        score = lambda c: round(abs(sum(stats[u][1] for u in c) / (n := sum(stats[u][0] for u in c)) - p_all / n_all) + 0.5 * abs(n / n_all - 0.15), 12)  # noqa: B023, E731
        assert sorted(r["unit"] for r in got if r["fold"] == fold and r["split"] == "val") == list(min((score(c), c) for c in folds.combos(list(stats), 2))[1])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_holdout(spark, seed):
    """Every split sees every class where three units have all of them, and shares are near 70/15/15."""
    rng, rows = random.Random(seed), []
    for u in range(rng.choice([12, 40])):
        kinds = rng.choice([["writing"], ["not_writing"], ["writing", "not_writing"]]) if u > 2 else ["writing", "not_writing", "unsure"]
        rows += [(f"s{u}", kinds[i % len(kinds)]) for i in range(rng.randint(20, 60))]
    got = folds.holdout(spark.createDataFrame(rows, "session string, label string"))
    split = {r["unit"]: r["split"] for r in got.collect()}
    assert got.columns == ["fold", "fold_no", "unit", "split"] and set(split) == {s for s, _ in rows}
    for name, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        mine = [label for s, label in rows if split[s] == name]
        assert {"writing", "not_writing"} <= set(mine) and abs(len(mine) / len(rows) - share) < 0.13


def test_holdout_of_few_units(spark):
    of = lambda rows: {r["unit"]: r["split"] for r in folds.holdout(spark.createDataFrame(rows, "session string, label string")).collect()}
    both = ["writing", "not_writing"]
    assert of([("a", both[i % 2]) for i in range(5)]) == {"a": "train"}
    assert of([("a", both[i % 2]) for i in range(5)] + [("b", both[i % 2]) for i in range(4)]) == {"a": "train", "b": "test"}
    assert sorted(of([(u, both[i % 2]) for u, n in (("a", 9), ("b", 5), ("c", 4)) for i in range(n)]).items()) == [("a", "train"), ("b", "val"), ("c", "test")]
    assert of([]) == {}


def test_random_rows(spark):
    out = folds.random_rows(spark.range(1003).withColumnRenamed("id", "k"), ["k"])
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 702, "val": 150, "test": 151}


def test_chains_of_matches(spark):
    """Matching chain by chain is matching the whole session."""
    rng = random.Random(8)
    spans = lambda: sorted({(a := rng.randint(0, 3000), a + rng.randint(1, 40)) for _ in range(150)})
    t, p = spans(), spans()
    frame = lambda x: spark.createDataFrame([("a", *s) for s in x], "session string, start int, end int")
    t, p = ([s for s, n in zip(x, [*x[1:], (10**9, 0)], strict=True) if s[1] < n[0]] for x in (t, p))  # events of one timeline don't overlap
    pairs = events.overlapping(frame(t), frame(p))
    got = {(r["i"], r["j"]) for r in events.matched(pairs, -F.col("iou")).collect()}
    want = {(i, j) for _, i, j in naive.match(t, p, lambda a, b: -naive.iou(a, b), lambda a, b: naive.iou(a, b) > 0)}
    assert got == want and len(got) > 20
    assert pairs.count() == sum(a[0] < b[1] and b[0] < a[1] for a in t for b in p)


def test_one_wrong_timestamp(spark):
    """A jump of a day gives a row for every tick, in arrays of bounded length."""
    rows = [("a", i, i * 40.0) for i in range(50)] + [("a", 50, 86_400_000.0)]
    out = timing.resample(spark.createDataFrame(rows, "session string, frame_index int, timestamp_ms double"), 30)
    n = int(86_400_000 / (1000 / 30)) + 1
    assert out.count() == n and out.where("source_frame_index = 49").count() > n - 100


def test_statistics():
    assert compare.kendall_p(4, 6, 0, (0, 0), (0, 0), (0, 0)) == pytest.approx(2 / 24)
    assert compare.kendall_p(60, 0, 885, (0, 0), (0, 0), (0, 0)) == 1.0
    assert compare.kendall_p(200, 19898, 1, (0, 0), (0, 0), (0, 0)) < 1e-300
    # all differences positive: 2 of 2^n sign patterns are as extreme
    assert compare.signed_rank([0.1, 0.2, 0.3, 0.4, 0.5]) == (0.0, pytest.approx(2 / 32))
    assert compare.signed_rank([1, -2, 3, 4]) == (2.0, pytest.approx(6 / 16))
    assert compare.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert compare.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert compare.chi2_tail(16.918977604620448, 9) == pytest.approx(0.05, abs=1e-9)


def grown(copies, name):
    """The SQL of a query over so many copies of the smallest events, with keys of their own."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * REPLACE (event_id + c * 10000000 AS event_id, user_id + c * 30000 AS user_id) FROM '{SF}/events.parquet', range({copies}) t(c)")
    return con.sql(registry.ORACLE_SQL[name]).df()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_error_function_of_sql():
    """As good for large numbers of folds as for small ones."""
    for z in [0.0, 0.3, 1.9, 2.0, 2.1, 4.0, 8.0, 20.0]:
        got = duckdb.sql(f"SELECT {further._ERFC} FROM (SELECT {z}::DOUBLE AS z)").fetchall()[0][0]
        assert got == pytest.approx(math.erfc(z), rel=1e-9, abs=1e-300)
    p = grown(100, "wilcoxon_holm")
    assert p["p"].between(0, 1).all() and p["p_holm"].min() < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("copies", [1, 20, 300])
def test_chi2_of_sql(copies):
    """The tail that the SQL of friedman has, for any number of folds."""
    rows = grown(copies, "friedman")
    assert len(rows) and all(r["p"] == pytest.approx(compare.chi2_tail(r["chi2"], 3), abs=2e-6) for _, r in rows.iterrows())


def test_friedman_and_holm(spark):
    scores = {"x": [9, 9.5, 5, 8.5, 9.5, 7.5, 8, 7, 8.5, 6], "y": [7, 6.5, 7, 7.5, 5, 8, 6, 6.5, 7, 7], "z": [6, 8, 4, 6, 7, 6.5, 6, 4, 6.5, 3]}
    rows = [(c, f"f{i}", float(s)) for c, v in scores.items() for i, s in enumerate(v)] + [("x", "only_x", 1.0)]
    df = spark.createDataFrame(rows, "config string, fold string, score double")
    r = compare.friedman(df).first()
    # rank sums by hand: x 26.0, y 20.5, z 13.5 with one tie pair
    ranks = [sorted([scores[c][i] for c in "xyz"]) for i in range(10)]
    sums = {c: sum((ranks[i].index(scores[c][i]) + 1) + (ranks[i].count(scores[c][i]) - 1) / 2 for i in range(10)) for c in "xyz"}
    ties = sum(t**3 - t for row in ranks for t in [row.count(v) for v in set(row)])
    want = (12 / (10 * 3 * 4) * sum(s * s for s in sums.values()) - 3 * 10 * 4) / (1 - ties / (10 * 3 * 8))
    assert r["n_folds"] == 10 and r["chi2"] == pytest.approx(want) and r["p"] == pytest.approx(compare.chi2_tail(want, 2))
    holm = {x["other"]: x for x in compare.wilcoxon_holm(df).collect()}
    ps = {o: compare.signed_rank([a - b for a, b in zip(scores["x"], scores[o], strict=True)])[1] for o in "yz"}
    low, high = sorted(ps.items(), key=lambda x: x[1])
    assert holm[low[0]]["p_holm"] == pytest.approx(min(1, 2 * low[1])) and holm[high[0]]["p_holm"] == pytest.approx(max(min(1, 2 * low[1]), high[1]))


def test_config_diff_and_names(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3"}), ({"a": "1"}, {"a": "1"})], "base map<string,string>, c map<string,string>")
    got = [r[0] for r in df.select(compare.config_diff(F.col("c"), F.col("base"))).collect()]
    assert got == ["b=3", "baseline"]
    w = spark.createDataFrame([(15, 5), (None, None)], "size int, stride int").select(compare.window_name(F.col("size"), F.col("stride"))).collect()
    assert [r[0] for r in w] == ["w15/s5", "frames"]


def test_summaries(spark):
    rows = spark.createDataFrame([("d", "m", "w", "f1", 1.0, 0.5), ("d", "m", "w", "f2", 2.0, None), ("d", "n", "w", "f1", 1.0, 0.25)], "dataset string, model string, window string, fold string, train_seconds double, f1 double")
    out = {r["model"]: r for r in summary.over_folds(rows, ["f1"]).collect()}
    assert (out["m"]["n_folds"], out["m"]["seconds"], out["m"]["f1_std"], out["m"]["f1_values"]) == (2, 3.0, 0.0, [0.5])
    stamped = spark.createDataFrame([("d", "m", "w", "2024-01"), ("d", "m", "w", "2024-02")], "dataset string, model string, window string, stamp string")
    assert {r["stamp"]: r["superseded"] for r in summary.latest(stamped).collect()} == {"2024-01": True, "2024-02": False}

"""Known answers and design claims of the verification operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.functions import prob
from assay.functions.contract import assert_contract, group_key
from assay.operators import agree, calibrate, intervals, overfit, resample, scan
from assay.operators.ordinal import with_ordinal
from assay.operators.resample import group_stats, interval, replicates

G, V = F.col("g"), F.col("v")


def rows(spark, data, schema="g string, v double"):
    return spark.createDataFrame(data, schema)


def one(df):
    (r,) = df.collect()
    return r


def test_normal(spark):
    x = rows(spark, [(str(v), v) for v in (-8.0, -3.0, -0.5, 0.0, 0.7, 1.96, 5.0, 9.0)])
    for r in x.select("v", prob.norm_cdf(V).alias("p")).collect():
        assert abs(r.p - 0.5 * math.erfc(-r.v / math.sqrt(2))) < 1e-14
    q = rows(spark, [("", p) for p in (0.01, 0.05, 0.2, 0.5, 0.8, 0.95, 0.975)])
    for r in q.select("v", prob.norm_cdf(prob.norm_ppf(V)).alias("back"), prob.norm_ppf(V).alias("q")).collect():
        assert abs(r.back - r.v) < 1e-8
        if r.v == 0.975:
            assert abs(r.q - 1.959963985) < 1e-6
    edge = rows(spark, [("", 0.0), ("", 1.0)]).select(prob.norm_ppf(V).alias("q")).collect()
    assert {r.q for r in edge} == {float("inf"), float("-inf")}


def test_finite(spark):
    df = rows(spark, [("a", 1.0), ("b", float("nan")), ("c", float("inf")), ("d", None)])
    assert [r.g for r in df.filter(prob.finite(V)).collect()] == ["a"]


@pytest.mark.parametrize("value", [1.0, 0.4])
def test_mean_ci_constant(spark, value):
    r = one(intervals.mean_ci(rows(spark, [(f"g{i}", value) for i in range(40)]), G, V, iters=100))
    assert r.estimate == pytest.approx(value) and r.lo == pytest.approx(value) and r.hi == pytest.approx(value)
    assert r.robust_positive and not r.robust_negative and r.reliable


def test_mean_ci_cases(spark):
    r = one(intervals.mean_ci(rows(spark, [(f"g{i}", 1.0 if i % 2 else -1.0) for i in range(40)]), G, V, iters=300))
    assert r.estimate == 0 and not r.robust_positive and not r.robust_negative and r.lo < 0 < r.hi
    r = one(intervals.mean_ci(rows(spark, [(f"g{i}", 0.5) for i in range(10)]), G, V, iters=50))
    assert not r.reliable and not r.robust_positive
    assert intervals.mean_ci(rows(spark, []), G, V, iters=50).count() == 0
    r = one(intervals.mean_ci(rows(spark, [(f"g{i}", 1.0) for i in range(20)] + [("x", float("nan"))]), G, V, iters=50))
    assert r.estimate == 1.0 and r.n == 20


def test_replicates_dont_depend_on_partitions(spark):
    data = rows(spark, [(f"g{i % 37}", float(i)) for i in range(200)])
    stats = group_stats(data, G, V, F.lit(1.0))
    a = interval(replicates(stats, 200)).collect()
    b = interval(replicates(group_stats(data.repartition(7), G, V, F.lit(1.0)), 200, broadcast_groups=0)).collect()
    assert [tuple(round(x, 9) for x in r) for r in a] == [tuple(round(x, 9) for x in r) for r in b]


def test_replicates_by_arrays_and_by_joins(spark, monkeypatch):
    """More groups than are sent to every executor: arrays for each value of by, and draws that are joined only beyond the
    bound of one value, give the same."""
    df = spark.range(2000).selectExpr("concat('s', id % 2, if(id % 14 < 7, 'x', '')) as s", "id % 3 as t", "concat('k', id) as key", "cast(id * id % 11 as double) as num", "cast(if(id < 999, 1, 2 + id % 3) as double) as den").sort("num").localCheckpoint()
    rows = lambda by, **how: [(*r[:-1], round(r.v, 9)) for r in replicates(df, 60, by=by, **how).sort(*by, "i").collect()]
    whole = rows(["s", "t"])
    assert len(whole) == 12 * 60
    for by, want in (["s", "t"], whole), ([], rows([])):
        assert rows(by, broadcast_groups=0, task_groups=0) == want
        monkeypatch.setattr(resample, "_joined_replicates", None)  # draws as rows take hours for millions of groups
        assert rows(by, broadcast_groups=10) == want
        monkeypatch.undo()


def test_poisson_agrees(spark):
    rnd = random.Random(7)
    df = rows(spark, [(f"g{i % 300}", rnd.gauss(1, 2)) for i in range(3000)])
    a, b = (one(intervals.mean_ci(df, G, V, iters=1000, method=m)) for m in ("draws", "poisson"))
    assert a.estimate == pytest.approx(b.estimate) and abs(a.lo - b.lo) < 0.03 and abs(a.hi - b.hi) < 0.03
    again = one(intervals.mean_ci(df.repartition(7), G, V, iters=1000, method="poisson"))
    assert again.lo == pytest.approx(b.lo)
    assert intervals.mean_ci(rows(spark, []), G, V, iters=50, method="poisson").count() == 0


def test_mean_weighs_groups_by_rows(spark):
    r = one(intervals.mean_ci(rows(spark, [("a", 1.0)] * 9 + [("b", 11.0)]), G, V, iters=50))
    assert r.estimate == 2.0


def test_roi(spark):
    df = spark.createDataFrame([(f"g{i}", 1.0, 1.5) for i in range(40)] + [("z", 0.0, 99.0), ("y", float("nan"), 9.0)], "g string, c double, p double")
    r = one(intervals.roi_ci(df, G, F.col("c"), F.col("p"), iters=100))
    assert r.lo > 100 and r.robust_positive and r.hits == 40 and r.n == 40


def test_confidence_sequence(spark):
    rnd = random.Random(1)
    df = rows(spark, [("a", rnd.gauss(0, 1)) for _ in range(200)])
    r = one(intervals.confidence_sequence(df, V))
    sd = one(df.agg(F.stddev_pop("v").alias("s"))).s
    assert (r.hi - r.lo) / 2 > 1.645 * sd / math.sqrt(200)
    for data in ([("a", 5.0)], [("a", 3.0)] * 25):
        r = one(intervals.confidence_sequence(rows(spark, data), V))
        assert r.degenerate and not r.decided and r.lo is None
    assert one(intervals.confidence_sequence(rows(spark, [("a", 5.0)] * 30), V, sigma=1.0)).validity == "finite_sample"


def test_sequential_scan(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, rnd.gauss(1, 0.3)) for i in range(200)], "o bigint, v double")
    assert one(intervals.sequential_scan(df, V, ["o"])).crossed_at == 20
    zeros = spark.createDataFrame([(i, 0.0) for i in range(40)], "o bigint, v double")
    r = one(intervals.sequential_scan(zeros, V, ["o"], min_n=0))
    assert r.crossed_at is None and r.n == 40
    with pytest.raises(ValueError, match="step"):
        intervals.sequential_scan(zeros, V, ["o"], step=0)
    assert intervals.sequential_scan(zeros.limit(0), V, ["o"]).count() == 0


def test_sequence_keeps_its_level_under_peeking(spark):
    from assay.operators.evaluate import peeking_rates

    r = {x.method: x.false_positives / x.trials for x in peeking_rates(spark, trials=300, n=200).collect()}
    assert r["sequence"] < 0.05 < 0.2 < r["fixed"]


def test_power(spark):
    v = [("a", x) for x in (0.0, 1.0, -1.0, 0.5, -0.5, 2.0, -2.0, 1.5)]
    a, b = (one(intervals.power_mean(rows(spark, v), V, m)).need_n for m in (0.4, 0.2))
    assert b / a == pytest.approx(4)
    assert one(intervals.power_mean(rows(spark, v), V, 0.0)).need_n == float("inf")
    assert intervals.power_mean(rows(spark, [("a", 1.0)] * 10), V, 0.1).count() == 0
    df = spark.createDataFrame([(1.0, p) for p in (1.5, 0.5) * 4], "c double, p double")
    sd = 100 * 0.5 * math.sqrt(8 / 7)
    assert one(intervals.power_roi(df, F.col("c"), F.col("p"))).need_n == pytest.approx((2.80158 * sd / 10) ** 2)
    assert one(intervals.power_roi(df, F.col("c"), F.col("p"), target=100.0)).need_n == float("inf")
    assert intervals.power_roi(df.limit(4), F.col("c"), F.col("p")).count() == 0


def test_calibration_sparse(spark):
    df = spark.createDataFrame([(i, i / 10, 1.0) for i in range(8)], "u bigint, b double, y double")
    assert all(r.resid == 0 for r in calibrate.in_sample(df, F.col("b"), F.col("y"), "u").collect())
    fitted = calibrate.fit(df, F.col("b"), F.col("y"), "u")
    assert [r.bin for r in fitted.orderBy("bin").collect()] == list(range(8))
    assert all(r.resid == 0 for r in calibrate.apply(df, fitted, F.col("b"), F.col("y")).collect())
    assert calibrate.apply(df, fitted.limit(0), F.col("b"), F.col("y")).count() == 0


def planted(spark, dates=8):
    rnd = random.Random(3)
    out = []
    for i in range(1200):
        b, real, noise = rnd.uniform(0, 0.6), rnd.random() < 0.3, rnd.random() < 0.5
        out.append((i, f"g{i % 240}", f"2024-01-{i % dates + 1:02d}", b, float(rnd.random() < b + 0.25 * real), real, noise, i < 5))
    return spark.createDataFrame(out, "u bigint, g string, t string, b double, y double, real boolean, noise boolean, rare boolean")


def test_holdout_and_staged(spark):
    df = planted(spark)
    specs = {k: F.col(k) for k in ("real", "noise", "rare")}
    r = {x.label: x for x in scan.holdout_scan(df, specs, G, F.col("t"), F.col("b"), F.col("y"), "u", iters=200).collect()}
    assert r["real"].survives and not r["noise"].survives and "rare" not in r
    s = {x.label: x for x in scan.staged_scan(planted(spark, 9), specs, G, F.col("t"), F.col("b"), F.col("y"), "u", iters=200).collect()}
    assert s["real"].confirmed and not s["noise"].confirmed and s["real"].note
    assert scan.staged_scan(df.limit(0), specs, G, F.col("t"), F.col("b"), F.col("y"), "u", iters=10).count() == 0
    z = {x.label: x.z for x in scan.residual_scan(df, specs, G, F.col("b"), F.col("y"), "u", iters=200).collect()}
    assert z["real"] > 2 > abs(z["noise"])


def test_multiple_comparisons(spark):
    r = one(scan.multiple_comparisons(spark.createDataFrame([(100, 2.5)], "n_tests bigint, z double")))
    assert r.p == pytest.approx(math.erfc(2.5 / math.sqrt(2))) and r.expected_false == pytest.approx(100 * r.p)
    assert r.sidak_alpha == pytest.approx(1 - 0.95 ** 0.01)


def test_sharpe(spark):
    df = rows(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", 5.0), ("c", 1.0)])
    assert {r.g: r.sharpe for r in overfit.sharpe(df, V, ["g"]).collect()} == {"a": 2.0, "b": 0.0}
    rnd = random.Random(4)
    noise = rows(spark, [(f"s{s:02d}", rnd.gauss(0, 1)) for s in range(60) for _ in range(50)])
    assert max((r.sharpe, r.dsr) for r in overfit.deflated_sharpe(noise, V, ["g"]).collect())[1] < 0.9
    assert overfit.deflated_sharpe(rows(spark, [("a", 1.0), ("a", 2.0), ("a", 4.0)]), V, ["g"]).count() == 0


def perf(spark, sets):
    return spark.createDataFrame([(f"s{i:02d}", t, float(v)) for i, vs in enumerate(sets) for t, v in enumerate(vs)], "s string, t int, v double")


def test_pbo(spark):
    got = []
    for seed in range(3):
        rnd = random.Random(seed)
        got.append(one(overfit.pbo_cscv(perf(spark, [[rnd.gauss(0, 1) for _ in range(120)] for _ in range(20)]), "s", "t", V)).pbo)
    assert sorted(got)[1] > 0.3
    rnd = random.Random(9)
    edge = [[rnd.gauss(0, 1) for _ in range(120)] for _ in range(19)] + [[rnd.gauss(3, 1) for _ in range(120)]]
    r = one(overfit.pbo_cscv(perf(spark, edge), "s", "t", V))
    assert r.pbo < 0.2 and r.n_splits == 252
    assert one(overfit.pbo_cscv(perf(spark, [[1, 2, 3, 4, 5], [2, 1, 4, 3, 5], [0, 0, 1, 1, 0]]), "s", "t", V)).n_splits == 6
    assert overfit.pbo_cscv(perf(spark, [[1.0]]), "s", "t", V).count() == 0


def test_purged_kfold(spark):
    df = spark.createDataFrame([(i, i) for i in range(100)], "u bigint, t bigint")
    folds = overfit.purged_kfold(df, "u", "t", 5, 0.05).collect()
    for k in range(5):
        test = {r.uid for r in folds if r.fold == k and r.role == "test"}
        train = {r.uid for r in folds if r.fold == k and r.role == "train"}
        assert len(test) == 20 and not test & train and not train & {max(test) + j for j in range(1, 6)}
    assert overfit.purged_kfold(df.limit(2), "u", "t", 5).count() == 0


def test_kappa(spark):
    def k(pairs):
        return one(agree.cohens_kappa(spark.createDataFrame(pairs, "a string, b string"), F.col("a"), F.col("b")))

    assert k([("1", "1"), ("0", "0")] * 3).kappa == 1
    assert k([("1", "0"), ("0", "1")] * 3).kappa == -1
    r = k([("p", "p")] * 10 + [("p", None)])
    assert r.kappa is None and r.degenerate and r.n == 10


def test_decisions(spark):
    df = spark.createDataFrame([(0.1, 0.05, 1000.0, 10.0), (0.0, -0.1, 1000.0, 10.0), (0.1, -0.1, 1000.0, 10.0)], "m double, l double, v double, c double")
    out = agree.decision_value(df, *(F.col(c) for c in "mlvc")).collect()
    assert [r.verdict for r in out] == ["adopt", "reject", "conditional"]
    r = one(agree.value_of_information(df.limit(1), F.col("m"), F.lit(0.0), F.col("v"), F.col("c")))
    assert r.evpi == 0 and r.d == float("inf") and not r.worth_sampling


def test_ordinal(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("k")).repartition(5)
    assert all(r.x == r.ord for r in with_ordinal(df, ["x"]).collect())
    by = with_ordinal(df, ["x"], by=["k"]).toPandas().sort_values(["k", "x"])
    assert (by.groupby("k").cumcount() == by.ord).all()


def test_contract(spark):
    df = assert_contract(spark.createDataFrame([("a", 1.0)], "group string, outcome double"), ["group"])
    r = one(df.select("cost", "payoff", "value"))
    assert r.cost == 1 and r.payoff == 1 and r.value is None
    with pytest.raises(ValueError, match="missing"):
        assert_contract(df, ["nothing"])
    keys = spark.createDataFrame([(1, None), (2, None), (3, "a")], "u bigint, g string").select(group_key(G, F.col("u")).alias("k")).distinct()
    assert keys.count() == 3

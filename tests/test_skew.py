"""Per-key results over weighted values against plain ones."""

import math
import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.operators.skew import heavy_keys, join_hot, percentiles_by_key, profile_by_key

K, V = F.col("k"), F.col("v")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", None]), st.one_of(st.none(), st.integers(-3, 3).map(float), st.just(math.nan), st.just(math.inf))), max_size=60))
def test_profile(spark, rows):
    got = {r.key: r for r in profile_by_key(spark.createDataFrame(rows, "k string, v double"), K, V).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        vs = [v for x, v in rows if x == k and v is not None and math.isfinite(v)]
        c = Counter(vs)
        assert (r.n, r.n_valued, r.n_distinct) == (sum(x == k for x, _ in rows), len(vs), len(c))
        assert r["mode"] == (min(c, key=lambda v: (-c[v], v)) if c else None)
        assert (r["mean"] is None) if not vs else math.isclose(r["mean"], sum(vs) / len(vs), abs_tol=1e-12)


def test_percentiles(spark):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randrange(50))) for _ in range(3000)] + [("b", 1.0), ("b", None), ("c", math.nan), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumns({"key": F.lit(1), "weight": F.lit(2)})
    got = {(r.key, r.share): r.percentile for r in percentiles_by_key(df, K, V, [0.0, 0.25, 0.5, 1.0]).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    for s in (0.0, 0.25, 0.5, 1.0):
        assert got["hot", s] == hot[max(1, math.ceil(s * len(hot))) - 1]
    assert got["b", 0.5] == 1.0 and got[None, 0.5] == 2.0 and ("c", 0.5) not in got


def test_heavy(spark):
    rows = [("a", None)] * 5 + [("b", None)] * 4 + [(None, None)] * 11
    p = profile_by_key(spark.createDataFrame(rows, "k string, v string"), K, V)
    assert {r.key for r in heavy_keys(p, 0.25).collect()} == {"a"}
    assert {r.key for r in heavy_keys(p, 0.2).collect()} == {"a", "b"}
    assert heavy_keys(profile_by_key(spark.createDataFrame([], "k string, v string"), K, V), 0.5).count() == 0


def test_join_with_hot_keys(spark):
    big = spark.range(1000).selectExpr("id", "if(id % 10 < 9, 'hot', if(id % 20 = 9, null, concat('k', id % 7))) as k")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    for how in ("inner", "left"):
        got, plain = join_hot(big, small, ["k"], how, hot_rows=50), big.join(small, ["k"], how)
        assert got.count() == plain.count() and got.exceptAll(plain.select(*got.columns)).count() == 0

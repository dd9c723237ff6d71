import random

import numpy as np
from pyspark.sql import functions as F

from assay.llm.consensus import consensus, latest_scores, pair_agreement, triplet_skills, usable_score


def test_usable(spark):
    cases = {"0": 0, " 2 ": 2, "1.0": 1, "[2]": 2, "[ 1 ]": 1, '["2"]': 2, "2e0": 2, "+1": 1, "02": 2, "１": 1, "1,0": None, "[1,0]": None, "none": None, "": None, "3": None, "-1": None, "1/2": None, "two": None, "0.5": None, "{}": None, "[]": None, "1d": None, "NaN": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    assert {r.s: r.v for r in df.select("s", usable_score(F.col("s")).alias("v")).collect()} == cases | {None: None}


def test_latest(spark):
    rows = [("i", "r", 1, "0", "2"), ("i", "r", 2, "1", "bad"), ("i", "r", 2, "1", "bad"), ("i", "s", None, "2", None), (None, "r", 1, "1", "1"), ("i", None, 1, "1", "1")]
    df = spark.createDataFrame(rows, "id string, judge string, at int, f string, c string")
    assert {tuple(r) for r in latest_scores(df, "id", "judge", "at", ["f", "c"]).collect()} == {("i", "f", "r", 1), ("i", "f", "s", 2)}


def crowd(n=900, seed=5):
    """Four good raters, two poor ones, two who copy each other at random, one who always says 2: truth and votes."""
    rnd = random.Random(seed)
    truth, votes = {}, []
    acc = {"g1": 0.9, "g2": 0.92, "g3": 0.88, "g4": 0.9, "p1": 0.5, "p2": 0.5}
    for i in range(n):
        t, fake = rnd.randrange(3), rnd.randrange(3)
        truth[f"i{i}"] = t
        for r, a in acc.items():
            if rnd.random() < 0.6:
                votes.append((f"i{i}", "f", r, t if rnd.random() < a else rnd.choice([x for x in range(3) if x != t])))
        votes += [(f"i{i}", "f", r, fake) for r in ("c1", "c2")] + [(f"i{i}", "f", "always", 2)]
    return truth, votes


def test_recovers_truth_and_raters(spark):
    truth, votes = crowd()
    df = spark.createDataFrame([(*v, 9.0) for v in votes], "item string, axis string, rater string, score int, weight double")
    scores, raters = consensus(df)
    got = {r.item: r.score for r in scores.collect()}
    skill = {r.rater: r.accuracy for r in raters.collect()}
    assert all(abs(skill[g] - 0.9) < 0.05 for g in ("g1", "g2", "g3", "g4")) and skill["c1"] < 0.4 and skill["always"] < 0.4
    ours = np.mean([got[i] == truth[i] for i in got])
    plain = {}
    for i, _, _, s in votes:
        plain.setdefault(i, []).append(s)
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[i] for i, v in plain.items()])
    assert ours > 0.93 > majority


def test_agreement(spark):
    rnd = random.Random(2)
    votes = [(f"i{k}", "a", r, rnd.randrange(3) if rnd.random() < 0.4 else k % 3) for k in range(60) for r in "xyz" if rnd.random() < 0.9]
    got = {(r.a, r.b): (r.n, r.c) for r in pair_agreement(spark.createDataFrame(votes, "item string, axis string, rater string, score int").repartition(3)).collect()}
    by = {(i, r): s for i, _, r, s in votes}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        both = [(by[f"i{k}", a], by[f"i{k}", b]) for k in range(60) if (f"i{k}", a) in by and (f"i{k}", b) in by]
        n, po = len(both), np.mean([p == q for p, q in both])
        pe = sum(sum(p == k for p, _ in both) * sum(q == k for _, q in both) for k in range(3)) / n**2
        assert got[a, b][0] == n and abs(got[a, b][1] - (po - pe) / (1 - pe)) < 1e-12


def test_many_raters_and_a_hot_one(spark):
    """Far more raters than partners, one of whom has most votes."""
    votes = spark.range(30_000).selectExpr("concat('i', id % 1500) as item", "'f' as axis", "if(id < 1500, 'hot', concat('r', cast(id / 1500 as int) % 19 + 100 * (id % 30 div 10))) as rater", "cast(if(xxhash64(id) % 10 < 8, id % 1500 % 3, xxhash64(id, 1) & 1) as int) as score").distinct()
    scores, raters = consensus(votes, partners=4)
    assert raters.count() == votes.select("rater").distinct().count() > 50 and raters.filter("skill > 0.5").count() > 50
    right = scores.filter("score = cast(substring(item, 2) as int) % 3").count()
    assert right > 0.97 * scores.count() > 0


def test_all_partners_count(spark):
    """A rater's skill is the median over all triplets with more than 64 other raters, as by brute force."""
    rnd, n = random.Random(4), 70
    c = {(a, b): (rnd.randrange(20, 90), rnd.uniform(-0.1, 0.9)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.98 or a == 0}
    got = {r.rater: r.skill for r in triplet_skills(spark.createDataFrame([(f"r{a:02d}", f"r{b:02d}", k, v) for (a, b), (k, v) in c.items()], "a string, b string, n int, c double")).collect()}
    of = lambda a, b: c.get((min(a, b), max(a, b)), (0, None))[1]
    for i in range(n):
        near = [j for j in range(n) if j != i and of(i, j) is not None]
        xs = [of(i, j) * of(i, k) / of(j, k) for j in near for k in near if j < k and (of(j, k) or 0) > 0.1]
        assert abs(got[f"r{i:02d}"] - min(1, max(0, np.median(xs))) ** 0.5) < 1e-12


def test_few_raters(spark):
    df = spark.createDataFrame([("i", "f", "a", 1), ("i", "f", "b", 2), ("i", "f", "c", 2), ("j", "f", "a", 1)], "item string, axis string, rater string, score int")
    scores, raters = consensus(df)
    assert [(r.item, r.score) for r in scores.collect()] == [("i", 2)] and {r.weight for r in raters.collect()} == {0.0}
    scores, raters = consensus(df.limit(0))
    assert scores.count() == 0 and raters.count() == 0
    assert triplet_skills(pair_agreement(df.limit(0))).count() == 0

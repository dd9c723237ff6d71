import random

import numpy as np

from pyspark.sql import functions as F

from assay.llm.leaks import Vocabulary, find_leaks, holds, lcs_pairs, normal_product, right_singular, windows, words

ITEM = "Why did Voriostith need 355 spools, which kept Fenatostaem refused for 939 hours, because Tamiolatrax had rebuilt 509 ratchets and braided louvres?"


def test_words():
    assert words("Ｔhe <b>lou</b>vre&amp;co **bold** café so­ft high-\n  way а​mber") == ["the", "louvre", "co", "bold", "cafe", "soft", "highway", "amber"]
    assert words(None) == [] == words("")


def test_windows():
    ids = np.arange(30, dtype=np.int32)
    w = windows(ids, 24, 12)
    for start in range(19):
        assert any(set(range(start, start + 12)) <= set(r) for r in w)
    assert windows(ids[:5], 24, 12).shape == (1, 24) and windows(ids[:0], 24, 12).tolist() == [[-1] * 24]


def test_holds():
    item = words(ITEM)
    even = [1.0] * len(item)
    noise = ["lorem"] * 9
    for k in range(len(item) - 11):
        assert holds(item, even, noise + item[k : k + 12] + noise)
    assert not holds(item, even, noise + item[3:9] + noise)
    off = [w if i % 6 else "other" for i, w in enumerate(item)]
    assert holds(item, even, noise + off + noise)
    assert len(lcs_pairs(item, off)) == len([w for w in off if w != "other"])


def test_exact_runs_anywhere():
    """A run of exactly 12 words is found whatever stands around it, the item's own words included."""
    rnd = random.Random(5)
    item = words(ITEM)
    for _ in range(300):
        k = rnd.randrange(len(item) - 11)
        around = [rnd.choice([*item, "lorem", "dolor"]) for _ in range(60)]
        assert holds(item, [1.0] * len(item), around[:30] + item[k : k + 12] + around[30:])


def test_singular_vectors(spark):
    rnd = np.random.default_rng(1)
    a = rnd.standard_normal((200, 5)) @ rnd.standard_normal((5, 60))
    v = right_singular(lambda q: a.T @ (a @ q), 60, 5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-8)
    # The tasks' sums are the product.
    rows = np.array([[3, 1, -1], [2, -1, -1], [4, 3, 0]] * 30, dtype=np.int32)
    idf, q = rnd.random(6), rnd.standard_normal((6, 4))
    dense = np.zeros((90, 6))
    for k, r in enumerate(rows):
        dense[k, r[r >= 0]] = idf[r[r >= 0]]
    got = normal_product(spark.createDataFrame([(r.tolist(),) for r in rows], "ids array<int>").repartition(3), idf, q)
    assert np.allclose(got, dense.T @ (dense @ q), rtol=1e-4)


def test_vocabulary():
    v = Vocabulary(["a", "b"], 16)
    assert v.ids(["a", "b"]).tolist() == [0, 1] and 2 <= v["other"] < 18 and v["other"] == Vocabulary(["a", "b"], 16)["other"]


def corpus(seed=2):
    rnd = random.Random(seed)
    name = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    common = "the of and to which kept because while under into after most".split()
    nouns = [name() for _ in range(60)]
    items = [(i, " ".join(rnd.choice([name(), rnd.choice(nouns), rnd.choice(common)]) for _ in range(30))) for i in range(25)]
    background = [name() for _ in range(400)]
    prose = lambda n: [rnd.choice([rnd.choice(background), rnd.choice(common), rnd.choice(common)]) for _ in range(n)]
    docs, truth = [], set()
    for d in range(300):
        ws = prose(rnd.choice([5, 60, 200]))
        if d % 3 == 0:
            i = rnd.randrange(25)
            iw = items[i][1].split()
            n = rnd.choice([12, 20, 30])
            s = rnd.randrange(30 - n + 1)
            part = iw[s : s + n]
            if n > 12 and rnd.random() < 0.5:
                part = [w if k % 6 != 3 else "zzz" for k, w in enumerate(part)]
            at = rnd.randrange(len(ws))
            ws[at:at] = part
            truth.add((i, d))
        elif d % 3 == 1:
            iw = items[rnd.randrange(25)][1].split()
            s = rnd.randrange(24)
            ws[0:0] = iw[s : s + 6]
        docs.append((d, " ".join(ws).capitalize()))
    return docs, items, truth


def test_against_planted(spark):
    docs, items, truth = corpus()
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in find_leaks(d.repartition(3), e).collect()}
    assert len(truth & got) >= 0.97 * len(truth) and len(got - truth) <= 0.02 * len(truth)
    seen = {tuple(r) for r in find_leaks(d, e, check=False).collect()}
    assert truth <= seen and len(seen) < 0.8 * 300 * 25
    # In blocks of items, the same.
    assert {tuple(r) for r in find_leaks(d, e, block_items=10).collect()} == got


def test_recall_against_brute_force(spark):
    """Of the pairs that hold by comparing every document with every item, nearly all are candidates by the cosine."""
    docs, items, _ = corpus(7)
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    seen = {tuple(r) for r in find_leaks(d, e, check=False).collect()}
    got = {tuple(r) for r in find_leaks(d, e).collect()}
    every = {(i, k) for k, text in docs for i, item in items if holds(words(item), [1.0] * len(words(item)), words(text))}
    assert len(every & seen) >= 0.98 * len(every) and got <= seen and len(got ^ every) <= 0.03 * len(every)


def test_hot_text_and_many_items(spark):
    """Nine tenths of the documents hold one item; thousands of items with tens of thousands of words are no bound."""
    rnd = random.Random(3)
    items = [(i, " ".join(f"w{rnd.randrange(60_000)}" for _ in range(20))) for i in range(3_000)]
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "lead in " + items[5][1] + " and out").otherwise(F.concat(F.lit("nothing of "), F.col("id"))).alias("text"))
    got = find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), rank=64)
    assert got.groupBy("item_id").count().collect() == [(5, 1_800)]


def test_cases(spark):
    docs = [(1, ITEM), (2, ITEM.upper().replace(" ", "  ")), (3, None), (4, ""), (None, ITEM), (5, "filler " * 50000 + ITEM), (6, "unrelated text"), (1, ITEM)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(9, ITEM), (8, None), (7, ""), (None, ITEM)], "item_id bigint, text string")
    assert {tuple(r) for r in find_leaks(d, e).collect()} == {(9, 1), (9, 2), (9, 5)}
    assert find_leaks(d, e.limit(0)).count() == 0 and find_leaks(d.limit(0), e).count() == 0

import random

from assay.llm.packing import best_fit, configurations, linear_groups, pack, token_counts


def test_groups():
    hist = {10: 3, 20: 4, 30: 1}
    groups = linear_groups(hist, 4)
    assert [sum(c.values()) for _, c in groups] == [2, 2, 2, 2] and [g for g, _ in groups] == [30, 20, 20, 10]
    assert linear_groups({}, 4) == []


def test_configurations():
    for sizes, demand in (([60, 40, 25], [10, 17, 33]), ([51], [7]), ([100, 34, 33], [2, 9, 9])):
        out = configurations(sizes, demand, 100)
        assert all(sum(s * c for s, c in zip(sizes, col)) <= 100 for col, _ in out)
        assert [sum(col[i] * n for col, n in out) for i in range(len(sizes))] == demand
    assert sum(n for _, n in configurations([60, 40], [10, 10], 100)) == 10


def test_best_fit():
    where = best_fit([(50, "a"), (30, "b")], [(30, "x"), (50, "y"), (10, "z"), (0, "e")], 100, "new")
    assert where[0] == "b" and where[1] == "a" and where[2] == "new-0"


def check(out, counts, capacity):
    bins, sizes = {}, {}
    for r in out:
        bins[r.container] = bins.get(r.container, 0) + r.size
        sizes.setdefault(r.id, []).append(r.size)
    assert max(bins.values(), default=0) <= capacity
    assert sorted(sum(v) for v in sizes.values()) == sorted(sum(n for i, n in counts if i == k) for k in {i for i, _ in counts})
    assert all(len(v) == 1 or sum(i == k for i, _ in counts) > 1 or sum(v) > capacity for k, v in sizes.items())
    return len(bins)


def test_pack(spark):
    rnd = random.Random(7)
    counts = [(i, min(900, int(rnd.expovariate(1 / 60)))) for i in range(3000)]
    df = spark.createDataFrame(counts, "id bigint, n_tokens int")
    out = pack(df, 256, block_items=700).collect()
    n = check(out, counts, 256)
    assert n <= 1.03 * sum(c for _, c in counts) / 256 + 5
    again = {(r.id, r.piece): r.container for r in pack(df.repartition(7), 256, block_items=700).collect()}
    assert again == {(r.id, r.piece): r.container for r in out}
    assert {r.id for r in out if r.n_pieces > 1} == {i for i, c in counts if c > 256}


def test_cases(spark):
    schema = "id bigint, n_tokens int"
    counts = [(1, 0), (2, 256), (3, 257), (4, 5), (4, 5), (None, 7), (5, 512)]
    out = pack(spark.createDataFrame(counts, schema), 256).collect()
    check([r for r in out if r.id is not None], [c for c in counts if c[0] is not None], 256)
    assert sorted(r.size for r in out if r.id == 4) == [5, 5] and sorted(r.size for r in out if r.id == 5) == [256, 256]
    assert pack(spark.createDataFrame([], schema), 256).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello there, world"), (2, None), (3, ""), (4, "word " * 30000)], "doc_id bigint, text string")
    got = {r.id: r.n_tokens for r in token_counts(df).collect()}
    assert 3 <= got[1] <= 6 and got[2] == got[3] == 0 and got[4] >= 29000

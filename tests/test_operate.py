"""Leak checks, gates, actions, retrieval, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import action, evaluate, gate, leak, resample, retrieve
from assay.plans import reference
from assay.sources import records
from assay.streaming import monitor


def test_repeated_entities(spark):
    df = spark.createDataFrame([(1, "A", 1, 0.0), (2, "A", 2, 1.0), (3, "B", 1, 0.0), (4, "B", 2, 0.0), (5, "C", 1, 1.0), (6, None, 1, 1.0), (7, None, 2, 1.0), (8, "D", 1, 1.0), (9, "D", 2, None)], "u bigint, e string, t int, y double")
    got = {r.entity: r.risk for r in leak.repeated_entities(df, F.col("e"), F.col("t"), F.col("y"), "u").collect()}
    assert got == {"A": "H", "B": "M", "D": "M"}


def test_reappearance(spark):
    data = [
        # r1: its favourite is promoted; r3: the third, r5: two reappear at their level; r6: nobody
        ("r1", "a", 1, 0.1, 1.0), ("r2", "a", 2, 0.5, 2.0), ("r3", "x", 1, 0.1, 1.0), ("r3", "y", 1, 0.2, 1.0), ("r3", "b", 1, 0.3, 1.0), ("r4", "b", 3, 0.1, 3.0),
        ("r5", "c", 1, 0.1, 5.0), ("r5", "d", 1, 0.2, 5.0), ("r6", "c", 2, 0.1, 5.0), ("r6", "d", 2, 0.2, 5.0), ("r7", "q", None, 0.1, 1.0), (None, "a", 9, 0.1, 0.0),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "u bigint, g string, e string, t int, b double, l double")
    got = {r.group: r.level for r in leak.reappearance_flags(df, "g", "e", "t", "b", "u", "l").collect()}
    assert got == {"r1": "H", "r2": "L", "r3": "M", "r4": "L", "r5": "L?", "r6": "L", "r7": "L"}
    assert {r.group: r.level for r in leak.reappearance_flags(df, "g", "e", "t", "b", "u").collect()}["r5"] == "H"


def test_split_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("c", 3), ("d", None), (None, 1), (None, 3)], "g string, t int")
    assert [r.group for r in leak.split_contamination(df, F.col("g"), F.col("t"), 2).collect()] == ["a"]
    dup = spark.createDataFrame([("X", 1), ("X", 1), ("Y", 1), (None, 1), (None, 1), ("Z", None), ("Z", None)], "e string, t int")
    assert {(r.entity, r.n) for r in leak.duplicates(dup, F.col("e"), F.col("t")).collect()} == {("X", 2), ("Z", 2)}


def test_target_leak(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, float(i % 2), rnd.random(), float(i % 2)) for i in range(48)], "u bigint, ans double, pad double, y double")
    got = {r.feature: r.leaks for r in leak.target_leak_scan(df, ["ans", "pad"], F.col("y"), "u").collect()}
    assert got == {"ans": True, "pad": False}
    assert leak.target_leak_scan(df.limit(29), ["ans"], F.col("y"), "u").count() == 0


def test_leak_report(spark):
    none = spark.createDataFrame([], "entity string, time int, n bigint")
    flags = spark.createDataFrame([("a", "L?")], "group string, level string")
    t = spark.createDataFrame([("f", 40, 0.1, False)], "feature string, n bigint, separation double, leaks boolean")
    out = {r.check: r.clean for r in leak.leak_report(flags, spark.createDataFrame([], "group string"), t, none).collect()}
    assert all(out.values()) and len(out) == 5


def test_dig_and_codes(spark):
    df = spark.createDataFrame([('{"a":{"b":[10,{"c":7}]}}', "9"), (None, None), ("broken", "1")], "raw string, code string")
    out = df.select(*(gate.dig(F.col("raw"), p) for p in ("a.b.1.c", "a.b.0", "a.x.y")), gate.apply_code_map(F.col("code"), {"1": "G1"})).collect()
    assert [tuple(r) for r in out] == [("7", "10", None, "?9"), (None, None, None, None), (None, None, None, "G1")]


def test_completeness_gate(spark):
    def passed(rows, ids=("1", "2")):
        df = spark.createDataFrame(rows, "id string, odds double, pad string, code string, err string")
        want = spark.createDataFrame([(i,) for i in ids], "i string")
        out = {(r.check, r.field): r for r in gate.completeness_gate(df, "id", ["odds"], ["pad"], ["code"], want, "err").collect()}
        return not out["passed", None].fails, out

    ok, out = passed([("1", 1.0, None, "?9", None), ("2", 2.0, "", "G1", None), ("3", 2.0, "x", "G1", None)])
    assert ok and out["empty", "pad"].n == 2 and out["unknown_code", "code"].n == 1 and out["unexpected", None].n == 1
    assert not passed([("1", None, "x", "G1", None), ("2", 2.0, "x", "G1", None)])[0]
    assert not passed([("1", 1.0, "x", "G1", None), ("2", None, None, None, "Timeout: x")])[0]
    assert not passed([("1", 1.0, "x", "G1", None)])[0]
    assert passed([], ids=())[0]


def test_completeness_gate_of_sparse_ids(spark):
    """Ids far apart in a range of 10**15: what is expected can't be laid out row by row."""
    far = range(1, 10**15 + 1)
    for kind in ("bigint", "string"):
        df = spark.createDataFrame([(k, 1.0) for k in (1, 10**9, 10**9, 10**15, 10**15 + 7)], "id bigint, odds double").withColumn("id", F.col("id").cast(kind))
        out = {r["check"]: (r.n, r.fails) for r in gate.completeness_gate(df, "id", ["odds"], expected=far).collect()}
        assert out == {"missing": (0, False), "uncollected": (10**15 - 3, True), "unexpected": (1, False), "passed": (1, True)}
    odd = spark.createDataFrame([("01",), ("2",), (None,), ("x",)], "id string").withColumn("odds", F.lit(1.0))
    for want in (range(1, 4), spark.range(1, 4).toDF("i")):
        assert {r["check"]: r.n for r in gate.completeness_gate(odd, "id", ["odds"], expected=want).collect()} == {"missing": 0, "uncollected": 2, "unexpected": 3, "passed": 1}
    with pytest.raises(ValueError):
        gate.completeness_gate(odd, "id", [], expected=range(1, 9, 2))


def states(spark, rows):
    return spark.createDataFrame(rows, "id string, odds double, pool array<string>, budget double")


def test_actions(spark):
    act = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cost"), F.lit("x").alias("legs"))
    policy = [
        ("one", F.col("odds") > 1, F.array(act("scale_up", 60.0))),
        ("two", F.col("odds") > 1, F.array(act("scale_up", 60.0), act("hold", 40.0))),
        ("bad", F.expr("try_divide(1, cast(odds as int)) < 0"), F.array(act("never", 1.0))),
    ]
    s = states(spark, [("s", 2.0, ["a"], 100.0), ("z", 0.0, [], 99.0)])
    a = action.generate(s, "id", policy)
    b = action.generate(s, "id", policy[::-1])
    assert {(r.state, r.action_key) for r in a.collect()} == {(r.state, r.action_key) for r in b.collect()}
    got = {(r.state, r.action.kind if r.action else None): r.rules for r in a.collect()}
    assert got["s", "scale_up"] == ["one", "two"] and got["z", None] == ["bad"]

    def violated(limit, pairs=(("scale_up", "scale_down"),), fields=("legs",), n=2):
        inv = [action.no_duplicate(), action.budget("cost", F.lit(limit)), action.required_fields(list(fields)), action.not_contradict("kind", list(pairs)), action.expected_count(F.lit(n), "warn")]
        return action.check(a, s, "id", inv).filter("state = 's'")

    assert violated(100.0).count() == 0
    assert [r.invariant for r in violated(99.0).collect()] == ["budget"]
    assert [r.invariant for r in violated(100.0, pairs=[("scale_up", "hold")]).collect()] == ["not_contradict"]
    warned = violated(100.0, n=5)
    assert all(r.committed for r in action.run(a, warned).filter("state = 's'").collect())
    assert not any(r.committed for r in action.run(a, violated(99.0)).filter("state = 's'").collect())


def test_action_nulls(spark):
    s = spark.createDataFrame([("s",)], "id string")
    a = spark.createDataFrame([("s", "k1", ("a", None, "")), ("s", "k1", ("a", None, ""))], "state string, action_key string, action struct<kind: string, cost: double, legs: string>")
    inv = [action.no_duplicate(), action.budget("cost", F.lit(1.0)), action.required_fields(["legs"])]
    assert {r.invariant for r in action.check(a, s, "id", inv).collect()} == {"no_duplicate", "budget", "required_fields"}


def test_retrieval(spark):
    docs = spark.createDataFrame([("d1", "Cats", "Cats purr.  Dogs bark! "), ("d2", None, "Birds sing. "), ("d3", "Fish", None)], "id string, title string, text string")
    chunks = retrieve.chunk_documents(docs)
    assert {r.chunk for r in chunks.collect()} == {"Cats. Cats purr.", "Cats. Dogs bark!", "Birds sing."}
    qs = spark.createDataFrame([("q", "dogs dogs"), ("r", "birds"), ("n", "nothing here")], "query_id string, query string")
    top = {(r.query_id, r.rank): r.doc_id for r in retrieve.top_docs(retrieve.bm25_scores(chunks, qs)).collect()}
    assert top == {("q", 1): "d1", ("r", 1): "d2"}
    rnd = random.Random(8)
    words = [f"w{int(rnd.paretovariate(1))}" for _ in range(3000)]
    many = spark.createDataFrame([(f"c{i}", f"d{i % 60}", " ".join(rnd.choices(words, k=12))) for i in range(240)], "chunk_id string, doc_id string, chunk string")
    qs = spark.createDataFrame([(f"q{i}", " ".join(rnd.choices(words, k=8))) for i in range(30)] + [("few", "w2999999"), ("empty", None)], "query_id string, query string")
    full = sorted(map(tuple, retrieve.top_docs(retrieve.bm25_scores(many, qs)).collect()))
    assert sorted(map(tuple, retrieve.bm25_top(many, qs).collect())) == full
    df = spark.createDataFrame([(["a", "b"], ["x", "a"]), (["c"], []), ([], ["a"])], "gold array<string>, got array<string>")
    r = retrieve.retrieval_metrics(df, "gold", "got").first()
    assert (r.n, r.recall, r.mrr) == (2, 0.25, 0.25)


def test_citations(spark):
    data = [("It was A [1] [1].", ["a", "b"], ["a"], "x"), ("B [2] and [9].", ["a", "b"], ["a"], "x"), ("The documents do not contain this information.", ["a"], [], "trap"), ("C [7].", ["a"], [], "trap"), (None, None, None, "x")]
    df = spark.createDataFrame(data, "answer string, got array<string>, gold array<string>, type string")
    out = retrieve.citation_check(df, "answer", F.col("got"), F.col("gold"), F.col("type") == "trap").collect()
    assert [r.citation_ok for r in out] == [True, False, True, False, False]
    assert out[1].out_of_range == 1 and out[1].precision == 0


def test_citations_of_traps(spark):
    data = [("A [1].", ["a", "b"], ["a"]), ("B [2].", ["a", "b"], ["a"]), ("A [1] [2].", ["a", "b"], ["a"]), ("A [1] [9].", ["a", "b"], ["a"]), ("A [1].", ["a"], []), ("A [1].", ["a"], None), ("No.", ["a"], ["a"])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i int, answer string, got array<string>, gold array<string>")
    out = retrieve.citation_check(df, "answer", F.col("got"), F.col("gold"), F.lit(True)).orderBy("i").collect()
    assert [r.citation_ok for r in out] == [True, False, False, True, False, False, False]


def test_traps_are_not_compared_with_judges(spark, tmp_path):
    rows = [("q1", "x", "A [1].", ["a"], ["a"]), ("q2", "unanswerable", "A [1].", ["a"], ["a"]), ("q3", None, "B.", ["a"], ["a"])]
    spark.createDataFrame([(i, t, "q", a, r, g) for i, t, a, r, g in rows], "id string, type string, question string, answer string, retrieved_doc_ids array<string>, gold_doc_ids array<string>").write.parquet(f"{tmp_path}/answers_gemini.parquet")
    spark.createDataFrame([(i, t, "j", 1, "2", "2", "2") for i, t, *_ in rows], "id string, type string, _judge string, judged_at int, faithfulness string, citation string, coverage string").write.parquet(f"{tmp_path}/judged_gemini_by_gemini.parquet")
    assert {(r.machine_ok, r.n) for r in reference.citation_vs_machine(spark, str(tmp_path)).collect()} == {(True, 1), (False, 1)}


def test_judgement(spark):
    df = spark.createDataFrame([('ok {"a": 1} bye',), ("none",), ("{broken",)], "t string")
    assert [r[0] for r in df.select(F.try_variant_get(retrieve.parse_judgement(F.col("t")), "$.a", "int")).collect()] == [1, None, None]


def test_labels(spark):
    df = spark.createDataFrame([("Normal, no alert",), ("an ALERT, not normal",), ("?",), (None,)], "t string")
    assert [r[0] for r in df.select(evaluate.first_word(F.col("t"), {"alert": "alert", "normal": "normal"})).collect()] == ["normal", "alert", "unk", "unk"]
    assert [r[0] for r in spark.createDataFrame([("Positive? negative",), ("pos",), ("x",), (None,)], "t string").select(evaluate.polarity(F.col("t"))).collect()] == ["neg", "pos", "unk", "err"]


def test_paired_ab(spark):
    df = spark.createDataFrame([(f"g{i}", "x" if i % 2 else "y", "p", "p", "q") for i in range(60)] + [("z", "x", None, "p", "p")], "g string, s string, truth string, a string, b string")
    out = {(r.stratum, r.of): r for r in evaluate.paired_ab(df, F.col("g"), F.col("truth"), F.col("a"), F.col("b"), ["s"], iters=50).collect()}
    assert out["all", "B-A"].estimate == -1 and out["all", "B-A"].robust_negative and out["s=x", "A"].n == 30


def test_pairwise_and_sample(spark):
    v = spark.createDataFrame([(f"i{i}", "f", r, (i + (r == "c")) % 3) for i in range(30) for r in "abc"], "item string, axis string, rater string, score int")
    out = {(r.rater_a, r.rater_b): r.kappa for r in evaluate.pairwise_agreement(v).collect()}
    assert out["a", "b"] == 1 and out["a", "c"] < 0
    df = spark.createDataFrame([(i, "alert" if i % 2 else "easy", f"e{i % 4}") for i in range(100)], "id bigint, k string, e string")
    got = evaluate.stratified_sample(df, F.col("k"), F.col("e"), "id", {"alert": 5, "easy": 2}, {"alert": 7, "easy": 60}).groupBy("kind_").count().collect()
    assert {r.kind_: r["count"] for r in got} == {"alert": 7, "easy": 4}


def test_scheme_guard():
    for url in ("file:///etc/passwd", "ftp://x/y"):
        with pytest.raises(ValueError, match="http"):
            records.http_json(url)


def test_harvest(spark):
    def fetch(i):
        if i == "bad":
            raise TimeoutError("late")
        return {"id": i}

    out = {r.id: (r.payload, r.error) for r in records.harvest(spark.createDataFrame([("a",), ("bad",), (None,), ("a",)], "e string"), fetch, retries=1).collect()}
    assert out == {"a": ('{"id": "a"}', None), "bad": (None, "TimeoutError: late")}


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"_model": "m", "1": {"A": "pos", "B": "neg"}, "2": {"A": "unk", "B": None}}))
    assert {(r.id, r.value.A, r.value.B) for r in records.json_by_id(spark, str(tmp_path / "p.json"), "A string, B string").collect()} == {("1", "pos", "neg"), ("2", "unk", None)}
    (tmp_path / "judged_x_by_me.json").write_text(json.dumps({"scores": [{"id": "q1", "citation": [1, 1], "faithfulness": 2}]}))
    r = records.judge_scores(spark, str(tmp_path / "judged_x_by_me.json")).first()
    assert (r.judge, r.id, r.citation, r.faithfulness) == ("me", "q1", "[1, 1]", "2")
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert records.json_lines(spark, str(tmp_path / "l.jsonl"), "id string").filter("id is not null").count() == 2
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert records.json_array(spark, str(tmp_path / "a.json"), "id bigint").count() == 2
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    records.write_json(records.csv_records(spark, str(tmp_path / "c.csv"), "a int, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().b == "x"


def test_streams(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, "up" if i % 2 else "flat", rnd.gauss(1 if i % 2 else 0, 1), f"2025-01-01 00:{i % 60:02d}:00") for i in range(400)]
    df = spark.createDataFrame(rows, "o bigint, k string, v double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode, name):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r[0] if name != "wins" else r.key: r for r in spark.table(name).collect()}

    out = run(monitor.running_sequence(stream, "k", "v", 1.0), "complete", "runs")
    assert out["up"].decided and not out["flat"].decided and out["up"].n == 200
    out = run(monitor.latched_sequence(stream, "k", "v", "o", 1.0), "update", "latch")
    assert out["up"].crossed_at is not None and out["flat"].crossed_at is None
    out = run(monitor.windowed_sequence(stream, "k", "v", "ts", 1.0, window="2 hours", late="10 minutes"), "complete", "wins")
    assert out["up"].n == 200


def test_http_source(spark):
    import http.server
    import threading

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path == "/a"
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(b'{"x": 1}' if ok else b"no")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(records.HttpJson)
    at = f"http://127.0.0.1:{server.server_port}"
    got = {r.url: (r.payload, r.error) for r in spark.read.format("http_json").option("urls", f"{at}/a {at}/b").load().collect()}
    server.shutdown()
    assert got[f"{at}/a"] == ('{"x": 1}', None) and got[f"{at}/b"][0] is None and "404" in got[f"{at}/b"][1]
    with pytest.raises(Exception, match="not an http address"):
        spark.read.format("http_json").option("urls", "file:///etc/hosts").load().collect()


def test_csv_through_the_gate(spark, tmp_path):
    """Read a CSV file, then hold it to the completeness gate."""
    (tmp_path / "c.csv").write_text("id,text,level\n1,a,x\n2,,?9\n4,d,\n")
    rows = records.csv_records(spark, str(tmp_path / "c.csv"), "id bigint, text string, level string")
    found = gate.completeness_gate(rows, "id", ["text"], ["level"], ["level"], expected=spark.range(1, 5).withColumnRenamed("id", "i"))
    got = {(r["check"], r.field): (r.n, r.fails) for r in found.collect()}
    assert got["missing", "text"] == (1, True) and got["empty", "level"] == (1, False) and got["uncollected", None] == (1, True) and got["passed", None][1]


def test_replay_through_the_judge(spark, tmp_path):
    """Saved predictions, keyed by id with notes about the file, judged against the labels."""
    (tmp_path / "p.json").write_text('{"_model": "m", ' + ", ".join(f'"{k}": {{"A": "normal", "B": "{"alert" if k % 2 else "normal"}"}}' for k in range(40)) + "}")
    saved = records.json_by_id(spark, str(tmp_path / "p.json"), "A string, B string").select("id", "value.*")
    labels = spark.range(40).selectExpr("cast(id as string) as id", "if(id % 2 = 1, 'alert', 'normal') as label", "'k' as kind")
    rows = labels.join(saved, "id")
    got = {r["of"]: r for r in evaluate.paired_ab(rows, F.col("id"), F.col("label"), F.col("A"), F.col("B"), [], rule=F.lit("alert"), iters=200).collect()}
    assert (got["A"].estimate, got["B"].estimate, got["B-A"].estimate, got["B-rule"].estimate) == (0.5, 1.0, 0.5, 0.5) and got["B-A"].robust_positive
    report = evaluate.ab_report(rows, F.col("id"), F.col("label"), F.col("A"), F.col("B"), iters=200).first()
    assert report.finding == "better" and report.verdict == "adopt" and report.n == 40
    assert evaluate.ab_errors(rows, "id", F.col("label"), F.col("A"), F.col("B")).groupBy("of").count().collect() == [("A", 20)]
    none = evaluate.ab_report(rows.filter("false"), F.col("id"), F.col("label"), F.col("A"), F.col("B"), iters=20)
    assert none.count() == 0


def test_pairs_without_draws_as_rows(spark, monkeypatch):
    """Pairs of raters over more groups than are sent to every executor get the same rows, and no draw becomes a row."""
    votes = spark.range(360).selectExpr("cast(id % 60 as string) as item", "'f' as axis", "concat('r', id div 60) as rater", "cast(hash(id) % 3 as int) as score").filter("rater <> 'r5' or item < '15'")
    rows = lambda: sorted(map(tuple, evaluate.pairwise_agreement(votes, iters=50).collect()))
    want = rows()
    assert len(want) == 10 and all(r[3] == 60 for r in want)  # r5 shares too few items
    monkeypatch.setattr(evaluate, "_BROADCAST_COMPARED", 0)
    monkeypatch.setattr(resample, "_joined_replicates", None)
    monkeypatch.setattr(resample.replicates, "__defaults__", (2000, 42, None, 10, 4_000_000))
    assert rows() == want


def test_ablation_without_draws_as_rows(spark, monkeypatch):
    votes = spark.range(240).selectExpr("cast(id % 60 as string) as item", "if(id % 2 = 0, 'f', 'g') as axis", "concat('r', id div 60) as rater", "cast(hash(id) % 3 as int) as score")
    rows = lambda: sorted(map(tuple, evaluate.ablation(votes, votes.withColumn("score", F.lit(1)), ["f"], iters=50).collect()))
    want = rows()
    assert len(want) == 4
    monkeypatch.setattr(resample, "_joined_replicates", None)
    monkeypatch.setattr(resample.replicates, "__defaults__", (2000, 42, None, 10, 4_000_000))
    assert rows() == want


def test_hot_group_and_placeholder_entity(spark):
    """One group and one entity with nine tenths of the rows give what a plain count over all pairs gives."""
    rnd = random.Random(8)
    data = [(k, "hot" if rnd.random() < 0.9 else f"g{k % 5}", "unknown" if rnd.random() < 0.9 else f"e{k % 7}", f"2025-01-{rnd.randrange(1, 5):02d} {rnd.randrange(24):02d}:00:00", rnd.random(), float(rnd.randrange(4))) for k in range(300)]
    df = spark.createDataFrame(data, "u int, g string, e string, t string, b double, l double").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.group: r.level for r in leak.reappearance_flags(df, "g", "e", "t", "b", "u", "l").collect()}
    for g in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == g), key=lambda r: r[4])
        t0 = min(r[3] for r in own)
        later = [[x[5] for x in data if x[2] == r[2] and x[3] > t0] for r in own]
        up = [bool(x) and max(x) > r[5] for r, x in zip(own, later)]
        want = "H" if up[0] else "M" if any(up[:3]) or sum(up) >= 2 else "L?" if sum(bool(x) for x in later) >= 2 else "L"
        assert got[g] == want, g

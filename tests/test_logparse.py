"""Entries from log lines of all layouts, and the awkward cases."""

import datetime as dt

from pyspark.sql import functions as F

from assay.operators import logparse
from assay.operators.loglex import Line, Masks, lex, slot_plans
from assay.operators.logparse import mine_templates, parse_log, shapes_of, template_plans

AT = dt.datetime(2025, 1, 2, 8, 0, 0)
SCHEMA = "id bigint, stream string, line_no bigint, received timestamp_ntz, text string"

CASES = [
    ("E0102 07:59:58.499700  1274 wal_writer.cc:17] boom", "2025-01-02T07:59:58", "ERROR", "wal_writer.cc"),
    ("I1231 23:59:58.1 77 quorum.cc:1] last year", "2024-12-31T23:59:58", "INFO", "quorum.cc"),
    ("[Thu Jan 02 03:08:12.133017 2025] [rewrite:trace1] [pid 31] x", "2025-01-02T03:08:12", "DEBUG", "rewrite"),
    ("02.01.2025 07:16:58 | WARNING  | image_registry | x | y", "2025-01-02T07:16:58", "WARN", "image_registry"),
    ("02.01.2025 07:16:58\t|\tCRITICAL\t|\tgateway\t|\tx", "2025-01-02T07:16:58", "FATAL", "gateway"),
    ("1735804800 2025.01.02 R1-M0-N1 2025-01-02-08.00.00.1 R1-M0-N1 RAS KERNEL SEVERE x", "2025-01-02T08:00:00", "ERROR", "KERNEL"),
    ('time=2025-01-02T14:46:46+09:00 lvl=panic pid=3 component=gateway msg="level=ERROR expected \\"q\\" level=info"', "2025-01-02T05:46:46", "FATAL", "gateway"),
    ('ts=2025-01-02T07:46:46.5-0130 svc=probe level=notice msg="x"', "2025-01-02T09:16:46", "INFO", "probe"),
    ("2025-01-02 05:59:26,888 \x1b[32mINFO\x1b[0m [pool-3-thread-30] org.velmar.Lease - x", "2025-01-02T05:59:26", "INFO", "org.velmar.Lease"),
    ("2025-01-02 05:59:26.888 TRACE [main] a.B - x\r", "2025-01-02T05:59:26", "DEBUG", "a.B"),
    ("2025-01-02T08:22:25Z routed-lite: level=ERROR x", "2025-01-02T08:22:25", "", "routed-lite"),
    ("<133>Jan  2 07:23:39 node-5 mirror-sync[16105]: x", "2025-01-02T07:23:39", "INFO", "mirror-sync"),
    ("<14>1 2025-01-02T15:18:28.850+05:30 node-42 ledgerd 18321 ID49 [meta@32473 seq=\"4768\"] x", "2025-01-02T09:48:28", "INFO", "ledgerd"),
    ("<8>1 2025-01-02T15:18:28Z node-42 ledgerd - - - x", "2025-01-02T15:18:28", "FATAL", "ledgerd"),
    ('{"time": 1735804800123, "level": 40, "ctx": {"level": 10}, "logger": "flag-service", "message": "x"}', "2025-01-02T08:00:00", "WARN", "flag-service"),
    ('{"severity":"crit","component":"g","message":"y","@timestamp":"2025-01-02T04:07:41-05:00"}', "2025-01-02T09:07:41", "FATAL", "g"),
]


def lines(spark, texts, stream="s", start=1):
    return spark.createDataFrame([(start + i, stream, start + 10 * i, AT, t) for i, t in enumerate(texts)], SCHEMA)


def entries(df, **how):
    return [r.asDict() for r in parse_log(df, **how).orderBy("stream", "first_id").collect()]


def test_layouts(spark):
    got = entries(lines(spark, [c[0] for c in CASES]))
    assert [(e["ts"], e["level"], e["component"]) for e in got] == [c[1:] for c in CASES]
    assert all(e["first_id"] == e["last_id"] for e in got)


def test_continuation(spark):
    texts = [
        "\tat lost.Head(X.java:1)", "{", '  "ts": "2025-01-02T07:00:00Z",', '  "ctx": {', '    "level": 60', "  },", '  "lvl": "warn",', '  "comp": "probe",', '  "msg": "hello"', "}",
        "  > 2024-12-26 09:59:05,750 ERROR [main] a.B - quoted", "", "end of quote", "2025-01-02T08:22:25Z a: x", "second line",
    ]
    df = lines(spark, texts)
    got = entries(df.unionByName(df), message=True)
    assert [(e["first_id"], e["last_id"], e["ts"], e["level"], e["component"], e["n_lines"]) for e in got] == [(2, 13, "2025-01-02T07:00:00", "WARN", "probe", 12), (14, 15, "2025-01-02T08:22:25", "", "a", 2)]
    assert got[1]["message"] == "x\nsecond line"


def test_blocks_carry_over(spark):
    texts = ["2025-01-02T08:22:25Z a: x"] + ["more"] * 40 + ["2025-01-02T08:22:26Z b: x"]
    for size in (1, 7, 100000):
        got = entries(lines(spark, texts), block_lines=size, broadcast_shapes=0 if size == 7 else 1000)
        assert [(e["first_id"], e["last_id"]) for e in got] == [(1, 41), (42, 42)]


def test_odd_rows(spark):
    assert entries(lines(spark, []).filter("id > 0")) == []
    odd = spark.createDataFrame(
        [(1, "s", 1, None, "E0102 07:59:58.4 12 a.cc:17] no year known"), (2, "s", 2, AT, None), (3, None, 3, AT, "2025-01-02T08:22:25Z a: x"), (4, "s", None, AT, "x"), (None, "t", 1, AT, "2025-99-02T08:22:25Z a: bad month")],
        SCHEMA,
    ).withColumns({"head": F.lit(1), "block": F.lit("x"), "shape": F.lit("y"), "layout": F.lit("z")})
    got = entries(odd)
    assert [(e["first_id"], e["last_id"], e["ts"]) for e in got] == [(1, 2, None), (None, None, None)]


def test_very_long_lines(spark):
    texts = ["2025-01-02T08:22:25Z a: " + "word-" * 60000, "<14>1 2025-01-02T15:18:28Z n d - - [" + "x" * 60000 + "] m", 'ts=2025-01-02T07:46:46Z svc=p level=info msg="' + "y z " * 40000 + '"', "|" * 50000]
    got = entries(lines(spark, texts))
    assert [e["component"] for e in got] == ["a", "d", "p"]


def test_templates(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES] + [("plain words here",), ("\tat a.b",)], "text string")
    mined = mine_templates(shapes_of(df))
    rows = mined.collect()
    assert sum(r.n for r in rows) == len(CASES)  # lines that can't begin an entry make no shape
    assert all(len(r.template.split("\t")) == len(r["shape"].split("\t")) for r in rows)
    assert template_plans(mined).count() == len(rows)


UNSEEN = [
    ("March 4, 2024 10:11:12 AM org.apache.Foo bar", "2024-03-04T10:11:12", "", "org.apache.Foo"),
    ("WARN 2024-03-04 10:11:12 [core] disk full", "2024-03-04T10:11:12", "WARN", "core"),
    ('127.0.0.1 - frank [04/Mar/2024:10:11:12 +0000] "GET / HTTP/1.1" 200 12', "2024-03-04T10:11:12", "", ""),
    ("Mon Mar  4 10:11:12 2024 core: ERROR boom", "2024-03-04T10:11:12", "ERROR", "core"),
    ("Mar  4 10:11:12 host sshd[12]: session opened", "2024-03-04T10:11:12", "", "sshd"),
    ("10:11:12.333 2024-03-04 WARN core - hello", "2024-03-04T10:11:12", "WARN", "core"),
    ("20240304T101112Z ERROR core boom", "2024-03-04T10:11:12", "ERROR", "core"),
    ("2024/03/04 10:11:12 payments[77] WARN disk full", "2024-03-04T10:11:12", "WARN", "payments"),
    ("[2024-03-04 10:11:12,123] {scheduler.py:77} INFO - task started", "2024-03-04T10:11:12", "INFO", "scheduler.py"),
    ('{"sev": "WARN", "at": "2024-03-04T10:11:12Z", "module": "m", "text": "x"}', "2024-03-04T10:11:12", "WARN", "m"),
]


def test_layouts_nobody_listed(spark):
    got = entries(lines(spark, [c[0] for c in UNSEEN]))
    assert [(e["ts"], e["level"], e["component"]) for e in got] == [c[1:] for c in UNSEEN]


def test_slots_follow_from_all_lines_of_a_template(spark, monkeypatch):
    """A word beside the time is a component if the template's lines repeat it, and part of the message if they don't."""
    words = "disk queue cache shard relay mirror probe batch ledger tenant".split()
    same = [f"2024-03-04 10:11:{k:02d} (1) {'alpha' if k % 2 else 'beta'} 7 {w}" for k, w in enumerate(words)]
    other = [f"2024-03-04 10:11:{k:02d} (1) {w} 7 full" for k, w in enumerate(words)]
    masks = Masks()
    plan = lambda texts: slot_plans([Line(1, t, [masks[x] for x in t]) for t in map(lex, texts)])[0].component
    assert plan(same) != (-1, -1) and plan(other) == (-1, -1)
    # The miner decides: without it, every shape stands for itself and its few lines name no component.
    kinds = ["disk", "12", "x1", "IO"]
    texts = [f"2024-03-04 10:11:12 alpha {a} {b} {c}" for a in kinds[:2] for b in kinds for c in kinds]
    mined = [e["component"] for e in entries(lines(spark, texts))]
    monkeypatch.setattr(logparse, "mine_templates", lambda s: s.withColumns({"leaf": F.col("shape"), "template": F.col("shape")}))
    alone = [e["component"] for e in entries(lines(spark, texts))]
    assert mined == ["alpha"] * 32 and alone == [""] * 32


def test_all_lines_of_a_template_decide(spark):
    """Not a few of them, in whatever order and however often they come."""
    words = "disk queue cache shard relay mirror probe batch ledger tenant".split()
    days = [f"03/{13 if k == 41 else 4:02d}/2025 08:00:{k % 60:02d} core: full" for k in range(80)]
    named = [f"2024-03-04 10:11:{k:02d} (1) {'alpha' if k % 2 else 'beta'} 7 {w}" for k, w in enumerate(words)]
    prose = [f"2024-03-04 10:12:{k:02d} (1) (2) {words[k % 10]} 7 full" for k in range(40)]
    texts = [*days, *named, *prose, "12 disks failed", "1735804800 disks failed"]
    df = lines(spark, texts).coalesce(1)
    got = entries(df)
    at = {e["first_id"]: e for e in got}
    assert [at[1 + k]["ts"][:10] for k in range(80)] == ["2025-03-13" if k == 41 else "2025-03-04" for k in range(80)]
    assert [at[81 + k]["component"] for k in range(10)] == ["beta", "alpha"] * 5
    assert [at[91 + k]["component"] for k in range(40)] == [""] * 40
    assert at[132]["ts"] == "2025-01-02T08:00:00"  # also if the first line of its shape has no time
    assert entries(df.unionByName(df).orderBy(F.desc("id"))) == got


def test_many_shapes_are_joined(spark):
    texts = [c[0] for c in CASES + UNSEEN] + ["  more", "and more"]
    few, many = entries(lines(spark, texts)), entries(lines(spark, texts), broadcast_shapes=0)
    assert few == many and len(few) == len(CASES) + len(UNSEEN)


def test_hot_stream(spark):
    """One stream with nearly all rows: no task reads more than a block of it."""
    rows = spark.range(20_000).selectExpr("id", "if(id % 10 < 9, 'hot', concat('s', id % 7)) as stream", "id as line_no", "timestamp_ntz'2025-01-02 08:00:00' as received", "if(id % 4 = 0, '2025-01-02T08:22:25Z a: x', 'more') as text")
    got = parse_log(rows, block_lines=500)
    assert got.count() == 5_000 and got.filter("first_id > last_id").count() == 0
    whole = parse_log(rows, block_lines=1_000_000)
    assert got.exceptAll(whole).count() == 0

"""Log lines of several programs into one record per entry.

Lines are cut into tokens and reduced to shapes (what is a number, a word, a level or punctuation). The distinct shapes
that could begin an entry, with counts of the values that their slots before the message take in all lines, are
partitioned iteratively by token count, least-variable position and token bijections. Each leaf is a template: constant
tokens and variable slots. By the values that a template's slots take it is decided which of them are time, level and
component, and whether lines with that template begin an entry at all; there is no list of programs or layouts. Then each
line is read again, in order, and its fields are taken by the positions that its template gives.

Lines follow their entry over blocks of line numbers, so that a stream with most of the rows is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.loglex import LEVEL_KEYS, MESSAGES, NAME_KEYS, SAY_KEYS, TIME_KEYS, TIMES, YEARLESS, Head, Masks, Plan, Values, head_plans, level_name, lex, places, plan_of, read_time, time_at, time_text
from assay.sources.tables import cut

_SEP = "\x01"
_TAB = "\t"
_COLOUR = re.compile("\x1b\\[[0-9;]*[A-Za-z]")
_AT = ("kind", "notation", "i", "j")


def clean(text: str | None) -> str:
    """Without colour codes and carriage returns; a null text is an empty one."""
    t = text or ""
    if "\x1b" in t:
        t = _COLOUR.sub("", t)
    return t.replace("\r", "") if "\r" in t else t


def shapes_of(texts: DataFrame) -> DataFrame:
    """From (text): (shape, n, heads), the shapes that can begin an entry, the number of their lines that have a time, and
    what is counted of all of these. A task sends one row per shape, or several if it counts very many values; a shape has
    a head for each of these rows and each place and notation of its time."""

    word = pa.struct([("k", pa.int32()), ("v", pa.string()), ("n", pa.int64()), ("rest", pa.int64()), ("several", pa.bool_())])
    head = pa.struct([
        ("kind", pa.string()), ("notation", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("head", pa.string()), ("n", pa.int64()), ("line", pa.string()),
        ("late", pa.int32()), ("said", pa.list_(pa.int64())), ("words", pa.list_(word)),
    ])
    fields = pa.schema([("shape", pa.string()), ("n", pa.int64()), ("heads", pa.list_(head))])

    def packed(h: Head) -> dict:
        words = [{"k": k, "v": v, "n": n, "rest": rest, "several": several} for (k, v), (n, rest, several) in h.words.items()]
        return dict(zip(_AT, h.at)) | {"head": _TAB.join(h.masks[: h.to]), "n": h.n, "line": h.line, "late": h.late, "said": list(h.said), "words": words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, values, found, begins, held = Masks(), Values(), {}, {}, 0

        def frame() -> pa.RecordBatch:
            of = [list(e.values()) for e in found.values()]
            columns = [pa.array(list(found), pa.string()), pa.array([sum(h.n for h in e) for e in of], pa.int64()), pa.array([[packed(h) for h in e] for e in of], pa.list_(head))]
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        for b in batches:
            for text in b.column(0).to_pylist():
                line = clean(text)
                if not line or line[0] in " \t":  # indented lines continue an entry
                    continue
                tokens = lex(line)
                kinds = [masks[t] for t in tokens]
                shape = _TAB.join(kinds)
                begin = begins.get(shape)
                if begin is None:
                    begin = places(kinds)
                    if len(shape) < 1000:
                        if len(begins) > 200_000:
                            begins.clear()
                        begins[shape] = begin
                at = time_at(line, tokens, *begin) if begin[0] else None
                if at is None:
                    continue
                e = found.setdefault(shape, {})
                h = e.get(at)
                if h is None:
                    h = e[at] = Head(at, kinds)
                    held += 10 + len(shape) // 64
                before = len(h.words)
                h.add(line, tokens, values)
                held += len(h.words) - before
            if held > 1_000_000:
                yield frame()
                found, held = {}, 0
        yield frame()

    schema = (
        "shape string, n bigint, heads array<struct<kind: string, notation: string, i: int, j: int, head: string, n: bigint, line: string, late: int, said: array<bigint>, "
        "words: array<struct<k: int, v: string, n: bigint, rest: bigint, several: boolean>>>>"
    )
    return texts.mapInArrow(run, schema).groupBy("shape").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("heads")).alias("heads"))


def mine_templates(shapes: DataFrame) -> DataFrame:
    """Iterative partitioning of distinct shapes (shape, n...) into leaves: adds leaf and template.

    Partition 1 is the token count, 2 the value at the position with the fewest values (at least two; the leftmost of
    equals), 3 the relation of the two positions with the most frequent number of values: one-to-one pairs split by the
    pair, one-to-many by the one, many-to-many stay together. A template has * at each variable slot. No shapes give no
    templates; equal shapes are expected once."""

    def positions(df: DataFrame) -> DataFrame:
        long = df.select("leaf", F.posexplode("tokens").alias("pos", "token"))
        return long.groupBy("leaf", "pos").agg(F.count_distinct("token").alias("card"))

    df = shapes.select("shape", F.split("shape", _TAB).alias("tokens")).withColumn("leaf", F.size("tokens").cast("string"))
    best = positions(df).filter("card > 1").groupBy("leaf").agg(F.min_by("pos", F.struct("card", "pos")).alias("at"))
    split = F.when(F.col("at").isNull(), F.col("leaf")).otherwise(F.concat_ws("\x02", "leaf", F.get("tokens", F.col("at"))))
    df = cut(df.join(best, "leaf", "left").withColumn("leaf", split).drop("at"))
    card = positions(df).filter("card > 1")
    mode = card.groupBy("leaf", "card").agg(F.count("*").alias("k")).groupBy("leaf").agg(F.max_by("card", F.struct("k", -F.col("card"))).alias("card"))
    pair = card.join(mode, ["leaf", "card"]).groupBy("leaf").agg(F.array_sort(F.collect_list("pos")).alias("ps")).filter("size(ps) > 1").select("leaf", F.get("ps", F.lit(0)).alias("p1"), F.get("ps", F.lit(1)).alias("p2"))
    df = cut(df.join(pair, "leaf", "left").withColumns({"v1": F.get("tokens", F.col("p1")), "v2": F.get("tokens", F.col("p2"))}))
    several = lambda a, b, name: df.filter("p1 is not null").groupBy("leaf", a).agg((F.count_distinct(b) > 1).alias(name))
    df = df.join(several("v1", "v2", "m12"), ["leaf", "v1"], "left").join(several("v2", "v1", "m21"), ["leaf", "v2"], "left")
    key = (
        F.when(F.col("p1").isNull() | (F.col("m12") & F.col("m21")), "")
        .when(~F.col("m12") & ~F.col("m21"), F.concat_ws("\x03", "v1", "v2"))
        .when(F.col("m12"), F.col("v1"))
        .otherwise(F.col("v2"))
    )
    df = cut(df.withColumn("leaf", F.concat_ws("\x02", "leaf", key)).select("leaf", "shape", "tokens"))
    slots = (
        df.select("leaf", F.posexplode("tokens").alias("pos", "token"))
        .groupBy("leaf", "pos")
        .agg(F.when(F.count_distinct("token") == 1, F.first("token")).otherwise("*").alias("slot"))
        .groupBy("leaf")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "slot"))).alias("slots"))
        .select("leaf", F.array_join("slots.slot", _TAB).alias("template"))
    )
    return shapes.join(df.join(slots, "leaf").select("shape", "leaf", "template"), "shape")


_PLAN = "struct<kind: string, notation: string, day_first: boolean, time: array<int>, level: array<int>, level_form: string, component: array<int>, message: array<int>, head: array<string>>"

_PAIR, _NAME = pa.list_(pa.int32()), pa.string()
_PLANS = pa.list_(pa.struct([
    ("kind", _NAME), ("notation", _NAME), ("day_first", pa.bool_()), ("time", _PAIR), ("level", _PAIR), ("level_form", _NAME), ("component", _PAIR), ("message", _PAIR), ("head", pa.list_(_NAME)),
]))


def _pack(p: Plan) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in p._asdict().items()}


def _unpack(row) -> Plan:
    get = row.__getitem__
    two = lambda k: tuple(int(x) for x in get(k))
    return Plan(get("kind"), get("notation"), bool(get("day_first")), two("time"), two("level"), get("level_form"), two("component"), two("message"), tuple(get("head")))


def template_plans(mined: DataFrame) -> DataFrame:
    """(shape, plan) of the mined shapes: what their template's slots hold, decided from the counts of all its lines. A
    shape has its time where most of its lines have it."""
    counted = mined.select("leaf", "shape", F.explode("heads").alias("h"))
    key = ["leaf", *_AT, "head"]
    heads = counted.select("leaf", "h.*")
    # Counts of a template's heads add up before they meet in one task, so that its shapes and lines don't.
    words = (
        heads.select(*key, F.explode("words").alias("w")).groupBy(*key, "w.k", "w.v")
        .agg(F.sum("w.n").alias("n"), F.min("w.rest").alias("rest"), (F.bool_or("w.several") | F.coalesce(F.min("w.rest") != F.max("w.rest"), F.lit(False))).alias("several"))
        .groupBy(*key).agg(F.collect_list(F.struct("k", "v", "n", "rest", "several")).alias("words"))
    )
    said = heads.select(*key, F.explode("said").alias("said")).groupBy(*key).agg(F.collect_set("said").alias("said"))
    whole = heads.groupBy(*key).agg(F.sum("n").alias("n"), F.min("line").alias("line"), F.bit_or("late").alias("late"))
    whole = whole.join(words, key, "left").join(said, key, "left")
    of = whole.groupBy("leaf").agg(F.collect_list(F.struct(*_AT, "n", "line", "late", F.slice("said", 1, MESSAGES).alias("said"), "words")).alias("heads"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = Masks()
        for b in batches:
            for leaf, rows in zip(b.column("leaf").to_pylist(), b.column("heads").to_pylist()):
                found = []
                for r in rows:
                    tokens = lex(r["line"])
                    h = Head(tuple(r[c] for c in _AT), [masks[t] for t in tokens])
                    h.tokens, h.n, h.late, h.said = tokens, r["n"], r["late"], set(r["said"] or ())
                    h.words = {(w["k"], w["v"]): [w["n"], w["rest"], w["several"]] for w in r["words"] or ()}
                    found.append(h)
                plans = pa.array([[_pack(p) for p in head_plans(found)]], _PLANS)
                yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.string()), plans], names=["leaf", "plans"])

    plans = cut(of.mapInArrow(decide, f"leaf string, plans array<{_PLAN}>"))
    votes = counted.groupBy("leaf", "shape", *(f"h.{c}" for c in _AT)).agg(F.sum("h.n").alias("n"))
    placed = votes.groupBy("leaf", "shape").agg(F.max(F.struct("n", *_AT)).alias("at")).select("leaf", "shape", *(f"at.{c}" for c in _AT))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            shapes, out = [], []
            for leaf, shape, plans, *at in zip(b["leaf"], b["shape"], b["plans"], *(b[c] for c in _AT)):
                if leaf not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[leaf] = [_unpack(p) for p in plans]
                p = plan_of(known[leaf], shape.split(_TAB), tuple(at))
                if p:
                    shapes.append(shape)
                    out.append(_pack(p))
            yield pd.DataFrame({"shape": shapes, "plan": out})

    return placed.join(plans, "leaf").mapInPandas(choose, f"shape string, plan {_PLAN}")


class _Entry:
    """The entry that lines are added to, within one block."""

    __slots__ = ("h", "first_id", "last_id", "last_line", "n", "ts", "level", "component", "opened", "kv", "said")

    def __init__(self, h=None, first_id=None, ts=None, level="", component="", opened=False):
        self.h, self.first_id, self.ts, self.level, self.component, self.opened = h, first_id, ts, level, component, opened
        self.last_id, self.last_line, self.n, self.kv, self.said = None, None, 0, {}, []


_ROLE = {k: "time" for k in TIME_KEYS} | {k: "level" for k in LEVEL_KEYS} | {k: "component" for k in NAME_KEYS} | {k: "message" for k in SAY_KEYS}
_TEXT, _LONG, _FLAG = pa.string(), pa.int64(), pa.bool_()
_ENTRY = {
    "stream": _TEXT, "block": _LONG, "h": _LONG, "edge": _FLAG, "first_id": _LONG, "last_id": _LONG, "last_line": _LONG, "n_lines": _LONG, "ts": _TEXT, "level": _TEXT, "component": _TEXT,
    "opened": _FLAG, "k_time": _TEXT, "k_level": _TEXT, "k_component": _TEXT, "said": pa.list_(pa.struct([("line_no", _LONG), ("message", _TEXT)])),
}


def _any_time(value: str, received) -> str | None:
    return next((time_text(read_time(f, value, received)) for f, p in TIMES.items() if p.fullmatch(value)), None)


def _read(plan: Plan, tokens: list[str], received: pa.Scalar | None, times: dict) -> tuple[str | None, str, str]:
    """(ts, level, component) of a line by its template's slots."""
    i, j = plan.time
    ts = None
    if i >= 0:
        raw = "".join(tokens[i:j]).strip()
        if plan.kind == "keys":
            raw = raw.strip('"')
        received = received and received.as_py()
        key = (plan.notation, raw, received)
        if key in times:
            ts = times[key]
        else:
            ts = time_text(read_time(plan.notation, raw, received, plan.day_first)) if plan.notation else _any_time(raw, received)
            if len(times) > 50_000:
                times.clear()
            times[key] = ts
    a, b = plan.level
    level = ""
    if a >= 0:
        raw = "".join(tokens[a:b]).strip()
        level = level_name("P" + raw if plan.level_form == "P" else raw[:1] if plan.level_form == "1" else raw)
    c, d = plan.component
    component = "".join(tokens[c:d]).strip() if c >= 0 else ""
    if plan.kind == "keys":
        component = component.strip('"')
    return ts, level, component


def _said(plan: Plan, tokens: list[str]) -> str:
    a, b = plan.message
    if a < 0:
        return ""
    t = "".join(tokens[a:b]).strip()
    return t[1:-1].replace('\\"', '"') if plan.kind == "keys" and len(t) > 1 and t[0] == t[-1] == '"' else t


def parse_log(
    lines: DataFrame,
    *,
    id: str = "id",
    stream: str = "stream",
    line_no: str = "line_no",
    received: str = "received",
    text: str = "text",
    message: bool = False,
    block_lines: int = 16384,
    broadcast_shapes: int = 200_000,
) -> DataFrame:
    """One row per log entry: stream, first_id, last_id, ts, level, component (and n_lines and message with its further lines).

    An entry begins at a line whose template has a time slot (or opens a JSON object) and ends before the next one of its
    stream. Lines before a stream's first entry belong to none; a repeated row counts once (of different rows with one
    stream and line_no, the one with the greatest id). Rows without stream or line_no have no place and are left out; a
    null text counts as an empty line. ts is null where the time slot holds no valid time, level and component are empty
    where the entry names none. Other columns are ignored. An empty table gives no rows.

    The shapes that begin entries are broadcast with their plans up to broadcast_shapes of them, and joined to the lines by
    a shuffle beyond that. A task reads blocks of block_lines line numbers of one stream, whatever the stream's size."""
    spark = lines.sparkSession
    shapes = cut(shapes_of(lines.filter(F.col(stream).isNotNull() & F.col(line_no).isNotNull()).select(F.col(text).alias("text"))))
    planned = cut(template_plans(mine_templates(shapes)))
    n = F.col(line_no).cast("bigint")
    src = lines.select(
        F.col(stream).alias("stream"), F.floor(n / block_lines).alias("block"), n.alias("line_no"), F.col(id).alias("id"),
        F.col(received).alias("received"), F.col(text).alias("text"),
    ).filter("stream is not null and line_no is not null")
    few = planned.count() <= broadcast_shapes
    if few:
        distinct: dict[Plan, Plan] = {}
        shared = spark.sparkContext.broadcast({r["shape"]: distinct.setdefault(p, p) for r in planned.collect() for p in [_unpack(r["plan"])]})
    else:

        def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            masks = Masks()
            for b in batches:
                yield b.assign(shape=[_TAB.join([masks[t] for t in lex(clean(x))]) for x in b["text"]])

        src = src.mapInPandas(shaped, src.schema.simpleString()[7:-1].replace(":", " ") + ", shape string").join(planned, "shape", "left").drop("shape")
    ordered = src.repartition("stream", "block").sortWithinPartitions("stream", "block", "line_no", F.col("id").desc_nulls_last())

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value if few else None
        masks, times = Masks(), {}
        out: list[tuple] = []
        here = last = fields = None
        at: _Entry | None = None

        def close(edge: bool) -> None:
            k = [at.kv[r][1] if r in at.kv else None for r in ("time", "level", "component")]
            said = at.said if message else None
            if at.opened and not edge:
                ts, level, component = (x and x.split(_SEP, 1)[1] for x in k)
                out.append((*here, at.h, False, at.first_id, at.last_id, at.last_line, at.n, ts or None, level or "", component or "", False, None, None, None, said))
            else:
                out.append((*here, at.h, edge, at.first_id, at.last_id, at.last_line, at.n, at.ts, at.level, at.component, at.opened, *k, said))

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

        for b in batches:
            if fields is None:
                given_as = {"stream": b.schema.field("stream").type, "first_id": b.schema.field("id").type, "last_id": b.schema.field("id").type}
                fields = pa.schema([(c, given_as.get(c, t)) for c, t in _ENTRY.items()])
            seen = b.column("received")
            given = b.column("plan").to_pylist() if not few else [None] * len(b)
            of = zip(*(b.column(c).to_pylist() for c in ("stream", "block", "line_no", "id", "text")), given)
            for row, (s, block, line, i, text, plan) in enumerate(of):
                if (s, block) != here:
                    if at is not None:
                        close(True)
                    here, last, at = (s, block), None, None
                if line == last:
                    continue
                last = line
                t = clean(text)
                tokens = None
                if few:
                    if t and t[0] not in " \t":
                        tokens = lex(t)
                        plan = plans.get(_TAB.join([masks[x] for x in tokens]))
                elif plan is not None:
                    plan, tokens = _unpack(plan), lex(t)
                if plan is not None:
                    if at is not None:
                        close(at.h is None)
                    at = _Entry(line, i, *_read(plan, tokens, seen[row] if plan.notation in YEARLESS else None, times), plan.kind == "open")
                elif at is None:
                    at = _Entry()
                at.last_id, at.last_line, at.n = i, line, at.n + 1
                if message:
                    at.said.append({"line_no": line, "message": _said(plan, tokens) if plan is not None else t})
                if plan is None and (at.opened or at.h is None) and '"' in t:
                    _key_line(at, t, line, seen[row])
            if len(out) > 20_000:
                yield batch()
                out.clear()
        if at is not None:
            close(True)
        if fields is not None:
            yield batch()

    kind = dict(src.dtypes)
    said = "array<struct<line_no: bigint, message: string>>"
    schema = (
        f"stream {kind['stream']}, block bigint, h bigint, edge boolean, first_id {kind['id']}, last_id {kind['id']}, last_line bigint, n_lines bigint, ts string, level string, "
        f"component string, opened boolean, k_time string, k_level string, k_component string, said {said}"
    )
    part = cut(ordered.mapInArrow(entries, schema))
    # Only the first and last entry of a block can be in several: a line without entry goes to the last one of the blocks before.
    edges = part.filter("edge")
    ahead = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = edges.groupBy("stream", "block").agg(F.max("h").alias("top"))
    carry = tops.withColumn("carried", F.last("top", ignorenulls=True).over(ahead)).filter("carried is not null").drop("top")
    late = edges.filter("h is null").join(carry, ["stream", "block"]).withColumn("h", F.col("carried")).drop("carried")
    # Aggregates over several blocks' lines of one entry: ids by line, key lines by indent and line.
    whole = edges.filter("h is not null").unionByName(late).groupBy("stream", "h").agg(
        F.max("first_id").alias("first_id"),
        F.max_by("last_id", "last_line").alias("last_id"),
        F.sum("n_lines").alias("n_lines"),
        *(F.max(c).alias(c) for c in ("ts", "level", "component", "opened")),
        *(F.min(c).alias(c) for c in ("k_time", "k_level", "k_component")),
        F.array_sort(F.flatten(F.collect_list("said"))).alias("said"),
    )
    value = lambda c: F.substring_index(c, _SEP, -1)
    whole = whole.withColumns(
        {
            "ts": F.when(F.col("opened"), F.nullif(value("k_time"), F.lit(""))).otherwise(F.col("ts")),
            "level": F.when(F.col("opened"), F.coalesce(value("k_level"), F.lit(""))).otherwise(F.col("level")),
            "component": F.when(F.col("opened"), F.coalesce(value("k_component"), F.lit(""))).otherwise(F.col("component")),
        }
    )
    kept = ["stream", "first_id", "last_id", "ts", "level", "component", *(["n_lines", "said"] if message else [])]
    every = part.filter("not edge").select(*kept).unionByName(whole.select(*kept))
    return every.withColumn("said", F.array_join("said.message", "\n")).withColumnRenamed("said", "message") if message else every


_KEY_LINE = re.compile(r'(\s*+)"(@?\w+)"\s*+:\s*+"?(.*?)"?,?\s*', re.S)


def _key_line(at: _Entry, text: str, line: int, received) -> None:
    """A key of an opened object gives a field; of keys for the same field the one least indented counts, then the first."""
    m = _KEY_LINE.fullmatch(text)
    role = m and _ROLE.get(m[2])
    if not role or role == "message":
        return
    order = (len(m[1]), line)
    if role in at.kv and at.kv[role][0] <= order:
        return
    value = _any_time(m[3], received.as_py()) if role == "time" else level_name(m[3]) if role == "level" else m[3]
    at.kv[role] = (order, f"{order[0]:06d}{order[1]:019d}{_SEP}{value or ''}")

"""Mapping raw records and gating their completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import cut


def dig(raw: Column, path: str) -> Column:
    """The value at a dotted path of JSON text, as text; segments of digits index arrays; any miss is null."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(raw), f"${steps}", "string")


def apply_code_map(value: Column, codes: dict[str, str]) -> Column:
    """The code's name; an unknown code with a leading question mark; null for null."""
    v = value.cast("string")
    names = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)) if codes else F.lit(None).cast("map<string,string>")
    return F.when(v.isNotNull(), F.coalesce(F.try_element_at(names, v), F.concat(F.lit("?"), v)))


def map_record(df: DataFrame, raw: str, fields: dict[str, tuple[str, str | None]], code_maps: dict[str, dict[str, str]], keep: list[str]) -> DataFrame:
    """The kept columns and one per field (path, name of a code map or null); an unknown map name is ignored."""
    out = []
    for name, (path, codes) in fields.items():
        value = dig(F.col(raw), path)
        out.append((apply_code_map(value, code_maps[codes]) if codes in code_maps else value).alias(name))
    return df.select(*keep, *out)


def missing(c: str) -> Column:
    """Null or, as text, empty."""
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def _unmatched(records: DataFrame, id: str, expected: DataFrame | range) -> DataFrame:
    """One row (uncollected, unexpected): expected ids without a record, and ids of records that nobody expected, as text."""
    i, n = F.col(id).cast("string"), lambda c: F.count_if(c)
    if isinstance(expected, range):
        at = F.col("i").try_cast("bigint")
        inside = F.coalesce((at >= expected.start) & (at < expected.stop) & (at.cast("string") == F.col("i")), F.lit(False))
        if dict(records.dtypes)[id] in ("tinyint", "smallint", "int", "bigint"):  # shorter than their text
            i, inside = F.col(id).cast("bigint"), F.coalesce((F.col("i") >= expected.start) & (F.col("i") < expected.stop), F.lit(False))
        got = records.select(i.alias("i")).distinct()
        return got.agg((F.lit(len(expected)) - n(inside)).alias("uncollected"), n(~inside).alias("unexpected"))
    want = expected.select(F.col(expected.columns[0]).cast("string").alias("i"), F.lit(False).alias("got"), F.lit(True).alias("want"))
    both = records.select(i.alias("i"), F.lit(True).alias("got"), F.lit(False).alias("want")).unionByName(want)
    both = both.groupBy("i").agg(F.max("got").alias("got"), F.max("want").alias("want"))
    alone = F.col("i").isNull()  # a null id is nobody's
    return both.agg(n(F.col("want") & (~F.col("got") | alone)).alias("uncollected"), n(F.col("got") & (~F.col("want") | alone)).alias("unexpected"))


def completeness_gate(records: DataFrame, id: str, required: list[str], optional: list[str] = (), coded: list[str] = (), expected: DataFrame | range | None = None, error: str | None = None) -> DataFrame:
    """(check, field, n, fails) and a row ('passed', null, n of failing checks, fails).

    Missing required fields, fetch errors and expected ids that weren't collected fail; empty optional fields, unknown
    codes and ids that nobody expected don't. Records with an error count only as errors. No records pass. Expected are the
    ids in a frame's first column, or all numbers of a range (with step 1), which is never laid out: what it costs depends
    on the records, however sparse their ids are."""
    if isinstance(expected, range) and expected.step != 1:
        raise ValueError("a range of expected ids must have step 1")
    good = records.filter(F.col(error).isNull()) if error else records
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    checks = [("missing", c, n(missing(c)), True) for c in required] + [("empty", c, n(missing(c)), False) for c in optional] + [("unknown_code", c, n(F.coalesce(F.col(c).startswith("?"), F.lit(False))), False) for c in coded]
    one = good.agg(*(x.alias(f"c{i}") for i, (_, _, x, _) in enumerate(checks)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(c).alias("field"), F.col(f"c{i}").alias("n"), F.lit(f).alias("gates")) for i, (k, c, _, f) in enumerate(checks))))
    rows = one.select(each.alias("e")).select("e.*")
    whole = lambda name, gates: F.struct(F.lit(name).alias("check"), F.lit(None).cast("string").alias("field"), F.col(name).alias("n"), F.lit(gates).alias("gates"))
    add = lambda counts, *checks: rows.unionByName(counts.select(F.explode(F.array(*(whole(*c) for c in checks))).alias("e")).select("e.*"))
    if error:
        rows = add(records.agg(F.count_if(F.col(error).isNotNull()).alias("fetch_error")), ("fetch_error", True))
    if expected is not None:
        rows = add(_unmatched(records, id, expected), ("uncollected", True), ("unexpected", False))
    rows = cut(rows.select("check", "field", "n", (F.col("gates") & (F.col("n") > 0)).alias("fails")))
    verdict = rows.agg(F.sum(F.col("fails").cast("bigint")).alias("n")).select(F.lit("passed").alias("check"), F.lit(None).cast("string").alias("field"), "n", (F.col("n") > 0).alias("fails"))
    return rows.unionByName(verdict)


def verdicts(measures: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """(check, value, side, bound, passed) from one row of measures: most, at most the bound; least, at least it. A null fails."""
    known = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).cast("double").alias("value"), F.lit(side).alias("side"), F.lit(float(v)).alias("bound")) for k, (side, v) in bounds.items())))
    rows = measures.select(known.alias("m")).select("m.*")
    ok = F.when(F.col("side") == "most", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))

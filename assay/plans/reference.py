"""Queries of the verification toolkit over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions import prob
from assay.functions.contract import assert_contract, first_load, group_key
from assay.operators import action, agree, calibrate, evaluate, gate, intervals, leak, overfit, retrieve, scan
from assay.sources.tables import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPLIT = "2025-01-01 00:00:00"
TESTS_Z = 2.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places: sums of doubles depend on the order."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows, each loaded once."""
    df = table(spark, sf_dir, "decisions")
    return assert_contract(first_load(df, "row_id", "loaded"), ["group", "time", "baseline", "outcome"])


def _key() -> Column:
    return group_key(F.col("group"), F.col("row_id"))


def _specs() -> dict[str, Column]:
    return {"weekend": F.col("weekend"), "g1": F.col("grade") == "G1", "high": F.col("level") >= 4, "dear": F.col("cost") >= 2}


_D = "d AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded) = 1)"
_KEY = """coalesce("group", chr(1) || row_id)"""


def _boot(stats: str, by: str = "", iters: int = 2000, seed: int = 42, scale: str = "1", pre: str = "") -> str:
    """Common table expressions num, m, reps, ci of the statistic over `stats` (by, key, num, den)."""
    b, on = (f"{by}, ", f"num.{by.replace(', ', ' = draws.')} = draws.{by}" if "," not in by else " AND ".join(f"num.{c} = draws.{c}" for c in by.split(", "))) if by else ("", "TRUE")
    part = f"PARTITION BY {by}" if by else ""
    return f"""
        {pre}num AS (SELECT {b}key, num, den, row_number() OVER ({part} ORDER BY key) - 1 AS ord FROM {stats}),
        m AS (SELECT {b}count(*) AS m FROM num {"GROUP BY " + by if by else ""}),
        dj AS (SELECT {b}m, unnest(range(m)) AS j FROM m),
        h0 AS (SELECT {b}m, j, i, {_mix("(i + " + str(1000003 * seed) + ") & 4294967295", "h")} FROM dj, range({iters}) t(i)),
        draws AS (SELECT {b}i, {_mix("xor(h, j)", "x")}, x % m AS ord FROM h0),
        reps AS (SELECT {", ".join("draws." + c for c in by.split(", ")) + ", " if by else ""}i, sum(num) / sum(den) AS v FROM draws JOIN num ON draws.ord = num.ord AND {on} GROUP BY ALL),
        ci AS (SELECT {b}list_sort(list(v)) AS vs, {scale} * vs[(floor(0.05 * len(vs)) + 1)::BIGINT] AS lo, {scale} * vs[(floor(0.95 * len(vs)) + 1)::BIGINT] AS hi FROM reps WHERE v IS NOT NULL {"GROUP BY " + by if by else ""})"""


def _mix(of: str, name: str) -> str:
    """Columns of the 32-bit hash of the draws; the last has the name given."""
    u = name + "_"
    return f"({of})::BIGINT AS {u}0, (xor({u}0, {u}0 >> 15) * 739982445) & 4294967295 AS {u}1, (xor({u}1, {u}1 >> 12) * 695872825) & 4294967295 AS {u}2, xor({u}2, {u}2 >> 15) AS {name}"


def _mean_sql(source: str, key: str, value: str, by: str = "", iters: int = 2000) -> str:
    b = f"{by}, " if by else ""
    return f"""
        WITH {source}, r AS (SELECT {b}{key} AS key, {value} AS v FROM src WHERE isfinite({value})),
        stats AS (SELECT {b}key, sum(v) AS num, count(*)::DOUBLE AS den, count(*) AS c FROM r GROUP BY {b}key), {_boot("stats", by, iters)},
        p AS (SELECT {b}sum(c)::BIGINT AS n, count(*) AS n_groups, sum(num) / sum(den) AS estimate FROM stats {"GROUP BY " + by if by else ""})
        SELECT {b}n, n_groups, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, n_groups >= 30 AS reliable,
               lo > 0 AND n_groups >= 30 AS robust_positive, hi < 0 AND n_groups >= 30 AS robust_negative, 'percentile' AS ci_method, 'heavy_tailed_undercoverage' AS ci_caveat
        FROM p {f"JOIN ci USING ({by})" if by else ", ci"}"""


# --- means, returns, sequences, power


@query(_mean_sql("src AS (SELECT * FROM orders)", "o_custkey", "o_totalprice"))
def mean_ci_orders(spark, d):
    """Mean order value, resampled by customer."""
    return rounded(intervals.mean_ci(table(spark, d, "orders"), F.col("o_custkey"), F.col("o_totalprice")))


@query(_mean_sql("src AS (SELECT * FROM events)", "user_id", "value"))
def mean_ci_events(spark, d):
    return rounded(intervals.mean_ci(table(spark, d, "events"), F.col("user_id"), F.col("value")))


@query(_mean_sql(f"{_D}, src AS (SELECT * FROM d)", _KEY, "value"))
def mean_ci_decisions(spark, d):
    """Mean value of decisions; a null group is a group of its own."""
    return rounded(intervals.mean_ci(decisions(spark, d), _key(), F.col("value")))


@query(_mean_sql("src AS (SELECT * FROM events)", "user_id", "value", by="event_type"))
def mean_ci_strata(spark, d):
    """Mean event value within each type, from one job."""
    return rounded(intervals.mean_ci(table(spark, d, "events"), F.col("user_id"), F.col("value"), by=["event_type"]))


@query(f"""
    WITH {_D}, r AS (SELECT {_KEY} AS key, cost, CASE WHEN isfinite(coalesce(payoff, outcome)) THEN coalesce(payoff, outcome) ELSE 0 END AS paid FROM d WHERE isfinite(cost) AND cost > 0),
    stats AS (SELECT key, sum(paid) AS num, sum(cost) AS den, count(*) AS c, sum((paid > 0)::INT) AS h FROM r GROUP BY key), {_boot("stats", scale="100")},
    p AS (SELECT sum(c)::BIGINT AS n, count(*) AS n_groups, 100 * sum(num) / sum(den) AS estimate, sum(h)::BIGINT AS hits FROM stats)
    SELECT n, n_groups, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, n_groups >= 30 AS reliable, lo > 100 AND n_groups >= 30 AS robust_positive, hi < 100 AND n_groups >= 30 AS robust_negative, 'percentile' AS ci_method, 'heavy_tailed_undercoverage' AS ci_caveat, hits FROM p, ci""")
def roi_ci_decisions(spark, d):
    """Return of the decisions acted on."""
    return rounded(intervals.roi_ci(decisions(spark, d), _key(), F.col("cost"), F.coalesce("payoff", "outcome")))


_RADIUS = "{s} * sqrt(2 * (n * 0.25 + 1) / (n::DOUBLE * n * 0.25) * ln(sqrt(n * 0.25 + 1) / 0.1))"


@query(f"""
    WITH s AS (SELECT event_type, count(*) AS n, avg(value - 50) AS mean, stddev_pop(value - 50) AS sd FROM events WHERE isfinite(value) GROUP BY event_type),
    c AS (SELECT *, n < 2 OR sd <= 0 AS degenerate, CASE WHEN n >= 2 AND sd > 0 THEN {_RADIUS.format(s="sd")} END AS r FROM s)
    SELECT event_type, n, round(mean, 6) AS mean, round(sd, 6) AS sigma, round(r, 6) AS radius, round(mean - r, 6) AS lo, round(mean + r, 6) AS hi, degenerate, coalesce(mean - r > 0, FALSE) AS robust_positive,
        coalesce(mean + r < 0, FALSE) AS robust_negative, coalesce(mean - r > 0 OR mean + r < 0, FALSE) AS decided, 'asymptotic' AS validity FROM c""")
def confidence_sequence_events(spark, d):
    return rounded(intervals.confidence_sequence(table(spark, d, "events"), F.col("value") - 50, by=["event_type"]))


@query(f"""
    WITH r AS (SELECT event_type, value - 48 AS x, row_number() OVER w AS n, sum(value - 48) OVER w AS s FROM events WHERE isfinite(value) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT event_type, n, abs(s / n) > {_RADIUS.format(s="30")} AS hit FROM r WHERE n >= 20 AND (n - 20) % 10 = 0)
    SELECT a.event_type, a.n, coalesce(looks, 0) AS looks, crossed_at FROM (SELECT event_type, max(n) AS n FROM r GROUP BY 1) a
    LEFT JOIN (SELECT event_type, count(*) AS looks, min(n) FILTER (WHERE hit) AS crossed_at FROM l GROUP BY 1) b ON a.event_type = b.event_type""")
def sequential_scan_events(spark, d):
    """When the value of each type of event is first seen to differ from 48, looking every ten events."""
    return intervals.sequential_scan(table(spark, d, "events"), F.col("value") - 48, ["ts", "event_id"], by=["event_type"], sigma=30.0)


@query(f"""
    WITH r AS (SELECT event_type, value - 48 AS x, row_number() OVER w AS n, sum(value - 48) OVER w AS s FROM events WHERE isfinite(value) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT event_type, n, s / n AS mean, {_RADIUS.format(s="30")} AS rad, max(n) OVER (PARTITION BY event_type) AS total FROM r)
    SELECT event_type, n, round(mean + 1e-9::DOUBLE, 6) AS mean, round(mean - rad, 6) AS lo, round(mean + rad, 6) AS hi, abs(mean) > rad AS decided, total FROM l WHERE n >= 20 AND (n - 20) % 10 = 0""")
def sequential_checkpoints_events(spark, d):
    """Every look of sequential_scan_events with its interval. Means of values with two places may be exact halves of the
    last place shown, so a billionth is added before rounding, lest the order of sums decides."""
    looks = intervals.sequential_checkpoints(table(spark, d, "events"), F.col("value") - 48, ["ts", "event_id"], by=["event_type"], sigma=30.0)
    return rounded(looks.withColumn("mean", F.col("mean") + 1e-9))


@query("SELECT count(*) AS n, round(stddev_samp(o_totalprice), 6) AS sd, round(pow(2.80158 * stddev_samp(o_totalprice) / 5000, 2), 6) AS need_n, pow(2.80158 * stddev_samp(o_totalprice) / 5000, 2) <= 5000 AS measurable FROM orders WHERE isfinite(o_totalprice)")
def power_mean_orders(spark, d):
    return rounded(intervals.power_mean(table(spark, d, "orders"), F.col("o_totalprice"), 5000.0))


@query(f"""
    WITH {_D}, r AS (SELECT cost AS c, CASE WHEN isfinite(coalesce(payoff, outcome)) THEN coalesce(payoff, outcome) ELSE 0 END AS p FROM d WHERE isfinite(cost) AND cost > 0),
    x AS (SELECT *, (p - c) / (c / 100) AS x FROM r), s AS (SELECT count(*) AS n, sum(p) / sum(c) * 100 AS roi, stddev_samp(x) AS sd, avg(x) AS m, stddev_pop(x) AS sp FROM x),
    k AS (SELECT avg(pow((x - m) / sp, 3)) AS skew FROM x, s)
    SELECT n, round(roi, 6) AS roi, round(sd, 6) AS sd, round(skew, 6) AS skew, round(pow(2.80158 * sd / 10, 2), 6) AS need_n, pow(2.80158 * sd / 10, 2) <= 5000 AS measurable, abs(skew) > 2 AS heavy_tailed FROM s, k WHERE n >= 5 AND sd > 0""")
def power_roi_decisions(spark, d):
    return rounded(intervals.power_roi(decisions(spark, d), F.col("cost"), F.coalesce("payoff", "outcome")))


# --- calibration and scans

_Y = "CASE WHEN isfinite(outcome) THEN outcome ELSE 0.0::DOUBLE END"
_FEATURES = {"weekend": "weekend", "g1": "grade = 'G1'", "high": "level >= 4", "dear": "cost >= 2"}


def _labels(source: str, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS label, {cols} FROM {source} WHERE {c}" for k, c in _FEATURES.items())


def _bins(source: str) -> str:
    return f"(SELECT bin, max(baseline) AS cut, avg(y) AS rate, count(*) AS n FROM (SELECT baseline, {_Y} AS y, least(14, ((row_number() OVER (ORDER BY baseline, row_id) - 1) * 15) // count(*) OVER ()) AS bin FROM {source} WHERE isfinite(baseline)) GROUP BY bin)"


@query(f"WITH {_D} SELECT (row_number() OVER (ORDER BY bin) - 1)::INT AS bin, cut, round(rate, 6) AS rate, n FROM {_bins('d')}")
def calibration_bins_decisions(spark, d):
    return rounded(calibrate.fit(decisions(spark, d), F.col("baseline"), F.col("outcome"), "row_id"))


@query(f"""
    WITH {_D}, b AS (SELECT *, {_Y} AS y, least(14, ((row_number() OVER (ORDER BY baseline, row_id) - 1) * 15) // count(*) OVER ()) AS bin FROM d WHERE isfinite(baseline)),
    q AS (SELECT *, {_KEY} AS key, y - avg(y) OVER (PARTITION BY bin) AS resid FROM b), l AS ({_labels("q", "key, resid")}),
    stats0 AS (SELECT label, key, sum(resid) AS num, count(*)::DOUBLE AS den FROM l GROUP BY ALL),
    p AS (SELECT label, sum(den)::BIGINT AS n, count(*) AS n_groups, sum(num) / sum(den) AS resid FROM stats0 GROUP BY label HAVING count(*) >= 30),
    stats AS (SELECT * FROM stats0 WHERE label IN (SELECT label FROM p)), {_boot("stats", "label", 1000)},
    e AS (SELECT label, stddev_pop(v) AS se FROM reps GROUP BY label)
    SELECT label, n, n_groups, round(resid, 6) AS resid, round(se, 6) AS se, round(CASE WHEN se > 0 THEN resid / se ELSE 0 END, 6) AS z FROM p JOIN e USING (label)""")
def residual_scan_decisions(spark, d):
    return rounded(scan.residual_scan(decisions(spark, d), _specs(), _key(), F.col("baseline"), F.col("outcome"), "row_id"))


def _stages(parts: int) -> str:
    whens = " ".join(f"WHEN time >= (SELECT t FROM cuts WHERE k = {k}) THEN 's{k + 1}'" for k in range(parts - 1, 0, -1))
    ks = ", ".join(f"({k})" for k in range(1, parts))
    return f"""
        WITH {_D}, ts AS (SELECT time AS t, row_number() OVER (ORDER BY time) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM d WHERE time IS NOT NULL)),
        cuts AS (SELECT k, t FROM ts, (VALUES {ks}) v(k) WHERE rn = n * k // {parts}),
        st AS (SELECT *, {_KEY} AS key, CASE {whens} ELSE 's1' END AS stage FROM d WHERE time IS NOT NULL),
        s1 AS (SELECT * FROM st WHERE stage = 's1'), bins AS {_bins("s1")},
        q AS (SELECT st.row_id, any_value(key) AS key, any_value(stage) AS stage, any_value(weekend) AS weekend, any_value(grade) AS grade, any_value(level) AS level, any_value(cost) AS cost,
                     any_value({_Y}) - coalesce(arg_min(rate, bin), (SELECT arg_max(rate, bin) FROM bins)) AS resid FROM st LEFT JOIN bins ON st.baseline <= bins.cut WHERE isfinite(st.baseline) GROUP BY st.row_id),
        l AS ({_labels("q", "key, stage, resid")}),
        stats0 AS (SELECT label, stage, key, sum(resid) AS num, count(*)::DOUBLE AS den FROM l GROUP BY ALL),
        p AS (SELECT label, stage, sum(den)::BIGINT AS n, count(*) AS n_groups, sum(num) / sum(den) AS resid FROM stats0 GROUP BY ALL HAVING count(*) >= 30),
        stats AS (SELECT s.* FROM stats0 s JOIN p ON s.label = p.label AND s.stage = p.stage), {_boot("stats", "label, stage", 1000)},
        e AS (SELECT label, stage, stddev_pop(v) AS se FROM reps GROUP BY ALL),
        z AS (SELECT label, stage, n, resid, CASE WHEN se > 0 THEN resid / se ELSE 0 END AS z FROM p JOIN e USING (label, stage)),
        w AS (SELECT label, {", ".join(f"max(resid) FILTER (WHERE stage = 's{k}') AS r{k}, max(z) FILTER (WHERE stage = 's{k}') AS z{k}, max(n) FILTER (WHERE stage = 's{k}') AS n{k}" for k in range(1, parts + 1))} FROM z GROUP BY label)"""


@query(f"{_stages(2)} SELECT label, round(r1, 6) AS resid_d, round(z1, 6) AS z_d, n1 AS n_d, round(r2, 6) AS resid_v, round(z2, 6) AS z_v, n2 AS n_v, coalesce(abs(z1) >= 2 AND r1 * r2 > 0 AND abs(r2) >= 0.02 AND abs(z2) >= 1, FALSE) AS survives FROM w")
def holdout_scan_decisions(spark, d):
    return rounded(scan.holdout_scan(decisions(spark, d), _specs(), _key(), F.col("time"), F.col("baseline"), F.col("outcome"), "row_id"))


@query(f"{_stages(3)} SELECT label, round(z1, 6) AS z_d, round(z2, 6) AS z_v, round(z3, 6) AS z_c, coalesce(abs(z1) >= 2 AND sign(r1) = sign(r2) AND abs(z2) >= 1 AND sign(r1) = sign(r3) AND abs(z3) >= 1, FALSE) AS confirmed, '' AS note FROM w")
def staged_scan_decisions(spark, d):
    return rounded(scan.staged_scan(decisions(spark, d), _specs(), _key(), F.col("time"), F.col("baseline"), F.col("outcome"), "row_id", estimand="outcome against baseline"))


# --- leaks


@query(f"""
    WITH {_D}, r AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY time NULLS FIRST, row_id) AS rn, coalesce(isfinite(outcome) AND outcome > 0, FALSE) AS hit FROM d WHERE entity IS NOT NULL)
    SELECT entity, count(*) AS appearances, CASE WHEN bool_or(hit AND rn > 1) THEN 'H' ELSE 'M' END AS risk FROM r GROUP BY entity HAVING count(*) > 1""")
def leak_check_decisions(spark, d):
    return leak.repeated_entities(decisions(spark, d), F.col("entity"), F.col("time"), F.col("outcome"), "row_id")


@query(f"""
    WITH {_D}, r AS (SELECT "group" AS g, entity AS e, time AS t, level AS l, row_id AS u, row_number() OVER (PARTITION BY "group" ORDER BY isnan(baseline), baseline NULLS LAST, row_id) AS rk, min(time) OVER (PARTITION BY "group") AS t0 FROM d WHERE "group" IS NOT NULL),
    k AS (SELECT r.u, r.g, r.rk, r.l, count(x.row_id) AS later, max(x.level) AS top FROM r LEFT JOIN d x ON r.e = x.entity AND x.time > r.t0 GROUP BY ALL),
    f AS (SELECT g, rk, later > 0 AS again, coalesce(later > 0 AND top > l, FALSE) AS up FROM k)
    SELECT g AS "group", CASE WHEN bool_or(up AND rk = 1) THEN 'H' WHEN bool_or(up AND rk <= 3) OR count(*) FILTER (WHERE up) >= 2 THEN 'M' WHEN count(*) FILTER (WHERE again) >= 2 THEN 'L?' ELSE 'L' END AS level FROM f GROUP BY g""")
def reappearance_decisions(spark, d):
    return leak.reappearance_flags(decisions(spark, d), "group", "entity", "time", "baseline", "row_id", "level")


@query(f"""WITH {_D} SELECT "group" FROM d WHERE "group" IS NOT NULL AND time IS NOT NULL GROUP BY "group" HAVING min(time) < '{SPLIT}' AND max(time) >= '{SPLIT}'""")
def split_contamination_decisions(spark, d):
    return leak.split_contamination(decisions(spark, d), F.col("group"), F.col("time"), SPLIT)


_NUMERIC = ["baseline", "cost", "payoff", "value", "level"]


@query(f"""
    WITH {_D}, x AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, outcome AS y, row_id FROM d WHERE isfinite({f}) AND isfinite(outcome)" for f in _NUMERIC)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x, row_id) - 1 AS o, count(*) OVER (PARTITION BY feature) AS n FROM x),
    s AS (SELECT feature, n, abs(avg(y) FILTER (WHERE o >= n - n // 4) - avg(y) FILTER (WHERE o < n // 4)) AS s FROM r WHERE n >= 30 GROUP BY feature, n)
    SELECT feature, n, round(s, 3) AS separation, s >= 0.95 AS leaks FROM s""")
def target_leak_decisions(spark, d):
    return leak.target_leak_scan(decisions(spark, d), _NUMERIC, F.col("outcome"), "row_id")


@query("SELECT entity, time, count(*) AS n FROM decisions WHERE entity IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_decisions(spark, d):
    """Decisions of one entity at one time, rows loaded twice included."""
    return leak.duplicates(table(spark, d, "decisions"), F.col("entity"), F.col("time"))


def _report_sql() -> str:
    parts = {
        "reappearance": f"SELECT count(*) AS n FROM ({SQL['reappearance_decisions']}) WHERE level IN ('H', 'M')", "split": f"SELECT count(*) AS n FROM ({SQL['split_contamination_decisions']})",
        "target": f"SELECT count(*) AS n FROM ({SQL['target_leak_decisions']}) WHERE leaks", "duplicate": f"WITH {_D} SELECT count(*) AS n FROM (SELECT entity, time FROM d WHERE entity IS NOT NULL GROUP BY ALL HAVING count(*) > 1)",
    }
    union = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", n FROM ({q})" for k, q in parts.items())
    return f"WITH p AS ({union}) SELECT \"check\", n::BIGINT AS n, n = 0 AS clean FROM (SELECT * FROM p UNION ALL SELECT 'all', sum(n) FROM p)"


@query(_report_sql())
def leak_report_decisions(spark, d):
    rows = cut(decisions(spark, d))
    flags = leak.reappearance_flags(rows, "group", "entity", "time", "baseline", "row_id", "level")
    return leak.leak_report(flags, leak.split_contamination(rows, F.col("group"), F.col("time"), SPLIT), leak.target_leak_scan(rows, _NUMERIC, F.col("outcome"), "row_id"), leak.duplicates(rows, F.col("entity"), F.col("time")))


# --- overfitting

_DAYS = "e AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) - 50 AS v FROM events WHERE isfinite(value) GROUP BY ALL)"
_MOMENTS = f"""{_DAYS}, c AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sp FROM e WINDOW w AS (PARTITION BY event_type)),
    s AS (SELECT event_type, count(*) AS n, coalesce(avg(v) / nullif(stddev_samp(v), 0), 0) AS sharpe, CASE WHEN count(*) < 3 OR max(sp) = 0 THEN 0 ELSE avg(pow((v - m) / nullif(sp, 0), 3)) END AS skew, CASE WHEN count(*) < 4 OR max(sp) = 0 THEN 3 ELSE avg(pow((v - m) / nullif(sp, 0), 4)) END AS kurt FROM c GROUP BY event_type HAVING count(*) >= 2)"""


def _daily(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter(prob.finite(F.col("value")))
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg((F.avg("value") - 50).alias("v"))


def _horner(cs: list[float], x: str) -> str:
    out = repr(cs[0]) + "::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r})::DOUBLE)"
    return out


def _cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {_horner(prob.TAIL_NUMERATOR, a)} / {_horner(prob.TAIL_DENOMINATOR, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) / 2.506628274631"
    return f"(CASE WHEN {x} > 0 THEN 1 - (CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.0710678118654755 THEN {near} ELSE {far} END) ELSE (CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.0710678118654755 THEN {near} ELSE {far} END) END)"


def _ppf(p: str) -> str:
    q = f"({p} - 0.5::DOUBLE)"
    r = f"({q} * {q})"
    z = f"sqrt(-2 * ln(1 - {p}))"
    zl = f"sqrt(-2 * ln({p}))"
    tail = lambda z: f"{_horner(prob.QUANTILE_C, z)} / {_horner(prob.QUANTILE_D, z)}"
    return f"(CASE WHEN {p} <= 0 THEN '-inf'::DOUBLE WHEN {p} >= 1 THEN 'inf'::DOUBLE WHEN {p} < 0.02425 THEN {tail(zl)} WHEN {p} > 0.97575 THEN -({tail(z)}) ELSE {_horner(prob.QUANTILE_A, r)} * {q} / {_horner(prob.QUANTILE_B, r)} END)"


_SPREAD = "sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))"


@query(f"WITH {_MOMENTS} SELECT event_type, n, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM s")
def sharpe_events(spark, d):
    return rounded(overfit.sharpe(_daily(spark, d), F.col("v"), ["event_type"]))


@query(f"WITH {_MOMENTS}, z AS (SELECT *, sharpe * sqrt(n - 1) / {_SPREAD} AS z FROM s WHERE n >= 3) SELECT event_type, n, round(sharpe, 6) AS sharpe, round({_cdf('z')}, 6) AS psr FROM z")
def psr_events(spark, d):
    return rounded(overfit.probabilistic_sharpe(_daily(spark, d), F.col("v"), ["event_type"]))


@query(f"""
    WITH {_MOMENTS}, t AS (SELECT var_pop(sharpe) AS vr, 1 - 1 / count(*)::DOUBLE AS p1, 1 - 1 / (count(*) * 2.718281828459045::DOUBLE) AS p2 FROM s HAVING count(*) >= 2),
    o AS (SELECT sqrt(vr) * (0.4227843350984671 * {_ppf("p1")} + 0.5772156649015329 * {_ppf("p2")}) AS sr0 FROM t),
    z AS (SELECT *, (sharpe - sr0) * sqrt(n - 1) / {_SPREAD} AS z FROM s, o WHERE n >= 3)
    SELECT event_type, n, round(sharpe, 6) AS sharpe, round(sr0, 6) AS sr0, round({_cdf("z")}, 6) AS dsr FROM z""")
def dsr_events(spark, d):
    return rounded(overfit.deflated_sharpe(_daily(spark, d), F.col("v"), ["event_type"]))


@query(f"""
    WITH {_DAYS}, c AS (SELECT day FROM e GROUP BY day HAVING count(*) = (SELECT count(DISTINCT event_type) FROM e)),
    p AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS o, count(*) OVER () AS t FROM c),
    k AS (SELECT max(t) AS t, least(10, max(t)) - least(10, max(t)) % 2 AS nb FROM p),
    b AS (SELECT day, (SELECT max(i) FROM range(k.nb) r(i) WHERE round_even(i * k.t / k.nb::DOUBLE, 0) <= o) AS b FROM p, k),
    x AS (SELECT event_type AS s, b, sum(v) AS x, count(*) AS n FROM e JOIN b USING (day) GROUP BY ALL),
    ms AS (SELECT i AS mask FROM k, range((1 << k.nb)::BIGINT) r(i) WHERE bit_count(i) = k.nb // 2),
    f AS (SELECT mask, s, sum(x) FILTER (WHERE mask & (1 << b) <> 0) / sum(n) FILTER (WHERE mask & (1 << b) <> 0) AS ins, sum(x) FILTER (WHERE mask & (1 << b) = 0) / sum(n) FILTER (WHERE mask & (1 << b) = 0) AS oos FROM x, ms GROUP BY ALL),
    g AS (SELECT mask, arg_min(oos, (-ins, s)) AS best, count(*) AS c FROM f GROUP BY mask),
    w AS (SELECT g.mask, (1 + count(*) FILTER (WHERE oos < best)) / (any_value(c) + 1)::DOUBLE AS w FROM g JOIN f ON f.mask = g.mask GROUP BY g.mask),
    l AS (SELECT list_sort(list(ln(w / (1 - w)))) AS ls FROM w)
    SELECT len(ls)::BIGINT AS n_splits, round(len(list_filter(ls, lambda z: z <= 0)) / len(ls)::DOUBLE, 6) AS pbo, round(ls[len(ls) // 2 + 1], 6) AS median_logit FROM l""")
def pbo_events(spark, d):
    return rounded(overfit.pbo_cscv(_daily(spark, d), "event_type", "day", F.col("v")))


@query(f"""
    WITH {_D}, r AS (SELECT row_id, time AS t, row_number() OVER (ORDER BY time, row_id) - 1 AS o, count(*) OVER () AS n FROM d WHERE time IS NOT NULL),
    b AS (SELECT i::INT AS fold, round_even(i * n / 5.0::DOUBLE, 0) AS a, round_even((i + 1) * n / 5.0::DOUBLE, 0) AS z, n FROM (SELECT max(n) AS n FROM r), range(5) q(i)),
    f AS (SELECT fold, a, z, b.n, min(t) AS lo, max(t) AS hi FROM b JOIN r ON o >= a AND o < z GROUP BY ALL),
    x AS (SELECT fold, CASE WHEN o >= a AND o < z THEN 'test' WHEN NOT (o >= z AND o < z + floor(f.n * 0.01)) AND NOT t BETWEEN lo AND hi THEN 'train' END AS role FROM r, f)
    SELECT fold, role, count(*) AS n FROM x WHERE role IS NOT NULL GROUP BY ALL""")
def purged_kfold_decisions(spark, d):
    """Rows of each purged fold by role."""
    return overfit.fold_counts(overfit.purged_kfold(decisions(spark, d), "row_id", "time"))


# --- agreement and decisions

_SCORE = """CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]+[.]?[0-9]*') AND trim({0})::DOUBLE IN (0, 1, 2) THEN trim({0})::DOUBLE::INT END"""


def _score(c: str) -> Column:
    x = F.trim(F.col(c))
    v = F.when(x.rlike(r"^[+-]?[0-9]+[.]?[0-9]*$"), x).cast("double")
    return F.when(v.isin(0.0, 1.0, 2.0), v.cast("int"))


_AXES = ["faithfulness", "citation", "coverage"]
_J = "j AS (SELECT * FROM judged_gemini_by_gemini WHERE id IS NOT NULL AND _judge IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, _judge ORDER BY judged_at DESC NULLS LAST, faithfulness, citation, coverage) = 1)"
_LONG = f"""{_J}, v AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT id AS item, type, '{a}' AS axis, _judge AS rater, {_SCORE.format(a)} AS score FROM j" for a in _AXES)}) WHERE score IS NOT NULL)"""


def _judged(spark, d, first: bool = False) -> DataFrame:
    """(item, type, axis, rater, score): plain numeric scores of each rater's latest, or first, row for an item."""
    j = table(spark, d, "judged_gemini_by_gemini").filter("id is not null and _judge is not null")
    at = F.col("judged_at").asc_nulls_first() if first else F.col("judged_at").desc_nulls_last()
    w = Window.partitionBy("id", "_judge").orderBy(at, *(F.col(a).asc_nulls_last() for a in _AXES))
    last = j.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), _score(a).alias("score")) for a in _AXES)))
    return last.select(F.col("id").alias("item"), "type", F.col("_judge").alias("rater"), each.alias("e")).select("item", "type", "e.axis", "rater", "e.score").filter("score is not null")


def _paired_sql(pairs: str, by: str, finding: tuple[str, str, str], kappa: bool = True) -> str:
    """Kappa and the paired difference with its interval, from a table p0 (by, item, x, y) of pairs; 10 at least."""
    on = " AND ".join(f"t.{c} = q.{c}" for c in by.split(", "))
    mean = _mean_sql("w AS (SELECT 1)", "item", "x - y", by=by).replace("WITH w AS (SELECT 1), ", "", 1).replace("FROM src", "FROM pp", 1)
    steps, last = mean.strip().rsplit("SELECT", 1)
    shown = "round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, " if kappa else ""
    return f"""
        WITH {pairs}, pp AS (SELECT p0.* FROM p0 QUALIFY count(*) OVER (PARTITION BY {by}) >= 10), {steps.rstrip()},
        q AS (SELECT {last}),
        t AS (SELECT {by}, count(*) AS n, avg((x = y)::INT) AS po, {" + ".join(f"avg((x = {k})::INT) * avg((y = {k})::INT)" for k in range(3))} AS pe FROM pp GROUP BY ALL)
        SELECT {", ".join("t." + c for c in by.split(", "))}, t.n, {shown}estimate AS difference, lo, hi, reliable, robust_positive, robust_negative, CASE WHEN robust_positive THEN '{finding[0]}' WHEN robust_negative THEN '{finding[1]}' ELSE '{finding[2]}' END AS finding
        FROM t JOIN q ON {on}"""


@query(_paired_sql(f"{_LONG}, p0 AS (SELECT a.axis, a.rater AS rater_a, b.rater AS rater_b, a.item, a.score AS x, b.score AS y FROM v a JOIN v b ON a.item = b.item AND a.axis = b.axis AND a.rater < b.rater)", "axis, rater_a, rater_b", ("higher", "lower", "none")))
def pairwise_kappa_judges(spark, d):
    """Kappa of every two judges by axis, and the interval of their difference."""
    return rounded(evaluate.pairwise_agreement(_judged(spark, d)))


_FIRST = _LONG.replace("judged_at DESC NULLS LAST", "judged_at ASC NULLS FIRST").replace("j AS", "j1 AS", 1).replace("v AS", "v1 AS", 1).replace("FROM j)", "FROM j1)").replace("FROM j UNION", "FROM j1 UNION").replace("FROM j WHERE", "FROM j1 WHERE")


@query(_paired_sql(f"{_LONG}, {_FIRST}, p0 AS (SELECT v.rater, v.axis, v.item, v.score AS x, v1.score AS y FROM v JOIN v1 ON v.item = v1.item AND v.axis = v1.axis AND v.rater = v1.rater WHERE v.axis IN ('faithfulness', 'coverage'))", "rater, axis", ("with", "without", "none"), kappa=False))
def ablation_judges(spark, d):
    """What revising their scores changed, by judge and axis: each judge's last scores against the first, paired by answer."""
    return rounded(evaluate.ablation(_judged(spark, d), _judged(spark, d, first=True), ["faithfulness", "coverage"]))


@query(_paired_sql(f"{_LONG}, p0 AS (SELECT v.rater, v.axis, v.item, v.score AS x, h.score AS y FROM v JOIN v h ON v.item = h.item AND v.axis = h.axis WHERE h.rater = 'rater-01' AND v.rater <> 'rater-01')", "rater, axis", ("lenient", "strict", "none")))
def human_kappa_judges(spark, d):
    """Every other judge against rater-01, who stands for the people that the tables have no labels of."""
    v = cut(_judged(spark, d))
    return rounded(evaluate.human_agreement(v.filter("rater = 'rater-01'"), v.filter("rater <> 'rater-01'")))


@query("""
    WITH l AS (SELECT CASE WHEN contains(text, ' FATAL ') OR contains(text, ' ERROR ') THEN 'alert' ELSE 'normal' END AS a, label AS b FROM logtriage WHERE label IS NOT NULL),
    t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg((a = 'alert')::INT) * avg((b = 'alert')::INT) + avg((a <> 'alert')::INT) * avg((b <> 'alert')::INT) AS pe FROM l)
    SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa, pe >= 1 AS degenerate FROM t""")
def kappa_rule_logtriage(spark, d):
    """Agreement of a keyword rule with the labels of log lines."""
    a = F.when(F.contains("text", F.lit(" FATAL ")) | F.contains("text", F.lit(" ERROR ")), "alert").otherwise("normal")
    return rounded(agree.cohens_kappa(table(spark, d, "logtriage"), a, F.col("label")))


@query(f"WITH {_LONG} SELECT rater, axis, count(*) AS n, round(avg(score), 6) AS mean FROM v GROUP BY ALL")
def axis_means_judges(spark, d):
    return rounded(evaluate.axis_means(_judged(spark, d)))


@query(f"WITH {_LONG} SELECT rater AS judge, count(*) AS n FROM v WHERE axis = 'faithfulness' GROUP BY rater HAVING count(*) >= 20")
def usable_judges(spark, d):
    return evaluate.usable_judges(_judged(spark, d).filter("axis = 'faithfulness'"), "rater", F.col("score"))


@query(f"WITH {_LONG} SELECT rater, count(*) AS n, round(avg(score), 6) AS mean FROM v WHERE axis = 'faithfulness' AND type = 'unanswerable' GROUP BY rater")
def traps_judges(spark, d):
    return rounded(_judged(spark, d).filter("axis = 'faithfulness' and type = 'unanswerable'").groupBy("rater").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))


_A = """a AS (SELECT * FROM (SELECT DISTINCT id, type, answer, retrieved_doc_ids AS got, gold_doc_ids AS gold FROM answers_gemini) QUALIFY row_number() OVER (PARTITION BY id ORDER BY answer NULLS FIRST, type) = 1),
    n AS (SELECT *, type = 'unanswerable' AS trap, list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[(\\d{1,6})\\]', 1), lambda x: x::INT)) AS nums FROM a),
    c AS (SELECT *, list_filter(nums, lambda x: x >= 1 AND x <= len(coalesce(got, []))) AS ins, list_sort(list_distinct(list_transform(ins, lambda x: got[x]))) AS cited_docs, contains(lower(coalesce(answer, '')), 'do not contain this information') AS refused FROM n),
    h AS (SELECT *, len(list_intersect(cited_docs, coalesce(gold, []))) AS hit FROM c),
    k AS (SELECT *, len(nums)::INT AS n_cited, (len(nums) - len(ins))::INT AS out_of_range, CASE WHEN NOT trap THEN CASE WHEN len(cited_docs) > 0 THEN hit / len(cited_docs)::DOUBLE ELSE 0 END END AS p, CASE WHEN NOT trap THEN CASE WHEN len(coalesce(gold, [])) > 0 THEN hit / len(list_distinct(gold))::DOUBLE ELSE 0 END END AS r FROM h),
    o AS (SELECT *, CASE WHEN trap THEN refused OR (len(cited_docs) > 0 AND hit = len(cited_docs)) ELSE p = 1 AND r > 0 END AS ok FROM k)"""


def _answers(spark, d) -> DataFrame:
    """Each answer once; of several for an id, the first in text order."""
    a = table(spark, d, "answers_gemini").select("id", "type", "question", "answer", "retrieved_doc_ids", "gold_doc_ids").distinct()
    w = Window.partitionBy("id").orderBy(F.col("answer").asc_nulls_first(), "type")
    return a.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _cited(spark, d) -> DataFrame:
    return retrieve.citation_check(_answers(spark, d), "answer", F.col("retrieved_doc_ids"), F.col("gold_doc_ids"), F.coalesce(F.col("type") == "unanswerable", F.lit(False)))


@query(f"WITH {_A} SELECT id, n_cited, out_of_range, array_to_string(cited_docs, ',') AS cited_docs, refused, round(p, 6) AS precision, round(r, 6) AS recall, ok AS citation_ok FROM o")
def citation_check_answers(spark, d):
    out = _cited(spark, d).withColumn("cited_docs", F.array_join("cited_docs", ","))
    return rounded(out.select("id", "n_cited", "out_of_range", "cited_docs", "refused", "precision", "recall", "citation_ok"))


@query(f"WITH {_A} SELECT trap, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM o GROUP BY trap")
def citation_summary_answers(spark, d):
    rows = _cited(spark, d).withColumn("trap", F.col("type") == "unanswerable")
    return rounded(rows.groupBy("trap").agg(F.count("*").alias("n"), F.count_if("citation_ok").alias("n_ok"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")))


@query(f"WITH {_A}, {_LONG} SELECT rater, ok AS machine_ok, count(*) AS n, round(avg(score), 6) AS mean FROM v JOIN o ON v.item = o.id WHERE axis = 'citation' AND o.type IS DISTINCT FROM 'unanswerable' GROUP BY ALL")
def citation_vs_machine(spark, d):
    """Mean citation score of each judge on the answers that the machine check passes, and on the others; traps are in neither."""
    ok = _cited(spark, d).filter("type is distinct from 'unanswerable'").select(F.col("id").alias("item"), F.col("citation_ok").alias("machine_ok"))
    return rounded(_judged(spark, d).filter("axis = 'citation'").join(ok, "item").groupBy("rater", "machine_ok").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))


@query(f"WITH {_A} SELECT id, trap, array_to_string(cited_docs, ',') AS cited_docs, round(p, 6) AS precision, round(r, 6) AS recall FROM o WHERE NOT ok")
def citation_failures_answers(spark, d):
    """The answers that the citation check doesn't pass."""
    out = _cited(spark, d).filter("not citation_ok").withColumns({"trap": F.col("type") == "unanswerable", "cited_docs": F.array_join("cited_docs", ",")})
    return rounded(out.select("id", "trap", "cited_docs", "precision", "recall"))


def _chars(alias: str) -> str:
    return f"SELECT id, max(length(coalesce(answer, '')))::DOUBLE AS v FROM {alias} WHERE id IS NOT NULL GROUP BY id"


@query(_mean_sql(f"""src AS (SELECT a.id, t.type, a.v - b.v AS diff FROM ({_chars("answers_gemini")}) a JOIN ({_chars("answers_gemini_norag")}) b ON a.id = b.id JOIN (SELECT id, min(type) AS type FROM answers_gemini GROUP BY id) t ON a.id = t.id)""", "id", "diff", by="type"))
def ablation_answers(spark, d):
    """Paired difference of answer length with and without retrieval, by type of question."""
    size = lambda name: table(spark, d, name).filter("id is not null").groupBy("id").agg(F.max(F.length(F.coalesce("answer", F.lit("")))).cast("double").alias(name), F.min("type").alias(f"type_{name}"))
    a, b = size("answers_gemini"), size("answers_gemini_norag")
    both = a.join(b, "id").withColumn("type", F.col("type_answers_gemini")).withColumn("diff", F.col("answers_gemini") - F.col("answers_gemini_norag"))
    return rounded(intervals.mean_ci(both, F.col("id"), F.col("diff"), by=["type"]))


@query("""
    WITH l AS (SELECT coalesce("group", chr(1) || id) AS key, kind, label, CASE WHEN contains(text, ' FATAL ') THEN 'alert' ELSE 'normal' END AS a, CASE WHEN contains(text, ' FATAL ') OR contains(text, ' ERROR ') THEN 'alert' ELSE 'normal' END AS r,
                      CASE WHEN contains(lower(text), 'fatal') OR contains(lower(text), 'error') OR contains(lower(text), 'severe') THEN 'alert' ELSE 'normal' END AS b FROM logtriage WHERE label IS NOT NULL),
    s AS (SELECT key, unnest(['all', 'kind=' || coalesce(kind, 'null'), 'label=' || label]) AS stratum, (a = label)::INT::DOUBLE AS va, (b = label)::INT::DOUBLE AS vb, (r = label)::INT::DOUBLE AS vr FROM l),
    src AS (SELECT key AS k0, stratum, 'A' AS of_, va AS v0 FROM s UNION ALL SELECT key, stratum, 'B', vb FROM s UNION ALL SELECT key, stratum, 'B-A', vb - va FROM s UNION ALL SELECT key, stratum, 'rule', vr FROM s UNION ALL SELECT key, stratum, 'B-rule', vb - vr FROM s), """
    + _mean_sql("x AS (SELECT 1)", "k0", "v0", by="stratum, of_").replace("WITH x AS (SELECT 1), ", "", 1).strip().replace("SELECT stratum, of_, n,", 'SELECT stratum, of_ AS "of", n,'))
def ab_rules_logtriage(spark, d):
    """Two classifiers of log lines against each other and against a keyword rule, by stratum, resampled by template."""
    t = F.lower("text")
    fatal = F.contains("text", F.lit(" FATAL "))
    a, rule = F.when(fatal, "alert").otherwise("normal"), F.when(fatal | F.contains("text", F.lit(" ERROR ")), "alert").otherwise("normal")
    b = F.when(F.contains(t, F.lit("fatal")) | F.contains(t, F.lit("error")) | F.contains(t, F.lit("severe")), "alert").otherwise("normal")
    return rounded(evaluate.paired_ab(table(spark, d, "logtriage"), group_key(F.col("group"), F.col("id")), F.col("label"), a, b, ["kind", "label"], rule=rule))


_TRAPS = f"""{_A}, x AS (SELECT id, trap, (refused = trap)::INT::DOUBLE AS va, ((refused OR len(cited_docs) = 0) = trap)::INT::DOUBLE AS vb FROM o WHERE trap IS NOT NULL)"""


def _ab_report_sql() -> str:
    one = lambda name, v: f"{name} AS ({_mean_sql(f'src AS (SELECT id, {v} AS v0 FROM x)', 'id', 'v0')})"
    return f"""
        WITH {_TRAPS}, {one("ca", "va")}, {one("cb", "vb")}, {one("cd", "vb - va")},
        w AS (SELECT count(*) AS n0, avg(vb - va) AS m, pow(2.80158 * stddev_samp(vb - va) / 0.05, 2) AS need_n, stddev_samp(vb - va) AS sd FROM x),
        z AS (SELECT m, CASE WHEN sd > 0 THEN need_n END AS need_n, {_RADIUS.format(s="1.0").replace("(n ", "(n0 ").replace("(n:", "(n0:").replace("* n *", "* n0 *").replace("sqrt(n *", "sqrt(n0 *")} AS rad FROM w),
        y AS (SELECT cd.*, ca.estimate AS ae, ca.lo AS al, ca.hi AS ah, cb.estimate AS be, cb.lo AS bl, cb.hi AS bh, need_n, m - rad AS sl, m + rad AS sh, 100 * cd.estimate - 2 AS en, 100 * cd.lo - 2 AS wn, (100 * cd.hi - 100 * cd.lo) / 3.29 AS se FROM ca, cb, cd, z),
        u AS (SELECT *, CASE WHEN se > 0 THEN 100 * abs(estimate) / se END AS k FROM y)
        SELECT ae AS a_estimate, al AS a_lo, ah AS a_hi, be AS b_estimate, bl AS b_lo, bh AS b_hi, estimate AS diff_estimate, lo AS diff_lo, hi AS diff_hi, n, n_groups, robust_positive, robust_negative,
               round(need_n, 3) AS need_n, need_n <= 5000 AS measurable, round(sl, 6) AS sequence_lo, round(sh, 6) AS sequence_hi, sl > 0 OR sh < 0 AS decided, round(en, 3) AS expected_net, round(wn, 3) AS worst_net,
               CASE WHEN wn > 0 AND en > 0 THEN 'adopt' WHEN en > 0 THEN 'conditional' ELSE 'reject' END AS verdict, round(e, 3) AS evpi, e > 1 AS worth_sampling,
               CASE WHEN robust_positive THEN 'better' WHEN robust_negative THEN 'worse' ELSE 'not told from luck' END AS finding
        FROM (SELECT *, CASE WHEN se > 0 THEN se * (exp(-k * k / 2) / 2.5066282746310002 - k * (1 - {_cdf("k")})) ELSE 0 END AS e FROM u)"""


def _trap_calls(spark, d) -> tuple[DataFrame, Column, Column, Column]:
    rows = _cited(spark, d).withColumn("trap", F.col("type") == "unanswerable")
    return rows, F.col("trap"), F.col("refused"), F.col("refused") | (F.size("cited_docs") == 0)


@query(_ab_report_sql())
def ab_report_answers(spark, d):
    """Is an answer without citations as good a sign of an unanswerable question as a refusal? The whole report, by answer."""
    rows, truth, a, b = _trap_calls(spark, d)
    out = rounded(evaluate.ab_report(rows, F.col("id"), truth, a, b))
    return out.withColumns({c: F.round(c, 3) for c in ("need_n", "expected_net", "worst_net", "evpi")})


@query(f"WITH {_TRAPS} SELECT id, 'A' AS \"of\" FROM x WHERE va = 0 UNION ALL SELECT id, 'B' FROM x WHERE vb = 0")
def ab_errors_answers(spark, d):
    """The answers that either sign gets wrong."""
    return evaluate.ab_errors(_trap_calls(spark, d)[0], "id", *_trap_calls(spark, d)[1:])


@query("""
    SELECT DISTINCT id, CASE WHEN p = 0 AND q = 0 THEN 'unk' WHEN q = 0 OR (p > 0 AND p <= q) THEN 'yes' ELSE 'no' END AS said,
           CASE WHEN answer IS NULL THEN 'err' WHEN contains(lower(answer), 'neg') THEN 'neg' WHEN contains(lower(answer), 'pos') THEN 'pos' ELSE 'unk' END AS polarity
    FROM (SELECT id, answer, instr(lower(coalesce(answer, '')), 'began') AS p, instr(lower(coalesce(answer, '')), 'outage') AS q FROM answers_gemini)""")
def label_parse_answers(spark, d):
    """Labels read off free text: the word that occurs first, and negative before positive."""
    a = table(spark, d, "answers_gemini")
    return a.select("id", evaluate.first_word(F.col("answer"), {"began": "yes", "outage": "no"}).alias("said"), evaluate.polarity(F.col("answer")).alias("polarity")).distinct()


@query("""
    WITH u AS (SELECT DISTINCT id, kind, "group" AS g FROM logtriage WHERE kind IS NOT NULL AND "group" IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind, g ORDER BY md5('42:' || id), id) AS r FROM u),
    c AS (SELECT * FROM r WHERE r <= CASE kind WHEN 'alert' THEN 5 WHEN 'hard_negative' THEN 3 ELSE 2 END),
    f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || id), id) AS q FROM c)
    SELECT id, kind, g AS "group" FROM f WHERE q <= CASE kind WHEN 'alert' THEN 90 ELSE 60 END""")
def stratified_sample_logtriage(spark, d):
    rows = table(spark, d, "logtriage").select("id", "kind", "group").distinct()
    out = evaluate.stratified_sample(rows, F.col("kind"), F.col("group"), "id", {"alert": 5, "hard_negative": 3, "easy_negative": 2}, {"alert": 90, "hard_negative": 60, "easy_negative": 60})
    return out.select("id", "kind", "group")


_PEEK_X = "((('0x' || substr(md5('42:' || trial || ':' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) - 0.5::DOUBLE) * 3.4641016151377544::DOUBLE"


@query(f"""
    WITH x AS (SELECT trial, k, {_PEEK_X} AS x FROM range(500) a(trial), range(1, 501) b(k)),
    r AS (SELECT trial, k AS n, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd FROM x WINDOW w AS (PARTITION BY trial ORDER BY k ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT trial, max((abs(m) > 1.645 * sd / sqrt(n))::INT) AS f, max((abs(m) > {_RADIUS.format(s="1")})::INT) AS s FROM r WHERE n >= 30 AND (n - 30) % 10 = 0 GROUP BY trial)
    SELECT 'fixed' AS method, count(*) AS trials, sum(f)::BIGINT AS false_positives FROM h UNION ALL SELECT 'sequence', count(*), sum(s)::BIGINT FROM h""")
def peeking_simulation(spark, d):
    return evaluate.peeking_rates(spark)


def _effect(spark, d) -> DataFrame:
    return intervals.mean_ci(table(spark, d, "events"), F.col("user_id"), F.col("value") - 49, by=["event_type"])


_EFFECT = _mean_sql("src AS (SELECT event_type, user_id, value - 49 AS x FROM events)", "user_id", "x", by="event_type")


@query(f"WITH q AS ({_EFFECT}) SELECT event_type, estimate, lo, round(estimate * 1000 - 200, 4) AS expected_net, round(lo * 1000 - 200, 4) AS worst_net, CASE WHEN lo * 1000 - 200 > 0 AND estimate * 1000 - 200 > 0 THEN 'adopt' WHEN estimate * 1000 - 200 > 0 THEN 'conditional' ELSE 'reject' END AS verdict FROM q")
def decision_value_events(spark, d):
    base = rounded(_effect(spark, d)).select("event_type", "estimate", "lo")
    return rounded(agree.decision_value(base, F.col("estimate"), F.col("lo"), F.lit(1000.0), F.lit(200.0)), 6).withColumns({c: F.round(c, 4) for c in ("expected_net", "worst_net")})


@query(f"""WITH q AS ({_EFFECT}), s AS (SELECT event_type, estimate, (hi - lo) / 3.29 AS se FROM q), t AS (SELECT *, CASE WHEN se > 0 THEN abs(estimate) / se ELSE 'inf'::DOUBLE END AS d FROM s),
    u AS (SELECT *, CASE WHEN se > 0 THEN 1000 * se * (exp(-d * d / 2) / 2.5066282746310002 - d * (1 - {_cdf("d")})) ELSE 0 END AS evpi FROM t) SELECT event_type, round(d, 4) AS d, round(evpi, 4) AS evpi, evpi > 5 AS worth_sampling FROM u""")
def evpi_events(spark, d):
    base = rounded(_effect(spark, d)).select("event_type", "estimate", ((F.col("hi") - F.col("lo")) / 3.29).alias("se"))
    out = agree.value_of_information(base, F.col("estimate"), F.col("se"), F.lit(1000.0), F.lit(5.0))
    return out.select("event_type", F.round("d", 4).alias("d"), F.round("evpi", 4).alias("evpi"), "worth_sampling")


@query(f"WITH q AS (SELECT count(DISTINCT event_type) AS n_tests, 2.5::DOUBLE AS z FROM events) SELECT n_tests, z, round(2 * (1 - {_cdf('z')}), 6) AS p, round(n_tests * 2 * (1 - {_cdf('z')}), 6) AS expected_false, round(1 - pow(0.95, 1.0::DOUBLE / n_tests), 6) AS sidak_alpha FROM q")
def multiple_comparisons_events(spark, d):
    tests = table(spark, d, "events").agg(F.count_distinct("event_type").alias("n_tests")).withColumn("z", F.lit(TESTS_Z))
    return rounded(scan.multiple_comparisons(tests))


@query(f"WITH x AS (SELECT DISTINCT round(baseline, 2) AS p FROM decisions WHERE isfinite(baseline)), y AS (SELECT p, {_ppf('p')} AS q FROM x) SELECT p, round(q, 6) AS quantile, round({_cdf('q')}, 6) AS back FROM y WHERE p > 0 AND p < 1")
def normal_round_trip(spark, d):
    """Quantiles of baselines and the probabilities that they give back."""
    p = table(spark, d, "decisions").filter(prob.finite(F.col("baseline"))).select(F.round("baseline", 2).alias("p")).distinct().filter("p > 0 and p < 1")
    q = p.withColumn("quantile", prob.norm_ppf(F.col("p")))
    return rounded(q.withColumn("back", prob.norm_cdf(F.col("quantile"))))


# --- acquiring and gating


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE json_extract_string(props, '$.k') WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE '?' || json_extract_string(props, '$.k') END AS k_name, CASE event_type WHEN 'purchase' THEN 'P' ELSE '?' || event_type END AS kind FROM events""")
def map_record_events(spark, d):
    e = table(spark, d, "events").withColumn("kind", gate.apply_code_map(F.col("event_type"), {"purchase": "P"}))
    return gate.map_record(e, "props", {"k": ("k", None), "k_name": ("k", "names")}, {"names": {"1": "one", "2": "two"}}, ["event_id", "kind"])


@query("SELECT DISTINCT id, gold_doc_ids[1] AS first_gold, gold_doc_ids[2] AS second_gold FROM answers_gemini")
def dig_answers(spark, d):
    """Members of arrays in JSON text, by their place."""
    raw = F.to_json(F.struct(F.struct("gold_doc_ids").alias("of")))
    return table(spark, d, "answers_gemini").select("id", gate.dig(raw, "of.gold_doc_ids.0").alias("first_gold"), gate.dig(raw, "of.gold_doc_ids.1").alias("second_gold")).distinct()


def _gate_sql() -> str:
    one = lambda check, field, cond, gates: f"SELECT '{check}' AS \"check\", '{field}' AS field, coalesce(sum(({cond})::INT), 0)::BIGINT AS n, {gates} AS g FROM decisions"
    parts = [one("missing", c, f"{c} IS NULL", "TRUE") for c in ("time", "baseline")] + [one("missing", "entity", "entity IS NULL OR entity = ''", "TRUE"), one("empty", "level", "level IS NULL", "FALSE"), one("unknown_code", "grade", "coalesce(starts_with(grade, '?'), FALSE)", "FALSE")]
    keys = "(SELECT DISTINCT row_id FROM decisions)"
    parts.append(f"SELECT 'uncollected', NULL, count(*), TRUE FROM (SELECT unnest(range(1, (SELECT max(row_id) FROM decisions) + 3)) AS i) e WHERE i NOT IN {keys}")
    parts.append(f"SELECT 'unexpected', NULL, count(*), FALSE FROM {keys} k WHERE row_id < 1")
    return f"WITH a AS ({' UNION ALL '.join(parts)}), b AS (SELECT \"check\", field, n, g AND n > 0 AS fails FROM a) SELECT * FROM b UNION ALL SELECT 'passed', NULL, sum(fails::INT)::BIGINT, sum(fails::INT) > 0 FROM b"


@query(_gate_sql())
def completeness_gate_decisions(spark, d):
    """Missing fields and uncollected ids of decisions; two ids more than there are were expected."""
    rows = table(spark, d, "decisions")
    ids = range(1, (rows.agg(F.max("row_id")).first()[0] or 0) + 3)
    return gate.completeness_gate(rows, "row_id", ["time", "baseline", "entity"], ["level"], ["grade"], expected=ids)


@query(r"""
    WITH a AS (SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (WHERE regexp_full_match(coalesce(answer, ''), '\s*')) AS blank, count(DISTINCT id) FILTER (WHERE type = 'unanswerable') AS traps FROM answers_gemini),
    o AS (SELECT count(*) AS orphans FROM (SELECT DISTINCT unnest(gold_doc_ids) AS i FROM answers_gemini) WHERE i IS NOT NULL AND i NOT IN (SELECT id FROM postmortems WHERE id IS NOT NULL)),
    s AS (SELECT count(*) AS secrets FROM answers_gemini WHERE regexp_matches(coalesce(answer, ''), '(sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16})'))
    SELECT unnest(['rows', 'unique_ids', 'blank_answers', 'traps', 'orphans', 'secrets']) AS "check", unnest([rows, ids, blank, traps, orphans, secrets]) AS n FROM a, o, s""")
def publish_gate_answers(spark, d):
    """Counts that decide whether answers may be published: rows, ids, blanks, traps, ids of unknown documents, secrets."""
    a = table(spark, d, "answers_gemini")
    secret = F.coalesce("answer", F.lit("")).rlike("(sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16})")
    own = a.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("unique_ids"), F.count_if(F.coalesce("answer", F.lit("")).rlike(r"^\s*$")).alias("blank_answers"), F.count_distinct(F.when(F.col("type") == "unanswerable", F.col("id"))).alias("traps"), F.count_if(secret).alias("secrets"))
    gold = a.select(F.explode("gold_doc_ids").alias("id")).filter("id is not null").distinct()
    orphans = gold.join(table(spark, d, "postmortems").select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphans").alias("check"), "n")
    return own.unpivot([], ["rows", "unique_ids", "blank_answers", "traps", "secrets"], "check", "n").unionByName(orphans)


# What answers must reach to be published.
FLOORS = {"duplicate_ids": ("most", 0), "blank_share": ("most", 2 / 30), "traps": ("least", 3), "orphans": ("most", 0), "secrets": ("most", 0), "usable_judges": ("least", 2), "recall": ("least", 0.9), "mrr": ("least", 0.9)}


def _verdict_sql() -> str:
    floors = ", ".join(f"('{k}', '{side}', {v!r}::DOUBLE)" for k, (side, v) in FLOORS.items())
    return f"""
        WITH c AS ({SQL["publish_gate_answers"]}), r AS ({SQL["retrieval_eval"]}), u AS ({SQL["usable_judges"]}), g AS (SELECT "check" AS k, n FROM c),
        m AS (SELECT (SELECT n FROM g WHERE k = 'blank_answers') / (SELECT n FROM g WHERE k = 'rows')::DOUBLE AS blank),
        d AS (SELECT count(*) AS n FROM (SELECT id FROM answers_gemini WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT question) > 1)),
        v AS (SELECT k AS name, n::DOUBLE AS value FROM g WHERE k IN ('traps', 'orphans', 'secrets') UNION ALL SELECT 'blank_share', round(blank, 6) FROM m UNION ALL SELECT 'duplicate_ids', n FROM d
              UNION ALL SELECT 'usable_judges', count(*) FROM u UNION ALL SELECT 'recall', recall FROM r UNION ALL SELECT 'mrr', mrr FROM r)
        SELECT name AS "check", value, side, bound, coalesce(CASE side WHEN 'most' THEN value <= bound ELSE value >= bound END, FALSE) AS passed FROM v JOIN (VALUES {floors}) f(name, side, bound) USING (name)"""


def publish_gate_verdicts(spark, d):
    """Whether the answers may be published: each measure of the gate, its bound, and whether it is kept; all must be."""
    counts = cut(publish_gate_answers(spark, d))
    value = lambda k: F.max(F.when(F.col("check") == k, F.col("n"))).cast("double")
    a = table(spark, d, "answers_gemini").filter("id is not null")
    own = counts.agg(value("traps").alias("traps"), value("orphans").alias("orphans"), value("secrets").alias("secrets"), F.round(F.try_divide(value("blank_answers"), value("rows")), 6).alias("blank_share"))
    twice = a.groupBy("id").agg(F.count_distinct("question").alias("q")).agg(F.count_if(F.col("q") > 1).cast("double").alias("duplicate_ids"))
    judges = usable_judges(spark, d).agg(F.count("*").cast("double").alias("usable_judges"))
    one = own.join(F.broadcast(twice)).join(F.broadcast(judges)).join(F.broadcast(retrieval_eval(spark, d).select("recall", "mrr")), how="left")
    return gate.verdicts(one, FLOORS)


# --- actions


def _policy() -> list[tuple[str, Column, Column]]:
    act = lambda kind, amount, who: F.array(F.struct(F.lit(kind).alias("kind"), amount.alias("amount"), who.alias("target")))
    return [
        ("low_balance", F.col("c_acctbal") < 0, act("remind", F.lit(10.0), F.col("c_name"))),
        ("no_balance", F.col("c_acctbal") < 500, act("remind", F.lit(10.0), F.col("c_name"))),
        ("rich", F.col("c_acctbal") > 5000, F.concat(act("invite", F.lit(60.0), F.col("c_name")), act("gift", F.lit(40.0), F.col("c_mktsegment")))),
        ("far", F.col("c_nationkey") >= 20, act("call", F.col("c_nationkey").cast("double"), F.col("c_name"))),
    ]


def _states(spark, d) -> DataFrame:
    return table(spark, d, "customer").withColumn("budget", F.when(F.col("c_nationkey") >= 20, 115.0).otherwise(100.0)).withColumn("most", F.lit(3))


_ACTIONS = """s AS (SELECT *, CASE WHEN c_nationkey >= 20 THEN 115.0 ELSE 100.0 END AS budget FROM customer),
    f AS (SELECT c_custkey AS state, 0 AS k, 'low_balance' AS rule, 'remind' AS kind, 10.0::DOUBLE AS amount, c_name AS target FROM s WHERE c_acctbal < 0
          UNION ALL SELECT c_custkey, 1, 'no_balance', 'remind', 10.0, c_name FROM s WHERE c_acctbal < 500
          UNION ALL SELECT c_custkey, 2, 'rich', 'invite', 60.0, c_name FROM s WHERE c_acctbal > 5000
          UNION ALL SELECT c_custkey, 2, 'rich', 'gift', 40.0, c_mktsegment FROM s WHERE c_acctbal > 5000
          UNION ALL SELECT c_custkey, 3, 'far', 'call', c_nationkey::DOUBLE, c_name FROM s WHERE c_nationkey >= 20),
    g AS (SELECT state, kind, amount, target, string_agg(rule, ',' ORDER BY k) AS rules FROM f GROUP BY state, kind, amount, target),
    v AS (SELECT c_custkey AS state, sum(amount) > any_value(budget) AS over, coalesce(bool_or(kind = 'invite') AND bool_or(kind = 'call'), FALSE) AS clash, count(kind) <> 3 AS other FROM s LEFT JOIN g ON s.c_custkey = g.state GROUP BY c_custkey)"""


def _generated(spark, d) -> DataFrame:
    return cut(action.generate(_states(spark, d), "c_custkey", _policy()))


def _violations(spark, d, actions: DataFrame) -> DataFrame:
    invariants = [action.no_duplicate(), action.budget("amount", F.col("budget")), action.required_fields(["kind", "target"]), action.not_contradict("kind", [("invite", "call")]), action.expected_count(F.col("most"), "warn")]
    return action.check(actions, _states(spark, d), "c_custkey", invariants)


@query(f"WITH {_ACTIONS} SELECT state, kind, amount, target, rules FROM g")
def actions_generate(spark, d):
    """Actions of four rules over customers, equal ones once with all their rules."""
    return _generated(spark, d).select("state", "action.kind", "action.amount", "action.target", F.array_join("rules", ",").alias("rules"))


@query(f"WITH {_ACTIONS} SELECT state, 'budget' AS invariant, 'error' AS severity FROM v WHERE over UNION ALL SELECT state, 'not_contradict', 'error' FROM v WHERE clash UNION ALL SELECT state, 'expected_count', 'warn' FROM v WHERE other")
def actions_check(spark, d):
    return _violations(spark, d, _generated(spark, d)).select("state", "invariant", "severity")


@query(f"WITH {_ACTIONS} SELECT DISTINCT state, 'no_duplicate' AS invariant, 'error' AS severity FROM g WHERE kind = 'remind' AND state % 7 = 0 UNION ALL SELECT DISTINCT state, 'required_fields', 'error' FROM g WHERE kind = 'gift' AND state % 5 = 0")
def actions_check_tampered(spark, d):
    """The invariants that generated actions keep, on actions that were tampered with: some given twice, some without target."""
    given = _generated(spark, d)
    own, kind = F.col("state") % 5 == 0, F.col("action.kind")
    without = given.withColumn("action", F.when(own & (kind == "gift"), F.col("action").withField("target", F.lit(None).cast("string"))).otherwise(F.col("action")))
    twice = without.unionByName(without.filter((F.col("state") % 7 == 0) & (kind == "remind")))
    found = action.check(twice, _states(spark, d), "c_custkey", [action.no_duplicate(), action.required_fields(["kind", "target"])])
    return found.select("state", "invariant", "severity")


@query(f"WITH {_ACTIONS} SELECT g.state, kind, target, NOT coalesce(over, FALSE) AND NOT clash AS committed FROM g JOIN v ON g.state = v.state")
def actions_run(spark, d):
    actions = _generated(spark, d)
    return action.run(actions, _violations(spark, d, actions)).select("state", "action.kind", "action.target", "committed")


# --- retrieval

_PM = "pm AS (SELECT id, title, text FROM (SELECT DISTINCT id, title, text FROM postmortems WHERE id IS NOT NULL AND text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY text, title NULLS FIRST) = 1)"
_CHUNKS = _PM + r""", parts AS (SELECT id AS doc_id, title, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM pm),
    ch0 AS (SELECT doc_id, title, unnest(ps) AS s, generate_subscripts(ps, 1) - 1 AS i FROM parts),
    ch AS (SELECT doc_id || '::' || i AS chunk_id, doc_id, concat_ws('. ', title, trim(s, ' ')) AS chunk FROM ch0 WHERE trim(s, ' ') <> '')"""


def _postmortems(spark, d) -> DataFrame:
    return table(spark, d, "postmortems").filter("id is not null and text is not null").groupBy("id").agg(F.min(F.struct("text", "title")).alias("m")).select("id", "m.title", "m.text")


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id, chunk FROM ch")
def chunk_postmortems(spark, d):
    return retrieve.chunk_documents(_postmortems(spark, d))


_BM25 = _CHUNKS + r""", w AS (SELECT chunk_id, doc_id, regexp_extract_all(lower(chunk), '[a-z0-9]+') AS ws FROM ch), st AS (SELECT count(*) AS nc, avg(len(ws)) AS avgdl FROM w),
    qs AS (SELECT id AS query_id, min(question) AS q FROM answers_gemini WHERE id IS NOT NULL GROUP BY id),
    qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM qs) GROUP BY ALL),
    tf AS (SELECT chunk_id, doc_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    we AS (SELECT term, chunk_id, doc_id, ln(1 + (nc - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM tf JOIN df USING (term), st),
    sc AS (SELECT query_id, chunk_id, doc_id, sum(w * qf) AS score FROM we JOIN qt USING (term) GROUP BY ALL),
    be AS (SELECT query_id, doc_id, round(max(score), 9) AS score FROM sc GROUP BY ALL),
    top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM be QUALIFY rank <= 5)"""


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "answers_gemini").filter("id is not null").groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("query"))


def _top(spark, d) -> DataFrame:
    return retrieve.bm25_top(retrieve.chunk_documents(_postmortems(spark, d)), _questions(spark, d))


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM top")
def bm25_top_postmortems(spark, d):
    """The five postmortems that answer each question best."""
    return rounded(_top(spark, d))


@query(f"""WITH {_BM25}, c5 AS (SELECT DISTINCT chunk_id FROM ch ORDER BY chunk_id LIMIT 5), every AS (SELECT query_id, chunk_id, round(max(score), 9) AS score FROM (SELECT query_id, chunk_id, score FROM sc UNION ALL SELECT query_id, chunk_id, 0.0 FROM qs, c5) GROUP BY ALL)
    SELECT query_id, chunk_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM every QUALIFY rank <= 5""")
def bm25_chunks_postmortems(spark, d):
    """The five best chunks for each question; chunks without a word of it fill up."""
    return rounded(retrieve.search_chunks(retrieve.chunk_documents(_postmortems(spark, d)), _questions(spark, d)))


@query(f"""WITH {_BM25}, g AS (SELECT id, min(gold_doc_ids) AS gold FROM answers_gemini WHERE id IS NOT NULL GROUP BY id), l AS (SELECT query_id, list(doc_id ORDER BY rank) AS got FROM top GROUP BY query_id),
    x AS (SELECT len(list_intersect(gold, coalesce(got, []))) / len(list_distinct(gold))::DOUBLE AS r, (SELECT min(i) FROM range(1, len(got) + 1) t(i) WHERE list_contains(gold, got[i])) AS f FROM g LEFT JOIN l ON g.id = l.query_id WHERE len(gold) > 0)
    SELECT count(*) AS n, round(avg(r), 3) AS recall, round(avg(coalesce(1.0::DOUBLE / f, 0)), 3) AS mrr FROM x""")
def retrieval_eval(spark, d):
    gold = table(spark, d, "answers_gemini").filter("id is not null").groupBy(F.col("id").alias("query_id")).agg(F.min("gold_doc_ids").alias("gold"))
    got = _top(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r")).select("query_id", F.col("r.doc_id").alias("got"))
    rows = gold.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    return retrieve.retrieval_metrics(rows, "gold", "got")


@query(f"""WITH {_PM}, a AS (SELECT id, min(retrieved_doc_ids) AS ds FROM answers_gemini WHERE id IS NOT NULL GROUP BY id), u AS (SELECT id, unnest(ds) AS doc, generate_subscripts(ds, 1) AS i FROM a)
    SELECT u.id, string_agg('[' || i || '] (' || doc || ') ' || concat_ws('. ', title, text), chr(10) ORDER BY i) AS context FROM u JOIN pm ON pm.id = u.doc GROUP BY u.id""")
def build_context_answers(spark, d):
    a = table(spark, d, "answers_gemini").filter("id is not null").groupBy("id").agg(F.min("retrieved_doc_ids").alias("ds"))
    return retrieve.build_context(a, "id", "ds", _postmortems(spark, d))


@query("""SELECT DISTINCT id, _judge AS rater, judged_at, CASE WHEN citation IS NOT NULL THEN faithfulness END AS f, CASE WHEN citation IS NOT NULL THEN coverage END AS c, citation IS NULL AS parse_fail FROM judged_gemini_by_gemini WHERE id IS NOT NULL""")
def parse_judgement_round_trip(spark, d):
    """Scores wrapped into a judge's chatter and parsed back; rows without a citation score stand for chatter without scores."""
    j = table(spark, d, "judged_gemini_by_gemini").filter("id is not null")
    scores = F.when(F.col("citation").isNotNull(), F.to_json(F.struct("faithfulness", "coverage"))).otherwise("{none")
    said = F.concat(F.lit("Here is my verdict:\n"), scores, F.lit("\nThank you."))
    v = retrieve.parse_judgement(said)
    return j.select("id", F.col("_judge").alias("rater"), "judged_at", F.try_variant_get(v, "$.faithfulness", "string").alias("f"), F.try_variant_get(v, "$.coverage", "string").alias("c"), v.isNull().alias("parse_fail")).distinct()


@query("""SELECT DISTINCT id, type, question, answer, NULL::INT AS human_faithfulness, NULL::INT AS human_citation, NULL::INT AS human_coverage FROM answers_gemini""")
def label_template_answers(spark, d):
    """Answers as rows to be labelled by people."""
    return table(spark, d, "answers_gemini").select("id", "type", "question", "answer", *(F.lit(None).cast("int").alias(f"human_{a}") for a in _AXES)).distinct()


query(_verdict_sql())(publish_gate_verdicts)

"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.logparse import parse_log
from assay.operators.skew import heavy_keys, percentiles_by_key, profile_by_key
from assay.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log entry of logtriage with its first and last line, time, level and component."""
    return parse_log(table(spark, sf_dir, "logtriage")).select("first_id", "last_id", "ts", "level", "component")


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole entries, with their message and number of lines."""
    return parse_log(table(spark, sf_dir, "logtriage"), message=True)


def _key(name: str) -> Column:
    """A group of decisions as it is compared: lower case, without outer blanks; an empty one is none."""
    k = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_by_key(table(spark, sf_dir, "decisions"), _key("group"), F.col("outcome"))


def _logtriage(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert = F.when(F.col("label").isNotNull(), (F.col("label") == "alert").cast("int"))
    return profile_by_key(table(spark, sf_dir, "logtriage"), F.col("group"), alert)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that hold at least 4 percent of the rows of decisions or of logtriage."""
    found = [heavy_keys(f(spark, sf_dir), 0.04).select(F.lit(tab).alias("tab"), F.col("key").alias("group_key")) for tab, f in (("decisions", _decisions), ("logtriage", _logtriage))]
    return found[0].unionByName(found[1])


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, valued rows, distinct values, mode and mean (outcome, or share of alerts) of each group of both tables."""
    frames = [f(spark, sf_dir).select(F.lit(tab).alias("tab"), F.col("key").alias("group_key"), "n", "n_valued", "n_distinct", F.col("mode").cast("double").alias("mode"), F.round("mean", 6).alias("mean")) for tab, f in (("decisions", _decisions), ("logtriage", _logtriage))]
    return frames[0].unionByName(frames[1])


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and the 95th percentile of value in each group of decisions."""
    found = percentiles_by_key(table(spark, sf_dir, "decisions"), _key("group"), F.col("value"), [0.25, 0.5, 0.75, 0.95])
    return found.select(F.col("key").alias("group_key"), "share", "percentile")


_KEY = "nullif(lower(regexp_replace(\"group\", '^\\s+|\\s+$', '', 'g')), '')"
_FINITE = "isfinite({0})"

QUERIES = {f.__name__: f for f in (p1_found, p1_entries, p6_found, p6_groups, p6_percentiles)}
SQL: dict[str, str] = {
    "p6_found": f"""
        WITH a AS (SELECT 'decisions' AS tab, {_KEY} AS group_key FROM decisions
                   UNION ALL SELECT 'logtriage', "group" FROM logtriage),
             t AS (SELECT tab, count(*) AS total FROM a GROUP BY tab)
        SELECT a.tab, group_key FROM a JOIN t ON a.tab = t.tab WHERE group_key IS NOT NULL
        GROUP BY a.tab, group_key, total HAVING count(*) >= 0.04 * total""",
    "p6_groups": f"""
        WITH a AS (SELECT 'decisions' AS tab, {_KEY} AS group_key, CASE WHEN isfinite(outcome) THEN outcome END AS v FROM decisions
                   UNION ALL SELECT 'logtriage', "group", CASE label WHEN 'alert' THEN 1.0::DOUBLE ELSE CASE WHEN label IS NOT NULL THEN 0.0::DOUBLE END END FROM logtriage),
             f AS (SELECT tab, group_key, v, count(*) AS w FROM a GROUP BY ALL)
        SELECT tab, group_key, sum(w)::BIGINT AS n, coalesce(sum(w) FILTER (WHERE v IS NOT NULL), 0)::BIGINT AS n_valued, count(v) AS n_distinct,
               arg_min(v, (-w, v)) FILTER (WHERE v IS NOT NULL) AS mode, round(sum(v * w) / sum(w) FILTER (WHERE v IS NOT NULL), 6) AS mean
        FROM f GROUP BY tab, group_key""",
    "p6_percentiles": f"""
        WITH a AS (SELECT {_KEY} AS group_key, value FROM decisions WHERE isfinite(value)),
             r AS (SELECT group_key, value, row_number() OVER (PARTITION BY group_key ORDER BY value) AS rn, count(*) OVER (PARTITION BY group_key) AS n FROM a),
             s AS (SELECT unnest([0.25, 0.5, 0.75, 0.95])::DOUBLE AS share)
        SELECT group_key, share, value AS percentile FROM r, s WHERE rn = greatest(1, ceil(share * n))""",
}

"""Look-ahead, split, target and duplicate leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.prob import finite
from assay.operators.ordinal import with_ordinal
from assay.operators.skew import join_hot
from assay.sources.tables import cut


def repeated_entities(df: DataFrame, entity: Column, time: Column, outcome: Column, uid: str) -> DataFrame:
    """(entity, appearances, risk) of entities seen at least twice: H if a later row has an outcome above 0, else M.

    Rows are in order of time (null first), ties by uid. Only the first row of an entity must be known, so this is an
    aggregate and no window."""
    rows = df.select(entity.alias("entity"), F.struct(time.isNotNull(), time, F.col(uid)).alias("at"), F.coalesce((finite(outcome) & (outcome > 0)).cast("int"), F.lit(0)).alias("hit")).filter("entity is not null")
    s = rows.groupBy("entity").agg(F.count("*").alias("appearances"), F.sum("hit").alias("hits"), F.min_by("hit", "at").alias("first")).filter("appearances > 1")
    return s.select("entity", "appearances", F.when(F.col("hits") - F.col("first") > 0, "H").otherwise("M").alias("risk"))


def reappearance_flags(df: DataFrame, group: str, entity: str, time: str, baseline: str, uid: str, level: str | None = None, top_k: int = 3) -> DataFrame:
    """(group, level): H, M, L? or L: whether entities of a group appear again, and are promoted, after the group's first time.

    An entity is promoted if it has a later record of a higher level than the row's (any later record without a level
    column). H: the row with the lowest baseline is promoted; M: one of the top_k is, or two rows; L?: two rows reappear;
    L otherwise. A group without time is L. Rows without a group are in no group, but later records of their entity.

    Later records are reduced to (time, highest level from there on) per entity and day, and days per entity, before the
    join, and the lowest baselines are taken in parts of a group first, so neither a group nor a placeholder entity with
    most rows is one task's."""
    lev = F.col(level).cast("double") if level else F.lit(0.0)
    rows = df.select(F.col(group).alias("g"), F.col(entity).alias("e"), F.col(time).alias("t"), F.col(baseline).cast("double").alias("b"), F.col(uid).alias("u"), lev.alias("l"))
    every = cut(rows)
    rows = every.filter("g is not null")
    start = rows.groupBy("g").agg(F.min("t").alias("t0"))
    first = rows.select("g", "e", "u", "b", "l", F.pmod(F.xxhash64("u"), F.lit(64)).alias("part"))
    for by in (["g", "part"], ["g"]):
        first = first.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("b").asc_nulls_last(), "u"))).filter(F.col("r") <= top_k)
    dated = rows.schema["t"].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    day = lambda c: F.to_date(c) if dated else F.lit(0)  # noqa: E731 - times of other types are not parted by day
    timed = every.filter("e is not null and t is not null").groupBy("e", "t").agg(F.max("l").alias("l")).withColumn("d", day("t"))
    probes = join_hot(cut(rows.filter("e is not null").select("g", "e").distinct()), start.filter("t0 is not null"), ["g"]).select("g", "e", "t0", day("t0").alias("d"))
    # Merged with the day's records in falling order of time, each (group, entity) sees the next one of the day last.
    merged = timed.select(F.lit(None).cast(rows.schema["g"].dataType).alias("g"), "e", "d", "t", "l", F.lit(1).alias("k")).unionByName(probes.select("g", "e", "d", F.col("t0").alias("t"), F.lit(None).cast("double").alias("l"), F.lit(0).alias("k")))
    merged = cut(merged)
    falling = Window.partitionBy("e", "d").orderBy(F.desc("t"), "k").rowsBetween(Window.unboundedPreceding, 0)
    today = merged.withColumns({"next": F.max(F.when(F.col("k") == 1, F.col("t"))).over(falling), "top": F.max("l").over(falling)}).filter("k = 0")
    days = merged.groupBy("e", "d").agg(F.max("l").alias("l"), F.max("k").alias("k"))
    after = Window.partitionBy("e").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("e", "d", F.max("l").over(after).alias("later_l"), F.max("k").over(after).alias("later_k"))
    found = today.join(days, ["e", "d"]).filter(F.col("next").isNotNull() | (F.col("later_k") == 1))
    later = found.select("g", "e", F.greatest("top", "later_l").alias("top"), F.lit(True).alias("again"))
    later = cut(later)
    seen = rows.select("g", "e", "l").join(later, ["g", "e"], "left")
    up = F.coalesce(F.col("again") & ((F.col("top") > F.col("l")) if level else F.lit(True)), F.lit(False))
    n = lambda c: F.sum(c.cast("int"))
    s = seen.groupBy("g").agg(n(up).alias("ups"), n(F.col("again").isNotNull()).alias("again"))
    lowest = first.join(later, ["g", "e"]).groupBy("g").agg(n(up & (F.col("r") == 1)).alias("fav"), n(up).alias("top"))
    s = s.join(lowest, "g", "left").fillna(0, ["fav", "top"])
    flag = F.when(F.col("fav") > 0, "H").when((F.col("top") > 0) | (F.col("ups") >= 2), "M").when(F.col("again") >= 2, "L?").otherwise("L")
    return s.select(F.col("g").alias("group"), flag.alias("level"))


def split_contamination(df: DataFrame, group: Column, time: Column, split) -> DataFrame:
    """(group) of groups with rows both before the split and from it on; rows without time don't count."""
    s = df.select(group.alias("group"), time.alias("t")).filter("group is not null and t is not null").groupBy("group").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    return s.filter((F.col("a") < F.lit(split)) & (F.col("z") >= F.lit(split))).select("group")


def target_leak_scan(df: DataFrame, features: list[str], outcome: Column, uid: str, thresh: float = 0.95) -> DataFrame:
    """(feature, n, separation, leaks): the difference of mean outcome between the quarters of highest and lowest values.

    Features need 30 rows with finite feature and outcome; ties are in order of uid. separation is rounded to three places
    after the comparison."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features)))
    rows = df.filter(finite(outcome)).select(F.col(uid).alias("u"), outcome.cast("double").alias("y"), pairs.alias("p")).select("u", "y", "p.feature", "p.x").filter(finite(F.col("x")))
    numbered = cut(with_ordinal(rows, ["x", "u"], by=["feature"]))
    n = numbered.groupBy("feature").agg(F.count("*").alias("n")).filter("n >= 30")
    q = F.floor(F.col("n") / 4)
    s = numbered.join(F.broadcast(n), "feature").groupBy("feature", "n").agg(F.abs(F.avg(F.when(F.col("ord") >= F.col("n") - q, F.col("y"))) - F.avg(F.when(F.col("ord") < q, F.col("y")))).alias("s"))
    return s.select("feature", "n", F.round("s", 3).alias("separation"), (F.col("s") >= thresh).alias("leaks"))


def duplicates(df: DataFrame, entity: Column, time: Column) -> DataFrame:
    """(entity, time, n) that occur more than once; a null entity never does, a null time is a time."""
    return df.select(entity.alias("entity"), time.alias("time")).filter("entity is not null").groupBy("entity", "time").agg(F.count("*").alias("n")).filter("n > 1")


def leak_report(flags: DataFrame, straddling: DataFrame, targets: DataFrame, dups: DataFrame) -> DataFrame:
    """(check, n, clean) of the four checks and of all; L and L? are tolerated."""
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = n("reappearance", flags.filter("level in ('H', 'M')")).unionByName(n("split", straddling)).unionByName(n("target", targets.filter("leaks"))).unionByName(n("duplicate", dups))
    parts = cut(parts)
    whole = parts.agg(F.sum("n").alias("n")).select(F.lit("all").alias("check"), "n")
    return parts.unionByName(whole).withColumn("clean", F.col("n") == 0)

"""Consensus of several raters by the triplet moment method.

Agreement rates of rater pairs, corrected for chance, are products of the two raters' skills; of three raters each skill
follows from the three rates. A rater's skill is the median over all triplets with it, so that pairs who copy each other
don't lift themselves. Votes are combined with the log-odds of the accuracies that follow from the skills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.tables import cut


def usable_score(raw: Column, highest: int = 2) -> Column:
    """0..highest from any numeric spelling, alone or as the only member of a list; null otherwise."""
    x = F.translate(F.trim(F.regexp_replace(raw, r"[\s 　]+", " ")), "０１２３４５６７８９．", "0123456789.")
    x = F.regexp_replace(x, r"^\[\s*([^\[\],]*?)\s*\]$", "$1")
    x = F.trim(F.regexp_replace(x, r"^([\"'])(.*)\1$", "$2"))
    value = F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), x).try_cast("double")
    # The usual spelling needs no pattern.
    usual = raw.isin([str(k) for k in range(highest + 1)])
    return F.when(usual, raw.cast("int")).when((value >= 0) & (value <= highest) & (value == F.floor(value)), value.cast("int"))


def latest_scores(df: DataFrame, item: str, rater: str, at: str, axes: list[str], highest: int = 2) -> DataFrame:
    """(item, axis, rater, score): usable scores of each rater's latest row for an item.

    Rows without item or rater are left out; a null time is the earliest; of rows with equal times the one with the
    greatest scores as text counts. A latest score that isn't usable gives none."""
    rows = df.select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.col(at).alias("at"), *(F.col(a).alias(f"s{i}") for i, a in enumerate(axes)))
    rows = rows.filter("item is not null and rater is not null")
    rank = F.struct("at", *(F.coalesce(f"s{i}", F.lit("")) for i in range(len(axes))))
    last = rows.groupBy("item", "rater").agg(F.max_by(F.struct(*(f"s{i}" for i in range(len(axes)))), rank).alias("s"))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), usable_score(F.col(f"s.s{i}"), highest).alias("score")) for i, a in enumerate(axes))))
    return last.select("item", "rater", each.alias("e")).select("item", "e.axis", "rater", "e.score").filter("score is not null")


def pair_agreement(votes: DataFrame, least: int = 20) -> DataFrame:
    """From (item, axis, rater, score): (a, b, n, c) of raters a < b with at least `least` common items: their agreement
    corrected for chance, which follows from the two raters' own frequencies over their common items.

    Votes meet within an item and are counted by the two raters and scores within each task first."""
    left = votes.select("item", "axis", F.col("rater").alias("a"), F.col("score").alias("x"))
    right = votes.select("item", "axis", F.col("rater").alias("b"), F.col("score").alias("y"))
    cells = cut(left.join(right, ["item", "axis"]).filter("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").alias("k")))
    total = cells.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("k")).otherwise(0)).alias("same")).filter(F.col("n") >= least)
    of = lambda c, name: cells.groupBy("a", "b", F.col(c).alias("s")).agg(F.sum("k").alias(name))
    chance = of("x", "kx").join(of("y", "ky"), ["a", "b", "s"]).groupBy("a", "b").agg(F.sum(F.col("kx").cast("double") * F.col("ky")).alias("both"))
    p = F.coalesce("both", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    c = F.when(p < 1, (F.col("same") / F.col("n") - p) / (1 - p)).otherwise(0.0)
    return total.join(chance, ["a", "b"], "left").select("a", "b", "n", c.alias("c"))


def triplet_skills(agreement: DataFrame, partners: int | None = None, informative: float = 0.1) -> DataFrame:
    """From (a, b, n, c): (rater, skill) in 0..1: the root of the median over pairs (j, k) of c_ij c_ik / c_jk.

    j and k run over all raters with whom a rater was compared or, if partners is given, those with most items in common.
    Pairs with c_jk at most `informative` form no triplet; a rater in none has no row. The median is exact; it is taken by
    ranks, which spill, so that a rater with many triplets needs no more memory."""
    pairs = cut(agreement)
    ways = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "n", "c").unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "n", "c"))
    if partners is not None:
        near = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "j"))
        ways = ways.withColumn("r", near).filter(F.col("r") <= partners)
    one, two = ways.select("i", "j", F.col("c").alias("cij")), ways.select("i", F.col("j").alias("k"), F.col("c").alias("cik"))
    known = pairs.filter(F.col("c") > informative).select(F.col("a").alias("j"), F.col("b").alias("k"), F.col("c").alias("cjk"))
    # A partner j meets the known pairs of j; those whose k is a partner too stay.
    triplets = one.join(known, "j").join(two, ["i", "k"])
    ratios = triplets.select("i", (F.col("cij") * F.col("cik") / F.col("cjk")).alias("x"))
    ranked = ratios.select("i", "x", F.row_number().over(Window.partitionBy("i").orderBy("x")).alias("r"), F.count("*").over(Window.partitionBy("i")).alias("m"))
    middle = ranked.filter((F.col("r") == F.floor((F.col("m") + 1) / 2)) | (F.col("r") == F.floor(F.col("m") / 2) + 1))
    median = middle.groupBy("i").agg(F.avg("x").alias("m"))
    return median.select(F.col("i").alias("rater"), F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m")))).alias("skill"))


#: Raters up to which their weights are sent to every task; more are joined by a shuffle.
BROADCAST_RATERS = 200_000


def consensus(votes: DataFrame, *, classes: int = 3, least_raters: int = 3, partners: int | None = None) -> tuple[DataFrame, DataFrame]:
    """From (item, axis, rater, score): scores and raters.

    Scores: item, axis, score, n_raters, agreement (the winner's share of the weight) for each item and axis with votes
    of at least least_raters. Raters: rater, n_votes, skill, accuracy, weight. A rater no better than chance weighs 0; an
    item with no other raters is decided by majority; ties go to the lower score. No votes give empty frames. Any number of
    raters is handled by joins; a rater's skill follows from all raters compared with them, or the `partners` with most items in common."""
    votes = cut(votes.select("item", "axis", "rater", "score"))
    counts = votes.groupBy("rater").agg(F.count("*").alias("n_votes"))
    raters = counts.join(triplet_skills(pair_agreement(votes), partners), "rater", "left").withColumn("skill", F.coalesce("skill", F.lit(0.0)))
    accuracy = F.least(F.lit(0.995), F.greatest(F.lit(1 / classes), (1 + (classes - 1) * F.col("skill")) / classes))
    raters = raters.withColumn("accuracy", accuracy)
    weight = F.greatest(F.lit(0.0), F.log(F.col("accuracy") * (classes - 1) / (1 - F.col("accuracy"))))
    raters = cut(raters.withColumn("weight", weight).select("rater", "n_votes", "skill", "accuracy", "weight"))
    of = raters.select("rater", "weight")
    weighed = votes.join(F.broadcast(of) if raters.count() <= BROADCAST_RATERS else of, "rater")
    sums = [F.sum(F.when(F.col("score") == k, F.col("weight") + 1e-6).otherwise(0.0)).alias(f"w{k}") for k in range(classes)]
    out = weighed.groupBy("item", "axis").agg(F.count("*").alias("n_raters"), *sums).filter(F.col("n_raters") >= least_raters)
    w = [F.round(f"w{k}", 9) for k in range(classes)]
    best = F.greatest(*w)
    score = F.coalesce(*(F.when(x == best, k) for k, x in enumerate(w)))
    share = best / sum(w[1:], w[0])
    return out.select("item", "axis", score.alias("score"), "n_raters", F.round(share, 6).alias("agreement")), raters

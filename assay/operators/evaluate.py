"""Comparisons of answers, prompts and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.agree import cohens_kappa, decision_value, value_of_information
from assay.operators.intervals import confidence_sequence, mean_ci, power_mean
from assay.operators.resample import ratio_ci
from assay.sources.tables import cut


def first_word(text: Column, words: dict[str, str], default: str = "unk") -> Column:
    """The label of the word that occurs first in the text, of equals the first given; default where none does."""
    at = {label: F.instr(F.lower(F.coalesce(text, F.lit(""))), w) for w, label in words.items()}
    best = F.least(*(F.when(p > 0, p).otherwise(2**31 - 1) for p in at.values())) if len(at) > 1 else F.when(next(iter(at.values())) > 0, next(iter(at.values()))).otherwise(2**31 - 1)
    out = F.lit(default)
    for label, p in reversed(at.items()):
        out = F.when((p > 0) & (p == best), label).otherwise(out)
    return out


def polarity(text: Column) -> Column:
    """neg before pos, else unk; null (a failed call) is err."""
    t = F.lower(text)
    return F.when(text.isNull(), "err").when(F.contains(t, F.lit("neg")), "neg").when(F.contains(t, F.lit("pos")), "pos").otherwise("unk")


def _right(p: Column, truth: Column) -> Column:
    return F.coalesce((p == truth).cast("double"), F.lit(0.0))


def paired_ab(df: DataFrame, key: Column, truth: Column, a: Column, b: Column, strata: list[str], *, rule: Column | None = None, iters: int = 2000, seed: int = 42) -> DataFrame:
    """(stratum, of, n, n_groups, estimate, lo, hi, reliable...): accuracy of A and B, their paired difference and, with a
    rule, the rule's accuracy and B's difference from it, over all rows and within each value of each stratum column, from
    one scan. A null prediction is wrong; rows without truth are left out."""
    ra, rb = _right(a, truth), _right(b, truth)
    measures = {"A": ra, "B": rb} | ({"rule": _right(rule, truth)} if rule is not None else {})
    # Rows with equal key, strata and outcomes are one row from here on.
    named = [F.concat_ws("=", F.lit(s), F.coalesce(F.col(s).cast("string"), F.lit("null"))).alias(f"_s{k}") for k, s in enumerate(strata)]
    rows = df.filter(truth.isNotNull()).select(key.alias("_k"), *named, *(v.alias(name) for name, v in measures.items()))
    rows = rows.groupBy("_k", *(f"_s{k}" for k in range(len(strata))), *measures).agg(F.count("*").alias("_n"))
    values = {m: F.col(m) for m in measures} | {"B-A": F.col("B") - F.col("A")} | ({"B-rule": F.col("B") - F.col("rule")} if rule is not None else {})
    each = F.array(*(F.struct(F.lit(name).alias("of"), v.alias("v")) for name, v in values.items()))
    every = F.array(F.lit("all"), *(f"_s{k}" for k in range(len(strata))))
    long = rows.select("_k", "_n", F.explode(every).alias("stratum"), each.alias("es")).select("_k", "_n", "stratum", F.explode("es").alias("e")).select("_k", "_n", "stratum", "e.of", "e.v")
    return ratio_ci(long, F.col("_k"), F.col("v") * F.col("_n"), F.col("_n"), by=["stratum", "of"], iters=iters, seed=seed, rows=F.col("_n"))


def ab_report(df: DataFrame, key: Column, truth: Column, a: Column, b: Column, *, mde: float = 0.05, value: float = 1.0, switch_cost: float = 2.0, sampling_cost: float = 1.0, alpha: float = 0.1, iters: int = 2000, seed: int = 42) -> DataFrame:
    """One row on the paired difference of B and A, in points of accuracy: both accuracies, the difference with its interval
    and verdict, the rows needed to see mde, the anytime-valid sequence with sigma 1, whether to adopt B at its switching
    cost, and what more data would be worth. No rows with truth give no result."""
    rows = cut(df.filter(truth.isNotNull()).select(key.alias("_k"), _right(a, truth).alias("_a"), _right(b, truth).alias("_b")).withColumn("_d", F.col("_b") - F.col("_a")))
    one = lambda c, name: mean_ci(rows, F.col("_k"), F.col(c), iters=iters, seed=seed).select(*(F.col(x).alias(f"{name}_{x}") for x in ("estimate", "lo", "hi")), *(["n", "n_groups", "robust_positive", "robust_negative"] if name == "diff" else []))
    out = one("_a", "a").join(F.broadcast(one("_b", "b"))).join(F.broadcast(one("_d", "diff")))
    power = power_mean(rows, F.col("_d"), mde).select("need_n", "measurable")
    seq = confidence_sequence(rows, F.col("_d"), alpha=alpha, sigma=1.0).select(F.col("lo").alias("sequence_lo"), F.col("hi").alias("sequence_hi"), "decided")
    out = out.join(F.broadcast(power), how="left").join(F.broadcast(seq), how="left")
    points = lambda c: F.col(c) * 100
    out = decision_value(out, points("diff_estimate"), points("diff_lo"), F.lit(value), F.lit(switch_cost))
    out = value_of_information(out, points("diff_estimate"), (points("diff_hi") - points("diff_lo")) / 3.29, F.lit(value), F.lit(sampling_cost)).drop("d")
    return out.withColumn("finding", F.when(F.col("robust_positive"), "better").when(F.col("robust_negative"), "worse").otherwise("not told from luck"))


def ab_errors(df: DataFrame, uid: str, truth: Column, a: Column, b: Column) -> DataFrame:
    """(uid, of): the rows with truth that A, or B, gets wrong; a null prediction is wrong."""
    wrong = F.array_compact(F.array(F.when(_right(a, truth) == 0, F.lit("A")), F.when(_right(b, truth) == 0, F.lit("B"))))
    return df.filter(truth.isNotNull()).select(uid, F.explode(wrong).alias("of"))


def usable_judges(scores: DataFrame, judge: str, axis: Column, least: int = 20) -> DataFrame:
    return scores.groupBy(F.col(judge).alias("judge")).agg(F.count(axis).alias("n")).filter(F.col("n") >= least)


def axis_means(scores: DataFrame) -> DataFrame:
    """From (item, axis, rater, score): (rater, axis, n, mean)."""
    return scores.groupBy("rater", "axis").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


#: Comparisons (of raters by axis, say) up to which those with enough items are sent to every task; more are joined by a shuffle.
_BROADCAST_COMPARED = 100_000


def _differences(both: DataFrame, by: list[str], least: int, iters: int, seed: int) -> DataFrame:
    """From (by..., item, sa, sb): kappa, agreement and the paired difference with its interval, resampled by item."""
    both = cut(both.filter("sa is not null and sb is not null"))
    enough = cut(both.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n"))
    both = both.join(F.broadcast(enough) if enough.count() <= _BROADCAST_COMPARED else enough, by, "left_semi")
    ci = mean_ci(both, F.col("item"), F.col("sa") - F.col("sb"), by=by, iters=iters, seed=seed)
    ci = ci.select(*by, F.col("estimate").alias("difference"), "lo", "hi", "reliable", "robust_positive", "robust_negative")
    kappa = cohens_kappa(both, F.col("sa"), F.col("sb"), by).select(*by, "n", F.col("po").alias("agreement"), "kappa")
    return kappa.join(ci, by)


def pairwise_agreement(scores: DataFrame, least: int = 10, *, iters: int = 2000, seed: int = 42) -> DataFrame:
    """From (item, axis, rater, score): (axis, rater_a, rater_b, n, agreement, kappa, difference, lo, hi, reliable,
    robust_positive, robust_negative, finding) of raters with `least` items in common; finding: higher, lower or none.

    Items are matched by key; what is compared are an item's few raters."""
    scores = cut(scores.select("item", "axis", "rater", "score"))
    a = scores.select("item", "axis", F.col("rater").alias("rater_a"), F.col("score").alias("sa"))
    b = scores.select("item", "axis", F.col("rater").alias("rater_b"), F.col("score").alias("sb"))
    out = _differences(a.join(b, ["item", "axis"]).filter("rater_a < rater_b"), ["axis", "rater_a", "rater_b"], least, iters, seed)
    return out.withColumn("finding", F.when(F.col("robust_positive"), "higher").when(F.col("robust_negative"), "lower").otherwise("none"))


def ablation(with_it: DataFrame, without: DataFrame, axes: list[str], least: int = 10, *, iters: int = 2000, seed: int = 42) -> DataFrame:
    """From two frames (item, axis, rater, score): (rater, axis, n, difference, lo, hi, reliable, robust_positive,
    robust_negative, finding) of each rater's scores with and without, paired by item; at least `least` items in common."""
    a = with_it.filter(F.col("axis").isin(axes)).select("item", "axis", "rater", F.col("score").alias("sa"))
    b = without.filter(F.col("axis").isin(axes)).select("item", "axis", "rater", F.col("score").alias("sb"))
    out = _differences(a.join(b, ["item", "axis", "rater"]), ["rater", "axis"], least, iters, seed).drop("kappa", "agreement")
    return out.withColumn("finding", F.when(F.col("robust_positive"), "with").when(F.col("robust_negative"), "without").otherwise("none"))


def human_agreement(human: DataFrame, scores: DataFrame, least: int = 10, *, iters: int = 2000, seed: int = 42) -> DataFrame:
    """From people's (item, axis, score) and judges' (item, axis, rater, score): (rater, axis, n, agreement, kappa,
    difference, lo, hi, reliable, robust_positive, robust_negative, finding); finding: lenient, strict or none."""
    a = scores.select("item", "axis", "rater", F.col("score").alias("sa"))
    out = _differences(a.join(human.select("item", "axis", F.col("score").alias("sb")), ["item", "axis"]), ["rater", "axis"], least, iters, seed)
    return out.withColumn("finding", F.when(F.col("robust_positive"), "lenient").when(F.col("robust_negative"), "strict").otherwise("none"))


def stratified_sample(df: DataFrame, kind: Column, event: Column, uid: str, caps: dict[str, int], limits: dict[str, int], seed: int = 42, spread: int = 64) -> DataFrame:
    """Rows with kind and event: at most caps[kind] of each event and limits[kind] of each kind, chosen by hash.

    This is a sampling operator; the order is that of md5(seed, uid), so it doesn't depend on partitions. Ranks are taken
    in `spread` parts of each event and of each kind first, so an event with most rows is no single task's."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(uid).cast("string")))
    rows = df.withColumns({"_kind": kind, "_event": event, "_h": h}).filter("_kind is not null and _event is not null").withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(spread)))
    pick = lambda d: F.coalesce(*(F.when(F.col("_kind") == k, F.lit(v)) for k, v in d.items()), F.lit(0))
    for within, most in ((["_kind", "_event", "_s"], caps), (["_kind", "_event"], caps), (["_kind", "_s"], limits), (["_kind"], limits)):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy("_h", uid))).filter(F.col("_r") <= pick(most))
    return rows.drop("_r", "_h", "_s").withColumnsRenamed({"_kind": "kind_", "_event": "event_"})


def peeking_rates(spark, trials: int = 500, n: int = 500, min_n: int = 30, step: int = 10, alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """(method, trials, false_positives): how often looking again and again finds an effect in noise: a fixed interval, and
    the anytime-valid sequence with sigma 1. Draws are uniform hashes scaled to deviation 1."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("trial").cast("string"), F.lit(":"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("double")
    x = (h / 4294967296.0 - 0.5) * 3.4641016151377544
    rows = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).withColumn("x", x)
    w = Window.partitionBy("trial").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("trial", F.col("k").alias("n"), F.avg("x").over(w).alias("m"), F.stddev_samp("x").over(w).alias("sd")).filter((F.col("n") >= min_n) & ((F.col("n") - min_n) % step == 0))
    k = F.col("n") * 0.25 + 1
    radius = F.sqrt(2 * k / (F.col("n").cast("double") * F.col("n") * 0.25) * F.log(F.sqrt(k) / alpha))
    hit = run.groupBy("trial").agg(F.max((F.abs("m") > 1.645 * F.col("sd") / F.sqrt("n")).cast("int")).alias("fixed"), F.max((F.abs("m") > radius).cast("int")).alias("sequence"))
    return hit.agg(F.count("*").alias("trials"), F.sum("fixed").alias("fixed"), F.sum("sequence").alias("sequence")).selectExpr("stack(2, 'fixed', fixed, 'sequence', sequence) as (method, false_positives)", "trials").select("method", "trials", "false_positives")

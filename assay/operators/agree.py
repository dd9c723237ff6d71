"""Agreement of raters, paired differences, and the value of deciding or of more data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.prob import unit_normal_loss
from assay.sources.tables import cut


def cohens_kappa(df: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., n, po, pe, kappa, degenerate); pairs with a null are left out; kappa is null where chance agreement is 1."""
    by = by or []
    cells = df.select(*by, a.cast("string").alias("a"), b.cast("string").alias("b")).filter("a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count("*").alias("c"))
    cells = cut(cells)
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    each = cells.select(*by, F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb")), F.struct(F.col("b").alias("x"), F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb")))).alias("e"))
    margins = each.groupBy(*by, "e.x").agg(F.sum("e.ca").alias("ca"), F.sum("e.cb").alias("cb")).groupBy(*by).agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("by_chance"))
    out = total.join(margins, by) if by else total.filter("n > 0").join(F.broadcast(margins))
    po, pe = F.col("same") / F.col("n"), F.col("by_chance") / (F.col("n").cast("double") * F.col("n"))
    out = out.withColumns({"po": po, "pe": pe})
    return out.select(*by, "n", "po", "pe", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), (F.col("pe") >= 1).alias("degenerate"))


def decision_value(df: DataFrame, mean: Column, low: Column, value: Column, switch_cost: Column) -> DataFrame:
    """Adds expected_net, worst_net and verdict: adopt if both are above 0, conditional if the first is, else reject."""
    e, w = mean * value - switch_cost, low * value - switch_cost
    return df.withColumns({"expected_net": e, "worst_net": w, "verdict": F.when((w > 0) & (e > 0), "adopt").when(e > 0, "conditional").otherwise("reject")})


def value_of_information(df: DataFrame, mean: Column, se: Column, value: Column, sampling_cost: Column) -> DataFrame:
    """Adds d, evpi (what a perfect answer is worth) and worth_sampling; no uncertainty makes d infinite and evpi 0."""
    d = F.when(se > 0, F.abs(mean) / F.when(se > 0, se)).otherwise(float("inf"))
    loss = F.when(se > 0, value * se * unit_normal_loss(F.abs(mean) / F.when(se > 0, se))).otherwise(0.0)
    return df.withColumns({"d": d, "evpi": loss, "worth_sampling": loss > sampling_cost})

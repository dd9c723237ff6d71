"""Row numbers over a whole frame without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.tables import cut


def with_ordinal(df: DataFrame, order: list[str], name: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2... in the order of `order` (which should be unique), within each value of `by` if given.

    Rows are laid out by range; only the numbers of rows per range are brought together."""
    keys = [*(by or []), *order]
    if not df.columns:
        raise ValueError("no columns")
    ranged = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    by = by or []
    sums = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_here"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0))).drop("_here")
    here = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_rn", here)
    if by:
        numbered = numbered.join(sums.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_part").alias("_p"), "_before"), (F.col("_part") == F.col("_p")) & _all_same(by))
        numbered = numbered.drop("_p", *(f"_by_{b}" for b in by))
    else:
        numbered = numbered.join(sums, "_part")
    return numbered.withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint")).drop("_part", "_rn", "_before")


def _all_same(by: list[str]) -> Column:
    out = F.lit(True)
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return out

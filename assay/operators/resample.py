"""Cluster bootstrap over groups.

Every statistic here is a ratio of sums over the drawn groups, so rows are reduced to (numerator, denominator) per group
first and never touched again. Draws are hashes of (seed, iteration, number of the draw) in 32-bit arithmetic: the same on
any partitioning and in SQL. Up to a bound the groups' sums are broadcast as arrays and a task adds up whole iterations;
beyond it each value of `by` has its arrays sent to its own tasks; beyond a bound for one value the draws are rows that are
joined by a shuffle, or, with method="poisson", hashes of the group itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.prob import MIN_GROUPS
from assay.operators.ordinal import with_ordinal
from assay.sources.tables import cut

# Labels that every interval carries.
CI_METHOD, CI_CAVEAT = "percentile", "heavy_tailed_undercoverage"


def group_stats(df: DataFrame, key: Column, num: Column, den: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., key, num, den): sums per group; rows with a null numerator count in neither."""
    rows = df.select(*(by or []), key.alias("key"), num.cast("double").alias("num"), den.cast("double").alias("den")).filter("num is not null")
    return rows.groupBy(*(by or []), "key").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


_WORD = 0xFFFFFFFF
#: Numbers of draws that are worked on together, so that they stay in the processor's cache.
_CHUNK = 65_536


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers, in place."""
    t = np.empty_like(x)
    for by, times in ((15, 0x2C1B3C6D), (12, 0x297A2D39), (15, None)):
        np.right_shift(x, np.uint32(by), out=t)
        x ^= t
        if times:
            x *= np.uint32(times)
    return x


def _resampled(nums: np.ndarray, dens: np.ndarray, its: np.ndarray, seed: int) -> np.ndarray:
    """From k statistics over the same number m of groups (k, m) and iterations: (k, iterations) values, NaN where the
    denominators add up to 0. Draws depend on m alone, so all k share them."""
    k, m = nums.shape
    v = np.full((k, len(its)), np.nan)
    start = _mixed(((its.astype(np.uint64) + np.uint64(1000003 * seed)) & np.uint64(_WORD)).astype(np.uint32))
    j = np.arange(m, dtype=np.uint32)
    even = dens[:, 0] if (dens == dens[:, :1]).all() and (dens[:, 0] == np.floor(dens[:, 0])).all() else None
    for at in range(0, len(its), each := max(1, _CHUNK // m)):
        x = _mixed(start[at : at + each, None] ^ j[None, :])
        x -= x // np.uint32(m) * np.uint32(m)
        if k == 1:
            drawn = x.astype(np.intp)
            n = nums[0].take(drawn, mode="clip").sum(1)[None]
            d = even[:, None] * m if even is not None else dens[0].take(drawn, mode="clip").sum(1)[None]
        else:
            times = np.empty((m, len(x)))
            for r, row in enumerate(x):
                times[:, r] = np.bincount(row.astype(np.intp), minlength=m)
            n = nums @ times
            d = even[:, None] * m if even is not None else dens @ times
        d = np.broadcast_to(d, n.shape)
        v[:, at : at + each] = np.divide(n, d, out=np.full(n.shape, np.nan), where=d != 0)
    return v


def mixed(x: Column) -> Column:
    """The same hash of a bigint column with values below 2**32."""
    step = lambda x, by, times: ((x.bitwiseXOR(F.shiftright(x, by))) * F.lit(times).cast("bigint")).bitwiseAND(F.lit(_WORD))
    x = step(step(x, 15, 0x2C1B3C6D), 12, 0x297A2D39)
    return x.bitwiseXOR(F.shiftright(x, 15))


def replicates(stats: DataFrame, iters: int = 2000, seed: int = 42, by: list[str] | None = None, broadcast_groups: int = 2_000_000, task_groups: int = 4_000_000) -> DataFrame:
    """(by..., i, v): the statistic sum(num) / sum(den) of each resample of the groups; null denominators are dropped.

    Draw j of iteration i takes the group with number hash(hash(i + 1000003 seed) xor j) modulo the number of groups, in the
    order of key within by. stats is read several times, so it should be a table. Up to broadcast_groups groups their sums are
    sent to every executor (16 bytes a group). Of more groups, as long as no value of by has over task_groups, arrays of their
    sums go to the tasks that resample them. Beyond that groups are numbered by range and the draws are joined to them by a
    shuffle. The result is the same."""
    by = by or []
    groups = stats.count()
    if groups > broadcast_groups:
        if (stats.groupBy(*by).count().agg(F.max("count")).first()[0] if by else groups) > task_groups:
            return _joined_replicates(stats, iters, seed, by)
        return _dealt_replicates(stats, iters, seed, by)
    spark = stats.sparkSession
    known = stats.select(*by, "key", "num", "den").sort(*by, "key").drop("key").toArrow()
    num, den = (known[c].to_numpy(zero_copy_only=False).astype("float64") for c in ("num", "den"))
    starts = _starts(known, by)
    names = pa.table({b: known[b] for b in by}).take(pa.array(starts, pa.int64())) if by else None
    shared = spark.sparkContext.broadcast((num, np.nan_to_num(den), np.array([*starts, groups]), names))
    schema = _schema(stats, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den, bounds, names = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = np.full(len(ids), np.nan)
            which, its = ids // iters, ids % iters
            for g in np.unique(which):
                rows = np.nonzero(which == g)[0]
                own = slice(bounds[g], bounds[g + 1])
                v[rows] = _resampled(num[None, own], den[None, own], its[rows], seed)[0]
            keep = np.nonzero(~np.isnan(v))[0]
            columns = [c.combine_chunks().take(pa.array(which[keep])) for c in names.columns] if names is not None else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(its[keep].astype("int32")), pa.array(v[keep])], names=[*(names.column_names if names is not None else []), "i", "v"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, groups * iters // 1_000_000))
    return spark.range(len(starts) * iters, numPartitions=tasks).mapInArrow(run, schema)


def _schema(stats: DataFrame, by: list[str]) -> str:
    of_by = ", ".join(f"`{b}` {t}" for b, t in stats.select(*by).dtypes)
    return ", ".join(x for x in (of_by, "i int, v double") if x)


def _starts(rows: pa.Table | pa.RecordBatch, by: list[str]) -> list[int]:
    """Where in rows in the order of by another value of by begins."""
    n = rows.num_rows
    other = np.zeros(n, bool)
    other[:1] = True
    for c in by:
        x = rows[c].combine_chunks() if isinstance(rows, pa.Table) else rows[c]
        code = x.dictionary_encode().indices if not isinstance(x, pa.ChunkedArray) else x.dictionary_encode().combine_chunks().indices
        code = code.fill_null(-1).to_numpy(zero_copy_only=False)
        other[1:] |= code[1:] != code[:-1]
    return np.nonzero(other)[0].tolist()


#: Statistics over equally many groups that are resampled together, as long as they have no more than so many groups in all.
_TOGETHER, _TOGETHER_GROUPS = 8, 1_000_000


def _dealt_replicates(stats: DataFrame, iters: int, seed: int, by: list[str]) -> DataFrame:
    """The same by arrays: the groups' sums in the order of their keys become blocks of arrays, and the blocks of each value
    of by go to the tasks that make some of its iterations."""
    spark = stats.sparkSession
    of_by = "".join(f"`{b}` {t}, " for b, t in stats.select(*by).dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            if not b.num_rows:
                continue
            starts = _starts(b, by)
            offsets = pa.array([*starts, b.num_rows], pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, b[c].fill_null(0.0)) for c in ("num", "den")]
            at = pa.array(starts, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in by), pa.array([part] * len(starts), pa.int32()), pa.array([seq] * len(starts), pa.int32()), *arrays], names=[*by, "part", "seq", "num", "den"])

    ordered = stats.select(*by, "key", "num", "den").repartitionByRange(*by, "key").sortWithinPartitions(*by, "key").drop("key")
    blocks = cut(ordered.mapInArrow(pack, of_by + "part int, seq int, num array<double>, den array<double>"))
    sizes = blocks.groupBy(*by).agg(F.sum(F.size("num")).alias("m"))
    # Values of by with equally many groups have the same draws.
    together = F.greatest(F.lit(1), F.least(F.lit(_TOGETHER), F.floor(_TOGETHER_GROUPS / F.col("m"))))
    lot = F.floor((F.row_number().over(Window.partitionBy("m").orderBy(*by)) - 1) / together) if by else F.lit(0)
    sizes = cut(sizes.withColumn("lot", lot.cast("bigint")))
    lots, parallel = sizes.select("m", "lot").distinct().count(), spark.sparkContext.defaultParallelism
    slices = max(1, min(iters, -(-4 * parallel // lots)))
    if by:
        same = [blocks[b].eqNullSafe(sizes[b]) for b in by]
        few = F.broadcast(sizes) if lots <= 100_000 else sizes
        blocks = blocks.join(few, same).select(*(blocks[b] for b in by), "part", "seq", "num", "den", "m", "lot")
    else:
        blocks = blocks.join(F.broadcast(sizes))
    blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = blocks.repartition(min(8 * parallel, lots * slices), "m", "lot", "slice").sortWithinPartitions("m", "lot", "slice", *by, "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, named, nums, dens = None, [], [], []

        def values() -> Iterator[pa.RecordBatch]:
            its = np.arange(iters * here[2] // slices, iters * (here[2] + 1) // slices)
            v = _resampled(np.array([np.concatenate(x) for x in nums]), np.array([np.concatenate(x) for x in dens]), its, seed)
            for row, name in zip(v, named):
                keep = np.nonzero(~np.isnan(row))[0]
                columns = [pa.repeat(x, len(keep)) for x in name]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(its[keep].astype("int32")), pa.array(row[keep])], names=[*by, "i", "v"])

        for b in batches:
            for r in range(b.num_rows):
                at, name = tuple(b[c][r].as_py() for c in ("m", "lot", "slice")), [b[c][r] for c in by]
                if at != here:
                    if here:
                        yield from values()
                    here, named, nums, dens = at, [], [], []
                if not named or named[-1] != name:
                    named.append(name)
                    nums.append([])
                    dens.append([])
                # Copied, so that the batch isn't kept.
                nums[-1].append(b["num"][r].values.to_numpy().copy())
                dens[-1].append(b["den"][r].values.to_numpy().copy())
        if here:
            yield from values()

    return dealt.mapInArrow(run, _schema(stats, by))


def _joined_replicates(stats: DataFrame, iters: int, seed: int, by: list[str]) -> DataFrame:
    numbered = cut(with_ordinal(stats, ["key"], by=by))
    m = numbered.groupBy(*by).agg(F.count("*").alias("m"))
    its = stats.sparkSession.range(iters).select(F.col("id").cast("int").alias("i"))
    # Numbers of draws in runs of 65,536, so that no row holds the draws of all groups.
    runs = its.join(m).withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / 65536)))).repartition(*by, "i", "r")
    upto = F.least(F.col("m") - 1, F.col("r") * 65536 + 65535)
    draws = runs.withColumn("h", mixed((F.col("i").cast("bigint") + 1000003 * seed).bitwiseAND(F.lit(_WORD)))).withColumn("j", F.explode(F.sequence(F.col("r") * 65536, upto)))
    draws = draws.select(*by, "i", F.pmod(mixed(F.col("h").bitwiseXOR(F.col("j").bitwiseAND(F.lit(_WORD)))), F.col("m")).alias("ord"))
    # A group drawn several times in an iteration is one row.
    times = draws.groupBy(*by, "i", "ord").agg(F.count("*").alias("times"))
    sums = times.join(numbered.select(*by, "ord", "num", "den"), [*by, "ord"]).groupBy(*by, "i").agg(F.sum(F.col("num") * F.col("times")).alias("n"), F.sum(F.col("den") * F.col("times")).alias("d"))
    return sums.select(*by, "i", F.try_divide("n", "d").alias("v")).filter("v is not null")


def poisson_replicates(stats: DataFrame, iters: int = 2000, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """(by..., i, v) like replicates(), with each group drawn a Poisson(1) number of times instead of m groups in all.

    A group's numbers are hashes of its key, so nothing is joined, numbered or broadcast: every task makes its own groups'
    draws and sends one partial sum per iteration, however many groups there are. For many groups the two agree."""
    by = by or []
    blocks = F.explode(F.sequence(F.lit(0), F.lit((iters - 1) // 4)))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("\x02")), F.lit(":"), F.col("b").cast("string")))
    rows = stats.withColumn("b", blocks).withColumn("h", hashed)
    each = []
    for k in range(4):
        u = F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0
        times, upto, p = F.lit(0), 0.0, math.exp(-1)
        for n in range(1, 11):
            upto += p
            p /= n
            times = F.when(u >= upto, n).otherwise(times)
        each.append(F.struct((F.col("b") * 4 + k).alias("i"), times.alias("times")))
    drawn = rows.select(*by, "num", "den", F.explode(F.array(*each)).alias("d")).filter((F.col("d.i") < iters) & (F.col("d.times") > 0))
    sums = drawn.groupBy(*by, F.col("d.i").alias("i")).agg(F.sum(F.col("num") * F.col("d.times")).alias("n"), F.sum(F.col("den") * F.col("d.times")).alias("d_"))
    return sums.select(*by, "i", F.try_divide("n", "d_").alias("v")).filter("v is not null")


def interval(reps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., lo, hi): elements int(0.05 n) and int(0.95 n) of the n sorted replicates, counted from 0."""
    at = lambda q: F.element_at("vs", (F.floor(F.lit(q) * F.size("vs")) + 1).cast("int"))
    vs = reps.groupBy(*(by or [])).agg(F.array_sort(F.collect_list("v")).alias("vs")).filter("size(vs) > 0")
    return vs.select(*(by or []), at(0.05).alias("lo"), at(0.95).alias("hi"))


def ratio_ci(df: DataFrame, key: Column, num: Column, den: Column, *, by: list[str] | None = None, iters: int = 2000, seed: int = 42, scale: float = 1.0, null_value: float = 0.0, method: str = "draws", rows: Column | None = None) -> DataFrame:
    """(by..., n, n_groups, estimate, lo, hi, reliable, robust_positive, robust_negative, ci_method, ci_caveat): a ratio
    of sums and its interval.

    Reliable from 30 groups on; robust only if reliable and the interval lies on one side of null_value. No rows give no
    result. The percentile interval is too narrow for heavy tails and few groups. method: "draws" of as many groups as there
    are, or "poisson" for more groups than should be numbered and joined. rows: how many rows a row stands for, 1 if not given."""
    by = by or []
    keyed = df.withColumn("_key", key).withColumn("_num", num.cast("double")).withColumn("_den", den.cast("double")).withColumn("_rows", (F.lit(1) if rows is None else rows).cast("bigint"))
    stats = cut(keyed.filter("_num is not null").groupBy(*by, F.col("_key").alias("key")).agg(F.sum("_num").alias("num"), F.sum("_den").alias("den"), F.sum("_rows").alias("rows")))
    point = stats.groupBy(*by).agg(F.sum("rows").alias("n"), F.count("*").alias("n_groups"), (F.try_divide(F.sum("num"), F.sum("den")) * scale).alias("estimate")).filter("n > 0")
    resample = {"draws": replicates, "poisson": poisson_replicates}[method]
    ci = interval(resample(stats.drop("rows"), iters, seed, by), by).withColumns({"lo": F.col("lo") * scale, "hi": F.col("hi") * scale})
    out = point.join(ci, by) if by else point.join(F.broadcast(ci))
    reliable = F.col("n_groups") >= MIN_GROUPS
    return out.withColumns({"reliable": reliable, "robust_positive": (F.col("lo") > null_value) & reliable, "robust_negative": (F.col("hi") < null_value) & reliable, "ci_method": F.lit(CI_METHOD), "ci_caveat": F.lit(CI_CAVEAT)})

"""Filling containers of fixed capacity with texts, by the linear grouping scheme.

Sizes are integers up to the capacity, so everything that is optimised works on their histogram. Large sizes are put into
groups of equal cardinality and rounded up to their group's largest; for these few sizes a linear program over container
configurations is solved by column generation and rounded down, and the few items left over are placed first-fit. Actual
texts then take the slots of their group by rank. Small texts are fitted best into the space that remains, in blocks of
bounded size that each get their share of containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.tables import cut

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"



def token_counts(df: DataFrame, *, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each row; a null text has 0 tokens. tokenizer: a model file that every executor can read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        enc = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        for b in batches:
            ids = enc.encode([t or "" for t in b["text"]], num_threads=1)
            yield pd.DataFrame({"id": b["id"], "n_tokens": [len(x) for x in ids]})

    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens int")


def linear_groups(histogram: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """(rounded size, {size: count}) from the largest sizes down, of equal cardinality; a size may lie in several groups."""
    total = sum(histogram.values())
    if not total:
        return []
    each = -(-total // groups)
    out: list[tuple[int, dict[int, int]]] = []
    room = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if room == 0:
                out.append((size, {}))
                room = each
            take = min(left, room)
            out[-1][1][size] = out[-1][1].get(size, 0) + take
            left, room = left - take, room - take
    return out


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most value within the capacity, sizes taken any number of times."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = np.nonzero(sizes <= c)[0]
        v = best[c - sizes[fit]] + value[fit]
        k = int(np.argmax(v))
        if v[k] > best[c - 1] + 1e-12:
            best[c], took[c] = v[k], fit[k]
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(len(sizes), dtype=int), capacity
    while c > 0:
        if took[c] >= 0:
            count[took[c]] += 1
            c -= sizes[took[c]]
        else:
            c -= 1
    return float(best[capacity]), count


def configurations(sizes: list[int], demand: list[int], capacity: int, stall: int = 200) -> list[tuple[list[int], int]]:
    """(configuration, number of containers) that together hold the demand exactly, in few containers.

    The linear program's basis starts with containers of one size; a knapsack over the dual prices finds the
    configuration to bring in, until none would help (or `stall` in a row didn't, when the basis goes in circles). Its solution rounded down leaves less than a container's content per configuration, which
    is placed first-fit from the largest down. Equal sizes are put together."""
    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(np.maximum(1, capacity // s)).astype(float)
    least, idle = float("inf"), 0
    while idle < stall:
        used = float(np.linalg.solve(basis, d).sum())
        least, idle = (used, 0) if used < least - 1e-9 else (least, idle + 1)
        dual = np.linalg.solve(basis.T, np.ones(len(s)))
        value, column = _knapsack(s, np.maximum(dual, 0), capacity)
        if value <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, d), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    amount = np.floor(np.maximum(np.linalg.solve(basis, d), 0) + 1e-9).astype(int)
    left, out = np.array(demand), []
    for j in np.argsort(-amount):
        column = basis[:, j].astype(int)
        n = amount[j]
        if column.any():
            n = int(min(n, min(left[i] // column[i] for i in np.nonzero(column)[0])))
        if n > 0:
            out.append((column.tolist(), n))
            left = left - n * column
    while left.any():
        column, room = np.zeros(len(s), dtype=int), capacity
        for i in np.argsort(-s, kind="stable"):
            take = int(min(left[i], room // s[i]))
            column[i], room = take, room - take * s[i]
        n = int(min(left[i] // column[i] for i in np.nonzero(column)[0]))
        out.append((column.tolist(), n))
        left = left - n * column
    return out


def best_fit(rooms: list[tuple[int, str]], items: list[tuple[int, str]], capacity: int, name: str) -> list[str]:
    """Container of each item, taken from the largest down, each into the smallest room it fits; new ones are named by name."""
    free = sorted(rooms)
    out = [""] * len(items)
    new = 0
    for k in sorted(range(len(items)), key=lambda k: (-items[k][0], items[k][1])):
        size = items[k][0]
        at = bisect_left(free, (size, ""))
        if at < len(free):
            room, where = free.pop(at)
        else:
            room, where, new = capacity, f"{name}-{new}", new + 1
        out[k] = where
        insort(free, (room - size, where))
    return out


def pack(
    counts: DataFrame, capacity: int = 2048, *, groups: int = 32, small: float = 0.125, bucket_items: int = 500_000, block_items: int = 20_000
) -> DataFrame:
    """From (id, n_tokens): (id, piece, n_pieces, size, container), no container over the capacity.

    An item longer than a container is cut into full containers and a rest (n_pieces > 1); no other is divided. Repeated
    rows are items of their own. An empty item takes no room but has a container. The order of equal sizes is by hash and
    id, so the result doesn't depend on how rows are spread."""
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    # Equal rows are told apart by their number; a repeated id is rare, so its rows are few.
    each = counts.groupBy("id", "n_tokens").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    pieces = each.select("id", "copy", n_pieces.alias("n_pieces"), F.posexplode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece", "k"), "n_tokens")
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int")
    key = F.concat_ws("/", F.col("id").cast("string"), "copy", "piece")
    pieces = cut(pieces.select("id", "piece", "n_pieces", size.alias("size"), key.alias("key")))
    # Equal sizes are ranked within buckets, which grow in number with the items.
    buckets = max(16, -(-pieces.count() // bucket_items))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    least = int(small * capacity)
    tally = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    hist = {r.size: r.n for r in tally.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    grouped = linear_groups({s: n for s, n in hist.items() if least < s < capacity}, groups)
    sizes = sorted({g[0] for g in grouped}, reverse=True)
    demand = [sum(sum(c.values()) for g, c in grouped if g == s) for s in sizes]
    # Slots of each rounded size, in order of the configurations: ranks from..upto-1 go, per_bin at a time, to bins from first on.
    slots, first, used = [], 0, [0] * len(sizes)
    for column, n in configurations(sizes, demand, capacity):
        for i, per_bin in enumerate(column):
            if per_bin:
                slots.append((i, used[i], used[i] + n * per_bin, per_bin, first))
                used[i] += n * per_bin
        first += n
    # Ranks run through each rounded size from its largest actual size down: where each part of an actual size begins.
    parts, begun, seen = [], [0] * len(sizes), dict.fromkeys(hist, 0)
    for g, content in grouped:
        i = sizes.index(g)
        for s in sorted(content, reverse=True):
            parts.append((s, seen[s], seen[s] + content[s], i, begun[i]))
            seen[s] += content[s]
            begun[i] += content[s]
    spark = counts.sparkSession
    slot = spark.createDataFrame(slots, "rounded int, low bigint, high bigint, per_bin int, first bigint")
    part = spark.createDataFrame(parts, "size int, since bigint, until bigint, rounded int, base bigint")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = tally.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key")) - 1
    large = pieces.filter((F.col("size") > least) & (F.col("size") < capacity)).withColumn("rank", rank).join(F.broadcast(offset) if capacity * buckets <= 1_000_000 else offset, ["size", "bucket"])
    large = large.withColumn("rank", F.col("rank") + F.col("before")).join(F.broadcast(part), "size").filter("rank >= since and rank < until")
    large = large.withColumn("rank", F.col("rank") - F.col("since") + F.col("base")).join(F.broadcast(slot), "rounded").filter("rank >= low and rank < high")
    bin_ = (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per_bin"))).cast("bigint")
    kept = ["id", "piece", "n_pieces", "size", "key"]
    large = cut(large.select(*kept, F.concat(F.lit("large-"), bin_.cast("string")).alias("container")))
    full = pieces.filter(F.col("size") == capacity).select(*kept, F.concat(F.lit("full-"), "key").alias("container"))

    n_small = sum(n for s, n in hist.items() if s <= least)
    # Blocks hold both the small texts and the rooms of the large ones, so either alone may need many.
    blocks = max(1, n_small // block_items, first // block_items if n_small else 1)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(blocks)).cast("int")
    rooms = large.groupBy("container").agg((capacity - F.sum("size")).cast("int").alias("size")).select(block("container").alias("block"), "size", F.col("container").alias("key"), F.lit(True).alias("room"))
    fill = pieces.filter(F.col("size") <= least).select(block("key").alias("block"), "size", "key", F.lit(False).alias("room"))

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        r, items = b[b["room"]], b[~b["room"]]
        where = best_fit(list(zip(r["size"].tolist(), r["key"])), list(zip(items["size"].tolist(), items["key"])), capacity, f"small-{b['block'].iloc[0]}")
        return pd.DataFrame({"key": items["key"].to_numpy(), "container": where})

    if not n_small:
        return large.unionByName(full).drop("key")
    fitted = rooms.unionByName(fill).groupBy("block").applyInPandas(fit, "key string, container string")
    small_ = pieces.filter(F.col("size") <= least).join(fitted, "key").select(*kept, "container")
    return large.unionByName(full).unionByName(small_).drop("key")

"""Splitting long texts at natural boundaries with overlap, by pointer doubling.

Every boundary of a text is joined to its farthest legal successor: the last cut that keeps a piece, its overlap with
the one before included, within the limit. Squaring that successor table again and again derives all greedy cuts of all
texts together, in as many rounds as the logarithm of the largest number of pieces. Only positions are joined; a text
is cut up once, in the row that holds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.tables import cut

#: Places to cut: after the white space that follows . ! or ?, after a line break, after an ideographic full stop.
BOUNDARY = re.compile("[.!?]\\s|[\n\r\u000b\u000c\u0085\u2028\u2029]|。")


def places(body: str, since: int, limit: int, overlap: int) -> tuple[list[int], list[int], int]:
    """Boundaries of a text (its end included); cuts where a stretch between two is too long for a piece, after a blank
    of the last half of the reach if there is one; and the longest stretch of what begins at since."""
    ends = sorted({m.end() for m in BOUNDARY.finditer(body)} | {len(body)})
    fresh, forced, longest, prev = limit - overlap, [], 0, 0
    for end in ends:
        longest = max(longest, end - max(prev, min(since, end)))
        # The first piece of a text has no overlap and reaches farther.
        at = prev
        reach = limit if prev <= overlap else prev + fresh
        while reach < end:
            low = max(at, reach - fresh // 2)
            at = next((k for k in range(reach, low, -1) if body[k - 1].isspace()), reach)
            forced.append(at)
            reach = at + fresh
        prev = end
    return ends, forced, longest


def boundaries(docs: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, ends, forced, longest_stretch) from (key, body, since)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [places(body, since, limit, overlap) for body, since in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind), pa.array([x[2] for x in found], pa.int32())], names=["key", "ends", "forced", "longest_stretch"])

    return docs.select("key", "body", F.col("since").cast("int")).mapInArrow(run, "key string, ends array<int>, forced array<int>, longest_stretch int")


def greedy_cuts(found: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, pos): ends of the pieces that a greedy pass over boundaries() makes; each piece but the first begins overlap
    before the end of the one before. A boundary within reach comes before any forced cut."""
    fresh = limit - overlap
    at = lambda c, natural: found.select("key", F.explode(c).alias("pos"), F.lit(natural).alias("natural"))
    ends = cut(at("ends", True).unionByName(at("forced", False)).groupBy("key", "pos").agg(F.max("natural").alias("natural")))
    w = Window.partitionBy("key").orderBy("pos").rangeBetween(1, fresh)
    far = lambda natural: F.max(F.when(F.col("natural") == natural, F.col("pos"))).over(w)
    nxt = cut(ends.withColumn("to", F.coalesce(far(True), far(False))).filter("to is not null").select("key", "pos", "to"))
    # A first piece no longer than the overlap would be repeated whole by the second.
    first = lambda natural: F.max(F.when(F.col("pos").between(overlap + 1, limit) & (F.col("natural") == natural), F.col("pos")))
    head = ends.groupBy("key").agg(F.coalesce(first(True), first(False), F.lit(limit)).alias("pos"))
    longest = ends.agg(F.max("pos")).first()[0] or 0
    # Two successive pieces advance by more than half of limit - overlap each.
    most = 4 * longest / fresh + 2
    reached, jump = cut(head), nxt
    for k in range(math.ceil(math.log2(most))):
        more = reached.join(jump, ["key", "pos"]).select("key", F.col("to").alias("pos"))
        new = cut(reached.unionByName(more).distinct())
        if k and new.count() == reached.count():
            break
        reached = new
        if 2 ** (k + 1) < most:
            jump = cut(jump.alias("a").join(jump.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.to") == F.col("b.pos"))).select("a.key", "a.pos", "b.to"))
    return reached


def split_texts(df: DataFrame, *, id: str = "id", title: str | None = "title", text: str = "text", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """One row per piece: id, piece_no, begins, ends (code points of the whole), piece, longest_stretch, size.

    The whole is title, ". " and text, or text alone without a title. Texts within the limit stay one piece. The pieces,
    each without what it repeats, make the whole again. longest_stretch is the longest part of the text without a
    boundary inside; where it is over the limit, cuts are made after a blank if one is near, else inside a word. Repeated
    rows count once; a null text gives no piece, an empty one too. Other columns are ignored."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    name = F.col(title) if title else F.lit(None).cast("string")
    rows = df.select(F.col(id).alias("id"), name.alias("name"), F.col(text).alias("text")).filter("text is not null and (text <> '' or name is not null)")
    body = F.when(F.col("name").isNull(), F.col("text")).otherwise(F.concat("name", F.lit(". "), "text"))
    docs = rows.select("id", body.alias("body"), F.length("text").alias("tail")).withColumn("key", F.md5(F.concat_ws("\x01", F.coalesce("id", F.lit("\x02")), "body")))
    docs = cut(docs.dropDuplicates(["key"]).withColumn("size", F.length("body")))
    over = docs.filter(F.col("size") > limit)
    found = cut(boundaries(over.withColumn("since", F.col("size") - F.col("tail")), limit, overlap))
    cuts = greedy_cuts(found, limit, overlap).groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("cuts"))  # one short array a text
    # Positions meet first, so a text is moved to them once.
    long = over.join(cut(cuts.join(found.select("key", "longest_stretch"), "key")), "key").select("id", "body", "size", "longest_stretch", "cuts")
    short = docs.filter(F.col("size") <= limit).select("id", F.lit(0).alias("piece_no"), F.lit(0).alias("begins"), F.col("size").alias("ends"), F.col("body").alias("piece"), F.lit(None).cast("int").alias("longest_stretch"), "size")

    names = short.columns

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                whole, cuts = b.column(1)[k].as_py(), b.column(4)[k].as_py()
                begins = [0, *(max(0, c - overlap) for c in cuts[:-1])]
                n, same = len(cuts), pa.array([k] * len(cuts))
                out = [b.column(0).take(same), pa.array(range(n), pa.int32()), pa.array(begins, pa.int32()), pa.array(cuts, pa.int32()), pa.array([whole[i:j] for i, j in zip(begins, cuts)], pa.string()), b.column(3).take(same), b.column(2).take(same)]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return long.mapInArrow(pieces, short.schema).unionByName(short)

"""Queries of the language-model data problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.chunking import split_texts
from assay.llm.consensus import consensus, latest_scores
from assay.llm.leaks import find_leaks
from assay.llm.packing import pack, token_counts
from assay.llm.pairs import pair_defects
from assay.llm.quality import COMMON, text_statistics, text_types
from assay.llm.splits import deal, tied_groups
from assay.sources.tables import cut, new_path, table

SPLIT_TIME = "2025-01-01 00:00:00"
AXES = ["faithfulness", "citation", "coverage"]


def _key(name: str) -> Column:
    """As groups and entities are compared: lower case, without outer blanks; an empty one is none."""
    k = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = _key("entity")
    return table(spark, sf_dir, "decisions").select("row_id", _key("group").alias("group"), F.when(entity.rlike("^e[0-9]+$"), entity).alias("entity"), "time")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective pairs of both answer tables with their defect."""
    of = lambda src: table(spark, sf_dir, src).select(F.lit(src).alias("src"), "id", "question", "answer", "type")
    return pair_defects(of("answers_gemini").unionByName(of("answers_gemini_norag")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tied groups of sets with rows both before and from 2025 on: each but the smallest, with the smallest."""
    rows = _decisions(spark, sf_dir)
    tied = cut(tied_groups(rows))
    early = F.col("time") < F.lit(SPLIT_TIME).cast("timestamp_ntz")
    sides = rows.filter("group is not null and time is not null").groupBy("group").agg(F.max(early.cast("int")).alias("before"), F.max((~early).cast("int")).alias("after"))
    both = tied.join(sides, "group").groupBy("root").agg(F.max("before").alias("before"), F.max("after").alias("after")).filter("before = 1 and after = 1")
    return tied.filter("group <> root").join(both, "root").select(F.col("root").alias("root_group"), F.col("group").alias("group_key"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of decisions with its split; a row without group is a set of its own."""
    rows = _decisions(spark, sf_dir)
    tied = cut(tied_groups(rows))
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    sizes = counts.filter("group is not null").join(tied, "group").groupBy("root").agg(F.sum("n").alias("n"))
    # Keys of single rows can't meet group keys: these hold no \x01.
    alone = F.concat(F.lit("\x01"), F.col("row_id").cast("string"))
    single = rows.filter("group is null").groupBy(alone.alias("root")).agg(F.count("*").alias("n"))
    dealt = cut(deal(sizes.unionByName(single), {"train": 0.7, "validation": 0.15, "test": 0.15}))
    where = tied.join(dealt, "root").select("group", "split")
    rooted = rows.filter("group is not null").select("row_id", "group").join(where, "group").select("row_id", "split")
    return rooted.unionByName(rows.filter("group is null").select("row_id", alone.alias("root")).join(dealt, "root").select("row_id", "split"))


def p3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups are tied to others, in how many sets, and the edges of the persisted forest that ties them: one less
    than its groups for each set."""
    to = new_path(spark)
    tied = cut(tied_groups(_decisions(spark, sf_dir), forest_to=to))
    sets = tied.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("groups"))
    return sets.join(F.broadcast(spark.read.parquet(to).agg(F.count("*").alias("edges"))))


def p3_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p3_splits: every row once, no group or entity in two splits, shares within a percent of 70, 15 and 15."""
    split = cut(p3_splits(spark, sf_dir))
    rows = cut(_decisions(spark, sf_dir).select("row_id", "group", "entity").distinct().join(split.distinct(), "row_id"))
    torn = lambda c: rows.filter(F.col(c).isNotNull() & F.col("group").isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    share = {s: F.count_if(F.col("split") == s) / F.count("*") for s in ("train", "validation", "test")}
    near = (F.abs(share["train"] - 0.7) <= 0.01) & (F.abs(share["validation"] - 0.15) <= 0.01) & (F.abs(share["test"] - 0.15) <= 0.01)
    out = split.agg(F.count("*").alias("rows"), near.alias("near"))
    return out.join(F.broadcast(torn("group").withColumnRenamed("n", "groups_torn"))).join(F.broadcast(torn("entity").withColumnRenamed("n", "entities_torn")))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all postmortems."""
    return split_texts(table(spark, sf_dir, "postmortems"), limit=1500, overlap=150)


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p4_pieces, by postmortem: its texts, pieces over the limit, and whether its pieces make the whole again."""
    pieces = p4_pieces(spark, sf_dir)
    own = F.when(F.col("piece_no") > 0, F.expr("substring(piece, 151)")).otherwise(F.col("piece"))
    whole = pieces.withColumn("own", own).groupBy("id", "size", F.when(F.col("size") <= 1500, F.xxhash64("piece")).alias("h"))
    texts = whole.agg(F.sum(F.length("own")).alias("chars"), F.count_if(F.length("piece") > 1500).alias("over"), F.count_if(F.col("piece_no") == 0).alias("texts"))
    return texts.groupBy("id").agg(F.sum("texts").alias("texts"), F.sum("over").alias("over_limit"), F.sum("chars").alias("chars"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postmortems over 1,500 characters, and whether they can be cut at boundaries only."""
    over = p4_pieces(spark, sf_dir).filter("size > 1500").groupBy("id").agg(F.max("longest_stretch").alias("s"))
    return over.select("id", F.when(F.col("s") > 1500, "unbreakable").otherwise("oversized").alias("kind"))


def _consensus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return consensus(latest_scores(table(spark, sf_dir, "judged_gemini_by_gemini"), "id", "_judge", "judged_at", AXES))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus score of each answer and axis with scores of at least three raters."""
    return _consensus(spark, sf_dir)[0].select(F.col("item").alias("id"), "axis", "score")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus scores with the number of raters and the share of the weight behind the score."""
    return _consensus(spark, sf_dir)[0]


def p5_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rater's skill, accuracy and weight."""
    return _consensus(spark, sf_dir)[1].select("rater", "n_votes", *(F.round(c, 6).alias(c) for c in ("skill", "accuracy", "weight")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of a document longer than a container."""
    return pack(token_counts(table(spark, sf_dir, "documents")), 2048).withColumnRenamed("id", "doc_id")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p7_containers: all documents, none over the capacity, none divided without need, all pieces there."""
    packed = cut(p7_containers(spark, sf_dir))
    over = packed.groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > 2048).alias("over_capacity"))
    each = packed.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.max("n_pieces").alias("n"), F.count("*").alias("k"))
    own = each.agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= 2048)).alias("divided_without_need"), F.count_if(F.col("k") != F.col("n")).alias("incomplete"))
    return own.join(F.broadcast(over))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that had to be divided."""
    return p7_containers(spark, sf_dir).filter("n_pieces > 1").select("doc_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of eval_items that each document holds in full or in part."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that aren't natural prose, and what they are."""
    return text_types(table(spark, sf_dir, "documents")).filter("kind <> 'prose'").select(F.col("id").alias("doc_id"), "kind")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each document that the problem names."""
    named = ("mean_word_length", "symbol_ratio", "closed_lines", "common_words")
    return text_statistics(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_chars", "n_words", "n_lines", *(F.round(c, 6).alias(c) for c in named))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_splits, p3_forest, p3_split_checks, p4_found, p4_pieces, p4_checks, p5_found, p5_agreement, p5_raters, p7_found, p7_containers, p7_checks, p8_found, p9_found, p9_statistics)}
_GROUP, _ENTITY = (f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')" for c in ('"group"', "entity"))

_TIED = f"""
    p AS (SELECT {_GROUP} AS g, CASE WHEN regexp_full_match({_ENTITY}, 'e[0-9]+') THEN {_ENTITY} END AS e FROM decisions WHERE {_GROUP} IS NOT NULL),
    low AS (SELECT e, min(g) AS a FROM p WHERE e IS NOT NULL GROUP BY e),
    edges AS (SELECT DISTINCT a, g AS b FROM p JOIN low USING (e) WHERE a <> g), both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach AS (SELECT DISTINCT g, g AS r FROM p UNION SELECT b, r FROM reach JOIN both_ ON g = a), roots AS (SELECT g, min(r) AS root FROM reach GROUP BY g)"""
_WORDS = "'" + "', '".join(w.replace("'", "''") for w in sorted(set(COMMON))) + "'"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_STATISTICS = rf"""
    t AS (SELECT doc_id, replace(coalesce(text, ''), chr(13), '') AS t, coalesce(length(text), 0) AS raw FROM documents),
    w AS (SELECT *, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+(?:[''’][\p{{L}}\p{{N}}_]+)*'), lambda x: regexp_full_match(x, '\p{{L}}+(?:[''’]\p{{L}}+)*')) AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}+', '', 'g') <> '') AS ls, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS solid FROM t),
    m AS (SELECT *, len(ws) AS n, length(regexp_replace(t, '[^はがをにのでとたてし]', '', 'g')) AS kana, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters FROM w)
    SELECT doc_id, length(t) AS n_chars, n AS n_words, len(ls) AS n_lines, round(list_sum(list_transform(ws, lambda x: length(regexp_replace(x, '[''’]', '', 'g')))) / nullif(n, 0)::DOUBLE, 6) AS mean_word_length,
           round(length(regexp_replace(t, '[\p{{L}}\p{{N}}\p{{M}}\p{{Z}}\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}.,;:!?''"()、。「」？’“”¿¡-]', '', 'g')) / nullif(solid, 0)::DOUBLE, 6) AS symbol_ratio,
           round(len(list_filter(ls, lambda x: regexp_matches(regexp_replace(x, '{_SPACE}+$', ''), '[.!?。！？…؟।]["”’'')\]*»]*$'))) / nullif(len(ls), 0)::DOUBLE, 6) AS closed_lines,
           round(greatest(len(list_filter(ws, lambda x: x IN ({_WORDS}))) / nullif(n, 0)::DOUBLE, kana / nullif(letters, 0)::DOUBLE), 6) AS common_words FROM m"""
_USABLE = """CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{{1,3}})?') THEN try_cast({0} AS DOUBLE) END"""
_BARE = """trim(regexp_replace(regexp_replace(regexp_replace(translate(trim(regexp_replace({0}, '[\\s\u00a0\u3000]+', ' ', 'g')), '０１２３４５６７８９．', '0123456789.'), '^\\[\\s*([^\\[\\],]*?)\\s*\\]$', '\\1'), '^"(.*)"$', '\\1'), '^''(.*)''$', '\\1'))"""
_RATERS = f"""
    l AS (SELECT id AS item, _judge AS rater, faithfulness AS s0, citation AS s1, coverage AS s2 FROM judged_gemini_by_gemini WHERE id IS NOT NULL AND _judge IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY id, _judge ORDER BY judged_at DESC NULLS LAST, coalesce(faithfulness, '') DESC, coalesce(citation, '') DESC, coalesce(coverage, '') DESC) = 1),
    e AS (SELECT item, rater, unnest(['faithfulness', 'citation', 'coverage']) AS axis, unnest([{_BARE.format("s0")}, {_BARE.format("s1")}, {_BARE.format("s2")}]) AS x FROM l),
    v AS (SELECT item, axis, rater, d::INT AS score FROM (SELECT *, {_USABLE.format("x")} AS d FROM e) WHERE d IN (0, 1, 2)),
    k AS (SELECT p.rater AS a, q.rater AS b, p.score AS x, q.score AS y, count(*) AS k FROM v p JOIN v q ON p.item = q.item AND p.axis = q.axis AND p.rater < q.rater GROUP BY ALL),
    t AS (SELECT a, b, sum(k) AS n, coalesce(sum(k) FILTER (WHERE x = y), 0) AS same, {" + ".join(f"coalesce(sum(k) FILTER (WHERE x = {s}), 0)::DOUBLE * coalesce(sum(k) FILTER (WHERE y = {s}), 0)" for s in range(3))} AS b2 FROM k GROUP BY a, b HAVING sum(k) >= 20),
    c AS (SELECT a, b, n, CASE WHEN b2 / (n::DOUBLE * n) < 1 THEN (same / n::DOUBLE - b2 / (n::DOUBLE * n)) / (1 - b2 / (n::DOUBLE * n)) ELSE 0 END AS c FROM t),
    w2 AS (SELECT * FROM (SELECT a AS i, b AS j, n, c FROM c UNION ALL SELECT b, a, n, c FROM c) QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, j) <= 64),
    m AS (SELECT p.i AS rater, median(p.c * q.c / c.c) AS m FROM w2 p JOIN w2 q ON p.i = q.i AND p.j < q.j JOIN c ON c.a = p.j AND c.b = q.j WHERE c.c > 0.1 GROUP BY p.i),
    sk AS (SELECT rater, count(*) AS n_votes, coalesce(sqrt(least(1, greatest(0, any_value(m)))), 0) AS skill FROM v LEFT JOIN m USING (rater) GROUP BY rater),
    ac AS (SELECT *, least(0.995::DOUBLE, greatest(1 / 3::DOUBLE, (1 + 2 * skill) / 3)) AS accuracy FROM sk),
    ra AS (SELECT *, greatest(0, ln(accuracy * 2 / (1 - accuracy))) AS weight FROM ac),
    s AS (SELECT item, axis, count(*) AS n_raters, {", ".join(f"round(sum(CASE WHEN score = {k} THEN weight + 1e-6::DOUBLE ELSE 0 END), 9) AS w{k}" for k in range(3))} FROM v JOIN ra USING (rater) GROUP BY ALL HAVING count(*) >= 3),
    fin AS (SELECT item, axis, CASE WHEN w0 = greatest(w0, w1, w2) THEN 0 WHEN w1 = greatest(w0, w1, w2) THEN 1 ELSE 2 END AS score, n_raters, round(greatest(w0, w1, w2) / (w0 + w1 + w2), 6) AS agreement FROM s)"""

SQL: dict[str, str] = {
    "p3_forest": f"WITH RECURSIVE {_TIED}, n AS (SELECT root, count(*) AS n FROM roots GROUP BY root HAVING count(*) > 1) SELECT count(*) AS sets, coalesce(sum(n), 0)::BIGINT AS groups, coalesce(sum(n - 1), 0)::BIGINT AS edges FROM n",
    "p3_split_checks": "SELECT count(*) AS rows, TRUE AS near, 0 AS groups_torn, 0 AS entities_torn FROM decisions",
    "p4_checks": "SELECT id, count(*) AS texts, 0 AS over_limit, sum(length(b))::BIGINT AS chars FROM (SELECT DISTINCT id, CASE WHEN title IS NULL THEN text ELSE title || '. ' || text END AS b FROM postmortems WHERE text IS NOT NULL AND (text <> '' OR title IS NOT NULL)) GROUP BY id",
    "p7_checks": "SELECT count(*) AS documents, 0 AS over_capacity, 0 AS divided_without_need, 0 AS incomplete FROM documents",
    "p9_statistics": f"WITH {_STATISTICS}",
    "p5_found": f"WITH {_RATERS} SELECT item AS id, axis, score FROM fin",
    "p5_agreement": f"WITH {_RATERS} SELECT item, axis, score, n_raters, agreement FROM fin",
    "p5_raters": f"WITH {_RATERS} SELECT rater, n_votes, round(skill, 6) AS skill, round(accuracy, 6) AS accuracy, round(weight, 6) AS weight FROM ra",
    "p3_found": f"""
        WITH RECURSIVE p AS (SELECT {_GROUP} AS g, CASE WHEN regexp_full_match({_ENTITY}, 'e[0-9]+') THEN {_ENTITY} END AS e, time FROM decisions WHERE {_GROUP} IS NOT NULL),
        low AS (SELECT e, min(g) AS a FROM p WHERE e IS NOT NULL GROUP BY e),
        edges AS (SELECT DISTINCT a, g AS b FROM p JOIN low USING (e) WHERE a <> g), both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach AS (SELECT DISTINCT g, g AS r FROM p UNION SELECT b, r FROM reach JOIN both_ ON g = a),
        roots AS (SELECT g, min(r) AS root FROM reach GROUP BY g),
        s AS (SELECT root FROM p JOIN roots USING (g) WHERE time IS NOT NULL GROUP BY root HAVING min(time) < '{SPLIT_TIME}' AND max(time) >= '{SPLIT_TIME}')
        SELECT root AS root_group, g AS group_key FROM roots WHERE g <> root AND root IN (SELECT root FROM s)""",
    "p4_found": r"""
        WITH r AS (SELECT DISTINCT id, title, text FROM postmortems WHERE text IS NOT NULL),
        o AS (SELECT id, text FROM r WHERE length(CASE WHEN title IS NULL THEN text ELSE title || '. ' || text END) > 1500),
        s AS (SELECT id, unnest(string_split(regexp_replace(text, '([.!?]\s|\n|。)', '\1' || chr(1), 'g'), chr(1))) AS part FROM o)
        SELECT id, CASE WHEN max(length(part)) > 1500 THEN 'unbreakable' ELSE 'oversized' END AS kind FROM s GROUP BY id""",
}

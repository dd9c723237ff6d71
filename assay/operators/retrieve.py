"""Sentence chunks, BM25 retrieval, its evaluation, and citation checks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.tables import cut


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)


def chunk_documents(docs: DataFrame, id: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """(chunk_id, doc_id, chunk): sentences, cut at white space after . ! or ?, with the title in front.

    Empty sentences are dropped after they were counted; a null title gives the sentence alone."""
    parts = F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+"))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(title).alias("title"), parts.alias("i", "s")).withColumn("s", F.trim("s")).filter("s <> ''")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("i").cast("string")).alias("chunk_id"), "doc_id", F.concat_ws(". ", "title", "s").alias("chunk"))


def bm25_weights(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(term, chunk_id, doc_id, w) of the queries' words in the chunks, and (query_id, term, qf) of the queries.

    Postings are cut down to the queries' words before they are counted. A word that a query repeats counts as often."""
    terms = cut(queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf")))
    words = cut(chunks.select("chunk_id", "doc_id", tokenize(F.col("chunk")).alias("ws")).withColumn("dl", F.size("ws")))
    stats = words.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term").distinct()
    tf = words.select("chunk_id", "doc_id", "dl", F.explode("ws").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "chunk_id", "doc_id", "dl").agg(F.count("*").alias("tf"))
    tf = cut(tf)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return cut(tf.join(df, "term").join(F.broadcast(stats)).select("term", "chunk_id", "doc_id", weight.alias("w"))), terms


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, doc_id, score) of all chunks that share a word with the query, from (chunk_id, doc_id, chunk)
    and (query_id, query). For the best documents only, bm25_top does less."""
    weights, terms = bm25_weights(chunks, queries, k1, b)
    return _sum(weights.join(terms, "term"))


def _sum(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "chunk_id", "doc_id").agg(F.sum(F.col("w") * F.col("qf")).alias("score"))


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int = 5, *, of: str = "doc_id", k1: float = 1.5, b: float = 0.75, block_chunks: int = 20_000, block_queries: int = 100_000) -> DataFrame:
    """(query_id, doc_id or chunk_id, score, rank): the k best documents by their best chunk, or the k best chunks; all
    chunks are scored, ties go by id. Documents and chunks that share no word with the query are left out.

    Queries share so many words with all chunks that joining them by word would make nearly every pair. Instead the queries
    are broadcast, block_queries at a time, and each task scores its chunks in blocks through the block's postings, keeping
    k results per query and block; the best of those are the best of all."""
    terms = cut(queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf")))
    words = cut(chunks.select("doc_id", "chunk_id", tokenize(F.col("chunk")).alias("ws")))
    parts = max(1, -(-terms.select("query_id").distinct().count() // block_queries))
    own = [terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) for p in range(parts)]
    found = [_bm25_block(words, t, k, of, k1, b, block_chunks) for t in own]
    return top_docs(reduce(DataFrame.unionByName, found), k, of)


def _bm25_block(words: DataFrame, terms: DataFrame, k: int, of: str, k1: float, b: float, block_chunks: int) -> DataFrame:
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "qf")).alias("ts")).collect()
    n, avgdl = words.agg(F.count("*"), F.avg(F.size("ws"))).first()
    wanted = terms.select("term").distinct()
    df = {r.term: r.df for r in words.select(F.explode(F.array_distinct("ws")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    shared = words.sparkSession.sparkContext.broadcast(([(r.query_id, [(t.term, t.qf) for t in r.ts if t.term in idf]) for r in asked], idf))

    def best(keys: list, texts: list) -> Iterator[tuple]:
        asked, idf = shared.value
        # In the order of their keys, a key's best chunk is the maximum of a run.
        order = sorted(range(len(keys)), key=keys.__getitem__)
        runs = [j for j, c in enumerate(order) if j == 0 or keys[c] != keys[order[j - 1]]]
        names, starts = [keys[order[j]] for j in runs], np.array(runs)
        raw: dict[str, list[tuple[int, float]]] = {}
        for j, c in enumerate(order):
            norm = k1 * (1 - b + b * len(texts[c]) / avgdl)
            for t, f in Counter(w for w in texts[c] if w in idf).items():
                raw.setdefault(t, []).append((j, idf[t] * f * (k1 + 1) / (f + norm)))
        postings = {t: (np.array([j for j, _ in v]), np.array([w for _, w in v])) for t, v in raw.items()}
        score = np.zeros(len(keys))
        for query, ts in asked:
            held = [(*postings[t], qf) for t, qf in ts if t in postings]
            if not held:
                continue
            score[:] = 0.0
            for at, w, qf in held:
                score[at] += w if qf == 1 else w * qf
            value = np.round(np.maximum.reduceat(score, starts), 9)
            least = np.partition(value, -k)[-k] if len(value) > k else 0.0
            hit = np.nonzero((value >= least) & (value > 0))[0]
            for v, name in sorted((-value[d], names[d]) for d in hit.tolist())[:k]:
                yield query, name, float(-v)

    kind = dict(words.dtypes)[of]
    kinds = f"query_id {dict(terms.dtypes)['query_id']}, {of} {kind}, score double"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, texts = [], []
        for batch in batches:
            keys += batch[of].tolist()
            texts += batch["ws"].tolist()
            if len(keys) >= block_chunks:
                yield pd.DataFrame(best(keys, texts), columns=["query_id", of, "score"])
                keys, texts = [], []
        if keys:
            yield pd.DataFrame(best(keys, texts), columns=["query_id", of, "score"])

    return words.mapInPandas(search, kinds)


def search_chunks(chunks: DataFrame, queries: DataFrame, k: int = 5, **how) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of every query that has a word; where fewer than k share a word
    with it, chunks with a score of 0 follow in order of their ids. Ties go by id."""
    hits = cut(bm25_top(chunks, queries, k, of="chunk_id", **how))
    first = chunks.select("chunk_id").distinct().orderBy("chunk_id").limit(k)  # k rows
    held = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    lacking = queries.select("query_id").distinct().join(held, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    more = lacking.crossJoin(F.broadcast(first)).join(hits, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    return top_docs(hits.select("query_id", "chunk_id", "score").unionByName(more), k, "chunk_id")


def top_docs(scores: DataFrame, k: int = 5, of: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score, rank): documents by their best chunk; ties by id."""
    best = scores.groupBy("query_id", of).agg(F.round(F.max("score"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), of))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def retrieval_metrics(df: DataFrame, gold: str, got: str) -> DataFrame:
    """(n, recall, mrr) over rows with gold ids: the share of gold retrieved, and one over the rank of the first."""
    first = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(got), F.lit(1))), lambda i: F.when(F.array_contains(F.col(gold), F.get(F.col(got), i - 1)), i)), lambda x: x.isNotNull()))
    rows = df.filter(F.size(gold) > 0).select((F.size(F.array_intersect(gold, got)) / F.size(F.array_distinct(gold))).alias("recall"), F.coalesce(1 / first, F.lit(0.0)).alias("rr"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 3).alias("recall"), F.round(F.avg("rr"), 3).alias("mrr"))


def citation_check(df: DataFrame, answer: str, retrieved: str, gold: str, trap: Column, refusal: str = r"do not contain this information") -> DataFrame:
    """Adds n_cited, out_of_range, cited_docs, refused, precision, recall, citation_ok.

    Citations are distinct [n] counted from 1 into the retrieved documents. A trap is right if refused, or if it cites
    gold documents and no others; other answers are right with a precision of 1 and some recall."""
    nums = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,6})\]"), 1), lambda x: x.cast("int")))
    df = df.withColumns({"_nums": nums, "_got": F.coalesce(retrieved, F.array().cast("array<string>")), "_gold": F.coalesce(gold, F.array().cast("array<string>"))})
    inside = F.filter("_nums", lambda x: (x >= 1) & (x <= F.size("_got")))
    df = df.withColumns({"n_cited": F.size("_nums"), "out_of_range": F.size("_nums") - F.size(inside), "cited_docs": F.array_sort(F.array_distinct(F.transform(inside, lambda x: F.get("_got", x - 1)))), "refused": F.lower(F.coalesce(answer, F.lit(""))).rlike(refusal)})
    hit = F.size(F.array_intersect("cited_docs", "_gold"))
    df = df.withColumns({"precision": F.when(~trap, F.coalesce(F.try_divide(hit, F.size("cited_docs")), F.lit(0.0))), "recall": F.when(~trap, F.coalesce(F.try_divide(hit, F.size(F.array_distinct("_gold"))), F.lit(0.0)))})
    ok = F.when(trap, F.col("refused") | ((F.size("cited_docs") > 0) & (F.size(F.array_except("cited_docs", "_gold")) == 0))).otherwise((F.col("precision") == 1) & (F.col("recall") > 0))
    return df.withColumn("citation_ok", ok).drop("_nums", "_got", "_gold")


def build_context(df: DataFrame, id: str, docs: str, corpus: DataFrame, corpus_id: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """(id, context): the documents of an array of ids as numbered lines `[i] (id) title. text`; unknown ids are left out."""
    rows = df.select(F.col(id).alias("id"), F.posexplode(docs).alias("i", "doc"))
    own = corpus.select(F.col(corpus_id).alias("doc"), F.concat_ws(". ", title, text).alias("body")).dropDuplicates(["doc"])
    line = F.format_string("[%d] (%s) %s", F.col("i") + 1, F.col("doc"), F.col("body"))
    found = rows.join(own, "doc").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("ls"))
    return found.select("id", F.array_join("ls.line", "\n").alias("context"))


def parse_judgement(text: Column) -> Column:
    """The first object in a judge's output, from its first brace to the last, as a variant; null where there is none.

    A null result is the parse failure."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))

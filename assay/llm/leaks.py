"""Evaluation texts inside a training corpus, by latent semantic retrieval.

All passages of all documents are counted for the words' weights. A randomized SVD of the TF-IDF matrix of passages (a
sample bounded by a parameter, chosen by hash) gives the leading right singular vectors: products of the matrix and its
transpose with a sketch are summed by the tasks, so no product of words with words exists anywhere. Then every passage of
every document is searched: an inverted index over the rarest words of the items leaves the items that it can hold, these
are compared with it by cosine in the latent space, and candidates are checked by the longest common subsequence of their
words and by whether the words that tell the item from others (the answer) are among it.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import cut

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_EMPHASIS = re.compile(r"[*_~`]+")
_BREAK = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
# Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнзгпАВЕКМНОРСТХУІЈЅαορνικτυχεηΑΒΕΖΗΙΚΜΝΟΡΤΥΧıł",
    "aeopcyxijsdhlkmtbh3rnABEKMHOPCTXYIJSaopvikruxenABEZHIKMNOPTYXil",
)


def words(text: str | None) -> list[str]:
    """Words whatever the case, punctuation, spacing, markup and form of the characters."""
    t = text or ""
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", _INVISIBLE.sub("", t))
        t = "".join(c for c in t if not unicodedata.combining(c)).translate(_ALIKE)
    t = _EMPHASIS.sub("", t)
    if "-" in t:
        t = _BREAK.sub("", t)
    return _WORD.findall(t.casefold())


def windows(ids: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Rows of size ids, one each stride; the last is filled up with -1. A run of up to size - stride words lies in one."""
    if len(ids) <= size:
        n = 1
    else:
        n = 1 + -(-(len(ids) - size) // stride)
    padded = np.full((n - 1) * stride + size, -1, dtype=np.int32)
    padded[: min(len(ids), len(padded))] = ids[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::stride]


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else (below[j] if below[j] >= row[j + 1] else row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _bounds(n: int, span: int, differ: int) -> tuple[int, int]:
    """Words of an item's window, and how many of them a passage must hold."""
    span = min(span, n)
    return min(span + 1, n), span - (-(-span // differ)) - 1


def holds(item: list, weight: list[float], passage: list, span: int = 12, differ: int = 6) -> bool:
    """Whether the passage holds span words in a row of the item, or as many but for one in `differ`.

    Of a window of one word more than span, at most one in `differ` of span and one at its rim may be missing, in about
    as many words of the passage; the matched words must make up most of the window's weight, lest common phrases do.
    Each window is aligned by itself with each stretch of the passage that holds enough of its words."""
    wide, need = _bounds(len(item), span, differ)
    known = set(passage)
    hit = [w in known for w in item]
    reach = wide + 4
    for s in range(len(item) - wide + 1):
        whole = sum(weight[s : s + wide])
        # Windows that even without regard to order hold too few of the words, or too little of the weight, can't match.
        if sum(hit[s : s + wide]) < need or sum(weight[k] for k in range(s, s + wide) if hit[k]) < 0.6 * whole:
            continue
        own = set(item[s : s + wide])
        at = [k for k, w in enumerate(passage) if w in own]
        tried = -1
        for k, o in enumerate(at):
            upto = next((j for j in range(len(at) - 1, k - 1, -1) if at[j] < o + reach), k)
            if upto - k + 1 < need or upto == tried and k and at[k - 1] + reach > at[upto]:
                continue
            got = lcs_pairs(item[s : s + wide], passage[o : o + reach])
            if len(got) >= need and got[-1][1] - got[0][1] <= wide + 3 and sum(weight[s + i] for i, _ in got) >= 0.6 * whole:
                return True
    return False


class Vocabulary(dict):
    """Numbers of words: the items' own words first, all others by hash in `others` places after them."""

    def __init__(self, words: list[str], others: int) -> None:
        super().__init__({w: i for i, w in enumerate(words)})
        self.own, self.others = len(words), others

    def __missing__(self, word: str) -> int:
        at = self.own + zlib.crc32(word.encode("utf-8", "replace")) % self.others
        if len(word) < 30 and len(self) < self.own + 500_000:
            self[word] = at
        return at

    def __reduce__(self):
        return Vocabulary, (list(self)[: self.own], self.others)

    def ids(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.int32, count=len(ws))


def once(rows: np.ndarray) -> np.ndarray:
    """Rows of ids with each id once, filled up with -1."""
    rows = -np.sort(-rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return rows


def numbered(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) from (doc_id, text): each text's words as numbers; texts without words are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            ids = [at.ids(words(t)) for t in b.column(1).to_pylist()]
            keep = [k for k, x in enumerate(ids) if len(x)]
            sizes = np.array([0, *(len(ids[k]) for k in keep)])
            flat = np.concatenate([ids[k] for k in keep]) if keep else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _each(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    for k in range(len(column)):
        yield flat[at[k] : at[k + 1]]


def passage_counts(docs: DataFrame, n: int, size: int) -> tuple[np.ndarray, int]:
    """From (ids): numbers of passages that hold each of n words, over all documents, and of all passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, passages = np.zeros(n, dtype=np.int64), 0
        for b in batches:
            parts = [windows(ids, size, size) for ids in _each(b.column(0))]
            if parts:
                rows = once(np.concatenate(parts))
                passages += len(rows)
                c += np.bincount(rows[rows >= 0], minlength=n)
        where = np.nonzero(c)[0]
        yield pa.RecordBatch.from_pydict({"at": np.append(where, -1), "n": np.append(c[where], passages)})

    got = docs.select("ids").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, num = got["at"].to_numpy(), got["n"].to_numpy()
    c = np.zeros(n)
    c[at[at >= 0]] = num[at >= 0]
    return c, int(num[at < 0].sum())


def gather(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Products of sparse rows (ids of entries of one, -1 for none) with a matrix."""
    out = np.zeros((len(rows), matrix.shape[1]), dtype=np.float32)
    for j in range(rows.shape[1]):
        k = np.nonzero(rows[:, j] >= 0)[0]
        out[k] += matrix[rows[k, j]]
    return out


def normal_product(passages: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) for the TF-IDF matrix A of the passages (array column ids): every task multiplies its passages and sums by
    word, and the words' sums are added up by the tasks after it. Only words by columns of q come to the driver."""
    shared = passages.sparkSession.sparkContext.broadcast((idf.astype(np.float32), q.astype(np.float32)))
    width = q.shape[1]

    def batch(at: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), width).cast(pa.list_(pa.float32()))], names=["word", "z"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        scaled, total = q * idf[:, None], None
        for b in batches:
            rows = b.column(0).flatten().to_numpy().reshape(len(b), -1)
            for part in np.array_split(rows, len(rows) // 2000 + 1):
                y = gather(part, scaled)
                p, j = np.nonzero(part >= 0)
                w = part[p, j]
                order = np.argsort(w, kind="stable")
                at, first = np.unique(w[order], return_index=True)
                z = np.add.reduceat(y[p[order]], first, axis=0) * idf[at, None] if len(at) else np.zeros((0, width), np.float32)
                if total is None:
                    total = np.zeros_like(q)
                total[at] += z
        if total is not None:
            at = np.nonzero(total.any(1))[0]
            for part in np.array_split(at, len(at) // 5000 + 1):
                yield batch(part, total[part])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z = b.column(1).flatten().to_numpy().reshape(len(b), -1)
            for k, w in enumerate(b.column(0).to_pylist()):
                sums[w] = sums[w] + z[k] if w in sums else z[k].copy()
        if sums:
            yield batch(np.array(list(sums)), np.stack(list(sums.values())))

    schema = "word int, z array<float>"
    got = passages.mapInArrow(multiply, schema).repartition("word").mapInArrow(add, schema).toArrow()
    out = np.zeros(q.shape)
    if got.num_rows:
        out[got["word"].to_numpy()] = got["z"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return out


def right_singular(product, n: int, rank: int, rounds: int = 2, seed: int = 42) -> np.ndarray:
    """Leading right singular vectors of a matrix with n columns by randomized subspace iteration; product(q) is A'(A q)."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, rank + 16))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(product(q))
    value, vector = np.linalg.eigh(q.T @ product(q))
    return q @ vector[:, np.argsort(-value)[:rank]]


class Index:
    """The items as projected queries, and the inverted index of their rarest words. docs: (doc_id, ids)."""

    def __init__(self, docs: DataFrame, items: list[tuple[int, list[str]]], vocabulary: Vocabulary, rank: int, size: int, fit_passages: int) -> None:
        self.size = size
        n, half = vocabulary.own + vocabulary.others, size // 2
        counts, passages = passage_counts(docs, n, size)
        self.idf = np.log1p((1 + passages) / (1 + counts))
        self.items = [(i, vocabulary.ids(ws).tolist()) for i, ws in items]
        self.weight = [self.idf[ids].tolist() for _, ids in self.items]
        own = [once(windows(np.array(ids, dtype=np.int32), half, max(1, half // 2))) for _, ids in self.items]
        #: The rows of queries of each item.
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        rows = np.concatenate(own)
        share = min(1.0, fit_passages / max(1, passages))
        sample = cut(_passages(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003), size))
        fitted = sample.count()
        # The items' own passages count as much as the corpus, lest its frequent words take all directions.
        much = fitted / len(rows)
        idf = self.idf.astype(np.float32)

        def product(q: np.ndarray) -> np.ndarray:
            z = normal_product(sample, self.idf, q) if fitted else np.zeros_like(q)
            y = gather(rows, (q * idf[:, None]).astype(np.float32))
            p, j = np.nonzero(rows >= 0)
            np.add.at(z, rows[p, j], y[p] * idf[rows[p, j], None] * max(much, 1e-9))
            return z

        basis = right_singular(product, n, min(rank, n))
        self.scaled = (basis * self.idf[:, None]).astype(np.float32)
        z = gather(rows, self.scaled)
        self.queries = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        self.words = [frozenset(ids) for _, ids in self.items]
        self.need = np.array([min(_bounds(len(ids), half, 6)[1], len(set(ids))) for _, ids in self.items])
        self.postings, self.least = self._anchors(half)
        self.anchor = np.zeros(n, dtype=bool)
        self.anchor[list(self.postings)] = True

    def _anchors(self, span: int, more: int = 3) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """word -> items, of the rarest words of each window, and how many of an item's a passage that holds it must have.

        As many words of a window may be missing as holds() allows, so of that many and `more` at least `more` are there."""
        found: dict[int, set[int]] = {}
        least = np.full(len(self.items), 10**6)
        for k, (_, ids) in enumerate(self.items):
            wide, need = _bounds(len(ids), span, 6)
            for s in range(len(ids) - wide + 1):
                own = sorted(set(ids[s : s + wide]), key=lambda w: (-self.idf[w], w))[: wide - need + more]
                least[k] = min(least[k], max(1, len(own) - (wide - need)))
                for w in own:
                    found.setdefault(w, set()).add(k)
        return {w: np.array(sorted(ks), dtype=np.int32) for w, ks in found.items()}, least

    def candidates(self, ids: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """(first word, item) of the passages that may hold an item: by the inverted index, then by the cosine."""
        half = self.size // 2
        run = np.concatenate([[0], np.cumsum(self.anchor[ids])])
        starts = np.arange(0, max(1, -(-(len(ids) - self.size) // half) + 1)) * half
        ends = np.minimum(starts + self.size, len(ids))
        for p in starts[run[ends] - run[starts] >= self.least.min()].tolist():
            part = ids[p : p + self.size]
            own = set(part.tolist())
            found = [self.postings[w] for w in own if w in self.postings]
            if len(found) < self.least.min():
                continue
            n = np.bincount(np.concatenate(found), minlength=len(self.items))
            z = None
            for k in np.nonzero(n >= self.least)[0].tolist():
                if len(self.words[k] & own) < self.need[k]:
                    continue
                if z is None:
                    one = np.array([sorted(own)], dtype=np.int32)
                    z = gather(one, self.scaled)[0]
                    z = z / max(float(np.sqrt((self.idf[one] ** 2).sum())), 1e-9)
                if (self.queries[self.first[k] : self.first[k + 1]] @ z).max() >= least:
                    yield p, k


def _passages(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [windows(ids, size, size) for ids in _each(b.column(0))]
            if parts:
                rows = once(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), size).cast(pa.list_(pa.int32()))], names=["ids"])

    return docs.select("ids").mapInArrow(run, "ids array<int>")


def find_leaks(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rank: int = 256, passage: int = 24, least: float = 0.2, block_items: int = 20_000, fit_passages: int = 100_000, others: int = 4096, check: bool = True,
) -> DataFrame:
    """(item_id, doc_id) of each document that holds an item's text or at least 12 words in a row of it, where one word in
    six may differ. A text that occurs twice counts for each document; a pair is given once.

    Null and empty texts hold nothing and are held by none, rows without id are left out; an item of fewer than 12 words
    counts when the document has all of it but for one word in six. block_items items at a time, with their vocabulary and
    vectors (rank numbers a word, with `others` places for all words that no item has), are sent to the executors; more are
    searched in further passes. The vectors are fitted on at most about fit_passages passages, chosen by hash of the
    document; words are counted over all passages and all documents are searched. Without check, all pairs of documents and
    items that pass the cosine are given."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    schema = "item_id bigint, doc_id bigint"
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    if (total := rows.count()) > block_items:
        rows = cut(rows)
    blocks = -(-total // block_items) or 1
    found = []
    for k in range(blocks):
        own = (rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)).orderBy("i", "t").collect()
        named = [(r.i, ws) for r in own if (ws := words(r.t))]
        if named:
            vocabulary = Vocabulary(sorted({w for _, ws in named for w in ws}), others)
            ids = cut(numbered(texts, vocabulary))
            found.append(_search(ids, Index(ids, named, vocabulary, rank, passage, fit_passages), least, check))
    return reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], schema)


def _search(docs: DataFrame, index: Index, least: float, check: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            found = set()
            for doc, ids in zip(b.column(0).to_pylist(), _each(b.column(1))):
                for at, k in index.candidates(ids, least):
                    name, own = index.items[k]
                    if (name, doc) in found:
                        continue
                    reach = len(own) + 4
                    # Words that no item has share numbers with each other, never with an item's word.
                    if not check or holds(own, index.weight[k], ids[max(0, at - reach) : at + index.size + reach].tolist()):
                        found.add((name, doc))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([d for _, d in pairs], pa.int64())], names=["item_id", "doc_id"])

    return docs.mapInArrow(search, "item_id bigint, doc_id bigint")

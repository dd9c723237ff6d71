"""Text quality statistics of documents, and text types by noisy labelling functions.

Statistics are taken over the whole text in one pass over its lines and words. Thresholds on them are labelling functions
that vote for a type or abstain; none of them needs to know the language. How often each function gives each vote for each type is learned by expectation maximization on the
votes alone; documents with the same votes are one weighted row there, so its cost doesn't grow with the documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import cut

TYPES = ["prose", "list", "table", "junk"]
# Common words of the languages at hand.
COMMON = (
    "the a an of to in and was were is are that this which with for on at by it not be from after as had has have i my we our you your if when but or no do while so than about all only each more until because could would there they their can will did into its one two first before "
    "der die das und ist den dem des ein eine war wurde wurden nicht im von zu mit auf für dass weil wir haben hat am bei als es sich mehr seit nach aus "
    "le la les de du des et est un une dans pour par sur avec qui que pas il elle nous au en puis plus à été avant depuis "
    "el los las del se un una en con por para que no lo su fue al uno desde cada mientras había nadie antes"
).split()

_COMMON = frozenset(COMMON)
_WORD = re.compile(r"\w++(?:['’]\w++)*+")
_MARKS = re.compile("['’]")
_SYMBOL = re.compile(r"[^A-Za-z0-9\s.,;:!?'\"()-]")
_ANY_SYMBOL = regex.compile(r"[^\p{L}\p{N}\p{M}\p{Z}\s.,;:!?'\"()、。「」？’“”¿¡-]")
#: A piece between blanks that is a word with its punctuation.
_NATURAL = regex.compile(r"[(\[\"“„«‘'¿¡]*+[\p{L}\p{M}]++(?:[-'’·.,/][\p{L}\p{M}]++)*+[)\]\"”»’'.,;:!?…؟،؛।]*+")
_ODD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|^[bcdfghjklmnpqrstvwxz]{3,}+$|^[a-z]{18,}+$")
#: Letters of scripts that put no blanks between words.
_UNSPACED = re.compile(r"[぀-ヿ一-鿿㐀-䶿฀-๿຀-໿ក-៿က-႟、。]")
_KANA = re.compile(r"[はがをにのでとたてし]")
_MANGLED = re.compile(r"[�ÃÂÐÑ€™šœžŸ¤¶¼¾©âÄÅ][�ÃÂÐÑ€™šœžŸ¤¶¼¾©âÄÅ ]++")
_CYCLE = re.compile(r"(?<!\S)(\S.{0,24}?)\1{5,}+", re.S)
_HEX = re.compile(r"\b(?=[a-f]{0,7}\d)[0-9a-f]{4,8}\b")
_CLOSED = re.compile(r"[.!?。！？…؟।][\"”'’)\]*»]*+$")
_BORDER = re.compile(r"[ +|:=-]*?[+|=-]{3}[ +|:=-]*+")
_HTML = re.compile(r"</?t(?:able|head|body|r|d|h)\b")
_ALIGNED = re.compile(r" *+\S++(?: \S++){0,2}+(?: {2,}+\S++(?: \S++){0,2}+){2,}+ *+")
_MARKED = re.compile(r"\s*+(?:[-*•+–‣◦▪·]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX✓]?\]|[☐☑✓])\s+\S")
_KEYED = re.compile(r"\s*+[\w.-]{2,30}: \S")
_STOP = tuple(".!?。")
# Separators of cells, how many a row has at least, and how long a cell is of which one row alone makes a table.
_SEPARATORS = {"bar": (re.compile(r"\|"), 2, 60), "tab": (re.compile(r"(?<=\S)\t"), 1, 60), "separated": (re.compile(r"[;,](?![ \n]|$)"), 2, 40), "ampersand": (re.compile(r" & "), 2, 61)}
#: Lines alike from which long cells make rows and long entries a list; fewer are taken for sentences with such signs.
LEAST_LINES = 3
_SIZES = ["n_chars", "n_words", "n_lines", "tab_lines"]
_RATIOS = [
    "mean_word_length", "symbol_ratio", "digit_ratio", "closed_lines", "common_words", "distinct_words", "odd_words", "natural_words", "unspaced", "mean_line_words", "mean_line_chars", "wrapped",
    "in_bar", "in_tab", "in_separated", "in_ampersand", "in_aligned", "in_border", "in_html", "in_marked", "in_keyed", "in_brief", "in_closed", "in_cycle", "in_unbroken", "in_hexwords", "in_mangled",
]


class _Kept(dict):
    """What is found of a word, kept for a bounded number of them."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, word: str):
        found = self.of(word)
        if len(word) < 40 and len(self) < 300_000:
            self[word] = found
        return found


def _rows(lines: list[str], kind: str) -> int:
    """Characters in lines that are rows of cells: short ones, or most of those with the separator and as many cells each."""
    pattern, least, short = _SEPARATORS[kind]
    sign = {"bar": "|", "tab": "\t", "ampersand": " & "}.get(kind)
    found, brief = [], 0
    for x in lines:
        if sign is None:
            signs = x.count(",") + x.count(";")
            n = len(pattern.findall(x)) if signs > 1 else 0
            if n < least or n < signs:  # separators with blanks after them, as in sentences: cells if they are semicolons
                n, cells = (x.count(";"), x.split(";")) if x.count("; ") >= 3 else (n, ())
            else:
                cells = pattern.split(x)
        else:
            n = x.count(sign) if sign in x else 0
            if kind == "tab" and n:
                n = len(pattern.findall(x))
            cells = pattern.split(x) if n >= least else ()
        if n >= least and any(map(str.isalnum, x)):
            # Semicolons with blanks occur in sentences too, so long cells between them are none.
            found.append((n if sign or n == signs else -len(found) - 1, len(x)))
            if cells and max(map(len, cells)) <= short:
                brief += len(x)
    if not found:
        return 0
    k, alike = Counter(n for n, _ in found).most_common(1)[0]
    long = sum(size for n, size in found if n == k) if alike >= LEAST_LINES and 2 * alike > len(found) else 0
    return max(brief, long)


def _entries(lines: list[str], pattern: re.Pattern, short: int, open_end: bool) -> int:
    found = [x for x in lines if pattern.match(x) and not (open_end and x.rstrip().endswith(_STOP))]
    return sum(map(len, found)) if len(found) >= LEAST_LINES else sum(len(x) for x in found if len(x) <= short + 32)


def measure(text: str | None, odd: dict[str, bool], natural: dict[str, bool]) -> tuple[list[int], list[float | None]]:
    """The statistics of a text, in the order of _SIZES and _RATIOS."""
    t = (text or "").replace("\r", "")
    plain, size = t.isascii(), len(t)
    lines = [x for x in t.split("\n") if x.strip()]
    ws = [w for w in _WORD.findall(t.lower()) if w.isalpha() or ("'" in w or "’" in w) and all(map(str.isalpha, _MARKS.split(w)))]
    pieces = t.split()
    solid, n, m = sum(map(len, pieces)), len(ws), len(lines)
    div = lambda a, b: a / b if b else None
    symbols = len(_SYMBOL.findall(t)) if plain else len(_ANY_SYMBOL.findall(t))
    digits = sum(map(str.isdigit, t)) if any(c in t for c in "0123456789") or not plain else 0
    closed = [x for x in lines if _CLOSED.search(x.rstrip())]
    letters = sum(map(str.isalpha, t)) if not plain else sum(map(len, ws)) or 1
    kana = 0 if plain else len(_KANA.findall(t))
    unspaced = 0 if plain else len(_UNSPACED.findall(t))
    n_odd = sum(odd[w] for w in ws)
    whole = sum(natural[x] for x in pieces)
    common = sum(w in _COMMON for w in ws)
    tabs = [x for x in lines if "\t" in x.lstrip()]
    cycle = 0
    if size and len(zlib.compress(t.encode("utf-8", "replace"), 1)) < 0.35 * size:
        cycle = sum(x.end() - x.start() for x in _CYCLE.finditer(t))
    borders = sum(len(x) for x in lines if x[:1] in " +|:=-" and _BORDER.fullmatch(x))
    html = sum(len(x) for x in lines if "<" in x and _HTML.search(x))
    aligned = sum(len(x) for x in lines if "  " in x.strip() and _ALIGNED.fullmatch(x))
    brief = sum(len(x) for x in lines if 2 <= len(x) <= 72 and "|" not in x and "\t" not in x and x[-1] not in " .!?:;,。|")
    share = lambda x: div(x, size)
    ratios = [
        div(sum(map(len, ws)) - sum(w.count("'") + w.count("’") for w in ws), n), div(symbols, solid), div(digits, solid), div(len(closed), m),
        max(x for x in (div(common, n), div(kana, letters), -1.0) if x is not None) if n or letters and not plain else None,
        div(len(set(ws)), n), div(n_odd, n), div(max(0, whole - n_odd), len(pieces)), div(unspaced, solid), div(n, m), div(size, m), div(sum(b.lstrip()[:1].islower() and not _CLOSED.search(a.rstrip()) for a, b in zip(lines, lines[1:])), m - 1) if m > 1 else 0.0,
        *(share(_rows(lines, k)) for k in ("bar", "tab", "separated", "ampersand")), share(aligned), share(borders), share(html),
        share(_entries(lines, _MARKED, 160, False)), share(_entries(lines, _KEYED, 90, True)), share(brief), share(sum(map(len, closed))), share(cycle),
        share(sum(len(x) for x in pieces if len(x) >= 26)), share(sum(map(len, _HEX.findall(t)))), 0.0 if plain and size else share(sum(map(len, _MANGLED.findall(t)))),
    ]
    return [size, n, m, len(tabs)], ratios


def text_statistics(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id with its statistics: n_chars, n_words, n_lines (not blank), tab_lines, mean_word_length, symbol_ratio,
    digit_ratio, closed_lines (share of lines ending in punctuation), common_words, distinct_words, odd_words (Latin ones
    without plausible vowels), natural_words (pieces between blanks that are words with their punctuation), unspaced
    (letters of scripts without blanks), mean_line_words, mean_line_chars, wrapped (share of
    lines that go on in small letters in the next), and the share of the text in rows, entries and
    other patterns. A line of cells is a row if its cells are short or at least three lines have as many, whatever their
    length; entries likewise. Of a null or empty text counts are 0 and shares null. Repeated ids give repeated rows; other
    columns are ignored."""
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    names = [*_SIZES, *_RATIOS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, natural = _Kept(lambda w: bool(_ODD.search(w))), _Kept(lambda x: bool(_NATURAL.fullmatch(x)))
        for b in batches:
            out = [measure(t, odd, natural) for t in b.column(1).to_pylist()]
            sizes = [pa.array([x[0][k] for x in out], pa.int64()) for k in range(len(_SIZES))]
            ratios = [pa.array([x[1][k] for x in out], pa.float64()) for k in range(len(_RATIOS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *sizes, *ratios], names=["id", *names])

    kinds = ", ".join([f"id {dict(rows.dtypes)['id']}", *(f"{c} bigint" for c in _SIZES), *(f"{c} double" for c in _RATIOS)])
    return rows.mapInArrow(run, kinds)


def labelling_functions() -> dict[str, Column]:
    """Thresholds on the statistics: the type voted for, or null."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    tabs = F.when(c("tab_lines") >= 3, c("in_tab")).otherwise(0.0)  # a line or two with tabs for blanks are no rows
    cells = F.greatest(tabs, *(c(f"in_{k}") for k in ("bar", "separated", "aligned", "html", "ampersand")))
    noisy = (c("symbol_ratio") > 0.22) & (cells < 0.5)
    clean = (c("symbol_ratio") < 0.15) & (c("in_hexwords") < 0.3) & (c("in_mangled") < 0.3) & (c("odd_words") < 0.3)
    entries = F.greatest(c("in_marked"), c("in_keyed"))
    # Words of any language, or letters of a script without blanks, make up nearly all of it.
    worded = (c("natural_words") >= 0.75) & (c("n_words") >= 6) | (c("unspaced") >= 0.6)
    full_lines = (c("mean_line_words") >= 12) | (c("unspaced") >= 0.3) & (c("mean_line_chars") >= 25)
    # Words repeat more in longer texts: beyond 3,000 words the least number of different ones grows with the root only.
    low = c("distinct_words") < 0.02 * F.least(F.lit(1.0), F.sqrt(F.lit(3000.0) / F.greatest(c("n_words"), F.lit(1.0))))
    return {
        "cells": F.when(cells + c("in_border") > 0.5, "table"),
        "numbers": F.when((c("digit_ratio") > 0.15) & (c("closed_lines") < 0.3) & (c("n_lines") >= 3) & (cells > 0.3), "table"),
        "entries": F.when((entries > 0.5) & (cells < 0.5), "list"),
        "brief": F.when((c("in_brief") > 0.5) & (c("n_lines") >= 4) & (cells < 0.5) & (c("common_words") < 0.35) & (c("mean_line_words") < 9) & ((c("common_words") > 0.05) | (c("mean_line_chars") < 48)), "list"),
        "common": F.when((c("common_words") >= 0.18) & ~low & clean, "prose").when((c("common_words") < 0.03) & ~worded, "junk"),
        "closed": F.when((c("in_closed") > 0.5) & ((c("common_words") > 0.08) | worded) & clean & ~low, "prose"),
        "running": F.when(full_lines & ((c("common_words") >= 0.12) | worded) & (cells < 0.5) & (entries < 0.5) & clean & ~low, "prose"),
        "wrapped": F.when(((c("wrapped") >= 0.3) & (c("mean_line_words") >= 6) | (c("mean_line_chars") >= 40) & (c("mean_line_words") >= 7.5) & (c("common_words") >= 0.25)) & worded & (cells < 0.5) & (entries < 0.5) & clean & ~low, "prose"),
        "symbols": F.when(noisy, "junk"),
        "odd": F.when((c("odd_words") > 0.3) | (c("in_unbroken") > 0.5) & (c("unspaced") < 0.3) & (cells < 0.5) | (c("in_mangled") > 0.4) | (c("in_hexwords") > 0.4), "junk"),
        "cycle": F.when((c("in_cycle") > 0.5) & (cells < 0.3) | (c("n_words") >= 20) & low, "junk"),
        "wordless": F.when((c("n_words") == 0) & (cells < 0.5) & (c("unspaced") < 0.3), "junk"),
    }


def learn(patterns: list[tuple[tuple[str | None, ...], int]], rounds: int = 30, prior: float = 20.0) -> dict[tuple[str | None, ...], np.ndarray]:
    """Posterior over TYPES for each pattern of votes, by expectation maximization over (pattern, number).

    Starts from the share of votes for each type; a function's rates of votes given the type are smoothed towards those
    starting rates with the weight of `prior` documents. A pattern without any vote is undecided and takes the class shares."""
    if not patterns:
        return {}
    k, names = len(TYPES), [*TYPES, None]
    votes = np.array([[names.index(v) for v in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    post = np.full((len(n), k), 0.25)
    for j in range(votes.shape[1]):
        for y in range(k):
            post[:, y] += votes[:, j] == y
    post /= post.sum(1, keepdims=True)

    def rates(post: np.ndarray, towards: np.ndarray | None) -> np.ndarray:
        r = np.zeros((votes.shape[1], k, k + 1))
        for j in range(votes.shape[1]):
            for v in range(k + 1):
                r[j, :, v] = (n[:, None] * post)[votes[:, j] == v].sum(0)
        base = np.full((k, k + 1), 1e-3) if towards is None else prior * towards
        r += base
        return r / r.sum(2, keepdims=True)

    start = rates(post, None)
    theta, share = start, (n[:, None] * post).sum(0) / n.sum()
    for _ in range(rounds):
        log = np.log(share + 1e-9)[None, :] + sum(np.log(theta[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        theta, share = rates(post, start), (n[:, None] * post).sum(0) / n.sum()
    return {p: post[i] for i, (p, _) in enumerate(patterns)}


def text_types(df: DataFrame, *, id: str = "doc_id", text: str = "text", max_patterns: int = 100_000) -> DataFrame:
    """id, kind (the type with the highest posterior; of equals the first of prose, list, table, junk) and posterior.

    A null or empty text is junk. No documents give no rows. The driver holds the distinct patterns of votes, of which
    eleven functions can't make more than max_patterns in practice; more are refused."""
    functions = labelling_functions()
    voted = cut(text_statistics(df, id=id, text=text).select("id", *(c.alias(k) for k, c in functions.items())))
    keys = list(functions)
    counted = voted.groupBy(*keys).agg(F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(counted) > max_patterns:
        raise ValueError("too many patterns of votes")
    post = learn(sorted(((tuple(r[k] for k in keys), r.n) for r in counted), key=str))
    rows = [(*p, TYPES[int(np.argmax(x))], float(np.max(x))) for p, x in post.items()]
    schema = ", ".join(f"`v_{k}` string" for k in keys) + ", kind string, posterior double"
    known = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    same = [voted[k].eqNullSafe(known[f"v_{k}"]) for k in keys]
    return voted.join(known, same).select("id", "kind", F.round("posterior", 6).alias("posterior"))

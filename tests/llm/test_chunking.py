import random
import re

from assay.llm.chunking import split_texts

SPLIT = re.compile(r"(?<=[.!?]\s)|(?<=\n)|(?<=。)")


def greedy(body, limit, overlap):
    ends, at = [], 0
    for part in SPLIT.split(body):
        at += len(part)
        if part:
            ends.append(at)
    out, end, start = [], 0, 0
    while end < len(body):
        reach = start + limit
        low = max(end, overlap if start == 0 else 0)
        fit = [e for e in ends if low < e <= reach]
        blank = [k for k in range(max(end, reach - (limit - overlap) // 2) + 1, min(reach, len(body)) + 1) if body[k - 1].isspace()]
        new = max(fit) if fit else max(blank) if blank else reach
        out.append((start, new))
        end, start = new, new - overlap
    return out


def text(rnd, n):
    out = []
    while sum(map(len, out)) < n:
        word = "".join(rnd.choice("abcéß日") for _ in range(rnd.choice([1, 3, 8, 40])))
        out.append(word + rnd.choice([" ", " ", " ", ". ", "\n", "。", "! "]))
    return "".join(out)


def test_against_plain_greedy(spark):
    rnd = random.Random(3)
    docs = [(str(i), None, text(rnd, n)) for i, n in enumerate([50, 99, 100, 101, 300, 700, 2500, 900])] + [("long", None, "x" * 950), ("mixed", None, "a. " + "y" * 420 + ". " + "b. " * 90), ("late", None, "z" * 250 + ". end of it. " * 20)]
    out = split_texts(spark.createDataFrame(docs, "id string, title string, text string"), limit=100, overlap=10).collect()
    for i, _, body in docs:
        got = sorted((r.begins, r.ends, r.piece) for r in out if r.id == i)
        if len(body) > 100:
            assert [g[:2] for g in got] == greedy(body, 100, 10), i
        else:
            assert [g[2] for g in got] == [body]
        assert all(len(p) == e - b <= 100 and body[b:e] == p for b, e, p in got)
        assert "".join(p[10 * (b > 0) :] for b, _, p in got) == body


def test_titles_and_stretches(spark):
    docs = [("a", "Title", "x" * 101 + ". y"), ("b", None, "x. " * 40), ("c", "T", "s" * 90 + ". " + "t" * 50)]
    out = {r.id: (r.size, r.longest_stretch) for r in split_texts(spark.createDataFrame(docs, "id string, title string, text string"), limit=100, overlap=10).collect()}
    assert out == {"a": (111, 103), "b": (120, 3), "c": (145, 92)}


def test_cases(spark):
    docs = [("a", None, None), ("b", None, ""), ("c", "only title", None), ("d", None, "same"), ("d", None, "same"), (None, "t", "no id " * 40), ("e", None, "word. " * 20000), ("f", "t", "")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "id string, title string, text string, key string, size int")
    out = split_texts(df, limit=100, overlap=10).collect()
    ids = [r.id for r in out]
    assert "a" not in ids and "b" not in ids and "c" not in ids and ids.count("d") == 1 and ids.count(None) >= 3 and ids.count("f") == 1
    assert sum(r.ends - r.begins for r in out if r.id == "e") == 120000 + 10 * (ids.count("e") - 1)
    assert split_texts(df.limit(0)).count() == 0


def test_blanks_before_words(spark):
    """Words without any stop are cut after blanks, and one text of nearly all characters is many pieces of one row."""
    words = "alpha bravo charlie delta echo foxtrot golf hotel " * 60
    out = split_texts(spark.createDataFrame([("a", None, words), ("hot", None, "One sentence here. " * 40000)], "id string, title string, text string")).collect()
    mine = sorted((r for r in out if r.id == "a"), key=lambda r: r.piece_no)
    assert len(mine) == 3 and all(r.piece.endswith(" ") for r in mine) and all(len(r.piece) <= 1500 for r in out)
    assert "".join(r.piece[150 * (r.piece_no > 0) :] for r in sorted((r for r in out if r.id == "hot"), key=lambda r: r.piece_no)) == "One sentence here. " * 40000

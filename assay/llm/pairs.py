"""Defects of prompt and response pairs: empty, copied, refused, in another language, or broken off.

Copies are found by aligning response and prompt: shingle containment first, then the longest common subsequence of
their tokens. Refusals are found by aligning the response's sentences with refusal templates in the same way. A slot takes
any number of words, but an answer that turns to something else (but, however), or has a sentence besides that is
neither a refusal nor a remark on one, is none. Languages are told by script, then by function words; a response that has
hardly any function word of the prompt's language is compared with the words that all other responses use. Whether a
response without a final stop is broken off is decided by how often its last words end a sentence, or go on, in all responses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import cut

# Refusal templates over lower-case words without contractions; * takes any number of words, | is a choice.
REFUSALS = """
i|we do not know *
i|we am|are not sure|certain|aware *
i|we * cannot|could answer|say|help|assist|tell|comment|discuss|provide|share|determine|confirm|speculate|find|give|offer|disclose|respond|comply *
i|we * not answer|say|help|assist|comment|discuss|provide|share|speculate|find|disclose|guess *
i|we am|are unable to *
i|we am|are not able|allowed|permitted|authorized|authorised to *
i|we have|hold|possess|found|find|see no information|knowledge|record|records|details|data|idea|answer|access|mention|evidence|comment *
i|we do not have|possess|see|find|hold any|enough|the|sufficient|reliable|that|this|access|information|details|data *
i|we lack *
i|we must|have|need|will to|respectfully|decline|refuse *
i|we decline|refuse to *
i|we would|prefer|rather rather|prefer|not not|to *
my training|knowledge * not cover|include|contain|extend|reach *
as an ai * i|we not|cannot *
as an ai * cannot|not *
unable to answer|determine|say|find|tell|help|comment *
not enough|sufficient information|context|data|details *
it is not possible|clear|known|stated|mentioned *
it would not be appropriate|right|possible *
it is|remains impossible|unknown|unclear|uncertain *
this|that is not something i|we *
this|that|the * cannot be answered|determined|established|known|said *
cannot be answered|determined|established|known|said *
this|that|the information|detail|details|answer|data * not available|known|provided|given *
* not available to me *
no comment|answer|information|details|data|mention|record|statement is|can|was|are|on|about|of|available|possible|given *
there is|are no information|mention|record|details|data|answer|evidence|reference *
nothing in the|these|my documents|document|context|passages|passage|sources|source|excerpts|excerpt|notes|material|materials|texts|records|training *
the|these|those|my|your|provided|given * documents|document|context|passages|passage|sources|source|excerpts|excerpt|notes|material|materials|texts|records * not|no|nothing *
the|these|those|my|your * documents|document|context|passages|passage|sources|source|excerpts|excerpt|notes|material|materials|texts|records are|is silent *
* outside|beyond of|the|my what|scope|knowledge|remit *
for safety|security|privacy|legal|policy|confidentiality reasons * not|cannot *
ich weiß * nicht *
das weiß ich nicht *
* kann|darf|möchte ich * nicht|keine *
ich kann|darf|möchte|habe|finde|besitze * nicht|keine|keinen|kein|nichts *
dazu|darüber|hierzu liegen|gibt|habe|finde|kann * keine|nichts|nicht *
* liegen mir|uns keine *
je ne|n'ai|n sais|peux|dispose|suis|ai pas *
je n'ai|ne * aucune|pas *
il * aucune information *
no lo sé *
no sé *
no puedo|podemos|tengo|tenemos|dispongo|hay *
lo siento * no *
non|eu|não lo|posso|ho|sei|so *
ik weet|kan het|niet|dat niet|antwoorden *
""".strip().split("\n")
# Words by which a sentence can decline; one without any isn't aligned.
_CUES = frozenset("not cannot no nothing unable decline refuse lack silent impossible unknown unclear uncertain outside beyond rather nicht keine keinen kein nichts pas aucune ne non não niet".split())
_CONTRACTIONS = {"n't": " not", "'m": " am", "'re": " are", "'d": " would", "'ve": " have", "'ll": " will", "'s": " is"}
_JAPANESE_NO = re.compile("(?:わかりません|分かりません|お答えできません|回答できません|お答えしかねます|情報(?:は|が)(?:ありません|含まれていません|見つかりません)|記載(?:は|が)ありません)")
# Function words by language.
WORDS = {
    "en": "the a an of to in and was were is are that which with for on at by it not be this from after as had has have because when how what why who did its between there",
    "de": "der die das den dem des und ist war wurde wurden nicht ein eine einen mit für von zu im am auf aus bei als seit nach vor sich es wir haben hat dass weil warum wie danach seitdem dann",
    "fr": "le la les l des du de et est était été une un dans pour par sur avec qui que pas ne elle il nous au aux en depuis avant cause pendant environ pourquoi puis d",
    "es": "el la los las de del y es fue era una un en para por con que no se al lo su desde entonces mientras cada porque cerca antes qué hasta nadie había dejó",
    "it": "il lo la gli le di del della e è era una un in per con che non si da dal al come perché dopo sono stato",
    "pt": "o a os as de do da e é foi era uma um em para por com que não se ao no na como porque depois foram",
    "nl": "de het een en is was werd van in op te met voor niet dat die door aan bij na als omdat waarom hoe wij hebben",
    "pl": "w z na do i nie to że się jest był była było po o od przez dla jak co który która które oraz ale już za przed gdy",
    "sv": "och att det som en på är av för med den till inte har de ett om var så från vid men efter hade när blev",
    "da": "og at det som en på er af for med den til ikke har de et om var så fra ved men efter havde da blev",
    "tr": "ve bir bu da de için ile çok olarak olan daha sonra ancak gibi kadar değil oldu neden nasıl tarafından",
    "fi": "ja on ei että se oli joka kun mutta myös sekä niin kuin hän ovat jälkeen mukaan koska ennen",
    "cs": "a je se na že to v s z do byl byla bylo ale jako pro po který která které nebo od aby když",
    "ro": "și de la în cu pe nu este a fost care că din pentru un o mai după prin sau dar când",
    "hu": "a az és hogy nem is egy volt van meg ez mint csak de már után miatt mert amely",
    "id": "yang dan di ke dari untuk dengan ini itu tidak pada adalah oleh karena setelah sebagai akan telah",
    "vi": "và của là có được cho không trong một các này đã với khi người từ do vì sau",
}
# Scripts by ranges of letters.
_SCRIPTS = {
    "ja": "぀-ヿ", "ko": "가-힯ᄀ-ᇿ", "han": "㐀-䶿一-鿿", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿݐ-ݿ", "hebrew": "֐-׿", "devanagari": "ऀ-ॿ",
    "bengali": "ঀ-৿", "tamil": "஀-௿", "thai": "฀-๿", "georgian": "Ⴀ-ჿ", "armenian": "԰-֏",
}
# What stands in for an answer.
PLACEHOLDERS = set("null none nil nan n/a na tbd todo undefined empty blank void placeholder no output|no answer|not available|no response|no data".replace("|", " | ").split()) | {
    "no output", "no answer", "not available", "no response", "no data", "not applicable", "no content",
}
_OPENERS = r"^(?:(?:(?:i'm|i am|we are|we're) (?:very |truly |so )?(?:sorry|afraid)(?: that)?|sorry|apologies|unfortunately|regrettably|leider|entschuldigung|désolé|lo siento|at this time|currently)\b[.,!:]*(?:\s*,?\s*but\b)?[.,!:]*\s+|(?:sure|certainly|of course|okay|ok|thank you for (?:the|your) question|great question|good question)\b[.,!:]*\s+)+"
_LABEL = r"^(?:(?:the\s+)?(?:final\s+)?(?:answer|response|output|reply|a|q|question|antwort|frage|réponse|respuesta|pregunta|you asked|your question(?: was| is)?|the question (?:was|is)|回答|質問)\s*[:：]\s*)+"
_CITE = re.compile(r"\s*[\[【](?:\d+(?:\s*[,;]\s*\d+)*|(?:doc|source)s?\s*\d+)[\]】]", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|(?:(?![぀-ヿ㐀-鿿가-힯])[^\W_])+(?:['’](?:(?![぀-ヿ㐀-鿿가-힯])[^\W_])+)*")
_FUNC = {lang: frozenset(words.split()) for lang, words in WORDS.items()}
_LANGS: dict[str, list[str]] = {}
for _lang, _own in _FUNC.items():
    for _w in _own:
        _LANGS.setdefault(_w, []).append(_lang)
_SCRIPT = {name: re.compile(f"[{r}]") for name, r in _SCRIPTS.items()}
_OTHER = re.compile(f"[{''.join(_SCRIPTS.values())}]")
_COUNT = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "zwei": 2, "drei": 3, "deux": 2, "trois": 3, "dos": 2, "tres": 3} | {str(k): k for k in range(2, 10)}
_END = re.compile(r"(?<=[.!?])(?=[\s\"'”’)\]*]|$)|(?<=[。！？])|\n")


_HIDDEN = re.compile(r"[​-‏⁠﻿­]")
_MARKUP = re.compile(r"```\w*|\*\*|__|^#+\s*|`")
_OPENER, _LABELLED = re.compile(_OPENERS, re.I), re.compile(_LABEL, re.I)


def bare(text: str | None) -> str:
    """Without citation marks, tags, fences, emphasis and invisible characters."""
    t = text or ""
    if not t.isascii():
        t = _HIDDEN.sub("", t).replace("　", " ")
    if "[" in t or "【" in t:
        t = _CITE.sub("", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    return _MARKUP.sub(" ", t).strip() if "`" in t or "*" in t or "_" in t or t[:1] == "#" else t.strip()


def body(text: str) -> str:
    """Without a leading label or courtesy."""
    while True:
        m = _OPENER.match(text) or _LABELLED.match(text)
        if not m or not m.end():
            return text.strip()
        text = text[m.end() :].strip()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("’", "'"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one bit a token of a; what both begin and end with is counted first."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    full, kept = (1 << len(a)) - 1, {}
    row = full
    for y in b:
        if y not in places:
            continue
        mask = kept.get(y)
        if mask is None:
            bits = bytearray(len(a) // 8 + 1)
            for i in places[y]:
                bits[i >> 3] |= 1 << (i & 7)
            mask = int.from_bytes(bits, "little")
            if len(kept) * len(bits) < 1 << 25:  # the masks of all words of a long text would be large
                kept[y] = mask
        both = row & mask
        row = ((row + both) | (row - both)) & full
    return head + tail + len(a) - row.bit_count()


# Words by which a sentence turns to an answer, and how remarks on a refusal begin, or what they speak of.
_TURN = frozenset("but however yet although though except whereas nevertheless nonetheless instead only".split())
_REMARK = re.compile(
    r"(?:please|sorry|apologies|thanks|thank you|let me know|feel free|if (?:you|more|further|additional)|(?:perhaps|maybe) you|you (?:may|might|could|can|should|would|will) (?:want|need|wish|try|ask|check|consult|contact|find|like|have)"
    r"|(?:i|we)(?:'m| am| are) (?:very |truly )?(?:sorry|afraid|unable)|(?:i|we) apologi[sz]e|(?:i|we)(?:'d| would) (?:need|rather not)|(?:i|we) (?:cannot|can't|do not|don't) (?:help|say|tell|answer|speculate|guess))\b"
)
_SOURCES = frozenset("documents document context passages passage sources source excerpts excerpt notes information material materials texts records".split())
_NONE = frozenset("no not none nothing neither nor without don't doesn't cannot can't isn't aren't".split())


def plain_words(text: str) -> list[str]:
    """Words in lower case with contractions written out."""
    t = text.lower().replace("’", "'").replace("can't", "cannot").replace("can not", "cannot").replace("won't", "will not")
    if "'" in t:
        for short, long in _CONTRACTIONS.items():
            t = t.replace(short, long)
    return tokens(t)


def _aligned(items: list[frozenset[str] | None], n: int, slots: int, words: list[str]) -> bool:
    """A template's items (None a slot) against a sentence: at most 0.15 of its n words missing, and few words outside of the slots."""
    lost, most, far = int(0.15 * n), (2 if slots else int(0.35 * n) + 1), len(words) + n

    def skip(state: list[list[int]]) -> list[list[int]]:
        for i, item in enumerate(items):
            for m in range(lost + 1):
                if item is None:
                    state[i + 1][m] = min(state[i + 1][m], state[i][m])
                elif m < lost:
                    state[i + 1][m + 1] = min(state[i + 1][m + 1], state[i][m])
        return state

    # state[i][m]: fewest words outside of slots, with i items used and m of them missing.
    state = [[far] * (lost + 1) for _ in range(len(items) + 1)]
    state[0][0] = 0
    state = skip(state)
    for w in words:
        new = [[x + (i == len(items) or items[i] is not None) for x in row] for i, row in enumerate(state)]
        for i, item in enumerate(items):
            if item is not None and w in item:
                new[i + 1] = [min(x, y) for x, y in zip(new[i + 1], state[i])]
        state = skip(new)
    return min(state[-1]) <= most


_ITEMS = [([None if w == "*" else frozenset(w.split("|")) for w in t.split()], sum(w != "*" for w in t.split()), t.count("*")) for t in REFUSALS]


def _matches(words: list[str]) -> bool:
    """Some template is aligned with the sentence."""
    here = set(words)
    if not here & _CUES or here & _TURN:
        return False
    for items, n, slots in _ITEMS:
        held = sum(not here.isdisjoint(x) for x in items if x is not None)
        if held >= n - int(0.15 * n) and _aligned(items, n, slots, words):
            return True
    return False


def declines(said: str) -> bool:
    """Every sentence is a refusal or a remark on one, and there is a refusal."""
    if _JAPANESE_NO.search(said) and len(re.findall("。", said)) <= 2:
        return True
    refused = False
    for part, _ in _parts(said):
        if not re.search(r"[^\W_]", part):
            continue
        words = plain_words(body(part))
        if words and _matches(words):
            refused = True
            continue
        here = set(words)
        if here & _TURN or words and not (_REMARK.match(part.strip().lower()) or here & _SOURCES and here & _NONE):
            return False
    return refused


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The question again, once or several times, and nothing more: most of its shingles, and a long common subsequence."""
    times = round(len(answer) / len(question)) if question else 0
    if 2 <= times <= 10:
        return all(is_copy(question, answer[i * len(answer) // times : (i + 1) * len(answer) // times]) for i in range(times))
    if len(question) < 3 or not 0.75 * len(question) <= len(answer) <= 1.34 * len(question):
        return False
    pairs = lambda w: set(zip(w, w[1:]))
    q = pairs(question)
    return len(q & pairs(answer)) >= 0.6 * len(q) and lcs(question, answer) >= 0.8 * max(len(question), len(answer))


def language(text: str) -> tuple[str, int]:
    """The script that prevails, or for Latin letters the language with the most function words, and how many letters or words say so."""
    found = {name: len(p.findall(text)) for name, p in _SCRIPT.items()} if _OTHER.search(text) else {}
    latin = sum(map(str.isalpha, text)) - sum(found.values()) if found else 0
    if found and sum(found.values()) * 2 > latin:
        best = max(found, key=lambda k: found[k])
        if best == "han" and found["ja"]:
            best = "ja"
        return best, sum(found.values())
    hits: Counter = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for lang in _LANGS.get(w, ()):
            hits[lang] += 1
    best2 = hits.most_common(2)
    if not best2:
        return "", 0
    return best2[0][0], best2[0][1] - (best2[1][1] if len(best2) > 1 else 0)


def _own(text: str, lang: str) -> int:
    """How many words, or letters of its script, the text has of a language."""
    if lang in _FUNC:
        return sum(w in _FUNC[lang] for w in tokens(text))
    return len(_OTHER.findall(text)) if lang in _SCRIPT else 0


def _words(sentence: str) -> list[str]:
    """Words as they are counted: digits become 9, capitals inside a sentence stand for a name."""
    out = []
    for i, w in enumerate(re.findall(r"[぀-ヿ㐀-鿿]|[^\s\"“”()぀-ヿ㐀-鿿]+", _CITE.sub("", sentence))):
        w = re.sub(r"\d+", "9", w.strip(",;:.!?。！？"))
        if w:
            out.append("N" if i and w[0].isupper() else w.lower())
    return out


def _grams(words: list[str], i: int) -> str:
    return " ".join((["^", "^", *words])[i : i + 3])


def _parts(text: str) -> list[tuple[str, bool]]:
    """Sentences and lines, and whether each is closed by a stop or by a line after it."""
    t = _CITE.sub("", text).rstrip()
    out, last = [], 0
    for m in _END.finditer(t):
        if m.start() > last and t[last : m.start()].strip():
            out.append((t[last : m.start()].strip(), True))
        last = max(last, m.end())
    if t[last:].strip():
        out.append((t[last:].strip(), False))
    return out


_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s*(?:([^\W\d_]+):)?")


def evidence(texts: Iterator[str]) -> Counter:
    """(key, ended or not) -> number: of three words (3), one word (1) and list labels (L), how often the sentence or list ends there."""
    c: Counter = Counter()
    for text in texts:
        parts = _parts(bare(text))
        for sentence, closed in parts:
            words = _words(sentence)
            for i in range(len(words)):
                end = i == len(words) - 1
                if not end or closed:
                    c["3" + _grams(words, i), end] += 1
                    c["2" + " ".join(words[max(0, i - 1) : i + 1]), end] += 1
                    c["1" + words[i], end] += 1
        labels = [m[1].lower() for line in text.split("\n") if (m := _ITEM.match(line)) and m[1]]
        for i, label in enumerate(labels):
            if i < len(labels) - 1 or (parts and parts[-1][1]):
                c["L" + label, i == len(labels) - 1] += 1
    return c


def tail(text: str) -> tuple[str, list[str]]:
    """How a text ends: closed, broken (inside a quotation, citation, list or enumeration), or open with the keys of its last words."""
    raw = text.rstrip()
    if raw.count("```") % 2 or re.search(r"[\[【][^\]】\s]{0,12}$", raw) or re.search(r"(?:…|\.\.\.)[\"'”)]*$", raw):
        return "broken", []
    t = _CITE.sub("", raw).rstrip(" *_`\t")
    t = re.sub(r"[​-‏⁠﻿]", "", t).rstrip()
    if t.count('"') % 2 or t.count("(") > t.count(")") or t.count("“") > t.count("”") or t.count("「") > t.count("」"):
        return "broken", []
    lines = [x for x in t.split("\n") if x.strip()]
    if not lines or re.match(r"^\s*(?:[-*•]|\d+[.)])\s*(?:[^\W\d_]+:)?$", lines[-1]):
        return "broken", []
    if re.search(r"[,;:、，(\-–—/]$", t):
        return "broken", []
    promise = re.search(r"\b(\w+) [^\W\d_]+:\s*$", lines[0].lower()) if len(lines) > 1 else None
    items = [x for x in lines[1:] if _ITEM.match(x)]
    if promise and promise[1] in _COUNT and items and len(items) < _COUNT[promise[1]]:
        return "broken", []
    labels = [m[1].lower() for x in lines if (m := _ITEM.match(x)) and m[1]]
    keys = ["L" + labels[-1]] if labels else []
    last, closed = _parts(bare(t))[-1] if _parts(bare(t)) else ("", False)
    if closed:
        return "closed", keys
    words = _words(last)
    if not words:
        return "closed", keys
    return "open", [*keys, "3" + _grams(words, len(words) - 1), "2" + " ".join(words[-2:]), "1" + words[-1], f"n{len(_words(bare(t)))}"]


#: Words from which on a response without function words of the prompt's language is looked into.
LEAST_WORDS = 6


def judge(question: str | None, answer: str | None, kind: str | None) -> tuple[str | None, list[str]]:
    """(defect, keys): empty, copy, refusal or language; truncated where the text is broken; else the keys to decide that, if any."""
    plain = bare(answer)
    said = body(plain)
    core = re.sub(r"[\W_]+", " ", said).strip().lower()
    if not core or core in PLACEHOLDERS or re.sub(r"[^a-z/]", "", said.lower()) in PLACEHOLDERS or not body(plain + " ").strip():
        return "empty", []
    asks = bare(question)
    q, a = tokens(asks), tokens(said)
    if is_copy(tokens(body(asks)), a) or is_copy(q, a):
        return "copy", []
    if declines(said):
        return (None if kind == "unanswerable" else "refusal"), []
    of, n = language(said)
    asked, m = language(asks)
    strange: list[str] = []
    if asked and m >= 1:
        own = _own(said, asked)
        # A quotation in another language doesn't make the answer one.
        if of and of != asked and n >= 2 and own < 0.5 * (n + own):
            return "language", []
        # Notes in few words each have hardly any function word in any language.
        if asked in _FUNC and len(a) >= LEAST_WORDS and own < 0.06 * len(a) and len(a) >= 4 * len(re.findall(r"[^\s.,;:!?][^.,;:!?\n]*", said)):
            strange = sorted({"u" + w for x, _ in _parts(said) for w in _words(x) if w not in ("N", "9")})
    end, keys = tail(answer or "")
    return ("truncated", []) if end == "broken" else (None, strange + keys)


def foreign(counts: dict[str, tuple[int, int]]) -> bool:
    """Of a response with hardly any function word of its prompt's language: whether most of its words occur in no other response."""
    words = [k for k in counts if k[0] == "u"]
    return bool(words) and 2 * sum(not sum(counts[k]) for k in words) > len(words)


def broken_off(counts: dict[str, tuple[int, int]], keys: list[str]) -> bool:
    """From key -> (ended, went on): whether a text with these last words lacks more than its final stop."""
    got = lambda kind: next((counts.get(k, (0, 0)) for k in keys if k[0] == kind), (0, 0))
    ended, on = got("L")
    if ended + on >= 5 and ended < 0.02 * on:
        return True
    n = next((int(k[1:]) for k in keys if k[0] == "n"), 0)
    if not n:
        return False
    ended, on = got("3")
    if ended + on:
        return ended < 0.5 * (ended + on)
    known = got("1")
    if n <= 6:
        return sum(known) == 0 and n > 2
    ended, on = got("2")
    return not ended or ended < 0.5 * (ended + on)


def pair_defects(pairs: DataFrame) -> DataFrame:
    """From (src, id, question, answer, type): (src, id, defect) of each defective pair, one defect at most.

    Repeated rows count once; a pair answered more than once has the defect of its first answer in text order that has
    one. A null question can't be copied or differ in language; a null answer is empty. Evidence on endings is counted
    over all answers, first within each task; only keys of answers without a final stop are looked up."""
    pairs = cut(pairs.select("src", "id", "question", "answer", "type").distinct())

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [judge(*x) for x in zip(b["question"], b["answer"], b["type"])]
            yield pd.DataFrame({"src": b["src"], "id": b["id"], "answer": b["answer"], "defect": [d for d, _ in out], "keys": [k for _, k in out]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        frame = lambda c: pd.DataFrame([(k, n if end else 0, 0 if end else n) for (k, end), n in c.items()], columns=["key", "ended", "went_on"])
        for b in batches:
            c.update(evidence(x for x in b["answer"] if x))
            if len(c) > 300_000:
                yield frame(c)
                c.clear()
        yield frame(c)

    rows = cut(pairs.mapInPandas(judged, "src string, id string, answer string, defect string, keys array<string>"))
    # Broken, empty and refused texts say nothing on how sentences end, nor do those that may be in another language.
    asked = rows.filter("defect is null and size(keys) > 0").select("src", "id", "answer", "keys")
    sound = rows.filter("defect is null and not exists(keys, k -> k like 'u%')").select("answer")
    counts = sound.mapInPandas(counted, "key string, ended bigint, went_on bigint").groupBy("key").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))
    # A text's own length needs no evidence; the words of strange texts are looked up as words.
    own = F.filter("keys", lambda k: k.startswith("n")).alias("own")
    wanted = asked.select("src", "id", "answer", own, F.explode(F.filter("keys", lambda k: ~k.startswith("n"))).alias("k"))
    wanted = wanted.withColumn("key", F.when(F.col("k").startswith("u"), F.concat(F.lit("1"), F.expr("substring(k, 2)"))).otherwise(F.col("k")))
    found = F.collect_list(F.struct(F.col("k").alias("key"), F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("went_on", F.lit(0)).alias("on")))
    both = wanted.join(counts, "key", "left").groupBy("src", "id", "answer").agg(found.alias("seen"), F.first("own").alias("own"))

    def cutoff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = "L321n"
        for b in batches:
            hit = []
            for seen, own in zip(b["seen"], b["own"]):
                counts = {e["key"]: (e["ended"], e["on"]) for e in seen}
                rest = {k: v for k, v in counts.items() if k[0] != "u"}
                keys = sorted([*rest, *own], key=lambda k: order.index(k[0]))
                hit.append("language" if foreign(counts) else "truncated" if broken_off(rest, keys) else None)
            yield b[["src", "id"]].assign(defect=hit).dropna(subset=["defect"])

    late = both.mapInPandas(cutoff, "src string, id string, defect string")
    found = rows.filter("defect is not null").select("src", "id", "defect").unionByName(late)
    return found.groupBy("src", "id").agg(F.min("defect").alias("defect"))

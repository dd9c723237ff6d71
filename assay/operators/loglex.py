"""Tokens of log lines, their masks, times, and what the slots of a mined template hold.

A line is cut into tokens once; their masks (what is a number, a word, a level, a month, punctuation or the name of a
key) are the line's shape. A Head counts the values in the slots before the message over all its lines; head_plans()
decides by the counts of a template's heads which slots are time, level and component. Reading a line's fields is then
indexing its tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from datetime import date, datetime
from functools import lru_cache
from hashlib import blake2b
from operator import itemgetter
from typing import NamedTuple

# Level names by severity class.
LEVELS = {
    "FATAL": ["FATAL", "CRITICAL", "CRIT", "EMERGENCY", "EMERG", "ALERT", "PANIC", "F", "C"],
    "ERROR": ["ERROR", "ERR", "SEVERE", "E"],
    "WARN": ["WARN", "WARNING", "W"],
    "INFO": ["INFO", "NOTICE", "INFORMATION", "I", "N"],
    "DEBUG": ["DEBUG", "TRACE", "FINE", "VERBOSE", "D", "T", "V"],
}
# Names of the fields in JSON and key=value entries.
TIME_KEYS = ["time", "ts", "timestamp", "@timestamp", "t", "datetime"]
LEVEL_KEYS = ["level", "lvl", "severity", "loglevel"]
NAME_KEYS = ["logger", "component", "comp", "module", "svc", "service", "subsystem"]
SAY_KEYS = ["message", "msg", "event"]
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_MONTH_NAMES = frozenset([m.lower() for m in MONTHS] + "january february march april june july august september sept october november december".split())
_DAY_NAMES = frozenset("mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday".split())
LEVEL_OF = {word: name for name, words in LEVELS.items() for word in words}

_LEX = re.compile(r'"[@\w.-]+"\s*+:\s*+|"(?:[^"\\]++|\\.)*+"\s*+|[A-Za-z_@][\w.]*+=|\w++(?:[.\-/@$]\w++)*+\s*+|[^\w\s]\s*+|^\s++', re.S)
_DIGITS = re.compile(r"\d+")
_DATED = re.compile(r"9(?:[-./TZ]{1,2}9){0,9}[TZ]?")


def lex(line: str) -> list[str]:
    """The line's tokens, each with the blanks that follow it; together they are the line."""
    return _LEX.findall(line)


def mask(token: str) -> str:
    """What kind of token it is; a blank at the end says that one follows it."""
    v = token.rstrip()
    blank = " " if len(v) < len(token) else ""
    if not v:
        return " "
    c = v[0]
    if c == '"' and len(v) > 1:
        return '"' + v[1 : v.index('"', 1)] + '":' if v[-1] == ":" else '"' + blank
    if v[-1] == "=" and len(v) > 1:
        return v
    if not (c.isalnum() or c == "_"):
        return v + blank
    if v.isdigit():
        return "9" + blank
    if c.isdigit():
        d = _DIGITS.sub("9", v)
        return (d if _DATED.fullmatch(d) else "x") + blank
    low = v.lower()
    if low in _MONTH_NAMES and c.isupper():
        return "M" + blank
    if low in _DAY_NAMES and c.isupper():
        return "D" + blank
    if len(v) > 1 and v.upper() in LEVEL_OF:
        return "L" + blank
    if _DIGITS.search(v):
        return "x" + blank
    return ("A" if v == v.upper() and v.isascii() else "a") + blank


class Masks(dict):
    """Masks by token; what is kept is bounded."""

    def __missing__(self, token: str) -> str:
        m = mask(token)
        if len(token) < 40:
            if len(self) > 200_000:
                self.clear()
            self[token] = m
        return m


# --- times

_CLOCK = r"(?P<h>\d\d?):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?:[.,]\d+)?"
_HALF = r"(?:\s?(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"(?:\s?(?P<z>Z|UTC|GMT|[+-]\d\d:?\d\d)(?![\w:]))?"
_MON = r"(?P<mon>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*+\.?"
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*+,?\s+)?"
# Notations of a time.
TIMES = {
    "year": re.compile(rf"(?P<y>\d{{4}})[-/.](?P<mo>\d\d?)[-/.](?P<d>\d\d?)[T\s:_-]\s*(?P<h>\d\d?)[:.](?P<mi>\d\d)(?:[:.](?P<s>\d\d))?(?:[.,:]\d+)?{_HALF}{_ZONE}"),
    "solid": re.compile(rf"(?P<y>(?:19|20)\d\d)(?P<mo>\d\d)(?P<d>\d\d)[T\s_-]?(?P<h>\d\d):?(?P<mi>\d\d):?(?P<s>\d\d)(?:[.,]\d+)?{_ZONE}"),
    "day": re.compile(rf"(?P<a>\d\d?)([./-])(?P<b>\d\d?)\2(?P<y>\d{{4}})[,T\s:]\s*{_CLOCK}{_HALF}{_ZONE}"),
    "named": re.compile(rf"{_WEEKDAY}{_MON}\s+(?P<d>\d\d?),?\s+(?:(?P<y>\d{{4}}),?\s+)?{_CLOCK}{_HALF}(?:\s+(?:UTC\s+|GMT\s+)?(?P<y2>\d{{4}})(?!\d))?{_ZONE}"),
    "day_named": re.compile(rf"{_WEEKDAY}(?P<d>\d\d?)[/ -]{_MON}[/ -](?P<y>\d{{4}})[:\sT,]+{_CLOCK}{_HALF}{_ZONE}"),
    "clock": re.compile(rf"{_CLOCK}{_HALF}\s+(?P<y>\d{{4}})[-/.](?P<mo>\d\d?)[-/.](?P<d>\d\d?){_ZONE}"),
    "letter": re.compile(rf"(?P<l>[A-Z])(?P<mo>\d\d)(?P<d>\d\d)\s+{_CLOCK}"),
    "epoch": re.compile(r"(?P<e>\d{10})(?:\d{3})?(?:\.\d+)?(?![\w.:-])"),
}

#: Notations whose year may be missing.
YEARLESS = frozenset(["letter", "named", ""])


@lru_cache(100_000)
def _day(y: int, mo: int, d: int) -> int | None:
    try:
        return date(y, mo, d).toordinal() - 719163
    except ValueError:
        return None


def read_time(notation: str, raw: str, received: datetime | None, day_first: bool = True) -> int | None:
    """Seconds since 1970 in UTC; None where raw is no valid time. A missing year is the last that doesn't put it after received."""
    m = TIMES[notation].match(raw)
    if not m:
        return None
    g = m.groupdict()
    if "e" in g:
        return int(g["e"])
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if ap := g.get("ap"):
        h = h % 12 + (12 if ap in "Pp" else 0)
    if h > 23 or mi > 59 or s > 60:
        return None
    if "a" in g:
        d, mo = (int(g["a"]), int(g["b"])) if day_first else (int(g["b"]), int(g["a"]))
    else:
        d = int(g["d"])
        mo = MONTHS.index(g["mon"]) + 1 if "mon" in g else int(g["mo"])
    clock = 3600 * h + 60 * mi + s
    z = g.get("z")
    if z and z[0] in "+-":
        clock -= (1 if z[0] == "+" else -1) * (3600 * int(z[1:3]) + 60 * int(z[-2:]))
    y = g.get("y") or g.get("y2")
    if y:
        day = _day(int(y), mo, d)
        return None if day is None else 86400 * day + clock
    if received is None:
        return None
    for year in range(received.year, received.year - 8, -1):
        if (month_day := (mo, d, h, mi, s)) > (received.month, received.day, received.hour, received.minute, received.second) and year == received.year:
            continue
        if (day := _day(year, *month_day[:2])) is not None:
            return 86400 * day + clock
    return None


@lru_cache(100_000)
def day_text(day: int) -> str:
    return date.fromordinal(day + 719163).isoformat() if -719162 <= day <= 2932896 else ""


def time_text(seconds: int | None) -> str | None:
    if seconds is None:
        return None
    day, s = divmod(seconds, 86400)
    d = day_text(day)
    return f"{d}T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" if d else None


@lru_cache(10_000)
def level_name(raw: str) -> str:
    """The severity class of a level's name, initial or number (P before a syslog priority); empty where it is none."""
    up = raw.strip(' "\'\t,').upper()
    n = up[1:] if up.startswith("P") and up[1:].isdigit() else up
    if n.isdigit() and len(n) <= 3:
        k = int(n)
        if n is not up:
            k %= 8
        if n is not up or k < 8:
            return ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"][k]
        return "FATAL" if k >= 60 else "ERROR" if k >= 50 else "WARN" if k >= 40 else "INFO" if k >= 30 else "DEBUG"
    return LEVEL_OF.get(up.rstrip("0123456789"), "")


# --- slots


class Plan(NamedTuple):
    """Where a template's fields are: token ranges, or -1. kind: open (a brace alone), keys (named fields) or line."""

    kind: str
    notation: str = ""
    day_first: bool = True
    time: tuple[int, int] = (-1, -1)
    level: tuple[int, int] = (-1, -1)
    level_form: str = ""
    component: tuple[int, int] = (-1, -1)
    message: tuple[int, int] = (-1, -1)
    #: Masks of the head up to its message, slots for words alike.
    head: tuple[str, ...] = ()


class Line(NamedTuple):
    n: int
    tokens: list[str]
    masks: list[str]


def _is_key(m: str) -> bool:
    return len(m) > 2 and m[0] == '"' and m[-1] == ":" or len(m) > 1 and m[-1] == "="


def _same(m: str) -> str:
    return "w" if m.strip() in ("a", "A", "x", "L") else m.strip() if m.strip() in (":", "|", "9") else m


def _word(m: str) -> bool:
    return m.strip() in ("a", "A", "x", "L")


def places(masks: list[str]) -> tuple[str, list[int]]:
    """(kind, positions): what the masks alone say of where a line's time may begin; kind is empty for a line that can't begin an entry.

    What stands before the time may be numbers, levels, names with digits or in capitals and punctuation, but no prose."""
    if not masks or masks[0] == " ":
        return "", []
    first = masks[0].strip()
    if first == "{":
        if len(masks) == 1:
            return "open", []
        return ("keys" if _is_key(masks[1]) and masks[1][0] == '"' else "", [])
    if first[-1] == "=" and len(first) > 1:
        return ("keys" if any(m[:-1] in TIME_KEYS for m in masks if m[-1] == "=") else "", [])
    if first in (">", "#", "*", "+", "-", ",", ";", ":", "|", "."):
        return "", []
    plain, found = 0, []
    for k, m in enumerate(masks):
        kind = m.strip()
        if kind[0] in "9xMD" and (plain == 0 or plain < 3 and masks[k - 1].strip() in ("[", "(")):
            found.append(k)
        if kind == "a" and k == 0 and (len(masks) < 2 or masks[1].strip() not in ("[", "-")):
            break
        if kind == "a":
            plain += 1
            if plain > 2:
                break
        elif kind[0] not in "9xLDMAP[](){}<>|,;:-/" and kind != "_":
            break
    return ("line" if found else "", found)


def time_at(line: str, tokens: list[str], kind: str, found: list[int]) -> tuple[str, str, int, int] | None:
    """(kind, notation, from, to): where a line that begins an entry has its time, at one of the places found; None where it has none."""
    if kind != "line":
        return (kind, "", -1, -1) if kind else None
    epoch, start, at = None, 0, 0
    for k in found:
        while at < k:
            start += len(tokens[at])
            at += 1
        for notation, pattern in TIMES.items():
            hit = pattern.match(line, start)
            if not hit:
                continue
            stop, end, to = hit.end(), start, k
            while end < stop:
                end += len(tokens[to])
                to += 1
            if line[stop:end].strip():
                continue
            if notation == "epoch":
                epoch = epoch or (k, to)
                continue
            return "line", notation, k, to
    if epoch and epoch[0] <= 1:
        return "line", "epoch", *epoch
    return None


def locate(tokens: list[str], masks: list[str]) -> tuple[str, str, int, int] | None:
    """Where a line has its time; None for a line that can't begin an entry."""
    return time_at("".join(tokens), tokens, *places(masks))


def _spans(masks: list[str]) -> list[tuple[str, int, int]]:
    """(name, from, to) of the values of the outer named fields."""
    depth, spans = 0, []
    braces = masks[0].strip() == "{"
    outer = 1 if braces else 0
    k = 0
    while k < len(masks):
        m = masks[k].strip()
        if m in ("{", "["):
            depth += 1
        elif m in ("}", "]"):
            depth -= 1
        elif _is_key(m) and depth == outer and (m[0] == '"') == braces:
            name, j, d = m.strip('":='), k + 1, 0
            while j < len(masks):
                x = masks[j].strip()
                d += (x in ("{", "[")) - (x in ("}", "]"))
                if d < 0 and braces or d == 0 and (x == "," if braces else _is_key(x)):
                    break
                j += 1
            spans.append((name, k + 1, j))
            k = j
            continue
        k += 1
    return spans


def _pick(spans: list[tuple[str, int, int]], names: list[str], fits=None) -> tuple[int, int]:
    known = sorted((names.index(n), i, j) for n, i, j in spans if n in names)
    if known:
        return known[0][1:]
    return next(((i, j) for n, i, j in spans if fits and n not in SAY_KEYS and fits(i)), (-1, -1))


def _keyed(heads: list[Head]) -> Plan:
    """The plan of named fields: roles by the keys, which are constants of the template, and by the values of their slots."""
    masks = heads[0].masks
    braces, spans, slot = masks[0].strip() == "{", _spans(masks), _slots(heads)

    def notation(i: int) -> str:
        votes = {v[1:]: w[0] for v, w in slot(i).items() if v[0] == "@"}
        return max(votes, key=lambda f: (votes[f], f), default="")

    def levels(i: int) -> bool:
        seen = slot(i)
        return 2 * sum(w[0] for v, w in seen.items() if v == "!") > sum(w[0] for v, w in seen.items() if v[0] == "@")

    time = _pick(spans, TIME_KEYS, lambda i: notation(i) not in ("", "epoch"))
    level, component, say = _pick(spans, LEVEL_KEYS, levels), _pick(spans, NAME_KEYS), _pick(spans, SAY_KEYS)
    last = max((j for i, j in (time, level, component)), default=0)
    keys = tuple(_same(m) for m in masks) if braces else tuple(_same(m) for m in masks[:last])
    return Plan("keys", notation(time[0]) if time[0] >= 0 else "", True, time, level, "", component, say, keys)


def _close(masks: list[str], k: int) -> int:
    """The position of the bracket that closes the one at k, or -1."""
    want = {"[": "]", "(": ")", "<": ">", "{": "}"}[masks[k].strip()]
    depth = 0
    for j in range(k, len(masks)):
        x = masks[j].strip()
        depth += (x == masks[k].strip()) - (x == want)
        if depth == 0:
            return j
    return -1


def _walk(masks: list[str], i: int, j: int) -> tuple[list[int], list[int], int]:
    """(slots, names, to): the words whose values _positional may ask for, those that may be a name by their repetition,
    and where the part of the line ends on which it depends. By the masks alone, so it goes as far as _positional could
    whatever the values: a place where that would stop is passed once, as its word may turn out to be the level."""
    n = len(masks)
    bare = lambda k: masks[k].strip() if 0 <= k < n else ""
    glued = lambda k: 0 <= k < n and masks[k][-1:] != " "
    slots, names, words = [k for k in range(i) if _word(masks[k])], [], 0
    k = j
    while bare(k) in ("]", ")", ">", ":", ","):
        k += 1
    if bare(0) == "<" and bare(1) == "9" and bare(2) == ">" and bare(3) == "9" and i == 4:
        k = min(n, k + 4)
        if bare(k) == "-":
            k += 1
        while bare(k) == "[" and _close(masks, k) > 0:
            k = _close(masks, k) + 1
    else:
        stops = prose = 0
        while k < n and stops < 2:
            m = bare(k)
            if m in ("[", "(", "{"):
                c = _close(masks, k)
                if c < 0:
                    break
                inner = [q for q in range(k + 1, c) if _word(masks[q])]
                slots += inner[:2]
                names += inner if len(inner) == 1 else []
                k = c
            elif m == "|":
                stops += 0.5 if words else 0
            elif m == "-":
                stops += 1 if words and not glued(k) else 0
            elif _word(masks[k]):
                slots.append(k)
                names += [k] if words < 2 else []
                words += 1
                prose = prose + 1 if m == "a" else 0
                stops += prose >= 2 or bare(k + 1) == ":" and glued(k) and (not glued(k + 1) or k + 2 == n)
            elif m not in (":", ",", "M", "D") and m[:1] != "9":
                break
            k += 1
    to = min(n, k + 6)
    return sorted({*slots, *(q for q in range(k, to) if _word(masks[q]))}), sorted(set(names)), to


_BLANKS = re.compile(r"\s+")


class Values(dict):
    """The values of words as they are counted, by token: those with digits only by what is asked of them."""

    def __missing__(self, token: str) -> str:
        v = token.strip()
        if mask(v) == "x":
            if level_name(v):
                v = _DIGITS.sub("9", v)
            else:
                x = "X" if v == v.upper() else "x"
                v = ("" if v[0].isalpha() or v[0] == "_" else "9") + x + ("_" + x if _dotted(v) else "")
        if len(token) < 40:
            if len(self) > 200_000:
                self.clear()
            self[token] = v
        return v


def _dotted(v: str) -> bool:
    return "." in v[1:-1] or "::" in v or "_" in v


#: Different messages from which on the repetition of a word says whether it is a name.
MESSAGES = 8


class Head:
    """Lines of one shape with their time at one place, in counts that add up: what their slots before the message hold.

    words: by slot and value the lines, the rest of one of them without its numbers as a hash, and whether another rest
    occurs; for a named field @ and its notation of time, and ! where it holds a level. said: hashes of different
    messages, numbers aside, until there are MESSAGES. late: 1 if a day's first number is over 12, 2 if its second is,
    between slashes."""

    __slots__ = ("at", "masks", "tokens", "line", "n", "late", "said", "words", "slots", "named", "to", "_all", "_read")

    def __init__(self, at: tuple[str, str, int, int], masks: list[str]):
        self.at, self.masks, self.tokens, self.line, self.n, self.late, self.said, self.words = at, masks, [], None, 0, 0, set(), {}
        kind, notation, i, j = at
        self.slots, self.named, self.to, self._all, self._read = [], [], len(masks), None, []
        if kind == "line":
            self.slots, names, self.to = _walk(masks, i, j)
            self._all = _reader(masks, j) if names else None
            self._read = [(k, _reader(masks, k + 1)) for k in names]
            self.slots = [k for k in self.slots if k not in names]
        elif kind == "keys":
            spans = _spans(masks)
            time = _pick(spans, TIME_KEYS)
            every = [(x, y) for name, x, y in spans if name not in SAY_KEYS]
            self.named = sorted({*([time] if time[0] >= 0 else every), *([] if _pick(spans, LEVEL_KEYS)[0] >= 0 else every)})
        elif kind == "open":
            self.to = 1

    def add(self, line: str, tokens: list[str], values: Values) -> None:
        self.n += 1
        if self.line is None or line < self.line:
            self.line, self.tokens = line, tokens
        words = self.words
        for k in self.slots:
            at = k, values[tokens[k]]
            w = words.get(at)
            if w is None:
                words[at] = [1, None, False]
            else:
                w[0] += 1
        for k, read in self._read:
            at = k, values[tokens[k]]
            w = words.get(at)
            if w is None:
                words[at] = [1, _rest(read, tokens), False]
            else:
                w[0] += 1
                if not w[2] and w[1] != _rest(read, tokens):
                    w[2] = True
        if self._read and len(self.said) < MESSAGES:
            self.said.add(_rest(self._all, tokens))
        for i, j in self.named:
            v = "".join(tokens[i:j]).strip().strip('"')
            for x in ("@" + next((f for f, p in TIMES.items() if p.match(v)), ""), *(["!"] if len(v) > 1 and not v.isdigit() and level_name(v) else [])):
                w = words.get((i, x))
                if w is None:
                    words[i, x] = [1, None, False]
                else:
                    w[0] += 1
        if self.at[1] == "day" and self.late != 3:
            b = TIMES["day"].match("".join(tokens[self.at[2] : self.at[3]]))
            if b:
                self.late |= (int(b["a"]) > 12) | (int(b["b"]) > 12 and b[2] == "/") << 1


def _reader(masks: list[str], k: int) -> tuple:
    """What _rest needs of lines with these masks from a position on: their words, and the rest with all numbers alike."""
    words = [q for q in range(k, len(masks)) if masks[q].strip() in ("a", "A")]
    return itemgetter(*words) if words else None, "".join("#" if m[0] in "9x" else "w" if m[0] in "aA" else m.strip() for m in masks[k:])


def _rest(read: tuple, tokens: list[str]) -> int:
    """The rest of a line, whatever its numbers and blanks, as a hash; the same in all tasks, which share a seed."""
    words, others = read
    text = others + _BLANKS.sub("", "".join(words(tokens))) if words else others
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _slots(heads: list[Head]):
    """A function that gives the words of a slot over all heads."""
    by: dict[int, dict[str, list]] = {}
    for h in heads:
        for (k, v), (n, rest, several) in h.words.items():
            of = by.setdefault(k, {})
            w = of.get(v)
            if w is None:
                of[v] = [n, rest, several]
            else:
                w[0] += n
                w[2] = w[2] or several or rest is not None and w[1] is not None and rest != w[1]
                w[1] = rest if w[1] is None else w[1]
    return lambda k: by.get(k, {})


def _positional(heads: list[Head], notation: str, i: int, j: int) -> Plan:
    """The plan of a line with a time at i..j: the tokens around it are walked until the message; which word is level or
    component is decided by the values that its slot takes in all lines of the template."""
    lead = heads[0]
    masks, n = lead.masks, len(lead.masks)
    bare = lambda k: masks[k].strip() if 0 <= k < n else ""
    glued = lambda k: 0 <= k < n and masks[k][-1:] != " "
    slot = _slots(heads)
    said = set().union(*(h.said for h in heads))
    count = lambda seen, fits: sum(w[0] for v, w in seen.items() if fits(v))

    def is_level(k: int) -> bool:
        seen = slot(k)
        total = count(seen, lambda v: True)
        long = count(seen, lambda v: len(v) > 1 and level_name(v) != "")
        short = count(seen, lambda v: len(v) == 1 and level_name(v) != "")
        return total > 0 and (2 * long > total or short > 0.9 * total and not glued(k - 1))

    def names(k: int, alone: bool) -> bool:
        """Most values of the slot come with several messages, numbers aside, or its lines have dotted ones; with few
        messages, alone stands for that. However often a line is repeated, the answer is the same."""
        seen = slot(k)
        if not seen or any(not (v[:1].isalpha() or v[:1] == "_") for v in seen):
            return False
        if 2 * count(seen, _dotted) > count(seen, lambda v: True):
            return True
        return 2 * sum(w[2] for w in seen.values()) >= len(seen) if len(said) >= MESSAGES else alone

    level, form, component = -1, "", -1
    if bare(0) == "<" and bare(1) == "9" and bare(2) == ">":
        level, form = 1, "P"
    elif notation == "letter":
        level, form = i, "1"
    else:
        level = next((k for k in range(i) if _word(masks[k]) and is_level(k)), -1)
    k = end = j
    while bare(k) in ("]", ")", ">", ":", ",") and k < n:
        k = end = k + 1
    seen_words: list[int] = []
    in_brackets: list[int] = []
    if form == "P" and bare(3) == "9" and i == 4:  # the versioned syslog header: host, name, process and message id
        component = k + 1 if bare(k + 1) != "-" else -1
        end = min(n, k + 4)
        if bare(end) == "-":
            end += 1
        while bare(end) == "[" and _close(masks, end) > 0:
            end = _close(masks, end) + 1
    else:
        piped, prose = False, 0
        while k < n:
            m = bare(k)
            if m in ("[", "(", "{"):
                c = _close(masks, k)
                if c < 0:
                    break
                inner = [q for q in range(k + 1, c) if _word(masks[q])]
                if len(inner) == 2 and c == k + 4 and bare(k + 2) == ":" and is_level(inner[1]):
                    component, level = (inner[0], inner[1]) if component < 0 else (component, inner[1])
                elif len(inner) == 1 and c == k + 4 and bare(k + 2) == ":" and bare(k + 3) == "9":
                    in_brackets.append(inner[0])
                elif len(inner) == 1 and c == k + 2:
                    if is_level(inner[0]) and level < 0:
                        level = inner[0]
                    elif bare(inner[0]) != "x":
                        in_brackets.append(inner[0])
                elif not (inner and lead.tokens[inner[0]].strip().lower() in ("pid", "tid", "thread", "client")) and len(inner) > 1:
                    break
                k = end = c + 1
                if bare(k) == ":":
                    k = end = k + 1
                if component >= 0 and not (bare(k) == "[" and lead.tokens[min(n - 1, k + 1)].strip().lower() in ("pid", "tid", "thread", "client")):
                    break
                continue
            if m == "|":
                piped, k = True, k + 1
                end = k
                continue
            if m == "-":
                if seen_words and component < 0 and not glued(k):
                    component = seen_words[-1]
                    end = k + 1
                    break
                k = end = k + 1
                continue
            if m in (":", ","):
                k += 1
                continue
            if m[:1] == "9" or m in ("M", "D"):
                k += 1
                continue
            if not _word(masks[k]):
                break
            if level < 0 and is_level(k):
                level = k
                k = end = k + 1
                if seen_words and not piped and bare(seen_words[-1]) != "x":
                    component = seen_words[-1]
                    break
                continue
            if piped:
                if bare(k + 1) == "|":
                    component, end = k, k + 2
                    break
                break
            after = bare(k + 1)
            if after == ":" and glued(k) and (not glued(k + 1) or k + 2 == n or bare(k + 2) == "9" and bare(k + 3) in ("]", ":")):
                component, end = k, k + 2
                if bare(k + 2) == "9" and glued(k + 1) and bare(k + 3) in ("]", ":"):
                    end = k + 4
                break
            if after in ("[", "(") and glued(k) and (c := _close(masks, k + 1)) == k + 3 and bare(k + 2) in ("9", "x"):
                component, end = k, c + 1
                if bare(end) == ":":
                    end += 1
                break
            prose = prose + 1 if bare(k) == "a" else 0
            seen_words.append(k)
            if prose >= 2:
                break
            k += 1
        if component >= 0 and level < 0 and end < n and _word(masks[end]) and is_level(end) and 2 * count(slot(end), lambda v: v == v.upper()) > count(slot(end), lambda v: True):
            level, end = end, end + 1
            if bare(end) == ":":
                end += 1
        if component < 0 and not piped:
            ahead = [q for q in in_brackets if names(q, True) and lead.tokens[q].strip().lower() not in ("main", "thread")]
            # With a level beside it, or a dotted name, a word alone is a component.
            close = [q for q in seen_words[:1] if bare(q) != "x" and names(q, level >= 0)]
            component = next(iter(ahead or close), -1)
            end = max(end, component + 1 + (bare(component + 1) in ("]", ")"))) if component >= 0 else end
    span = lambda k: (k, k + 1) if k >= 0 else (-1, -1)
    day_first = True
    if notation == "day":
        late = [h.late for h in heads]
        day_first = any(x & 1 for x in late) or not any(x & 2 for x in late)
    reach = max(end, j, level + 1, component + 1)
    # The token after a name closes the head.
    return Plan("line", notation, day_first, (i, j), span(level), form, span(component), (min(reach, n), n), tuple(_same(m) for m in masks[:reach]))


def fits(plan: Plan, masks: list[str]) -> bool:
    """Whether a line with these masks has the plan's head."""
    head = plan.head
    return len(masks) >= len(head) and all(_same(m) == h for m, h in zip(masks, head))


def heads_of(lines: list[Line]) -> list[Head]:
    """The heads of the lines that can begin an entry."""
    found: dict = {}
    values = Values()
    for x in lines:
        if at := locate(x.tokens, x.masks):
            key = (at, *x.masks)
            h = found.get(key) or found.setdefault(key, Head(at, x.masks))
            h.add("".join(x.tokens), x.tokens, values)
            h.n += x.n - 1
    return list(found.values())


def slot_plans(lines: list[Line]) -> list[Plan]:
    """What the slots of a template hold, by its lines. Lines that can't begin an entry give none."""
    return head_plans(heads_of(lines))


def head_plans(heads: list[Head]) -> list[Plan]:
    """What the slots of a template hold, by its heads: one plan per head that differs, the most frequent first."""
    left = sorted(heads, key=lambda h: (-h.n, h.masks, h.tokens))
    out: list[Plan] = []
    while left:
        votes: Counter = Counter()
        for h in left:
            votes[h.at] += h.n
        best = max(votes, key=lambda a: (votes[a], a))
        own = [h for h in left if h.at == best]
        kind, notation, i, j = best
        if kind == "open":
            plan = Plan("open", head=("{",))
        else:
            plan = _keyed(own) if kind == "keys" else _positional(own, notation, i, j)
            # Values of lines with another head say nothing on this one's slots.
            same = [h for h in own if fits(plan, h.masks)]
            if 0 < len(same) < len(own):
                plan = _keyed(same) if kind == "keys" else _positional(same, notation, i, j)
        out.append(plan)
        lead = own[0]
        left = [h for h in left if h is not lead and not (h.at == best and fits(plan, h.masks))]
    return out


def plan_of(plans: list[Plan], masks: list[str], at: tuple[str, str, int, int]) -> Plan | None:
    """The first plan for a shape's head, of those with its time at the same place in the same notation."""
    kind, notation, i, j = at
    return next((p for p in plans if p.kind == kind and (kind != "line" or p.notation == notation and p.time == (i, j)) and fits(p, masks)), None)

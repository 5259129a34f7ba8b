"""Personal data: base patterns, and a semi-Markov conditional random field for forms that they miss.

The field scores whole segments of up to MOST tokens as email, ip, card or phone (groups, digits, signs, word before,
checksum) and chooses boundaries and types together by dynamic programming.  Its weights are fitted here by the gradient
of the conditional likelihood on generated sentences with a fixed seed.  It runs round every run of digits and every
sign for "at" that could hold an entity (seven digits, four groups, or a sign, a label and a dot); elsewhere no segment
passes the exact checks (Luhn, octets, number of digits) that candidates must pass.  Base spans always stay: they are
fixed segments of the path, and are never overlapped by added ones.

Results by case: null and empty texts have no spans; texts are scanned whole, in time linear in their length; equal texts,
so repeated rows, give equal spans; of equal segmentations the first by segment wins; an empty table gives no rows; columns
beside the keys and text are not read, and a key named spans is replaced by the spans.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The longest entity: a card of 19 digits with a sign between each two has 37 tokens.
MOST = 37
KINDS = ("email", "ip", "card", "phone")
#: The base shapes.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where its digits begin: a later start in one run fails like the first, and is not tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
AT, DOT = frozenset(("@", "at", "arobase", "arroba")), frozenset((".", "dot", "point", "punkt", "punto"))
OPEN, CLOSE, JOINS = frozenset("([{<"), frozenset(")]}>"), frozenset("()[]{}<>._-+%")
#: Signs inside a number.
SIGNS = frozenset("+().,/_-–:*|·[]")
#: Blanks are taken whole, so a long run of them is passed once.
_DOT = r"\s*+(?:[\[({<]\s*+)?(?:\.|(?:dot|point|punkt|punto)\b)"
RUN = re.compile(r"[+(]?[+]?[0-9](?:[\s().,/_:*|·–\-]*+[0-9]){6,}|(?<![0-9])[0-9]{1,3}(?:" + _DOT + r"\s*+(?:[\])}>]\s*+)?[0-9]{1,3}){3}(?![0-9])|(?:@|\b(?:at|arobase|arroba)\b|[\[({<]\s*+a(?=\s*+[\])}>]))\s*+(?:[\])}>]\s*+)?\w[\w-]*+" + _DOT, re.I)
CUES = {w: k for k, ws in {"phone": "tel tél telephone téléphone phone call mobile port portable fax ring appelez", "card": "card carte visa mastercard cb karte tarjeta", "ip": "ip host server address adresse", "email": "mail email courriel e-mail contact write"}.items() for w in ws.split()}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping per kind; by start, then kind."""
    text, out = text or "", []
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        m = EMAIL_TAIL.match(text, at) if first < at else None
        if m:
            out.append((first, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for n, shape in ((2, CARD), (3, PHONE)) if "+" in text else ((2, CARD),):
            for m in shape.finditer(text):
                d = "".join(DIGIT.findall(m.group()))
                if 14 <= len(d) <= 19 and luhn(d) if n == 2 else 10 <= len(d) <= 15:
                    out.append((m.start(), n, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


class Window:
    """Tokens of a stretch of text, each with a letter for its part: D digits, W word, A at, P dot, S sign."""

    def __init__(self, text: str, low: int = 0, high: int | None = None):
        self.text = text
        found = list(TOKEN.finditer(text, low, len(text) if high is None else high))
        self.words = [m.group() for m in found]
        self.first, self.end = [m.start() for m in found], [m.end() for m in found]
        self.parts = []
        for i, w in enumerate(self.words):
            lone = w.lower()
            wrapped = 0 < i < len(self.words) - 1 and self.words[i - 1] in OPEN and self.words[i + 1] in CLOSE
            self.parts.append("D" if w[0].isdigit() else "A" if lone in AT or lone == "a" and wrapped else "P" if lone in DOT else "W" if w.isalpha() else "S")

    def glued(self, i: int, j: int) -> bool:
        """Whether a letter or digit touches the segment."""
        s, e = self.first[i], self.end[j - 1]
        return s > 0 and self.text[s - 1].isalnum() or e < len(self.text) and self.text[e].isalnum()


def candidates(w: Window):
    """For each token in turn, (first, end, kind, features) of the segments from there that pass their kind's exact check."""
    n = len(w.words)
    cue = [CUES.get(x.lower(), "") for x in w.words]
    for i in range(n):
        out = []
        before = next((cue[k] for k in range(i - 1, max(-1, i - 4), -1) if cue[k]), "")
        # Numbers: digits and signs alone; four groups with dots between may be an address.
        if w.parts[i] == "D" or w.words[i] in "+(":
            groups, signs = [], []
            for j in range(i, min(n, i + MOST)):
                x, part = w.words[j], w.parts[j]
                if part == "D":
                    groups.append(x)
                elif part == "P" or x in SIGNS:
                    signs.append(x.lower())
                    continue
                else:
                    break
                d = "".join(groups)
                if len(d) > 19:
                    break
                if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups) and w.parts[i] == "D" and sum(g in DOT for g in signs) == 3 and not set(signs) - DOT - set("()[]") and not w.glued(i, j + 1):
                    out.append((i, j + 1, "ip", number(w, i, j + 1, "ip", groups, signs, before)))
                if set(signs) - SIGNS or w.glued(i, j + 1):
                    continue
                if 7 <= len(d) <= 15:
                    out.append((i, j + 1, "phone", number(w, i, j + 1, "phone", groups, signs, before)))
                if 13 <= len(d) <= 19 and w.parts[i] == "D" and luhn(d):
                    out.append((i, j + 1, "card", number(w, i, j + 1, "card", groups, signs, before)))
        # Addresses: words joined by signs, one sign for "at", a dot after it.
        if w.parts[i] in "WD":
            at = dot = -1
            for j in range(i + 1, min(n, i + MOST)):
                part, last = w.parts[j], w.parts[j - 1]
                if part == "A":
                    if at >= 0:
                        break
                    at = j
                elif part == "P":
                    dot = j
                elif part == "S" and w.words[j] not in JOINS or part in "WD" and last in "WD" and w.first[j] != w.end[j - 1]:
                    break
                elif at < 0 and part == "S" and w.words[j] not in OPEN and w.first[j] != w.end[j - 1]:
                    break
                elif part in "WD" and dot > at >= 0 and not w.glued(i, j + 1):
                    out.append((i, j + 1, "email", address(w, i, j + 1, at, before)))
        yield out


def number(w: Window, i: int, j: int, kind: str, groups: list[str], signs: list[str], cue: str) -> tuple:
    lens = [len(g) for g in groups]
    plus, n = "+" in signs, sum(lens)
    kept = "".join(sorted(set(signs)))
    lead = "+" if plus else "0" if groups[0][0] == "0" else "(" if w.words[i] == "(" else "9"
    shape = "-".join(map(str, lens)) if len(lens) < 8 else "many"
    wide = w.text[w.first[i] : w.end[j - 1]]
    lines = "\n" in wide
    near = w.words[i - 1] if i and w.first[i] - w.end[i - 1] == 0 else ""
    after = w.words[j] if j < len(w.words) and w.first[j] == w.end[j - 1] and not (w.words[j] in ".,;:!?)" and (j + 1 == len(w.words) or w.first[j + 1] > w.end[j])) else ""
    more = [w.parts[k] == "D" for k in (i - 1, j) if 0 <= k < len(w.words)]
    dates = len(lens) >= 3 and bool(re.match(r"(?:19|20)[0-9]{2}$", groups[0]) and lens[1:3] == [2, 2])
    return named(kind, lead, n, shape, kept, max(lens), min(lens), cue, lines, near, after, min(len(lens), 9), any(more), dates)


@lru_cache(maxsize=50_000)
def named(kind, lead, n, shape, kept, most, least, cue, lines, near, after, groups, beside, dates) -> tuple:
    return tuple(f"{kind}|{x}" for x in ("", f"lead {lead} n{n}", f"n{n}", f"shape {shape}", f"lead {lead} shape {shape}", f"signs {kept}", f"max{most} min{least}", f"cue {cue}", f"lines {lines}", f"near {near}", f"after {after}", f"groups {groups}", f"beside {beside}", f"dates {dates}"))


def address(w: Window, i: int, j: int, at: int, cue: str) -> tuple:
    form = lambda k: w.words[k].lower() + ("()" if w.words[k - 1] in OPEN else "")
    dots = [k for k in range(at + 1, j) if w.parts[k] == "P"]
    loose = [k for k in dots if w.words[k] == "." and w.first[k + 1] > w.end[k]]
    early = [k for k in dots if w.words[k] == "." and w.first[k] > w.end[k - 1]]
    last = w.words[j - 1]
    top = "long" if len(last) > 6 else f"{len(last)}{'a' if last.islower() else 'A' if last.isupper() else 'Aa'}"
    open_ends = sum(x in OPEN for x in w.words[i:j]) != sum(x in CLOSE for x in w.words[i:j])
    kinds = {"." if w.words[k] == "." else form(k).strip(w.words[k].lower()) or "word" for k in dots}
    sign = "@" if w.words[at] == "@" else "()" if w.words[at - 1] in OPEN else "word"
    cut = i > 0 and w.first[i] == w.end[i - 1] and w.words[i - 1] in "._%+-"
    further = j + 1 < len(w.words) and (w.parts[j] == "P" and (w.words[j] != "." or w.first[j + 1] == w.end[j]) or w.words[j] in OPEN and w.parts[j + 1] == "P")
    dashed = j < len(w.words) and w.words[j] == "-" and w.first[j] == w.end[j - 1]
    return tuple(f"email|{x}" for x in ("", f"at {sign}", f"{sign} {sorted(kinds)}", f"{sign} loose {bool(loose)} {bool(early)}", f"top {top}", f"loose {bool(loose)} top {top}", f"open {open_ends}", f"cut {cut}", f"further {further} {dashed}", f"cue {cue}", f"start {w.parts[i]}"))


def segments(w: Window, weights: dict) -> dict:
    """(first, end, kind) -> (score, features); "other" is one token with score 0."""
    out = {(i, i + 1, ""): (0.0, ()) for i in range(len(w.words))}
    for found in candidates(w):
        for i, j, k, f in found:
            out[i, j, k] = sum(weights.get(x, 0.0) for x in f) - 2.0, f
    return out


def best(w: Window, weights: dict, base: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """The segments of the best path that passes through every base span.

    Token by token, with only the path so far in memory; of equal paths the first by segment wins."""
    memo: dict = {}
    value, back = [0.0] + [-np.inf] * len(w.words), [None] * (len(w.words) + 1)
    fixed = sorted(base)
    ends = [b for _, b, _ in fixed]
    for i, found in enumerate(candidates(w)):
        here = [(i + 1, "", 0.0)]
        for _, j, k, f in found:
            near = bisect.bisect_right(ends, w.first[i])
            if near < len(fixed) and fixed[near][0] < w.end[j - 1]:
                continue
            if f not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[f] = sum(weights.get(x, 0.0) for x in f) - 2.0
            here.append((j, k, memo[f]))
        for j, k, s in sorted(here):
            if value[i] + s > value[j]:
                value[j], back[j] = value[i] + s, (i, j, k)
    out, at = [], len(w.words)
    while at:
        out.append(back[at])
        at = back[at][0]
    return [x for x in reversed(out) if x[2]]


def sentences(rng):
    """Pieces of text, each with its kind, "" for what only looks like personal data."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 8))))
    pick = lambda x: x[int(rng.integers(len(x)))]
    octet = lambda: str(rng.integers(0, 256))

    def card():
        d = pick("3456") + num(pick((14, 14, 14, 13, 15, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick((" ", "-", ".", "/", "\n", "_", " - ", "*"))
        cuts = pick(((4, 4, 4, 4, 4), (4, 6, 5, 4), (1,) * 19, (5, 5, 5, 5), (8, 8, 8)))
        out, at = [], 0
        for c in cuts:
            out.append(d[at : at + c])
            at += c
        return sep.join(x for x in out if x)

    def phone(n):
        s = pick((" ", ".", "-", "\n", "/", "_"))
        two = lambda k: s.join(num(2) for _ in range(k))
        return [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: s.join((pick("23456789") + num(2), num(3), num(4))), lambda: "0" + pick("123456789") + s + two(4), lambda: f"0{pick('1234567')}{num(8)}", lambda: f"0{pick('67')}{s}{num(3)}{s}{num(3)}{s}{num(2)}", lambda: f"+{num(2)}{s}{num(1)}{s}" + two(4), lambda: pick("56789") + num(2) + pick(" -") + num(6), lambda: f"+{num(2)} (0) {num(1)} " + two(4), lambda: f"00{pick('34')}{num(1)}{s}{num(1)}{s}" + two(4), lambda: f"0{num(3)}{pick(' /-')}{num(6)}", lambda: f"+{num(1)}{s}{num(3)}{s}{num(3)}{s}{num(4)}"][n]()

    def email(at, dot, loose):
        local = pick((word(), f"{word()}.{word()}", f"{word()}_{word()}", word() + num(2)))
        host = [word() for _ in range(pick((1, 1, 2)))] + [pick(("com", "fr", "org", "uk", "de", "net", "info"))]
        return local + at + (dot + pick(("", "\n" if loose else "")) if dot.strip() == "." else dot).join(host)

    case = lambda x: pick((x, x, x.capitalize(), x.upper()))
    while True:
        for n in range(11):
            yield phone(n), "phone"
        for _ in range(6):
            yield card(), "card"
        for d in (" . ", "[.]", " [dot] ", ".\n", " dot ", "(.)", ". "):
            yield d.join(octet() for _ in range(4)), "ip"
        for at in (f" {case('at')} ", f" [{case('at')}] ", f" ({case('at')}) ", f" ({case('arobase')}) ", " @ ", "@", f" {case('arobase')} ", " (a) ", f"[{case('at')}]", "@\n"):
            for dot in (f" {case('dot')} ", f" [{case('dot')}] ", f"({case('dot')})", f" {case('point')} ", f" ({case('point')}) ", ".") + ((" . ",) if "@" in at else ()):
                yield email(at, dot, "@" in at), "email"
        caps = lambda: word().capitalize()
        yield from ((x, "") for x in (
            f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"19{num(2)}-20{num(2)}", f"{num(2)}.{num(2)}.19{num(2)}", f"20{num(2)}{num(2)}{num(2)}",
            f"1,{num(3)},{num(3)}.{num(2)}", f"{num(1)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(3)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", pick("123456789") + num(7), pick("123456789") + num(8), pick("123456789") + num(9), pick("123456789") + num(12), num(16),
            ", ".join(num(2) for _ in range(5)), " ".join(num(1) for _ in range(9)), " ".join(num(3) for _ in range(4)), f"{num(2)}.{num(6)}, {num(1)}.{num(6)}", f"{num(1)}:{num(2)}:{num(2)} - {num(1)}:{num(2)}:{num(2)}", " ".join("20" + num(2) for _ in range(4)), f"0.{num(8)}", f"{num(4)}-{num(4)}", " ".join(num(2) for _ in range(6)), f"1, 2, 3, {num(4)}",
        ))
        for at in ("at", "at", "At"):
            yield from ((x, "") for x in (f"{word()} {at} {num(3)} {word()}.", f"{word()} {at} {word()}. {caps()}", f"{word()} {at} {word()}. {word()}", f"{word()} {at} {word()}.\n{caps()}", f"{word()} {at} {word()}.", f"{word()}. {at} {word()}. {word()}", f"{word()}.\n{at} {word()}.\n{word()}", f"{word()} {at} {word()} . {caps()}", f"{word()} {at} {word()}, {word()} dot {word()}", f"{word()} {at} {word()} {word()} point {word()}"))


@lru_cache(maxsize=1)
def fitted() -> dict:
    """Weights by stochastic gradient on generated sentences; expectations by the forward and backward sums."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5))
    cues = sorted(CUES)
    weights: dict = {}
    made = sentences(rng)
    for _ in range(4000):
        gold, kind = next(made)
        before, after = " ".join(word() for _ in range(3)), " ".join(word() for _ in range(3))
        if kind and rng.random() < 0.15:
            before += " " + str(rng.choice([c for c in cues if CUES[c] == kind])) + ("" if rng.random() < 0.5 else " :")
        text = f"{before} {gold}{rng.choice(['', '', ',', '.', ';'])} {after}"
        w, s = Window(text), len(before) + 1
        score = segments(w, weights)
        right = (w.first.index(s), w.end.index(s + len(gold)) + 1, kind) if kind else None
        n = len(w.words)
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        for (i, j, _), (s, _) in sorted(score.items()):
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + s)
        for (i, j, _), (s, _) in sorted(score.items(), reverse=True):
            back[i] = np.logaddexp(back[i], s + back[j])
        push: Counter = Counter()
        for x, (s, f) in score.items():
            if x[2]:
                g = (x == right) - float(np.exp(ahead[x[0]] + s + back[x[1]] - ahead[n]))
                if abs(g) > 1e-4:
                    for name in f:
                        push[name] += g
        for f, g in push.items():
            weights[f] = weights.get(f, 0.0) + 0.2 * g
    return weights


def added_spans(text: str, base: list[tuple[int, int, str]], weights: dict) -> list[tuple[int, int, str]]:
    ranges: list = []
    for run in RUN.finditer(text):
        if any(s <= run.start() and run.end() <= e for s, e, _ in base):
            continue
        low, high = run.start(), run.end()
        ahead = list(TOKEN.finditer(text, max(0, low - 256), low))[-MOST:]
        low = ahead[0].start() if ahead else low
        # The first token may be the rest of a word.
        while low > 0 and text[low].isalnum() and text[low - 1].isalnum():
            low -= 1
        tokens = TOKEN.finditer(text, high)
        for _, m in zip(range(MOST), tokens):
            high = m.end()
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    out = []
    for low, high in ranges:
        w = Window(text, low, high)
        near = [x for x in base if x[0] < high and low < x[1]]
        out += [(w.first[i], w.end[j - 1], k) for i, j, k in best(w, weights, near)]
    return out


def find_private(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys plus spans: array of kind, start, end, and whether a base pattern gave it."""
    held = df.sparkSession.sparkContext.broadcast(fitted())

    def setup():
        weights = held.value

        def spans(t):
            base = base_spans(t)
            rows = [(s, KINDS.index(k), e, True) for s, e, k in base] + [(s, KINDS.index(k), e, False) for s, e, k in (added_spans(t, base, weights) if t else [])]
            return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(rows)]

        return lambda texts: {"spans": [spans(t) for t in texts]}

    return map_texts(df, keys, "spans array<struct<kind:string,start:int,end:int,base:boolean>>", setup, text_col)


def digest(found: DataFrame) -> DataFrame:
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

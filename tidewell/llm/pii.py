"""Personal data by a semi-Markov conditional random field.

Base kinds (email, ip, card, phone) are found exactly, with code point spans. Around every token with a digit
or ``@``, or the word "dot", an island of tokens is cut; outside islands nothing can be an entity. On an island the model scores
whole segments of up to ``LONGEST`` tokens and ``CHARS`` characters (the longest address that mail allows) with features of the span
as such (digits, check sums, shape, what stands beside and before it); dynamic programming over bounded segments finds the best
joint choice of boundaries and types. Its entities that no base span touches are added: phone numbers in local form, cards in
other separators or inside longer runs, addresses written out ("name at host dot org"), IPv6, and two kinds the base lacks, iban and
ssn (a nine-digit id in groups of 3-2-4).

The weights are trained here, by the likelihood of labelled segmentations. Backgrounds are at most ``FIT_ISLANDS`` islands of the corpus,
those of the smallest hashes, with what the base rules find in them, and a few fixed sentences. ``examples`` puts entities made by
seeded rules into them, in varied separators and contexts, and look-alikes that are none (dates, versions, order numbers, times,
prices). Everything but this bounded sample reads whole texts.

Defined results: null text counts as empty; an empty table gives an empty result; repeated rows give equal rows; a
null ``doc_id`` is carried along; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import each, table

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4  # kinds of the contract
LONGEST = 15  # tokens of an entity
CHARS = 320
AROUND = 6  # tokens kept beside a trigger: a domain may end so far after the last digit
FIT_ISLANDS, FIT_TOKENS, EPOCHS, MADE = 800, 64, 6, 900
SEED = 40_961

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\x00-\x7F]+|[^\s]")
_TRIGGER = re.compile(r"[0-9@]|(?i:\bdot\b)")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and not overlapping within a kind."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:  # a local part is the run of its characters that ends at the sign
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _AT.match(text, at) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token spans near tokens with a digit or @."""
    out: list[list[tuple[int, int]]] = []
    if not _TRIGGER.search(text):
        return out
    reach, before = 0, []
    current: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        span = m.span()
        if _TRIGGER.search(m[0]):
            current += before
            current.append(span)
            before, reach = [], AROUND
        elif reach:
            current.append(span)
            reach -= 1
        else:
            before.append(span)
            if len(before) > AROUND:
                before.pop(0)
                if current:
                    out.append(current)
                    current = []
    if current:
        out.append(current)
    return out


_NUMBER_LIKE = re.compile(r"[0-9 ().+/-]+")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]?(?:at|@)[\])]? ?[A-Za-z0-9-]+(?: ?[\[(]?(?:dot|\.)[\])]? ?[A-Za-z0-9-]+)+", re.I)
_LOCAL_PHONE = re.compile(r"\([0-9]{2,5}\)[ -]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{1,4}[ /-][0-9]{3,4}[ -]?[0-9]{2,4}")
_CARD_GROUPS = re.compile(r"[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{14,19}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}")
_DATE = re.compile(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")
_V6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?:::)?")
# Words before an entity that speak of it, by kind, and words before numbers of other things.
SAID = [
    frozenset("email mail contact write reach".split()),
    frozenset("ip host server address addr".split()),
    frozenset("card visa mastercard amex credit debit paid".split()),
    frozenset("phone tel telephone call fax mobile cell ring dial".split()),
    frozenset("iban account bank transfer".split()),
    frozenset("ssn social security".split()),
    frozenset("order version build page chapter isbn issue ticket invoice no nr price total year since code serial part".split()),
]


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _v6_holds(s: str) -> bool:
    return s.count("::") <= 1 and ":::" not in s and (s.count(":") == 7 if "::" not in s else s.count(":") <= 7)


def _before(text: str, a: int) -> list[str]:
    """The last two words before the place, on the same stretch."""
    return re.findall(r"[a-z]+", text[max(0, a - 24) : a].lower())[-2:]


def features(text: str, a: int, b: int, tokens: int) -> tuple[int, ...]:
    """Numbers of the features that hold for the span."""
    s = text[a:b]
    d = _digits(s)
    n = len(d)
    on = [0, 1 + min(n, 20), 22 + min(tokens, LONGEST)]
    letters = any(c.isalpha() for c in s)
    spaced = " " in s or not s.isprintable()
    plain = _NUMBER_LIKE.fullmatch(s) is not None
    on.append(40 if letters else 41)
    on.append(42 if spaced else 43)
    if s.count("@") == 1:
        head, _, tail = s.partition("@")
        good = bool(head) and all(c in _LOCAL for c in head) and "." in tail.strip(".") and tail[-1:].isalnum() and all(c.isalnum() and c < "\x80" or c in ".-" for c in tail)
        on.append(44 if good else 45)
        if good and (a == 0 or text[a - 1] not in _LOCAL):
            on.append(46)
        if good and not (b < len(text) and (text[b] == "." and text[b + 1 : b + 2].isalnum() or text[b] == "-")):
            on.append(47)
    elif letters and _WRITTEN.fullmatch(s):
        on.append(48)
        if re.search(r"\W(?:dot|\.)\W*(?:com|org|net|edu|io|info|de|fr|es|example)$", s, re.I):
            on.append(49)
        if re.search(r"\bat\b.*\bat\b", s, re.I):
            on.append(50)
    parts = s.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        on.append(51 if all(int(p[:6]) <= 255 and len(p) <= 6 for p in parts) else 52)
    if ":" in s and _V6.fullmatch(s):
        on.append(53 if _v6_holds(s) and not _DATE.fullmatch(s) else 54)
    if 14 <= n <= 19 and plain and _CARD_GROUPS.fullmatch(s):
        on.append(55 if luhn(d) else 56)
    if s[0] == "+" and plain and s[-1].isdigit() and s[1:2].isdigit():
        on.append(57 if 10 <= n <= 15 else 58)
    if plain and 7 <= n <= 12 and _LOCAL_PHONE.fullmatch(s):
        on.append(59)
    if letters and n >= 2 and _IBAN.fullmatch(s):
        on.append(60 if iban_holds(s) else 61)
    if n == 9 and _SSN.fullmatch(s):
        on.append(62)
    if 3 <= n <= 8 and _DATE.fullmatch(s):
        on.append(63)
    on.append(64 if s[-1].isalnum() else 65)
    on.append(66 if s[0].isalnum() else 67)
    on.append(68 if a == 0 or text[a - 1].isspace() else 69)
    on.append(70 if b == len(text) or not text[b].isalnum() else 71)
    follow, lead = text[b : b + 2], text[max(0, a - 2) : a]
    if len(follow) == 2 and follow[0] in " -./" and follow[1].isdigit() and s[-1].isdigit():
        on.append(72)
    if len(lead) == 2 and lead[1] in "-./+:" and lead[0].isalnum():
        on.append(73)
    for k, words in enumerate(SAID):
        if not words.isdisjoint(_before(text, a)):
            on.append(74 + k)
    return tuple(on)


WIDTH = 74 + len(SAID)


def _segments(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, ...]]:
    out = {}
    for j in range(1, len(tokens) + 1):
        for i in range(max(0, j - LONGEST), j):
            a, b = tokens[i][0], tokens[j - 1][1]
            if b - a <= CHARS and (text[a].isalnum() or text[a] in "+(._%-") and text[b - 1].isalnum() and _TRIGGER.search(text, a, b):
                out[i, j] = features(text, a, b, j - i)
    return out


def decode(weights: np.ndarray, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities as (start, kind, end)."""
    n = len(tokens)
    best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
    by_end: dict[int, list] = {}
    for (i, j), on in _segments(text, tokens).items():
        s = weights[:, on].sum(axis=1)
        k = int(s.argmax())
        if s[k] > 0:  # leaving its tokens out scores 0
            by_end.setdefault(j, []).append((i, k, float(s[k])))
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], (j - 1, -1)
        for i, k, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j:
        i, k = back[j]
        if k >= 0:
            out.append((tokens[i][0], k, tokens[j - 1][1]))
        j = i
    return out[::-1]


# Sentences that stand for text around entities where the corpus has little.
SENTENCES = [
    "please send the papers to the office before noon",
    "we met them on 12 May and again in 2019 near the station",
    "the parcel has 3 items and weighs 14.5 kilos in all",
    "she is at home, and he looks at the red dot on the map",
    "der Brief kam am 3. Juni an und blieb 2 Tage liegen",
    "la réunion est prévue à 9 heures dans la salle 204",
    "el informe tiene 120 páginas y 7 anexos",
]
_NAMES = "anna ben carla dmitri eva farid greta hugo ines jan".split()
_HOSTS = "mail post example netz kontor campus lab firma".split()
_ENDS = "com org net de fr es io".split()
_BY_KIND = ("email", "mail me", "write"), ("host", "server", ""), ("card", "paid by card", ""), ("call", "tel", "phone"), ("IBAN", "account", ""), ("SSN", "social security", "ssn")
_OTHERS = "order", "version", "invoice", "since", "page", "", "total", "code"


def _with_check(digits: str) -> str:
    """The digits with the last changed so that the check sum holds."""
    return next(x for k in "0123456789" if luhn(x := digits[:-1] + k))


def made(rng: np.random.Generator, kind: int) -> str:
    """An entity of the kind, in a form drawn by chance."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == 0:
        name = pick(_NAMES) + pick(["", "." + pick(_NAMES), digits(2)])
        at, dot = pick([("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" AT ", " DOT ")])
        return name + at + pick(_HOSTS) + pick(["", dot + pick(_HOSTS)]) + dot + pick(_ENDS)
    if kind == 1:
        if rng.random() < 0.5:
            return ".".join(map(str, rng.integers(0, 256, 4)))
        groups = [f"{x:x}" for x in rng.integers(1, 1 << 16, 8)]
        return ":".join(groups) if rng.random() < 0.5 else ":".join(groups[:3]) + "::" + ":".join(groups[3 : 3 + int(rng.integers(1, 4))])
    if kind == 2:
        d, sep = _with_check(digits(16)), pick(["", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = str(rng.integers(200, 999)), digits(3), digits(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"0{a[:2]}/{b}{c[:3]}", f"0{a} {b} {c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"+{rng.integers(1, 99)} ({a}) {b}-{c}"])
    if kind == 4:
        body, country = digits(int(rng.integers(14, 19))), pick(["DE", "FR", "ES", "NL", "GB"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))
    sep = pick("- ")
    return f"{rng.integers(100, 665):03d}{sep}{rng.integers(1, 99):02d}{sep}{rng.integers(1, 9999):04d}"


def look_alike(rng: np.random.Generator) -> str:
    """A number of something else."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    n = lambda a, b: int(rng.integers(a, b))
    return pick(
        [
            f"{n(1900, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", f"{n(0, 24)}:{n(0, 60):02d}", f"{n(0, 24)}:{n(0, 60):02d}:{n(0, 60):02d}",
            f"{n(1, 30)}.{n(0, 30)}.{n(0, 30)}", f"{n(300, 999)}.{n(300, 999)}.{n(300, 999)}.{n(300, 999)}", f"{n(1, 99)},{n(100, 999)},{n(100, 999)}", f"{n(10**5, 10**12)}", f"{n(10**13, 10**17)}",
            f"{n(100, 999)}-{n(10000, 99999)}-{n(1, 9)}", f"978-{n(0, 9)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}", f"{n(1990, 2030)}-{n(1990, 2030)}", f"{n(1, 99)}.{n(10, 99)}", f"{n(1000, 9999)} {n(1000, 9999)}", f"{n(1, 99)} at {n(1, 99)}", "at a dot on it",
            f"{chr(65 + n(0, 26))}{chr(65 + n(0, 26))}{n(10, 99)}{n(10**6, 10**9)}", f"{n(10, 999)} {n(10, 999)} {n(10, 999)}", f"{n(10, 99)}-{n(10, 99)}-{n(10, 99)}-{n(10, 99)}",
        ]
    )


def examples(backgrounds: list[tuple[str, list[tuple[int, int, int]]]], count: int = MADE, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts: entities and look-alikes by seeded rules, each between two background texts with their own labels."""
    rng = np.random.default_rng(seed)
    grounds = [*backgrounds, *((s, base_spans(s)) for s in SENTENCES for _ in range(max(1, len(backgrounds) // 10)))]
    out = []
    for i in range(count):
        text, gold = "", []
        for k in range(3):
            ground, own = grounds[int(rng.integers(len(grounds)))]
            words = ground.split(" ")
            if len(words) > 12 and not own:
                ground = " ".join(words[:12])
            gold += [(a + len(text), kind, b + len(text)) for a, kind, b in own]
            text += ground
            if k == 2:
                break
            kind = int(rng.integers(len(KINDS))) if (i + k) % 2 else -1
            said = (_BY_KIND[kind] if kind >= 0 else _OTHERS)[int(rng.integers(3 if kind >= 0 else len(_OTHERS)))] if rng.random() < 0.5 else ""
            text += [" ", ", ", ". "][int(rng.integers(3))] + (said + [" ", ": "][int(rng.integers(2))] if said else "")
            entity = made(rng, kind) if kind >= 0 else look_alike(rng)
            if kind >= 0:
                gold.append((len(text), kind, len(text) + len(entity)))
            text += entity + [" ", ", ", ". ", "; "][int(rng.integers(4))]
        out.append((text, gold))
    return out


def train_weights(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray:
    """Weights (kinds x features) by the gradient of the segmentations' log likelihood."""
    w, seen = np.zeros((len(KINDS), WIDTH)), np.full((len(KINDS), WIDTH), 1e-6)
    w[:, 0] = -1.0
    data = []
    for text, gold in rows:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segments = _segments(text, tokens)
        if not segments:
            continue
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        want = [(first[a], last[b], k) for a, k, b in gold if a in first and b in last and (first[a], last[b]) in segments]
        keys = list(segments)
        x = np.zeros((len(keys), WIDTH))
        for r, key in enumerate(keys):
            x[r, list(segments[key])] = 1
        place = {key: r for r, key in enumerate(keys)}
        data.append((len(tokens), keys, x, [(place[i, j], k) for i, j, k in want]))
    for _ in range(EPOCHS):
        for n, keys, x, want in data:
            s = x @ w.T
            top = s.max(axis=1)
            total = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
            forward, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            forward[0] = behind[n] = 0.0
            ends, starts = {}, {}
            for r, (i, j) in enumerate(keys):
                ends.setdefault(j, []).append((i, r))
                starts.setdefault(i, []).append((j, r))
            for j in range(1, n + 1):
                forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + total[r] for i, r in ends.get(j, ()))])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + total[r] for j, r in starts.get(i, ()))])
            log_p = np.array([forward[i] + behind[j] for i, j in keys])[:, None] + s - forward[n]
            p = np.exp(np.minimum(log_p, 0))
            for r, k in want:
                p[r, k] -= 1
            gradient = p.T @ x + 1e-4 * w
            seen += gradient**2
            w -= 0.5 * gradient / np.sqrt(seen)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    def cut(batches):
        for batch in batches:
            rows = {}
            for text in each(batch.column("text")):
                if not text:
                    continue
                spans = None
                for tokens in islands(text):
                    if len(tokens) > FIT_TOKENS:
                        continue
                    a, b = tokens[0][0], tokens[-1][1]
                    if spans is None:
                        spans = base_spans(text)
                    rows[text[a:b]] = ",".join(f"{s - a}:{k}:{e - a}" for s, k, e in spans if a <= s and e <= b)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.string())], names=["island", "gold"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "island string, gold string")
    sample = found.withColumn("h", F.xxhash64("island")).groupBy("h").agg(F.min(F.struct("island", "gold")).alias("one")).orderBy("h").limit(FIT_ISLANDS).select("one.*")
    rows = [(r["island"], [tuple(map(int, g.split(":"))) for g in r["gold"].split(",") if g]) for r in sample.collect()]
    return train_weights(examples(rows))


@lru_cache(1 << 14)
def _line(spans: tuple) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs) if weights is None else weights)

    def run(batches):
        for batch in batches:
            rows = []
            for text in each(batch.column("text")):
                text = text or ""
                base = base_spans(text)
                counts = [0] * BASE
                for _, k, _ in base:
                    counts[k] += 1
                starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
                added = []
                for a, k, b in (s for tokens in islands(text) for s in decode(model.value, text, tokens)):
                    before = bisect_left(starts, b)
                    if not before or ends[before - 1] <= a:  # no base span touches it
                        added.append((a, k, b))
                line = _line(tuple(base))
                rows.append((*counts, hashlib.sha256(line.encode()).hexdigest(), _line(tuple(sorted(base + added))) if added else line, len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * BASE + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_added"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))

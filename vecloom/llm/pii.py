"""Personal data: candidate spans scored by boosted trees.

Base rules find e-mail addresses, IP addresses, card and phone numbers exactly. Beside
them, generators with wider patterns (spelled-out addresses, other separators, numbers
without a country code) propose spans that may overlap. Boosted trees score each candidate
by its format and its context. Lessons come from the corpus and from a fixed set of made-up
spans, so a corpus without a kind still has a detector for it: a base span is a positive example,
and so are its usual disguises (spelled-out marks, bracketed dots, a phone without its country
code); negative ones are the look-alikes made of its letters and digits (thousands, lists, scores,
times, dates, ids, versions, prose around an @), and candidates of the texts that touch no base
span and break their kind's format. Each kind gets
the least threshold that reaches the wanted precision on vectors its trees have not seen.

The examples of all texts are counted by feature vector, and trees and thresholds are fitted on
all different vectors: on the driver if there are few, else the histograms of a level of all trees
are summed over the partitions of the vectors. A vector weighs the logarithm of its count, so
frequent formats do not crowd out rare ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import as_binary, as_lists
from vecloom.llm.texts import map_texts, pieces
from vecloom.session import materialise, take_bounded

KINDS = ["email", "ip", "card", "phone"]
# Up to so many different vectors the trees are fitted on the driver.
LOCAL_ROWS = 20_000
# With more, the partitions whose histograms are summed, the rounds after which the scores so
# far are written, and the steps of the scores that are counted for the thresholds.
MOST_PARTS, WRITTEN_ROUNDS, SCORE_STEPS = 32, 8, 1 << 20
# Parts of the vectors; trees fitted on the others score each one for calibration.
FOLDS = 4
# Candidates of a text that are scored at once.
SCORED = 20_000
# Precision that a kind's threshold must reach, and the least threshold.
PRECISION = 0.99
LEAST_SCORE = 0.9

LOCAL = r"[A-Za-z0-9._%+-]+"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
REVERSED_LOCAL = re.compile(LOCAL)
# A match always begins where a run of digits does; to start within one finds nothing new.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[^0-9]+")
SPELLED = re.compile(r"at\s?[)\]}]")
BRACKETED = re.compile(r"\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?")
THOUSANDS = re.compile(r"[0-9]{1,3}(?:[., ][0-9]{3})+")

# The wider patterns; quantifiers are bounded, so a long run costs no more than its length. Blanks
# may stand around a mark that is spelled out or an @, but not around a plain dot of a host,
# whose last part is of letters.
AT = r"(?:\s?[(\[{]\s?at\s?[)\]}]\s?|\s?@\s?)"
AT_SIGN = re.compile(AT)
DOT = r"(?:\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\.)"
WIDE = {
    "email": re.compile(
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}"
        rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}{DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
    ),
    "ip": re.compile(
        r"(?<![0-9])[0-9]{1,3}(?:\s?(?:[(\[]dot[)\]]|[.,:()\[\]_-]{1,3})\s?[0-9]{1,3}){3}(?![0-9])"
    ),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,3}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9])"),
}
# Words that announce a kind in the text before it.
CONTEXT = {
    "email": ["mail", "contact", "write", "correo", "schreib"],
    "ip": ["ip", "host", "server", "address", "adresse"],
    "card": ["card", "visa", "credit", "karte", "carte", "tarjeta"],
    "phone": ["tel", "phone", "call", "mobile", "fax", "llama", "appel"],
}
CONTEXT_CHARS = 30
# A country code and what parts it from the rest of a number that is written in groups.
COUNTRY = re.compile(r"\+[0-9]{1,3}[ .-]+(?=[(0-9])")
# Two to five groups of digits, the first perhaps in brackets.
NATIONAL = re.compile(r"(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ ./-])[0-9]{2,8}(?:[ .-][0-9]{2,5}){0,3}")
DATE = re.compile(
    r"(?:(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2})"
    r"(?![0-9])|(?:(?:19|20)[0-9]{2}(?:[ ./-]{1,3}|$)){2,}"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(parts) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def emails(text: str):
    """Leftmost non-overlapping addresses, found from their @ signs in linear time."""
    start, at = 0, text.find("@")
    while at >= 0:
        local = REVERSED_LOCAL.match(text[start:at][::-1])
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local.end(), domain.end()
            start = domain.end()
        else:
            start = at + 1
        at = text.find("@", start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not HINT.search(text):
        return []
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if octets(m[0].split("."))]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def touches(spans: list[tuple[int, int, int]]):
    """Function from (start, end) to whether any of the spans overlaps it. The spans are joined
    to runs once, so a question costs the logarithm of their number."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def touched(start: int, end: int) -> bool:
        at = bisect_left(starts, end) - 1
        return at >= 0 and ends[at] > start

    return touched


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping spans that the wide patterns propose."""
    if not (HINT.search(text) or SPELLED.search(text)):
        return []
    return [
        (kind, *m.span()) for kind, name in enumerate(KINDS) for m in WIDE[name].finditer(text)
    ]


FEATURES = 32


def features(
    text: str, kind: int, start: int, end: int, span: str | None = None, told: bool | None = None
) -> list[float]:
    """Format and context of a span; ``span`` stands in for the text's own if given, and
    ``told`` for whether the text before announces the kind."""
    span = text[start:end] if span is None else span
    digits = DIGITS.sub("", span)
    numbers = [p for p in DIGITS.split(span) if p]
    marks = [c for c in span if not c.isalnum()]
    if told is None:
        before = text[max(0, start - CONTEXT_CHARS) : start].lower()
        told = any(w in before for w in CONTEXT[KINDS[kind]])
    tail = re.split(r"[^A-Za-z]", span)[-1]
    sizes = [len(p) for p in numbers] or [0]
    between = DIGITS.findall(span.strip("+() "))
    at = AT_SIGN.search(span) if kind == 0 else None
    # Patterns of numbers say nothing of addresses, and of brackets nothing where there are none.
    number = kind >= 2
    bracketed = len(BRACKETED.findall(span)) if kind < 2 and len(marks) > 3 else 0
    local = span[: at.start()] if at else ""
    return [
        float(kind),
        float(len(span)),
        float(len(digits)),
        float(len(marks)),
        float(len(set(marks))),
        float(len(numbers)),
        float(len(digits) >= 13 and luhn(digits)),
        float(len(numbers) == 4 and octets(numbers)),
        float(span.count("@")),
        float(bool(at) and "@" not in at.group()),
        float(span.startswith("+")),
        float(len(tail)),
        float(marks.count(".")),
        float(text[start - 1 : start].isalnum()),
        float(text[end : end + 1].isalnum()),
        float(told),
        float(span.startswith("(")),
        float(sizes[0]),
        float(sizes[-1]),
        float(marks.count(" ")),
        float(bracketed),
        float(sum(span.count(c) for c in ",:;")),
        float(len(set(between)) <= 1),
        float(min(sizes)),
        float(max(sizes)),
        float(any(c.isalpha() for c in local)),
        float(tail.islower()),
        float(bool(at) and at.group().startswith(" ") != at.group().endswith(" ")),
        float(span.lstrip("(").startswith("0")),
        float(number and bool(DATE.match(span))),
        float(kind == 3 and national(span)),
        float(number and bool(THOUSANDS.fullmatch(span))),
    ]


def national(span: str) -> bool:
    """Whether a span is grouped as phones without a country code are, and is no date."""
    digits = DIGITS.sub("", span)
    return 7 <= len(digits) <= 12 and bool(NATIONAL.fullmatch(span)) and not DATE.match(span)


def regrouped(phone: str) -> list[str]:
    """A base phone without its country code: as it is grouped, and with one mark between
    its groups; none if it has no groups."""
    head = COUNTRY.match(phone)
    own = phone[head.end() :] if head else ""
    numbers = [p for p in DIGITS.split(own) if p]
    if len(numbers) < 2:
        return []
    made = [own, *(mark.join(numbers) for mark in "- .")]
    made.append(f"({numbers[0]}) " + "-".join(numbers[1:]))
    return [p for p in dict.fromkeys(made) if national(p) and WIDE["phone"].fullmatch(p)]


def not_phones(phone: str) -> list[str]:
    """A plain run, ids and dates made of a base phone's digits."""
    d = DIGITS.sub("", phone)
    month, day = f"{int(d[-4:-2]) % 12 + 1:02}", f"{int(d[-2:]) % 28 + 1:02}"
    year = f"20{d[-6:-4]}"
    return [
        d,
        f"{d[:1]}-{d[1:-1]}-{d[-1:]}",
        f"{d[:-1]}-{d[-1:]}",
        f"{year}-{month}-{day}",
        f"{year}-{month}-{day} {d[-3:-1]}",
        f"{day}.{month}.{year}",
        f"{day}/{month}/{year}",
        f"{year}-{int(year) + 1}",
    ]


def plausible(kind: int, span: str) -> bool:
    """Whether a span could be of its kind although the base rules did not find it; such
    spans teach nothing."""
    digits = DIGITS.sub("", span)
    sizes = [len(p) for p in DIGITS.split(span) if p]
    if kind == 0:
        at = AT_SIGN.search(span)
        one_sided = at.group().startswith(" ") != at.group().endswith(" ")
        return any(c.isalpha() for c in span[: at.start()]) and span[-1].islower() and not one_sided
    if kind == 1:
        plain = re.sub(r"\s?\.\s?", ".", BRACKETED.sub(".", span))
        return bool(IP.fullmatch(plain)) and octets(plain.split("."))
    if kind == 2:
        return luhn(digits) and min(sizes) >= 3
    if span.startswith("+"):
        return 9 <= len(digits) <= 15
    return national(span) and min(sizes) >= 2 and not THOUSANDS.fullmatch(span)


def grouped(digits: str, sizes: list[int], mark: str) -> str:
    """Digits in groups of the given sizes, the last one taking what is left."""
    ends = np.cumsum([0, *sizes]).tolist()
    parts = [digits[a:b] for a, b in zip(ends, ends[1:])] + [digits[ends[-1] :]]
    return mark.join(p for p in parts if p)


def disguises(kind: int, own: str) -> list[str]:
    """What a base span is usually written like where it should not be found."""
    if kind == 0:
        local, host = own.split("@")
        ats = [" [at] ", "[at]", "(at)", " (at) ", " {at} ", " @ "]
        dots = [".", " [dot] ", "[dot]", "(dot)", " (dot) ", "[.]"]
        return [local + a + host.replace(".", d) for a in ats for d in dots if (a, d) != (" @ ", "[.]")]
    if kind == 1:
        parts = own.split(".")
        marks = ["[.]", "(.)", "[dot]", "(dot)", " [.] ", " . "]
        return [m.join(parts) for m in marks] + [f"{'.'.join(parts[:3])}[.]{parts[3]}"]
    digits = DIGITS.sub("", own)
    if kind == 2:
        sizes = [4, 6] if len(digits) == 15 else [4, 4, 4]
        return [digits, *(grouped(digits, sizes, m) for m in (".", "/", "_", " - ", "--"))]
    return regrouped(own)


def look_alikes(kind: int, own: str) -> list[str]:
    """Ordinary text made of a base span's letters and digits that a generator takes up."""
    digits = DIGITS.sub("", own)
    if kind == 0:
        local, host = own.split("@")
        word = re.sub("[^a-z]", "", local.lower()) or "we"
        name, end = re.sub("[^a-z]", "", host.lower()) or "home", host.rsplit(".", 1)[-1]
        number = str(len(own))
        return [
            f"{word} @ {name}.{end.title()}ing", f"{word} (at) {name}.{end.title()}",
            f"{word} @{name}.{end}", f"{word}@ {name}.{end}", f"{number} @ {name}.{end}",
            f"{number} (at) {name}.{end}", f"{word} @ {name}.transposed", f"{number} @ 4.{end}",
            f"{word} [at] {name}.{end.title()}", f"{number}@ {number}.{end}",
        ]
    if kind == 1:
        a, b, c, d = (p.lstrip("0") or "0" for p in own.split("."))
        hour, minute = f"{int(a) % 24}", f"{int(b) % 60:02}"
        return [
            f"{a}, {b}, {c}, {d}", f"{a},{b},{c},{d}", f"{a}:{b}:{c}:{d}", f"{a}-{b}, {c}-{d}",
            f"{a[:1]}-{b[:1]}, {c[:1]}-{d[:1]}", f"{a[:1]}, {b[:1]}, {c[:1]}, {d[:1]}",
            f"{hour}:{minute}:{int(c) % 60:02}.{int(d):03}", f"{hour}:{minute}-{int(c) % 24}:{minute}",
            f"{a[:2]},{int(b):03},{int(c):03},{int(d):03}", f"{a}-{b}-{c}-{d}", f"{a}_{b}_{c}_{d}",
            f"{a}.{b}, {c}.{d}", f"{a}.{b}-{c}.{d}", f"{a}[.]{b}[.]{int(c) + 300}[.]{d}", f"{a}.{b},{c}",
            f"{a}. {b}. {c}. {d}", f"({a}) {b} ({c}) {d}", f"[{a}], [{b}], [{c}], [{d}]"[1:-1],
        ]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        out = [wrong, *(grouped(wrong, [4, 4, 4], m) for m in (".", "/", "_", " - ", " ", "-"))]
        halves = grouped(digits[:8], [4], "/"), grouped(digits[8:], [4], "/")
        out += [m.join(halves) for m in (" ", "  ", " - ")] + [" ".join(h.replace("/", "-") for h in halves)]
        return out + [grouped(digits, [n] * 20, m) for n in (1, 2) for m in (" ", "/", ".", "-", " - ")]
    d = (digits + "4071852963")[:15]
    lists = [
        " ".join(str(i) for i in range(1, 8 + int(d[0]) % 4)),
        " ".join(str(10 * i) for i in range(1, 6)), " ".join(str(12 + i) for i in range(6)),
        " ".join(d[:9]), "-".join(d[:8]), "/".join(d[:8]), grouped(d[:10], [2] * 9, "/"),
        f"{d[0]}-{d[1]} {d[2]}-{d[3]} {d[4]}-{d[5]} {d[6]}-{d[7]}",
    ]
    lists += [
        mark.join(str(10 + (7 * int(d[i]) + 13 * i) % 90) for i in range(n))
        for n in (4, 5, 6, 7) for mark in (" ", "-", ".", "/")
    ]
    # Thousands, coordinates, versions, book numbers, two halves of an id, amounts.
    ids = [
        f"{int(d[:2]) % 9 + 1}.{d[2:5]}.{d[5:8]}", f"{int(d[:2]) % 89 + 10} {d[2:5]} {d[5:8]}",
        f"{int(d[:3]) % 899 + 100}.{d[3:6]}.{d[6:9]}", f"{int(d[:3]) % 899 + 100} {d[3:6]} {d[6:9]}",
        f"{d[:2]}.{d[2:6]} {d[6]}.{d[7:11]}", f"{d[0]}.{d[1:9]}", f"{d[:2]}.0.{d[2:7]}.{d[7:11]}",
        f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d[:5]}-{d[5:10]}", f"{d[:3]}-{d[3:5]}-{d[5:9]}",
        f"{d[:4]}-{d[4:8]}", f"{d[:8]}.{d[8:10]}", f"{d[:4]}/{d[4:8]}", f"{d[:7]}-{d[7]}",
    ]
    return not_phones(own) + lists + ids


def lessons(text: str, kind: int, start: int, end: int) -> list[tuple[int, int, list[float]]]:
    """(kind, label, features) of a base span, its disguises and look-alikes, announced and not."""
    own = text[start:end]
    out = [(kind, 1, features(text, kind, start, end))]
    for label, spans in ((1, [own, *disguises(kind, own)]), (0, look_alikes(kind, own))):
        for span in dict.fromkeys(spans):
            if span == own or WIDE[KINDS[kind]].fullmatch(span):
                out += [(kind, label, features(text, kind, start, end, span, t)) for t in (False, True)]
    return out


def made_up(count: int = 32) -> list[tuple[int, int, list[float]]]:
    """The lessons of a fixed set of made-up base spans, the same for every corpus."""
    draw = np.random.default_rng(20_240)
    out = []

    def digits(size: int) -> str:
        return "".join(map(str, draw.integers(0, 10, size)))

    def letters(size: int) -> str:
        return "".join(chr(97 + i) for i in draw.integers(0, 26, size))

    for turn in range(count):
        host = letters(3 + turn % 6) + ".example" * (turn % 3 == 0)
        end = ["com", "org", "net", "de", "info", "co.uk"][turn % 6]
        local = letters(3 + turn % 7) + [".", "_", "", digits(2)][turn % 4] + letters(turn % 5)
        number = digits(14 if turn % 4 == 3 else 15)
        check = next(c for c in "0123456789" if luhn(number + c))
        country = str(1 + int(draw.integers(0, 98)))
        phone = [
            f"+{country} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{country} {digits(3)} {digits(3)} {digits(4)}",
            f"+{country} 0{digits(2)} {digits(6)}", f"+{country} 0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        ][turn % 4]
        address = ".".join(str(x) for x in draw.integers(0, [256, 100, 10, 256][turn % 4], 4))
        for kind, span in enumerate((f"{local}@{host}.{end}", address, number + check, phone)):
            out += lessons(f" {span} ", kind, 1, 1 + len(span))
    return out


def examples(text: str) -> list[tuple[int, int, list[float]]]:
    """(kind, label, features) that a text teaches."""
    base = base_spans(text)
    exact, out, touched = set(base), [], touches(base)
    for kind, start, end in candidates(text):
        if (kind, start, end) in exact:
            out.append((kind, 1, features(text, kind, start, end)))
        elif not plausible(kind, text[start:end]) and not touched(start, end):
            out.append((kind, 0, features(text, kind, start, end)))
    for kind, start, end in base:
        out.append((kind, 1, features(text, kind, start, end)))
    return out


# -- Boosted trees -------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete trees of one depth: a feature and a cut for each inner node, a value for
    each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1.0 / (1.0 + np.exp(-total))


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Every place between different values if they are few, else quantiles."""
    different = np.unique(values)
    if len(different) <= bins:
        return different[:-1]
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 80,
    depth: int = 4,
    rate: float = 0.3,
    bins: int = 32,
    weight: np.ndarray | None = None,
) -> Trees:
    """Gradient boosting of the logistic loss over binned features; ``y`` may be a share of
    positives."""
    weight = np.ones(len(y)) if weight is None else weight
    cuts = [cuts_of(x[:, f], bins) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    share = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    grown = []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            own = node - base
            for f, values in enumerate(cuts):
                width = len(values) + 1
                cell = own * width + codes[:, f]
                gs = np.bincount(cell, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(cell, h, count * width).reshape(count, width).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                at = gain[:, :-1].argmax(axis=1) if width > 1 else np.zeros(count, np.int64)
                better = (gain[np.arange(count), at] > best + 1e-9) & (width > 1)
                best[better] = gain[np.arange(count), at][better]
                feature[base : base + count][better] = f
                if width > 1:
                    cut[base : base + count][better] = values[at][better]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        place = node - inner
        gs, hs = np.bincount(place, g, leaves), np.bincount(place, h, leaves)
        leaf = rate * gs / (hs + 1)
        total += leaf[place]
        grown.append((feature, cut, leaf))
    return Trees(*(np.stack(z) for z in zip(*grown)), start)


@dataclass
class Detector:
    """The trees, and the least score for each kind."""

    trees: Trees
    thresholds: list[float]


def calibrate(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Threshold from which on the share of positives reaches the wanted precision: half-way
    between the last score that does and the next one, and no less than LEAST_SCORE."""
    weight = np.ones(len(scores)) if weight is None else weight
    order = np.argsort(-scores, kind="stable")
    right, seen = np.cumsum((labels * weight)[order]), np.cumsum(weight[order])
    ordered = np.append(scores[order], 0.0)
    last = ordered[1:] != ordered[:-1]
    good = last & (right / np.maximum(seen, 1) >= PRECISION)
    if not good.any():
        return 2.0
    at = np.flatnonzero(good)[-1]
    return max(LEAST_SCORE, float(ordered[at] + ordered[at + 1]) / 2)


def format_of(x: str) -> Column:
    """The format of a feature vector: its marks, numbers and flags, with counts capped, so a
    kind and label has at most 2,304 formats, fewer than its quota."""
    at = lambda i, most: F.least(F.get(x, F.lit(i)), F.lit(float(most)))
    caps = {4: 7, 5: 5, 6: 1, 7: 1, 8: 2, 9: 1, 10: 1}
    return F.array(*[at(i, most) for i, most in caps.items()])


def fair_share(counts: list[int], quota: int) -> float:
    """The largest s for which the sum of min(count, s) stays within the quota."""
    left = float(quota)
    for place, count in enumerate(sorted(counts)):
        share = left / (len(counts) - place)
        if count > share:
            return share
        left -= count
    return float(max(counts))


def training_vectors(made: DataFrame, train_rows: int | None = None) -> DataFrame:
    """(kind, label, x, n, ones, stands) of the vectors to fit on, from (kind, label, x).

    ``n`` examples have the vector, ``ones`` of them positive, and ``label`` is what most of
    them say. These are all vectors, unless ``train_rows`` bounds them: then each kind and label
    has an equal quota, dealt to its formats, and a vector of a format with more of them than
    its share stands for ``stands``.
    """
    counted = made.groupBy("kind", "x").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    counted = counted.select(
        "*",
        (2 * F.col("ones") >= F.col("n")).cast("int").alias("label"),
        format_of("x").alias("format"),
        F.xxhash64("kind", "x").alias("hash"),
    )
    counted = materialise(counted, "vectors")
    if train_rows is None:
        return counted.withColumn("stands", F.lit(1.0)).orderBy("kind", "label", "hash", "x").select(
            "kind", "label", "x", "n", "ones", "stands"
        )
    # A row for each format, of which the caps in format_of leave few.
    key = ["kind", "label", "format"]
    sizes = counted.groupBy(*key).agg(F.count("*").alias("size"), F.min("hash").alias("first"))
    sizes = sizes.collect()
    quota = max(1, train_rows // (2 * len(KINDS)))
    groups: dict = {}
    for r in sizes:
        groups.setdefault((r.kind, r.label), []).append(r.size)
    share = {g: fair_share(c, quota) for g, c in groups.items()}
    taken = []
    for r in sizes:
        part = min(1.0, share[r.kind, r.label] / r.size)
        # The vectors of a format whose hash is in the lowest part, at least the first one.
        limit = max(r.first, min(2**63 - 1, int(-(2**63) + part * 2.0**64)))
        taken.append((r.kind, r.label, r.format, limit, 1.0 / part))
    schema = "kind int, label int, format array<double>, most long, stands double"
    limits = made.sparkSession.createDataFrame(taken, schema)
    kept = counted.join(F.broadcast(limits), key).filter(F.col("hash") <= F.col("most"))
    return kept.orderBy("kind", "label", "hash", "x").select(
        "kind", "label", "x", "n", "ones", "stands"
    )


def fit(df: DataFrame, text_col: str = "text", train_rows: int | None = None) -> Detector:
    """Trees and thresholds from the examples of all texts, counted by vector, and from the
    lessons of the made-up spans, counted likewise. ``train_rows`` bounds the vectors, if wanted.

    Trees weigh a vector by the logarithm of its count, so millions of copies do not drown a
    rare format. Each vector is scored by trees that were fitted without it; these scores
    calibrate the thresholds, with the same weights. Null and empty texts teach nothing; without
    any text the made-up spans alone teach.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                rows = [e for t in piece.column(0).to_pylist() if t for e in examples(t)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                    ],
                    names=["kind", "label", "x"],
                )

    made = df.select(text_col).mapInArrow(run, "kind int, label int, x array<double>")
    vectors = training_vectors(made, train_rows)
    table = take_bounded(vectors, LOCAL_ROWS) if train_rows is None else vectors.toArrow()
    if table is None:
        return fit_spread(vectors)
    own, times = np.unique([[e[1], *e[2]] for e in made_up()], axis=0, return_counts=True)
    columns = {c: table.column(c).to_numpy() for c in ("kind", "n", "ones", "stands")}
    found = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    x = np.concatenate([found, own[:, 1:]])
    n = np.append(columns["n"], times).astype(np.float64)
    y = np.append(columns["ones"] / columns["n"], own[:, 0])
    stands = np.append(columns["stands"], np.ones(len(own)))
    kind = np.append(columns["kind"], own[:, 1])
    weight = np.log2(1.0 + n)
    # Equal vectors share a part, and every part gets its share of each kind.
    _, same = np.unique(x, axis=0, return_inverse=True)
    fold = same.reshape(-1) % FOLDS
    scores = np.zeros(len(y))
    for part in range(FOLDS):
        held = fold == part
        trees = fit_trees(x[~held], y[~held], weight=weight[~held])
        scores[held] = trees.score(x[held])
    kinds = [kind == k for k in range(len(KINDS))]
    return Detector(
        fit_trees(x, y, weight=weight),
        [calibrate(scores[k], y[k], (weight * stands)[k]) for k in kinds],
    )


# -- Many vectors --------------------------------------------------------------------------


def spread_cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """As ``cuts_of``, of all vectors of rows(x): what is counted is each value of a feature."""
    counted = rows.select(F.posexplode("x").alias("f", "value")).groupBy("f", "value").count()
    counted = materialise(counted, "values")
    few = counted.groupBy("f").agg(F.count("*").alias("different"))
    shares = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
    joined = counted.join(F.broadcast(few), "f")
    every = joined.where(F.col("different") <= bins).select("f", "value").toArrow()
    at = joined.where(F.col("different") > bins).groupBy("f").agg(
        F.percentile("value", F.array(*map(F.lit, shares)), F.col("count")).alias("cuts")
    )
    # At most ``bins`` values of a feature.
    cuts = [np.zeros(0)] * FEATURES
    feature, value = every.column("f").to_numpy(), every.column("value").to_numpy()
    for f in np.unique(feature):
        cuts[f] = np.unique(value[feature == f])[:-1]
    for r in at.collect():
        cuts[r.f] = np.unique(r.cuts)
    return cuts


def node_of(codes: np.ndarray, feature: np.ndarray, place: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after the first levels of a tree over binned features."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(levels):
        node = 2 * node + 1 + (codes[rows, feature[node]] > place[node])
    return node


def code_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), FEATURES)


def histograms(state: DataFrame, shipped, level: int, width: int) -> np.ndarray:
    """Sums of gradients and second derivatives [model, node, feature, bin, 2] of a level over
    all rows of state(codes, y, weight, fold, total). Shipped are the rounds since the totals
    were written, the last of them the trees that grow; model ``m`` leaves out fold m."""

    def run(batches):
        rounds = shipped.value
        count = 1 << level
        sums = np.zeros((FOLDS + 1, count, FEATURES, width, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = code_matrix(batch.column(0))
            y, weight, fold = (batch.column(i).to_numpy() for i in (1, 2, 3))
            total = batch.column(4).flatten().to_numpy().reshape(len(y), FOLDS + 1).copy()
            for m in range(FOLDS + 1):
                for feature, place, leaf in (r[m] for r in rounds[:-1]):
                    levels = int(np.log2(len(leaf)))
                    total[:, m] += leaf[node_of(codes, feature, place, levels) - len(feature)]
                own = fold != m
                part, p = codes[own], 1.0 / (1.0 + np.exp(-total[own, m]))
                g, h = weight[own] * (y[own] - p), weight[own] * np.maximum(p * (1 - p), 1e-6)
                feature, place, _ = rounds[-1][m]
                node = node_of(part, feature, place, level) - (count - 1)
                for f in range(FEATURES):
                    cell = node * width + part[:, f]
                    for i, values in enumerate((g, h)):
                        sums[m, :, f, :, i] += np.bincount(cell, values, count * width).reshape(count, width)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    # One array of fixed size for each of at most MOST_PARTS partitions.
    found = state.mapInArrow(run, "sums binary").toArrow().column("sums").to_pylist()
    shape = (FOLDS + 1, 1 << level, FEATURES, width, 2)
    return sum(np.frombuffer(x).reshape(shape) for x in found)


def with_totals(state: DataFrame, shipped) -> DataFrame:
    """The state with the rounds added to its totals, written."""
    names = state.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = code_matrix(batch.column(0))
            total = batch.column(4).flatten().to_numpy().reshape(len(codes), FOLDS + 1).copy()
            for trees in shipped.value:
                for m, (feature, place, leaf) in enumerate(trees):
                    levels = int(np.log2(len(leaf)))
                    total[:, m] += leaf[node_of(codes, feature, place, levels) - len(feature)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], as_lists(total), *batch.columns[5:]], names)

    return materialise(state.mapInArrow(run, state.schema), "boosting")


def fit_spread(
    vectors: DataFrame, rounds: int = 80, depth: int = 4, rate: float = 0.3, bins: int = 32
) -> Detector:
    """As ``fit``, from any number of training vectors: trees over the bins of all vectors,
    grown level by level from histograms, those of each fold beside those of all."""
    spark = vectors.sparkSession
    own, times = np.unique([[e[1], *e[2]] for e in made_up()], axis=0, return_counts=True)
    made = pa.table(
        {
            "kind": own[:, 1].astype(np.int32), "x": as_lists(own[:, 1:]),
            "n": times.astype(np.int64), "ones": (own[:, 0] * times).astype(np.int64),
        }
    )
    rows = vectors.select("kind", "x", "n", "ones").unionByName(spark.createDataFrame(made))
    # Made-up spans are lessons beside those of the texts; equal vectors share a fold.
    rows = materialise(
        rows.select(
            "kind", "x", (F.col("ones") / F.col("n")).alias("y"), F.log2(1.0 + F.col("n")).alias("weight"),
            F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold"),
        ),
        "lessons",
    )
    cuts = spread_cuts(rows, bins)
    width = max(len(c) for c in cuts) + 1
    held = [F.sum(F.when(F.col("fold") != m, F.col(c))) for m in range(FOLDS + 1) for c in ("weight", "right")]
    sums = np.array(rows.withColumn("right", F.col("y") * F.col("weight")).agg(*held).first(), float)
    share = np.clip(sums[1::2] / sums[::2], 0.01, 0.99)
    starts = np.log(share / (1 - share))

    def coded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, FEATURES)
            codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
            total = np.tile(starts, (len(x), 1))
            yield pa.RecordBatch.from_arrays(
                [as_binary(codes.astype(np.uint8)), *batch.columns[2:], as_lists(total), batch.column(0)],
                ["codes", "y", "weight", "fold", "total", "kind"],
            )

    schema = "codes binary, y double, weight double, fold int, total array<double>, kind int"
    state = materialise(rows.repartition(MOST_PARTS, "x").mapInArrow(coded, schema), "boosting")
    inner, leaves = (1 << depth) - 1, 1 << depth
    usable = np.array([[b < len(c) for b in range(width)] for c in cuts])
    models: list = [[] for _ in range(FOLDS + 1)]
    recent: list = []
    for turn in range(rounds):
        growing = [
            [np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(leaves)] for _ in models
        ]
        for level in range(depth + 1):
            shipped = spark.sparkContext.broadcast([*recent, growing])
            found = histograms(state.coalesce(MOST_PARTS), shipped, level, width)
            base, count = (1 << level) - 1, 1 << level
            for m, (feature, place, leaf) in enumerate(growing):
                gs, hs = found[m, ..., 0].cumsum(axis=2), found[m, ..., 1].cumsum(axis=2)
                ga, ha = gs[..., -1:], hs[..., -1:]
                if level == depth:
                    leaf[:] = rate * ga[:, 0, 0] / (ha[:, 0, 0] + 1)
                    continue
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain = np.where(usable, gain, -np.inf).reshape(count, -1)
                at = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(count), at] > 1e-9)
                feature[base + better], place[base + better] = np.divmod(at[better], width)
            shipped.unpersist()
        for grown, trees in zip(models, growing):
            feature, place, leaf = trees
            cut = [cuts[f][c] if c < 255 else np.inf for f, c in zip(feature, place)]
            grown.append((feature, np.array(cut), leaf))
        recent.append(growing)
        if len(recent) == WRITTEN_ROUNDS or turn == rounds - 1:
            state = with_totals(state, spark.sparkContext.broadcast(recent))
            recent = []
    # The scores by the trees that were fitted without a vector, counted in fine steps.
    score = 1.0 / (1.0 + F.exp(-F.get("total", F.col("fold"))))
    counted = state.groupBy("kind", F.round(score * SCORE_STEPS).alias("step")).agg(
        F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("y")).alias("right")
    )
    # At most SCORE_STEPS of a kind.
    table = counted.orderBy("kind", "step").toArrow()
    kind, step, weight, right = (table.column(c).to_numpy() for c in ("kind", "step", "weight", "right"))
    trees = Trees(*(np.stack(z) for z in zip(*models[FOLDS])), float(starts[FOLDS]))
    kinds = [kind == k for k in range(len(KINDS))]
    return Detector(
        trees, [calibrate(step[k] / SCORE_STEPS, right[k] / weight[k], weight[k]) for k in kinds]
    )


# -- Spans of texts ------------------------------------------------------------------------


def all_spans(texts: list[str], detector: Detector) -> list[tuple[list, list]]:
    """(base, all) spans of each text; added ones overlap neither base spans nor each other."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    for row, (text, own) in enumerate(zip(texts, base)):
        touched = touches(own)
        spans = [c for c in candidates(text) if not touched(c[1], c[2])]
        for lo in range(0, len(spans), SCORED):
            part = spans[lo : lo + SCORED]
            scores = detector.trees.score(np.array([features(text, *c) for c in part]))
            more[row] += [
                (-score, *c) for score, c in zip(scores, part) if score >= detector.thresholds[c[0]]
            ]
        more[row] = free_of_overlap(more[row])
    return [(b, sorted(b + m)) for b, m in zip(base, more)]


def free_of_overlap(scored: list) -> list[tuple[int, int, int]]:
    """The best of (-score, kind, start, end) that overlap no better one."""
    starts: list[int] = []
    ends: dict[int, int] = {}
    kept = []
    for _, kind, start, end in sorted(scored):
        at = bisect_left(starts, end)
        if at == 0 or ends[starts[at - 1]] <= start:
            starts.insert(bisect_left(starts, start), start)
            ends[start] = end
            kept.append((kind, start, end))
    return kept


def written(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find(
    df: DataFrame, detector: Detector, keep: list[Column], text_col: str = "text"
) -> DataFrame:
    """(keep..., n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts are those of base spans. Null and empty texts have no spans; repeated rows stay;
    an empty table gives none.
    """

    def kernel(texts: list):
        found = all_spans([t or "" for t in texts], detector)
        counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(len(KINDS))]
        digests = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]
        return [*counts, digests, [written(a) for _, a in found]]

    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(df, keep, F.col(text_col), lambda: kernel, fields)


def redacted(text: str, spans: list) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    out, place = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        if start >= place:
            out += [text[place:start], f"[{KINDS[kind].upper()}]"]
        place = max(place, end)
    return "".join([*out, text[place:]])


def redact(df: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` with all spans redacted from the text; nulls stay null."""

    def kernel(texts: list):
        found = all_spans([t or "" for t in texts], detector)
        return [[None if t is None else redacted(t, a) for t, (_, a) in zip(texts, found)]]

    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    made = map_texts(df, others, F.col(text_col), lambda: kernel, "__redacted string")
    return made.withColumnRenamed("__redacted", text_col).select(*df.columns)

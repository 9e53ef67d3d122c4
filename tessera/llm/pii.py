"""Personal data by candidate gradient boosting.

Four kinds have a fixed base (emails, IP addresses, card numbers, phone numbers): their spans are always
redacted. Around them, high-recall generators propose further, possibly overlapping candidates (obfuscated
emails, phone numbers without a plus, identity numbers, account numbers, credentials); boosted trees score each
from its format and context, a calibrated threshold per kind decides, and of overlapping selections the most
probable stays.

The trees are fitted on generated candidates, seeded, on the driver (a few seconds). Candidates of another generator, with
other cues, contexts and look-alikes, calibrate them: a logistic curve of each kind turns scores into probabilities, and
the kind's threshold is the probability half-way between the last candidate above it and the first below, at the lowest
place where the target precision holds. Nothing depends on the corpus.

Runs of credentials have no longest length, and every generator takes time linear in the text.

Defined results: a null text is an empty one and has no spans; offsets count code points; rows with equal ids are
rows of their own; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibration import logistic
from tessera.llm.lean import lean
from tessera.llm.store import bounded_batches
from tessera.llm.textkit import slices

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the trees select, after the base kinds in the order of spans.
ADDED = ("id_number", "account", "credential")
KINDS = BASE + ADDED
TARGET_PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators of further candidates: (kind, pattern, strings of which a text must hold one for it to be worth a scan, or None).
#: Each run starts at a boundary of its own, so a scan stays linear in the text.
GENERATORS = (
    ("phone", re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"), None),
    ("id_number", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), None),
    ("account", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("credential", re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"), ("AKIA", "ASIA")),
    ("credential", re.compile(r"(?<=[=:])\s{0,2}[\"']?([A-Za-z0-9_+/.-]{8,})[\"']?(?![\w])"), ("=", ":")),
    ("credential", re.compile(r"(?<!\w)[0-9a-f]{32,}(?!\w)"), None),
    ("credential", re.compile(r"(?<![\w.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), ("eyJ",)),
)
_AT = re.compile(r"\(at\)|\[at\]|\{at\}|&#64;", re.I)
_AFTER = re.compile(r"\s?[A-Za-z0-9-]{2,}\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[A-Za-z]{2,}\b", re.I)
_PEM = "PRIVATE KEY-----"
CUES = {
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "sms"),
    "id_number": ("ssn", "social", "sec", "security", "tax", "passport", "insurance"),
    "account": ("iban", "account", "bank", "transfer", "konto"),
    "credential": ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "credential", "auth"),
    "email": ("mail", "contact", "write", "reach"),
    "none": ("order", "version", "isbn", "page", "figure", "commit", "sha", "revision", "build", "serial", "part", "item", "id", "hash", "url", "http", "https"),
}


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans in the order of kinds, then starts. Each kind takes time linear in the text."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                    found.append(("ip", at, at + size))
                at += size + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[\x20-]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PLUS.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def obfuscated(text: str) -> list[tuple[str, int, int]]:
    """Emails whose sign is spelled out: the run before the sign, the sign, a domain."""
    found = []
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
        start = end
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if end - start >= 2 and (after := _AFTER.match(text, m.end())):
            found.append(("email", start, after.end()))
    return found


def key_blocks(text: str) -> list[tuple[str, int, int]]:
    """Private keys from their first line to their last, or to the end of the text without one."""
    found, at = [], text.find("-----BEGIN ")
    while at >= 0:
        head = text.find("-----", at + 11)
        stop = at + 11
        if head >= 0 and text[head - 11 : head + 5] == _PEM:
            last = text.find("-----END ", head)
            stop = len(text) if last < 0 else text.find("-----", last + 9)
            stop = len(text) if stop < 0 else stop if last < 0 else stop + 5
            found.append(("credential", at, stop))
        at = text.find("-----BEGIN ", stop)
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose; they may overlap one another."""
    found = obfuscated(text) + (key_blocks(text) if _PEM in text else [])
    for kind, pattern, needs in GENERATORS:
        if needs is None or any(n in text for n in needs):
            k = 1 if pattern.groups else 0
            found += [(kind, m.start(k), m.end(k)) for m in pattern.finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    n = max(len(s), 1)
    digits, upper, lower = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
    counts = Counter(s)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    near = set(re.findall(r"[a-z_]+", before)[-4:])
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)) / n
    out = [float(KINDS.index(kind)), float(n), digits / n, upper / n, lower / n, entropy, float(len(counts)), changes]
    out += [float(any(c == w or (len(c) > 3 and c in w) for c in CUES[k] for w in near)) for k in ("phone", "id_number", "account", "credential", "email", "none")]
    flat = "".join(c for c in s if c.isdigit())
    out += [float(bool(re.search(r"[=:]\s*[\"']?\Z", before))), float(before[-1:] in "\"'"), float(after[:1] in "\"'"), float(len(flat)), float(bool(flat) and len(set(flat)) == 1), float(sum(c in " .-()" for c in s))]
    # Letters of the last part, and signs in brackets without a space around them.
    out += [float(n - 1 - max(s.rfind(c) for c in ".)]} ")), float(any(c in s for c in ("[", "{", "&#64;"))), float("(" in s and " (" not in s)]
    out += [float("/" in s or "." in s), float(flat[:3] in ("000", "666") or flat[:1] == "9"), float(s.startswith(("AKIA", "ASIA", "eyJ", "-----BEGIN")))]
    return out


class Trees:
    """Gradient-boosted regression trees on the logistic loss: depth-limited, Newton steps, exact splits over quantile cuts."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 32, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.cuts, self.penalty = rounds, depth, rate, cuts, penalty
        self.trees: list = []
        self.first = 0.0

    def _grow(self, x, g, h, rows, depth):
        weight = -g[rows].sum() / (h[rows].sum() + self.penalty)
        best = (1e-6, None, None)
        if depth and len(rows) >= 8:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            score = total_g**2 / (total_h + self.penalty)
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in self.at[f]:
                    left = v <= cut
                    if 4 <= left.sum() <= len(rows) - 4:
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        gain = gl**2 / (hl + self.penalty) + (total_g - gl) ** 2 / (total_h - hl + self.penalty) - score
                        if gain > best[0]:
                            best = (gain, f, cut)
        if best[1] is None:
            return self.rate * weight
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _value(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._value(a, x), self._value(b, x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.at = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 1)[:-1])) for f in range(x.shape[1])]
        self.first = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        score = np.full(len(y), self.first)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._value(tree, x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.first + sum(self._value(t, x) for t in self.trees)


def generated(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of made-up candidates: every kind with look-alikes."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randint(2, 9)))
    caps = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    path = lambda k, by: by.join(word() for _ in range(k))
    signed = lambda: f"eyJ{mixed(r.randint(15, 40))}.eyJ{mixed(r.randint(40, 500))}.{mixed(43)}"
    good = {
        "email": lambda: (r.choice(["", "mail ", "contact "]), f"{word()}{r.choice(['.' + digit(2), '_' + word(), '.' + word(), digit(1)])}{r.choice(['(at)', ' (at) ', '[at]', ' [at] ', '{at}', '&#64;'])}{word()}{r.choice(['.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net', 'de', 'gov', 'name'])}", ""),
        "phone": lambda: (r.choice(["call ", "tel ", "phone ", "fax ", ""]), r.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)} {digit(3)} {digit(4)}"]), ""),
        "id_number": lambda: (r.choice(["ssn ", "ssn: ", "social security ", "social security no ", "tax number ", "tax ", "passport ", "insurance "]), f"{r.randint(100, 665)}-{digit(2)}-{digit(4)}", ""),
        "account": lambda: (r.choice(["iban ", "account ", "bank transfer ", ""]), f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{digit(2)} " + " ".join(digit(4) for _ in range(r.randint(4, 5))), ""),
        "credential": lambda: r.choice([("password=", hexa(18), ""), ('token = "', hexa(40), '"'), ("", r.choice(["AKIA", "ASIA"]) + r.choice([caps(16), "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))]), ""), ("pwd: ", mixed(r.randint(9, 20)), ""), ("secret: ", caps(24), ""), ("api_key=", hexa(32), ""), ("password=", caps(10).lower(), ""), ('secret = "', hexa(r.randint(65, 400)), '"'), (r.choice(["api_key=", "key: "]), mixed(r.randint(40, 400)), ""), (r.choice(["token=", "auth: "]), signed(), "")]),
    }
    bad = {
        "email": lambda: ("", f"{word()} (at) {word()}.{word()[:6]}", ""),
        "phone": lambda: (r.choice(["order ", "part ", "serial ", "isbn "]), f"{digit(3)}.{digit(3)}.{digit(4)}", ""),
        "id_number": lambda: (r.choice(["part ", "order ", "version ", "item "]), f"{r.choice(['000', '666', '9' + digit(2)])}-{digit(2)}-{digit(4)}", ""),
        "account": lambda: (r.choice(["part ", "build ", "serial "]), f"{caps(2)}{digit(2)} {caps(4)} {caps(4)} {caps(4)}", ""),
        "credential": lambda: r.choice([("note: ", word() + word(), ""), ("see: ", f"{word()}/{word()}.html", ""), ("commit ", hexa(40), ""), ("sha hash: ", hexa(64), ""), ('class="', word() + "-" + word(), '"'), ("x = ", word() + digit(1) + word(), ""), ("http:", f"//{word()}.{word()}.com", ""), ("Subject: ", word() + word()[:6], ""), ("revision = ", digit(8), ""), ("sha hash: ", hexa(128), ""), (r.choice(["see: ", 'href="']), path(r.randint(8, 60), "/"), ""), ("http:", f"//{word()}.{word()}.com/{path(r.randint(8, 60), r.choice('/-_'))}", ""), ("part: ", path(r.randint(8, 60), r.choice(".-_")), "")]),
    }
    out = []
    for _ in range(n):
        kind = r.choice(sorted(good))
        label = r.random() < 0.5
        cue, span, tail = (good if label else bad)[kind]()
        text = " ".join(word() for _ in range(r.randint(0, 6))) + " " + cue
        whole = text + span + tail + " " + " ".join(word() for _ in range(r.randint(0, 6)))
        out.append((whole, kind, len(text), len(text) + len(span), int(label)))
    return out


def held_out_candidates(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """As ``generated``, by other rules: sentences, settings and tables with other cues, words and look-alikes."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    digits, low, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    name = lambda: pick(low, r.randint(3, 10)).capitalize()
    filler = lambda: " ".join(pick("aeioulnrst", r.randint(1, 8)) for _ in range(r.randint(0, 9)))
    out = []
    while len(out) < n:
        kind, label = r.choice(("email", "phone", "id_number", "account", "credential")), int(r.random() < 0.5)
        if kind == "email":
            span = f"{pick(low, 5)}_{pick(low, 4)}{r.choice([' (AT) ', '{at}', '[at]'])}{pick(low, 7)}{r.choice([' [dot] ', '.', '{dot}'])}{r.choice(['co', 'info', 'edu', 'io'])}" if label else f"{name()} (at) {pick(low, r.randint(7, 11))}.{pick(low, r.randint(6, 9))}"
            cue, tail = r.choice(["e-mail: ", "", "reach me, "]) if label else r.choice(["meeting ", "", "we were "]), " "
        elif kind == "phone":
            a, b, c = pick(digits, 3), pick(digits, 3), pick(digits, 4)
            span = r.choice([f"({a}){b}-{c}", f"{a}-{b}-{c}", f"+1 {a}-{b}-{c}"]) if label else f"{a}.{b}.{c}"
            cue, tail = r.choice(["mobile: ", "sms to ", "", f"{name()}, "]) if label else r.choice(["figure ", "isbn ", "version ", "part no "]), "."
        elif kind == "id_number":
            span = f"{r.randint(101, 599)}-{pick(digits, 2)}-{pick(digits, 4)}" if label else f"{r.choice(['000', '666', '9' + pick(digits, 2)])}-{pick(digits, 2)}-{pick(digits, 4)}"
            cue, tail = r.choice(["SSN: ", "insurance no ", "social sec. ", "tax id "]) if label else r.choice(["page ", "serial ", "order no ", "item "]), ","
        elif kind == "account":
            body = " ".join(pick(digits, 4) for _ in range(r.randint(4, 5)))
            span = f"{r.choice(['NL', 'IT', 'CH', 'AT'])}{pick(digits, 2)} {body}" if label else f"{pick(upper, 2)}{pick(digits, 2)} " + " ".join(pick(upper + digits, 4) for _ in range(3))
            cue, tail = r.choice(["IBAN: ", "konto ", "pay to ", "transfer "]) if label else r.choice(["serial ", "build ", "part ", "item "]), ";"
        elif label:
            cue, span, tail = r.choice([("passwd=", pick(low + digits, 14), ""), ('"token": "', pick("0123456789abcdef", r.choice([32, 48, 300])), '"'), ("key=", pick(low + upper + digits, r.choice([24, 90, 260])), ""), ("", "ASIA" + pick(upper + digits, 16), ""), ("auth: ", f"eyJ{pick(low + upper, 18)}.eyJ{pick(low + upper + digits, r.randint(60, 400))}.{pick(low + upper + digits, 40)}", "")])
        else:
            cue, span, tail = r.choice([("Title: ", pick(low, r.randint(8, 14)), ""), ("url=", f"//{pick(low, 8)}.{pick(low, 3)}/{pick(low, 6)}/{pick(low, 9)}", ""), ("revision: ", pick("0123456789abcdef", 40), ""), ("sha: ", pick("0123456789abcdef", 64), ""), ("name='", pick(low, 6) + "_" + pick(low, 6), "'"), ("id: ", pick(digits, 9), ""), ("ratio: ", pick(digits, 2) + "." + pick(digits, 6), "")])
        text = f"{filler()} {cue}"
        out.append((f"{text}{span}{tail} {filler()}", kind, len(text), len(text) + len(span), label))
    return out


class Model:
    """Trees, and for each kind a curve from scores to probabilities and a threshold."""

    def __init__(self, trees: Trees, curves: dict[str, tuple[float, float]], limits: dict[str, float]) -> None:
        self.trees, self.curves, self.limits = trees, curves, limits

    def probabilities(self, texts: list[str], found: list[tuple[str, int, int]]) -> np.ndarray:
        score = self.trees.score(np.array([features(t, *c) for t, c in zip(texts, found, strict=True)]))
        slope, offset = (np.array([self.curves[k][i] for k, _, _ in found]) for i in (0, 1))
        return 1 / (1 + np.exp(-np.clip(slope * score + offset, -30, 30)))


@lru_cache(maxsize=1)
def model(n: int = 3000, seed: int = 7) -> Model:
    """Trees of generated candidates, calibrated on those of the other generator."""
    made, held = generated(n, seed), held_out_candidates(n, seed + 1)
    numbers = lambda rows: np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    trees = Trees().fit(numbers(made), np.array([m[4] for m in made], dtype=float))
    score, truth, kinds = trees.score(numbers(held)), np.array([m[4] for m in held], dtype=float), np.array([m[1] for m in held])
    curves, limits = {}, {}
    for kind in sorted(set(kinds.tolist())):
        own = kinds == kind
        slope, offset = curves[kind] = logistic(score[own], truth[own])
        p = 1 / (1 + np.exp(-np.clip(slope * score[own] + offset, -30, 30)))
        order = np.argsort(-p, kind="stable")
        p, right = p[order], np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        # A cut never parts equal probabilities.
        enough = [i for i in np.flatnonzero(right >= TARGET_PRECISION).tolist() if i + 1 == len(p) or p[i + 1] < p[i]]
        limits[kind] = math.inf if not enough else float((p[enough[-1]] + (p[enough[-1] + 1] if enough[-1] + 1 < len(p) else 0.0)) / 2)
    return Model(trees, curves, limits)


class Taken:
    """Disjoint runs of places that are spoken for."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Whether a run is free; it is taken then."""
        at = bisect.bisect_right(self.starts, a)
        if (at and self.ends[at - 1] > a) or (at < len(self.starts) and self.starts[at] < b):
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def selected(text: str, base: list[tuple[str, int, int]], how: Model) -> list[tuple[str, int, int]]:
    """Candidates that the trees select: none overlaps a base span or a more probable one."""
    found = candidates(text)
    if not found:
        return []
    p, taken = how.probabilities([text] * len(found), found), Taken([(a, b) for _, a, b in base])
    ranked = sorted(range(len(found)), key=lambda k: (-p[k], found[k][1], found[k][2], found[k][0]))
    return [found[k] for k in ranked if p[k] >= how.limits[found[k][0]] and taken.take(found[k][1], found[k][2])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def found(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (and the redacted text if asked for)."""
    bounded_batches(docs.sparkSession)
    how = model()
    nothing = hashlib.sha256(b"").hexdigest()

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "redacted")}
                for t in batch.column("text").to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    more = selected(t, base, how)
                    kinds = Counter(k for k, _, _ in base)
                    for k in BASE:
                        out[f"n_{k}"].append(kinds[k])
                    out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing)
                    out["spans"].append(joined(base + more))
                    out["n_spans"].append(len(base) + len(more))
                    out["redacted"].append(redact(t, base + more) if redacted else None)
                columns = [batch.column("doc_id")] + [pa.array(out[f"n_{k}"], pa.int64()) for k in BASE] + [pa.array(out[c], pa.int64() if c == "n_spans" else pa.string()) for c in ("base_sha256", "spans", "n_spans", "redacted")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string")
    return out if redacted else out.drop("redacted")

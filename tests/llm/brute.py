"""Brute-force versions of the corpus operators over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(CASE))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple]) -> dict:
    """{(doc_id, text): (set size, component)} by comparing every pair."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {docs[i]: (len(sets[i]), least.get(root(i))) if sets[i] else (0, docs[i][0]) for i in range(len(docs))}


def quality_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def lm_base(docs: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    tokens = [(d, [*words(t), None]) for d, t in docs]
    count = Counter(x for d, w in tokens if not out(d) for x in w)
    n, v = sum(count.values()), len(count)
    score = lambda w: sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
    return [(d, out(d), len(w), sum(count[x] > 0 for x in w), n, score(w)) for d, w in tokens]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

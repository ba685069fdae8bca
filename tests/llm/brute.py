"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(LOWER)


def repeats(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept digest) of (doc_id, text) rows."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def decontaminate(docs, items, window=10):
    """doc_id -> (n_words, n_hit, item ids)."""
    index = {}
    for item, text in items:
        words = PLAIN_WORD.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else ():
            index.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = sorted({len(k) for k in index})
    out = {}
    for doc, text in docs:
        words = PLAIN_WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                got = index.get(tuple(words[i : i + size]))
                if got:
                    found |= got
                    hit.update(range(i, i + size))
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def shingles(text, k):
    words = SPACE_WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(docs, k=3, percent=90):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    top = {d: d for d in ids}

    def find(d):
        while top[d] != d:
            top[d] = top[top[d]]
            d = top[d]
        return d

    by_shingle = {}
    for d in ids:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    for d in ids:
        if not sets[d]:
            continue
        shared = Counter(e for s in sets[d] for e in by_shingle[s] if e < d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def surviving_lines(docs, percent=80):
    """doc_id -> text without the lines that an earlier line matches."""
    earlier, by_word, out = [], {}, {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            words = set(SPACE_WORD.findall(line))
            if words:
                shared = Counter(e for w in words for e in by_word.get(w, ()))
                match = any(100 * n >= percent * (len(words) + len(earlier[e]) - n) for e, n in shared.items())
                for w in words:
                    by_word.setdefault(w, []).append(len(earlier))
                earlier.append(words)
                if match:
                    continue
            kept.append(line)
        out[doc] = "\n".join(kept) if text is not None else None
    return out


def quality(text, window=5):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [line for line in text.split("\n") if SPACE_WORD.search(line)]
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    counts = Counter(runs)
    hit = {i + j for i, r in enumerate(runs) if counts[r] > 1 for j in range(window)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(hit),
    )


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 10 == 0


class KneserNey:
    """Interpolated modified Kneser-Ney model by plain dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter(g for t in texts for g in self.grams(t))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount = {k: self.discounts(Counter(c.values())) for k, c in self.counts.items()}

    def grams(self, text):
        words = ["<s>"] * (self.order - 1) + (text or "").split() + ["</s>"]
        return [tuple(words[i : i + self.order]) for i in range(len(words) - self.order + 1)]

    @staticmethod
    def discounts(n):
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(k, max(0, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3)]

    def probability(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.counts[1]) + 1)
        after = [n for g, n in self.counts[k].items() if g[:-1] == gram[:-1]]
        lower = self.probability(gram[1:])
        if not after:
            return lower
        d = self.discount[k]
        n = self.counts[k][gram]
        direct = max(n - d[min(n, 3)], 0)
        return (direct + sum(d[min(a, 3)] for a in after) * lower) / sum(after)

    def score(self, text):
        return sum(math.log10(self.probability(g)) for g in self.grams(text))

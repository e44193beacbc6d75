"""Plain single-process versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    repeat = len(covered)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat, "base_failed": len(w) < 50 or 100 * repeat > 50 * len(w),
    }


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for k, (pattern, fine) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if fine(m[0])]
    names = ["email", "ip", "card", "phone"]
    return [sum(k == i for _, k, _ in out) for i in range(4)], ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out))


def repeats(texts, window=35):
    """(n_words, n_removed, kept_sha256) per text."""
    docs = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, size=5):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w)} - {()} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(ids, texts):
    """The smallest id linked with each row's id, by all pairs with a common shingle."""
    sets = [shingles(t) for t in texts]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[top(i)] = top(j)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(ids[i], least.get(top(i), ids[i]))
    return [(len(s), least[top(i)]) for i, s in enumerate(sets)]


def nearest(ids, vectors, queries, k=5):
    x = np.asarray(vectors, np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = [(round(-s[i], 12), ids[i]) for i in range(len(ids)) if ids[i] != q]
        out[q] = [v for _, v in sorted(order)[:k]]
    return out


def word_bits(trained: dict[str, list[str]], asked: list[str]) -> list[list[float]]:
    """Bits of each word under each language's interpolated Kneser-Ney model of order 4, in dicts of strings."""
    import math

    def grams(word):
        s = f"\x02{word}\x03"
        return [[(s[max(0, i - k + 1) : i + 1], s[max(0, i - k + 1) : i]) for k in range(1, 5)] for i in range(1, len(s))]

    models, letters = [], set()
    for lang in sorted(trained):
        n, ends = [{} for _ in range(4)], [{} for _ in range(4)]
        for word in trained[lang]:
            for found in grams(word):
                n[3][found[3]] = n[3].get(found[3], 0) + 1
                for k in range(3):
                    ends[k].setdefault(found[k], set()).add(found[k + 1])
        for k in range(3):
            n[k] = {g: len(e) for g, e in ends[k].items()}
        total, kinds = [{} for _ in range(4)], [{} for _ in range(4)]
        for k in range(4):
            for (_, context), m in n[k].items():
                total[k][context] = total[k].get(context, 0) + m
                kinds[k][context] = kinds[k].get(context, 0) + 1
        letters |= {g for g, _ in n[0]}
        models.append((n, total, kinds))
    out = []
    for word in asked:
        out.append([])
        for n, total, kinds in models:
            bits = 0.0
            for found in grams(word):
                p = 1 / (max(2, len(letters)) + 1)
                for k, (gram, context) in enumerate(found):
                    t = total[k].get(context)
                    if t:
                        p = max(n[k].get((gram, context), 0) - 0.75, 0) / t + min(0.75 * kinds[k][context] / t, 1) * p
                bits -= math.log2(p)
            out[-1].append(bits)
    return out

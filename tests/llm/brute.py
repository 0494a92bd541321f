"""Plain, slow versions of the contracts."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    n_lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    repeat = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(n_lines) - len(set(n_lines)), len(repeat), failed


def substring(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(rows, window=100):
    data = sorted((doc, (t or "").encode()) for doc, t in rows)
    first = {}
    for doc, b in data:
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], (doc, i))
    out = []
    for doc, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (doc, i):
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(FOLD))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(rows, percent=85, size=3):
    sets = [shingles(t, size) for _, t in rows]
    root = {doc: doc for doc, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return [(doc, len(s), find(doc), find(doc) == doc) for (doc, _), s in zip(rows, sets)]


def edit_distance(pattern, text):
    """Least distance of pattern to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def least_distance(pattern, text):
    """As edit_distance, a row at a time."""
    at = np.arange(len(text) + 1)
    codes = np.array([ord(c) for c in text], dtype=np.int64)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(pattern, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - at) + at
    return int(row.min())


def posteriors(texts, domains, bucket, buckets, prior, sharpness):
    """Domain posteriors of each text: shrunk naive Bayes over buckets of words, labels' priors, roots of lengths."""
    count = np.zeros((4, buckets))
    for t, d in zip(texts, domains):
        for w in WORD.findall(t or ""):
            if d is not None:
                count[d, bucket[w]] += 1
    total, seen = count.sum(), np.bincount([d for d in domains if d is not None], minlength=4)
    log_p = np.log((count + prior * (count.sum(axis=0) + 1) / (total + buckets)) / (count.sum(axis=1, keepdims=True) + prior))
    ratio = np.round((log_p - log_p[0]) * 1e6) * (count.sum(axis=0) > 0)
    out = []
    for t in texts:
        words = WORD.findall(t or "")
        z = sum((ratio[:, bucket[w]] for w in words), np.zeros(4)) / 1e6 / math.sqrt(max(len(words), 1)) * sharpness
        e = np.exp(np.minimum(60, z + np.log((seen + 1) / (seen[0] + 1))))
        out.append(e / e.sum())
    return np.array(out)


def rates(p, n, want, steps=50, tolerance=1e-4):
    """Projected gradient on the squared gaps, scaled by their curvature."""
    n, r = np.asarray(n) / sum(n), np.ones(len(n))
    for _ in range(steps):
        gap = (n * r) @ p - want
        if np.abs(gap).max() < tolerance:
            break
        on = r > 0
        move, size = np.linalg.solve((p[on] * n[on][:, None]).T @ p[on] + 1e-9 * np.eye(4), gap), 1.0
        while np.linalg.norm((n * np.maximum(0, r - p @ (size * move))) @ p - want) > (1 - 1e-4 * size) * np.linalg.norm(gap):
            size /= 2
        r = np.maximum(0, r - p @ (size * move))
    return r

"""Plain versions of the pipeline's stages, on lists of (doc_id, text)."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np

from siftgauge.llm import op2_quality as q

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    t, w = text or "", words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in q.SYMBOLS for c in t), "n_symbol_runs": len(re.findall(r"[#*$%&|<>]+", t)),
        "n_odd": sum(c in q.ODD for c in t), "n_ends": len(re.findall(r'[.!?]+[ \t-\r"]|[.!?]\Z', t)), "n_upper": sum("A" <= c <= "Z" for c in t),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}),
    }


def votes(c):
    out = []
    for _, part, whole, low, good_from, good_to, high in q.RULES:
        share = c[part] / c[whole] if c[whole] else None
        out.append(0 if share is None else -1 if share < low or share > high else 1 if good_from is not None and good_from <= share <= good_to else 0)
    return out


def odds(v, prior, right):
    return 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right)))))


def em(rows):
    """(prior, accuracies) after the steps of expectation and maximisation over all rows' votes."""
    clamp = lambda x, a, b: min(b, max(a, x))
    prior, right = q.START_PRIOR, [q.START_RIGHT] * len(q.RULES)
    for _ in range(q.STEPS):
        p = [odds(v, prior, right) for v in rows]
        agree = lambda j: sum(x if v[j] == 1 else 1 - x if v[j] == -1 else 0 for v, x in zip(rows, p))
        new = [clamp((agree(j) + q.PSEUDO) / (sum(v[j] != 0 for v in rows) + 2 * q.PSEUDO), q.LEAST_RIGHT, q.MOST_RIGHT) for j in range(len(right))]
        prior, right = clamp((sum(p) + q.PSEUDO) / (len(rows) + 2 * q.PSEUDO), q.LEAST_PRIOR, q.MOST_PRIOR), new
    return prior, right


def kept(texts):
    found = [counts(t) for t in texts]
    rows = [votes(c) for c in found]
    model = em(rows)
    return [not (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]) and odds(v, *model) >= 0.5 for c, v in zip(found, rows)]


def one_of_each(docs, width=5, percent=80):
    sets = []
    for _, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for k, d in enumerate(docs):
        groups.setdefault(find(k) if sets[k] else ("none", *d), []).append(d)
    return [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]


def without_repeats(docs, width=200):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    out = []
    for (i, t), b in zip(docs, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append((i, None if t is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def clean(docs, bench, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item, t in bench:
        own = split(t)
        if item is not None and own:
            n = min(width, len(own))
            grams.setdefault(n, set()).update(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
    return [d for d in docs if not any(tuple(w[k : k + n]) in g for w in [split(d[1])] for n, g in grams.items() for k in range(len(w) - n + 1))]

"""Fixtures for the corpus operators: awkward documents and plain brute force."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, rest string, component_id string"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); further columns have clashing names."""
    full = [(*r, *[None] * (4 - len(r)), 0, 0.5, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [rng.choice(vocabulary) for _ in range(n)]


def awkward():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(prose(1, 30000))
    base = prose(2, 120)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:60] + prose(3, 60)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, long), (5, " ".join(base)), (6, "  ".join(w.upper() for w in base)), (7, " ".join(near)),
        (8, " ".join(far)), (9, "one two"), (10, "ONE two"), (11, "one two three four five"), (12, "é ÀÉ \U0001f600 ß"), (12, "é ÀÉ \U0001f600 ß"),
        (13, "\x00\x01 \x7f ok"), (None, "one two"), (14, long + " end"), (15, "1234 !!! ..."),
    ]


def jaccard_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width=5):
    w = jaccard_words(text)
    if len(w) >= width:
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def components(rows, percent=80):
    """doc_id -> (set size, least doc_id reachable)"""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}

"""Brute-force versions and awkward tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators add.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, score string, _text string, _key string, rank string, set string, n string"


def table(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, texts):
    rows = [(i, t, "en", None if i % 2 else "s", 0, *["x"] * 8) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


def prose(random, n, vocabulary=4000):
    return " ".join(f"w{random.randrange(vocabulary)}" for _ in range(n))


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOW))
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)] if w else [])


def groups(texts, k, threshold=80):
    """The smallest index reachable from each text over links of the threshold in per cent."""
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def covered(texts, length):
    """For each text, which bytes lie in a string of length bytes that starts elsewhere too."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out

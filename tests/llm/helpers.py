"""Fixtures of awkward documents, and plain-Python versions of the operators."""

import hashlib
import random
import re

CLASH = ["row", "digest", "n", "bucket", "range", "node", "size", "copies", "start", "hits", "score", "_id", "anchor", "text_sha256"]


def frame(spark, rows):
    """doc_id, text and columns whose names the operators use inside."""
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(*r, *[7] * len(CLASH)) for r in rows], schema)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "or", "ing", "ti", "sh", "ou", "ñe", "ß"]) for _ in range(r.randint(1, 5))) for _ in range(n))


def awkward():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    return [
        (1, base), (2, base), (3, "  ".join(words)), (4, near), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "One"),
        (10, prose(2, 6000)), (11, prose(3, 90) + "\n" + base), (12, "日本語 テキスト é\u0085x y"), (13, "a\n\nA \nb"),
        (None, base), (None, "no id"), (14, base), (14, base), (14, "another text"), (15, "x" * 5000), (16, " " * 900), (17, base + " " + base)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k):
    w = words_of(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def cut_repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha) by comparing all strings of ``length`` bytes."""
    raws, seen = [(t or "").encode() for t in texts], {}
    for b in raws:
        for k in range(len(b) - length + 1):
            seen[b[k:k + length]] = seen.get(b[k:k + length], 0) + 1
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def groups(docs, k, percent):
    """Component of each row by comparing all pairs; None stands for the largest id."""
    big = 1 << 62
    sets = [(big if i is None else i, shingles(t, k)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, s) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), big), doc)
    return [(doc if doc < big else None, len(s), (lambda c: None if c == big else c)(least[find(i)])) for i, (doc, s) in enumerate(sets)]

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import prose, sha, words_of
from lendscope.llm import digests, phrases, trie, whitening


# ---------------------------------------------------------------- digests
def test_joined_digests_of_groups_of_any_size(spark):
    rows = [(k.encode(), v) for k, n in (("a", 1), ("b", 2), ("hot", 30_000), ("z", 7)) for v in range(-3, n - 3)]
    random.Random(1).shuffle(rows)
    got = {bytes(r.key): (r.n, r.sha256) for r in digests.joined_sha256(spark.createDataFrame(rows, "key binary, value long")).collect()}
    for k, n in (("a", 1), ("b", 2), ("hot", 30_000), ("z", 7)):
        assert got[k.encode()] == (n, sha(",".join(map(str, range(-3, n - 3)))))
    text = spark.createDataFrame([(b"k", v) for v in ("9", "10", "é", "")], "key binary, value string")
    assert digests.joined_sha256(text).first().sha256 == sha(",10,9,é")
    assert digests.joined_sha256(text.limit(0)).count() == 0


# ---------------------------------------------------------------- whitening
def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.arange(1.0, 41.0), np.geomspace(1e-3, 1e3, 30), [5, 5, 5, 2, 2, 1], [1 + 1e-9, 1, 1 - 1e-9, 3, 3 + 1e-8, 0.5],
    np.concatenate((1 + 1e-7 * np.arange(10), [2, 3])), [4, 0, 0, 0], [0, 0], [7.0]])
def test_refinement_reaches_double_precision(values):
    a = symmetric(values)
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    value, vector = whitening.refine(a, rough)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(value - np.sort(values)).max() <= 1e-13 * size
    assert np.abs(vector.T @ vector - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vector - vector * value).max() <= 1e-13 * size
    if size > 1:  # the float32 vectors alone are far from it
        assert np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max() >= np.abs(a @ vector - vector * value).max()


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, n int, x int, component int")


def check_whitened(out, rows, components=4):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows
            if v and None not in v and np.isfinite(np.array(v, float)).all()]
    fit = np.unique(np.stack([x for _, x in rows]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, w = np.linalg.eigh(z.T @ z / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(components, fit.shape[1])
    assert len(out) == k * len(rows)
    deviation = defaultdict(set)
    for i, x in rows:
        deviation[i].add(sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)))
    for r in out:
        assert r.n == n and r.deviation in deviation[r.vec_id]
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-12 and r.identity_error < 1e-10
    for c in range(k):
        want = sorted((i if i is not None else -1, x) for i, x in ((i, float((v - s / n) @ w[:, c] / math.sqrt(e[c]))) for i, v in rows))
        got = sorted((r.vec_id if r.vec_id is not None else -1, r.whitened) for r in out if r.component == c + 1)
        flipped = sorted((i, -x) for i, x in got)
        assert min(max(abs(a[1] - b[1]) for a, b in zip(want, g)) for g in (got, flipped)) < 1e-9


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 9)) * np.linspace(3, 0.3, 9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(400 + i, rows[0][1]) for i in range(150)] + [rows[1], (None, rows[2][1])]
    awkward = [(900, None), (901, []), (902, [None] + rows[0][1][1:]), (903, [float("nan")] + rows[0][1][1:]), (904, [float("inf")] + rows[0][1][1:])]
    out = whitening.whiten(embeddings(spark, rows + awkward)).collect()
    check_whitened(out, rows)
    assert out[0].n == 300
    check_whitened(whitening.whiten(embeddings(spark, [(i, v[:3]) for i, v in rows])).collect(), [(i, v[:3]) for i, v in rows])


def test_whitening_without_spread_and_rows(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None), (2, [])])).count() == 0
    out = whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(out) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in out)
    line = whitening.whiten(embeddings(spark, [(i, [float(i), float(i)]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in line)
    with pytest.raises(ValueError):
        whitening.whiten(embeddings(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(ValueError):
        whitening.whiten(embeddings(spark, [(1, [3e38]), (2, [1.0])]))


# ---------------------------------------------------------------- trie
def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "conv_id long, turn long, role string, text string, id int, i int, part int, n int")


def trie_of(rows):
    """Plain-Python nodes: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, sha)."""
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            told[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    told = {c: [t for _, t in sorted(v)] for c, v in told.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built = told.get(base, [])[:h] + own[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = {q[:-1] for q in members if q}
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
                    sum(q not in kids for q in below), sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q),
                    sha(",".join(map(str, sorted(ends[p]))))))
    return sorted(out, key=repr)


def told(out):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out), key=repr)


def conversations(seed=3):
    r = random.Random(seed)
    starts = [[("user", prose(s, 5)), ("assistant", prose(s + 50, 9)), ("user", prose(s + 90, 3))] for s in range(3)]
    rows = []
    for c in [*range(0, 45), 100, 107, 113, 10**12, 10**12 + 7]:
        said = starts[r.randrange(3)][:r.randrange(4)] + [("user", f"w{r.randrange(2)} x") for _ in range(r.randrange(9))]
        rows += [(c, 10 * i, *t) for i, t in enumerate(said)]
    rows += [(200 + c, i, "user", f"the {i}") for c in range(60) for i in range(5)]
    rows += [(3, None, "user", "first"), (3, None, None, None), (None, 1, "user", "nobody"), (5, 0, "user", "tie"), (5, 0, "user", "tie"),
             (5, 0, "system", "tie"), (6, 99, "user", ""), (8, 2, "user", "x " * 200_000), (9, 0, "us", "er"), (9, 1, "user", ""), (-7, 1, "user", "a b"),
             (118, 1, "user", "one turn")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 3, 4, 16])
def test_trie_against_plain_python(spark, height):
    rows = conversations()
    assert told(trie.prefix_trie(turns(spark, rows), height).collect()) == trie_of(rows)


def test_bands_of_bands(spark):
    rows = [(c, i, "u", f"{min(i, c)}") for c in range(21, 30) for i in range(33)]
    assert told(trie.prefix_trie(turns(spark, rows), height=2).collect()) == trie_of(rows)


def test_trie_of_one_turn_none_and_a_hot_conversation(spark):
    assert trie.prefix_trie(turns(spark, [])).count() == 0
    assert trie.prefix_trie(turns(spark, [(None, 1, "user", "x")])).count() == 0
    gone = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    for rows in ([(gone, 1, "user", "cut away")], [(0, 1, "user", "x y")], [(7, i, "u", str(i % 3)) for i in range(400)] + [(8, 0, "u", "0")]):
        assert told(trie.prefix_trie(turns(spark, rows)).collect()) == trie_of(rows)


def test_turns_of_a_long_conversation_lie_in_many_partitions(spark):
    rows = [(1, i, "u", "t") for i in range(4000)] + [(c, i, "u", "t") for c in range(2, 40) for i in range(3)]
    random.Random(2).shuffle(rows)
    got = trie.numbered_turns(turns(spark, rows).repartition(6)).groupBy("conv_id").agg({"i": "sum", "*": "count"}).collect()
    assert {r.conv_id: r["sum(i)"] for r in got} == {1: 4000 * 4001 // 2, **{c: 6 for c in range(2, 40)}}


# ---------------------------------------------------------------- phrases
def terms_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits(docs, items, length):
    windows = defaultdict(set)
    for item, text in items:
        w = terms_of(text)
        for i in range(max(len(w) - length, 0) + 1 if w else 0):
            windows[tuple(w[i:i + length])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = terms_of(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def table(spark, rows, name):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], f"{name} long, text string, key int, term int, pos int, window int, n int")


def leaks():
    p = [prose(s, 40) for s in range(6)]
    items = [(i, t) for i, t in enumerate(p)] + [(10, "Short, one!"), (11, "x"), (12, None), (13, ""), (14, "... !"), (None, prose(70, 12)),
                                                 (15, p[0]), (15, p[1][:90]), (16, "a a a a a a a a a a a a"), (2, "second row of two"), (9, "é É ñ 日本")]
    w = p[2].split(" ")
    docs = [(1, p[0]), (2, prose(99, 300)), (3, prose(98, 50) + " " + " ".join(w[5:15]) + ". " + prose(97, 50)), (4, " ".join(w[5:14])),
            (5, None), (6, ""), (7, "short ONE? x"), (8, "a " * 37), (9, "x-x"), (10, " ".join(reversed(w))), (11, p[3].upper().replace(" ", "--") + " " + p[4]),
            (12, "é É ñ 日本 é é"), (None, p[0]), (None, None), (13, "second row of two"), (13, "x"), (13, "x"), (14, prose(70, 12)),
            (15, " ".join(prose(s, 3000) for s in range(20, 40)) + " " + p[5] + " " + prose(1, 4000) + " " + " ".join(w)),
            (16, " ".join(w[0:12] + w[6:18])), *[(100 + i, prose(60, 30) + " " + p[1]) for i in range(50)]]
    return docs, items


@pytest.mark.parametrize("length", [1, 3, 10])
def test_decontamination_against_plain_python(spark, length):
    docs, items = leaks()
    out = phrases.decontaminate(table(spark, docs, "doc_id"), table(spark, items, "item_id"), length).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=repr) == hits(docs, items, length)


def test_decontamination_of_empty_tables(spark):
    docs, items = leaks()
    assert phrases.decontaminate(table(spark, [], "doc_id"), table(spark, items, "item_id")).count() == 0
    clean = phrases.decontaminate(table(spark, docs, "doc_id"), table(spark, [], "item_id")).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_items or r.n_hit for r in clean)


def test_proximity_against_plain_python(spark):
    docs, items = leaks()
    docs = [d for d in docs if d[0] != 15]
    d, b = table(spark, docs, "doc_id"), table(spark, items, "item_id")
    terms = phrases.vocabulary(b)
    index = phrases.positional_index(d, terms)
    windows, _ = phrases.item_windows(b, 4)
    plans = phrases.lookups(windows, terms, index)
    told = {r.window: (tuple(r.words), r.term) for r in windows.join(plans, "window").selectExpr("window", "words", "plan[0].term").withColumnRenamed(
        "plan[0].term", "term").collect()}
    name = {r.term: r.word for r in terms.collect()}
    for within in (3, 12):
        got = {(bytes(r.key), bytes(r.window), r.pos) for r in phrases.proximity_matches(index, plans, within).collect()}
        want = set()
        for text in {t for _, t in docs}:
            w, key = terms_of(text), hashlib.sha256((text or "").encode()).digest()[:16]
            for g, (ws, rarest) in told.items():
                for i, x in enumerate(w):
                    if x == name[rarest] and set(ws) - {x} <= set(w[max(0, i - within):i + within + 1]):
                        want.add((key, bytes(g), i))
        assert got == want

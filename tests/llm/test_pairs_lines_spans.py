import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, cut_repeats, frame, groups, prose, sha, shingles
from lendscope.llm import bwt, components, fingerprint, lines, mphf, suffix_dedup, superminhash
from lendscope.llm.shingles import Shingler, distinct


def test_shingles_match_python_sets():
    texts = [t or "" for _, t in awkward()]
    for k in (1, 2, 5):
        h, owner = distinct(*Shingler(k)([t.encode() for t in texts]))
        assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t, k)) for t in texts]


def test_words_made_to_collide_modulo_a_power_of_two(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))  # Thue-Morse and its complement
    two = one.translate(str.maketrans("ab", "ba"))
    h, _ = Shingler(1)([one.encode(), two.encode()])
    assert h[0] != h[1]
    out = superminhash.near_duplicates(frame(spark, [(1, one), (2, two), (3, one + " x"), (4, two + " x")]), 2, 80).collect()
    assert all(r.kept for r in out)
    words = [f"w{i}" for i in range(200_000)]
    assert len(set(Shingler(1)([" ".join(words).encode()])[0].tolist())) == len(words)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    for shared in (0, 40, 150, 300):
        pool = rng.integers(0, 1 << 63, 600 - shared, dtype=np.uint64)
        a, b = np.sort(pool[:300]), np.sort(pool[300 - shared:])
        sig = superminhash.signatures(np.concatenate((a, b)), np.repeat([0, 1], 300), 2)
        assert abs((sig[0] == sig[1]).mean() - shared / (600 - shared)) < 0.12
    one = superminhash.signatures(np.array([5], np.uint64), np.array([0]), 1)
    assert len(set((one[0] >> np.uint64(32)).tolist())) == superminhash.PLACES  # a permutation


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent):
    rows = awkward()
    base = prose(9, 200).split(" ")
    for n in range(40):  # a chain: each near the next, the ends far apart
        rows.append((200 + n, " ".join(base[:100] + [f"w{m}" for m in range(n)] + base[100 + n:])))
    out = superminhash.near_duplicates(frame(spark, rows), k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(groups(rows, k, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(400) > p], rng.integers(0, 1 << 63, int(400 * p)).astype(np.uint64)))) for p in rng.random(60)]
    got = superminhash.parities(np.concatenate(sets), np.repeat(np.arange(60), [len(x) for x in sets]), 60).view(np.uint64)
    for i in range(60):
        for j in range(i):
            bits = sum(int(x).bit_count() for x in got[i] ^ got[j])
            assert bits <= len(np.setxor1d(sets[i], sets[j]))
            assert bits % 2 == len(np.setxor1d(sets[i], sets[j])) % 2
    assert not superminhash.parities(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3).any()


def test_a_group_with_stragglers_keeps_every_link(spark):
    """Copies of one text, lightly and heavily edited: against all pairs."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = list(words)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            own[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(own)))
    out = superminhash.near_duplicates(frame(spark, rows), 2, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(groups(rows, 2, 80))
    assert 1 < len({r.component_id for r in out}) < 160


def test_near_duplicates_without_links_and_rows(spark):
    assert superminhash.near_duplicates(frame(spark, [])).count() == 0
    out = superminhash.near_duplicates(frame(spark, [(1, None), (2, ""), (3, "a b c")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {(1, 1, True), (2, 2, True), (3, 3, True)}


def test_drop_near_duplicates_keeps_columns(spark):
    docs = frame(spark, awkward())
    out = superminhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and {5, 6, 7, 12} <= {r.doc_id for r in out.collect()}


def test_rows_that_share_or_lack_an_id_are_dropped_by_their_own_text(spark):
    base = prose(5, 150)
    near = base.replace(" ", "  ", 3).replace(base.split(" ")[70], "changed", 1)
    rows = [(1, base), (14, near), (14, "another text"), (None, near), (None, "a unique one"), (20, "same row"), (20, "same row"), (21, "same row"),
            (30, base + " end"), (30, base + " fin"), (40, ""), (40, ""), (None, None), (50, prose(8, 100_000))]
    out = [(r.doc_id, r.text) for r in superminhash.drop_near_duplicates(frame(spark, rows)).collect()]
    want = [rows[i] for i in (0, 2, 4, 5, 10, 11, 12, 13)]
    assert Counter(out) == Counter(want)
    assert superminhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(1000, 3), (3, 1000), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 3: 3, 1000: 3}


def test_fingerprints(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 14] + [(300 + i, prose(i, 300)) for i in range(20)]
    out = {r.doc_id: r for r in fingerprint.fingerprint_documents(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        new = t[:len(t) - m] + following[:m]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(new))
        assert abs(r.near_edited - jaccard(shingles(t, 5), shingles(new, 5))) < 0.2
        assert abs(r.near_next - jaccard(shingles(t, 5), shingles(following, 5))) < 0.2
    assert out[1].fingerprint == out[2].fingerprint and out[5].fingerprint == out[6].fingerprint == ""
    assert fingerprint.fingerprint_documents(frame(spark, [])).count() == 0
    one = fingerprint.fingerprint_documents(frame(spark, [(4, "a b c d e f g")])).collect()[0]
    assert one.near_next == 1.0


def test_fingerprints_over_ranges_and_ties(spark, monkeypatch):
    rows = [(i % 90, prose(i, 30)) for i in range(120)] + [(None, "x y"), (None, "z")]
    whole = fingerprint.fingerprint_documents(frame(spark, rows)).collect()
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    cut = fingerprint.fingerprint_documents(frame(spark, rows)).collect()
    assert Counter(whole) == Counter(cut) and len(whole) == len(rows)


def test_densified_bins_agree_for_equal_sets():
    h = np.array([1 << 60, 5 << 58], np.uint64)
    low, filled = fingerprint.bin_minima(np.concatenate((h, h)), np.array([0, 0, 1, 1]), 2)
    dense = fingerprint.densify(low, filled)
    assert (dense[0] == dense[1]).all() and set(dense[0].tolist()) == set(h.tolist())


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 20_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        ph = mphf.PerfectHash.from_bytes(mphf.PerfectHash.build(a, b).to_bytes())
        assert sorted(ph.lookup(a, b).tolist()) == list(range(n))
        assert len(ph.bits) <= 0.8 * n + 64
    with pytest.raises(ValueError):
        mphf.PerfectHash.build(np.array([4, 4], np.uint64), np.array([1, 1], np.uint64))


def test_line_dedup(spark, monkeypatch):
    rows = awkward() + [(400 + i, f"  Common LINE\t\nown {i}\n\ncommon line\n{'rare' if i < 9 else 'x'}") for i in range(12)]
    rows += [(500 + i, None) for i in range(12)]

    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    want = Counter()
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or found[key(x)] < 10]
        want[i, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    for keys, probes in ((100_000, 200_000), (5, 3)):  # one shard; many shards with copies
        monkeypatch.setattr(lines, "SHARD_KEYS", keys)
        monkeypatch.setattr(lines, "PROBE_ROWS", probes)
        out = lines.drop_common_lines(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out) == want
    assert lines.drop_common_lines(frame(spark, [])).count() == 0


def test_merged_transforms_find_repeats():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, length = int(rng.integers(1, 60)), int(rng.integers(2, 7))
        texts = [rng.integers(0, 2, int(rng.integers(length, 25)), dtype=np.uint8).tobytes() for _ in range(n)]
        offsets = np.array([int(rng.integers(0, len(t))) for t in texts])
        for rows in (4096, 7):
            got = [set(x.tolist()) for x in bwt.repeated_starts(texts, offsets, length, rows)]
            seen = Counter((k - o, t[k:k + length]) for t, o in zip(texts, offsets) for k in range(len(t) - length + 1))
            assert got == [{k for k in range(len(t) - length + 1) if seen[k - o, t[k:k + length]] > 1} for t, o in zip(texts, offsets)]


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeated_spans(spark, crowd):
    passage = prose(77, 70)
    rows = awkward() + [(600 + i, prose(i, 40) + " " + passage[i:] + prose(i + 50, 40)) for i in range(12)]
    rows += [(700, "ab" * 400), (701, "ab" * 150 + "c" + "ab" * 150), (702, "z" * 199), (703, "z" * 199), (704, "y" * 200)]
    out = suffix_dedup.repeated_spans(frame(spark, rows), anchor_segments=crowd).collect()
    want = Counter((i, *r) for (i, _), r in zip(rows, cut_repeats([t for _, t in rows])))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    for r in out:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed and len(r.spans) == 2 * r.n_spans


def test_repeated_spans_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    text = prose(5, 400)
    rows = [(1, text), (2, "start " + text[100:1500] + " end"), (3, prose(6, 300))]
    out = suffix_dedup.repeated_spans(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == Counter(
        (i, *r) for (i, _), r in zip(rows, cut_repeats([t for _, t in rows])))
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_span_hash_is_of_the_other_bytes():
    assert hashlib.sha256(b"").hexdigest() == cut_repeats(["q" * 500])[0][3] and re.match("e3b0", cut_repeats(["q" * 500])[0][3])

import base64
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import awkward, frame, prose, sha
from lendscope.llm import bpe, exact, shard
from lendscope.session import work_path
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def norm(t):
    return sha(regex.sub(r"[\x20\x09-\x0D]+", " ", t or ""))


def test_exact_dedup_against_plain_python(spark):
    rows = awkward()
    out = exact.exact_dedup(frame(spark, rows)).collect()
    size = Counter(norm(t) for _, t in rows)
    least = {}
    for i, t in rows:
        least[norm(t)] = min(least.get(norm(t), 1 << 62), 1 << 62 if i is None else i)
    assert Counter((r.doc_id, r.text_sha256, r.group_size, r.keep_id) for r in out) == Counter(
        (i, norm(t), size[norm(t)], None if least[norm(t)] == 1 << 62 else least[norm(t)]) for i, t in rows)
    kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in out if r.kept]
    assert Counter(k for k, *_ in kept) == Counter(dict.fromkeys(size, 1)) and all(a == b for _, a, b in kept)


def test_exact_dedup_keeps_what_an_earlier_run_indexed(spark):
    path = work_path(spark, "digest-test")
    first = exact.DigestIndex(spark, path, 4)
    exact.exact_dedup(frame(spark, [(50, "seen"), (51, "other")]), first).collect()
    again = exact.DigestIndex(spark, path, 4)  # as a later session opens it
    out = {r.doc_id: r for r in exact.exact_dedup(frame(spark, [(1, "seen"), (2, "new"), (3, "new")]), again).collect()}
    assert not out[1].kept and out[1].keep_id == 50 and out[2].kept and not out[3].kept
    assert again.table().count() == 3
    plan = again.table().alias("a").join(again.table().alias("b").hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1]


def test_drop_copies_keeps_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter(norm(r.text) for r in out.collect()) == Counter({norm(t): 1 for _, t in rows})
    assert exact.drop_copies(frame(spark, [])).count() == 0 and exact.exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100, 1021])
def test_shards_are_a_gapless_permutation(spark, n):
    rows = [(i * 37, prose(i, 5)) for i in range(n)]
    out = shard.shuffled_shards(frame(spark, rows), 8).collect()
    assert len(out) == n
    sizes = Counter(r.shard for r in out)
    assert not n or max(sizes.values()) - min(sizes.get(k, 0) for k in range(8)) <= 1
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes.get(k, 0)))
    assert sorted(r.row_number for r in out) == list(range(n))


def test_shards_of_awkward_rows(spark):
    rows = awkward()
    out = shard.shuffled_shards(frame(spark, rows), 3).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in raw)
    again = shard.shuffled_shards(frame(spark, rows[::-1]).repartition(5), 3).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_feistel_in_plain_python(spark):
    def once(x, a, b, keys):
        x, y, mx, my = x // b, x % b, a, b
        for k in keys:
            t = (y * 48271 + k) % shard.PRIME
            x, y, mx, my = y, (x + t * t % shard.PRIME) % mx, my, mx
        return x * b + y
    import math
    for n in (1, 5, 12, 97):
        a = max(1, math.isqrt(n - 1) + 1)
        b = -(-n // a)
        want = []
        for x in range(n):
            p = once(x, a, b, shard.KEYS)
            while p >= n:
                p = once(p, a, b, shard.KEYS)
            want.append(p)
        got = [r.p for r in spark.range(n).select("id", F.expr(shard.permuted("id", n)).alias("p")).orderBy("id").collect()]
        assert got == want and sorted(got) == list(range(n))


def test_bpe_is_what_the_rank_file_says(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = awkward() + [(100 + i, t) for i, t in enumerate([
        "I'm don't THEY'LL 12345 ½ ²   \x1c\x1f᠎", "\U0001f600\U0001f468‍\U0001f469 é ́", "aaaa" * 300, "\t \n  \r\n x  ", "<|endoftext|>",
        "".join(chr(c) for c in range(1, 1500)), "supercalifragilisticexpialidocious" * 8])]
    out = bpe.encode_documents(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in rows:
        ids = b"".join(x.to_bytes(4, "little") for x in theirs.encode_ordinary(t or ""))
        want[i, len(ids) // 4, sha(ids), sha(t or "")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert bpe.encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_every_vocabulary_entry_comes_out_of_the_merges_or_whole():
    ranks = bpe.read_ranks(RANKS)
    model = bpe.Codec(bpe.serialise_model(ranks), ranks, public_tokenizers.PATTERN)
    assert model.decode(b"".join(r.to_bytes(4, "little") for r in range(len(ranks)))) == b"".join(sorted(ranks, key=ranks.get))
    for token, rank in list(ranks.items())[::97]:
        ids = model.sp.encode(bpe.mapped(token), out_type=int)
        assert b"".join(model.pieces[i] for i in ids) == token and (ids == [rank] or len(ids) > 1)


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0})

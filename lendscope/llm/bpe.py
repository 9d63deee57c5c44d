"""Byte-level BPE by a sentencepiece model made from a rank file.

No tokenizer is trained: every vocabulary entry becomes a piece whose bytes
are mapped to characters of their own and whose score is the negative rank, so
sentencepiece's merge order (best score, leftmost first) is the rank order.
The normaliser is the identity. Pre-tokens are cut by the vocabulary's own
pattern and encoded one by one; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import byte_slices, inner_id, outer_id, small_batches

#: Byte b stands as the character FIRST_CHAR + b: letters that no normaliser or piece marker touches.
FIRST_CHAR = 0x100
#: Distinct pre-tokens a task remembers; beyond that it starts afresh (a speed matter only).
REMEMBERED = 100_000
#: Text that a task encodes at a time.
SLICE_CHARS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}


# ---- the model file: protocol-buffer wire format, numbers of the public ModelProto
def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def mapped(b: bytes) -> str:
    return "".join(chr(FIRST_CHAR + x) for x in b)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece
    comes last and never occurs, as all 256 bytes are pieces."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[b] for b in order] != list(range(len(order))) or len(order) >= 1 << 24:
        raise ValueError("ranks must run from 0 without gaps, and stay exact as 32-bit floats")
    if missing := [x for x in range(256) if bytes([x]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    pieces = b"".join(_piece(mapped(b), -float(r), 1) for r, b in enumerate(order)) + _piece("<unk>", 0.0, 2)
    trainer = (_number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order))
               + b"".join(_number(f, -1) for f in (41, 42, 43)))  # BPE; unk id; no bos, eos, pad
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.chars = {x: FIRST_CHAR + x for x in range(256)}
        self.known: dict[str, bytes] = {}

    def _pack(self, token: str) -> bytes:
        raw = token.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.sp.encode(raw.decode("latin-1").translate(self.chars), out_type=int)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self._pack(t)
        long = {t: known.pop(t) for t in set(tokens) if len(t) > 200}  # not worth their memory
        return b"".join([long.get(t) or known[t] for t in tokens] if long else [known[t] for t in tokens])

    def decode(self, packed: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(packed, "<u4").tolist()])


_codecs: dict[str, Codec] = {}


def codec(model: bytes, ranks: dict[bytes, int], pattern: str, key: str) -> Codec:
    """One codec a worker process."""
    if key not in _codecs:
        _codecs[key] = Codec(model, ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens,
    ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256
    (of the bytes decoded from these ids) and, with ``ids``, the ids as binary.

    NULL and empty texts have no tokens. Rows are independent: repeated rows,
    NULL ids and an empty table need nothing special; other columns are not
    looked at. The vocabulary (about 1 MB, whatever the input) goes to the
    tasks with the function.
    """
    ranks = read_ranks(rank_file)
    model = serialise_model(ranks)
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((model, ranks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(*shared.value, pattern, key)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_CHARS):
                packed = [c.encode(t) if t else b"" for t in part["text"]]
                out = {"doc_id": part["doc_id"], "n_tokens": [len(p) // 4 for p in packed],
                       "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                       "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in packed]}
                yield pd.DataFrame(out | ({"ids": packed} if ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    small_batches(docs.sparkSession)
    rows = docs.select(inner_id().alias("doc_id"), "text")
    return rows.mapInPandas(run, schema).withColumn("doc_id", outer_id(F.col("doc_id")))

"""Merging Burrows-Wheeler transforms of aligned segments, with NumPy.

Segments are rows of a matrix, aligned at their anchor; suffixes start in a
column. Going from the last column to the first, the order of the suffixes of
a column is the stable sort, by one character, of the order one column to the
right: the characters read in that order are the column's transform. A shard
of rows keeps its own transform. To merge shards only the interleave is
refined, column by column: which shard the next suffix comes from. The common
prefix of neighbours follows from that of the column before (one more where
the new characters agree, nothing where not), so no suffix is ever compared
or sorted again.
"""

from __future__ import annotations

import numpy as np

SHARD_ROWS = 4096
#: Stands where a row has no text: a byte that UTF-8 never holds, so that such rows never come between others.
NOTHING = 255


class ShardTransform:
    """Orders and transform of one shard's rows (uint8 matrix)."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        self.order = np.empty((width, n), np.int32)  # by column: the rows in the order of their suffixes
        self.chars = np.empty((width, n), np.uint8)  # by column: what stands there, in the order of the column after
        now = np.arange(n, dtype=np.int32)
        for j in range(width - 1, -1, -1):
            self.chars[j] = rows[now, j]
            now = now[np.argsort(self.chars[j], kind="stable")]
            self.order[j] = now


def _range_min(values: np.ndarray) -> list[np.ndarray]:
    levels, span = [values], 1
    while 2 * span <= len(values):
        levels.append(np.minimum(levels[-1][:-span], levels[-1][span:]))
        span *= 2
    return levels


def merge(shards: list[ShardTransform], valid: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each shard a matrix (rows x columns): does the string of ``length``
    characters that starts there occur in another row at the same column?
    ``valid`` tells which cells hold text; a string never leaves them."""
    sizes = [s.order.shape[1] for s in shards]
    n, width = sum(sizes), shards[0].order.shape[0]
    kind = np.uint8 if len(shards) < 256 else np.uint16
    interleave = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    prefix = np.zeros(n, np.int16)  # common prefix with the suffix before
    log = np.zeros(n + 1, np.int64)
    log[1:] = np.log2(np.arange(1, n + 1)).astype(np.int64)
    out = [np.zeros(v.shape, bool) for v in valid]
    cuts = np.cumsum(sizes)[:-1]
    for j in range(width - 1, -1, -1):
        place = np.argsort(interleave, kind="stable")  # places of shard 0 in its order, then of shard 1, ...
        chars = np.empty(n, np.uint8)
        chars[place] = np.concatenate([s.chars[j] for s in shards])
        order = np.argsort(chars, kind="stable")
        # common prefixes of the new neighbours: the least between their old places, and one more
        levels = _range_min(prefix)
        a, b = order[:-1], order[1:]
        same = chars[a] == chars[b]
        a, b = a[same], b[same]
        k = log[b - a]
        least = np.empty(len(a), np.int16)
        for level in np.unique(k):
            i = np.flatnonzero(k == level)
            least[i] = np.minimum(levels[level][a[i] + 1], levels[level][b[i] - (1 << level) + 1])
        prefix = np.zeros(n, np.int16)
        prefix[1:][same] = least + 1
        interleave = interleave[order]
        place = np.argsort(interleave, kind="stable")
        here = np.empty(n, bool)
        here[place] = np.concatenate([v[s.order[j], j] for s, v in zip(shards, valid)])
        prefix[~here] = 0
        prefix[1:][~here[:-1]] = 0
        hit = prefix >= length
        hit[:-1] |= hit[1:]
        if hit.any():
            for o, s, h in zip(out, shards, np.split(hit[place], cuts)):
                o[s.order[j][h], j] = True
    return out


def repeated_starts(texts: list[bytes], offsets: np.ndarray, length: int, shard_rows: int = SHARD_ROWS) -> list[np.ndarray]:
    """For each text (UTF-8, or part of it) the starts of its substrings of ``length`` bytes that
    another text holds at the same distance from its anchor (``offsets``)."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    left = offsets.max() - offsets
    width = int((left + sizes).max())
    column = np.arange(width)
    valid = (column >= left[:, None]) & (column < (left + sizes)[:, None])
    rows = np.full((n, width), NOTHING, np.uint8)
    rows[valid] = np.frombuffer(b"".join(texts), np.uint8)
    parts = range(0, n, shard_rows)
    shards = [ShardTransform(rows[i:i + shard_rows]) for i in parts]
    flags = merge(shards, [valid[i:i + shard_rows] for i in parts], length)
    return [np.flatnonzero(f) - x for f, x in zip(np.concatenate(flags), left)]

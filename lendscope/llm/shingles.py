"""Hashes of word shingles for a batch of texts, with NumPy.

Words are runs of bytes other than white space, A-Z lower-cased. A word's hash
joins two polynomials of its bytes, each modulo a prime below 2^31 (modulo a
power of two, words can be written that collide for every base), cut out of
running sums over the batch, so nothing loops over words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Prime moduli and bases of the two polynomials.
_FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Call with a list of UTF-8 texts: shingle hashes (uint64, an entry for
    each occurrence) and the position in the list that each belongs to, in
    rising order of position. A text of 1 to ``k`` - 1 words has one shingle,
    its whole sequence; one without words has none."""

    def __init__(self, k: int):
        self.k = k
        drawn = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(_BASE)).reshape(2, 256)
        self.byte = [1 + v % np.uint64(p - 1) for v, (p, _) in zip(drawn, _FIELDS)]
        self._tables(1 << 16)

    def _tables(self, n: int) -> None:
        def powers(p: int, base: int) -> np.ndarray:
            t = np.ones(n, np.uint64)
            done = 1
            while done < n:
                more = min(done, n - done)
                t[done:done + more] = t[:more] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done += more
            return t
        self.power = [powers(p, base) for p, base in _FIELDS]
        self.inverse = [powers(p, pow(base, -1, p)) for p, base in _FIELDS]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b" " + b" ".join(t.lower() for t in texts) + b" ", np.uint8)
        if len(buf) > len(self.power[0]):
            self._tables(2 * len(buf))
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        both = []
        for (p, _), byte, power, inverse in zip(_FIELDS, self.byte, self.power, self.inverse):
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(byte[buf] * power[: len(buf)] % np.uint64(p), out=total[1:])
            both.append((total[end] - total[start]) % np.uint64(p) * inverse[start] % np.uint64(p))
        h = mix(((both[0] << np.uint64(31)) | both[1]) + (end - start).astype(np.uint64) * np.uint64(_BASE))
        at = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
        return h, np.searchsorted(at, start, "right") - 1

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w, owner = self.words(texts)
        count = np.bincount(owner, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(count)[:-1]))

        def chain(at: np.ndarray, n: int) -> np.ndarray:
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = mix(h * np.uint64(_BASE) + w[at + j])
            return h

        full = np.flatnonzero(owner[: max(0, len(w) - self.k + 1)] == owner[self.k - 1:])
        hashes, owners = [chain(full, self.k)], [owner[full]]
        for n in range(1, self.k):
            if len(short := np.flatnonzero(count == n)):
                hashes.append(chain(first[short], n))
                owners.append(short)
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(o, kind="stable")
        return h[order], o[order]


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct hashes, sorted."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]

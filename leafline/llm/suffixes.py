"""Sorted suffix runs: anchors, front coding, and a loser tree that keeps common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

GRAM = 8
_POSITION_BITS = 24
_STEP = 1 << 22


def _gram_keys(raw: np.ndarray) -> np.ndarray:
    """A hash of the 8 bytes from each position on."""
    g = raw.astype(np.uint64)
    g = g[:-1] | (g[1:] << np.uint64(8))
    g = g[:-2] | (g[2:] << np.uint64(16))
    g = g[:-4] | (g[4:] << np.uint64(32))
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def anchors(text: bytes, length: int, window: int) -> np.ndarray:
    """Positions such that any ``length`` bytes, wherever they occur, hold the same one in their first ``window`` bytes.

    It is the position of the least hash, the first of several equal ones. Long
    texts are worked off in overlapping parts.
    """
    last = len(text) - length
    if last < 0:
        return np.empty(0, np.int64)
    raw, found = np.frombuffer(text, np.uint8), []
    low = np.uint64((1 << _POSITION_BITS) - 1)
    for at in range(0, last + 1, _STEP):
        starts = min(_STEP, last + 1 - at)
        n = starts + window - 1
        keys = (_gram_keys(raw[at : at + n + GRAM - 1]) & ~low) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = keys
        blocks = padded.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
        changed = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        found.append((least[changed] & low).astype(np.int64) + at)
    return np.unique(np.concatenate(found))


def fingerprints(text: bytes, positions: np.ndarray, size: int) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [(x := digest(text[p : p + size])) - ((x >> 63) << 64) for p in positions.tolist()]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes need no look."""
    most, i, step = min(len(a), len(b)), known, 32
    while i < most:
        x, y = a[i : i + step], b[i : i + step]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return i + (n - (differ.bit_length() + 7) // 8 if differ else n)
        i, step = i + step, 2 * step
    return most


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of each sorted string, how much of it the one before has too, and the rest."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False))]
    return shared[: len(strings)], [s[n:] for s, n in zip(strings, shared, strict=False)]


def front_decode(shared: list[int], rests: list[bytes]) -> Iterator[tuple[bytes, int]]:
    last = b""
    for n, rest in zip(shared, rests, strict=True):
        last = last[:n] + rest
        yield last, n


class LoserTree:
    """Merges sorted runs of (string, prefix shared with the string before).

    Every string still in play is kept with the length of the prefix that it shares
    with the last string put out. Of two strings the one that shares more is the
    lesser; only if both share as much are bytes compared, from that length on.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs, self.size = runs, len(runs)
        self.now: list[bytes | None] = []
        self.shared: list[int] = []
        for run in runs:
            head = next(run, None)
            self.now.append(head[0] if head else None)
            self.shared.append(0)
        self.losers = [-1] * max(1, self.size)
        self.winner = self._build(1) if self.size else -1

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lost
        return won

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the one with the winner, as far as it is needed later."""
        a, b, shared = self.now[x], self.now[y], self.shared
        if b is None:
            return x, y
        if a is None:
            return y, x
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        n = common_prefix(a, b, shared[x])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            shared[y] = n
            return x, y
        shared[x] = n
        return y, x

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, string, prefix shared with the string put out before), in order."""
        while self.winner >= 0 and self.now[self.winner] is not None:
            run = self.winner
            yield run, self.now[run], self.shared[run]
            head = next(self.runs[run], None)
            self.now[run], self.shared[run] = head if head else (None, 0)
            won, node = run, (run + self.size) // 2
            while node >= 1:
                won, self.losers[node] = self._play(won, self.losers[node])
                node //= 2
            self.winner = won

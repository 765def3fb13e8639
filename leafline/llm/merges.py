"""Byte-pair merges of many words at once, in numpy."""

from __future__ import annotations

import json

import numpy as np

_PAD, _NONE, _BITS = 0xFFFF, 1 << 20, 20
_WIDTHS, _WORDS = (8, 16, 32), 8_192


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class PairMerges:
    """Ids of words as the tokenizer makes them: again and again, the leftmost pair of the least rank becomes one symbol.

    Pairs are looked up in two hash tables: what finds its place taken in the first
    has one of its own in the second.
    """

    longest = _WIDTHS[-1]  #: bytes in a word

    @classmethod
    def of(cls, tokenizer) -> PairMerges | None:
        """None for models that are no byte-level BPE with ``</w>`` at the end of words, or that have special rules."""
        model = json.loads(tokenizer.to_str())["model"]
        vocab, letters = model.get("vocab"), _byte_letters()
        rules = ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in rules):
            return None
        if any(x not in vocab or x + "</w>" not in vocab for x in letters) or max(vocab.values()) >= _PAD or not model["merges"]:
            return None
        return cls(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], letters)

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: list[str]):
        self.inner = np.array([vocab[x] for x in letters], np.uint16)
        self.last = np.array([vocab[x + "</w>"] for x in letters], np.uint16)
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint16)
        pairs = {vocab[a] << 16 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        keys, rng = np.fromiter(pairs, np.uint32, len(pairs)), np.random.default_rng(1)
        while True:
            self.factors = rng.integers(0, 1 << 31, 2, np.uint32) * np.uint32(2) + np.uint32(1)
            self.keys = np.full(2 << _BITS, _PAD << 16 | _PAD, np.uint32)
            at = self._slots(keys, 0)
            self.keys[at] = keys
            lost = np.flatnonzero(self.keys[at] != keys)
            at[lost] = self._slots(keys[lost], 1)
            if len(np.unique(at[lost])) == len(lost):
                break
        self.ranks = np.full(2 << _BITS, _NONE, np.int32)
        self.keys[at], self.ranks[at] = keys, np.fromiter(pairs.values(), np.int32, len(pairs))

    def _slots(self, keys: np.ndarray, table: int) -> np.ndarray:
        return (keys * self.factors[table] >> np.uint32(32 - _BITS)).astype(np.int32) + (table << _BITS)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right
        at = self._slots(keys, 0)
        out, other = self.ranks[at], np.flatnonzero(self.keys[at] != keys)
        keys = keys[other]
        at = self._slots(keys, 1)
        out[other] = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        return out

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of ``longest`` bytes at most, one word after the other in some order; where each word's begin, and how many it has."""
        begin, n, made, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [np.empty(0, np.uint16)], 0
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], [0, *_WIDTHS], "right").tolist()
        for low, high in zip(cuts, cuts[1:], strict=False):
            for i in range(low, high, _WORDS):
                some = order[i : min(i + _WORDS, high)]
                ids = self._merged(raw, starts[some], sizes[some]).T
                n[some] = found = np.count_nonzero(ids != _PAD, axis=1)
                begin[some] = total + np.cumsum(found) - found
                made.append(ids[ids != _PAD])
                total += len(made[-1])
        return np.concatenate(made), begin, n

    def _merged(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A column for each word. Each step does one merge in each word that has one left, and takes out a row."""
        place = np.arange(int(sizes.max()), dtype=np.int32)[:, None]
        ids = self.inner[raw[np.minimum(starts + place, len(raw) - 1)]]
        ids[place >= sizes] = _PAD
        ids[sizes - 1, np.arange(len(starts))] = self.last[raw[starts + sizes - 1]]
        out, words = np.full(ids.shape, _PAD, np.uint16), np.arange(len(starts))
        ranks = self._ranks(ids[:-1].ravel(), ids[1:].ravel()).reshape(len(ids) - 1, len(starts))
        while True:
            best = ((ranks << 6) + place[: len(ranks)]).min(0, initial=_NONE << 6)
            more = best < _NONE << 6
            out[: len(ids), words[~more]] = ids[:, ~more]
            words, best, ids, ranks = words[more], best[more], ids[:, more], ranks[:, more]
            if not len(words):
                return out
            at, new = best & 63, self.made[best >> 6]
            ids = np.where(place[: len(ids) - 1] > at, ids[1:], ids[:-1])
            ids[at, np.arange(len(words))] = new
            ranks = np.where(place[: len(ranks) - 1] >= at, ranks[1:], ranks[:-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < len(ids) - 1)
            ranks[at[right], right] = self._ranks(new[right], ids[at[right] + 1, right])
            ranks[at[left] - 1, left] = self._ranks(ids[at[left] - 1, left], new[left])

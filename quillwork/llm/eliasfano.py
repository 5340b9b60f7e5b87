"""Compact sorted sequences and a two-level n-gram trie on them, in flat bytes that can be mapped from a file."""

from __future__ import annotations

import json

import numpy as np

LOW_BITS = 56
KEY_BITS = 40


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary.

    `get` and `successor` work on many positions at once, from the compact form.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(LOW_BITS, max(0, (top // max(n, 1)).bit_length() - 1))
        packed = []
        for at in range(0, n, 1 << 16) if bits else []:
            part = values[at : at + (1 << 16)] & np.uint64((1 << bits) - 1)
            packed.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(8, dtype=np.uint8)])
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(places[-1]) if n else 0) // 64 + 1) * 64, dtype=np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint32)]).astype("<u4")
        return cls(n, bits, low, high, ranks)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these positions."""
        at = np.asarray(at, dtype=np.int64)
        word = np.searchsorted(self.ranks, at, side="right") - 1
        left = (at - self.ranks[word]).astype(np.int64)
        bits = self.high[word]
        place = np.zeros(len(at), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            over = left >= ones
            left -= np.where(over, ones, 0)
            place += np.where(over, width, 0)
            bits = np.where(over, bits >> np.uint64(width), part)
        out = (word * 64 + place - at).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start = at * self.low_bits
            byte, low = start >> 3, np.zeros(len(at), dtype=np.uint64)
            for k in range(8):
                low |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
            out |= (low >> (start & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first position in [lo, hi) whose value is not below `value`, else hi, for each query."""
        lo, hi, value = np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64), np.asarray(value, dtype=np.uint64)
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            below = self.get(mid) < value[left]
            lo[left[below]] = mid[below] + 1
            hi[left[~below]] = mid[~below]
            left = left[lo[left] < hi[left]]
        return lo

    def parts(self) -> tuple[list[int], list[np.ndarray]]:
        return [self.n, self.low_bits], [self.low, self.high, self.ranks]


def quantise(values: np.ndarray) -> tuple[float, float, np.ndarray]:
    """least, step, 16-bit codes: values are within half a step of least + step * code."""
    least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (most - least) / 65535 or 1.0
    return least, step, np.rint((values - least) / step).astype("<u2")


class Trie:
    """Words (64-bit keys) and, under each, the words before it (40-bit keys), with quantised values.

    Level 1 holds the words' keys, pointers to their children and two values; level 2 the children's keys, made monotone by the
    rank of their word, and one value. Children are found by successor search between two pointers, relative to their word.
    """

    def __init__(self, words: EliasFano, pointers: EliasFano, children: EliasFano, codes: list[tuple[float, float, np.ndarray]]):
        self.words, self.pointers, self.children, self.codes = words, pointers, children, codes

    @classmethod
    def build(cls, words: np.ndarray, values: list[np.ndarray], owner: np.ndarray, keys: np.ndarray, child_values: np.ndarray) -> Trie:
        """words sorted; owner: each child's word number, with keys sorted inside a word."""
        pointers = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
        children = (owner.astype(np.uint64) << np.uint64(KEY_BITS)) | keys.astype(np.uint64)
        return cls(EliasFano.of(words), EliasFano.of(pointers), EliasFano.of(children), [*map(quantise, values), quantise(child_values)])

    def to_bytes(self) -> bytes:
        arrays, sequences = [], []
        for s in (self.words, self.pointers, self.children):
            numbers, own = s.parts()
            sequences.append(numbers)
            arrays += own
        arrays += [c for _, _, c in self.codes]
        head = json.dumps({"sequences": sequences, "scales": [c[:2] for c in self.codes], "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
        out = len(head).to_bytes(8, "little") + head
        for a in arrays:
            out += b"\0" * (-len(out) % 8) + a.tobytes()
        return out

    @classmethod
    def mapped(cls, data) -> Trie:
        """From bytes or a np.memmap of a file that holds them; levels stay in place and are read as queries need them."""
        raw = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes | memoryview) else data
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head, at, arrays = json.loads(raw[8 : 8 + n].tobytes()), 8 + n, []
        for kind, length in head["arrays"]:
            at += -at % 8
            size = np.dtype(kind).itemsize * length
            arrays.append(raw[at : at + size].view(kind))
            at += size
        ef = [EliasFano(*numbers, *arrays[3 * k : 3 * k + 3]) for k, numbers in enumerate(head["sequences"])]
        return cls(*ef, [(a, b, c) for (a, b), c in zip(head["scales"], arrays[9:], strict=True)])

    def _value(self, level: int, at: np.ndarray, found: np.ndarray, missing: np.ndarray) -> np.ndarray:
        least, step, codes = self.codes[level]
        if not len(codes):
            return missing
        return np.where(found, least + step * codes[np.where(found, at, 0)], missing)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each word, and whether it is there."""
        words = np.asarray(words, dtype=np.uint64)
        at = self.words.successor(np.zeros(len(words)), np.full(len(words), self.words.n), words)
        found = at < self.words.n
        found[found] = self.words.get(at[found]) == words[found]
        return at, found

    def find_children(self, rank: np.ndarray, there: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each child key under the word of that rank, and whether it is there; none where the word isn't."""
        rank = np.where(there, rank, 0)
        lo, hi = (self.pointers.get(rank + k).astype(np.int64) for k in (0, 1))
        hi = np.where(there, hi, lo)
        value = (rank.astype(np.uint64) << np.uint64(KEY_BITS)) | np.asarray(keys, dtype=np.uint64)
        at = self.children.successor(lo, hi, value)
        found = at < hi
        found[found] = self.children.get(at[found]) == value[found]
        return at, found

"""Elias-Fano sequences and a two-level n-gram trie in one flat buffer, queried by numpy over a memory map."""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bits of a follower's hash below its parent's rank in the second level's keys.
CHILD_BITS = 40


def build_sequence(values: np.ndarray) -> dict[str, np.ndarray]:
    """Elias-Fano parts of a non-decreasing sequence of 64-bit numbers: whole low bytes, and unary high parts.

    The high part of value i sets bit ``high + i``, so n values take at most
    n + 2^(their bits) bits; the split keeps that within about 3 n.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bytes = min(7, max(0, -(-(top.bit_length() - max(n, 1).bit_length()) // 8)))
    shift = np.uint64(8 * low_bytes)
    low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes]
    at = (values >> shift).astype(np.int64) + np.arange(n)
    bits = np.zeros((top >> (8 * low_bytes)) + n + 1, np.uint8)
    bits[at] = 1
    return {"low": np.ascontiguousarray(low), "high": np.packbits(bits, bitorder="little"), "n": np.array([n])}


class Sequence:
    """Reads a sequence; its high parts are unpacked once, its low bytes stay in the map."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low = int(parts["n"][0]), parts["low"]
        at = np.flatnonzero(np.unpackbits(parts["high"], bitorder="little"))
        self.high = (at - np.arange(self.n)).astype(np.uint64)
        self.shift = np.uint64(8 * self.low.shape[1])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at given places."""
        whole = np.zeros((len(at), 8), np.uint8)
        whole[:, : self.low.shape[1]] = self.low[at]
        return whole.view("<u8").reshape(-1) | (self.high[at] << self.shift)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of the first value not below ``x``, within [first, last) of each query; ``last`` if there is none."""
        high = x >> self.shift if self.shift < 64 else np.zeros_like(x)
        # Equal high parts are neighbours: the answer lies among them or right behind.
        low_at, high_at = np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")
        if first is not None:
            low_at, high_at = np.clip(low_at, first, last), np.clip(high_at, first, last)
        open_ = np.flatnonzero(low_at < high_at)
        while len(open_):
            middle = (low_at[open_] + high_at[open_]) // 2
            below = self[middle] < x[open_]
            low_at[open_] = np.where(below, middle + 1, low_at[open_])
            high_at[open_] = np.where(below, high_at[open_], middle)
            open_ = open_[low_at[open_] < high_at[open_]]
        return low_at


def quantise(values: np.ndarray, codes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of numbers on an even grid, and the grid's start and step."""
    low = float(values.min()) if len(values) else 0.0
    step = max((float(values.max()) - low) / (codes - 1), 1e-12) if len(values) else 1.0
    return np.rint((values - low) / step).astype(np.uint16), np.array([low, step])


class Trie:
    """Words, and under each the words it was seen after.

    Level 1 holds the words' hashes; a monotone pointer per word starts its children
    in level 2, whose keys are the word's rank followed by ``CHILD_BITS`` bits of
    the preceding word's hash, so they grow through the whole level. Every node has
    a quantised value: a word its log10 probability and its back-off as a context,
    a pair what having seen it adds to the log10 probability.
    """

    @staticmethod
    def build(words, alone, back, parent, child, gain) -> bytes:
        """``parent`` are ranks in ``words`` (sorted hashes); (parent, child) is sorted and distinct."""
        parts: dict[str, np.ndarray] = {}
        starts = np.searchsorted(parent, np.arange(len(words) + 1))
        keys = (parent.astype(np.uint64) << np.uint64(CHILD_BITS)) | child
        for name, values in (("words", words), ("starts", starts), ("keys", keys)):
            parts |= {f"{name}.{k}": v for k, v in build_sequence(values).items()}
        for name, values in (("alone", alone), ("back", back), ("gain", gain)):
            parts[name], parts[f"{name}.grid"] = quantise(values)
        head = "\n".join(f"{k} {v.dtype.str} {','.join(map(str, v.shape))} {v.nbytes}" for k, v in parts.items())
        body = b"".join(v.tobytes() for v in parts.values())
        return len(head).to_bytes(8, "little") + head.encode() + body

    def __init__(self, data: np.ndarray):
        size = int.from_bytes(data[:8].tobytes(), "little")
        at, parts = 8 + size, {}
        for line in data[8:at].tobytes().decode().split("\n"):
            name, kind, shape, length = line.split(" ")
            part = data[at : at + int(length)]
            # Parts follow one another without gaps; numpy reads them where they lie.
            parts[name] = np.ndarray([int(x) for x in shape.split(",")], kind, part) if int(length) else np.zeros(
                [int(x) for x in shape.split(",")], kind)
            at += int(length)
        self.words, self.starts, self.keys = (
            Sequence({k: parts[f"{name}.{k}"] for k in ("low", "high", "n")}) for name in ("words", "starts", "keys")
        )
        self.parts = parts

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        low, step = self.parts[f"{name}.grid"]
        return low + step * self.parts[name][at].astype(float)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Rank of every word, -1 for unknown ones."""
        if not self.words.n:
            return np.full(len(words), -1)
        at = self.words.successor(words)
        hit = at < self.words.n
        hit[hit] = self.words[at[hit]] == words[hit]
        return np.where(hit, at, -1)

    def gains(self, ranks: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What a pair adds over back-off: the children of the word are searched for the word before it; 0 if not there."""
        out = np.zeros(len(ranks))
        known = np.flatnonzero(ranks >= 0)
        if not len(known) or not self.keys.n:
            return out
        r = ranks[known]
        first, last = self.starts[r].astype(np.int64), self.starts[r + 1].astype(np.int64)
        key = (r.astype(np.uint64) << np.uint64(CHILD_BITS)) | before[known]
        at = self.keys.successor(key, first, last)
        hit = np.flatnonzero(at < last)
        hit = hit[self.keys[at[hit]] == key[hit]]
        out[known[hit]] = self._value("gain", at[hit])
        return out

    def values(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, back-off as a context) of known words."""
        return self._value("alone", ranks), self._value("back", ranks)


def mapped(data: bytes) -> np.ndarray:
    """The buffer as a memory-mapped file of the task's own temporary folder; the file goes at once, the map stays."""
    handle, path = tempfile.mkstemp(suffix=".trie")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        return np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)

"""Canonical length-limited Huffman codes over token ids, coded and decoded with numpy."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this length limit")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(used))  # True: a leaf, False: a package of the level before
        merged = both[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    # Codes of the greatest length follow each other; a shorter one stands for all that begin with it.
    free = int(size[-1] if len(size) else 0) - size
    out = np.zeros(len(lengths), np.uint64)
    out[order] = (np.cumsum(1 << free) - (1 << free)) >> free
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray, every: int) -> tuple[np.ndarray, int, bytes]:
    """(bit offset of every `every`-th id, number of bits, big-endian 32-bit words)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word = start >> 5
    shifted = code[ids] << (64 - (start & 31) - size).astype(np.uint64)
    out = np.zeros(int(end[-1] >> 5) + 3, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return start[::every], int(end[-1]), out.astype(">u4").tobytes()


class Decoder:
    """Looks up the next `limit` bits in a table, at all checkpoints of a block at once."""

    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=0)))
        code = codes(lengths)
        used = np.flatnonzero(lengths)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.size = np.ones(1 << self.limit, np.uint8)
        pad = self.limit - lengths[used].astype(np.int64)
        order = np.argsort(code[used].astype(np.int64) << pad)
        used, many = used[order], (1 << pad)[order]
        self.symbol[: many.sum()] = np.repeat(used, many)
        self.size[: many.sum()] = np.repeat(lengths[used], many)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int, every: int) -> np.ndarray:
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        pair = (words[:-1] << np.uint64(32)) | words[1:]
        bit = checkpoints.astype(np.int64)
        out = np.zeros((len(bit), every), np.uint32)
        mask, last = np.uint64((1 << self.limit) - 1), len(pair) - 1
        for k in range(min(every, n)):
            peek = (pair[np.minimum(bit >> 5, last)] >> (64 - (bit & 31) - self.limit).astype(np.uint64)) & mask
            out[:, k] = self.symbol[peek]
            bit = bit + self.size[peek]
        return out.ravel()[:n]

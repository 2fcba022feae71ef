"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement (Holt and McMillan's method).

A shard's transform is built from its own sorted suffixes. Merging starts from the shards one after the other; a round
reads the next symbols of each shard in the present interleave and re-sorts the interleave stably by symbol, so that after h
rounds it is the order by the first h symbols. Beside it run the blocks of suffixes that share these h symbols (the gap
method's common prefixes), which after h rounds are the repeated intervals of length h. No suffix is compared or sorted again.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """The transform of some strings (uint8 symbols above 0, one after the other): symbols before the sorted suffixes."""

    def __init__(self, symbols: np.ndarray, lens: np.ndarray, depth: int):
        n = len(lens)
        size = len(symbols) + n
        own = np.zeros(size, np.uint8)  # every string ends with a 0
        ends = np.cumsum(lens + 1)
        inner = np.ones(size, bool)
        inner[ends - 1] = False
        own[inner] = symbols
        # the first `depth` symbols as 64-bit keys, zeros from a string's end on
        left = np.repeat(ends, lens + 1) - np.arange(size)  # symbols to the string's end, its 0 included
        keys = []
        padded = np.concatenate([own, np.zeros(8, np.uint8)])
        eight = np.zeros(size + 8 * (depth // 8 + 2), np.uint64)
        for j in range(8):
            eight[:size] |= padded[j : j + size].astype(np.uint64) << np.uint64(56 - 8 * j)
        for a in range(0, depth, 8):
            whole = eight[a : a + size]
            many = np.clip(np.minimum(left, depth) - a, 0, 8).astype(np.uint64)
            mask = np.where(many > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(many, 1).astype(np.uint64))), np.uint64(0))
            keys.append(whole & mask)
        self.suffix = np.lexsort(tuple(reversed(keys))).astype(np.int64)  # ties by place: strings in their order
        before = np.zeros(size, np.uint8)
        before[1:] = own[:-1]
        self.symbols = before[self.suffix]
        self.ends = n


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each merged position its shard, and its block: suffixes that share their first depth symbols."""
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.symbols) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.ends for s in shards])
    n_ends = len(ends)
    symbols = np.concatenate([s.symbols for s in shards])
    block = np.zeros(len(z), np.int32)
    read = np.empty(len(z), np.uint8)
    for _ in range(depth):
        read[np.argsort(z, kind="stable")] = symbols
        order = np.argsort(read, kind="stable")
        z, read_, block_ = z[order], read[order], block[order]
        z[:n_ends] = ends  # the suffixes that are a string's end keep the order of strings
        head = np.ones(len(z), bool)
        head[1:] = (read_[1:] != read_[:-1]) | (block_[1:] != block_[:-1])
        head[1:n_ends] = False
        block = np.cumsum(head, dtype=np.int32)
    return z, block


def repeated(symbols: list[np.ndarray], lens: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of all shards: shard, suffix (place among the shard's symbols, ends included) and block, in merged order."""
    shards = [Shard(s, n, depth) for s, n in zip(symbols, lens, strict=True)]
    z, block = merge(shards, depth)
    suffix = np.empty(len(z), np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate([s.suffix for s in shards])
    return z, suffix, block

"""Simple-8b over whole blocks of ids, in numpy.

A 64-bit word holds a 4-bit selector and 60 bits of data: k values of b bits each. Values too
wide for the packed layouts get an escape word of their own. A block holds ``BLOCK`` ids; the
word where each block starts is kept, so blocks are packed and unpacked side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: Fixed values of the coding: values in a word by selector. A value has 60 // k bits; the
#: first selector is the escape, one raw value.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) for unsigned ids under 2**32."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-n // BLOCK)
    longest = max(COUNTS)
    grid = np.zeros((blocks, BLOCK + longest), np.uint32)
    body = np.zeros(blocks * BLOCK, np.uint32)
    body[:n] = ids
    grid[:, :BLOCK] = body.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK

    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # bit length
    choice = selectors(bits)
    at = np.zeros(blocks, np.int64)
    where, owner = [], []
    live = np.arange(blocks)
    step = np.array(COUNTS)
    while len(live):
        where.append(at[live])
        owner.append(live)
        at[live] += step[choice[live, at[live]]]
        live = live[at[live] < sizes[live]]
    order = np.argsort(np.concatenate(owner), kind="stable")
    where, owner = np.concatenate(where)[order], np.concatenate(owner)[order]
    chosen = choice[owner, where]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, k in enumerate(COUNTS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            for j in range(k):
                words[own] |= grid[owner[own], where[own] + j].astype(np.uint64) << np.uint64(j * (60 // k))
    return words, np.searchsorted(owner, np.arange(blocks)).astype(np.uint32)


def selectors(bits: np.ndarray) -> np.ndarray:
    """At each place the selector that takes the most values, by sliding maxima of bit lengths."""
    choice = np.zeros(bits.shape, np.uint8)
    most = {1: bits}
    for s, k in enumerate(COUNTS[1:], 1):
        a = max(c for c in COUNTS[:s] if c in most)
        b = next(c for c in COUNTS if c >= k - a)
        width = bits.shape[1] - k + 1
        most[k] = np.maximum(most[a][:, :width], most[b][:, k - b:k - b + width])
        fits = most[k] <= 60 // k
        choice[:, :width][fits] = s
    return choice


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of words packed by ``pack``; the last word of a block may hold
    padding, which is left out."""
    if not n:
        return np.empty(0, np.uint32)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1], np.uint32)
    for s, k in enumerate(COUNTS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            mask = np.uint64((1 << (60 // k)) - 1)
            for j in range(k):
                out[ends[own] - k + j] = (words[own] >> np.uint64(j * (60 // k))) & mask
    return out[:n]


def unpack_blocks(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """All blocks at once: values are unpacked in a row, then each block's padding is cut."""
    if not n:
        return np.empty(0, np.uint32)
    counts = np.array(COUNTS)[(words >> np.uint64(60)).astype(np.int64)]
    flat = unpack(words, int(counts.sum()))
    held = np.add.reduceat(counts, firsts.astype(np.int64))
    starts = np.cumsum(held) - held
    sizes = np.full(len(firsts), BLOCK)
    sizes[-1] = n - (len(firsts) - 1) * BLOCK
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
    return flat[places]

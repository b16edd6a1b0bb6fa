"""Simple-8b: ids packed into 64-bit words, vectorised.

A word's low 4 bits are its selector; the other 60 hold COUNTS[s] ids of WIDTHS[s] bits, first id lowest. An id of
ESCAPE or more is written as ESCAPE, and its value goes to the block's list of escapes (unsigned 32-bit). Ids are
packed in blocks of BLOCK, each starting on a word, with offsets of the blocks' words and escapes.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the Simple-8b format: ids in a word, bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 15) - 1  # the widest id of four to a word
BLOCK = 1024
SELECTORS = [s for s in range(16) if WIDTHS[s] <= 15]
BITS = np.frexp(np.arange(ESCAPE + 1))[1].astype(np.int8)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each block, first escape of each block); the offsets have one entry more than there are blocks."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
    ids = ids.astype(np.uint32)
    escaped = ids >= ESCAPE
    # One row for each block, with zeros behind it: padding fits into any word, and decode() cuts it off.
    flat = np.zeros(blocks * block, np.uint16)
    flat[:n] = np.minimum(ids, ESCAPE)
    code = np.zeros((blocks, block + 240), np.uint16)
    code[:, :block] = flat.reshape(blocks, block)
    length = np.full(blocks, block)
    length[-1] = n - block * (blocks - 1)
    # The selector at each place: that of the most ids, all narrow enough. peak: bits of the widest of the next `wide` ids.
    best = np.full((blocks, block), SELECTORS[-1], np.int8)
    peak, wide = BITS[code], 1
    for s in reversed(SELECTORS):
        while wide < COUNTS[s]:
            step = min(wide, COUNTS[s] - wide)
            peak, wide = np.maximum(peak[:, :-step], peak[:, step:]), wide + step
        if s < SELECTORS[-1]:  # who fits into one selector fits into all of fewer ids
            best -= (peak[:, :block] <= WIDTHS[s]).view(np.int8)
    # All blocks side by side: each step finds the next word of every block that has ids left.
    live, at, found = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(live):
        s = best[live, at]
        found.append((live, at, s))
        at = at + COUNTS[s]
        more = at < length[live]
        live, at = live[more], at[more]
    row, at, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row * block + at)
    row, at, s = row[order], at[order], s[order]
    words = s.astype(np.uint64)
    for k in np.unique(s):
        if WIDTHS[k]:
            here = np.flatnonzero(s == k)
            first = row[here] * (block + 240) + at[here]
            for i in range(COUNTS[k]):
                words[here] |= code.reshape(-1)[first + i].astype(np.uint64) << np.uint64(4 + WIDTHS[k] * i)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))])
    extra = np.concatenate([[0], np.cumsum(np.bincount(np.flatnonzero(escaped) // block, minlength=blocks))])
    return words, ids[escaped], starts, extra


def decode(words: np.ndarray, escapes: np.ndarray, n: int, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n ids (uint32) of encode()'s words."""
    if not n:
        return np.empty(0, np.uint32)
    s = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[s].copy()
    # Padding at the end of a block is cut off.
    blocks = len(starts) - 1
    length = np.full(blocks, block)
    length[-1] = n - block * (blocks - 1)
    total = np.add.reduceat(count, starts[:-1])
    count[starts[1:] - 1] -= total - length
    first = np.cumsum(count) - count
    out = np.zeros(n + 240, np.uint32)
    for k in SELECTORS:
        rows = np.flatnonzero(s == k)
        if len(rows) and WIDTHS[k]:
            shifts = (4 + WIDTHS[k] * np.arange(COUNTS[k])).astype(np.uint64)
            values = (words[rows, None] >> shifts) & np.uint64((1 << int(WIDTHS[k])) - 1)
            keep = np.arange(COUNTS[k]) < count[rows, None]
            out[(first[rows, None] + np.arange(COUNTS[k]))[keep]] = values[keep]
    out = out[:n]
    at = np.flatnonzero(out == ESCAPE)
    out[at] = escapes
    return out

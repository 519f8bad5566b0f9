"""Simple-8b coding of unsigned 64-bit integers, encoded and decoded with whole-array operations.

Layout.  Values are cut into blocks of a fixed count.  A block is a run of 64-bit words; the top
four bits of a word are its selector, the other 60 hold a fixed count of values of a fixed width,
lowest bits first.  A block's last word may be padded with zeros: the block's count says where it
ends.  Selector 0 marks an escape: its payload is an index into a list of raw 64-bit values, for
values of 60 bits or more.  ``offsets`` holds the first word of each block, so blocks decode
independently and all at once.
"""

from __future__ import annotations

import numpy as np

# Selector, values in a word, bits of each value.
SELECTORS = ((2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60))
ESCAPE = 0
BLOCK = 4096
_WIDEST = 60
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDTH16 = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, offsets, escapes)``: offsets has the first word of each block and, last, the count of words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    blocks = -(-n // block)
    grid = np.zeros((blocks, block + _WIDEST), np.uint64)
    whole = np.zeros(blocks * block, np.uint64)
    whole[:n] = values
    grid[:, :block] = whole.reshape(blocks, block)
    width = np.searchsorted(_POWERS, grid.ravel(), "right").astype(np.uint8).reshape(grid.shape) if int(values.max()) >> 16 else _WIDTH16[grid]
    selector = np.zeros((blocks, block), np.uint8)
    count = np.ones((blocks, block), np.uint8)
    open_ = np.ones((blocks, block), bool)
    for code, many, bits in SELECTORS:
        fits, reach = width <= bits, 1
        while reach < many:  # all of the next `reach` values are narrow enough
            step = min(reach, many - reach)
            fits = fits[:, :-step] & fits[:, step:]
            reach += step
        fits = fits[:, :block] & open_
        selector[fits] = code
        count[fits] = many
        open_ &= ~fits
        if not open_.any():
            break
    ends = np.full(blocks, block)
    ends[-1] = n - (blocks - 1) * block
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        steps.append((live, at[live]))
        at[live] += count[live, at[live]]
        live = live[at[live] < ends[live]]
    rows = np.concatenate([s[0] for s in steps])
    cols = np.concatenate([s[1] for s in steps])
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    codes = selector[rows, cols]
    words = codes.astype(np.uint64) << np.uint64(60)
    for code, many, bits in SELECTORS:
        mine = np.flatnonzero(codes == code)
        for i in range(many if len(mine) else 0):
            words[mine] |= grid[rows[mine], cols[mine] + i] << np.uint64(i * bits)
    mine = np.flatnonzero(codes == ESCAPE)
    escapes = grid[rows[mine], cols[mine]]
    words[mine] = np.arange(len(mine), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=blocks))])
    return words, offsets.astype(np.int64), escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    many = np.ones(16, np.int64)
    for code, count, _ in SELECTORS:
        many[code] = count
    codes = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(many[codes])])
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = of * block + before[:-1] - before[offsets[of]]
    end = np.minimum((of + 1) * block, n)
    for code, count, bits in SELECTORS:
        mine = np.flatnonzero(codes == code)
        mask = np.uint64((1 << bits) - 1)
        for i in range(count if len(mine) else 0):
            to = start[mine] + i
            inside = to < end[mine]
            out[to[inside]] = (words[mine[inside]] >> np.uint64(i * bits)) & mask
    mine = np.flatnonzero(codes == ESCAPE)
    out[start[mine]] = escapes[words[mine].astype(np.int64)] if len(mine) else 0
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, index: int, block: int = BLOCK) -> np.ndarray:
    """The values of one block, from that block's words alone."""
    part = words[offsets[index] : offsets[index + 1]]
    return decode(part, np.array([0, len(part)]), escapes, min(block, n - index * block), block)

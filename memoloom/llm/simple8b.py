"""Simple-8b coding of id sequences: 64-bit words whose four top bits say how many ids of which width follow.

An encoded sequence is cut into blocks of a fixed number of ids, and an offset per block says at which word it starts, so
blocks are encoded and decoded side by side. Values of more than 60 bits are escapes: the word holds a place in a list of
raw values at the end.

Layout, all little-endian: magic, number of ids (u64), number of escapes (u64), word offset of each block and of the end
(u32 each), the words (u64), the raw values (u64).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
BLOCK = 4096
_HEAD = "<4sQQ"
_HEAD_SIZE = struct.calcsize(_HEAD)
#: Fixed values of the format: (ids, bits each) of every selector; selector 0 is the escape.
SELECTORS = (
    (1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNT = np.array([n for n, _ in SELECTORS])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; above 2**53 one more at times, which only makes an escape of it."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _choices(width: np.ndarray) -> np.ndarray:
    """For each place of (blocks, ids) the selector that takes most ids from there on."""
    spans = {1: width}
    for n in (2, 4, 8, 16, 32, 64):
        half = spans[n // 2]
        spans[n] = half.copy()
        np.maximum(half[:, : -n // 2], half[:, n // 2 :], out=spans[n][:, : -n // 2])
    best = np.where(width > 60, np.uint8(0), np.uint8(15))
    for selector in range(14, 0, -1):
        n, bits = SELECTORS[selector]
        base = 1 << (n.bit_length() - 1)
        fits = spans[base] <= bits
        if n > base:
            fits[:, : -(n - base)] &= fits[:, n - base :].copy()
        if fits.any():
            np.putmask(best, fits, selector)
    return best


def encode(values: np.ndarray) -> bytes:
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + 128), np.uint64)  # what a block's last word holds beyond it is zero
    if n:
        full = n // BLOCK
        padded[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
        padded[full:, : n - full * BLOCK] = values[full * BLOCK :]
    best = _choices(_widths(padded[:, :BLOCK])) if blocks else np.zeros((0, BLOCK), np.uint8)
    chosen, steps = best.ravel(), _COUNT[best].ravel()
    begin = np.zeros(blocks * BLOCK, bool)
    at = np.arange(blocks) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    while len(at):  # one word of every unfinished block at a time
        begin[at] = True
        at = at + steps[at]
        open_ = at < ends
        if not open_.all():
            at, ends = at[open_], ends[open_]
    place = np.flatnonzero(begin)
    selector = chosen[place]
    first = place + place // BLOCK * 128  # in the padded blocks
    padded = padded.ravel()
    words = selector.astype(np.uint64) << np.uint64(60)
    for code in range(1, 16):
        count, bits = SELECTORS[code]
        mine = np.flatnonzero(selector == code) if bits else ()
        if len(mine):
            start = first[mine]
            held = padded[start]
            for k in range(1, count):
                held |= padded[start + k] << np.uint64(k * bits)
            words[mine] |= held
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(place, np.arange(blocks + 1) * BLOCK).astype("<u4")
    parts = (struct.pack(_HEAD, MAGIC, n, len(escaped)), offsets.tobytes(), words.astype("<u8").tobytes())
    return b"".join((*parts, padded[first[escaped]].astype("<u8").tobytes()))


def decode(data: bytes) -> np.ndarray:
    magic, n, escapes = struct.unpack_from(_HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b sequence")
    blocks = -(-n // BLOCK)
    offsets = np.frombuffer(data, "<u4", blocks + 1, _HEAD_SIZE).astype(np.int64)
    start = _HEAD_SIZE + offsets.nbytes // 2
    words = np.frombuffer(data, "<u8", int(offsets[-1]), start)
    raw = np.frombuffer(data, "<u8", escapes, start + words.nbytes)
    selector = (words >> np.uint64(60)).astype(np.int64)
    taken = np.r_[0, np.cumsum(_COUNT[selector])]
    owner = np.repeat(np.arange(blocks), np.diff(offsets))
    first = taken[:-1] - taken[offsets[owner]] + owner * BLOCK
    out = np.zeros(blocks * BLOCK + 128, np.uint64)
    for code in range(15, 0, -1):
        count, bits = SELECTORS[code]
        mine = np.flatnonzero(selector == code)
        if bits and len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            found = (words[mine, None] >> shifts) & np.uint64((1 << bits) - 1)
            index = first[mine, None] + np.arange(count)
            inside = index < (owner[mine, None] + 1) * BLOCK
            out[index[inside]] = found[inside]
    escaped = np.flatnonzero(selector == 0)
    out[first[escaped]] = raw[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]

"""Words and word windows of whole Arrow batches, as numpy arrays.

A batch of texts is one byte buffer; words are runs of bytes outside the six
ASCII white-space characters, cut at document borders.  Everything below works
on all words of the batch at once, so the cost per word is a few vector
operations and the memory follows the batch, which ``pieces`` keeps small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xD6E8FEB86659FD93)
_K3 = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S32)) * _K2
    x = (x ^ (x >> _S29)) * _K3
    return x ^ (x >> _S32)


def pieces(batch: pa.RecordBatch, col: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about ``limit`` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    arr = batch.column(batch.schema.get_field_index(col))
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts (and the last ends); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    buf = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


class Words:
    """All words of an Arrow string array: ``start``/``end`` bytes, ``first[d]`` the first word of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        buf, self.offsets = text_bytes(texts)
        if lower:
            buf = buf | (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
        self.buf = buf
        inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        cut = np.zeros(len(buf) + 1, dtype=bool)          # a text starts (or the buffer ends) here
        cut[self.offsets] = True
        before = np.zeros(len(buf), dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(len(buf), dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def fits(self, n: int) -> np.ndarray:
        """Mask over the words: n words from here on lie in one text."""
        last = np.repeat(self.first[1:], self.count)
        return np.arange(len(self)) + n <= last


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time over all spans at once."""
    length = end - start
    h = length.astype(np.uint64) * _K1
    if not len(start):
        return h
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(pad, 8)
    live = np.arange(len(start))
    at = 0
    while len(live):
        lane = np.ascontiguousarray(lanes[start[live] + at]).view("<u8").ravel()
        rest = np.minimum(8, length[live] - at).astype(np.uint64)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - rest) * np.uint64(8))
        x = (h[live] ^ lane) * _K1
        x = (x ^ (x >> _S32)) * _K2
        h[live] = x ^ (x >> _S29)
        at += 8
        live = live[length[live] > at]
    return h


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        inv = np.uint64(pow(int(_K1), -1, 1 << 64))
        _POW["up"] = np.cumprod(np.full(size, _K1, dtype=np.uint64))
        _POW["down"] = np.cumprod(np.full(size, inv, dtype=np.uint64))
    return _POW["up"][:n], _POW["down"][:n]


class Rolling:
    """Hashes of all runs of n consecutive words, for any n, from one prefix sum."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h) + 1)
        self.sum = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * up[:len(h)], dtype=np.uint64, out=self.sum[1:])

    def windows(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n words from each place (all places, or those given)."""
        if at is not None:
            return mix((self.sum[at + n] - self.sum[at]) * self.down[at])
        if len(self.sum) <= n:
            return np.empty(0, np.uint64)
        k = len(self.sum) - n
        return mix((self.sum[n:] - self.sum[:-n]) * self.down[:k])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def text_column(batch: pa.RecordBatch, col: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(col))

"""Token ids of whole texts with a public byte-level BPE tokenizer.

Such a tokenizer cuts a text into pre-tokens before it merges anything, so ids
of a text are those of its units one after the other, wherever units end at
pre-token borders.  Three borders can be told from the bytes: before white
space that follows something else, between an ASCII letter and another ASCII
character, and between a single newline and an ASCII letter.  Units repeat far
more than texts, and each distinct one is encoded once per batch and remembered
by its hash, in arrays that take some 25 bytes a unit: a Python worker lives on
after its task, and what it holds counts in the steps that follow.  Texts that hold a special token, or white space outside ASCII
before ASCII white space, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from txguard.llm.text import span_hashes, text_bytes

#: Units that a worker remembers, ids of one that is remembered at most, and units that the library has in hand at once
#: (it takes about 1 KB for each).
CACHE_UNITS, SHORT_UNIT, ENCODED_UNITS = 1_000_000, 16, 5_000
#: White space outside ASCII, in UTF-8, before ASCII white space.
_WIDE_SPACE = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\x09-\x0d\x20]")
_READY: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts; remembers at most ``CACHE_UNITS`` units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # units by ascending hash: where in ``ids`` their ids start and how many they are
        self.key, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint8)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at these places, one after the other, and how many each has."""
        ids, size = array("I"), []
        for lo in range(0, len(start), ENCODED_UNITS):
            units = zip(start[lo:lo + ENCODED_UNITS].tolist(), end[lo:lo + ENCODED_UNITS].tolist())
            for e in self.tok.encode_batch_fast([raw[a:b].decode() for a, b in units], add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                size.append(len(own))
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _remember(self, place: np.ndarray, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Take the short ones of some new units; ``place``: where their keys belong."""
        short = size <= SHORT_UNIT
        own = size[short]
        at = len(self.ids) + np.cumsum(own) - own
        self.ids = np.concatenate([self.ids, ids[np.repeat(short, size)]])
        for name, new in (("key", keys[short]), ("at", at), ("size", own)):
            old = getattr(self, name)
            setattr(self, name, np.insert(old, place[short], new.astype(old.dtype)))

    def _whole(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        """Texts to be encoded as one unit."""
        at = [m.start() for m in _WIDE_SPACE.finditer(raw)] if any(c in raw for c in (b"\xc2", b"\xe1", b"\xe2", b"\xe3")) else []
        for s in self.special:
            if s in raw:
                at += [m.start() for m in re.finditer(re.escape(s), raw)]
        return {int(np.searchsorted(offsets, a, side="right")) - 1 for a in at}

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        buf, offsets = text_bytes(texts)
        raw = buf.tobytes()
        white = (buf == 32) | ((buf >= 9) & (buf <= 13))
        lower = buf | 32
        letter = (lower >= 97) & (lower <= 122) & (buf < 128)
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf):
            cut[1:-1] = white[1:] & ~white[:-1]
            cut[1:-1] |= letter[:-1] & ~letter[1:] & (buf[1:] < 128)
            cut[2:-1] |= letter[2:] & (buf[1:-1] == 10) & ~white[:-2]
        for d in self._whole(raw, offsets):
            cut[offsets[d]:offsets[d + 1]] = False
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(buf))
        key, first, back = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.key, key)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == key[known]
        at, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        flat, new = self.ids, np.flatnonzero(~known)
        if len(new):
            ids, size[new] = self._encode(raw, start[first[new]], end[first[new]])
            at[new] = len(flat) + np.cumsum(size[new]) - size[new]
            flat = np.concatenate([flat, ids])
            if len(self.key) < CACHE_UNITS:
                self._remember(place[new], key[new], ids, size[new])
        n = size[back]
        stop = np.cumsum(n)
        # each unit's place in ``flat`` less its place in the output, once per id
        shift = (at[back] - (stop - n)).astype(np.int32)
        ids = flat[np.repeat(shift, n) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)]
        edge = np.concatenate([[0], stop])[np.searchsorted(start, offsets)]
        return [ids[a:b] for a, b in zip(edge, edge[1:])]


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]

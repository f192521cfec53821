"""MD5 over many texts at once, by arrays: only as much of it as orders digests by their first four bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts worked on at a time, which a core's cache holds.
SLAB = 32_768
#: Arrays without an axis, which NumPy adds or shifts by faster than by numbers.
_ADDED, _LEFT, _RIGHT = ([np.array(x, np.uint32) for x in numbers] for numbers in (_SINES, _TURNS, [32 - x for x in _TURNS]))


def _words(parts: list[bytes], at: int, blocks: int, whole: int = 0) -> np.ndarray:
    """[word, part]: the message words of parts of one length that stand at byte `at`, with the padding of `whole` bytes where given."""
    size = len(parts[0])
    held = np.zeros((len(parts), blocks * 64), np.uint8)
    held[:, at : at + size] = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), size)
    if whole:
        held[:, whole] = 0x80
        held[:, -8:] = np.frombuffer((8 * whole).to_bytes(8, "little"), np.uint8)
    return np.ascontiguousarray(held.view("<u4").T)


def _rounds(state: list[np.ndarray], words: list[np.ndarray], shape: tuple[int, int], steps: int = 64) -> list[np.ndarray]:
    """The steps of one block upon the flat arrays of `state`, which are overwritten. words: arrays without an axis, or of `shape` when broadcast."""
    add, both, either, differ, turned, left, right = np.add, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert, np.left_shift, np.right_shift
    a, b, c, d = state
    spare = np.empty_like(a)
    for i in range(steps):
        if i < 16:
            word = words[i]
            differ(c, d, spare)
            both(spare, b, spare)
            differ(spare, d, spare)
        elif i < 32:
            word = words[(5 * i + 1) % 16]
            differ(b, c, spare)
            both(spare, d, spare)
            differ(spare, c, spare)
        elif i < 48:
            word = words[(3 * i + 5) % 16]
            differ(b, c, spare)
            differ(spare, d, spare)
        else:
            word = words[7 * i % 16]
            turned(d, spare)
            either(spare, b, spare)
            differ(spare, c, spare)
        add(a, spare, a)
        if word.ndim:
            grid = a.reshape(shape) if word.ndim == 2 else a
            add(grid, word, grid)
            add(a, _ADDED[i], a)
        else:
            add(a, word + _ADDED[i], a)
        left(a, _LEFT[i], spare)
        right(a, _RIGHT[i], a)
        either(a, spare, a)
        add(a, b, a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


class _Crossed:
    """Texts of one length behind heads of one length: firsts(heads) gives [head, text] of the digests' first four bytes."""

    def __init__(self, heads: list[bytes], texts: list[bytes]):
        self.before, self.n = len(heads[0]), len(texts)
        whole = self.before + len(texts[0])
        self.blocks = (whole + 8) // 64 + 1
        self.heads, self.texts = _words(heads, 0, self.blocks), _words(texts, self.before, self.blocks, whole)
        self.same = (self.texts == self.texts[:, :1]).all(axis=1).tolist()

    def _word(self, k: int, rows: slice) -> np.ndarray:
        head, text = self.heads[k, rows], self.texts[k, :1].reshape(()) if self.same[k] else self.texts[k]
        if len(head) > 1:
            return text if 4 * k >= self.before and not text.ndim else head[:, None] | text
        return text if 4 * k >= self.before else head.reshape(()) | text

    def firsts(self, rows: slice) -> np.ndarray:
        shape = (self.heads[0, rows].size, self.n)
        state = [np.full(shape[0] * shape[1], x, np.uint32) for x in _START]
        with np.errstate(over="ignore"):
            for block in range(self.blocks):
                words = [np.asarray(self._word(k, rows)) for k in range(16 * block, 16 * block + 16)]
                before = [x.copy() for x in state]
                if block == self.blocks - 1:  # the first word is done after 61 steps
                    return np.add(before[0], _rounds(state, words, shape, 61)[1]).byteswap().reshape(shape)
                state = [np.add(x, y, out=x) for x, y in zip(_rounds(state, words, shape), before, strict=True)]


def lowest(heads: list[bytes], texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of heads, places of texts): pairs that hold, of each head, the `most` texts of the lowest MD5 of head + text,
    and beside them only those whose digests have the first four bytes of the last one."""
    by_head, by_text = (np.array([len(x) for x in parts]) for parts in (heads, texts))
    for before in np.unique(by_head):
        at = np.flatnonzero(by_head == before)
        groups = [np.flatnonzero(by_text == size) for size in np.unique(by_text)]
        slabs = [part for g in groups for part in np.array_split(g, -(-len(g) // SLAB))]
        order = np.concatenate(slabs)
        parts = [_Crossed([heads[k] for k in at], [texts[k] for k in slab]) for slab in slabs]
        step = max(1, SLAB // len(texts))
        for first in range(0, len(at), step):
            rows = slice(first, min(first + step, len(at)))
            keys = np.concatenate([p.firsts(rows) for p in parts], axis=1)
            bound = np.partition(keys, most - 1, axis=1)[:, most - 1] if most < len(texts) else np.full(len(keys), 2**32 - 1, np.uint32)
            head, text = np.nonzero(keys <= bound[:, None])
            yield at[first + head], order[text]

"""Token ids by a given tokenizer file, with the ids of each piece of text remembered.

A text is cut before every blank or line end that a character other than white space follows. No pre-token of the supported tokenizers
(byte-level BPE, word BPE that drops white space) spans such a place, so the ids of the pieces, joined, are the ids of the
text. A piece that was seen before costs a look-up by its hash in a sorted array and a comparison with the bytes remembered; the
others go to the ``tokenizers`` library, many in one call, and so do pieces whose hash another piece holds already. What a worker
remembers is bounded: it starts anew when it is full.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa

from quire.llm.arrays import prefix_hash, range_hash

REMEMBERED = 1_200_000
_PLAIN = re.compile(r"[ \n][^\s<]+")
_TOGETHER = 512
# Bytes that may begin white space, or that are it: no cut stands before them.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LOADED: dict[str, "Pieces"] = {}


def forget() -> None:
    """Frees what a worker remembers, for steps that encode no more, and hands freed memory back to the system.

    Without that, a worker keeps the pages of its earlier steps as long as it lives, beside what the step at hand needs.
    """
    _LOADED.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


class Pieces:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)

    @classmethod
    def load(cls, path: str) -> "Pieces":
        """One per worker process and file."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def encode(self, data: np.ndarray, off: np.ndarray, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a text buffer, and the first id of each row (one more than rows); ``prefix`` is its prefix hash, if known."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        fresh = np.zeros(n + 1, bool)
        fresh[off] = True
        fresh[: n - 1] |= ((data[:-1] == 32) | (data[:-1] == 10)) & ~_MAYBE_SPACE[data[1:]]
        start = np.flatnonzero(fresh[:n])
        end = np.append(start[1:], n)
        keys = range_hash(prefix_hash(data) if prefix is None else prefix, start, end)
        kinds, first, which = np.unique(keys, return_index=True, return_inverse=True)
        self._remember(kinds, data, start[first], end[first])
        at = np.searchsorted(self.keys, kinds)
        begin, count, ids = self.begin[at][which], self.count[at][which].astype(np.int64), self.ids
        # Equal hashes are no proof: the bytes must be those that the ids were made from.
        size, place = end - start, self.place[at][which]
        known = np.minimum(np.repeat(place - start, size) + np.arange(n), len(self.text) - 1)
        other = np.flatnonzero((self.size[at][which] != size) | np.logical_or.reduceat(self.text[known] != data, start))
        if len(other):
            raw = data.tobytes()
            own, sizes = self._ask([raw[a:b].decode() for a, b in zip(start[other].tolist(), end[other].tolist())])
            begin[other], count[other] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, own])
        stop = np.cumsum(count)
        source = np.repeat(begin - (stop - count), count) + np.arange(stop[-1])
        rows = np.concatenate([[0], stop])[np.searchsorted(start, off)]
        return ids[source], rows

    def _remember(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        def unknown() -> np.ndarray:
            at = np.searchsorted(self.keys, keys)
            return np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))

        todo = unknown()
        if len(self.keys) + len(todo) > REMEMBERED and len(self.keys):
            self._forget()
            todo = unknown()
        if not len(todo):
            return
        raw = data.tobytes()
        ids, count = self._ask([raw[a:b].decode() for a, b in zip(start[todo].tolist(), end[todo].tolist())])
        where = np.searchsorted(self.keys, keys[todo])
        begin = len(self.ids) + np.cumsum(count) - count
        self.keys = np.insert(self.keys, where, keys[todo])
        self.begin = np.insert(self.begin, where, begin)
        self.count = np.insert(self.count, where, count)
        self.ids = np.concatenate([self.ids, ids])
        size = (end - start)[todo]
        self.place = np.insert(self.place, where, len(self.text) + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.text = np.concatenate([self.text, data[np.repeat(start[todo] - (np.cumsum(size) - size), size) + np.arange(size.sum())]])

    def _ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, joined in their order, and the number of each.

        Plain pieces are encoded as one text and told apart by where their tokens end; the others one by one.
        """
        plain = [bool(_PLAIN.fullmatch(p)) for p in pieces]
        joint = [p for p, x in zip(pieces, plain) if x]
        count = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = []
        sizes = []
        for at in range(0, len(joint), _TOGETHER * 64):
            groups = [joint[g : g + _TOGETHER] for g in range(at, min(at + _TOGETHER * 64, len(joint)), _TOGETHER)]
            for group, e in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
                last = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 1]
                stops = np.searchsorted(last, np.cumsum([len(p) for p in group]), side="right")
                parts.append(np.array(e.ids, np.uint32))
                sizes.append(np.diff(stops, prepend=0))
        is_plain = np.array(plain)
        if sizes:
            count[is_plain] = np.concatenate(sizes)
        other = [p for p, x in zip(pieces, plain) if not x]
        alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        count[~is_plain] = [len(x) for x in alone]
        # Joint ids and single ids are in two runs; bring them into the order of the pieces.
        ids = np.concatenate([*parts, *alone, np.zeros(0, np.uint32)])
        run = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        begin = np.empty(len(pieces), np.int64)
        begin[run] = np.cumsum(count[run]) - count[run]
        stop = np.cumsum(count)
        return ids[np.repeat(begin - (stop - count), count) + np.arange(len(ids))], count


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each row's ids."""
    n = len(rows) - 1
    return np.insert(ids, rows[1:], np.uint32(end_id)), rows + np.arange(n + 1)

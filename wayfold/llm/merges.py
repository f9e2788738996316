"""Byte-pair merging of many words at once, in rounds over flat numpy arrays.

All symbols of all words lie in one array. A round finds the smallest pair rank of each word (a segmented minimum),
merges its occurrences from the left, closes the gaps, and looks up only the pairs beside a merge. Words without a
known pair leave the arrays. Rounds end when none is left.

Merging every occurrence in the same round gives what merging one after the other would, if no merge of the result has
a smaller rank; the table knows for which ranks that holds, and of the others a round merges only the leftmost.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """(left, right) -> rank and result. Symbols are ints from 0; a negative symbol merges with nothing.

    ``rank``: the smaller, the sooner. Several pairs may share a rank if they share their result.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, 2**64 - 1, dtype=np.uint64)
        self.at = np.zeros(size, dtype=np.int32)
        self.rank, self.result = rank.astype(np.int32), result.astype(np.int32)
        keys, waiting = self._key(left, right), np.arange(len(left))
        slot = self._slot(keys)
        while len(waiting):
            free = self.keys[slot[waiting]] == np.uint64(2**64 - 1)
            put = waiting[free]
            put = put[np.unique(slot[put], return_index=True)[1]]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & (size - 1)
        top = int(max(left.max(initial=0), right.max(initial=0), result.max(initial=0))) + 1
        used = np.full(top, NONE, dtype=np.int32)
        np.minimum.at(used, left, self.rank)
        np.minimum.at(used, right, self.rank)
        self.together = used[self.result] > self.rank

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, -1 where there is none."""
        out = np.full(len(left), -1, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[todo], right[todo])
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, one word after the other, and how many each has."""
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        sym, done = symbols.astype(np.int32), []
        row = self._pairs(sym, word)
        while len(sym):
            rank = np.where(row >= 0, self.rank[row], NONE)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(starts, append=len(word))
            if (over := least == NONE).any():
                gone = np.repeat(over, counts)
                done.append((word[gone], sym[gone]))
                stay = ~gone
                word, sym, row, rank = word[stay], sym[stay], row[stay], rank[stay]
                least, counts = least[~over], counts[~over]
                if not len(sym):
                    break
                starts = np.cumsum(counts) - counts
            pick = np.flatnonzero(rank == np.repeat(least, counts))
            # of neighbours, every second one from the left; where merging together is unsafe, only a word's first
            run = np.flatnonzero(np.diff(pick, prepend=-2) != 1)
            place = np.arange(len(pick)) - np.repeat(run, np.diff(run, append=len(pick)))
            first = np.diff(word[pick], prepend=-1) != 0
            pick = pick[first | ((place % 2 == 0) & self.together[row[pick]])]
            sym[pick] = self.result[row[pick]]
            stay = np.ones(len(sym), dtype=bool)
            stay[pick + 1] = False
            moved = pick - np.arange(len(pick))
            word, sym, row = word[stay], sym[stay], row[stay]
            beside = np.zeros(len(sym), dtype=bool)
            beside[moved] = True
            beside[moved[moved > 0] - 1] = True
            again = np.flatnonzero(beside)
            row[again] = self._pairs(sym, word, again)
        if not done:
            return symbols[:0].astype(np.int32), np.zeros(len(lengths), dtype=np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lengths))

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(sym)) if at is None else at
        out = np.full(len(at), -1, dtype=np.int32)
        inner = np.flatnonzero(at < len(sym) - 1)
        left = at[inner]
        same = word[left] == word[left + 1]
        inner, left = inner[same], left[same]
        out[inner] = self.find(sym[left], sym[left + 1])
        return out

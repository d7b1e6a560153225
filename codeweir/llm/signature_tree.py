"""Signature trees: nodes hold the OR of their members' token bitmaps and the range of
their sizes; a dual traversal leaves out pairs of nodes that can't overlap enough. Many
trees, one for each group of members, are built and traversed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
MIN_BITS, MAX_BITS = 64, 1 << 16


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, at least 2 n while bounded."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (2 * n - 1).bit_length()))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """A set's bitmap as bits / 64 unsigned numbers: token t sets bit t modulo bits."""
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


class SignatureTree:
    """Trees over members' bitmaps (rows of one width) and sizes, one for each group, built
    bottom-up in the order of size and signature, so that alike members share nodes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray | None = None):
        group = np.zeros(len(sizes), np.int64) if groups is None else groups
        self.order = np.lexsort((bits[:, 0], sizes, group))
        bits, sizes, group = bits[self.order], sizes[self.order].astype(np.int64), group[self.order]
        # Tokens of a set beyond its set bits: what an overlap of bitmaps may hide.
        excess = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, excess)]
        #: Where each node's children begin in the level below, and their number.
        self.children: list[np.ndarray] = [np.zeros(0, np.int64)]
        while len(group) and (group[1:] == group[:-1]).any():
            cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            within = np.arange(len(group)) - np.repeat(cut, np.diff(np.append(cut, len(group))))
            at = np.flatnonzero(within % FAN == 0)
            _, low, high, excess = self.levels[-1]
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            self.levels.append((bits, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))
            self.children.append(np.append(at, len(group)))
            group = group[at]

    def _labels(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(labels[self.order],) * 2]
        for at in self.children[1:]:
            first, last = out[-1]
            out.append((np.minimum.reduceat(first, at[:-1]), np.maximum.reduceat(last, at[:-1])))
        return out

    def pairs(self, percent: int, labels: np.ndarray, live: bool = False, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of member pairs of one group that may have 100 * intersection >= percent * union
        and whose labels differ. live: labels may change between blocks; nodes that have
        come under one label are then left out together."""
        top = len(self.levels) - 1
        if not top:
            return
        roots = np.arange(len(self.levels[top][1]))
        stack, known = [(top, roots, roots)], self._labels(labels)
        while stack:
            level, i, j = stack.pop()
            if len(i) > block:
                stack.append((level, i[block:], j[block:]))
                i, j = i[:block], j[:block]
            if live:
                known = self._labels(labels)
            first, last = known[level]
            bits, low, high, excess = self.levels[level]
            may = (first[i] != last[j]) | (last[i] != first[j])
            may &= (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
            i, j = i[may], j[may]
            overlap = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64) + np.minimum(excess[i], excess[j])
            may = (100 + percent) * overlap >= percent * (low[i] + low[j])
            i, j = i[may], j[may]
            if not len(i):
                continue
            if not level:
                yield self.order[i], self.order[j]
                continue
            at, step = self.children[level], np.arange(FAN)
            a = np.repeat(at[i][:, None] + step, FAN, axis=1).ravel()
            b = np.tile(at[j][:, None] + step, (1, FAN)).ravel()
            ends = np.repeat(at[i + 1], FAN * FAN), np.repeat(at[j + 1], FAN * FAN)
            same = np.repeat(i == j, FAN * FAN)
            good = (a < ends[0]) & (b < ends[1]) & (~same | (a < b if level == 1 else a <= b))
            stack.append((level - 1, a[good], b[good]))

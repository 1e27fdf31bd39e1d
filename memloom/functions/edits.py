"""Edit distance and similarity ratio of many texts to many names at once, in numpy.

A text of 64 characters at most is one word of bits, and a step takes the next character of the names of all pairs. Pairs
are bounded first by the characters that both have, so only those that can still be the nearest are worked out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Classes of characters that pairs are bounded by.
CLASSES = 64
#: Characters in a word of bits; longer texts are one large integer each.
WORD = 64
#: Pairs worked out at once.
PAIRS = 1 << 18
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and each text's length."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)


def _bags(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text how many characters it has of each class."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(rows * CLASSES + ids % CLASSES, minlength=len(lengths) * CLASSES).reshape(-1, CLASSES)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair how many characters both can have in common."""
    kind = np.uint8 if max(a.max(initial=0), b.max(initial=0)) < 256 else np.int32
    out = np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T.astype(kind), b.T.astype(kind)):
        if x.any() and y.any():
            out += np.minimum.outer(x, y)
    return out


class _Pairs:
    """Texts and names of a block as numbers; `cost` is the edit distance, or the ratio with its sign changed."""

    def __init__(self, texts: list[str], names: list[str], ratio: bool):
        self.ratio = ratio
        both, self.size, self.length = self._numbers(texts, names)
        self.at = np.cumsum(self.size) - self.size
        self.start = np.cumsum(self.length) - self.length
        bags = _shared(_bags(self.ids, self.size), _bags(self.codes, self.length))
        self.bound = self._cost(np.arange(len(texts))[:, None], np.arange(len(names))[None, :], bags)
        short = np.flatnonzero(self.size <= WORD)
        rows = np.repeat(np.arange(len(texts)), self.size)
        place = np.arange(len(self.ids)) - self.at[rows]
        keep = self.size[rows] <= WORD
        self.row = np.zeros(len(texts), np.int64)
        self.row[short] = np.arange(len(short))
        self.masks = np.zeros((len(short), both), np.uint64)
        np.bitwise_or.at(self.masks, (self.row[rows[keep]], self.ids[keep]), _ONE << place[keep].astype(np.uint64))

    def _numbers(self, texts: list[str], names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
        (a, size), (b, length) = _flat(texts), _flat(names)
        known, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.ids, self.codes = ids[: len(a)], ids[len(a) :]
        return len(known), size, length

    def _cost(self, t: np.ndarray, n: np.ndarray, common: np.ndarray) -> np.ndarray:
        """What a pair costs that has so many characters in common: exact for the ratio, the least for edits."""
        a, b = self.size[t], self.length[n]
        if not self.ratio:
            return np.maximum(a, b) - common
        return -np.where(a + b > 0, 2.0 * common / np.maximum(a + b, 1), 1.0)

    def short(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Costs of pairs of texts of a word of bits at most."""
        out = np.zeros(len(t), float if self.ratio else np.int64)
        # longest names first: those with a further character are always the first ones
        order = np.argsort(-self.length[n], kind="stable")
        for lo in range(0, len(t), PAIRS):
            part = order[lo : lo + PAIRS]
            out[part] = (self._common if self.ratio else self._edits)(t[part], n[part])
        return out

    def _steps(self, t: np.ndarray, n: np.ndarray):
        """For each place in the names, how many pairs have one and where their texts have its character."""
        row, start, length = self.row[t], self.start[n], self.length[n]
        for j in range(int(length[0]) if len(n) else 0):
            k = int(np.searchsorted(-length, -j, side="left"))
            yield k, self.masks[row[:k], self.codes[start[:k] + j]]

    def _edits(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        size = self.size[t]
        score = size.copy()
        last = np.where(size > 0, _ONE << np.maximum(size - 1, 0).astype(np.uint64), np.uint64(0))
        more, less = np.full(len(t), _ALL), np.zeros(len(t), np.uint64)
        for k, eq in self._steps(t, n):
            p, m, top = more[:k], less[:k], last[:k]
            down = eq | m
            across = (((eq & p) + p) ^ p) | eq
            up, fall = m | ~(across | p), p & across
            score[:k] += ((up & top) != 0).astype(np.int64) - ((fall & top) != 0)
            up, fall = (up << _ONE) | _ONE, fall << _ONE
            more[:k], less[:k] = fall | ~(down | up), up & down
        return np.where(size > 0, score, self.length[n])

    def _common(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        size = self.size[t]
        rows = np.full(len(t), _ALL)
        for k, eq in self._steps(t, n):
            hit = rows[:k] & eq
            rows[:k] = (rows[:k] + hit) | (rows[:k] - hit)
        held = np.where(size > 0, _ALL >> (WORD - np.maximum(size, 1)).astype(np.uint64), np.uint64(0))
        return self._cost(t, n, np.bitwise_count(~rows & held).astype(np.int64))

    def long(self, t: int) -> tuple[float, int]:
        """Cost and place of the nearest name of a text of any length, by large integers; names in order of their bounds."""
        m = int(self.size[t])
        own = self.ids[self.at[t] : self.at[t] + m]
        masks = {int(c): int.from_bytes(np.packbits(own == c, bitorder="little").tobytes(), "little") for c in np.unique(own)}
        work: Callable[[dict[int, int], int, list[int]], int] = _long_common if self.ratio else _long_edits
        best: tuple[float, int] | None = None
        for n in np.argsort(self.bound[t], kind="stable").tolist():
            if best is not None and (self.bound[t, n], n) > best:
                if self.bound[t, n] > best[0]:
                    break
                continue
            found = work(masks, m, self.codes[self.start[n] : self.start[n] + self.length[n]].tolist())
            cost = float(self._cost(np.array(t), np.array(n), np.array(found))) if self.ratio else found
            best = min(best, (cost, n)) if best is not None else (cost, n)
        return best


def _long_edits(masks: dict[int, int], m: int, name: list[int]) -> int:
    full, top, score = (1 << m) - 1, 1 << (m - 1), m
    more, less = full, 0
    for c in name:
        eq = masks.get(c, 0)
        down = eq | less
        across = (((eq & more) + more) ^ more) | eq
        up, fall = less | (~(across | more) & full), more & across
        score += bool(up & top) - bool(fall & top)
        up, fall = (up << 1 | 1) & full, (fall << 1) & full
        more, less = fall | (~(down | up) & full), up & down
    return score


def _long_common(masks: dict[int, int], m: int, name: list[int]) -> int:
    full = (1 << m) - 1
    row = full
    for c in name:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return m - row.bit_count()


def nearest(texts: list[str], names: list[str], *, ratio: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """For each text the place of its nearest name and the cost, and how many pairs were worked out. Ties go to the first name.

    The cost is the edit distance or, with `ratio`, the similarity with its sign changed: twice the length of the longest
    common subsequence over both lengths, 1 for two empty texts. There is a name at least.
    """
    pairs = _Pairs(texts, names, ratio)
    best = pairs.bound.argmin(axis=1)
    cost = np.zeros(len(texts), float if ratio else np.int64)
    short = np.flatnonzero(pairs.size <= WORD)
    cost[short] = pairs.short(short, best[short])
    # pairs whose bound is no worse than what the first guess came to
    t, n = np.nonzero(pairs.bound[short] <= cost[short][:, None])
    t = short[t]
    other = n != best[t]
    t, n = t[other], n[other]
    t, n = np.concatenate([short, t]), np.concatenate([best[short], n])
    found = np.concatenate([cost[short], pairs.short(t[len(short) :], n[len(short) :])])
    order = np.lexsort((n, found, t))
    first = order[np.concatenate([[True], t[order][1:] != t[order][:-1]])] if len(order) else order
    best[t[first]], cost[t[first]] = n[first], found[first]
    for i in np.flatnonzero(pairs.size > WORD).tolist():
        cost[i], best[i] = pairs.long(i)
    return best, cost, len(t)

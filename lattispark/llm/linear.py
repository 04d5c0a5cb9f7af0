"""Logistic regression over sparse rows, fitted on bounded samples, and hashed n-grams of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Letters of a text that are looked at together, or up to the next space.
LETTERS = 1 << 18
#: Values of sparse rows that are multiplied at once, which bounds what is made in between.
TOGETHER = 1 << 18
GAP = re.compile(r"[\x20\x09-\x0D]")


class Rows:
    """Sparse rows: feature numbers and values, row after row."""

    def __init__(self, numbers: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.sizes = np.array([len(x) for x in numbers], np.int64)
        self.numbers = np.concatenate(numbers).astype(np.int32, copy=False) if numbers else np.empty(0, np.int32)
        self.values = np.concatenate(values).astype(np.float32, copy=False) if values else np.ones(len(self.numbers), np.float32)
        self.of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def _parts(self):
        return (slice(at, at + TOGETHER) for at in range(0, len(self.numbers), TOGETHER))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for part in self._parts():
            of = self.of[part]
            sums = np.bincount(of - of[0], self.values[part] * weights[self.numbers[part]])
            out[of[0] : of[0] + len(sums)] += sums
        return out

    def back(self, errors: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        for part in self._parts():
            out += np.bincount(self.numbers[part], self.values[part] * errors[self.of[part]], width)
        return out

    def take(self, chosen: np.ndarray) -> "Rows":
        starts = np.cumsum(self.sizes) - self.sizes
        part = Rows([])
        part.sizes = self.sizes[chosen]
        at = np.repeat(starts[chosen] - (np.cumsum(part.sizes) - part.sizes), part.sizes) + np.arange(part.sizes.sum())
        part.numbers, part.values = self.numbers[at], self.values[at]
        part.of = np.repeat(np.arange(len(part.sizes), dtype=np.int32), part.sizes)
        return part

    def plus(self, other: "Rows") -> "Rows":
        """These rows and then the others."""
        part = Rows([])
        part.sizes, part.numbers, part.values = (np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("sizes", "numbers", "values"))
        part.of = np.repeat(np.arange(len(part.sizes), dtype=np.int32), part.sizes)
        return part


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: Rows, y: np.ndarray, width: int, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 200, rate: float = 0.1, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole of the (bounded) sample, from a start if there is one."""
    w, b = (start[0].astype(float), start[1]) if start else (np.zeros(width), 0.0)
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        error = (sigmoid(rows.dot(w) + b) - y) * weight
        g, gb = rows.back(error, width) + l2 * w, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(b)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept that turn a margin into a log-odds, with smoothed targets. Weights say
    how many rows of the population each row stands for."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    weight = np.ones(len(y)) if weight is None else weight * (len(y) / weight.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda t: float((weight * (np.logaddexp(0, t[0] * z + t[1]) - target * (t[0] * z + t[1]))).sum())
    at = np.array([1.0, 0.0])
    now = loss(at)
    for _ in range(50):  # Newton's steps, halved until the loss falls
        p = sigmoid(at[0] * z + at[1])
        d, s = (p - target) * weight, np.maximum(p * (1 - p), 1e-9) * weight
        g = np.array([(d * z).sum(), d.sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        while (then := loss(at - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if now - then < 1e-10:
            break
        at, now = at - step, then
    return max(float(at[0]), 1e-3), float(at[1])


def gram_numbers(text: str | None, bits: int, sizes: tuple[int, ...], fold: bool) -> Iterator[np.ndarray]:
    """Hashed numbers below 2**bits of the character n-grams of a text's words, in parts.

    Words are set apart by one mark, which may begin or end an n-gram but not lie within it.
    """
    if not text:
        return
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + LETTERS)
        stop = gap.start() if gap else len(text)
        part = text[at:stop].lower() if fold else text[at:stop]
        at = stop
        letters = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        mark = np.concatenate([[True], (letters == 32) | ((letters >= 9) & (letters <= 13)), [True]])
        letters = np.concatenate([[0], letters, [0]]).astype(np.uint64)
        letters[mark] = 0
        once = ~mark
        once[0] = True
        once[1:] |= ~mark[:-1]
        letters, mark = letters[once], mark[once]
        if len(letters) < 2:
            continue
        with np.errstate(over="ignore"):
            letters = (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for size in sizes:
                n = len(letters) - size + 1
                if n <= 0:
                    continue
                total, good = np.full(n, size, np.uint64), np.ones(n, bool)
                for k in range(size):
                    total = (total ^ letters[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
                    if 0 < k < size - 1 or size == 1:
                        good &= ~mark[k : k + n]
                yield ((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits))[good].astype(np.int64)

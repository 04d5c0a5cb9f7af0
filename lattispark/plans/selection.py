"""NumPy indices as plans: per axis a point, a range or a list; lists may act together.

A Selection is made on the driver from the index alone, before any job. It knows the shape of
its result, bounds on every axis (for chunk pruning), and what a strict engine declines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class DiscontiguousArrayError(Exception):
    """Strict mode: a strided slice or an integer array that is no unit-step range."""


class UnsupportedVIndexingError(Exception):
    """Strict mode: a pointwise index whose points don't fill a box."""


@dataclass(frozen=True)
class Point:
    """One index; its axis is dropped."""

    at: int

    def bounds(self) -> tuple[int, int]:
        return self.at, self.at + 1


@dataclass(frozen=True)
class Range:
    """start, start + step, ...: `count` of them. A step may be negative."""

    start: int
    count: int
    step: int = 1

    def bounds(self) -> tuple[int, int]:
        if not self.count:
            return 0, 0
        last = self.start + (self.count - 1) * self.step
        return min(self.start, last), max(self.start, last) + 1


@dataclass(frozen=True)
class Gather:
    """Any indices, in order, repeats included."""

    at: tuple[int, ...]

    def bounds(self) -> tuple[int, int]:
        return (min(self.at), max(self.at) + 1) if self.at else (0, 0)


@dataclass(frozen=True)
class Points:
    """Lists that act together: at[k] belongs to axis axes[k], all of one broadcast shape."""

    axes: tuple[int, ...]
    at: tuple[tuple[int, ...], ...]
    shape: tuple[int, ...]


@dataclass(frozen=True)
class Selection:
    """axes: a selector per axis, None where `points` selects. out: for each axis of the result,
    the source axis (an int) or ("points", k) for axis k of the points' shape."""

    shape: tuple[int, ...]
    axes: tuple
    points: Points | None
    out: tuple
    result_shape: tuple[int, ...] = field(default=())

    def bounds(self) -> list[tuple[int, int]]:
        """For each axis, the least box (start, stop) that holds what is selected."""
        found: list[tuple[int, int]] = []
        for axis, selector in enumerate(self.axes):
            if selector is None:
                at = self.points.at[self.points.axes.index(axis)]
                found.append((min(at), max(at) + 1) if at else (0, 0))
            else:
                found.append(selector.bounds())
        return found


def _wrapped(index: int, size: int, axis: int) -> int:
    where = index + size if index < 0 else index
    if not 0 <= where < size:
        raise IndexError(f"index {index} is out of bounds for axis {axis} with size {size}")
    return where


def _list(value, size: int, axis: int) -> np.ndarray:
    array = np.asarray(value)
    if array.dtype == bool:
        if array.ndim != 1 or len(array) != size:
            raise IndexError(f"boolean index on axis {axis} must have {size} entries")
        array = np.flatnonzero(array)
    if array.size == 0:
        array = array.astype(np.int64)
    if array.dtype.kind not in "iu":
        raise IndexError("arrays used as indices must be of integer or boolean type")
    array = array.astype(np.int64)
    bad = (array < -size) | (array >= size)
    if bad.any():
        raise IndexError(f"index {array[bad].flat[0]} is out of bounds for axis {axis} with size {size}")
    return np.where(array < 0, array + size, array)


def expanded(index, rank: int) -> tuple:
    """The index as one entry per axis; an ellipsis, or the end, stands for whole axes."""
    entries = index if isinstance(index, tuple) else (index,)
    if sum(e is Ellipsis for e in entries) > 1:
        raise IndexError("an index can only have a single ellipsis ('...')")
    if len([e for e in entries if e is not Ellipsis]) > rank:
        raise IndexError(f"too many indices for array with {rank} dimensions")
    if not any(e is Ellipsis for e in entries):
        entries = (*entries, Ellipsis)
    at = next(k for k, e in enumerate(entries) if e is Ellipsis)
    return (*entries[:at], *[slice(None)] * (rank - len(entries) + 1), *entries[at + 1 :])


def _contiguous(at) -> bool:
    return len(at) > 0 and bool(np.all(np.diff(np.asarray(at)) == 1))


def normalise(index, shape: tuple[int, ...], mode: str = "plain", strict: bool = False) -> Selection:
    """A Selection from a NumPy index.

    mode "plain" is a[...], where arrays broadcast together; "outer" crosses the axes' lists, and
    drops axes with an integer; "pointwise" wants an integer or array for every axis. Lists that
    are unit-step ranges become ranges where they act alone.
    """
    if mode not in ("plain", "outer", "pointwise"):
        raise ValueError(f"unknown mode {mode!r}")
    shape = tuple(int(n) for n in shape)
    entries = expanded(index, len(shape))
    axes: list = []
    lists: dict[int, np.ndarray] = {}
    for axis, (entry, size) in enumerate(zip(entries, shape, strict=True)):
        if isinstance(entry, (bool, np.bool_)):
            raise IndexError("a boolean is not an index")
        if isinstance(entry, (int, np.integer)):
            axes.append(Point(_wrapped(int(entry), size, axis)))
        elif isinstance(entry, slice):
            start, stop, step = entry.indices(size)
            count = len(range(start, stop, step))
            if strict and count > 1 and step != 1:
                raise DiscontiguousArrayError(f"strict mode takes slices of step 1 only, not {step}")
            axes.append(Range(start, count, step))
        elif isinstance(entry, (list, np.ndarray, range, tuple)):
            lists[axis] = _list(entry, size, axis)
            axes.append(None)
        else:
            raise ValueError(f"unsupported index {entry!r}")
    if mode == "pointwise" and any(isinstance(a, Range) for a in axes):
        raise IndexError("a pointwise index needs an integer or array for each axis")
    if strict:
        _decline(lists, mode)
    if mode == "outer" or not lists:
        for axis, at in lists.items():
            if at.ndim != 1:
                raise IndexError("outer indexing needs one-dimensional arrays")
            axes[axis] = Range(int(at[0]), len(at)) if _contiguous(at) else Gather(tuple(at.tolist()))
        out = tuple(k for k, a in enumerate(axes) if not isinstance(a, Point))
        sizes = tuple(a.count if isinstance(a, Range) else len(a.at) for a in axes if not isinstance(a, Point))
        return Selection(shape, tuple(axes), None, out, sizes)
    together = [k for k, a in enumerate(axes) if a is None or isinstance(a, Point)]
    try:
        cast = np.broadcast_arrays(*[lists[k] if k in lists else np.array(axes[k].at) for k in together])
    except ValueError as error:
        raise IndexError(f"shape mismatch: {error}") from None
    adjacent = together == list(range(together[0], together[-1] + 1))
    joint = tuple(("points", k) for k in range(cast[0].ndim))
    rest = [k for k in range(len(shape)) if k not in together]
    before = [k for k in rest if k < together[0]] if adjacent else []
    after = [k for k in rest if k not in before]
    out = (*before, *joint, *after)
    if len(together) == 1 and cast[0].ndim == 1:  # a list that acts alone
        at = cast[0]
        axes[together[0]] = Range(int(at[0]), len(at)) if _contiguous(at) else Gather(tuple(at.tolist()))
        out = tuple(together[0] if isinstance(o, tuple) else o for o in out)
        sizes = tuple(a.count if isinstance(a, Range) else len(a.at) for a in (axes[o] for o in out))
        return Selection(shape, tuple(axes), None, out, sizes)
    points = Points(tuple(together), tuple(tuple(c.ravel().tolist()) for c in cast), cast[0].shape)
    for k in together:
        axes[k] = None
    sizes = tuple(points.shape[o[1]] if isinstance(o, tuple) else axes[o].count for o in out)
    return Selection(shape, tuple(axes), points, out, sizes)


def _decline(lists: dict[int, np.ndarray], mode: str) -> None:
    """What strict mode refuses: lists with gaps, and points that don't fill the box of their lists."""
    boxes = []
    for at in lists.values():
        steps = np.diff(at.ravel())
        if not (np.all(steps == 1) or np.all(steps == 0)):
            raise DiscontiguousArrayError("an integer array is not a unit-step range")
        boxes.append(at.size if np.all(steps == 1) else 1)
    sizes = [at.size for at in lists.values()] if mode == "outer" else [int(np.prod(np.broadcast_shapes(*[at.shape for at in lists.values()])))] if lists else []
    if np.prod(boxes) != np.prod(sizes):
        raise UnsupportedVIndexingError("the points don't fill a box")


def result_shape(index, shape: tuple[int, ...], mode: str = "plain") -> tuple[int, ...]:
    """The shape of a[index], without any job."""
    return normalise(index, shape, mode).result_shape

"""Chunks in tasks: numbering, fetching with partial decoding, updating and erasing."""

from __future__ import annotations

from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from ..plans.meta import ArrayMeta
from ..plans.selection import Gather, Point, Range, Selection
from ..sources.store import Store

#: Cells of one Arrow batch.
CELLS = 1 << 18


def cell_schema(meta: ArrayMeta) -> T.StructType:
    return T.StructType([*[T.StructField(f"i{k}", T.LongType()) for k in range(len(meta.shape))], T.StructField("value", meta.spark_type())])


def to_arrow(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Flat NumPy values as the Spark type's Arrow array."""
    if x.dtype.names:
        return pa.StructArray.from_arrays([to_arrow(np.ascontiguousarray(x[n]), kind.field(n).type) for n in x.dtype.names], fields=[kind.field(n) for n in x.dtype.names])
    if x.dtype.kind == "c":
        return pa.StructArray.from_arrays([to_arrow(np.ascontiguousarray(p), kind.field(n).type) for n, p in (("re", x.real), ("im", x.imag))], fields=[kind.field("re"), kind.field("im")])
    if pa.types.is_decimal(kind):
        return pa.array([Decimal(int(v)) for v in x], kind)
    if x.dtype.kind in "Mm":
        return pa.array(x.view(np.int64), kind)
    if x.dtype.kind in "OU":
        return pa.array([str(v) for v in x], kind)
    if x.dtype.kind in "SV":
        return pa.array([bytes(v) if x.dtype.kind == "V" else v for v in x.tolist()] if x.dtype.kind == "S" else [v.tobytes() for v in x], kind)
    return pa.array(x).cast(kind)


def from_arrow(values: pa.Array, kind: np.dtype) -> np.ndarray:
    """The reverse. Numbers that the array's type can't hold are an error."""
    if values.null_count:
        raise ValueError("a cell can't be null")
    if kind.names:
        out = np.empty(len(values), kind)
        for n in kind.names:
            out[n] = from_arrow(values.field(n), kind[n])
        return out
    if kind.kind == "c":
        return (values.field("re").to_numpy(zero_copy_only=False) + 1j * values.field("im").to_numpy(zero_copy_only=False)).astype(kind)
    if kind.kind in "OUSV":
        out = np.empty(len(values), kind)
        out[:] = values.to_pylist() if kind.kind != "V" else [np.void(v) for v in values.to_pylist()]
        return out
    if kind.kind in "Mm":
        return values.to_numpy(zero_copy_only=False).astype(np.int64).view(kind)
    if pa.types.is_decimal(values.type):
        return np.array([int(v) for v in values.to_pylist()], kind)
    got = values.to_numpy(zero_copy_only=False)
    if kind.kind in "iu" and got.dtype.kind in "iu" and len(got):
        limits = np.iinfo(kind)
        if int(got.min()) < limits.min or int(got.max()) > limits.max:
            raise OverflowError(f"a value doesn't fit {kind}")
    return got.astype(kind)


def load(store: Store, meta: ArrayMeta, at: tuple[int, ...], box: list[tuple[int, int]] | None = None) -> np.ndarray | None:
    """A chunk, or None if it isn't stored. Of a shard, only inner chunks that the box meets are read."""
    chain = meta.chain()
    shard = chain.sharded()
    if shard is not None and box is not None:
        found = store.reader(meta.key(at))
        return None if found is None else shard.partial(found[1], found[0], meta.chunks, box)
    data = store.get(meta.key(at))
    return None if data is None else chain.decode(data, meta.chunks)


def save(store: Store, meta: ArrayMeta, at: tuple[int, ...], x: np.ndarray, keep_empty: bool = False, prefix: str = "") -> bool:
    """Store a chunk, or erase it where all of it is fill. True if it was stored."""
    if x.shape != tuple(meta.chunks):
        raise ValueError(f"a chunk of shape {x.shape} where {meta.chunks} is due")
    if not keep_empty and meta.is_fill(x):
        if prefix:
            store.set(f"{prefix}/erase/{meta.key(at)}", b"")
        else:
            store.erase(meta.key(at))
        return False
    store.set(f"{prefix}/set/{meta.key(at)}" if prefix else meta.key(at), meta.chain().encode(x, meta.chunks))
    return True


def chunk_box(meta: ArrayMeta, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The chunks (start, stop by axis) that a box of cells meets."""
    return [(a // c, -(-b // c)) if b > a else (0, 0) for (a, b), c in zip(bounds, meta.chunks, strict=True)]


class Touched:
    """The chunks that hold a selected cell, numbered. Along an axis they come from the selector: all
    that a range or a short step meets, one for each step that is longer than a chunk, those of a list;
    of points, the chunks that hold one. Nothing is kept that is longer than the caller's own lists."""

    def __init__(self, selection: Selection, chunks: tuple[int, ...]):
        self.rank, self.chunks = len(chunks), chunks
        #: axes that go together, their number of chunks, and what gives the chunk by number
        self.groups: list[tuple[tuple[int, ...], int, tuple]] = []
        self.lists: dict[int, np.ndarray] = {}
        self.points = None
        for k, (selector, c) in enumerate(zip(selection.axes, chunks, strict=True)):
            if isinstance(selector, Gather):
                self.lists[k] = np.unique(np.asarray(selector.at, np.int64))
                own = np.unique(self.lists[k] // c)
                self.groups.append(((k,), len(own), ("list", own[:, None])))
            elif isinstance(selector, Range) and selector.count and abs(selector.step) > c:
                self.groups.append(((k,), selector.count, ("steps", selector.start, selector.step, c)))
            elif selector is not None:
                start, stop = selector.bounds()
                first, last = (start // c, -(-stop // c)) if stop > start else (0, 0)
                self.groups.append(((k,), last - first, ("run", first)))
        if selection.points is not None:
            axes = tuple(selection.points.axes)
            self.points = axes, np.stack([np.asarray(a, np.int64).reshape(-1) for a in selection.points.at], axis=1)
            own = np.unique(self.points[1] // np.array([chunks[k] for k in axes]), axis=0)
            self.groups.append((axes, len(own), ("list", own)))

    @property
    def count(self) -> int:
        return prod(n for _, n, _ in self.groups)

    def chunk(self, number: int) -> tuple[int, ...]:
        at = [0] * self.rank
        for axes, n, (kind, *how) in reversed(self.groups):
            number, k = divmod(number, n)
            if kind == "list":
                place = how[0][k].tolist()
            else:
                place = [how[0] + k] if kind == "run" else [(how[0] + k * how[1]) // how[2]]
            for axis, value in zip(axes, place, strict=True):
                at[axis] = value
        return tuple(at)

    def within(self, at: tuple[int, ...], bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The bounds, drawn in to what lists and points select of a chunk, so that of a shard only the
        inner chunks between are read."""
        out = list(bounds)
        for k, places in self.lists.items():
            a, b = np.searchsorted(places, [at[k] * self.chunks[k], (at[k] + 1) * self.chunks[k]])
            out[k] = (int(places[a]), int(places[b - 1]) + 1)
        if self.points is not None:
            axes, places = self.points
            own = places[(places // np.array([self.chunks[k] for k in axes]) == np.array([at[k] for k in axes])).all(axis=1)]
            for n, k in enumerate(axes):
                out[k] = (int(own[:, n].min()), int(own[:, n].max()) + 1)
        return out


def numbered(n: int, box: list[tuple[int, int]]) -> tuple[int, ...]:
    """Chunk n of a box of chunks, in row-major order."""
    at = []
    for a, b in reversed(box):
        n, rest = divmod(n, b - a)
        at.append(a + rest)
    return tuple(reversed(at))


def cells_of(store: Store, meta: ArrayMeta, at: tuple[int, ...], bounds: list[tuple[int, int]], schema: pa.Schema, missing: bool = True):
    """Record batches of a chunk's cells within bounds. Chunks that aren't stored give fill values,
    or nothing if missing is False."""
    origin = [k * c for k, c in zip(at, meta.chunks, strict=True)]
    local = [(max(a - o, 0), min(b - o, c, s - o)) for (a, b), o, c, s in zip(bounds, origin, meta.chunks, meta.shape, strict=True)]
    sizes = [max(b - a, 0) for a, b in local]
    total = prod(sizes)
    if not total:
        return
    chunk = load(store, meta, at, local)
    if chunk is None:
        if not missing:
            return
        part = np.broadcast_to(meta.full(()), sizes)
    else:
        part = chunk[tuple(slice(a, b) for a, b in local)]
    flat = part.reshape(-1)
    for start in range(0, total, CELLS):
        stop = min(start + CELLS, total)
        places = np.unravel_index(np.arange(start, stop), sizes) if sizes else ()
        columns = [pa.array(p + (o + a)) for p, o, (a, _) in zip(places, origin, local, strict=True)]
        columns.append(to_arrow(np.ascontiguousarray(flat[start:stop]), schema.field("value").type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def arrow_schema(meta: ArrayMeta) -> pa.Schema:
    return to_arrow_schema(cell_schema(meta))


def hits(selection: Selection, at: tuple[int, ...], chunks: tuple[int, ...]) -> list[np.ndarray]:
    """Places within a chunk that points, ranges and lists select, by axis."""
    out = []
    for selector, k, c in zip(selection.axes, at, chunks, strict=True):
        low, high = k * c, (k + 1) * c
        if isinstance(selector, Point):
            places = np.array([selector.at])
        elif isinstance(selector, Range):
            step = selector.step
            first = selector.start if step > 0 else selector.start + (selector.count - 1) * step
            step = abs(step)
            skip = max(0, -(-(low - first) // step))
            places = np.arange(first + skip * step, min(high, first + selector.count * step), step)
        else:
            places = np.unique(np.asarray(selector.at if isinstance(selector, Gather) else [], np.int64))
        out.append(places[(places >= low) & (places < high)] - low)
    return out


def update(store: Store, meta: ArrayMeta, at: tuple[int, ...], places: list[np.ndarray], values, keep_empty: bool = False, prefix: str = "", outer: bool = False) -> bool:
    """Set cells of a chunk; only a chunk that isn't wholly overwritten is read first."""
    index = np.ix_(*places) if outer and places else tuple(places)
    count = prod(len(p) for p in places) if outer else (len(places[0]) if places else 1)
    chunk = None
    if count < prod(meta.chunks):
        chunk = load(store, meta, at)
    chunk = meta.full(meta.chunks) if chunk is None else np.array(chunk)
    chunk[index] = values
    return save(store, meta, at, chunk, keep_empty, prefix)

"""The data source "lattice": arrays by spark.read and df.write.

Reading gives cells; comparisons of i* with numbers choose the chunks that are read. Writing
updates the array at the path with the cells given. All cells of a chunk must be in one task, as
keyed() deals them; tasks write to a staging folder, and the driver moves what they wrote.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators import cells as C
from ..operators import chunks as K
from ..plans.meta import DOCUMENTS, ArrayMeta
from .store import ReadOnlyError, Store


def _meta(store: Store) -> ArrayMeta:
    for document in DOCUMENTS.values():
        if (text := store.get(document)) is not None:
            return ArrayMeta.from_json(text.decode())
    raise FileNotFoundError(f"no array at {store.uri}")


@dataclass
class Chunks(InputPartition):
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    stored: tuple[str, ...]
    erased: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, store: Store, meta: ArrayMeta, tasks: int):
        self.store, self.meta, self.tasks = store, meta, tasks
        self.bounds = [(0, n) for n in meta.shape]

    def pushFilters(self, filters):
        """Narrows the box of cells. Every filter is left to Spark too, so a wide box is safe."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if len(name) == 1 and name[0][:1] == "i" and name[0][1:].isdigit() and int(name[0][1:]) < len(self.bounds):
                k = int(name[0][1:])
                a, b = self.bounds[k]
                if isinstance(f, EqualTo):
                    a, b = max(a, f.value), min(b, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    a = max(a, f.value)
                elif isinstance(f, GreaterThan):
                    a = max(a, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    b = min(b, f.value + 1)
                elif isinstance(f, LessThan):
                    b = min(b, f.value)
                elif isinstance(f, In) and f.value:
                    a, b = max(a, min(f.value)), min(b, max(f.value) + 1)
                self.bounds[k] = (a, max(a, b))
            yield f

    def partitions(self):
        total = prod(b - a for a, b in K.chunk_box(self.meta, self.bounds))
        tasks = max(1, min(total, self.tasks))
        return [Chunks(total * n // tasks, total * (n + 1) // tasks) for n in range(tasks)]

    def read(self, partition: Chunks):
        schema, box = K.arrow_schema(self.meta), K.chunk_box(self.meta, self.bounds)
        for n in range(partition.first, partition.last):
            yield from K.cells_of(self.store, self.meta, K.numbered(n, box), self.bounds, schema)


class Writer(DataSourceArrowWriter):
    def __init__(self, store: Store, meta: ArrayMeta, keep_empty: bool):
        self.store, self.meta, self.keep_empty = store, meta, keep_empty
        self.staging = f".staging/{uuid.uuid4().hex}"

    def write(self, iterator):
        rank, meta = len(self.meta.shape), self.meta
        held: dict[tuple, list] = {}
        done: list[tuple[str, bool]] = []

        def flush(at: tuple) -> None:
            places = [np.concatenate([p[k] for p, _ in held[at]]) for k in range(rank)]
            values = np.concatenate([v for _, v in held.pop(at)])
            done.append((meta.key(at), K.update(self.store, meta, at, places, values, self.keep_empty, self.staging)))

        for batch in iterator:
            places = [batch.column(batch.schema.get_field_index(f"i{k}")).to_numpy() for k in range(rank)]
            values = K.from_arrow(batch.column(batch.schema.get_field_index("value")), meta.numpy_dtype)
            owners = np.stack([p // c for p, c in zip(places, meta.chunks, strict=True)], 1) if rank else np.zeros((len(values), 0), np.int64)
            unique, which = np.unique(owners, axis=0, return_inverse=True) if len(owners) else (owners, owners)
            present = {tuple(int(k) for k in row) for row in unique}
            for n, row in enumerate(unique):
                at, mask = tuple(int(k) for k in row), np.ravel(which) == n
                held.setdefault(at, []).append(([p[mask] - k * c for p, k, c in zip(places, at, meta.chunks, strict=True)], values[mask]))
            # rows are dealt and sorted by chunk: a chunk that this batch lacks is complete
            for at in [a for a in held if a not in present]:
                flush(at)
        for at in list(held):
            flush(at)
        return Written(tuple(k for k, stored in done if stored), tuple(k for k, stored in done if not stored))

    def commit(self, messages):
        keys = [k for m in messages if m for k in (*m.stored, *m.erased)]
        if len(set(keys)) < len(keys):
            self.store.clear(self.staging)
            raise ValueError("cells of one chunk came from several tasks; deal them with keyed() first")
        for message in messages:
            for key in message.stored if message else ():
                self.store.move(f"{self.staging}/set/{key}", key)
            for key in message.erased if message else ():
                self.store.erase(key)
        self.store.clear(self.staging)

    def abort(self, messages):
        self.store.clear(self.staging)


class LatticeSource(DataSource):
    """Options: path; mode "r" refuses writes; tasks (default 64); write_empty_chunks."""

    @classmethod
    def name(cls):
        return "lattice"

    def _store(self) -> Store:
        return Store(self.options["path"], read_only=self.options.get("mode") == "r")

    def schema(self):
        return K.cell_schema(_meta(self._store()))

    def reader(self, schema):
        store = self._store()
        return Reader(store, _meta(store), int(self.options.get("tasks", 64)))

    def writer(self, schema, overwrite):
        store = self._store()
        if store.read_only:
            raise ReadOnlyError("store was opened in read-only mode")
        return Writer(store, _meta(store), str(self.options.get("write_empty_chunks", "false")).lower() == "true")


def keyed(cells: DataFrame, chunks: tuple[int, ...]) -> DataFrame:
    """Cells dealt so that a chunk's cells are in one task, next to each other."""
    names = [f"c{k}" for k in range(len(chunks))]
    return C.chunk_columns(cells, chunks).repartition(*names).sortWithinPartitions(*names).drop(*names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LatticeSource)

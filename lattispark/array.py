"""ChunkArray: create, open, select, assign and resize arrays in a store."""

from __future__ import annotations

import warnings
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cells as C
from .operators import chunks as K
from .plans.meta import DOCUMENTS, ArrayMeta, UnsupportedMetadataError
from .plans.selection import Selection, normalise
from .sources.store import ReadOnlyError, Store


class ChunkArray:
    """An array in a store. Plans are made on the driver from metadata alone; chunks are numbered
    by spark.range and read or written in tasks, so no list of chunks is ever made.

    One writer at a time: a chunk that two jobs update at once keeps one of the two.
    """

    def __init__(self, spark: SparkSession, store: Store, meta: ArrayMeta, strict: bool = False, write_empty_chunks: bool = False, chunk_concurrent_minimum: int = 4, chunk_concurrent_maximum: int | None = None):
        self.spark, self.store, self.meta, self.strict = spark, store, meta, strict
        self.write_empty_chunks = write_empty_chunks
        self.minimum, self.maximum = chunk_concurrent_minimum, chunk_concurrent_maximum

    @classmethod
    def create(cls, spark: SparkSession, uri: str, meta: ArrayMeta, **options) -> "ChunkArray":
        store = Store(uri)
        store.set(DOCUMENTS[meta.version], meta.to_json().encode())
        return cls(spark, store, meta, **options)

    @classmethod
    def open(cls, spark: SparkSession, uri: str, mode: str = "r+", strict: bool = False, validate_checksums: bool | None = None, direct_io: bool = False, file_handle_cache_size: int = 0, **options) -> "ChunkArray":
        """mode "r" refuses writes. Metadata that can't be served is an error."""
        store = Store(uri, read_only=mode == "r", direct_io=direct_io, file_handle_cache_size=file_handle_cache_size)
        for document in DOCUMENTS.values():
            if (text := store.get(document)) is not None:
                meta = ArrayMeta.from_json(text.decode(), validate_checksums=validate_checksums is not False)
                return cls(spark, store, meta, strict, **options)
        raise FileNotFoundError(f"no array at {uri}")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.meta.shape

    def _plan(self, box: list[tuple[int, int]], total: int | None = None) -> DataFrame:
        """Numbers of the chunks in a box, or of so many, dealt out to a bounded number of tasks."""
        total = prod(b - a for a, b in box) if total is None else total
        most = self.maximum or 16 * self.spark.sparkContext.defaultParallelism
        return self.spark.range(0, total, 1, max(1, min(total, max(self.minimum, most))))

    def _selection(self, index, mode: str) -> Selection:
        if self.strict:
            self.meta.strict_check()
        return normalise(index, self.meta.shape, mode, self.strict)

    def _cells(self, bounds: list[tuple[int, int]], missing: bool = True) -> DataFrame:
        store, meta, box = self.store, self.meta, K.chunk_box(self.meta, bounds)

        def run(stream):
            schema = K.arrow_schema(meta)
            for batch in stream:
                for n in batch.column(0).to_pylist():
                    yield from K.cells_of(store, meta, K.numbered(n, box), bounds, schema, missing)

        return self._plan(box).mapInArrow(run, K.cell_schema(meta))

    def _selected(self, selection: Selection) -> DataFrame:
        """Cells of the chunks that the selection touches, within its bounds."""
        store, meta, bounds = self.store, self.meta, selection.bounds()
        touched = K.Touched(selection, meta.chunks)

        def run(stream):
            schema = K.arrow_schema(meta)
            for batch in stream:
                for n in batch.column(0).to_pylist():
                    at = touched.chunk(n)
                    yield from K.cells_of(store, meta, at, touched.within(at, bounds), schema)

        return self._plan([], touched.count).mapInArrow(run, K.cell_schema(meta))

    def cells(self) -> DataFrame:
        """Every cell."""
        return self._cells([(0, n) for n in self.meta.shape])

    def stored(self) -> DataFrame:
        """The cells of chunks that are stored: the array's sparse form."""
        return self._cells([(0, n) for n in self.meta.shape], missing=False)

    def select(self, index=Ellipsis, mode: str = "plain") -> DataFrame:
        """a[index] as cells of the result; only chunks that hold a selected cell are read, and of a shard
        the inner chunks between the selected cells."""
        selection = self._selection(index, mode)
        return C.apply(self._selected(selection), selection)

    def read(self, index=Ellipsis, mode: str = "plain") -> np.ndarray:
        """a[index] as a NumPy array on the driver."""
        selection = self._selection(index, mode)
        got = C.apply(self._selected(selection), selection).toArrow()
        out = self.meta.full(selection.result_shape)
        values = K.from_arrow(got.column("value").combine_chunks(), self.meta.numpy_dtype)
        if not selection.result_shape:
            out[()] = values[0]
        else:
            out[tuple(got.column(f"i{k}").to_numpy() for k in range(len(selection.result_shape)))] = values
        return out

    def _check_writable(self) -> None:
        if self.store.read_only:
            raise ReadOnlyError("store was opened in read-only mode")

    def assign(self, index, value, mode: str = "plain") -> None:
        """a[index] = value: a scalar, a NumPy array that broadcasts, or a DataFrame of cells along
        the result. Whole chunks are overwritten unread; chunks that become all fill are erased."""
        self._check_writable()
        selection = self._selection(index, mode)
        if isinstance(value, DataFrame):
            return self._scatter(C.placed(value, selection))
        array = np.asarray(value, self.meta.numpy_dtype)
        if array.ndim == 0 and selection.points is None:
            return self._constant(selection, array[()])
        array = np.broadcast_to(array, selection.result_shape)
        return self._scatter(C.placed(self.frame(array), selection))

    def frame(self, array: np.ndarray) -> DataFrame:
        """A NumPy array as cells."""
        schema = K.cell_schema(self.meta)
        names = [f"i{k}" for k in range(array.ndim)]
        places = np.indices(array.shape).reshape(array.ndim, -1) if array.ndim else []
        values = K.to_arrow(np.ascontiguousarray(array).reshape(-1), K.arrow_schema(self.meta).field("value").type)
        return self.spark.createDataFrame(pa.table([*[pa.array(p) for p in places], values], names=[*names, "value"])).select(*names, F.col("value").cast(schema["value"].dataType).alias("value"))

    def _constant(self, selection: Selection, value) -> None:
        store, meta, keep = self.store, self.meta, self.write_empty_chunks
        box = K.chunk_box(meta, selection.bounds())

        def run(stream):
            for batch in stream:
                done = []
                for n in batch.column(0).to_pylist():
                    at = K.numbered(n, box)
                    places = K.hits(selection, at, meta.chunks)
                    if all(len(p) for p in places):
                        # cells beyond the array's edge belong to the chunk's padding
                        done.append(K.update(store, meta, at, places, value, keep, outer=True))
                yield pa.RecordBatch.from_pydict({"stored": pa.array(done, pa.bool_())})

        self._plan(box).mapInArrow(run, "stored boolean").agg(F.count("stored")).collect()

    def _scatter(self, cells: DataFrame) -> None:
        """Write cells by chunk: a group is one chunk, whose size is bounded by the metadata."""
        store, meta, keep = self.store, self.meta, self.write_empty_chunks
        rank = len(meta.shape)
        names = [f"c{k}" for k in range(rank)] or ["c"]
        keyed = C.chunk_columns(cells, meta.chunks) if rank else cells.withColumn("c", F.lit(0))

        def run(group: pa.Table) -> pa.Table:
            at = tuple(group.column(f"c{k}")[0].as_py() for k in range(rank))
            places = [group.column(f"i{k}").to_numpy() - at[k] * meta.chunks[k] for k in range(rank)]
            values = K.from_arrow(group.column("value").combine_chunks(), meta.numpy_dtype)
            return pa.table({"stored": [K.update(store, meta, at, places, values if rank else values[0], keep)]})

        keyed.groupBy(*names).applyInArrow(run, "stored boolean").agg(F.count("stored")).collect()

    def resize(self, shape: tuple[int, ...]) -> None:
        """Change the shape; chunks that lie outside of it are deleted, those at the edge stay whole."""
        self._check_writable()
        old, store = self.meta, self.store
        new = ArrayMeta(**{**{f: getattr(old, f) for f in old.__dataclass_fields__}, "shape": tuple(int(n) for n in shape)})
        box = [(0, n) for n in old.counts]

        def run(stream):
            for batch in stream:
                for n in batch.column(0).to_pylist():
                    at = K.numbered(n, box)
                    if any(k >= c for k, c in zip(at, new.counts, strict=True)):
                        store.erase(old.key(at))
                yield batch

        store.set(DOCUMENTS[new.version], new.to_json().encode())
        self.meta = new
        if any(a < b for a, b in zip(new.counts, old.counts, strict=True)):
            self._plan(box).mapInArrow(run, "id long").agg(F.count("id")).collect()


def open_array(spark: SparkSession, uri: str, strict: bool = False, **options) -> ChunkArray | None:
    """Like ChunkArray.open; without strict, metadata that can't be served is a warning and None."""
    try:
        return ChunkArray.open(spark, uri, strict=strict, **options)
    except UnsupportedMetadataError as error:
        if strict:
            raise
        warnings.warn(str(error), UserWarning, stacklevel=2)
        return None

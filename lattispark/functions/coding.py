"""Codecs over DataFrames: in SQL where a codec is arithmetic on cells, else chunk by chunk in Arrow.

Chunks have the columns c0 ... c{k-1} (long), key (string) and payload (binary). A chunk that is
all fill has no row.
"""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import chunks as K
from ..plans.meta import ArrayMeta


def _place(chunks: tuple[int, ...]) -> Column:
    """The row-major place of a cell in its chunk."""
    place = F.lit(0).cast("long")
    for k, n in enumerate(chunks):
        place = place * n + F.col(f"i{k}") % n
    return place


def _within(chunks: tuple[int, ...]) -> Window:
    return Window.partitionBy(*[F.expr(f"i{k} div {n}") for k, n in enumerate(chunks)]).orderBy(_place(chunks))


def delta(cells: DataFrame, chunks: tuple[int, ...]) -> DataFrame:
    """The first value of each chunk, then differences."""
    names = [f"i{k}" for k in range(len(chunks))]
    kind = cells.schema["value"].dataType
    return cells.select(*names, (F.col("value") - F.coalesce(F.lag("value").over(_within(chunks)), F.lit(0).cast(kind))).cast(kind).alias("value"))


def undelta(cells: DataFrame, chunks: tuple[int, ...]) -> DataFrame:
    """Running sums within each chunk: the reverse of delta()."""
    names = [f"i{k}" for k in range(len(chunks))]
    running = F.sum("value").over(_within(chunks).rowsBetween(Window.unboundedPreceding, 0))
    return cells.select(*names, running.cast(cells.schema["value"].dataType).alias("value"))


def shard_places(cells: DataFrame, shards: tuple[int, ...], inner: tuple[int, ...]) -> DataFrame:
    """Of each cell, its shard s* and its inner chunk c* there."""
    return cells.select(*[F.expr(f"i{k} div {n}").alias(f"s{k}") for k, n in enumerate(shards)], *[F.expr(f"i{k} % {n} div {m}").alias(f"c{k}") for k, (n, m) in enumerate(zip(shards, inner, strict=True))])


def shard_index(cells: DataFrame, shards: tuple[int, ...], inner: tuple[int, ...], fill, itemsize: int) -> DataFrame:
    """The index of uncompressed shards: offset and size of each inner chunk, in row-major order.
    Chunks of fill take no bytes, and their offset is null."""
    keys = [*[f"s{k}" for k in range(len(shards))], *[f"c{k}" for k in range(len(inner))]]
    kind = cells.schema["value"].dataType
    placed = shard_places(cells, shards, inner).columns
    rows = cells.select(*[F.expr(f"i{k} div {n}").alias(f"s{k}") for k, n in enumerate(shards)], *[F.expr(f"i{k} % {n} div {m}").alias(f"c{k}") for k, (n, m) in enumerate(zip(shards, inner, strict=True))], "value")
    assert placed == keys
    sizes = rows.groupBy(*keys).agg(F.bool_and(F.col("value").eqNullSafe(F.lit(fill).cast(kind))).alias("empty"))
    nbytes = F.when(F.col("empty"), 0).otherwise(prod(inner) * itemsize).cast("long")
    before = Window.partitionBy(*keys[: len(shards)]).orderBy(*keys[len(shards) :]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("nbytes", nbytes)
    offset = F.when(~F.col("empty"), F.coalesce(F.sum("nbytes").over(before), F.lit(0)))
    return sizes.select(*keys, offset.cast("long").alias("byte_offset"), "nbytes")


def encoded(cells: DataFrame, meta: ArrayMeta) -> DataFrame:
    """Chunks from cells; a group is one chunk, of bounded size. Cells that are missing are fill."""
    rank = len(meta.shape)
    names = [f"c{k}" for k in range(rank)]
    schema = ", ".join([*(f"{n} long" for n in names), "key string", "payload binary"])
    kinds = pa.schema([*((n, pa.int64()) for n in names), ("key", pa.string()), ("payload", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        at = tuple(group.column(n)[0].as_py() for n in names)
        places = tuple(group.column(f"i{k}").to_numpy() - at[k] * meta.chunks[k] for k in range(rank))
        chunk = meta.full(meta.chunks)
        chunk[places] = K.from_arrow(group.column("value").combine_chunks(), meta.numpy_dtype)
        if meta.is_fill(chunk):
            return kinds.empty_table()
        return pa.table([*[[k] for k in at], [meta.key(at)], [meta.chain().encode(chunk, meta.chunks)]], schema=kinds)

    return C.chunk_columns(cells, meta.chunks).groupBy(*names).applyInArrow(run, schema)


def decoded(chunks: DataFrame, meta: ArrayMeta) -> DataFrame:
    """Cells of the chunks that are there."""
    rank = len(meta.shape)

    def run(stream):
        schema, chain = K.arrow_schema(meta), meta.chain()
        for batch in stream:
            for n in range(batch.num_rows):
                at = [batch.column(k)[n].as_py() for k in range(rank)]
                chunk = chain.decode(batch.column(rank + 1)[n].as_py(), meta.chunks)
                origin = [a * c for a, c in zip(at, meta.chunks, strict=True)]
                sizes = [min(c, s - o) for c, s, o in zip(meta.chunks, meta.shape, origin, strict=True)]
                flat = np.ascontiguousarray(chunk[tuple(slice(0, s) for s in sizes)]).reshape(-1)
                for start in range(0, len(flat), K.CELLS):
                    stop = min(start + K.CELLS, len(flat))
                    places = np.unravel_index(np.arange(start, stop), sizes)
                    yield pa.RecordBatch.from_arrays([*[pa.array(p + o) for p, o in zip(places, origin, strict=True)], K.to_arrow(flat[start:stop], schema.field("value").type)], schema=schema)

    return chunks.select(*[f"c{k}" for k in range(rank)], "key", "payload").mapInArrow(run, K.cell_schema(meta))

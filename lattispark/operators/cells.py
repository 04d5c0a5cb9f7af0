"""Operators on arrays in cell form: columns i0 ... i{k-1} (long) and value.

All are DataFrame expressions, so that Catalyst pushes coordinate predicates to the scan. Lists
given by the caller travel as small tables and are broadcast up to BROADCAST entries.
"""

from __future__ import annotations

from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selection import Gather, Point, Range, Selection, normalise

#: Entries of a list that is broadcast at most; longer ones are joined by shuffle.
BROADCAST = 1_000_000


def axis(k: int) -> str:
    return f"i{k}"


def rank_of(cells: DataFrame) -> int:
    return sum(c[:1] == "i" and c[1:].isdigit() for c in cells.columns)


def from_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    """Cells of a two-dimensional array from rows of (row number, array)."""
    return df.select(F.col(row).cast("long").alias("i0"), F.posexplode(values).alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), "value")


def _small(df: DataFrame, data: dict[str, list[int]]) -> DataFrame:
    """A table of the caller's lists."""
    made = df.sparkSession.createDataFrame(pd.DataFrame(data, columns=list(data), dtype="int64"), ", ".join(f"{c} long" for c in data))
    return F.broadcast(made) if len(next(iter(data.values()))) <= BROADCAST else made


def pruned(cells: DataFrame, selection: Selection, chunks: tuple[int, ...] | None = None) -> DataFrame:
    """Cells within the selection's bounds. With chunks, predicates on chunk columns c* are added,
    which Catalyst can't derive from those on i*."""
    for k, (start, stop) in enumerate(selection.bounds()):
        if (start, stop) != (0, selection.shape[k]):
            cells = cells.where(F.col(axis(k)).between(start, stop - 1))
            if chunks and f"c{k}" in cells.columns and stop > start:
                cells = cells.where(F.col(f"c{k}").between(start // chunks[k], (stop - 1) // chunks[k]))
    return cells


def apply(cells: DataFrame, selection: Selection, chunks: tuple[int, ...] | None = None) -> DataFrame:
    """The selected cells, numbered from 0 along the axes of the result."""
    cells = pruned(cells, selection, chunks)
    place: dict = {}
    for k, selector in enumerate(selection.axes):
        column = F.col(axis(k))
        if isinstance(selector, Point):
            cells = cells.where(column == selector.at)
        elif isinstance(selector, Range):
            if selector.count == 0:
                cells = cells.where(F.lit(False))
            offset = column - selector.start
            if selector.step != 1:
                cells = cells.where(offset % selector.step == 0)
                offset = F.expr(f"({axis(k)} - {selector.start}) div {selector.step}")
            place[k] = offset
        elif isinstance(selector, Gather):
            wanted = _small(cells, {axis(k): list(selector.at), f"_p{k}": list(range(len(selector.at)))})
            cells = cells.join(wanted, axis(k))
            place[k] = F.col(f"_p{k}")
    if selection.points is not None:
        points = selection.points
        data = {axis(k): list(at) for k, at in zip(points.axes, points.at, strict=True)}
        total = prod(points.shape)
        for d in range(len(points.shape)):
            inner = prod(points.shape[d + 1 :])
            data[f"_q{d}"] = [n // inner % points.shape[d] for n in range(total)]
        if not points.shape:
            data["_q"] = [0]
        cells = cells.join(_small(cells, data), [axis(k) for k in points.axes])
        place |= {("points", d): F.col(f"_q{d}") for d in range(len(points.shape))}
    return cells.select(*[place[o].cast("long").alias(axis(n)) for n, o in enumerate(selection.out)], "value")


def select(cells: DataFrame, index, shape: tuple[int, ...], mode: str = "plain", strict: bool = False, chunks: tuple[int, ...] | None = None) -> DataFrame:
    """a[index] in cell form."""
    return apply(cells, normalise(index, shape, mode, strict), chunks)


def grid(spark, shape: tuple[int, ...], prefix: str = "i") -> DataFrame:
    """All coordinates of a box, made where they are used: a range, divided."""
    inner = [prod(shape[k + 1 :]) for k in range(len(shape))]
    numbers = spark.range(prod(shape))
    return numbers.select(*[F.expr(f"cast(id div {max(inner[k], 1)} % {max(shape[k], 1)} as long)").alias(f"{prefix}{k}") for k in range(len(shape))])


def filled(cells: DataFrame, shape: tuple[int, ...], fill) -> DataFrame:
    """Every cell of the box; those that are missing hold the fill value."""
    names = [axis(k) for k in range(len(shape))]
    kind = cells.schema["value"].dataType
    return grid(cells.sparkSession, shape).join(cells, names, "left").select(*names, F.coalesce("value", F.lit(fill).cast(kind)).alias("value"))


def inside(selection: Selection) -> Column:
    """Whether a cell lies in a selection of points and ranges."""
    test = F.lit(True)
    for k, selector in enumerate(selection.axes):
        column = F.col(axis(k))
        if isinstance(selector, Gather):
            test = test & column.isin(*selector.at)
        elif selector is not None:
            start, stop = selector.bounds()
            test = test & column.between(start, stop - 1)
            if isinstance(selector, Range) and abs(selector.step) > 1:
                test = test & ((column - selector.start) % selector.step == 0)
    return test


def assign_constant(cells: DataFrame, index, shape: tuple[int, ...], value, mode: str = "plain") -> DataFrame:
    """a[index] = constant, in one pass over the cells."""
    selection = normalise(index, shape, mode)
    kind = cells.schema["value"].dataType
    if selection.points is None:
        test = inside(selection)
    else:
        points = selection.points
        marks = _small(cells, {axis(k): list(at) for k, at in zip(points.axes, points.at, strict=True)}).distinct().withColumn("_hit", F.lit(True))
        cells = cells.join(marks, [axis(k) for k in points.axes], "left")
        test = inside(selection) & F.coalesce("_hit", F.lit(False))
    names = [axis(k) for k in range(len(shape))]
    return cells.select(*names, F.when(test, F.lit(value).cast(kind)).otherwise(F.col("value")).alias("value"))


def placed(values: DataFrame, selection: Selection) -> DataFrame:
    """Cells of a value array, numbered along the selection's result, moved to where they belong.
    Where a list names a place twice, the later value wins, as in NumPy."""
    columns: list[Column] = []
    names = {o: axis(n) for n, o in enumerate(selection.out)}
    rows = values.select(*[F.col(axis(n)).alias(f"_o{n}") for n in range(len(selection.out))], "value")
    order: list[Column] = []
    outs = {o: f"_o{n}" for n, o in enumerate(selection.out)}
    extra = False
    for k, selector in enumerate(selection.axes):
        if isinstance(selector, Point):
            columns.append(F.lit(selector.at).cast("long").alias(axis(k)))
        elif isinstance(selector, Range):
            columns.append((F.col(outs[k]) * selector.step + selector.start).cast("long").alias(axis(k)))
        elif isinstance(selector, Gather):
            rows = rows.join(_small(rows, {outs[k]: list(range(len(selector.at))), f"_a{k}": list(selector.at)}), outs[k])
            columns.append(F.col(f"_a{k}").alias(axis(k)))
            extra = extra or len(set(selector.at)) < len(selector.at)
        else:
            columns.append(F.col(f"_a{k}").alias(axis(k)))
    if selection.points is not None:
        points = selection.points
        total = prod(points.shape)
        data = {f"_a{k}": list(at) for k, at in zip(points.axes, points.at, strict=True)}
        for d in range(len(points.shape)):
            inner = prod(points.shape[d + 1 :])
            data[outs[("points", d)]] = [n // inner % points.shape[d] for n in range(total)]
        joins = [outs[("points", d)] for d in range(len(points.shape))]
        rows = rows.join(_small(rows, data), joins) if joins else rows.join(F.broadcast(_small(rows, data)), F.lit(True))
        extra = extra or len(set(zip(*points.at, strict=True))) < total
    order = [F.col(f"_o{n}") for n in range(len(names))]
    made = rows.select(*columns, "value", *order)
    targets = [axis(k) for k in range(len(selection.shape))]
    if not extra:
        return made.select(*targets, "value")
    last = F.max_by("value", F.struct(*[f"_o{n}" for n in range(len(names))]))
    return made.groupBy(*targets).agg(last.alias("value"))


def assign(cells: DataFrame, index, shape: tuple[int, ...], values: DataFrame, mode: str = "plain") -> DataFrame:
    """a[index] = values (cells along the result): new where there is one, else old."""
    names = [axis(k) for k in range(len(shape))]
    new = placed(values, normalise(index, shape, mode)).withColumnRenamed("value", "_new").withColumn("_set", F.lit(True))
    kind = cells.schema["value"].dataType
    both = cells.join(new, names, "left")
    return both.select(*names, F.when(F.col("_set"), F.col("_new").cast(kind)).otherwise(F.col("value")).alias("value"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of either side; where both have one, the new. For sparse arrays."""
    names = [axis(k) for k in range(rank_of(old))]
    left = old.select(*names, F.struct("value").alias("_old"))
    right = new.select(*names, F.struct("value").alias("_new"))
    return left.join(right, names, "full").select(*names, F.coalesce("_new", "_old")["value"].alias("value"))


def chunk_columns(cells: DataFrame, chunks: tuple[int, ...]) -> DataFrame:
    """Adds the chunk coordinates c*."""
    return cells.select("*", *[F.expr(f"i{k} div {n}").alias(f"c{k}") for k, n in enumerate(chunks)])


def live_chunks(cells: DataFrame, chunks: tuple[int, ...], fill) -> DataFrame:
    """Coordinates of chunks that hold anything but the fill value; the rest are erased. NaN
    equals NaN."""
    names = [f"c{k}" for k in range(len(chunks))]
    kind = cells.schema["value"].dataType
    empty = F.bool_and(F.col("value").eqNullSafe(F.lit(fill).cast(kind)))
    return chunk_columns(cells, chunks).groupBy(*names).agg(empty.alias("empty")).where(~F.col("empty")).select(*names)


def coverage(cells: DataFrame, selection: Selection, chunks: tuple[int, ...]) -> DataFrame:
    """For each chunk that the selection touches: how many of its cells, and whether it is whole."""
    names = [f"c{k}" for k in range(len(chunks))]
    hit = chunk_columns(pruned(cells, selection).where(inside(selection)), chunks)
    return hit.groupBy(*names).agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) == prod(chunks)).alias("is_whole"))


def padded(shape: tuple[int, ...], chunks: tuple[int, ...]) -> Column:
    """Cells of a chunk that lie outside the array's edge, by chunk coordinates."""
    inner = F.lit(1)
    for k, n in enumerate(chunks):
        inner = inner * F.least(F.lit(n), F.lit(shape[k]) - F.col(f"c{k}") * n)
    return F.lit(prod(chunks)) - inner


def resized(cells: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Cells within a new shape."""
    for k, n in enumerate(shape):
        cells = cells.where(F.col(axis(k)) < n)
    return cells


def transposed(cells: DataFrame, order: tuple[int, ...]) -> DataFrame:
    """Axis n of the result is axis order[n]."""
    if sorted(order) != list(range(len(order))):
        raise TypeError(f"{order} is not a permutation of the axes")
    return cells.select(*[F.col(axis(k)).alias(axis(n)) for n, k in enumerate(order)], "value")


def linear(shape: tuple[int, ...], order: str = "C") -> Column:
    """The place of a cell in row-major (C) or column-major (F) order."""
    place, step = F.lit(0).cast("long"), 1
    for k in range(len(shape)) if order == "F" else reversed(range(len(shape))):
        place = place + F.col(axis(k)) * step
        step *= shape[k]
    return place


def reshaped(cells: DataFrame, shape: tuple[int, ...], new: tuple[int, ...], order: str = "C") -> DataFrame:
    if prod(shape) != prod(new):
        raise ValueError(f"cannot reshape {shape} to {new}")
    rows = cells.select(linear(shape, order).alias("_n"), "value")
    out = []
    for k in range(len(new)):
        inner = prod(new[k + 1 :]) if order == "C" else prod(new[:k])
        out.append(F.expr(f"cast(_n div {max(inner, 1)} % {max(new[k], 1)} as long)").alias(axis(k)))
    return rows.select(*out, "value")

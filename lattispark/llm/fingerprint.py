"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes of the UTF-8 text ends a chunk wherever it falls in a
residue of the block size. Each chunk gives one of 64 characters. The block size is three times
a power of two, chosen by the text's length and halved while the signature is too short; the
fingerprint has the signatures at that size and at twice that size. Two fingerprints are
compared by edit distance at the sizes that both have.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from .common import batches, bounded, documents, narrow

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH, SMALLEST, WINDOW = 64, 3, 7
#: Two signatures are alike only if they share a run of so many characters.
SHARED = 4
#: Bytes whose rolling hash is worked out at once.
SLAB = 1 << 22


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the (up to) seven bytes that end at each place."""
    wide = data.astype(np.uint32) + np.uint32(1)
    total = wide.copy()
    factor = np.uint32(1)
    with np.errstate(over="ignore"):
        for back in range(1, min(WINDOW, len(wide))):
            factor = np.uint32((int(factor) * 0x9E3779B1) & 0xFFFFFFFF)
            total[back:] += wide[:-back] * factor
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
        total ^= total >> np.uint32(12)
    return total


def _triggers(raw: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where chunks can end at this block size or a larger one, and the hashes there."""
    places, hashes = [], []
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data), SLAB):
        before = min(at, WINDOW - 1)
        rolled = _rolling(data[at - before : at + SLAB])[before:]
        hit = np.flatnonzero(rolled % np.uint32(block) == block - 1)
        places.append(hit + at)
        hashes.append(rolled[hit])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(places), np.concatenate(hashes)


def _signature(raw: bytes, places: np.ndarray, length: int) -> str:
    """One character a chunk; the last chunk takes all that is left."""
    out, at = [], 0
    for end in (places[: length - 1] + 1).tolist():
        out.append(ALPHABET[zlib.crc32(raw[at:end]) & 63])
        at = end
    if at < len(raw):
        out.append(ALPHABET[zlib.crc32(raw[at:]) & 63])
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """block:signature:signature at twice the block; "3::" for an empty text, and for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    block = SMALLEST
    while block * LENGTH < len(raw):
        block *= 2
    while True:
        places, hashes = _triggers(raw, block)
        if block == SMALLEST or len(places) >= LENGTH // 2 - 1:
            break
        block //= 2
    # a multiple of the block: the places of the double block are among those of the block
    twice = places[hashes % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(raw, places, LENGTH)}:{_signature(raw, twice, LENGTH // 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        u = rows & masks.get(c, 0)
        rows = ((rows + u) | (rows - u)) & full
    return len(a) - rows.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (an exchange counts 2) over the joint length."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    size = min(SHARED, len(a), len(b))
    runs = {a[k : k + size] for k in range(len(a) - size + 1)}
    if not any(b[k : k + size] in runs for k in range(len(b) - size + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; equal fingerprints give 1, and so do those of two empty texts. Block sizes that
    are neither equal nor in the ratio of two to one give 0."""
    if x == y:
        return 1.0
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    a, b = int(a), int(b)
    if a == b:
        return max(_alike(a1, b1), _alike(a2, b2))
    if a == 2 * b:
        return _alike(a1, b2)
    if b == 2 * a:
        return _alike(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as many first characters of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(column: Column, cuts: list) -> Column:
    """How many of the ascending cuts are at most the column: first among every root-of-them-th,
    then among those that follow it."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    reached = lambda values: F.aggregate(values, F.lit(0), lambda n, c: n + F.when(column >= c, 1).otherwise(0))
    runs = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    coarse = reached(F.array(*[F.lit(run[0]) for run in runs]))
    fine = F.element_at(F.array(*[F.array(*[F.lit(c) for c in run]) for run in runs]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse > 0, (coarse - 1) * step + reached(fine)).otherwise(0)


#: Keys of each part that cuts are chosen by, where keys aren't numbers.
SAMPLED = 50


def _cuts(df: DataFrame, key: str, parts: int) -> list:
    """Keys, ascending, near the quantiles. Those of keys that aren't numbers come from SAMPLED x parts
    keys, chosen by hash; a bad choice makes parts uneven and changes no result."""
    if isinstance(df.schema[key].dataType, NumericType):
        found = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], min(1000 * parts, 100_000)).alias("e")).first()["e"]
        return sorted(set(found or []))
    few = df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key)).limit(SAMPLED * parts)
    ordered = [r[0] for r in few.orderBy(key).collect()]  # in Spark's order, not Python's
    return list(dict.fromkeys(ordered[k * len(ordered) // parts] for k in range(1, parts))) if ordered else []


def _seats(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of so many buckets, such that Spark deals the numbers to partitions of their own."""
    found: dict[int, int] = {}
    size = 32 * parts
    rows = spark.range(size).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(parts)).alias("p"))
    for r in rows.groupBy("p").agg(F.min("v").alias("v")).collect():
        found[r["p"]] = r["v"]
    return [found.get(p, size + p) for p in range(parts)]


def _with_next(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows of (bucket, ahead, key, text), such that each bucket holds a run of keys and, with
    ahead = 1, a copy of the row that comes next after it.

    Buckets are cut at keys of the table near its quantiles, so they hold about as many rows
    each; a key of many rows makes its bucket larger, and rows are streamed, never gathered.
    """
    lo = df.agg(F.min(key).alias("lo")).first()["lo"]
    cuts = [c for c in _cuts(df, key, parts) if c != lo] if parts > 1 else []
    starts = [lo, *cuts]
    column = F.col(key)
    rows = df.withColumn("bucket", F.coalesce(_bucket(column, cuts), F.lit(0)).cast("int")).withColumn("ahead", F.lit(0))
    # the first row of a bucket is also shown to the bucket before it; of equal keys, the least text
    first = rows.where(column.isin(starts) if lo is not None else F.lit(False))
    first = first.groupBy("bucket").agg(F.min(F.struct(F.col(key), F.col("text").isNotNull(), F.col("text"))).alias("x"))
    last = len(starts) - 1
    first = first.select(F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("ahead"), F.col(f"x.{key}").alias(key), F.col("x.text").alias("text"))
    return rows.select("bucket", "ahead", key, "text").unionByName(first)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of df: key, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited and near_next, in the order of the key (and text, where keys tie).

    The next document is the one with the next key; after the last comes the first. A single
    document is its own next. Null texts count as empty; rows with a null key come first in the
    order, but the last row is followed by the first with a key. Each text is shuffled once, and
    a task holds two documents at a time.
    """
    rows = narrow(df, key, text).toDF(key, "text")
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[key].dataType.simpleString()
    placed = _with_next(rows, key, parts)
    seats = F.array(*[F.lit(v) for v in _seats(spark, parts)])
    placed = placed.withColumn("bucket", F.element_at(seats, F.col("bucket") + 1))  # buckets of even size, one to a partition
    bounded(spark)
    dealt = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", F.col(key).asc_nulls_first(), F.col("text").asc_nulls_first())
    arrow_key = to_arrow_type(df.schema[key].dataType)

    def run(stream):
        held = None  # bucket, key, text and fingerprint of the row before
        out: list[list] = [[] for _ in range(7)]

        def emit(following: str, its: str) -> None:
            _, k, t, f = held
            changed = edited(t, following)
            e = fingerprint(changed)
            for column, value in zip(out, (k, len(t), changed, f, e, likeness(f, e), likeness(f, its)), strict=True):
                column.append(value)

        names = [key, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [arrow_key, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches()(stream):
            for bucket, ahead, k, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                t = t or ""
                f = fingerprint(t)
                if held is not None and held[0] == bucket:
                    emit(t, f)
                held = None if ahead else (bucket, k, t, f)
            if out[0]:
                yield flush()

    return dealt.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")

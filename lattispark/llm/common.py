"""What the text operators share: words, word codes, Arrow stages and working tables."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows and bytes of one Arrow batch. Some texts are very long, so bytes bind first.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Long texts are cut into words piece by piece, so that the list of words stays small.
PIECE = 1 << 20
#: Entries of a cache by word before it is emptied.
CACHE = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists; a list holds the words of about PIECE characters."""
    if not text:
        return
    at, size = 0, len(text)
    while size - at > PIECE:
        cut = WORD.search(text, at + PIECE)  # a word that begins before the cut may go on after it
        stop = at + PIECE
        if cut is None:
            break
        if cut.start() == stop and text[stop - 1] not in SPACES:
            stop = cut.end()
        yield WORD.findall(text, at, stop)
        at = stop
    yield WORD.findall(text, at)


_SPACE_BYTE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Words of more bytes are hashed one by one.
_LONG = 1 << 16


def count_words(text: str | None) -> int:
    """How many words a text has, from its bytes: spaces that a letter follows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    total, before = 0, True
    for at in range(0, len(raw), PIECE):
        space = _SPACE_BYTE[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)]
        total += int((space[:-1] > space[1:]).sum()) + int(before and not space[0])
        before = bool(space[-1])
    return total


class Codes:
    """64-bit codes of the words of a text, from its bytes: a polynomial of each word's bytes,
    mixed. Memory is bounded by PIECE and the longest word."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(0xC0DE + seed)
        self.of_byte = draw.integers(1, 1 << 63, 256).astype(np.uint64)
        self.powers = np.full(_LONG, 0x5851F42D4C957F2D, np.uint64)
        self.powers[0] = 1
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(self.powers, dtype=np.uint64)

    def _piece(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        inside = np.flatnonzero(~_SPACE_BYTE[data])
        if not len(inside):
            return np.empty(0, np.uint64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(inside) > 1) + 1])
        sizes = np.diff(np.append(first, len(inside)))
        place = np.arange(len(inside)) - np.repeat(first, sizes)
        if (longest := int(sizes.max())) > _LONG:
            place = np.minimum(place, _LONG - 1)
        with np.errstate(over="ignore"):
            out = mixed(np.add.reduceat(self.of_byte[data[inside]] * self.powers[place], first))
        if longest > _LONG:
            for k in np.flatnonzero(sizes > _LONG):
                start = int(inside[first[k]])
                out[k] = xxhash.xxh3_64_intdigest(raw[start : start + int(sizes[k])])
        return out

    def of(self, text: str | bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if len(raw) <= PIECE:
            return self._piece(raw)
        parts, at = [], 0
        while at < len(raw):
            gap = _GAP.search(raw, at + PIECE)
            stop = gap.start() if gap else len(raw)
            parts.append(self._piece(raw[at:stop]))
            at = stop
        return np.concatenate(parts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their low and high bits both spread."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(codes: np.ndarray, width: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each window of so many codes; empty if there are fewer. Hashes of
    windows of one, two, four ... codes are joined to those of the width asked for."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, span, step, at = codes, 1, np.uint64(seed | 1), 0
        total = None
        while True:
            if width & span:
                own = part[at : at + n]
                total = own.copy() if total is None else total * step + own
                at += span
            if span * 2 > width:
                return mixed(total)
            part, step, span = part[:-span] * step + part[span:], step * step, span * 2


def sliding(extreme: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The minimum or maximum of each window, by windows of one, two, four ... values."""
    n, span = len(values) - width + 1, 1
    while span * 2 <= width:
        values = extreme(values[:-span], values[span:])
        span *= 2
    return extreme(values[:n], values[width - span : width - span + n])


def batches(rows: int = BATCH_ROWS) -> Callable:
    """Cut incoming Arrow batches to a bounded number of rows and bytes, without copying."""

    def cut(stream):
        for batch in stream:
            size = max(1, batch.nbytes // max(1, batch.num_rows))
            step = int(max(1, min(rows, BATCH_BYTES // size)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    return cut


def give_back() -> None:
    """Give memory that this process has freed back to the system, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def arrow_stage(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """mapInArrow where make(), once per task, gives the function of one bounded batch.

    The function returns a record batch, or an iterable of them.
    """

    def run(stream):
        each = make()
        batch = out = None
        for batch in batches()(stream):
            out = each(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        del each, batch, out
        give_back()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches that the JVM sends, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one
    is set only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.lattispark.local.dir", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="lattispark-work-")
            spark.conf.set("spark.lattispark.local.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/lattispark/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a working table to the shared folder and read it again: it survives the loss
    of executors, cuts the lineage, and has known sizes for the planner."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.working_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete working tables that nothing reads any more."""
    for made in tables:
        remove(made.sparkSession, made.working_path)
        _made[:] = [x for x in _made if x[1] != made.working_path]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Delete the working tables of this process."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended, and with it the folder's use
            return


#: Bits of a bitmap of hashes, and of one row of it.
BITS, ROW = 27, 15


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """The lowest BITS bits of each value, as a bitmap: of 2**BITS bits, whatever the input."""

    def run(stream):
        for batch in stream:
            maps = []
            for low in batch.column(1).to_pylist():
                bits = np.zeros(1 << ROW, np.uint8)
                bits[low] = 1
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "bits": pa.array(maps, pa.binary())})

    place = F.col(column).bitwiseAND((1 << BITS) - 1)
    sets = values.select(F.shiftright(place, ROW).cast("int").alias("row"), place.bitwiseAND((1 << ROW) - 1).cast("int").alias("low")).groupBy("row").agg(F.collect_set("low").alias("lows"))
    out = np.zeros((1 << (BITS - ROW), 1 << (ROW - 3)), np.uint8)
    made = sets.mapInArrow(run, "row int, bits binary").toArrow()  # as many bytes as the bitmap at most
    for row, bits in zip(made.column("row").to_pylist(), made.column("bits").to_pylist(), strict=True):
        out[row] = np.frombuffer(bits, np.uint8)
    del made
    give_back()
    return out.reshape(-1)


def held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a bitmap may hold; false for those that it surely lacks."""
    place = (values & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that are read, so that other columns can't clash or be shipped."""
    return df.select(*[F.col(f"`{c}`") for c in columns])

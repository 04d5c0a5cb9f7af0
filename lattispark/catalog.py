"""The registered queries of the array engine and their SQL.

Arrays over the driver's tables: E is embeddings as a matrix, V events.value as a vector (also
reshaped to axes of ten), O orders.o_totalprice as a vector, D documents.text as a vector of
strings, and K the ragged turns of conversations as a sparse matrix of text lengths.
"""

from __future__ import annotations

import tempfile
import uuid
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .array import ChunkArray
from .functions import coding
from .operators import cells as C
from .plans.meta import ArrayMeta
from .plans.selection import normalise, result_shape

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WIDTH = 64


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_arrays(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))


def v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("i0"), F.col("value").cast("double").alias("value"))


def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values as an array of rank 4, a thousand to each step of the leading axis."""
    shape = v4_shape(spark, sf_dir)
    return C.reshaped(v(spark, sf_dir), (prod(shape),), shape)


def o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i0"), F.col("o_totalprice").cast("double").alias("value"))


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The length of a dense axis: a count from file footers."""
    return _table(spark, sf_dir, name).count()


def v4_shape(spark, sf_dir):
    """The leading axis grows with the events. It has ten steps at least, as the selections go up to
    the eighth; steps beyond the events hold no cells."""
    return max(10, -(-rows_of(spark, sf_dir, "events") // 1000)), 10, 10, 10


def e_shape(spark, sf_dir):
    return rows_of(spark, sf_dir, "embeddings"), WIDTH


E = f"E AS (SELECT vec_id::BIGINT AS i0, k::BIGINT AS i1, embedding[k + 1]::DOUBLE AS value FROM embeddings, range(0, {WIDTH}) AS t(k))"
#: Rows of the matrix with a column number from 1 beside each; joined by row, not by cell.
ROWS = f"R AS (SELECT vec_id, embedding, unnest(range(1, {WIDTH} + 1)) AS k FROM embeddings)"
V = "V AS (SELECT event_id::BIGINT AS i0, value::DOUBLE AS value FROM events)"
V4 = "V4 AS (SELECT event_id // 1000 AS i0, event_id // 100 % 10 AS i1, event_id // 10 % 10 AS i2, event_id % 10 AS i3, value::DOUBLE AS value FROM events)"
O = "O AS (SELECT o_orderkey::BIGINT AS i0, o_totalprice::DOUBLE AS value FROM orders)"
K = "K AS (SELECT conv_id::BIGINT AS i0, turn::BIGINT AS i1, length(text)::BIGINT AS value FROM conversations)"


# selections


@query(f"WITH {E} SELECT * FROM E")
def scan_full(spark, sf_dir):
    return C.select(e(spark, sf_dir), Ellipsis, e_shape(spark, sf_dir))


@query(f"WITH {E} SELECT i0 - 10 AS i0, i1 - 1 AS i1, value FROM E WHERE i0 BETWEEN 10 AND 19 AND i1 BETWEEN 1 AND 6")
def slice_2d(spark, sf_dir):
    return C.select(e(spark, sf_dir), (slice(10, 20), slice(1, 7)), e_shape(spark, sf_dir))


@query(f"WITH {V} SELECT i0 - 5 AS i0, value FROM V WHERE i0 >= 5 AND i0 < 23")
def slice_across_chunks(spark, sf_dir):
    """Chunks of 7: the bounds on c0 are derived from those on i0."""
    keyed = C.chunk_columns(v(spark, sf_dir), (7,))
    return C.select(keyed, slice(5, 23), (rows_of(spark, sf_dir, "events"),), chunks=(7,))


@query(f"WITH {E} SELECT i1 AS i0, value FROM E WHERE i0 = 2")
def int_index_drop_axis(spark, sf_dir):
    return C.select(e(spark, sf_dir), 2, e_shape(spark, sf_dir))


@query(f"WITH {E} SELECT 0::BIGINT AS i0, i1, value FROM E WHERE i0 = (SELECT max(i0) FROM E)")
def negative_index(spark, sf_dir):
    return C.select(e(spark, sf_dir), ([-1],), e_shape(spark, sf_dir))


@query(f"WITH {E} SELECT 0::BIGINT AS i0, i1, value FROM E WHERE i0 = 4")
def int_array_len1(spark, sf_dir):
    return C.select(e(spark, sf_dir), ([4],), e_shape(spark, sf_dir))


@query(f"WITH {E} SELECT i0 - 1 AS i0, i1, value FROM E WHERE i0 BETWEEN 1 AND 3")
def contiguous_gather(spark, sf_dir):
    return C.select(e(spark, sf_dir), ([1, 2, 3],), e_shape(spark, sf_dir))


@query(f"WITH {E}, g(p, i0) AS (VALUES (0::BIGINT, 6), (1, 0), (2, 3), (3, 3)) SELECT p AS i0, i1, value FROM E JOIN g USING (i0)")
def discontiguous_gather(spark, sf_dir):
    return C.select(e(spark, sf_dir), ([6, 0, 3, 3],), e_shape(spark, sf_dir))


@query(f"WITH {V} SELECT i0 // 3 AS i0, value FROM V WHERE i0 % 3 = 0")
def strided_slice(spark, sf_dir):
    return C.select(v(spark, sf_dir), slice(None, None, 3), (rows_of(spark, sf_dir, "events"),))


@query(f"WITH {E} SELECT 9 - i0 AS i0, i1, value FROM E WHERE i0 < 10")
def reversed_slice(spark, sf_dir):
    return C.select(e(spark, sf_dir), (slice(9, None, -1),), e_shape(spark, sf_dir))


@query(f"WITH {E} SELECT row_number() OVER (PARTITION BY i1 ORDER BY i0) - 1 AS i0, i1, value FROM E WHERE i0 IN (0, 2, 7)")
def boolean_index(spark, sf_dir):
    n, _ = e_shape(spark, sf_dir)
    return C.select(e(spark, sf_dir), ([k in (0, 2, 7) for k in range(n)],), (n, WIDTH))


@query(f"WITH {V4} SELECT i1 AS i0, i2 AS i1, i3 AS i2, value FROM V4 WHERE i0 = 2 AND i3 < 5")
def ellipsis_4d(spark, sf_dir):
    return C.select(v4(spark, sf_dir), (2, Ellipsis, slice(0, 5)), v4_shape(spark, sf_dir))


@query(f"WITH {E}, a(p, i0) AS (VALUES (0::BIGINT, 0), (1, 5), (2, 9)), b(q, i1) AS (VALUES (0::BIGINT, 3), (1, 1)) SELECT p AS i0, q AS i1, value FROM E JOIN a USING (i0) JOIN b USING (i1)")
def outer_index(spark, sf_dir):
    return C.select(e(spark, sf_dir), ([0, 5, 9], [3, 1]), e_shape(spark, sf_dir), "outer")


@query(f"WITH {E}, g(p, i0, i1) AS (VALUES (0::BIGINT, 0, 3), (1, 5, 1), (2, 9, 3)) SELECT p AS i0, value FROM E JOIN g USING (i0, i1)")
def pointwise_index(spark, sf_dir):
    return C.select(e(spark, sf_dir), ([0, 5, 9], [3, 1, 3]), e_shape(spark, sf_dir), "pointwise")


@query(f"WITH {V4}, g(p, i0, i2) AS (VALUES (0::BIGINT, 1, 4), (1, 7, 7)) SELECT p AS i0, i1, i3 AS i2, value FROM V4 JOIN g USING (i0, i2)")
def split_arrays_4d(spark, sf_dir):
    """Arrays on axes apart: their common axis comes first, as in NumPy."""
    return C.select(v4(spark, sf_dir), ([1, 7], slice(None), [4, 7]), v4_shape(spark, sf_dir))


@query(f"WITH {E} SELECT value FROM E WHERE i0 = 3 AND i1 = 5")
def point_lookup(spark, sf_dir):
    return C.select(e(spark, sf_dir), (3, 5), e_shape(spark, sf_dir))


@query("SELECT 10::BIGINT AS d0, 3::BIGINT AS d1, 2::BIGINT AS d2")
def result_shape_of(spark, sf_dir):
    shape = result_shape((slice(0, 10), 4, [1, 5, 2], slice(1, 5, 2)), (10, 10, 10, 10), "outer")
    return spark.range(1).select(*[F.lit(n).cast("long").alias(f"d{k}") for k, n in enumerate(shape)])


@query(f"WITH {E} SELECT i0 // 8 AS c0, i1 // 16 AS c1, count(*) AS n_cells, count(*) = 128 AS is_whole FROM E WHERE i0 BETWEEN 5 AND 29 AND i1 BETWEEN 16 AND 47 GROUP BY ALL")
def whole_vs_partial_chunks(spark, sf_dir):
    shape = e_shape(spark, sf_dir)
    return C.coverage(e(spark, sf_dir), normalise((slice(5, 30), slice(16, 48)), shape), (8, 16))


# filling and writing, in cell form


def k(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("i0"), F.col("turn").cast("long").alias("i1"), F.length("text").cast("long").alias("value"))


def k_shape(spark, sf_dir):
    found = k(spark, sf_dir).agg(F.max("i0"), F.max("i1")).first()
    return int(found[0]) + 1, int(found[1]) + 1


@query(f"WITH {K}, g AS (SELECT a.i AS i0, b.i AS i1 FROM range(0, (SELECT max(i0) + 1 FROM K)) AS a(i), range(0, (SELECT max(i1) + 1 FROM K)) AS b(i)) SELECT i0, i1, coalesce(value, -1)::BIGINT AS value FROM g LEFT JOIN K USING (i0, i1)")
def fill_missing(spark, sf_dir):
    return C.filled(k(spark, sf_dir), k_shape(spark, sf_dir), -1)


@query(f"WITH {E} SELECT i0, i1, CASE WHEN i0 BETWEEN 3 AND 11 AND i1 BETWEEN 60 AND 63 THEN 42.0 ELSE value END AS value FROM E")
def constant_write(spark, sf_dir):
    return C.assign_constant(e(spark, sf_dir), (slice(3, 12), slice(60, None)), e_shape(spark, sf_dir), 42.0)


@query(f"WITH {E} SELECT i0, i1, CASE WHEN (i0, i1) IN ((1, 1), (4, 9)) THEN 0.5 ELSE value END AS value FROM E")
def pointwise_write(spark, sf_dir):
    return C.assign_constant(e(spark, sf_dir), ([1, 4], [1, 9]), e_shape(spark, sf_dir), 0.5)


@query(f"WITH {ROWS} SELECT a.vec_id::BIGINT AS i0, (k - 1)::BIGINT AS i1, CASE WHEN a.vec_id BETWEEN 20 AND 29 AND k <= 32 THEN b.embedding[k + 32] ELSE a.embedding[k] END::DOUBLE AS value FROM R AS a LEFT JOIN embeddings AS b ON b.vec_id = a.vec_id - 20")
def array_write(spark, sf_dir):
    """a[20:30, :32] = a[0:10, 32:]"""
    cells, shape = e(spark, sf_dir), e_shape(spark, sf_dir)
    return C.assign(cells, (slice(20, 30), slice(0, 32)), shape, C.select(cells, (slice(0, 10), slice(32, None)), shape))


@query(f"WITH {ROWS} SELECT a.vec_id::BIGINT AS i0, (k - 1)::BIGINT AS i1, coalesce(b.embedding, a.embedding)[k]::DOUBLE AS value FROM R AS a LEFT JOIN embeddings AS b ON b.vec_id = CASE a.vec_id WHEN 8 THEN 0 WHEN 2 THEN 1 END")
def partial_update(spark, sf_dir):
    """a[[8, 2]] = a[0:2]: single rows of chunks change."""
    cells, shape = e(spark, sf_dir), e_shape(spark, sf_dir)
    return C.assign(cells, ([8, 2],), shape, C.select(cells, slice(0, 2), shape))


@query(f"WITH {V}, w AS (SELECT i0, CASE WHEN i0 < 250 OR i0 % 50 >= 25 THEN 0.0 ELSE value END AS value FROM V) SELECT i0 // 25 AS c0 FROM w GROUP BY ALL HAVING NOT bool_and(value = 0.0)")
def erase_empty_chunks(spark, sf_dir):
    cells = v(spark, sf_dir).withColumn("value", F.when((F.col("i0") < 250) | (F.col("i0") % 50 >= 25), 0.0).otherwise(F.col("value")))
    return C.live_chunks(cells, (25,), 0.0)


@query(f"WITH {V} SELECT i0 // 10 AS c0 FROM (SELECT i0, CASE WHEN i0 < 30 THEN 'NaN'::DOUBLE ELSE value END AS value FROM V) GROUP BY ALL HAVING NOT bool_and(isnan(value))")
def nan_fill(spark, sf_dir):
    cells = v(spark, sf_dir).withColumn("value", F.when(F.col("i0") < 30, float("nan")).otherwise(F.col("value")))
    return C.live_chunks(cells, (10,), float("nan"))


@query(f"WITH {E}, m AS (SELECT max(i0) + 1 AS n FROM E) SELECT c0, c1, (30 * 20 - least(30, n - c0 * 30) * least(20, 64 - c1 * 20))::BIGINT AS n_padding FROM (SELECT DISTINCT i0 // 30 AS c0, i1 // 20 AS c1 FROM E), m")
def edge_chunk_padding(spark, sf_dir):
    shape = e_shape(spark, sf_dir)
    keys = C.chunk_columns(e(spark, sf_dir), (30, 20)).select("c0", "c1").distinct()
    return keys.withColumn("n_padding", C.padded(shape, (30, 20)).cast("long"))


@query(f"WITH {E} SELECT i0, i1, value FROM E WHERE i0 < 33 AND i1 < 10")
def resize_shrink(spark, sf_dir):
    return C.resized(e(spark, sf_dir), (33, 10))


# keys, orders, shards


@query(f"WITH {E} SELECT DISTINCT 'c/' || (i0 // 50) || '/' || (i1 // 16) AS key FROM E")
def chunk_keys_v3(spark, sf_dir):
    return C.chunk_columns(e(spark, sf_dir), (50, 16)).select("c0", "c1").distinct().select(F.concat_ws("/", F.lit("c"), "c0", "c1").alias("key"))


@query(f"WITH {E} SELECT DISTINCT (i0 // 50) || '.' || (i1 // 16) AS key FROM E")
def chunk_keys_v2(spark, sf_dir):
    return C.chunk_columns(e(spark, sf_dir), (50, 16)).select("c0", "c1").distinct().select(F.concat_ws(".", "c0", "c1").alias("key"))


@query(f"WITH {E} SELECT i1 AS i0, i0 AS i1, value FROM E")
def transpose(spark, sf_dir):
    return C.transposed(e(spark, sf_dir), (1, 0))


@query(f"WITH {V4} SELECT i1 AS i0, i2 AS i1, i0 AS i2, value FROM V4 WHERE i3 = 0")
def transpose_3d(spark, sf_dir):
    return C.transposed(C.select(v4(spark, sf_dir), (Ellipsis, 0), v4_shape(spark, sf_dir)), (1, 2, 0))


@query(f"WITH {E} SELECT i0 + i1 * (SELECT max(i0) + 1 FROM E) AS place, value FROM E")
def order_f_linear(spark, sf_dir):
    return e(spark, sf_dir).select(C.linear(e_shape(spark, sf_dir), "F").alias("place"), "value")


@query(f"WITH {E} SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, value FROM E")
def reshape_row_major(spark, sf_dir):
    n, width = e_shape(spark, sf_dir)
    return C.reshaped(e(spark, sf_dir), (n, width), (2 * n, width // 2))


@query("SELECT p_partkey::BIGINT AS i0, p_size::BIGINT AS value FROM part")
def delta_codec(spark, sf_dir):
    """Differences within chunks of 25 rows, and sums of them again."""
    cells = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i0"), F.col("p_size").cast("long").alias("value"))
    return coding.undelta(coding.delta(cells, (25,)), (25,))


@query("SELECT p_partkey::BIGINT AS i0, (p_size - coalesce(lag(p_size) OVER (PARTITION BY p_partkey // 25 ORDER BY p_partkey), 0))::BIGINT AS value FROM part")
def delta_encode(spark, sf_dir):
    cells = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i0"), F.col("p_size").cast("long").alias("value"))
    return coding.delta(cells, (25,))


@query(f"WITH {E} SELECT DISTINCT i0 // 64 AS s0, i1 // 32 AS s1, i0 % 64 // 16 AS c0, i1 % 32 // 8 AS c1 FROM E")
def shard_assignment(spark, sf_dir):
    return coding.shard_places(e(spark, sf_dir), (64, 32), (16, 8)).distinct()


@query(
    f"WITH {V}, w AS (SELECT i0, CASE WHEN i0 % 40 >= 30 THEN 0.0 ELSE value END AS value FROM V), c AS (SELECT i0 // 40 AS s0, i0 % 40 // 10 AS c0, bool_and(value = 0.0) AS empty FROM w GROUP BY ALL)"
    " SELECT s0, c0, CASE WHEN empty THEN NULL ELSE sum(CASE WHEN empty THEN 0 ELSE 80 END) OVER (PARTITION BY s0 ORDER BY c0 ROWS UNBOUNDED PRECEDING)::BIGINT - 80 END AS byte_offset, CASE WHEN empty THEN 0 ELSE 80 END::BIGINT AS nbytes FROM c"
)
def shard_index_offsets(spark, sf_dir):
    """Shards of 40 values in inner chunks of 10, uncompressed; a fourth of each is fill."""
    cells = v(spark, sf_dir).withColumn("value", F.when(F.col("i0") % 40 >= 30, 0.0).otherwise(F.col("value")))
    return coding.shard_index(cells, (40,), (10,), 0.0, 8)


@query("SELECT doc_id::BIGINT - 5 AS i0, text AS value FROM documents WHERE doc_id BETWEEN 5 AND 24")
def vlen_strings(spark, sf_dir):
    return C.select(vlen_texts(spark, sf_dir), slice(5, 25), (rows_of(spark, sf_dir, "documents"),))


def vlen_texts(spark, sf_dir):
    """Every text through the vlen-utf8 codec and back. A mark before each tells null and empty texts
    from the fill of ids that aren't there."""
    cells = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("i0"), F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.lit("+"), "text")).alias("value"))
    top = cells.agg(F.max("i0")).first()[0]
    meta = ArrayMeta((0 if top is None else top + 1,), (64,), "string", "", ({"name": "vlen-utf8"}, {"name": "zstd"}))
    back = coding.decoded(coding.encoded(cells, meta), meta).where("value <> ''")
    return back.select("i0", F.when(F.col("value") != "-", F.expr("substring(value, 2)")).alias("value"))


@query("SELECT o_orderkey::BIGINT AS i0, o_orderstatus AS value_status, o_totalprice::DOUBLE AS value_price FROM orders")
def structured_cells(spark, sf_dir):
    cells = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i0"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price")).alias("value"))
    return cells.select("i0", F.col("value.status").alias("value_status"), F.col("value.price").alias("value_price"))


# chunks through codecs, without a store


def _through(name: str, codecs: list[dict], dtype: str = "float64", chunks: tuple[int, ...] = (64, 32)):
    def run(spark, sf_dir):
        shape = e_shape(spark, sf_dir)
        meta = ArrayMeta(shape, chunks, dtype, 0.0, tuple(codecs))
        return coding.decoded(coding.encoded(e(spark, sf_dir), meta), meta)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"WITH {E} SELECT * FROM E"


_BYTES = {"name": "bytes", "configuration": {"endian": "little"}}
_through("endian_roundtrip", [{"name": "bytes", "configuration": {"endian": "big"}}])
for _name, _config in {"gzip": {"level": 5}, "zlib": {"level": 2}, "bz2": {"level": 1}, "zstd": {"level": 3, "checksum": True}, "crc32c": {}, "blosc": {"cname": "lz4", "shuffle": "shuffle"}}.items():
    _through(f"{_name}_roundtrip", [_BYTES, {"name": _name, "configuration": _config}])
_through("bitshuffle_roundtrip", [_BYTES, {"name": "blosc", "configuration": {"cname": "zstd", "shuffle": "bitshuffle"}}])
_through("transpose_roundtrip", [{"name": "transpose", "configuration": {"order": [1, 0]}}, _BYTES])
_INNER = [{"name": "transpose", "configuration": {"order": [1, 0]}}, _BYTES, {"name": "blosc", "configuration": {"cname": "lz4"}}]
_through("shard_roundtrip", [{"name": "sharding_indexed", "configuration": {"chunk_shape": [16, 8], "codecs": _INNER}}])
_through("nested_shard_roundtrip", [{"name": "sharding_indexed", "configuration": {"chunk_shape": [32, 16], "index_location": "start", "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [8, 8], "codecs": [_BYTES, {"name": "zstd"}]}}]}}])


# through a store


def _stored(spark: SparkSession, sf_dir: str, codecs=None, chunks=(64, 32), version: int = 3) -> ChunkArray:
    """E in a store under the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    codecs = codecs or ({"name": "sharding_indexed", "configuration": {"chunk_shape": [16, 16], "codecs": [_BYTES, {"name": "zstd"}]}},)
    meta = ArrayMeta(e_shape(spark, sf_dir), chunks, "float64", 0.0, tuple(codecs), version=version, separator="/" if version == 3 else ".", prefix=version == 3)
    array = ChunkArray.create(spark, f"{root.rstrip('/')}/lattispark-arrays/{uuid.uuid4().hex}", meta)
    array.assign(Ellipsis, e(spark, sf_dir))
    return array


@query(f"WITH {E} SELECT * FROM E")
def read_after_write_source(spark, sf_dir):
    return _stored(spark, sf_dir).cells()


@query(f"WITH {E} SELECT i0 - 30 AS i0, (i1 - 10) // 4 AS i1, value FROM E WHERE i0 BETWEEN 30 AND 99 AND i1 BETWEEN 10 AND 49 AND (i1 - 10) % 4 = 0")
def partial_decode(spark, sf_dir):
    """A strided box of a sharded array: inner chunks outside of it are never read."""
    return _stored(spark, sf_dir).select((slice(30, 100), slice(10, 50, 4)))


@query(f"WITH {E} SELECT i0, i1, CASE WHEN i0 BETWEEN 60 AND 69 THEN 1.5 WHEN i0 = 7 AND i1 IN (3, 4) THEN 0.0 ELSE value END AS value FROM E")
def store_update(spark, sf_dir):
    array = _stored(spark, sf_dir)
    array.assign((slice(60, 70),), 1.5)
    array.assign((7, [3, 4]), 0.0)
    return array.cells()


@query(f"WITH {E} SELECT i0, i1, value FROM E WHERE i0 < 100 AND i1 < 40")
def store_resize(spark, sf_dir):
    array = _stored(spark, sf_dir)
    array.resize((100, 40))
    return array.cells()


@query(f"WITH {E} SELECT * FROM E")
def second_version_store(spark, sf_dir):
    return ChunkArray.open(spark, _stored(spark, sf_dir, (_BYTES, {"name": "zlib", "configuration": {"level": 2}}), version=2).store.uri, mode="r").cells()


@query(f"WITH {E} SELECT i0, i1, value FROM E WHERE i0 BETWEEN 20 AND 39 AND i1 < 16")
def data_source_scan(spark, sf_dir):
    """The registered data source; its filters are pushed to the choice of chunks."""
    from .sources.datasource import register

    register(spark)
    return spark.read.format("lattice").option("path", _stored(spark, sf_dir).store.uri).load().where("i0 BETWEEN 20 AND 39 AND i1 < 16")

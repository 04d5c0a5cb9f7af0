"""Arrays in stores: codecs, golden bytes, updates, erasing, resizing, strictness, the data source."""

import http.server
import json
import threading
import warnings
from functools import partial

import numpy as np
import pytest

from lattispark.array import ChunkArray, open_array
from lattispark.functions.codecs import Chain, ChecksumError, UnsupportedMetadataError, crc32c
from lattispark.plans.meta import ArrayMeta, UnsupportedDataTypeError
from lattispark.plans.selection import DiscontiguousArrayError
from lattispark.sources import datasource
from lattispark.sources.store import ReadOnlyError, Store

BYTES = {"name": "bytes", "configuration": {"endian": "little"}}
SHARD = {"name": "sharding_indexed", "configuration": {"chunk_shape": [4, 4], "codecs": [{"name": "transpose", "configuration": {"order": [1, 0]}}, BYTES, {"name": "blosc", "configuration": {"cname": "lz4"}}]}}
CHAINS = [
    [BYTES], [{"name": "bytes", "configuration": {"endian": "big"}}], [{"name": "delta"}, BYTES, {"name": "zlib"}], [BYTES, {"name": "gzip"}], [BYTES, {"name": "bz2"}],
    [BYTES, {"name": "zstd", "configuration": {"level": 0, "checksum": True}}], [BYTES, {"name": "crc32c"}], [BYTES, {"name": "blosc", "configuration": {"cname": "zstd", "shuffle": "bitshuffle"}}],
    [BYTES, {"name": "blosc", "configuration": {"cname": "zlib", "shuffle": "noshuffle"}}], [SHARD], [{"name": "transpose", "configuration": {"order": "F"}}, BYTES],
]


@pytest.mark.parametrize("codecs", CHAINS, ids=lambda c: "-".join(x["name"] for x in c))
@pytest.mark.parametrize("dtype", ["uint16", "int64", "float32", "bool", "complex64"])
def test_codec_round_trip(codecs, dtype):
    if dtype in ("bool", "complex64") and codecs[0]["name"] == "delta":
        pytest.skip("differences need numbers")
    meta = ArrayMeta((16, 16), (8, 8), dtype, 0, tuple(codecs))
    x = (np.arange(64) % 7).reshape(8, 8).astype(dtype)
    data = meta.chain().encode(x, (8, 8))
    assert (meta.chain().decode(data, (8, 8)) == x).all()


def test_golden_bytes():
    assert crc32c(b"123456789") == 0xE3069283
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [8, 8], "codecs": [BYTES]}}
    meta = ArrayMeta((16, 16), (8, 16), "uint16", 0, (shard,))
    x = np.zeros((8, 16), "uint16")
    x[:, :8] = 1
    data = meta.chain().encode(x, (8, 16))
    assert len(data) == 16 * 2 + 8 * 8 * 2 + 4
    assert data[-20:-4] == b"\xff" * 16
    assert Chain([{"name": "bytes", "configuration": {"endian": "big"}}], meta).encode(np.array([[258]], "uint16"), (1, 1)) == b"\x01\x02"


def test_blosc_reads_split_blocks():
    """A container of two blocks, the first with a stream per byte of the numbers."""
    import struct

    import pyarrow as pa

    x = np.arange(300, dtype="<u4")
    raw, block = x.tobytes(), 1024
    blocks = [raw[:block], raw[block:]]
    out, starts = b"", []
    head = 16 + 8
    for n, b in enumerate(blocks):
        starts.append(head + len(out))
        shuffled = np.frombuffer(b, np.uint8).reshape(-1, 4).T.tobytes()
        parts = [shuffled[k * len(b) // 4 : (k + 1) * len(b) // 4] for k in range(4)] if n == 0 else [shuffled]
        for p in parts:
            c = pa.Codec("lz4_raw").compress(p, asbytes=True)
            c = c if len(c) < len(p) else p
            out += struct.pack("<i", len(c)) + c
    data = struct.pack("<BBBBIII", 2, 1, 1 | 1 << 5, 4, len(raw), block, head + len(out)) + struct.pack("<2i", *starts) + out
    meta = ArrayMeta((300,), (300,), "uint32", 0, (BYTES, {"name": "blosc"}))
    assert (meta.chain().decode(data, (300,)) == x).all()


def test_checksums_are_verified_unless_told_not_to():
    meta = ArrayMeta((4,), (4,), "int32", 0, (BYTES, {"name": "crc32c"}))
    data = bytearray(meta.chain().encode(np.arange(4, dtype="int32"), (4,)))
    data[0] ^= 1
    with pytest.raises(ChecksumError):
        meta.chain().decode(bytes(data), (4,))
    lax = ArrayMeta((4,), (4,), "int32", 0, (BYTES, {"name": "crc32c"}), validate_checksums=False)
    lax.chain().decode(bytes(data), (4,))


def test_metadata_is_checked():
    with pytest.raises(TypeError):
        ArrayMeta((4, 4), (2, 2), "int8", 0, ({"name": "transpose", "configuration": {"order": [1, 1]}}, BYTES))
    with pytest.raises(ValueError):
        ArrayMeta((4, 4), (2,), "int8")
    with pytest.raises(ValueError):
        ArrayMeta((16, 16), (6, 6), "int8", 0, (SHARD,))
    with pytest.raises(UnsupportedMetadataError, match="pcodec.*known"):
        ArrayMeta((4,), (2,), "int8", 0, ({"name": "pcodec"},))


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("dtype,fill", [("int32", 7), ("float64", "NaN"), ("float32", "-Infinity"), ("string", ""), ("bool", True)])
def test_json_round_trip(version, dtype, fill):
    codec = {"name": "vlen-utf8"} if dtype == "string" else BYTES
    meta = ArrayMeta((20, 30), (8, 10), dtype, fill, (codec, {"name": "zlib", "configuration": {"level": 2}}), version, "." if version == 2 else "/", version == 3)
    back = ArrayMeta.from_json(meta.to_json())
    assert back.numpy_dtype == meta.numpy_dtype and back.shape == meta.shape and back.chunks == meta.chunks
    assert meta.is_fill(back.full((2,))) and back.key((1, 2)) == ("c/1/2" if version == 3 else "1.2")


def test_second_version_document():
    text = '{"chunks": [2], "compressor": {"id": "zlib", "level": 2}, "dtype": ">i4", "fill_value": 0, "filters": [{"id": "delta", "dtype": "<i4"}], "order": "F", "shape": [4], "zarr_format": 2, "dimension_separator": "/"}'
    meta = ArrayMeta.from_json(text)
    assert [c["name"] for c in meta.codecs] == ["delta", "bytes", "zlib"] and meta.key((3,)) == "3"
    assert json.loads(meta.to_json())["dtype"] == ">i4"


def create(spark, tmp_path, shape=(10, 12), chunks=(4, 4), dtype="int16", fill=-1, codecs=(BYTES,), **options):
    return ChunkArray.create(spark, str(tmp_path / "a"), ArrayMeta(shape, chunks, dtype, fill, tuple(codecs)), **options)


@pytest.mark.parametrize("codecs,chunks", [((BYTES,), (4, 4)), ((SHARD,), (8, 8))])
def test_writes_follow_numpy(spark, tmp_path, codecs, chunks):
    a = create(spark, tmp_path, chunks=chunks, codecs=codecs)
    x = np.full((10, 12), -1, "int16")
    steps = [(Ellipsis, np.arange(120).reshape(10, 12)), ((slice(2, 7), slice(3, 9)), 42), ((3, 4), 5), (([1, 8], [2, 11]), 77), ((slice(None, None, 3), slice(9, None, -4)), 8), (([6, 0, 3],), np.arange(36).reshape(3, 12) + 500), ((slice(0, 2),), np.arange(12))]
    for index, value in steps:
        a.assign(index, value)
        x[tuple(np.array(i) if isinstance(i, list) else i for i in index) if isinstance(index, tuple) else index] = value
        assert (a.read() == x).all(), index
    for index in [(slice(1, 9, 2), 3), ([6, 0, 3, 3],), (3, 4), (Ellipsis, slice(0, 0))]:
        assert (a.read(index) == x[tuple(np.array(i) if isinstance(i, list) else i for i in index)]).all()
    assert (a.read(([0, 5], [3, 1]), "outer") == x[np.ix_([0, 5], [3, 1])]).all()


def test_empty_chunks_are_erased_and_fill_is_read(spark, tmp_path):
    a = create(spark, tmp_path, shape=(16, 16), chunks=(8, 16), dtype="uint16", fill=0, codecs=({"name": "sharding_indexed", "configuration": {"chunk_shape": [8, 8], "codecs": [BYTES]}},))
    assert (a.read() == 0).all() and a.store.keys("c") == []
    a.assign((slice(0, 8), slice(0, 8)), 1)
    assert a.store.keys("c") == ["c/0/0"] and len(a.store.get("c/0/0")) == 164
    a.assign(Ellipsis, 0)
    assert a.store.keys("c") == []
    kept = ChunkArray(spark, a.store, a.meta, write_empty_chunks=True)
    kept.assign(Ellipsis, 0)
    assert a.store.keys("c") == ["c/0/0", "c/1/0"] and (a.read() == 0).all()


def test_edge_chunks_are_whole(spark, tmp_path):
    a = create(spark, tmp_path, shape=(5,), chunks=(20,), dtype="uint8", fill=0)
    a.assign(Ellipsis, np.arange(5))
    assert len(a.store.get("c/0")) == 20 and (a.read() == np.arange(5)).all()


def test_resize(spark, tmp_path):
    a = create(spark, tmp_path, shape=(16, 18), chunks=(10, 10), fill=0)
    a.assign(Ellipsis, np.arange(288).reshape(16, 18))
    a.resize((10, 12))
    assert a.store.keys("c") == ["c/0/0", "c/0/1"]
    assert (ChunkArray.open(spark, a.store.uri).read() == np.arange(288).reshape(16, 18)[:10, :12]).all()


@pytest.mark.parametrize("dtype,values", [("string", ["a", "", "ß中"]), ("uint64", [0, 2**64 - 1, 5]), ("float16", [0.5, 1, -2]), ("complex128", [1 + 2j, 0, -1j]), ("S3", [b"ab", b"c", b"xyz"]), ("datetime64[ns]", [1, 2, 3]), ("V2", [b"ab", b"cd", b"ef"])])
def test_types(spark, tmp_path, dtype, values):
    codec = {"name": "vlen-utf8"} if dtype == "string" else BYTES
    meta = ArrayMeta((4,), (2,), dtype, None, (codec,))
    a = ChunkArray.create(spark, str(tmp_path / "t"), meta)
    x = np.array(values, object) if dtype == "string" else np.array([np.void(v) for v in values], dtype) if dtype == "V2" else np.array(values, dtype)
    a.assign(slice(0, 3), x)
    got = a.read(slice(0, 3))
    assert [np.asarray(g).tobytes() if dtype != "string" else g for g in got] == [np.asarray(v).tobytes() if dtype != "string" else v for v in x]


def test_structured(spark, tmp_path):
    kind = json.dumps([["a", "S3"], ["b", "<i4"], ["c", "<f8"]])
    meta = ArrayMeta((3,), (2,), kind, None, (BYTES,), 2, ".", False)
    a = ChunkArray.create(spark, str(tmp_path / "s"), meta)
    x = np.array([(b"x", 1, 0.5), (b"yz", 2, 1.5), (b"", 3, 2.5)], meta.numpy_dtype)
    a.assign(Ellipsis, x)
    again = ChunkArray.open(spark, a.store.uri)
    assert (again.read() == x).all()


def test_values_out_of_range_are_an_error(spark, tmp_path):
    a = create(spark, tmp_path, shape=(4,), chunks=(2,), dtype="uint8", fill=0)
    with pytest.raises(Exception, match="doesn't fit"):
        a.assign(Ellipsis, spark.createDataFrame([(0, 256)], "i0 long, value int"))


def test_read_only_and_missing(spark, tmp_path):
    a = create(spark, tmp_path)
    reader = ChunkArray.open(spark, a.store.uri, mode="r")
    for write in (lambda: reader.assign(0, 1), lambda: reader.resize((1, 1))):
        with pytest.raises(ReadOnlyError):
            write()
    with pytest.raises(FileNotFoundError):
        ChunkArray.open(spark, str(tmp_path / "none"))
    with pytest.raises(NotImplementedError):
        Store("ftp://host/a")
    with pytest.raises(ValueError):
        Store("/tmp", cache=1)
    Store("/tmp", direct_io=True, file_handle_cache_size=4)


def test_strict_mode(spark, tmp_path):
    a = create(spark, tmp_path, strict=True)
    with pytest.raises(DiscontiguousArrayError):
        a.select(slice(None, None, 2))
    text = ChunkArray.create(spark, str(tmp_path / "v"), ArrayMeta((4,), (2,), "string", "", ({"name": "vlen-utf8"},)), strict=True)
    with pytest.raises(UnsupportedDataTypeError):
        text.select(Ellipsis)
    path = tmp_path / "bad"
    path.mkdir()
    (path / "zarr.json").write_text(a.meta.to_json().replace('"bytes"', '"pcodec"'))
    with pytest.raises(UnsupportedMetadataError):
        open_array(spark, str(path), strict=True)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert open_array(spark, str(path)) is None and seen


def test_http(spark, tmp_path):
    a = create(spark, tmp_path)
    a.assign(Ellipsis, np.arange(120).reshape(10, 12))
    handler = partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *_: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        remote = ChunkArray.open(spark, f"http://127.0.0.1:{server.server_port}/a")
        assert (remote.read((slice(2, 5),)) == np.arange(120).reshape(10, 12)[2:5]).all()
        with pytest.raises(ReadOnlyError):
            remote.assign(0, 1)
        server.shutdown()


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    a = create(spark, tmp_path, fill=0)
    x = np.arange(120).reshape(10, 12)
    cells = a.frame(x.astype("int16"))
    datasource.keyed(cells, a.meta.chunks).write.format("lattice").mode("append").option("path", a.store.uri).save()
    assert (a.read() == x).all() and not a.store.keys(".staging")
    back = spark.read.format("lattice").option("path", a.store.uri).load()
    rows = back.where("i0 >= 3 and i0 < 5 and i1 = 2").collect()
    assert sorted(r["value"] for r in rows) == [38, 50]
    with pytest.raises(Exception, match="read-only"):
        cells.write.format("lattice").mode("append").option("path", a.store.uri).option("mode", "r").save()
    zero = a.frame(np.zeros((4, 4), "int16"))
    datasource.keyed(zero, a.meta.chunks).write.format("lattice").mode("append").option("path", a.store.uri).save()
    assert "c/0/0" not in a.store.keys("c")


def test_filters_choose_chunks(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

    meta = ArrayMeta((100, 100), (10, 10), "int8")
    reader = datasource.Reader(Store(str(tmp_path)), meta, 64)
    list(reader.pushFilters([GreaterThanOrEqual(("i0",), 15), LessThan(("i0",), 31), In(("i1",), (3, 25))]))
    assert reader.bounds == [(15, 31), (3, 26)]
    assert reader.partitions()[-1].last == 3 * 3


def test_arrays_without_cells(spark, tmp_path):
    a = ChunkArray.create(spark, str(tmp_path / "e"), ArrayMeta((0, 4), (2, 2), "int8"))
    assert a.cells().count() == 0 and a.read().shape == (0, 4)


@pytest.mark.parametrize(
    "index,mode",
    [
        (([0, 19, 0],), "plain"), ((slice(None, None, 7), slice(1, None, 9)), "plain"), ((slice(18, 2, -6), 3), "plain"), (([1, 18], [2, 13]), "outer"),
        (([1, 18, 0], [2, 13, 2]), "pointwise"), (([],), "plain"), ((slice(2, 2),), "plain"), ((3, 4), "plain"), ((slice(3, 9), [0, 13]), "plain"),
    ],
)
@pytest.mark.parametrize("sharded", [False, True])
def test_only_touched_chunks_are_read(spark, tmp_path, index, mode, sharded):
    """Chunks without a selected cell are spoilt, so that reading one would fail."""
    inner = ({"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"})
    codecs = ({"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 1], "codecs": list(inner)}},) if sharded else inner
    values = np.arange(20 * 14, dtype="int32").reshape(20, 14) + 1
    array = ChunkArray.create(spark, f"file://{tmp_path}/a", ArrayMeta((20, 14), (4, 3), "int32", 0, codecs))
    array.assign(Ellipsis, values)
    where = np.indices(values.shape)
    take = (lambda x: x[np.ix_(*index)]) if mode == "outer" else (lambda x: x[tuple(np.asarray(i, int) if isinstance(i, list) else i for i in index)])
    touched = set(zip((take(where[0]) // 4).reshape(-1).tolist(), (take(where[1]) // 3).reshape(-1).tolist(), strict=True))
    spoilt = 0
    for i in range(5):
        for j in range(5):
            if (i, j) not in touched:
                (tmp_path / "a" / "c" / str(i) / str(j)).write_bytes(b"junk")
                spoilt += 1
    assert spoilt == 25 - len(touched)
    assert np.array_equal(array.read(index, mode), take(values))

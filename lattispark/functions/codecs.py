"""Codecs: functions between arrays and bytes, chained as the metadata says.

encode() and decode() run inside Arrow stages, on one chunk at a time.
"""

from __future__ import annotations

import bz2
import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard


class UnsupportedMetadataError(Exception):
    """Metadata that this engine can't serve; every codec that it knows is named."""


class ChecksumError(RuntimeError):
    """Stored bytes don't match their checksum."""


def _crc_table() -> np.ndarray:
    """The table of the reflected Castagnoli polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1))
    return table


_CRC = _crc_table().tolist()


def crc32c(data: bytes) -> int:
    value, table = 0xFFFFFFFF, _CRC
    for byte in data:
        value = table[(value ^ byte) & 0xFF] ^ (value >> 8)
    return value ^ 0xFFFFFFFF


class Codec:
    """array: whether it maps arrays to arrays; serial: whether it maps arrays to bytes."""

    array = serial = False

    def __init__(self, config: dict, meta):
        self.config, self.meta = config, meta

    def shape(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return shape


class Bytes(Codec):
    """Numbers in C order, in the byte order given."""

    serial = True

    def _kind(self) -> np.dtype:
        order = {"big": ">", "little": "<"}.get(self.config.get("endian") or "little")
        if order is None:
            raise UnsupportedMetadataError(f"endian {self.config.get('endian')!r}")
        return self.meta.numpy_dtype.newbyteorder(order)

    def encode(self, x: np.ndarray, shape) -> bytes:
        return np.ascontiguousarray(x).astype(self._kind(), copy=False).tobytes()

    def decode(self, data: bytes, shape) -> np.ndarray:
        kind = self._kind()
        want = int(np.prod(shape, dtype=np.int64)) * kind.itemsize
        if len(data) != want:
            raise RuntimeError(f"a chunk of shape {tuple(shape)} needs {want} bytes and has {len(data)}")
        return np.frombuffer(data, kind).reshape(shape).astype(kind.newbyteorder("="))


class VlenUtf8(Codec):
    """A count, then a length and UTF-8 bytes for each string."""

    serial = True

    def encode(self, x: np.ndarray, shape) -> bytes:
        items = [str(v).encode() for v in x.ravel()]
        return b"".join([struct.pack("<I", len(items)), *(part for i in items for part in (struct.pack("<I", len(i)), i))])

    def decode(self, data: bytes, shape) -> np.ndarray:
        (count,), at, out = struct.unpack_from("<I", data), 4, []
        for _ in range(count):
            (size,) = struct.unpack_from("<I", data, at)
            out.append(data[at + 4 : at + 4 + size].decode())
            at += 4 + size
        made = np.empty(count, object)
        made[:] = out
        return made.reshape(shape)


class Transpose(Codec):
    """Axis n of what is stored is axis order[n] of the chunk."""

    array = True

    def __init__(self, config: dict, meta):
        super().__init__(config, meta)
        order = config.get("order")
        rank = len(meta.shape)
        self.order = tuple(range(rank)) if order == "C" else tuple(reversed(range(rank))) if order == "F" else tuple(order or ())
        if sorted(self.order) != list(range(rank)):
            raise TypeError(f"transpose order {order} is no permutation of {rank} axes")

    def shape(self, shape):
        return tuple(shape[k] for k in self.order)

    def encode(self, x, shape):
        return x.transpose(self.order)

    def decode(self, x, shape):
        return x.transpose(np.argsort(self.order))


class Delta(Codec):
    """The first value, then differences, in C order."""

    array = True

    def encode(self, x, shape):
        flat = x.ravel()
        out = flat.copy()
        out[1:] = flat[1:] - flat[:-1]
        return out.reshape(x.shape)

    def decode(self, x, shape):
        return np.cumsum(x.ravel(), dtype=x.dtype).reshape(x.shape)


class Gzip(Codec):
    def encode(self, data, shape):
        return gzip.compress(data, int(self.config.get("level", 5)), mtime=0)

    def decode(self, data, shape):
        return gzip.decompress(data)


class Zlib(Codec):
    def encode(self, data, shape):
        return zlib.compress(data, int(self.config.get("level", 1)))

    def decode(self, data, shape):
        return zlib.decompress(data)


class Bz2(Codec):
    def encode(self, data, shape):
        return bz2.compress(data, int(self.config.get("level", 1)))

    def decode(self, data, shape):
        return bz2.decompress(data)


class Zstd(Codec):
    def encode(self, data, shape):
        return zstandard.ZstdCompressor(level=int(self.config.get("level", 0)) or 3, write_checksum=bool(self.config.get("checksum", False))).compress(data)

    def decode(self, data, shape):
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)


class Crc32c(Codec):
    """Four little-endian bytes of checksum after the data."""

    def encode(self, data, shape):
        return data + struct.pack("<I", crc32c(data))

    def decode(self, data, shape):
        body, (want,) = data[:-4], struct.unpack("<I", data[-4:])
        if self.meta.validate_checksums and crc32c(body) != want:
            raise ChecksumError("crc32c checksum doesn't match")
        return body


def _shuffled(data: bytes, size: int, back: bool) -> bytes:
    whole = len(data) // size * size
    body = np.frombuffer(data[:whole], np.uint8)
    body = body.reshape(size, -1).T if back else body.reshape(-1, size).T
    return np.ascontiguousarray(body).tobytes() + data[whole:]


def _bits_shuffled(data: bytes, size: int, back: bool) -> bytes:
    items = len(data) // size // 8 * 8
    whole = items * size
    body = np.frombuffer(data[:whole], np.uint8)
    if back:
        bits = np.unpackbits(body, bitorder="little").reshape(size * 8, items).T
    else:
        bits = np.unpackbits(body.reshape(items, size), axis=1, bitorder="little").T
    return np.packbits(np.ascontiguousarray(bits).ravel(), bitorder="little").tobytes() + data[whole:]


class Blosc(Codec):
    """The version 1 container: lz4, zlib and zstd, with byte or bit shuffle. Chunks are written as
    one block that isn't split; any number of blocks and splits is read."""

    #: Fixed values of the format: codes of the compressors.
    CODES = {"lz4": 1, "lz4hc": 1, "zlib": 3, "zstd": 4}

    def _raw(self, name: str):
        return pa.Codec("lz4_raw") if name in ("lz4", "lz4hc") else None

    def encode(self, data, shape):
        name = self.config.get("cname", "lz4")
        if name not in self.CODES:
            raise UnsupportedMetadataError(f"blosc compressor {name!r}; known: {sorted(self.CODES)}")
        size = int(self.config.get("typesize") or max(self.meta.numpy_dtype.itemsize, 1))
        shuffle = {"noshuffle": 0, "shuffle": 1, "bitshuffle": 2}.get(self.config.get("shuffle", "shuffle"), self.config.get("shuffle"))
        if shuffle == -1:
            shuffle = 2 if size == 1 else 1
        flags = 0x10 | self.CODES[name] << 5
        body = data
        if shuffle == 1 and size > 1:
            flags, body = flags | 1, _shuffled(data, size, False)
        elif shuffle == 2:
            flags, body = flags | 4, _bits_shuffled(data, size, False)
        level = int(self.config.get("clevel", 5))
        if name == "zlib":
            packed = zlib.compress(body, level)
        elif name == "zstd":
            packed = zstandard.ZstdCompressor(level=max(level * 2 - 1, 1)).compress(body)
        else:
            packed = pa.Codec("lz4_raw").compress(body, asbytes=True)
        if len(packed) + 24 >= len(data) + 16 or not level or not data:
            return struct.pack("<BBBBIII", 2, 1, flags & ~5 | 2, size, len(data), max(len(data), 1), len(data) + 16) + data
        return struct.pack("<BBBBIIIII", 2, 1, flags, size, len(data), len(data), len(packed) + 24, 20, len(packed)) + packed

    def decode(self, data, shape):
        _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBIII", data)
        if flags & 2:
            return data[16 : 16 + total]
        count = -(-total // block) if block else 0
        starts = struct.unpack_from(f"<{count}i", data, 16)
        code, out = flags >> 5, []
        for k, at in enumerate(starts):
            want = min(block, total - k * block)
            parts = 1 if flags & 0x10 or want < block or size > 16 or block // size < 128 else size
            body = b""
            for _ in range(parts):
                (packed,) = struct.unpack_from("<i", data, at)
                piece, part = data[at + 4 : at + 4 + packed], want // parts
                at += 4 + packed
                if packed == part:
                    body += piece
                elif code == 1:
                    body += pa.Codec("lz4_raw").decompress(piece, part, asbytes=True)
                elif code == 3:
                    body += zlib.decompress(piece)
                elif code == 4:
                    body += zstandard.ZstdDecompressor().decompress(piece, max_output_size=part)
                else:
                    raise UnsupportedMetadataError(f"blosc compressor code {code}")
            out.append(_shuffled(body, size, True) if flags & 1 and size > 1 else _bits_shuffled(body, size, True) if flags & 4 else body)
        return b"".join(out)


class Sharding(Codec):
    """Many inner chunks in one object, with an index of (offset, nbytes), 16 bytes each, and its
    checksum, at the start or end. An inner chunk of fill values has no bytes: its entry is all ones."""

    serial = True
    NONE = 0xFFFFFFFFFFFFFFFF

    def __init__(self, config: dict, meta):
        super().__init__(config, meta)
        self.inner = tuple(config["chunk_shape"])
        self.at_end = config.get("index_location", "end") != "start"
        self.codecs = config.get("codecs") or [{"name": "bytes", "configuration": {"endian": "little"}}]
        self.chain = Chain(self.codecs, meta)
        index = config.get("index_codecs") or [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        names = [c["name"] for c in index]
        if names not in (["bytes"], ["bytes", "crc32c"]):
            raise UnsupportedMetadataError(f"shard index codecs {names}")
        self.sum = names[-1] == "crc32c"
        self.order = ">" if index[0].get("configuration", {}).get("endian") == "big" else "<"

    def counts(self, shape) -> tuple[int, ...]:
        if len(shape) != len(self.inner) or any(s % c for s, c in zip(shape, self.inner, strict=True)):
            raise ValueError(f"shard shape {tuple(shape)} is not divisible by inner chunks {self.inner}")
        return tuple(s // c for s, c in zip(shape, self.inner, strict=True))

    def index_size(self, shape) -> int:
        return 16 * int(np.prod(self.counts(shape), dtype=np.int64)) + 4 * self.sum

    def _box(self, at):
        return tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, self.inner, strict=True))

    def encode(self, x, shape):
        counts = self.counts(shape)
        index = np.full((int(np.prod(counts, dtype=np.int64)), 2), self.NONE, np.uint64)
        parts, offset = [], 0 if self.at_end else self.index_size(shape)
        for n, at in enumerate(np.ndindex(*counts)):
            piece = x[self._box(at)]
            if not self.meta.is_fill(piece):
                data = self.chain.encode(piece, self.inner)
                index[n] = offset, len(data)
                offset += len(data)
                parts.append(data)
        table = index.astype(f"{self.order}u8").tobytes()
        if self.sum:
            table += struct.pack("<I", crc32c(table))
        return b"".join([*parts, table] if self.at_end else [table, *parts])

    def read_index(self, table: bytes, shape) -> np.ndarray:
        body = table[:-4] if self.sum else table
        if self.sum and self.meta.validate_checksums and struct.unpack("<I", table[-4:])[0] != crc32c(body):
            raise ChecksumError("the shard index doesn't match its checksum")
        return np.frombuffer(body, f"{self.order}u8").reshape(*self.counts(shape), 2).astype(np.uint64)

    def decode(self, data, shape):
        size = self.index_size(shape)
        return self.partial(lambda a, b: data[a:b], len(data), shape, [(0, n) for n in shape], data[-size:] if self.at_end else data[:size])

    def partial(self, fetch, total: int, shape, box, table: bytes | None = None) -> np.ndarray:
        """The chunk, with only the inner chunks that a box (start, stop by axis) meets decoded;
        fetch(a, b) reads bytes, so the rest is never read."""
        size = self.index_size(shape)
        if table is None:
            table = fetch(total - size, total) if self.at_end else fetch(0, size)
        index = self.read_index(table, shape)
        out = self.meta.full(shape)
        ranges = [range(a // c, -(-b // c)) if b > a else range(0) for (a, b), c in zip(box, self.inner, strict=True)]
        for at in np.ndindex(*[len(r) for r in ranges]):
            place = tuple(r[k] for r, k in zip(ranges, at, strict=True))
            offset, nbytes = (int(v) for v in index[place])
            if offset != self.NONE:
                out[self._box(place)] = self.chain.decode(fetch(offset, offset + nbytes), self.inner)
        return out


REGISTRY: dict[str, type[Codec]] = {
    "bytes": Bytes, "vlen-utf8": VlenUtf8, "transpose": Transpose, "delta": Delta, "gzip": Gzip, "zlib": Zlib,
    "bz2": Bz2, "zstd": Zstd, "crc32c": Crc32c, "blosc": Blosc, "sharding_indexed": Sharding,
}


class Chain:
    """Codecs in order of encoding: arrays to arrays, one to bytes, bytes to bytes."""

    def __init__(self, codecs: list[dict], meta):
        self.codecs: list[Codec] = []
        for c in codecs:
            name = c.get("name")
            if name not in REGISTRY:
                raise UnsupportedMetadataError(f"codec {name!r} is not supported; known: {', '.join(sorted(REGISTRY))}")
            self.codecs.append(REGISTRY[name](c.get("configuration") or {}, meta))
        if sum(c.serial for c in self.codecs) != 1:
            raise UnsupportedMetadataError("a codec chain needs one codec from arrays to bytes")

    def _shapes(self, shape):
        shapes = []
        for c in self.codecs:
            shapes.append(shape)
            shape = c.shape(shape)
        return shapes

    def encode(self, x: np.ndarray, shape) -> bytes:
        for c, s in zip(self.codecs, self._shapes(tuple(shape)), strict=True):
            x = c.encode(x, s)
        return x

    def decode(self, data: bytes, shape) -> np.ndarray:
        for c, s in reversed(list(zip(self.codecs, self._shapes(tuple(shape)), strict=True))):
            data = c.decode(data, s)
        return data

    def sharded(self) -> Sharding | None:
        """The sharding codec, where a part can be read by its index alone."""
        return self.codecs[0] if len(self.codecs) == 1 and isinstance(self.codecs[0], Sharding) else None

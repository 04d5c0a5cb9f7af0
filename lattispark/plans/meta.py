"""Array metadata: shape, chunks, dtype, fill value and codecs, read from and written to JSON of
two format versions, and checked when it is made."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from ..functions.codecs import Chain, UnsupportedMetadataError

#: Fixed values of the storage format.
VERSION_KEY = "zarr_format"
DOCUMENTS = {3: "zarr.json", 2: ".zarray"}
NAMED_FLOATS = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


class UnsupportedDataTypeError(Exception):
    """Strict mode: a data type that only the general path serves."""


#: NumPy kinds that strict mode refuses: raw, bytes, strings, times, objects.
REFUSED = frozenset("VSUMmOT")


def _spark_type(kind: np.dtype) -> T.DataType:
    """Unsigned numbers and half floats are widened; 64-bit unsigned become decimals."""
    if kind.names:
        return T.StructType([T.StructField(n, _spark_type(kind[n])) for n in kind.names])
    by = {"b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType()}
    if kind.kind == "c":
        part = T.FloatType() if kind.itemsize == 8 else T.DoubleType()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)])
    if kind.kind in "OUT":
        return T.StringType()
    if kind.kind in "SV":
        return T.BinaryType()
    if kind.kind in "Mm":
        return T.LongType()
    found = by.get(f"{kind.kind}{kind.itemsize}")
    if found is None:
        raise UnsupportedMetadataError(f"data type {kind}")
    return found


@dataclass(frozen=True)
class ArrayMeta:
    """chunks is the shape of a stored object (a shard, where codecs say so)."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill_value: object = 0
    codecs: tuple = ({"name": "bytes", "configuration": {"endian": "little"}},)
    version: int = 3
    separator: str = "/"
    prefix: bool = True
    validate_checksums: bool = True
    attributes: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if len(self.shape) != len(self.chunks):
            raise ValueError(f"chunks {self.chunks} don't have the rank of shape {self.shape}")
        if any(n < 0 for n in self.shape) or any(c < 1 for c in self.chunks):
            raise ValueError("a shape can't be negative, and chunks have at least one cell on each axis")
        chain = self.chain()
        sizes = self.chunks
        for c in chain.codecs:
            if hasattr(c, "counts"):
                c.counts(sizes)
            sizes = c.shape(sizes)
        self.spark_type()

    @property
    def numpy_dtype(self) -> np.dtype:
        if self.dtype in ("string", "str"):
            return np.dtype(object)
        if self.dtype.startswith("["):
            return np.dtype([tuple(x) for x in json.loads(self.dtype)])
        return np.dtype(self.dtype)

    def spark_type(self) -> T.DataType:
        return _spark_type(self.numpy_dtype)

    def chain(self) -> Chain:
        return Chain([dict(c) for c in self.codecs], self)

    def fill(self):
        value, kind = self.fill_value, self.numpy_dtype
        if value is None:
            return "" if kind.kind == "O" else np.zeros((), kind)[()]
        if isinstance(value, str) and value in NAMED_FLOATS and kind.kind in "fc":
            value = NAMED_FLOATS[value]
        if kind.names:
            if isinstance(value, str):
                value = base64.b64decode(value)
            return np.frombuffer(value, kind)[0] if isinstance(value, bytes) else np.array(tuple(value), kind)[()]
        if kind.kind in "SV" and isinstance(value, str):
            return np.array(base64.b64decode(value), kind)[()]
        if kind.kind == "c" and isinstance(value, (list, tuple)):
            value = complex(*[NAMED_FLOATS.get(v, v) for v in value])
        return str(value) if kind.kind == "O" else np.array(value, kind)[()]

    def full(self, shape) -> np.ndarray:
        out = np.empty(shape, self.numpy_dtype)
        out[...] = self.fill()
        return out

    def is_fill(self, x: np.ndarray) -> bool:
        """All cells have the fill value's bytes: NaN is NaN, and -0.0 is not 0.0."""
        if x.dtype.kind == "O":
            return bool((x == self.fill()).all())
        one = np.asarray(self.fill(), self.numpy_dtype).tobytes()
        return np.ascontiguousarray(x.astype(self.numpy_dtype, copy=False)).tobytes() == one * x.size

    @property
    def counts(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    def key(self, at) -> str:
        parts = [str(int(k)) for k in at]
        if self.prefix:
            return self.separator.join(["c", *parts])
        return self.separator.join(parts) or "0"

    def strict_check(self) -> None:
        if self.numpy_dtype.kind in REFUSED:
            raise UnsupportedDataTypeError(f"data type {self.dtype} is not supported in strict mode")

    # JSON

    def to_json(self) -> str:
        kind, fill = self.numpy_dtype, self._plain_fill()
        if self.version == 3:
            name = "string" if kind.kind == "O" else "bool" if kind.kind == "b" else kind.newbyteorder("=").name
            doc = {
                VERSION_KEY: 3, "node_type": "array", "shape": list(self.shape), "data_type": name,
                "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunks)}},
                "chunk_key_encoding": {"name": "default" if self.prefix else "v2", "configuration": {"separator": self.separator}},
                "fill_value": fill, "codecs": [dict(c) for c in self.codecs], "attributes": self.attributes,
            }
            return json.dumps(doc)
        filters, compressor, order, endian = [], None, "C", "<"
        for c in self.codecs:
            name, config = c["name"], c.get("configuration") or {}
            if name == "transpose":
                order = "F"
            elif name == "bytes":
                endian = ">" if config.get("endian") == "big" else "<"
            elif name in ("delta", "vlen-utf8"):
                filters.append({"id": name, **config})
            else:
                if compressor is not None:
                    filters.append(compressor)
                compressor = {"id": name, **config}
        text = "|O" if kind.kind == "O" else json.loads(self.dtype) if self.dtype.startswith("[") else kind.newbyteorder(endian if kind.itemsize > 1 else "|").str
        doc = {"chunks": list(self.chunks), "compressor": compressor, "dtype": text, "fill_value": fill, "filters": filters or None, "order": order, "shape": list(self.shape), VERSION_KEY: 2, "dimension_separator": self.separator}
        return json.dumps(doc)

    def _plain_fill(self):
        value = self.fill_value if self.fill_value is None or isinstance(self.fill_value, (str, list)) else self.fill()
        if isinstance(value, (bytes, np.void)):
            return base64.b64encode(bytes(value)).decode()
        if isinstance(value, np.generic):
            value = value.item()
        if isinstance(value, complex):
            return [value.real, value.imag]
        if isinstance(value, float) and value != value:
            return "NaN"
        if isinstance(value, float) and value in (float("inf"), float("-inf")):
            return "Infinity" if value > 0 else "-Infinity"
        return value

    @staticmethod
    def from_json(text: str, **options) -> "ArrayMeta":
        """Either version; what can't be served is an UnsupportedMetadataError."""
        doc = json.loads(text)
        version = doc.get(VERSION_KEY)
        if version == 3:
            grid, keys = doc["chunk_grid"], doc.get("chunk_key_encoding") or {"name": "default"}
            if grid["name"] != "regular":
                raise UnsupportedMetadataError(f"chunk grid {grid['name']!r}")
            config = keys.get("configuration") or {}
            prefix = keys["name"] == "default"
            name = doc["data_type"]
            if not isinstance(name, str):
                raise UnsupportedMetadataError(f"data type {name}")
            codecs = tuple(c if isinstance(c, dict) else {"name": c} for c in doc["codecs"])
            return ArrayMeta(tuple(doc["shape"]), tuple(grid["configuration"]["chunk_shape"]), name, doc.get("fill_value"), codecs, 3, config.get("separator", "/" if prefix else "."), prefix, attributes=doc.get("attributes") or {}, **options)
        if version == 2:
            return ArrayMeta._from_second(doc, options)
        raise UnsupportedMetadataError(f"format version {version!r}")

    @staticmethod
    def _from_second(doc: dict, options: dict) -> "ArrayMeta":
        raw = doc["dtype"]
        kind = np.dtype([tuple(x) for x in raw]) if isinstance(raw, list) else np.dtype(raw)
        steps: list[dict] = []
        if doc.get("order", "C") == "F" and len(doc["shape"]) > 1:
            steps.append({"name": "transpose", "configuration": {"order": list(reversed(range(len(doc["shape"]))))}})
        filters = list(doc.get("filters") or [])
        split = lambda f: {"name": f["id"], "configuration": {k: v for k, v in f.items() if k != "id"}}
        arrays = [f for f in filters if f["id"] == "delta"]
        packs = [f for f in filters if f["id"] not in ("delta", "vlen-utf8")]
        steps += map(split, arrays)
        if kind.kind == "O":
            steps.append({"name": "vlen-utf8"})
        else:
            big = not kind.names and kind.str[0] == ">"
            steps.append({"name": "bytes", "configuration": {"endian": "big" if big else "little"}})
        steps += map(split, packs)
        if doc.get("compressor"):
            steps.append(split(doc["compressor"]))
        text = json.dumps(raw) if isinstance(raw, list) else "string" if kind.kind == "O" else kind.newbyteorder("=").str
        return ArrayMeta(tuple(doc["shape"]), tuple(doc["chunks"]), text, doc.get("fill_value"), tuple(steps), 2, doc.get("dimension_separator", "."), False, **options)

"""Stores: objects by key under a root. Local folders, object stores and HTTP (read only)."""

from __future__ import annotations

import urllib.error
import urllib.request
import uuid
from urllib.parse import urlsplit

from pyarrow import fs


class ReadOnlyError(ValueError):
    """The store was opened in read-only mode."""


SCHEMES = ("", "file", "s3", "s3a", "gs", "abfs", "abfss", "hdfs", "viewfs", "http", "https")


class Store:
    """Picklable; connections are made where they are used. Options that only tune local file
    handles (direct_io, file_handle_cache_size) are accepted and have no effect here."""

    def __init__(self, uri: str, read_only: bool = False, asynchronous: bool = False, direct_io: bool = False, file_handle_cache_size: int = 0, **options):
        if options:
            raise ValueError(f"unknown store options {sorted(options)}")
        scheme = urlsplit(uri).scheme if "://" in uri else ""
        if scheme not in SCHEMES:
            raise NotImplementedError(f"{scheme} stores are not supported")
        self.uri, self.http = uri.rstrip("/"), scheme in ("http", "https")
        self.read_only = read_only or self.http
        self._fs = None

    def __getstate__(self):
        return self.__dict__ | {"_fs": None}

    def _open(self) -> tuple[fs.FileSystem, str]:
        if self._fs is None:
            if "://" in self.uri:
                self._fs = fs.FileSystem.from_uri(self.uri.replace("s3a://", "s3://", 1))
            else:
                self._fs = fs.LocalFileSystem(), self.uri
        return self._fs

    def _http(self, key: str, headers: dict | None = None) -> bytes | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.uri}/{key}", headers=headers or {}), timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code in (404, 410):
                return None
            raise OSError(f"{self.uri}/{key}: HTTP {error.code}") from error

    def get(self, key: str) -> bytes | None:
        """The object, or None if there is none."""
        if self.http:
            return self._http(key)
        system, root = self._open()
        try:
            with system.open_input_stream(f"{root}/{key}") as stream:
                return stream.read()
        except (FileNotFoundError, NotADirectoryError):
            return None

    def reader(self, key: str):
        """(size, fetch(a, b)) of an object for reads of parts, or None if there is none."""
        if self.http:
            data = self._http(key)
            return None if data is None else (len(data), lambda a, b: data[a:b])
        system, root = self._open()
        try:
            handle = system.open_input_file(f"{root}/{key}")
        except (FileNotFoundError, NotADirectoryError):
            return None
        return handle.size(), lambda a, b: handle.read_at(b - a, a)

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError("store was opened in read-only mode")

    def set(self, key: str, data: bytes) -> None:
        """Write an object under another name and move it, so that no reader sees a part."""
        self._writable()
        system, root = self._open()
        target = f"{root}/{key}"
        folder, _, name = target.rpartition("/")
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as stream:
            stream.write(data)
        system.move(draft, target)

    def erase(self, key: str) -> None:
        self._writable()
        system, root = self._open()
        try:
            system.delete_file(f"{root}/{key}")
        except (FileNotFoundError, NotADirectoryError):
            pass

    def move(self, key: str, to: str) -> None:
        self._writable()
        system, root = self._open()
        system.create_dir(f"{root}/{to}".rpartition("/")[0], recursive=True)
        system.move(f"{root}/{key}", f"{root}/{to}")

    def clear(self, prefix: str) -> None:
        self._writable()
        system, root = self._open()
        if system.get_file_info(f"{root}/{prefix}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{prefix}")

    def keys(self, prefix: str = "") -> list[str]:
        """Keys under a prefix, sorted. For small listings, as in tests and commits."""
        system, root = self._open()
        top = f"{root}/{prefix}".rstrip("/")
        if system.get_file_info(top).type != fs.FileType.Directory:
            return []
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        return sorted(f.path[len(root) :].lstrip("/") for f in found if f.type == fs.FileType.File)

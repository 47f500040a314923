"""Sorted arrays as files in the folder that driver and executors share, memory-mapped by tasks."""

from __future__ import annotations

import resource
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from .common import shared_root

#: Mapped files that one of a task's collections of arrays may hold at most; fewer where a process may open fewer files.
MAPS = 4_096


def _resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def scratch_path(spark: SparkSession) -> str:
    """URI of a folder that isn't there yet, in the shared folder."""
    return f"{shared_root(spark)}/cairn-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared folder, removed at the end."""
    uri = scratch_path(spark)
    fs, path = _resolve(uri)
    fs.create_dir(path, recursive=True)
    try:
        yield uri
    finally:
        remove(uri)


def remove(uri: str) -> None:
    fs, path = _resolve(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def save(uri: str, name: str, data: np.ndarray) -> None:
    """Writes the array under another name and then renames it: a task that runs again leaves one whole file."""
    fs, path = _resolve(uri)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(memoryview(np.ascontiguousarray(data)).cast("B") if data.size else b"")
    fs.move(part, f"{path}/{name}")


def load(uri: str, name: str, dtype: str) -> np.ndarray:
    """The array, mapped: in place if the folder is mounted, else from a copy that has no name any more."""
    fs, path = _resolve(uri)
    info = fs.get_file_info(f"{path}/{name}")
    if info.type == pafs.FileType.NotFound or not info.size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{path}/{name}") as f:
        while block := f.read(8 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, dtype, "r")


class Opened:
    """Arrays by key, read at first use and kept for the keys used last, of which each has `files` files: a process may map
    only so many files at a time, and a large input has more shards than that."""

    def __init__(self, read: Callable, files: int = 1):
        allowed = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
        most = MAPS if allowed == resource.RLIM_INFINITY else min(MAPS, allowed // 8)
        self.read, self.most, self.held = read, max(1, most // files), {}

    def __call__(self, key: Hashable):
        found = self.held.pop(key, None)
        if found is None:
            found = self.read(key)
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]  # the one not used for the longest time
        self.held[key] = found
        return found


class Writer:
    """Appends arrays to one file, which gets its name when all is written."""

    def __init__(self, uri: str, name: str):
        self.fs, path = _resolve(uri)
        self.part, self.path, self.size = f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}", 0

    def __enter__(self) -> Writer:
        self.out = self.fs.open_output_stream(self.part)
        return self

    def append(self, data: np.ndarray) -> int:
        """Writes the array; where it begins, in elements."""
        at, self.size = self.size, self.size + len(data)
        self.out.write(memoryview(np.ascontiguousarray(data)).cast("B"))
        return at

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)


class Reader:
    """Slices of the arrays in a folder: mapped if it is mounted, else read by range."""

    def __init__(self, uri: str, dtype: str):
        self.fs, self.folder = _resolve(uri)
        self.dtype, self.local, self.opened = np.dtype(dtype), isinstance(self.fs, pafs.LocalFileSystem), Opened(self._open)

    def _open(self, name: str):
        path = f"{self.folder}/{name}"
        return np.memmap(path, self.dtype, "r") if self.local else self.fs.open_input_file(path)

    def __call__(self, name: str, at: int, n: int) -> np.ndarray:
        f = self.opened(name)
        if self.local:
            return f[at : at + n]
        f.seek(at * self.dtype.itemsize)
        return np.frombuffer(f.read(n * self.dtype.itemsize), self.dtype)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted `wanted` in sorted `keys`, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted

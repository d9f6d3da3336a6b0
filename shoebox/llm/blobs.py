"""Arrays as compressed blobs, dealt out by shard, and as files that workers map: what tasks hand each other instead of rows."""

from __future__ import annotations

import functools
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from shoebox.llm import text
from shoebox.llm.spark import open_folder

BLOBS = "shard int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        for a in arrays:
            out.write(np.array([len(a)], np.int64).tobytes() + a.tobytes())
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    with pa.CompressedInputStream(pa.BufferReader(blob), "zstd") as source:
        out = []
        for kind in kinds:
            n = int(np.frombuffer(source.read(8), np.int64)[0])
            out.append(np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind))
        return out


def dealt(shard: np.ndarray, shards: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One blob per shard that has entries."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [(s, pack(*(c[order[cut[s] : cut[s + 1]]] for c in columns))) for s in range(shards) if cut[s] < cut[s + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"]
    )


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under another name and move, so that a task that runs twice leaves one whole file."""
    fs, base = open_folder(folder)
    draft = f"{base}/_{name}-{np.random.default_rng().integers(2**62)}"
    with fs.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(array).data.cast("B") if len(array) else b"")
    fs.move(draft, f"{base}/{name}")


class _Arrays:
    """A model's arrays, mapped when first used."""

    def __init__(self, folder: str):
        self.fs, self.base = open_folder(folder)
        self.open: dict = {}

    def get(self, name: str, kind) -> np.ndarray:
        if name not in self.open:
            path = f"{self.base}/{name}"
            info = self.fs.get_file_info(path)
            if info.type != pafs.FileType.File or not info.size:
                self.open[name] = np.zeros(0, kind)
            elif isinstance(self.fs, pafs.LocalFileSystem):
                self.open[name] = np.memmap(path, kind, "r")
            else:
                with tempfile.TemporaryFile() as copy, self.fs.open_input_stream(path) as source:
                    while block := source.read(1 << 24):
                        copy.write(block)
                    copy.flush()
                    self.open[name] = np.memmap(copy, kind, "r")
        return self.open[name]


@text.held
@functools.lru_cache(maxsize=1)
def arrays_of(folder: str) -> _Arrays:
    return _Arrays(folder)


def found_in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and the place of those."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, at[hit]


def by_shard(keys: np.ndarray, shard: np.ndarray, shards: int):
    """The places of each shard's keys, in key order."""
    order = np.lexsort((keys, shard))
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            yield s, order[cut[s] : cut[s + 1]]

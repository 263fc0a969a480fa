"""Sorted arrays as compact binary rows, dealt to shards.

A row (shard, kind, data) holds equally long arrays, the first of them sorted keys. Keys are
stored as differences, every array byte plane by byte plane, and all of it is compressed, so
that an n-gram costs a few bytes in a shuffle instead of a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "shard int, kind int, data binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """``keys`` are sorted non-negative integers; columns keep their types, which the reader must know."""
    gaps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(keys), -1).T.tobytes() for c in (gaps, *columns)] if len(keys) else []
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + b"".join(planes))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    """Keys (int64) and columns of ``types``."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in (np.uint64, *types):
        t = np.dtype(t)
        plane = np.frombuffer(raw, np.uint8, n * t.itemsize, at)
        out.append(np.ascontiguousarray(plane.reshape(t.itemsize, n).T).reshape(-1).view(t) if n else np.empty(0, t))
        at += n * t.itemsize
    out[0] = np.cumsum(out[0], dtype=np.uint64).view(np.int64)
    return out


def hash_of(keys: np.ndarray) -> np.ndarray:
    """Multiplicative hash of 64 bits, the upper ones mixed best."""
    return keys.astype(np.uint64) * _MIX


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """One of 2**bits shards for each key."""
    return (hash_of(keys) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def deal(kind: int, shard: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of sorted ``keys`` and their columns, one for each shard that has any."""
    order = np.argsort(shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard, kind="stable")
    sorted_shard = shard[order]
    begins = starts(sorted_shard)
    ends = np.append(begins, len(order))[1:]
    return [(int(sorted_shard[b]), kind, pack(keys[o := order[b:e]], *[c[o] for c in columns])) for b, e in zip(begins, ends, strict=True)]


def to_batches(rows: list[tuple[int, int, bytes]], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` bytes at most."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += len(r[2])
        if total >= size:
            yield _batch(held)
            held, total = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "data"])


def exchange(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows of a shard together, kinds in order."""
    return rows.repartition(partitions, "shard").sortWithinPartitions("shard", "kind")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(shard, its rows) of what ``exchange`` gave."""
    shard, held = None, []
    for batch in batches:
        for s, k, d in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append((k, d))
    if held:
        yield shard, held


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The parts' arrays one after another, by key."""
    if len(parts) == 1:
        return parts[0]
    joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(joined[0])
    return [c[order] for c in joined]


def starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))

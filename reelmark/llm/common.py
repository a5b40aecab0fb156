"""Helpers that the corpus operators share: text columns as byte arrays, 64-bit hashing in numpy, storage for cut lineage.

Everything here works on one Arrow batch inside a task; Spark partitions and shuffles the rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reelmark.sources.storage import shared_folder, stored

__all__ = ["Hasher", "distinct", "extended", "given_back", "mixed", "runs", "segment_hashes", "shared_folder", "steps", "stored", "table", "text_bytes"]

#: Bytes of text that one step of numpy work takes; longer single texts are taken whole, alone.
STEP_BYTES = 1 << 19

#: Bytes that one running sum of hashing covers; segments that cross from one such tile to the next are put together from their parts.
TILE = STEP_BYTES
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1597334677)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offset of each row (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most `most`, or that hold a single larger row."""
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, prime: int) -> np.ndarray:
    """base^0 to base^TILE modulo a prime below 2^31."""
    out = np.ones(1, np.uint64)
    while len(out) <= TILE:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
    return out[: TILE + 1]


def _power_tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each prime the powers of its base and of that base's inverse."""
    if not _tables:
        _tables.extend((_powers(base, prime), _powers(pow(base, -1, prime), prime)) for base, prime in zip(_BASES, _PRIMES, strict=True))
    return _tables


class Hasher:
    """64-bit hashes of data[start:end] for segments that lie one after another; equal bytes give equal hashes.

    Polynomials modulo two primes near 2^31, each with a base of its own: unlike one modulo a power of two, no family of strings
    collides whatever the base. A segment's hash comes from running sums over a tile of the data, so memory doesn't grow with long texts.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.held: tuple[int, list[np.ndarray]] = (-1, [])

    def _sums(self, tile: int) -> list[np.ndarray]:
        if self.held[0] != tile:
            part = self.data[tile * TILE : (tile + 1) * TILE].astype(np.uint64) + np.uint64(1)
            sums = [np.zeros(len(part) + 1, np.uint64) for _ in _PRIMES]
            for out, (power, _) in zip(sums, _power_tables(), strict=True):
                np.cumsum(part * power[: len(part)], out=out[1:])
            self.held = tile, sums
        return self.held[1]

    def _within(self, tile: int, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        a, b = starts - tile * TILE, ends - tile * TILE
        return [(s[b] - s[a]) % np.uint64(p) * inverse[a] % np.uint64(p) for s, p, (_, inverse) in zip(self._sums(tile), _PRIMES, _power_tables(), strict=True)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """starts must rise."""
        out = np.zeros((len(_PRIMES), len(starts)), np.uint64)
        for tile in range(-(-len(self.data) // TILE)):
            lo, hi = np.searchsorted(starts, (tile * TILE, (tile + 1) * TILE))
            own = np.arange(lo, hi)[ends[lo:hi] <= (tile + 1) * TILE]
            if len(own):
                out[:, own] = self._within(tile, starts[own], ends[own])
            for k in np.arange(lo, hi)[ends[lo:hi] > (tile + 1) * TILE]:
                at, end = int(starts[k]), int(ends[k])
                while at < end:
                    stop = min(end, (at // TILE + 1) * TILE)
                    parts = self._within(at // TILE, np.array([at]), np.array([stop]))
                    for j, (part, prime, base) in enumerate(zip(parts, _PRIMES, _BASES, strict=True)):
                        out[j, k] = (int(out[j, k]) + int(part[0]) * pow(base, at - int(starts[k]), prime)) % prime
                    at = stop
        return mixed((out[0] << np.uint64(32)) | out[1])


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hasher(data).hashes(starts, ends)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    y = np.sort(x)
    return y[np.concatenate(([True], y[1:] != y[:-1]))] if len(y) else y


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def extended(schema: StructType, added: str) -> StructType:
    """The schema followed by the fields of a DDL string."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


def given_back() -> None:
    """Hands memory that a fit on the driver no longer uses back to the system, which allocators otherwise keep for themselves."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

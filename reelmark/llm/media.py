"""Media columns: payloads stored as lossless WebP pictures, and features of what is read back.

A payload is a text's UTF-8 bytes, filled up with blanks to whole rows of WIDTH grey samples (one row at least). It is stored as strips of at most STRIP_ROWS
rows, one WebP file after another, so long payloads are decoded in many small equal parts beside each other.

Defined cases: null text counts as empty, one row of blanks; equal texts have equal stored bytes and features; texts of any length are
stored whole; repeated rows are stored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm import webp
from reelmark.llm.common import steps, text_bytes

WIDTH, STRIP_ROWS = 192, 32
ENCODE_BYTES, DECODE_BYTES = 1 << 20, 20 << 20


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the length of the text in bytes and its payload as WebP files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            sizes = np.diff(offsets)
            for first, last in steps(sizes, ENCODE_BYTES):
                padded = np.maximum(1, -(-sizes[first:last] // WIDTH)) * WIDTH
                at = np.concatenate(([0], np.cumsum(padded)))
                payload = np.full(at[-1], 32, np.uint8)
                payload[np.arange(offsets[last] - offsets[first]) + np.repeat(at[:-1] - (offsets[first:last] - offsets[first]), sizes[first:last])] = data[offsets[first] : offsets[last]]
                strip = STRIP_ROWS * WIDTH
                counts = -(-padded // strip)
                starts = np.repeat(at[:-1], counts) + strip * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
                bounds = np.concatenate((starts, at[-1:]))
                files: list[bytes] = []
                for a, b in steps(np.diff(bounds), ENCODE_BYTES):
                    files += webp.encode_grey(payload[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], WIDTH)
                upto = np.concatenate(([0], np.cumsum(counts)))
                media = [b"".join(files[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(sizes[first:last]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def read_payloads(media: list[bytes]) -> list[np.ndarray]:
    """The grey samples of each stored payload."""
    pictures = [webp.riff_pictures(m) for m in media]
    flat = [p for own in pictures for p in own]
    samples: list[np.ndarray] = []
    for a, b in steps(np.array([4 * len(p) for p in flat], np.int64), DECODE_BYTES):
        samples += [(image.ravel() >> np.uint32(8)).astype(np.uint8) for image in webp.decode(flat[a:b])]
    upto = np.concatenate(([0], np.cumsum([len(own) for own in pictures])))
    return [np.concatenate(samples[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]


def feature(samples: np.ndarray) -> str:
    """Mean and variance in thousandths, number of levels, mean step between neighbours in thousandths, and 64 signs of change between 65 equal parts."""
    counts = np.bincount(samples, minlength=256)
    n, total, squares = len(samples), int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    change = int(np.abs(np.diff(samples.astype(np.int16))).sum())
    edges = np.arange(66) * n // 65
    means = np.add.reduceat(samples.astype(np.int64), edges[:-1]) / np.diff(edges)
    signs = int.from_bytes(np.packbits(means[1:] > means[:-1]).tobytes(), "big")
    return f"{1000 * total // n}:{1000 * (n * squares - total * total) // (n * n)}:{np.count_nonzero(counts)}:{1000 * change // max(1, n - 1)}:{signs:016x}"


def describe(stored: DataFrame) -> DataFrame:
    """Digests and features of the payloads as they are read back from media."""
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch["media"].to_pylist()
            for first, last in steps(np.array([4 * len(m) for m in media], np.int64), DECODE_BYTES):
                own = media[first:last]
                payloads = read_payloads(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, last - first),
                        batch["n_bytes"].slice(first, last - first),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-16:].tobytes()) for p in payloads], pa.int64()),
                        pa.array([len(m) for m in own], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in own]),
                        pa.array([feature(p) for p in payloads]),
                    ],
                    [c.split()[0] for c in columns.split(", ")],
                )

    return stored.mapInArrow(read, columns)

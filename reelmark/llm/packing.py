"""Packing of tokenised documents into windows of equal capacity by best-fit decreasing.

Each document's ids (with an end id) are cut into full windows and a rest. The pieces, not the ids, are dealt at random into groups
of a bounded number of documents; each group is packed on its own: pieces by falling length, each into the open window with the
least room that still takes it, found with a segment tree over the possible rooms.

Defined cases: null or empty text is the end id alone; an overlong document fills whole windows before its rest is packed; equal
lengths are taken by doc_id and start; repeated rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Documents that one packing group holds on average; more groups, not larger ones, as the input grows.
GROUP_DOCUMENTS = 50_000

#: Blanks on which Python and the tokenizer may differ, and the start of its special tokens: such a text is encoded in one call.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|")
#: Fixed value: the tokenizer's own cuts (endings after an apostrophe, letters, single numbers, other marks), for lower-case characters below 256.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
# Fixed value: how a tokenizer must normalise and cut for the pattern above to stand for its cuts; texts for any other go through it whole.
_CUTS_ALONE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Pretokens that a worker remembers, in two halves; the older half is dropped as the younger one fills.
_CACHED = 480_000
_encoders: dict[str, Encoder] = {}


class _Memo(dict):
    """key -> ids as little-endian 32-bit bytes, computed when missing; memory stays bounded and frequent keys stay."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _CACHED // 2:
            self.older = dict(self)
            self.clear()
        value = self[key] = self.older.get(key) or self.compute(key)
        return value


def _latin(text: str) -> bool:
    """All characters lie below 256: lower-casing and composition work on each alone."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """The ids of a text as bytes. A tokenizer cuts a text into pretokens and never joins across them, so where its cuts are known each is encoded once and remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        self.cuts_known = all(own[k] == v for k, v in _CUTS_ALONE.items()) and all(t["content"].startswith("<|") for t in own["added_tokens"])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_letters = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.pretokens = _Memo(self._pretoken)

    def _pretoken(self, pretoken: str) -> bytes:
        plain = pretoken.isascii() and pretoken.isprintable()
        letters = pretoken if plain else pretoken.encode().decode("latin-1").translate(self.byte_letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not self.cuts_known or not _latin(text) or any(x in text for x in _ODD):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(text.lower())))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for each piece of at most `window` ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                rows += [(doc_id, a, min(window, n - a), zlib.crc32(ids[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset for each length; lengths must fall. A segment tree counts open windows by the room they have left."""
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    by_room: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, opened = [], [], 0
    for need in lengths:
        i = need + size
        while not tree[i]:  # up and to the right, until some window with enough room lies below
            while i & 1:
                i >>= 1
            if i <= 1:
                i = 0
                break
            i += 1
        if i:
            while i < size:
                i = 2 * i + (not tree[2 * i])
            room = i - size
            at = by_room[room].pop()
            while i:
                tree[i] -= 1
                i >>= 1
        else:
            room, at, opened = window, opened, opened + 1
        number.append(at)
        offset.append(window - room)
        if left := room - need:
            by_room[left].append(at)
            i = left + size
            while i:
                tree[i] += 1
                i >>= 1
    return number, offset


def pack(cut: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset. A group's windows have ids from group * 2^40 on."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        number, offset = best_fit(rows["length"].tolist(), window)
        rows["sequence_id"] = np.array(number, np.int64) + (int(key[0]) << 40)
        rows["offset"] = np.array(offset, np.int64)
        return rows.drop(columns="part")

    out = ", ".join(f"{n} long" for n in [*cut.columns, "sequence_id", "offset"])
    # The place of a row among its task's rows is the same whenever that task runs, so a repeated task deals its rows as before.
    dealt = cut.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(fill, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """One row per piece of every document: where its ids stand in which sequence."""
    groups = max(1, -(-docs.count() // group_documents))
    return pack(pieces(docs, tokenizer_path, window), groups, window)

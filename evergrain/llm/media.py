"""Media columns: payloads stored as PNG, read back with checksum tests, and cosine-transform hashes.

A PNG is a signature and chunks (length, type, data, CRC-32 of type and data); the image data is one zlib stream
of filtered rows. Writing picks, for each row, the filter with the least sum of absolute differences; reading
undoes all five filters with numpy, whole runs of rows at a time: none, sub and up by running sums, Average and Paeth along diagonals.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type, 8 bits a sample.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels in a row; with three channels a row holds 192 bytes.
WIDTH = 64
SIDE, LOW = 32, 8


class BadMedia(ValueError):
    """The bytes are no PNG that can be read, or a checksum fails."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """samples: (height, width, channels) of uint8, channels 1 to 4."""
    height, width, channels = samples.shape
    colour = next(c for c, n in CHANNELS.items() if n == channels)
    rows = samples.reshape(height, width * channels)
    left = np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])  # none, sub, up; differences modulo 256
    cost = np.minimum(tried, 256 - tried.astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    filtered = np.empty((height, 1 + rows.shape[1]), np.uint8)
    filtered[:, 0] = best
    filtered[:, 1:] = tried[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(stored: bytes) -> Iterator[tuple[bytes, bytes]]:
    if stored[:8] != SIGNATURE:
        raise BadMedia("no PNG signature")
    at, kind = 8, b""
    while at < len(stored) and kind != b"IEND":
        if at + 12 > len(stored):
            raise BadMedia("a chunk is cut off")
        (length,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + length]
        if len(data) < length or stored[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + data)):
            raise BadMedia(f"checksum of {kind!r} fails")
        yield kind, data
        at += 12 + length
    if kind != b"IEND":
        raise BadMedia("no end chunk")


def _by_neighbours(rows: np.ndarray, kinds: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    """Average and Paeth rows undone. A pixel needs those to its left, above and left above, so all pixels of a diagonal
    are undone at once: so many numpy steps as the rows are wide and high together."""
    height, width = len(rows), rows.shape[1] // channels
    pixels = rows.reshape(height, width, channels).astype(np.int16)
    out = np.zeros((height + 1, width + 1, channels), np.int16)
    out[0, 1:] = above.reshape(width, channels)
    average = (kinds == 3)[:, None]
    for k in range(height + width - 1):
        y = np.arange(max(0, k - width + 1), min(height, k + 1))
        x = k - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        out[y + 1, x + 1] = (pixels[y, x] + np.where(average[y], (a + b) // 2, paeth)) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


def _unfilter(filtered: np.ndarray, channels: int) -> np.ndarray:
    kinds, rows = filtered[:, 0], filtered[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise BadMedia(f"unknown filter {kinds.max()}")
    height, wide = rows.shape
    runs = np.flatnonzero(np.r_[True, np.minimum(kinds[1:], 3) != np.minimum(kinds[:-1], 3), True]) if height else np.zeros(1, np.int64)
    for at, end in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        if kinds[at] == 1:
            pixels = rows[at:end].reshape(end - at, wide // channels, channels)
            rows[at:end] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(end - at, wide)
        elif kinds[at] == 2:
            first = max(0, at - 1)
            rows[at:end] = np.cumsum(rows[first:end], axis=0, dtype=np.uint8)[at - first :]
        elif kinds[at] > 2:
            rows[at:end] = _by_neighbours(rows[at:end], kinds[at:end], rows[at - 1] if at else np.zeros(wide, np.uint8), channels)
    return rows


def decode_png(stored: bytes) -> np.ndarray:
    """(height, width, channels) of uint8. 8 bits a sample, no interlacing, no palette; every checksum is tested."""
    head, data = None, []
    for kind, part in _chunks(stored):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise BadMedia("only 8-bit samples without palette or interlacing are read")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if len(raw) != height * (1 + width * channels):
        raise BadMedia("image data has another length than its header says")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels).reshape(height, width, channels)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest frequencies of the 32 x 32 grey image lie over their median.

    Each of the 32 x 32 is the mean of all samples of its cell; on a side of fewer than 32 pixels cells repeat them.
    """
    height, width, channels = samples.shape
    tall, wide = (np.arange(SIDE) * height) // SIDE, (np.arange(SIDE) * width) // SIDE
    high, broad = (np.maximum(1, np.diff(np.r_[at, n])) for at, n in ((tall, height), (wide, width)))
    columns = np.add.reduceat(samples.reshape(height, -1), tall, axis=0, dtype=np.int64).reshape(SIDE, width, channels).sum(axis=2)
    small = np.add.reduceat(columns, wide, axis=1) / (np.outer(high, broad) * channels)
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media (PNG), payload (read back from it), feature, for every row.

    The payload is the text's UTF-8 bytes (null: none) and spaces up to a positive multiple of a row of 3 * width
    bytes. Equal texts give equal values. Repeated rows and null ids pass through one by one; a text of any length
    becomes one image of as many rows as it takes. Narrow: no shuffle.
    """
    row = 3 * width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.iloc[begin : begin + 256]
                out: dict[str, list] = {"n_bytes": [], "media": [], "payload": [], "feature": []}
                for text in part["text"]:
                    raw = text.encode("utf-8", "replace")
                    payload = raw.ljust(max(row, -(-len(raw) // row) * row), b" ")
                    media = encode_png(np.frombuffer(payload, np.uint8).reshape(-1, width, 3))
                    samples = decode_png(media)
                    out["n_bytes"].append(len(raw))
                    out["media"].append(media)
                    out["payload"].append(samples.tobytes())
                    out["feature"].append(cosine_hash(samples))
                yield pd.DataFrame({"doc_id": part["doc_id"].array} | out)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string")

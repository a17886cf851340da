"""Media columns: lossless PNG in binary columns, read back chunk by chunk, with cosine-transform hashes.

encode() makes an 8-bit grey PNG of bytes, decode() reads non-interlaced 8-bit PNGs of grey or colour samples (no palettes)
back: it tests each chunk's checksum, inflates the image data, as much as the header announces and no more, tests their own
checksum and undoes the five row filters with numpy. with_png() and with_features() are the DataFrame forms.

Defined results: a null payload is an empty one; an empty payload gives one tile of 255s; equal payloads give equal
media and features; broken media, also such that end early, hold more than announced or announce more than MOST_BYTES, raise
ValueError, or give nulls and a reason where `on_error="null"`. Only the named
columns are read, so that further columns with clashing names don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

TILE = 24  # pixels; a payload is a whole number of TILE x TILE tiles
PAD = 255
MOST_BYTES = 1 << 30  # of an image's samples
FLUSH_BYTES = 4 << 20  # rows go on to Spark in batches of about this size


def padded(data: bytes) -> bytes:
    """data and PAD up to a positive multiple of a tile's bytes."""
    unit = TILE * TILE
    return data + bytes([PAD]) * (unit - len(data) if not data else -len(data) % unit)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def chunks(png: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """Kind and body of each chunk up to IEND, each checksum tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, view = 8, memoryview(png)
    while True:
        if at + 12 > len(png):
            raise ValueError("the PNG ends before its last chunk")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], view[at + 8 : at + 8 + n]
        if at + 12 + n > len(png) or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(view[at + 4 : at + 8 + n]):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IEND":
            return
        yield kind, body
        at += 12 + n


def filtered(pixels: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """The rows of a (height, bytes) image under one of the filters that numpy applies to all rows at once."""
    left, up = np.zeros_like(pixels), np.zeros_like(pixels)
    left[:, bpp:], up[1:] = pixels[:, :-bpp], pixels[:-1]
    if kind == AVERAGE:
        return pixels - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    if kind == PAETH:
        corner = np.zeros_like(pixels)
        corner[1:, bpp:] = pixels[:-1, :-bpp]
        return pixels - paeth(left, up, corner)
    return pixels - {NONE: np.zeros_like(pixels), SUB: left, UP: up}[kind]


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, upper and corner bytes the nearest to left + upper - corner, ties in this order."""
    x, y, z = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    da, db, dc = np.abs(y - z), np.abs(x - z), np.abs(x + y - 2 * z)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def unfiltered(kinds: np.ndarray, lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the filters of all rows: runs of rows under one filter are done at once."""
    if kinds.size and kinds.max() > PAETH:
        raise ValueError("unknown filter")
    out = np.empty_like(lines)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    above = np.zeros(lines.shape[1], np.uint8)
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
        if start == end:
            continue
        run, kind = lines[start:end], kinds[start]
        if kind == NONE:
            out[start:end] = run
        elif kind == SUB:
            out[start:end] = np.add.accumulate(run.reshape(len(run), -1, bpp), axis=1, dtype=np.uint8).reshape(run.shape)
        elif kind == UP:
            np.add.accumulate(run, axis=0, dtype=np.uint8, out=out[start:end])
            out[start:end] += above
        else:
            out[start:end] = slanted(run, above, bpp, kind)
        above = out[end - 1]
    return out


def slanted(run: np.ndarray, above: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """AVERAGE and PAETH need the left, upper and corner bytes: slants of pixels are done at once."""
    h, w = len(run), run.shape[1] // bpp
    grid = np.zeros((h + 1, w + 1, bpp), np.uint8)
    grid[0, 1:] = above.reshape(w, bpp)
    source = run.reshape(h, w, bpp)
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        left, up, corner = grid[r + 1, c], grid[r, c + 1], grid[r, c]
        guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == AVERAGE else paeth(left, up, corner)
        grid[r + 1, c + 1] = source[r, c] + guess
    return grid[1:, 1:].reshape(h, -1)


def encode(payload: bytes, level: int = 6, kinds: tuple[int, ...] = (NONE, SUB, UP), idat_bytes: int = 1 << 16) -> bytes:
    """A grey 8-bit PNG of TILE columns; of the filters in kinds the one with the least sum of signed sizes is used."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, TILE)
    best = min(((filtered(pixels, 1, k), k) for k in kinds), key=lambda x: (int(np.minimum(x[0], 0 - x[0]).sum(dtype=np.int64)), x[1]))
    lines = np.empty((len(pixels), TILE + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best[1], best[0]
    z = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", TILE, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", z[i : i + idat_bytes]) for i in range(0, len(z), idat_bytes)) + chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """Samples as (height, width, channels) of an 8-bit, non-interlaced PNG."""
    size, inflate, parts, room = None, zlib.decompressobj(), [], 0
    try:
        for kind, body in chunks(png):
            if (kind == b"IHDR") != (size is None) or kind == b"IHDR" and len(body) != 13:
                raise ValueError("the PNG doesn't begin with one header")
            if kind == b"IHDR":
                width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
                if depth != 8 or colour not in CHANNELS or interlace:
                    raise ValueError("only 8-bit samples without palette or interlace are read")
                size = width, height, CHANNELS[colour]
                room = height * (width * size[2] + 1)
                if not 0 < width * height or room > MOST_BYTES:
                    raise ValueError(f"an image of {width} x {height}")
            elif kind == b"IDAT":
                if inflate.eof:
                    raise ValueError("image data behind their end")
                parts.append(inflate.decompress(body, room + 1))
                room -= len(parts[-1])
                if room < 0:
                    raise ValueError("more image data than the header announces")
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if size is None or room or not inflate.eof or inflate.unused_data:
        raise ValueError("the image data don't fit the header or lack their end")
    width, height, bpp = size
    lines = np.frombuffer(b"".join(parts), np.uint8).reshape(height, width * bpp + 1)
    return unfiltered(lines[:, 0], lines[:, 1:], bpp).reshape(height, width, bpp)


def cosines(n: int) -> np.ndarray:
    """The orthogonal cosine transform (type II)."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)


COSINES = cosines(TILE)


def cosine_hash(pixels: np.ndarray, low: int = 8) -> bytes:
    """64 bits: which of the low x low lowest frequencies of the image, shrunk to TILE x TILE, are over their median.

    The image must be TILE wide and a multiple of TILE high, or it is cut and repeated to that.
    """
    h, w = pixels.shape[:2]
    grey = pixels.reshape(h, w, -1).astype(np.float64).mean(axis=2)
    if w != TILE or h % TILE:
        grey = grey[np.arange(-(-h // TILE) * TILE) * h // (-(-h // TILE) * TILE)][:, np.arange(TILE) * w // TILE]
    small = grey.reshape(TILE, -1, TILE).mean(axis=1)
    low_part = np.round((COSINES @ small @ COSINES.T)[:low, :low].ravel(), 6)
    return np.packbits(low_part > np.median(low_part[1:])).tobytes()


def flushed(rows: Iterator[dict], schema: pa.Schema, weigh: str) -> Iterator[pa.RecordBatch]:
    """Batches of about FLUSH_BYTES of the column weigh, however many rows these are."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"") + 64
        if size >= FLUSH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def with_png(df: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """key (long), n_bytes (long, unpadded) and media (binary, a PNG) of each row's binary column data."""
    out = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                for k, d in zip(b.column(0), b.column(1), strict=True):
                    d = d.as_py() or b""
                    yield {key: k.as_py(), "n_bytes": len(d), "media": encode(padded(d))}

        yield from flushed(each(), out, "media")

    return df.select(F.col(key).cast("long").alias(key), F.col(data).cast("binary").alias("data")).mapInArrow(store, f"`{key}` long, n_bytes long, media binary")


def with_features(df: DataFrame, key: str = "doc_id", media: str = "media", on_error: str = "raise") -> DataFrame:
    """key, n_bytes, payload (binary), dct_hash (binary, 8 bytes), media and error, read from the stored media."""
    out = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("dct_hash", pa.binary()), ("media", pa.binary()), ("error", pa.string())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                for k, n, m in zip(*b.columns, strict=True):
                    png, row = m.as_py(), {key: k.as_py(), "n_bytes": n.as_py(), "payload": None, "dct_hash": None, "error": None}
                    try:
                        pixels = decode(png or b"")
                        row |= {"payload": pixels.tobytes(), "dct_hash": cosine_hash(pixels)}
                    except ValueError as e:
                        if on_error != "null":
                            raise
                        row["error"] = str(e)
                    yield row | {"media": png}

        yield from flushed(each(), out, "payload")

    return df.select(F.col(key).cast("long").alias(key), "n_bytes", F.col(media).cast("binary").alias("media")).mapInArrow(load, f"`{key}` long, n_bytes long, payload binary, dct_hash binary, media binary, error string")

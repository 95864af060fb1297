"""Media columns: Netpbm and BMP images in binary columns.

Payloads are stored as 8-bit samples in a binary PPM of ``WIDTH`` pixels a row, and read back by decoding the stored
bytes. Images of the Netpbm family (P1 to P6) and uncompressed BMP (8, 24 and 32 bits) become numpy arrays, are shrunk by
area to a quarter of their side with integral images, cut to a grid of NPY tiles of ``TILE`` by ``TILE`` pixels and
described by a difference hash of each tile and of the whole. One row is one image: nothing is shuffled, and memory holds
one image at a time, beside it only views of it and integral images of strips of about ``STRIP`` samples.

Defined results: a null text counts as empty, whose payload is one row of spaces; equal texts have equal values; a tile at
the right or lower edge is as small as what is left; a file that is no such image, is cut short or has more samples than it
says raises ``ValueError``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Pixels a row of a stored payload, three samples each.
WIDTH = 64
ROW = 3 * WIDTH
PAD = 32

#: Rows and columns of the difference hash, side of an NPY tile, and how many pixels of a side become one.
HASH, TILE, SHRINK = 8, 16, 4
#: Samples of a strip whose integral image is held at once (a strip has one row at least).
STRIP = 1 << 20

_SPACE = rb"(?:[\x20\t-\r]|#[^\r\n]*[\r\n])+"


def pad(data: bytes) -> bytes:
    """Filled with spaces to a positive multiple of a row."""
    return data + bytes([PAD]) * (-len(data) % ROW if data else ROW)


def encode_ppm(pixels: np.ndarray) -> bytes:
    """An (h, w, 3) array of bytes as binary PPM."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An (h, w, 3) array of bytes as 24-bit BMP, rows from the bottom and padded to four bytes."""
    h, w, _ = pixels.shape
    stride = -(-3 * w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an (h, w, channels) array; samples of two bytes keep 16 bits, bitmaps become 0 (black) and 255. Binary
    samples of a byte are a view of the data."""
    kind = int(bytes(data[1:2]))
    numbers = 2 if kind in (1, 4) else 3
    head = re.compile(rb"P[1-6]" + rb"".join([_SPACE + rb"(\d+)"] * numbers) + rb"[\x20\t-\r]").match(data)
    if head is None:
        raise ValueError("no Netpbm header")
    w, h, most = (*map(int, head.groups()), 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    count, body = w * h * channels, memoryview(data)[head.end() :]
    if not 0 < most < 65536 or not count:
        raise ValueError("bad Netpbm header")
    if kind == 4:
        stride = -(-w // 8)
        if len(body) < stride * h:
            raise ValueError("Netpbm data is cut short")
        bits = np.unpackbits(np.frombuffer(body, np.uint8, stride * h).reshape(h, stride), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if kind in (5, 6):
        kind_of = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
        if len(body) < count * kind_of.itemsize:
            raise ValueError("Netpbm data is cut short")
        samples = np.frombuffer(body, kind_of, count)
        return samples.astype(kind_of.newbyteorder("="), copy=False).reshape(h, w, channels)
    body = re.sub(rb"#[^\r\n]*", b" ", bytes(body))
    values = [int(x) for x in (re.findall(rb"[01]", body) if kind == 1 else body.split())[:count]]
    if len(values) < count or max(values) > most:
        raise ValueError("Netpbm data is cut short or out of range")
    array = np.array(values, np.uint16 if most > 255 else np.uint8).reshape(h, w, channels)
    return ((1 - array) * 255).astype(np.uint8) if kind == 1 else array


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits as an (h, w, 3) array."""
    if len(data) < 54:
        raise ValueError("BMP header is cut short")
    offset, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32) or w <= 0 or h == 0 or header < 40:
        raise ValueError("BMP form not supported")
    stride = -(-w * bits // 32) * 4
    if len(data) < offset + stride * abs(h):
        raise ValueError("BMP data is cut short")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:: -1 if h > 0 else 1]
    if bits == 8:
        entries = (offset - 14 - header) // 4
        palette = np.frombuffer(data, np.uint8, 4 * entries, 14 + header).reshape(entries, 4)
        return palette[rows[:, :w]][:, :, 2::-1]
    step = bits // 8
    return rows[:, : w * step].reshape(abs(h), w, step)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """A Netpbm or BMP file as an array of rows, columns and channels."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if re.match(rb"P[1-6]", data):
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Each output sample is the mean of the input area below it, fractions of pixels included.

    The integral image is read at fractional corners by linear interpolation, which is exact for areas. It is made strip by
    strip from the last row of the strip before, and of each strip only the rows that corners lie between are kept, read at
    the output's columns. Sums of samples stay below 2**53, so doubles hold them exactly.
    """
    h, w, channels = pixels.shape

    def corners(size: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * size
        whole = edge // parts
        return whole, np.minimum(whole + 1, size), (edge % parts) / parts

    top, below, down = corners(h, rows)
    left, right, across = corners(w, columns)
    wanted = np.unique(np.concatenate([top, below]))
    held = np.zeros((len(wanted), columns + 1, channels))
    step = max(1, STRIP // (w * channels))
    last = np.zeros((1, w + 1, channels))
    for y in range(0, h, step):
        strip = pixels[y : y + step]
        total = np.zeros((len(strip) + 1, w + 1, channels))
        np.cumsum(strip, axis=1, dtype=np.float64, out=total[1:, 1:])
        np.cumsum(total[1:], axis=0, out=total[1:])
        total += last
        last = total[-1:].copy()
        lo, hi = np.searchsorted(wanted, [y, y + len(strip) + (y + step >= h)])
        at = total[wanted[lo:hi] - y]
        held[lo:hi] = at[:, left] * (1 - across)[:, None] + at[:, right] * across[:, None]
    sums = held[np.searchsorted(wanted, top)] * (1 - down)[:, None, None] + held[np.searchsorted(wanted, below)] * down[:, None, None]
    areas = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return areas * (rows * columns / (h * w))


def gray(pixels: np.ndarray) -> np.ndarray:
    """Rec. 601 luma of three channels, or the one channel."""
    return pixels @ np.array([0.299, 0.587, 0.114]) if pixels.shape[2] == 3 else pixels[:, :, 0].astype(np.float64)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hexadecimal: whether each of 8 by 8 areas is darker than its right neighbour."""
    small = np.round(gray(area_resize(pixels, HASH, HASH + 1)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    """The image as an NPY file of 8 bits."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(pixels), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tiled(pixels: np.ndarray, side: int = TILE, shrink: int = SHRINK) -> list[tuple[bytes, str]]:
    """The image shrunk by area and cut, row by row, to tiles of at most ``side`` by ``side``: NPY file and difference hash of each."""
    h, w = (max(1, -(-n // shrink)) for n in pixels.shape[:2])
    small = area_resize(pixels, h, w)
    cuts = (small[y : y + side, x : x + side] for y in range(0, h, side) for x in range(0, w, side))
    return [(npy(c), difference_hash(c)) for c in cuts]


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<binary>, tile_hashes array<string>"


def stored_form(text: memoryview | bytes) -> bytearray:
    """A text's bytes, filled up, as the PPM file that holds them."""
    n = len(text)
    filled = n + (-n % ROW if n else ROW)
    out = bytearray(b"P6\n%d %d\n255\n" % (WIDTH, filled // ROW))
    out += text
    out += bytes([PAD]) * (filled - n)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """Per document: digests of the payload as read back, of the stored image, its difference hash, and tiles with theirs."""

    def one(text: pa.Scalar) -> tuple:
        data = memoryview(text.as_buffer() or b"") if text.is_valid else b""
        stored = stored_form(data)
        image = decode(stored)
        payload = memoryview(image.reshape(-1))
        cuts = tiled(image)
        hashes = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        return len(data), len(payload), *hashes, difference_hash(image), [t for t, _ in cuts], [h for _, h in cuts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()))
        names = [c.split()[0] for c in STORED.split(", ")]
        for batch in batches:
            rows = [one(text) for text in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED)


def tiles(images: DataFrame, column: str = "image", side: int = TILE, shrink: int = SHRINK) -> DataFrame:
    """Per row of a binary column of image files: its rows, columns, difference hash, and NPY tiles with theirs; null for null.

    Other columns are kept; the new ones are ``height``, ``width``, ``dhash``, ``tiles`` and ``tile_hashes``.
    """
    new = ("height", "width", "dhash", "tiles", "tile_hashes")

    @F.arrow_udf("struct<height int, width int, dhash string, tiles array<binary>, tile_hashes array<string>>")
    def one(files: pa.Array) -> pa.Array:
        out = []
        for file in files:
            if not file.is_valid:
                out.append(None)
                continue
            pixels = decode(file.as_py())
            cuts = tiled(pixels, side, shrink)
            out.append({"height": pixels.shape[0], "width": pixels.shape[1], "dhash": difference_hash(pixels), "tiles": [t for t, _ in cuts], "tile_hashes": [h for _, h in cuts]})
        return pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("dhash", pa.string()), ("tiles", pa.list_(pa.binary())), ("tile_hashes", pa.list_(pa.string()))]))

    keep = [F.col(f"`{c}`") for c in images.columns if c not in new]
    return images.select(*keep, one(F.col(column)).alias("__m")).select(*keep, "__m.*")

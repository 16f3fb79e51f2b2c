"""Media columns: Netpbm and BMP images, area resizing by integral images, NPY tiles and difference hashes.

``decode`` reads PBM, PGM and PPM (P1 to P6, up to 16 bits, comments allowed) and uncompressed BMP (1, 4, 8, 24 and 32 bits, either row
order) into arrays of height x width x channels. ``resize`` averages exact areas, whole or in part, from the image's integral.
``dhash`` compares neighbours of a 9 x 8 reduction. ``npy`` is the array in NumPy's file format, version 1.0.

Bytes without a picture (null, cut short, of unknown format) have null features and an error text; nothing is raised.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts

WIDTH = 64  # pixels in a row of a stored text: 192 bytes
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_ppm(samples: np.ndarray) -> bytes:
    """height x width x 3 bytes as P6."""
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """height x width x 3 bytes as a 24-bit BMP, rows from below."""
    h, w, _ = samples.shape
    pad = -3 * w % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = samples[::-1, :, ::-1].reshape(h, 3 * w)
    size = rows.size
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("header cut short")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3]
    if not w or not h or not 0 < top < 65536:
        raise ValueError("header out of range")
    channels = 3 if kind in (3, 6) else 1
    if kind == 1:
        found = re.sub(rb"#[^\n]*|\s", b"", data[at:])[: w * h]
        values = 1 - (np.frombuffer(found, np.uint8) - 48)
    elif kind in (2, 3):
        found = re.sub(rb"#[^\n]*", b" ", data[at:]).split()[: w * h * channels]
        values = np.array(found, dtype=np.int64).astype(np.uint8 if top < 256 else np.uint16)
    elif kind == 4:
        row = (w + 7) // 8
        if len(data) < at + 1 + row * h:
            raise ValueError("samples cut short")
        values = 1 - np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].reshape(-1)
    else:
        unit = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(data) < at + 1 + w * h * channels * unit.itemsize:
            raise ValueError("samples cut short")
        values = np.frombuffer(data, unit, w * h * channels, at + 1)
    if values.size != w * h * channels:
        raise ValueError("samples cut short")
    return values.astype(np.uint8 if top < 256 else np.uint16).reshape(h, w, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("header cut short")
    offset, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError("BMP of an unsupported kind")
    row = (w * bits + 31) // 32 * 4
    if len(data) < offset + row * abs(h):
        raise ValueError("samples cut short")
    rows = np.frombuffer(data, np.uint8, row * abs(h), offset).reshape(abs(h), row)
    if bits >= 24:
        out = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = rows[:, :w] if bits == 8 else np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        out = palette[index[:, :w]]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _areas(integral: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
    """Differences of the integral between ``edges`` along an axis, linear within a cell."""
    lower = np.minimum(edges.astype(np.int64), integral.shape[axis] - 2)
    part = (edges - lower).reshape([-1 if k == axis else 1 for k in range(integral.ndim)])
    return np.diff(np.take(integral, lower, axis) * (1 - part) + np.take(integral, lower + 1, axis) * part, axis=axis)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a height x width x channels image, as doubles."""
    h, w, c = image.shape
    integral = np.zeros((h + 1, w + 1, c), np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
    sums = _areas(_areas(integral, np.arange(height + 1) * (h / height), 0), np.arange(width + 1) * (w / width), 1)
    return sums / (h / height * w / width)


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma in thousandths, as one channel."""
    return (image.astype(np.int64) @ np.array([299, 587, 114]) if image.shape[2] == 3 else image[:, :, 0].astype(np.int64) * 1000)[:, :, None]


def dhash(image: np.ndarray) -> str:
    """16 hex digits: a bit for each of 8 x 8 places, set where a place is darker than its right neighbour (by over a thousandth of a unit of thousandths, against rounding)."""
    small = resize(grey(image), 8, 9)[:, :, 0]
    return np.packbits(small[:, 1:] - small[:, :-1] > 1e-3).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


FEATURES = "height int, width int, channels int, feature string, tile binary, error string"


def features(data: bytes | None, tile: int = 16) -> tuple:
    """FEATURES of an image: its shape, difference hash and a tile x tile NPY reduction of its samples."""
    try:
        image = decode(data or b"")
        return (*image.shape, dhash(image), npy(np.rint(resize(image, tile, tile)).astype(image.dtype)), None)
    except (ValueError, struct.error, IndexError) as e:
        return (None, None, None, None, None, str(e) or type(e).__name__)


def media_features(media: DataFrame, id_col: str, media_col: str, tile: int = 16) -> DataFrame:
    """id and FEATURES of each row's image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x, tile) for x in b.column(1).to_pylist()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", "height", "width", "channels", "feature", "tile", "error"])

    small_batches(media.sparkSession)
    kind = dict(media.dtypes)[id_col]
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {FEATURES}").withColumnRenamed("id", id_col)


def stored_text(text: bytes | None) -> bytes:
    """A text as an image of rows of WIDTH pixels: padded with spaces to a positive multiple of 192 bytes; BMP where the rows are even
    in number, PPM where they are odd."""
    text = text or b""
    row = 3 * WIDTH
    samples = np.frombuffer(text.ljust(max(1, -(-len(text) // row)) * row), np.uint8).reshape(-1, WIDTH, 3)
    return encode_ppm(samples) if len(samples) % 2 else encode_bmp(samples)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text stored losslessly as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x or b"") for x in rows], pa.int64()), pa.array([stored_text(x) for x in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text as an image to the shared folder, reads the images back and returns DIGESTS of them and of their tiles.

    A null text is empty, which is one row of spaces. An empty table gives an empty result; equal rows give equal rows.
    """
    stored = materialise(text_media(docs, id_col, text_col), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for media in b.column(2).to_pylist():
                image = decode(media)
                payload = image.tobytes()
                _, _, _, feature, tile, _ = features(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, hashlib.sha256(tile).hexdigest()))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    return stored.mapInArrow(run, DIGESTS)

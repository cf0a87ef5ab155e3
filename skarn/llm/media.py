"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

Defined cases: a null payload column reads as empty bytes; an empty text still makes one row of 64 zero bytes; a blob
that is no image of the known kinds raises ValueError in `decode`; equal payloads give equal media and features.
Extra columns of the input are ignored.
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
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

#: Samples in a row of a stored payload.
WIDTH = 64
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A 2-d uint8 array as binary PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """A (height, width, 3) uint8 array as binary PPM."""
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A 2-d uint8 array as an 8-bit grey BMP, or (h, w, 3) RGB as 24-bit BMP; rows bottom-up and padded to 4 bytes."""
    colour = samples.ndim == 3
    height, width = samples.shape[:2]
    rows = samples[::-1, :, ::-1] if colour else samples[::-1]
    rows = np.ascontiguousarray(rows).reshape(height, -1)
    pad = -rows.shape[1] % 4
    body = np.pad(rows, ((0, 0), (0, pad))).tobytes()
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).copy()
    if not colour:
        palette[:, 3] = 0
        palette = palette.tobytes()
    offset = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + len(body), 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24 if colour else 8, 0, len(body), 2835, 2835, 0 if colour else 256, 0)
    return head + info + palette + body


def _netpbm(blob: bytes) -> np.ndarray:
    m = _HEADER.match(blob)
    if not m:
        raise ValueError("no Netpbm header")
    kind, width, height = int(m[1]), int(m[2]), int(m[3])
    at = m.end()
    top = 1
    if kind not in (1, 4):
        m = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(blob, at)
        if not m:
            raise ValueError("no maximum value in the Netpbm header")
        top, at = int(m[1]), m.end()
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", blob[at:])
        values = np.array(list(body.translate(None, b" \t\r\n\v\f")), np.int64) - 48 if kind == 1 else np.array(body.split(), np.int64)
    elif kind == 4:
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        values = bits[:, :width].reshape(-1).astype(np.int64)
    else:
        values = np.frombuffer(blob, np.uint8 if top < 256 else ">u2", n, at + 1)
    values = values[:n]
    if len(values) < n:
        raise ValueError("the image is cut short")
    if kind in (1, 4):
        values = 1 - values  # 1 is black
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    values = values.astype(np.uint8)
    return values.reshape((height, width, 3) if planes == 3 else (height, width))


def _bmp(blob: bytes) -> np.ndarray:
    offset, = struct.unpack_from("<I", blob, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", blob, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits, compression {packed}")
    tall, each = abs(height), bits // 8
    stride = (width * each + 3) // 4 * 4
    rows = np.frombuffer(blob, np.uint8, stride * tall, offset).reshape(tall, stride)[:, : width * each]
    rows = rows if height < 0 else rows[::-1]
    if bits == 8:
        colours = np.frombuffer(blob, np.uint8, (offset - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        grey = (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all()
        return colours[:, 0][rows] if grey else colours[:, 2::-1][rows]
    return np.ascontiguousarray(rows.reshape(tall, width, each)[:, :, 2::-1])


def decode(blob: bytes) -> np.ndarray:
    """(height, width) grey or (height, width, 3) RGB samples of a Netpbm (P1 to P6) or BMP (8, 24, 32 bits) image."""
    if blob[:2] == b"BM":
        return _bmp(blob)
    return _netpbm(blob)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages, exact for any ratio: the integral image read at fractional borders by bilinear interpolation."""
    tall, wide = samples.shape[:2]
    integral = np.zeros((tall + 1, wide + 1, *samples.shape[2:]))
    np.cumsum(np.cumsum(samples, 0, dtype=np.float64), 1, out=integral[1:, 1:])

    def at(borders: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(borders.astype(np.int64), top - 1)
        return low, borders - low

    low, part = at(np.arange(height + 1) * tall / height, tall)
    part = part.reshape(-1, *[1] * (integral.ndim - 1))
    rows = integral[low] * (1 - part) + integral[low + 1] * part
    low, part = at(np.arange(width + 1) * wide / width, wide)
    part = part.reshape(1, -1, *[1] * (integral.ndim - 2))
    both = rows[:, low] * (1 - part) + rows[:, low + 1] * part
    sums = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return sums * (height * width / (tall * wide))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits in hex: whether each of 8x8 areas is darker than its right neighbour, at 1e-6 of a grey level."""
    grey = samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(samples: np.ndarray, side: int = 16) -> bytes:
    """The image at side x side as NPY bytes of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: the UTF-8 bytes of each text, padded, as a binary PGM of 64 columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "data"):
                data = [x or b"" for x in b.column("data").to_pylist()]
                media = [encode_pgm(np.frombuffer(padded(x), np.uint8).reshape(-1, WIDTH)) for x in data]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def features(media: DataFrame, side: int = 16) -> DataFrame:
    """Decodes the stored media: payload digests read back from the samples, the NPY tile and the difference hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media"):
                rows = []
                for blob in b.column("media").to_pylist():
                    samples = decode(blob)
                    payload = samples.tobytes()
                    npy = tile(samples, side)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{difference_hash(samples)}:{hashlib.sha256(npy).hexdigest()[:16]}", npy))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(to_media(table(spark, sf_dir, "documents")), "media")
    found = written(features(media), "media-tiles")
    # The tile's digest is taken of the tile that was read back.
    feature = F.concat_ws(":", F.substring_index("feature", ":", 1), F.substring(F.sha2("tile", 256), 1, 16))
    return found.withColumn("feature", feature).withColumnRenamed("id", "doc_id").drop("tile")

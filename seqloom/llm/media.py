"""Media columns: Netpbm and BMP images decoded to numpy, area-resized, kept as NPY tiles with hashes.

Images are (height, width, channels) arrays of uint8. A resize by area takes each target pixel's mean
over the source rectangle it covers, parts of pixels included, from an integral image. A difference
hash compares neighbours in each row of a 9 x 8 grey tile: 64 bits.
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
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, bound_batches, tidied

#: An image row of 64 RGB pixels.
ROW_BYTES = 192
TILE = 16
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three."""
    h, w, c = image.shape
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[c], w, h) + image.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with up to 8 bits a sample, scaled to 0..255 where the maximum is another."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    n, at, head = kind[1] - 48, 2, []
    for _ in range(2 if n in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("a Netpbm header is cut off")
        head.append(int(m[1]))
        at = m.end()
    w, h, top, c = head[0], head[1], head[2] if len(head) > 2 else 1, 3 if n in (3, 6) else 1
    if not 0 < top < 256 or w < 1 or h < 1:
        raise ValueError("Netpbm images of 1 to 8 bits are read")
    if n == 1:
        flat = np.frombuffer(bytes(x for x in re.sub(rb"#[^\n]*\n", b"", data[at:]) if x in b"01"), np.uint8) - 48
    elif n < 4:
        flat = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[: w * h * c], dtype=np.int64)
    elif n == 4:
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: (w + 7) // 8 * h]
        flat = np.unpackbits(raw.reshape(h, -1), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8, offset=at + 1)
    if flat.size < w * h * c:
        raise ValueError("a Netpbm image is cut off")
    flat = flat[: w * h * c]
    if n in (1, 4):
        flat = 255 * (1 - flat.astype(np.uint8))
    elif top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape(h, w, c)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit rows from bottom to top, padded to 4 bytes."""
    h, w, _ = image.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = np.broadcast_to(image, (h, w, 3))[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, in either row order."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    at, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    if packed or bits not in (8, 24, 32) or w < 1 or not h:
        raise ValueError("plain BMP images of 8, 24 or 32 bits are read")
    line, up = (w * bits // 8 + 3) // 4 * 4, h > 0
    raw = np.frombuffer(data, np.uint8, offset=at)
    if raw.size < line * abs(h):
        raise ValueError("a BMP image is cut off")
    rows = raw[: line * abs(h)].reshape(abs(h), line)[:: -1 if up else 1, : w * bits // 8]
    if bits == 8:
        table = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)
        return table[rows][:, :, 2::-1].copy()
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means as float64, from an integral image that is kept only at the rows which borders need."""
    h, w, c = image.shape

    def borders(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The m + 1 borders of n pixels: the pixel that each lies in, and how far."""
        edge = np.arange(m + 1) * (n / m)
        lo = np.minimum(edge.astype(int), n - 1)
        return lo, edge - lo

    lo, part = borders(h, height)
    above = np.zeros((height + 1, w, c))  # sums of all rows above a border's, one band of rows at a time
    for j in range(1, height + 1):
        above[j] = above[j - 1] + image[lo[j - 1] : lo[j]].sum(0, dtype=np.int64)
    rows = np.diff(above + part[:, None, None] * image[lo], axis=0)
    total = np.zeros((height, w + 1, c))
    np.cumsum(rows, axis=1, out=total[:, 1:])
    lo, part = borders(w, width)
    part = part[None, :, None]
    cells = np.diff(total[:, lo] * (1 - part) + total[:, lo + 1] * part, axis=1)
    return cells / (h / height * w / width)


def grey(image: np.ndarray) -> np.ndarray:
    """Rec. 601 luma as one channel."""
    return image if image.shape[2] == 1 else (image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a pixel of the 9 x 8 luma tile darker than its right neighbour (after rounding to 1/256)?"""
    tile = np.round(grey(resize_area(image, 8, 9))[:, :, 0] * 256)
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image as a size x size uint8 array in NPY format."""
    out = io.BytesIO()
    np.save(out, np.round(resize_area(image, size, size)).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def text_media(docs: DataFrame, form: str = "netpbm", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with blanks to rows of 64 RGB pixels, as an image.

    A null or empty text is one row of blanks with no bytes. A text of any length is one image. Repeated
    rows and null doc_ids are rows of their own; other columns have no effect. An empty table gives an
    empty table.
    """
    to = {"netpbm": encode_netpbm, "bmp": encode_bmp}[form]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                data = [x or b"" for x in part.column(1).to_pylist()]
                full = [x + b" " * (-len(x) % ROW_BYTES if x else ROW_BYTES) for x in data]
                media = [to(np.frombuffer(x, np.uint8).reshape(-1, ROW_BYTES // 3, 3)) for x in full]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.encode(text, "UTF-8").alias("data")).mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads doc_id, n_bytes, media and adds digests of payload and media, the NPY tile and the difference hash.

    Equal media give equal features; damaged or null media raise a ValueError. The memory used is a small
    multiple of the longest image.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows = []
                for stored in part.column(2).to_pylist():
                    if stored is None:
                        raise ValueError("a row without media")
                    image = decode(stored)
                    payload = image.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), npy_tile(image), difference_hash(image)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile_npy", "feature"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile_npy binary, feature string")


def op4_media(spark, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "media")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text_media(docs).write.option("compression", "zstd").parquet(work.path("media"))
    stored = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(work.path("media"))
    return media_features(stored)

"""Media columns: Netpbm and BMP files in a binary column, decoded to numpy arrays.

``decode`` reads PBM, PGM, PPM (plain and raw, 8- and 16-bit) and uncompressed BMP
(1, 4, 8 bits with palette, 16, 24, 32 bits, also with channel masks; bottom-up and
top-down).  ``area_resize``
averages exactly over fractional boxes by an integral image, so its cost does not
depend on the scale.  ``features`` writes the resized grey tile as NPY bytes and a
64-bit difference hash of it.

Text can be stored as media without loss: bytes as samples of an RGB picture whose
rows hold ``ROW`` bytes, padded with 255 to whole rows.

Cases: null or empty text is one row of padding; equal texts give equal bytes and
features; a media column's undecodable or null value, and a picture without a row or a
column, gives null features and an ``error``; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_and_text, nothing_held, rows_of, small_batches, stored

#: Bytes of a stored row: 192 pixels of three samples.
ROW = 576
#: Height and width of a tile.
TILE = (32, 32)


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    fields, at = [], 2
    need = 2 if kind in (1, 4) else 3
    while len(fields) < need:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields[0], fields[1], fields[2] if need == 3 else 1
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise ValueError("the picture has no samples, or they have no range")
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array([int(bytes([b])) for b in body if b in b"01"] if kind == 1 else list(map(int, body.split())), np.uint16)
    elif kind == 4:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        values = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
    if len(values) < count:
        raise ValueError("samples are missing")
    if kind in (1, 4):
        values = 1 - values  # 1 is black
    image = values[:count].reshape(height, width, channels)
    if most in (255, 65535) or kind in (1, 4):
        scale = 255 if kind in (1, 4) else 1
        return (image * scale).astype(np.uint16 if most > 255 else np.uint8)
    top = 65535 if most > 255 else 255
    return ((image.astype(np.uint32) * top + most // 2) // most).astype(np.uint16 if most > 255 else np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or packing == 3 and depth not in (16, 32):
        raise ValueError("this kind of BMP is not supported")
    if width < 1 or height == 0:
        raise ValueError("the picture has no samples")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if depth <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        bits = np.unpackbits(body, axis=1).reshape(rows, -1, depth)
        places = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)[:, :width]
        image = palette[places]
    elif packing == 3 or depth == 16:  # masks of red, green and blue, if not five bits each
        values = np.ascontiguousarray(body[:, : width * depth // 8]).view(f"<u{depth // 8}").astype(np.int64)
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        image = np.stack([_channel(values, mask) for mask in masks], axis=2)
    else:
        image = body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    return image[::-1] if height > 0 else image


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """The masked bits of each value as 0 .. 255; 0 without a mask."""
    if mask == 0:
        return np.zeros(values.shape, np.uint8)
    low = mask & -mask
    top = mask // low
    return (((values & mask) // low * 255 + top // 2) // top).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels, 8- or 16-bit samples."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Mean of the channels as 0 .. 255."""
    top = 257.0 if image.dtype == np.uint16 else 1.0
    return image.mean(axis=2) / top


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's box, borders counted by the part inside."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(np.floor(edges).astype(int), table.shape[axis] - 2)
        part = edges - low
        shape = [-1 if i == axis else 1 for i in range(2)]
        return table.take(low, axis) * (1 - part.reshape(shape)) + table.take(low + 1, axis) * part.reshape(shape)

    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    sums = np.diff(np.diff(at(x, 1, at(y, 0, total)), axis=0), axis=1)
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 area means is below its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def features(data: bytes) -> tuple[np.ndarray, bytes, str]:
    """Decoded image, NPY bytes of its grey tile, difference hash."""
    image = decode(data)
    flat = grey(image)
    tile = np.clip(np.rint(area_resize(flat, *TILE)), 0, 255).astype(np.uint8)
    return image, npy(tile), difference_hash(flat)


def media_features(media: DataFrame, key: str = "id", column: str = "media") -> DataFrame:
    """``id, height, width, channels, tile, dhash, error`` of each row of a binary media column."""
    small_batches(media.sparkSession)
    out = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            rows = []
            for i, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    image, tile, bits = features(data or b"")
                    rows.append((i, *image.shape, tile, bits, None))
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    rows.append((i, None, None, None, None, None, str(e)[:200]))
            yield rows_of(out, {f.name: [r[k] for r in rows] for k, f in enumerate(out)})

    chosen = media.select(F.col(key).cast("long").alias("id"), F.col(column).alias("media"))
    return chosen.mapInArrow(run, "id long, height int, width int, channels int, tile binary, dhash string, error string")


def text_as_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: the text's bytes as a PPM, or a BMP where the padded text has an odd number of rows."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                padded = data + b"\xff" * ((-len(data)) % ROW if data else ROW)
                image = np.frombuffer(padded, np.uint8).reshape(-1, ROW // 3, 3)
                rows.append((doc_id, len(data), (encode_bmp if len(image) % 2 else encode_ppm)(image)))
            yield rows_of(out, {f.name: [r[k] for r in rows] for k, f in enumerate(out)})

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_TILES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string"
_TILE_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tile", pa.binary()), ("dhash", pa.string())])


def stored_text_tiles(docs: DataFrame) -> DataFrame:
    """Store each text as media in a table, read the stored bytes back, digest what they hold, and write each
    picture's NPY tile and difference hash to a second table, which is returned."""
    written = stored(text_as_media(docs), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                image, tile, bits = features(data)
                payload = image.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), tile, bits))
            yield rows_of(_TILE_ROWS, {f.name: [r[k] for r in rows] for k, f in enumerate(_TILE_ROWS)})

    return stored(written.mapInArrow(run, _TILES), "tiles")


def stored_text_digests(docs: DataFrame) -> DataFrame:
    """The rows of ``stored_text_tiles``, of which ``feature`` is the difference hash and the checksum of the stored NPY tile."""
    tiles = stored_text_tiles(docs)
    feature = F.concat("dhash", F.lit(":"), F.lower(F.lpad(F.hex(F.crc32("tile")), 8, "0")))
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))

"""Whether an image file is whole, without a decoder.

PNG: every chunk has its length and its checksum, the header comes first and the end
last, and the pixel data unpack to the size that the header gives.  JPEG: every segment
lies within the file, there is a frame before the scans, and the file goes on to the end
marker.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# --- Fixed values of the two formats. ---
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by PNG colour type
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
ALONE = {0x01, *range(0xD0, 0xD8)}  # markers without a segment
SCAN, END = 0xDA, 0xD9
# --- End of fixed values. ---


def png_is_whole(data: bytes) -> bool:
    at, kinds, packed, wanted = len(PNG), [], zlib.decompressobj(), 0
    got = 0
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data) or zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return False
        body = data[at + 8 : at + 8 + size]
        if not kinds:
            if kind != b"IHDR" or size != 13:
                return False
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if not width or not height or colour not in CHANNELS:
                return False
            wanted = -1 if laced else height * (1 + (width * depth * CHANNELS[colour] + 7) // 8)
        elif kind == b"IDAT":
            try:
                while body:  # a piece at a time, so that a packed bomb isn't held
                    got += len(packed.decompress(body, 1 << 20))
                    body = packed.unconsumed_tail
            except zlib.error:
                return False
        kinds.append(kind)
        at += 12 + size
        if kind == b"IEND":
            return b"IDAT" in kinds and packed.eof and wanted in (-1, got)
    return False


def jpeg_is_whole(data: bytes) -> bool:
    at, frame, scanned = 2, False, False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return False
        kind = data[at + 1]
        if kind == 0xFF:  # filler
            at += 1
        elif kind == END:
            return frame and scanned
        elif kind in ALONE:
            at += 2
        else:
            if at + 4 > len(data):
                return False
            size = struct.unpack_from(">H", data, at + 2)[0]
            if size < 2 or at + 2 + size > len(data) or kind == 0:
                return False
            frame |= kind in FRAMES
            at += 2 + size
            if kind == SCAN:
                if not frame:
                    return False
                scanned = True
                while True:  # coded data: up to a marker that isn't a stuffed byte or a restart
                    at = data.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(data):
                        return False
                    if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                        at += 2
                    elif data[at + 1] == 0xFF:
                        at += 1
                    else:
                        break
    return False


def is_whole(data: bytes | None) -> bool | None:
    """Null for null; false for what is neither PNG nor JPEG."""
    if data is None:
        return None
    return png_is_whole(data) if data.startswith(PNG) else jpeg_is_whole(data) if data.startswith(JPEG) else False


def _keep_whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):  # contents are large
            some = batch.slice(k, 64)
            yield some.filter(pa.array([bool(is_whole(x.as_py())) for x in some.column(column)], pa.bool_()))


def decodable(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose image in the column ``content`` is whole; null, empty, cut and damaged ones go."""
    from functools import partial

    return df.mapInArrow(partial(_keep_whole, column=content), df.schema)


def png(width: int, rows: list[bytes]) -> bytes:
    """A grey image of eight bits."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")

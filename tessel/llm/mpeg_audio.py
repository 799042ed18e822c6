"""MPEG audio column: resynchronise frame headers, read tags and variable-bitrate tables, verify checksums.

encode() stores a payload losslessly as an MPEG-1 Layer III stream of silent mono frames at 48 kHz, whose ancillary
bytes hold 192 payload bytes each, behind an ID3v2 tag and a Xing table frame. parse() accepts MPEG-1, 2 and 2.5 streams of Layers I, II
and III, of one rate or many: it finds the frames, skips tags and junk, reads Xing, Info and VBRI tables with their seek points, and
checks the CRC-16 of Layer III frames (in the other layers the checksum covers bits that depend on the allocation; there it is not checked).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, bounded_batches, lean, named, slices, utf8

UNIT = 192
# fixed values: MPEG audio bit rates (kbit/s) by version 1 or 2 and the header's layer bits (3: Layer I, 2: II, 1: III), sampling rates (Hz) by version bits
_KBITS = {
    (1, 3): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, 0],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 0],
    (1, 1): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0],
    (2, 3): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, 0],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0],
    (2, 1): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0],
}
_RATES = {3: [44100, 48000, 32000, 0], 2: [22050, 24000, 16000, 0], 0: [11025, 12000, 8000, 0], 1: [0, 0, 0, 0]}
_ALL_LAYERS = (1, 2, 3)

#: MPEG-1 Layer III with CRC, 80 kbit/s, 48 kHz, mono: 240 bytes a frame.
_HEADER = bytes([0xFF, 0xFA, 0x64, 0xC0])
_FRAME, _SIDE, _BODY = 240, 17, 4 + 2 + 17


def crc16(data: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    crc = np.full(len(data), 0xFFFF, np.uint16)
    for k in range(data.shape[1]):
        crc = (crc << np.uint16(8)) ^ _CRC_TABLE[(crc >> np.uint16(8)) ^ data[:, k]]
    return crc


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_CRC_TABLE = _crc_table()


def _silent_frames(n: int) -> np.ndarray:
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, np.uint8)
    covered = np.zeros((1, 2 + _SIDE), np.uint8)
    covered[0, :2] = np.frombuffer(_HEADER[2:], np.uint8)
    crc = int(crc16(covered)[0])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    return frames


def encode(payload: bytes) -> bytes:
    """Tag, table frame and one frame for each UNIT bytes of payload, whose length must be a positive multiple of it."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes, got {len(payload)}")
    n = len(payload) // UNIT
    frames = _silent_frames(n + 1)
    frames[1:, _BODY : _BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    stream = _FRAME * (n + 1)
    toc = bytes(min(255, (k * 256) // 100) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, stream) + toc
    frames[0, _BODY : _BODY + len(table)] = np.frombuffer(table, np.uint8)
    body = b"TSSE" + struct.pack(">IH", 8, 0) + b"\x03payload"
    size = bytes((len(body) >> s) & 127 for s in (21, 14, 7, 0))
    return b"ID3\x04\x00\x00" + size + body + frames.tobytes()


@dataclass
class Parsed:
    """What parse() found. samples: by sampling rate. seek_points: the table's, as places in the stream."""

    offsets: np.ndarray
    sizes: np.ndarray
    samples: dict[int, int]
    tag: str
    table_frames: int | None
    table_bytes: int | None
    crc_checked: int
    crc_bad: int
    skipped: int
    table_at: int | None
    seek_points: list[int]

    @property
    def duration(self) -> tuple[int, int]:
        """Exact seconds as a reduced fraction."""
        return sum((Fraction(n, rate) for rate, n in self.samples.items()), Fraction()).as_integer_ratio()


def header(h: bytes, layers: tuple[int, ...] = (1,)) -> tuple[int, int, int, bool, int] | None:
    """(frame bytes, samples, rate, has CRC, side bytes: 0 but for Layer III) of a header of the given layers (header bits, 1 is Layer III), or None."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = (h[1] >> 3) & 3, (h[1] >> 1) & 3
    rate = _RATES[version][(h[2] >> 2) & 3]
    if layer not in layers or not rate:
        return None
    first = version == 3
    kbits = _KBITS[1 if first else 2, layer][h[2] >> 4]
    if not kbits:
        return None
    pad, mono = (h[2] >> 1) & 1, h[3] >> 6 == 3
    if layer == 3:
        return (12 * kbits * 1000 // rate + pad) * 4, 384, rate, not h[1] & 1, 0
    samples = 1152 if first or layer == 2 else 576
    side = 0 if layer == 2 else (17 if mono else 32) if first else (9 if mono else 17)
    return samples // 8 * kbits * 1000 // rate + pad, samples, rate, not h[1] & 1, side


def _confirmed(stream: bytes, at: int, end: int) -> bool:
    """A frame at this place that ends the stream or has another one of its version, layer and rate behind it."""
    found = header(stream[at : at + 4], _ALL_LAYERS)
    if found is None or (after := at + found[0]) > end:
        return False
    following = header(stream[after : after + 4], _ALL_LAYERS) if after + 4 <= end else None
    return after + 4 > end or following is not None and following[2] == found[2] and not (stream[after + 1] ^ stream[at + 1]) & 0x1E


def _tables(stream: bytes, at: int, side: int, has_crc: bool) -> tuple[int | None, int | None, list[int]] | None:
    """(frames, bytes, seek points) of the variable-bitrate table in the frame at this place, or None."""
    p = at + 4 + 2 * has_crc + side
    if side and stream[p : p + 4] in (b"Xing", b"Info"):
        (flags,) = struct.unpack(">I", stream[p + 4 : p + 8])
        p += 8
        counts: list[int | None] = [None, None]
        for k in (0, 1):
            if flags >> k & 1:
                (counts[k],) = struct.unpack(">I", stream[p : p + 4])
                p += 4
        points = [at + x * counts[1] // 256 for x in stream[p : p + 100]] if flags & 4 and counts[1] else []
        return counts[0], counts[1], points
    p = at + 36
    if stream[p : p + 4] == b"VBRI":
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", stream[p + 10 : p + 26])
        steps = [int.from_bytes(stream[p + 26 + width * k : p + 26 + width * (k + 1)], "big") * scale for k in range(entries)]
        return frames, size, [at + x for x in accumulate(steps, initial=0)]
    return None


def parse(stream: bytes) -> Parsed:
    """Find every frame.

    After a gap, and at the start, a header counts if its frame ends the stream or a header of the same kind follows it. Behind a frame
    a header counts even without one, unless a frame that is confirmed in this way begins inside it: then the header is junk, or its frame lost bytes.
    """
    n, at, skipped, tag = len(stream), 0, 0, ""
    while stream[at : at + 3] == b"ID3" and at + 10 <= n:
        s = stream[at + 6 : at + 10]
        tag = f"id3v2.{stream[at + 3]}"
        at += 10 + (s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3])
    end = n
    if n - at >= 128 and stream[n - 128 : n - 125] == b"TAG":
        end, tag = n - 128, (tag + "+" if tag else "") + "id3v1"
    data = np.frombuffer(stream, np.uint8)
    offsets, sizes, samples, bad, checked = [], [], {}, 0, 0
    table: tuple[int | None, int | None, list[int]] | None = None
    table_at = None
    synced = False

    def inside(a: int, b: int) -> bool:
        """Whether a confirmed frame begins after a and before b."""
        while (a := stream.find(b"\xff", a + 1, b)) >= 0:
            if _confirmed(stream, a, end):
                return True
        return False

    while at + 4 <= end:
        found = header(stream[at : at + 4], _ALL_LAYERS)
        run = 0
        if found and at + found[0] <= end and (synced or _confirmed(stream, at, end)):
            # a run of frames with the same header is taken at once; each but the last has a header behind it
            size, per, hz, has_crc, side = found
            grid = data[at : at + (end - at) // size * size].reshape(-1, size)
            same = (grid[:, :4] == grid[0, :4]).all(1)
            run = int(len(same) if same.all() else np.argmin(same))
            last = at + (run - 1) * size
            if not _confirmed(stream, last, end) and header(stream[last + size : last + size + 4], _ALL_LAYERS) is None and inside(last, last + size):
                run -= 1
        if not run:
            nxt = stream.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at, synced = nxt, False
            continue
        grid = grid[:run]
        if has_crc and side and size >= 6 + side:
            wrong = crc16(np.concatenate([grid[:, 2:4], grid[:, 6 : 6 + side]], 1)) != (grid[:, 4].astype(np.uint16) << np.uint16(8) | grid[:, 5])
            bad, checked = bad + int(wrong.sum()), checked + run
        offs = at + size * np.arange(run, dtype=np.int64)
        if not offsets and (table := _tables(stream, at, side, has_crc)):
            table_at, offs = at, offs[1:]
        offsets.append(offs)
        sizes.append(np.full(len(offs), size))
        samples[hz] = samples.get(hz, 0) + per * len(offs)
        at, synced = at + run * size, True
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    frames, size, points = table or (None, None, [])
    return Parsed(join(offsets), join(sizes), samples, tag, frames, size, checked, bad, skipped + max(0, end - at), table_at, points)


def payload_of(stream: bytes, parsed: Parsed) -> bytes:
    """What encode() put in, read from the frames that parse() found."""
    at = parsed.offsets[:, None] + np.arange(_BODY, _BODY + UNIT)
    return np.frombuffer(stream, np.uint8)[at].tobytes()


SCHEMA = (
    "row_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tag string, frames long, table_frames long, "
    "duration_num long, duration_den long, crc_checked long, crc_bad long, skipped long{more}"
)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text as MPEG audio, read the stored bytes back and describe them.

    The text's UTF-8 bytes (null: none) are padded with spaces to a positive multiple of 192. With keep_media the stored bytes
    and the seek offset of each frame are columns too (media binary, seek_offsets array<long>), else only the offsets' CRC is.
    Equal texts give equal values, so repeated rows do; an empty text is one frame of spaces, a very long one as many frames as it takes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = named(docs, row_id=id_col, text=text_col)
    kind = docs.schema["row_id"].dataType.simpleString()
    more = ", seek_crc32 long" + (", media binary, seek_offsets array<long>" if keep_media else "")
    names = [x.split()[0] for x in (SCHEMA.format(id=kind, more=more)).split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw = data.tobytes()
            for i, j in slices(offs, SLICE_BYTES):
                cols: list[list] = [[] for _ in names[1:]]
                for k in range(i, j):
                    text = raw[offs[k] : offs[k + 1]]
                    pad = -len(text) % UNIT or (0 if text else UNIT)
                    stored = encode(text + b" " * pad)
                    p = parse(stored)
                    back = payload_of(stored, p)
                    num, den = p.duration
                    row = [len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), p.tag, len(p.offsets), p.table_frames, num, den, p.crc_checked, p.crc_bad, p.skipped, zlib.crc32(p.offsets.tobytes())]
                    for col, v in zip(cols, row + [stored, p.offsets] if keep_media else row, strict=True):
                        col.append(v)
                kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "tag": pa.string(), "media": pa.binary(), "seek_offsets": pa.list_(pa.int64())}
                arrays = [batch.column(0).slice(i, j - i), *[pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names[1:], cols, strict=True)]]
                schema = schema or pa.schema([pa.field(n, a.type) for n, a in zip(names, arrays, strict=True)])
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.mapInArrow(run, SCHEMA.format(id=kind, more=more)).withColumnRenamed("row_id", id_col)

"""AVI motion-JPEG columns: write, read back, decode and cut into shots (operator 3).

A payload becomes a video of 8 x 8 RGB frames, 192 samples each.  Frames are lossless JPEG (ITU-T T.81,
process 14, predictor 1), so the samples come back exactly.  The Huffman table gives the difference
category s a code of 9 - s bits; with its s further bits every sample then takes nine bits, which lets
whole frames be coded and decoded as arrays.  The reader follows the RIFF lists to the frame index and
decodes any frame by itself.  Frames whose table lacks that property are refused.

Shots end where the histogram difference of neighbouring frames passes a threshold taken from the
differences around it (their mean plus ``sigmas`` deviations, and ``least`` at the lowest).

Defined results: a null text is the empty text; a payload is padded with spaces to a positive multiple
of 192 bytes, a long one is a long video, written and read by one task; equal texts give equal media; of equal
histogram differences the first may start a shot; media that is null or no AVI file gives a row without payload and
clips, whose ``status`` says so ("null", "foreign"); a file cut off before its index or inside it, or whose index does
not name as many frames as the header, gives the whole frames that are there ("truncated"); frames with other tables give no payload ("refused"); an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIDE, UNIT, BITS, FPS, BINS = 8, 192, 9, 25, 16
CLIP = "struct<first_frame: int, n_frames: int, start_s: double, end_s: double>"


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit code of each difference -255..255, and the difference of each code."""
    diff = np.arange(-255, 256)
    category = np.ceil(np.log2(np.abs(diff) + 1)).astype(int)
    extra = np.where(diff > 0, diff, diff + (1 << category) - 1)
    code = (((1 << (BITS - category)) - 2) << category) | extra
    back = np.zeros(512, np.int16)
    back[code] = diff
    return code.astype(np.uint64), back


CODE_OF, DIFF_OF = _code_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HUFFMAN = bytes([0]) + bytes([1] * BITS + [0] * (16 - BITS)) + bytes(range(BITS - 1, -1, -1))
FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, HUFFMAN)
    + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 1, 0, 0]))
)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The payload, a multiple of 192 bytes, as an AVI file with an idx1 index."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE, 3).astype(np.int16)
    diff = px.copy()
    diff[:, :, 1:] -= px[:, :, :-1]
    diff[:, 1:, 0] -= px[:, :-1, 0]
    diff[:, 0, 0] -= 128
    code = CODE_OF[diff.reshape(-1, 8) + 255]
    packed = np.empty((len(code), 9), np.uint8)
    high = code[:, 7] >> np.uint64(8)
    for k in range(7):
        high |= code[:, k] << np.uint64(55 - 9 * k)
    packed[:, :8] = high.astype(">u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8] = code[:, 7] & np.uint64(255)
    scans, size = packed.tobytes(), UNIT * BITS // 8
    frames, index, at = [], [], 4
    for i in range(0, len(scans), size):
        frame = FRAME_HEAD + scans[i : i + size].replace(b"\xff", b"\xff\0") + b"\xff\xd9"
        frames.append(b"00dc" + struct.pack("<I", len(frame)) + frame + b"\0" * (len(frame) & 1))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(frames[-1])
    n = len(frames)
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", UNIT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield bytes(data[at : at + 4]), at + 8, size
        at += 8 + size + (size & 1)


class Avi:
    """An AVI file in memory, read through its index."""

    def __init__(self, data: bytes):
        self.data = view = memoryview(data)
        if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"AVI ":
            raise ValueError("not an AVI file")
        self.fps, movi, frames, self.index = float(FPS), 0, -1, np.zeros((0, 4), np.uint32)
        for name, at, size in _chunks(view, 12, len(view)):
            kind = bytes(view[at : at + 4]) if name == b"LIST" else b""
            if kind == b"hdrl":
                found = {n: a for n, a, m in _chunks(view, at + 4, min(at + size, len(view))) if a + m <= len(view)}
                if b"avih" in found:
                    self.fps = 1e6 / (int.from_bytes(view[found[b"avih"] : found[b"avih"] + 4], "little") or 1e6 / FPS)
                    frames = int.from_bytes(view[found[b"avih"] + 16 : found[b"avih"] + 20], "little")
            elif kind == b"movi":
                movi = at
            elif name == b"idx1" and at + size <= len(view) and size % 16 == 0:
                self.index = np.frombuffer(view[at : at + size], "<u4").reshape(-1, 4)
        self.whole = movi > 0 and len(self.index) == frames > 0
        if self.whole:
            self.at = (self.index[:, 2].astype(np.int64) + movi + 8).tolist()
            self.sizes = self.index[:, 3].tolist()
        else:  # no index, or not all of it: walk the frames that are there
            found = [(at, size) for name, at, size in _chunks(view, movi + 4, len(view)) if name == b"00dc" and at + size <= len(view)] if movi else []
            self.at, self.sizes = [a for a, _ in found], [n for _, n in found]

    def samples(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Decoded frames first to last, as an array of frames x 192 samples."""
        head, scans = len(FRAME_HEAD), []
        for at, size in zip(self.at[first:last], self.sizes[first:last], strict=True):
            frame = bytes(self.data[at : at + size])
            if not frame.startswith(FRAME_HEAD) or not frame.endswith(b"\xff\xd9"):
                raise ValueError("not a frame with the nine-bit table")
            scans.append(frame[head:-2].replace(b"\xff\0", b"\xff"))
        packed = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 9)
        high = np.ascontiguousarray(packed[:, :8]).view(">u8").astype(np.uint64).ravel()
        code = np.empty((len(packed), 8), np.uint16)
        for k in range(7):
            code[:, k] = (high >> np.uint64(55 - 9 * k)) & np.uint64(511)
        code[:, 7] = ((high & np.uint64(1)) << np.uint64(8)) | packed[:, 8]
        diff = DIFF_OF[code].reshape(-1, SIDE, SIDE, 3)
        diff[:, 0, 0] += 128
        diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
        return np.cumsum(diff, axis=2).astype(np.uint8).reshape(-1, UNIT)


def histogram_steps(samples: np.ndarray) -> np.ndarray:
    """Half the sum of absolute differences of neighbouring frames' colour histograms, as a share of the samples."""
    n = len(samples)
    cell = (samples >> 4).reshape(n, -1, 3) + np.array([0, BINS, 2 * BINS])
    cell = cell.reshape(n, -1) + np.arange(n)[:, None] * (3 * BINS)
    counts = np.bincount(cell.ravel(), minlength=n * 3 * BINS).reshape(n, -1)
    return np.abs(np.diff(counts, axis=0)).sum(1) / (2 * UNIT)


def shot_starts(steps: np.ndarray, around: int = 12, sigmas: float = 2.0, least: float = 0.1, shortest: int = 4) -> list[int]:
    """First frames of the shots, 0 included."""
    n = len(steps)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (steps, steps * steps))
    low, high = np.maximum(np.arange(n) - around, 0), np.minimum(np.arange(n) + around + 1, n)
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - steps) / others
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - steps * steps) / others - mean * mean, 0))
    starts = [0]
    for i in np.flatnonzero(steps > np.maximum(mean + sigmas * spread, least)).tolist():
        if i + 1 - starts[-1] >= shortest:
            starts.append(i + 1)
    return starts


def encode_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes of the text and media, its AVI file."""
    kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j in slices(np.cumsum([0, *map(len, texts)])):
                media = [write_avi(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT))) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(map(len, texts[i:j]), pa.int64()), pa.array(media, pa.large_binary())], schema=kept)

    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Decode AVI columns: digests of what was read back, and the shots as an array of clips."""
    clip = pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("clips", pa.list_(clip)), ("status", pa.string())]
    kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *fields])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5 + ([], "null")
        told = len(data), hashlib.sha256(data).hexdigest()
        try:
            video = Avi(data)
        except (ValueError, KeyError, ZeroDivisionError):
            return (None,) * 3 + (*told, [], "foreign")
        try:
            samples, status = video.samples(), "whole" if video.whole else "truncated"
        except ValueError:
            return (None,) * 3 + (*told, [], "refused")
        payload = samples.tobytes()
        starts = shot_starts(histogram_steps(samples)) if len(samples) else [0]
        ends = [*starts[1:], len(samples)]
        clips = [{"first_frame": a, "n_frames": b - a, "start_s": a / video.fps, "end_s": b / video.fps} for a, b in zip(starts, ends, strict=True)]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *told, clips if len(samples) else [], status

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column("media")]
            columns = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("n_bytes").cast(pa.int64()), *columns], schema=kept)

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<{CLIP}>, status string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def clip_rows(read: DataFrame) -> DataFrame:
    """One timed row for each clip."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")

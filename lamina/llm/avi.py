"""Media columns: AVI motion-JPEG files in binary columns, cut into timed clips.

Reading follows the RIFF structure: headers give the frame rate, the ``idx1`` index (or, without one, a
walk over the ``movi`` list) gives the frames, and :mod:`lamina.llm.jpeg` decodes them. A shot starts where
the histogram difference to the frame before exceeds both a floor and the mean plus ``SIGMAS`` standard
deviations of the differences so far in the shot (last ``MEMORY`` of them). :func:`clips` yields one row per
shot with its times; the feature string of :func:`media_features` lists the same clips as
``first-last@start-end`` (frames, seconds).

Writing stores any bytes without loss as 8-bit grey samples, one byte a sample, in frames 64 samples wide and
at most ``HEIGHT`` high; a short last frame is filled up with zeros and the length is kept in the stream's ``strd``
chunk.

Defined results: NULL media give NULL, damaged media give NULL features and no clips; NULL and empty texts
are stored as 64 zero bytes. Equal inputs give equal files and features. Rows are independent, so repeated
rows repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import jpeg

WIDTH, HEIGHT, RATE, UNIT = 64, 16, 25, 64
BINS, FLOOR, SIGMAS, MEMORY = 16, 0.25, 3.0, 12


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(parts))


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold ``payload`` (a positive multiple of 64 bytes) as samples."""
    rows = len(payload) // WIDTH
    height = min(HEIGHT, rows)
    count = -(-rows // height)
    samples = np.frombuffer(payload + b"\0" * (count * height * WIDTH - len(payload)), dtype=np.uint8).reshape(count, height, WIDTH)
    frames = jpeg.encode_lossless(samples)
    biggest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, biggest * RATE, 0, 0x10, count, 0, 1, biggest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, RATE, 0, count, biggest, -1, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    header = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf), _chunk(b"strd", struct.pack("<Q", len(payload)))))
    return _chunk(b"RIFF", b"AVI " + header + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Video:
    """Frames per second, the frames' JPEG bytes in order, and the stored payload's length if there is one."""

    rate: float
    frames: list[bytes]
    payload_bytes: int | None

    def decoded(self) -> list[np.ndarray]:
        return [jpeg.decode(f) for f in self.frames]


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("chunk beyond the file")
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> Video:
    """Parse an AVI file; ValueError if its structure is broken."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, length, movi, index = float(RATE), None, None, None

    def headers(at: int, end: int) -> None:
        nonlocal rate, length
        for name, begin, size in _walk(data, at, end):
            if name == b"LIST" and data[begin : begin + 4] == b"strl":
                headers(begin + 4, begin + size)
            elif name == b"strh" and data[begin : begin + 4] == b"vids":
                scale, per = struct.unpack_from("<II", data, begin + 20)
                rate = per / scale if scale and per else rate
            elif name == b"strd" and size >= 8:
                length = struct.unpack_from("<Q", data, begin)[0]

    for name, begin, size in _walk(data, 12, len(data)):
        if name == b"LIST" and data[begin : begin + 4] == b"hdrl":
            headers(begin + 4, begin + size)
        elif name == b"LIST" and data[begin : begin + 4] == b"movi":
            movi = (begin, size)
        elif name == b"idx1":
            index = (begin, size)
    if movi is None:
        raise ValueError("no frames")
    frames = []
    if index:
        entries = list(struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]))
        # offsets count from the list's type in most files, from the file's start in some
        base = movi[0] if entries and data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        for name, _, at, size in entries:
            if name[2:] in (b"dc", b"db"):
                if data[base + at : base + at + 4] != name or base + at + 8 + size > len(data):
                    raise ValueError("index beyond the frames")
                frames.append(data[base + at + 8 : base + at + 8 + size])
    else:
        frames = [data[begin : begin + size] for name, begin, size in _walk(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")]
    return Video(rate, frames, length)


def payload_of(video: Video, frames: list[np.ndarray]) -> bytes:
    raw = b"".join(f.tobytes() for f in frames)
    return raw if video.payload_bytes is None else raw[: video.payload_bytes]


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    if not frames:
        return []
    histograms = np.stack([np.bincount(f.ravel() >> 4, minlength=BINS) / max(f.size, 1) for f in frames])
    moves = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    out, begin, past = [], 0, []
    for k, move in enumerate(moves.tolist(), start=1):
        limit = max(FLOOR, (np.mean(past) + SIGMAS * np.std(past)) if past else 0.0)
        if move > limit:
            out.append((begin, k - 1))
            begin, past = k, []
        else:
            past = [*past, move][-MEMORY:]
    return [*out, (begin, len(frames) - 1)]


_FEATURES = T.StructType(
    [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)
_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


@F.arrow_udf(T.BinaryType())
def _store(texts: pa.Array) -> pa.Array:
    return pa.array([write_avi(padded((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in texts], type=pa.binary())


def features(media: bytes | None) -> tuple | None:
    if media is None:
        return None
    try:
        video = read_avi(media)
        frames = video.decoded()
    except (ValueError, KeyError, IndexError, struct.error):
        return None
    payload = payload_of(video, frames)
    cut = shots(frames)
    timed = ",".join(f"{a}-{b}@{a / video.rate:.2f}-{(b + 1) / video.rate:.2f}" for a, b in cut)
    mean = sum(int(f.sum(dtype=np.int64)) for f in frames) / max(sum(f.size for f in frames), 1)
    text = f"frames={len(frames)};shots={len(cut)};mean={mean:.3f};clips={timed}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), text


@F.arrow_udf(_FEATURES)
def _features(media: pa.Array) -> pa.Array:
    rows = [features(m.as_py()) for m in media]
    columns = [pa.array([None if r is None else r[k] for r in rows], type=kind) for k, kind in enumerate(_ARROW)]
    return pa.StructArray.from_arrays(columns, names=_FEATURES.names)


def media_column(text: Column) -> Column:
    """An AVI file holding the text's UTF-8 bytes."""
    return _store(text)


def media_features(media: Column) -> Column:
    """Struct of payload and media sizes and digests, and the feature string, read back from the file."""
    return _features(media)


def clips(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per shot: id, clip, first_frame, last_frame, start_s, end_s, mean luminance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    video = read_avi(media.as_py() or b"")
                    frames = video.decoded()
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                rows += [(key, n, a, b, a / video.rate, (b + 1) / video.rate, float(np.mean([f.mean() for f in frames[a : b + 1]]))) for n, (a, b) in enumerate(shots(frames))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [batch.schema.types[0], *[pa.int64()] * 3, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_luma"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, clip long, first_frame long, last_frame long, start_s double, end_s double, mean_luma double")

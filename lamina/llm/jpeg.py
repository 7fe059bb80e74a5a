"""JPEG intra frames: lossless coding of 8-bit grey samples, and decoding of lossless and baseline frames.

Lossless frames (SOF3, predictor 1) use one Huffman table whose code for a difference of s bits has 9 - s
bits, so every sample takes exactly nine bits; coding and decoding such a frame is array arithmetic. Frames
with other tables, and baseline DCT frames (SOF0, grey or colour, with restart intervals), are decoded bit by
bit. Formats: ITU-T T.81.
"""

from __future__ import annotations

import numpy as np

_SAMPLES = 9


def _code_of(difference: int) -> int:
    size = abs(difference).bit_length()
    prefix = (1 << (_SAMPLES - size)) - 2  # 8 - size ones and a zero
    extra = difference if difference >= 0 else difference + (1 << size) - 1
    return (prefix << size) | extra


_ENCODE = np.array([_code_of(d) for d in range(-255, 256)], dtype=np.uint16)
_DECODE = np.zeros(512, dtype=np.int16)
_DECODE[_ENCODE] = np.arange(-255, 256)
_COUNTS = bytes([1] * 9 + [0] * 7)
_VALUES = bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """JPEG files of uint8 frames (count, height, width); width * height must be a multiple of 8."""
    count, height, width = frames.shape
    x = frames.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    c = _ENCODE[diff + 255].reshape(count, -1, 8)
    packed = np.empty((*c.shape[:2], 9), dtype=np.uint8)
    packed[..., 0] = c[..., 0] >> 1
    for k in range(1, 8):
        packed[..., k] = ((c[..., k - 1] << (8 - k)) | (c[..., k] >> (k + 1))) & 255
    packed[..., 8] = c[..., 7] & 255
    head = b"\xff\xd8" + _segment(0xC3, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += _segment(0xC4, bytes([0]) + _COUNTS + _VALUES) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    return [head + frame.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for frame in packed]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff\xff\xff\xff", 0

    def peek16(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: list) -> int:
        length, value = table[self.peek16()] or (0, 0)
        if not length or self.at >= 8 * len(self.data):
            raise ValueError("bad Huffman code")
        self.at += length
        return value

    def extended(self, size: int) -> int:
        if not size:
            return 0
        value = self.peek16() >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def _table(counts: bytes, values: bytes) -> list:
    out: list = [None] * 65536
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [(length, values[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _zigzag() -> list[int]:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [8 * r + c for r, c in cells]


_ZIGZAG = _zigzag()
_k = np.arange(8)
_DCT = np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))


def decode(data: bytes) -> np.ndarray:
    """Luminance samples (height, width) of a lossless or baseline frame; ValueError if it cannot be read."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, raw, quant, frame, restart = 2, {}, {}, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                raw[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = [int.from_bytes(body[1 + wide * k : 1 + wide * (k + 1)], "big") for k in range(64)]
                body = body[1 + 64 * wide :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1, 0xC3):
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            frame = (marker, body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), parts)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("progressive and arithmetic frames are not intra frames of this format")
        elif marker == 0xDA:
            if frame is None or frame[1] != 8:
                raise ValueError("8-bit frame header expected before the scan")
            end = data.rfind(b"\xff\xd9")
            scan = data[at : end if end >= at else len(data)]
            return _lossless(scan, body, frame, raw, restart) if frame[0] == 0xC3 else _baseline(scan, body, frame, raw, quant, restart)
    raise ValueError("no scan")


def _lossless(scan: bytes, header: bytes, frame, raw, restart: int) -> np.ndarray:
    _, _, height, width, parts = frame
    predictor = header[1 + 2 * header[0]]
    if len(parts) != 1 or restart:
        raise ValueError("lossless frames have one component and no restarts here")
    counts, values = raw[header[2] >> 4]
    bits, n = scan.replace(b"\xff\x00", b"\xff"), height * width
    if predictor == 1 and counts == _COUNTS and values == _VALUES and n % 8 == 0 and len(bits) == n * 9 // 8:
        b = np.frombuffer(bits, dtype=np.uint8).reshape(-1, 9).astype(np.uint16)
        codes = np.empty((len(b), 8), dtype=np.uint16)
        for k in range(8):
            codes[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
        diff = _DECODE[codes].reshape(height, width)
        first = np.cumsum(diff[:, 0], dtype=np.int32) + 128
        diff = diff.astype(np.int32)
        diff[:, 0] = first
        return np.cumsum(diff, axis=1, dtype=np.int32).astype(np.uint8)
    reader, table, out = _Bits(bits), _table(counts, values), np.zeros((height, width), dtype=np.int64)
    for y in range(height):
        for x in range(width):
            left, up, corner = out[y, x - 1] if x else 0, out[y - 1, x] if y else 0, out[y - 1, x - 1] if x and y else 0
            if not x:
                guess = up if y else 128
            elif not y:
                guess = left
            else:
                guess = (0, left, up, corner, left + up - corner, left + ((up - corner) >> 1), up + ((left - corner) >> 1), (left + up) >> 1)[predictor]
            out[y, x] = (guess + reader.extended(reader.symbol(table))) & 255
    return out.astype(np.uint8)


def _baseline(scan: bytes, header: bytes, frame, raw, quant, restart: int) -> np.ndarray:
    _, _, height, width, parts = frame
    tables = {k: _table(*v) for k, v in raw.items()}
    uses = {header[1 + 2 * k]: header[2 + 2 * k] for k in range(header[0])}
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a lone component is not interleaved: its unit is one block
        parts, hmax, vmax = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    luma, (_, h0, v0, _) = parts[0][0], parts[0]
    plane = np.zeros((down * v0 * 8, across * h0 * 8))
    pieces, begin, k = [], 0, 0
    while k < len(scan) - 1:
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[begin:k])
            begin = k + 2
        k += 2 if scan[k] == 0xFF else 1
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, scan[begin:]]]
    step, unit = restart or across * down, 0
    for piece in pieces:
        reader, last = _Bits(piece), dict.fromkeys(uses, 0)
        for unit_now in range(unit, min(unit + step, across * down)):
            my, mx = divmod(unit_now, across)
            for name, h, v, q in parts:
                for by in range(v):
                    for bx in range(h):
                        block = np.zeros(64)
                        last[name] += reader.extended(reader.symbol(tables[uses[name] >> 4]))
                        block[0] = last[name] * quant[q][0]
                        at = 1
                        while at < 64:
                            symbol = reader.symbol(tables[0x10 | (uses[name] & 15)])
                            run, size = symbol >> 4, symbol & 15
                            if not size:
                                if run != 15:
                                    break
                                at += 16
                                continue
                            at += run
                            if at > 63:
                                raise ValueError("coefficient beyond its block")
                            block[_ZIGZAG[at]] = reader.extended(size) * quant[q][at]
                            at += 1
                        if name == luma:
                            y, x = 8 * (my * v + by), 8 * (mx * h + bx)
                            plane[y : y + 8, x : x + 8] = _DCT.T @ block.reshape(8, 8) @ _DCT + 128
        unit += step
    full = plane[: -(-height * v0 // vmax), : -(-width * h0 // hmax)]
    return np.clip(np.rint(full), 0, 255).astype(np.uint8)

"""Media columns: texts as lossless 8-bit FLAC streams, encoded and decoded in Arrow batches.

A stream has STREAMINFO with the PCM's MD5, a SEEKTABLE with a point every SEEK_FRAMES frames, and
frames of 192 samples whose subframe is a fixed or an adaptive linear predictor with Rice-coded
residuals. Work is vectorised over frames: the encoder writes all frames of a chunk at once, the
decoder follows one lane per seek point. Chunks bound the memory whatever a text's length. Streams of
other encoders, with any kind of subframe, are decoded frame by frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.session import materialize, ship_package

#: Samples of a frame, frames of a seek lane, and frames handled at once.
BLOCK, SEEK_FRAMES, CHUNK = 192, 8, 12_288
#: Of adaptive predictors: order, bits of a coefficient, and how far a prediction is shifted.
ORDER, PRECISION, SHIFT = 4, 8, 6
RATE = 8000
# Fixed values of the format: predictors of fixed order 0 to 4, and the CRC polynomials.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CRC8, CRC16 = 0x07, 0x8005


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    top, mask = np.uint32(1 << (bits - 1)), np.uint32((1 << bits) - 1)
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ np.uint32(poly), table << 1) & mask
    return table


_T8, _T16 = _crc_table(CRC8, 8), _crc_table(CRC16, 16)


def _crc8(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(at), np.uint32)
    for i in range(int(length.max(initial=0))):
        crc = np.where(i < length, _T8[crc ^ data[np.minimum(at + i, len(data) - 1)]], crc)
    return crc


def _crc16(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(at), np.uint32)
    least = int(length.min(initial=0)) if len(length) else 0
    for i in range(int(length.max(initial=0))):
        byte = data[at + i] if i < least else data[np.minimum(at + i, len(data) - 1)]
        new = ((crc << 8) & 0xFFFF) ^ _T16[(crc >> 8) ^ byte]
        crc = new if i < least else np.where(i < length, new, crc)
    return crc


def _number_bytes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes (n x 6) and their counts."""
    n = 1 + sum((number >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(number), 6), np.uint8)
    for size in range(1, 7):
        rows = n == size
        if not rows.any():
            continue
        v = number[rows]
        if size == 1:
            out[rows, 0] = v
            continue
        out[rows, 0] = ((0xFF << (7 - size)) & 0xFF) | (v >> (6 * (size - 1)))
        for j in range(1, size):
            out[rows, j] = 0x80 | ((v >> (6 * (size - 1 - j))) & 0x3F)
    return out, n


def _residuals(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """What is left of frames x (n x BLOCK) after prediction; the first columns stay unpredicted."""
    order = coefficients.shape[1]
    if not order:
        return x
    predicted = np.zeros((len(x), BLOCK - order), np.int32)
    for j in range(order):
        predicted += coefficients[:, j : j + 1] * x[:, order - 1 - j : BLOCK - 1 - j]
    out = x.copy()
    out[:, order:] -= predicted >> shift
    return out


def _adaptive(x: np.ndarray) -> np.ndarray:
    """Quantised predictors of order ORDER for each frame, by Levinson and Durbin's recursion."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : BLOCK - lag]) for lag in range(ORDER + 1)], 1)
    a, error = np.zeros((len(x), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / error
        before = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    return np.clip(np.rint(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def _encode_chunk(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of frames x (n x BLOCK, int32), and how many each has."""
    n, rows = len(x), np.arange(len(x))
    adaptive = _adaptive(x)
    options = [(o, np.tile(np.array(FIXED[o], np.int32), (n, 1)).reshape(n, o), 0) for o in range(3)] + [(ORDER, adaptive, SHIFT)]
    best, order, codes, param = np.full(n, 1 << 30, np.int64), np.zeros(n, np.int64), np.zeros((n, BLOCK), np.int32), np.zeros(n, np.int64)
    for o, c, shift in options:
        e = _residuals(x, c, shift)
        z = (e << 1) ^ (e >> 31)
        z[:, :o] = 0
        mean = np.maximum(z.sum(1) / (BLOCK - o), 1.0)
        k0 = np.clip(np.log2(mean).astype(np.int64), 0, 13)
        for k in (np.maximum(k0 - 1, 0), k0):
            bits = (z >> k[:, None].astype(np.int32)).sum(1) + (BLOCK - o) * (k + 1) + 8 * o + (9 + PRECISION * o if shift else 0)
            less = bits < best
            if less.any():
                best, order, param = np.where(less, bits, best), np.where(less, o, order), np.where(less, k, param)
                codes[less] = z[less]
    lpc = order == ORDER
    # Fields of a frame, as values and lengths in bits.
    name, name_bytes = _number_bytes(number)
    head = np.zeros((n, 11), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x14, 0x02)  # sync and fixed blocking, 192 samples at 8 kHz, mono of 8 bits
    head[:, 4:10] = name
    head_crc = _crc8(head.reshape(-1), rows * 11, 4 + name_bytes)
    fields = 4 + 6 + 1 + 1 + ORDER + 2 + ORDER + 1 + BLOCK + 2
    value, length = np.zeros((n, fields), np.int32), np.zeros((n, fields), np.int32)
    value[:, :10], length[:, :4] = head[:, :10], 8
    length[:, 4:10] = np.where(np.arange(6) < name_bytes[:, None], 8, 0)
    value[:, 10], length[:, 10] = head_crc, 8
    value[:, 11], length[:, 11] = np.where(lpc, 0x40 | ((ORDER - 1) << 1), (8 + order) << 1), 8
    warm = np.arange(ORDER) < order[:, None]
    value[:, 12:16], length[:, 12:16] = np.where(warm, x[:, :ORDER] & 0xFF, 0), np.where(warm, 8, 0)
    value[:, 16], length[:, 16] = np.where(lpc, PRECISION - 1, 0), np.where(lpc, 4, 0)
    value[:, 17], length[:, 17] = np.where(lpc, SHIFT, 0), np.where(lpc, 5, 0)
    value[:, 18:22] = np.where(lpc[:, None], adaptive & ((1 << PRECISION) - 1), 0)
    length[:, 18:22] = np.where(lpc, PRECISION, 0)[:, None]
    value[:, 22], length[:, 22] = param, 10  # Rice with parameters of 4 bits, one partition
    k = param[:, None].astype(np.int32)
    coded = np.arange(BLOCK) >= order[:, None]
    value[:, 23 : 23 + BLOCK] = np.where(coded, (codes & ((1 << k) - 1)) | (1 << k), 0)
    length[:, 23 : 23 + BLOCK] = np.where(coded, (codes >> k) + 1 + k, 0)
    pad = -length.sum(1) % 8
    length[:, -2], length[:, -1] = pad, 16
    end = np.cumsum(length.reshape(-1).astype(np.int64))
    bits = np.zeros(end[-1], np.uint8)
    flat = value.reshape(-1)
    for j in range(int(flat.max()).bit_length()):
        bits[end[np.flatnonzero((flat >> j) & 1)] - 1 - j] = 1
    data = np.packbits(bits)
    size = length.sum(1) // 8
    at = np.cumsum(size) - size
    crc = _crc16(data, at, size - 2)
    data[at + size - 2], data[at + size - 1] = crc >> 8, crc & 0xFF
    return data, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(frames) - frames
    number = np.arange(frames.sum()) - np.repeat(first, frames)
    signal = np.frombuffer(b"".join(payloads), np.uint8)
    parts, sizes = [], []
    for low in range(0, len(number), CHUNK):
        high = min(len(number), low + CHUNK)
        x = signal[low * BLOCK : high * BLOCK].reshape(-1, BLOCK).astype(np.int32) - 128
        data, size = _encode_chunk(x, number[low:high])
        parts.append(data)
        sizes.append(size)
    data, size = np.concatenate(parts).tobytes(), np.concatenate(sizes)
    ends = np.cumsum(size)
    out = []
    for i, payload in enumerate(payloads):
        low, high = first[i], first[i] + frames[i]
        begin = ends[low] - size[low]
        at = np.arange(low, high, SEEK_FRAMES)
        seek = np.zeros(len(at), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        seek["sample"], seek["offset"], seek["samples"] = number[at] * BLOCK, ends[at] - size[at] - begin, BLOCK
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
        info = BLOCK.to_bytes(2, "big") * 2 + int(size[low:high].min()).to_bytes(3, "big") + int(size[low:high].max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        table = seek.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + data[begin : ends[high - 1]])
    return out


class _Bits:
    """Big-endian bits of a buffer."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        wide = self.data.astype(np.int32)
        self.wide = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        bits = np.unpackbits(self.data)
        self.ones, self.before = np.flatnonzero(bits).astype(np.int32), np.cumsum(bits, dtype=np.int32) - bits

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n bits from each position, at most 17."""
        return (self.wide[at >> 3].astype(np.int64) >> (24 - (at & 7) - n)) & ((np.int64(1) << n) - 1)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """The position of the first set bit from each position on."""
        return self.ones[self.before[at]]


def _must(ok: np.ndarray, what: str) -> None:
    if not np.all(ok):
        raise ValueError(f"damaged FLAC stream: {what}")


def _decode_lanes(data: np.ndarray, at: np.ndarray, number: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Samples (lane, frame, BLOCK) of lanes that start at byte positions with these frame numbers."""
    bits, lanes = _Bits(data), len(at)
    depth = int(frames.max())
    e = np.zeros((lanes, depth, BLOCK), np.int32)
    order, shift = np.zeros((lanes, depth), np.int64), np.zeros((lanes, depth), np.int64)
    weights = np.zeros((lanes, depth, 4), np.int32)
    start = at.astype(np.int64).copy()
    for f in range(depth):
        live = np.flatnonzero(frames > f)
        s = start[live]
        raw = bits.data
        name, name_bytes = _number_bytes(number[live] + f)
        _must((raw[s] == 0xFF) & (raw[s + 1] == 0xF8) & (raw[s + 2] == 0x14) & (raw[s + 3] == 0x02), "frame header")
        for j in range(6):
            _must((j >= name_bytes) | (raw[np.minimum(s + 4 + j, len(raw) - 1)] == name[:, j]), "frame number")
        _must(_crc8(raw, s, 4 + name_bytes) == raw[s + 4 + name_bytes], "header checksum")
        pos = s + 5 + name_bytes
        kind = raw[pos].astype(np.int64) >> 1
        lpc = kind >= 32
        _must(lpc | ((kind >= 8) & (kind <= 12)), "subframe type")
        o = np.where(lpc, kind - 31, kind - 8)
        _must(o <= 4, "predictor order")
        pos = (pos + 1) * 8
        for j in range(4):  # samples without a prediction
            warm = j < o
            e[live, f, j] = np.where(warm, (bits.read(pos, 8) ^ 0x80) - 128, 0)
            pos = pos + 8 * warm
        w = np.zeros((len(live), 4), np.int64)
        for fixed, c in enumerate(FIXED):
            w[(~lpc) & (o == fixed), : len(c)] = c
        precision = np.where(lpc, bits.read(pos, 4) + 1, 0)
        pos = pos + 4 * lpc
        shift[live, f] = np.where(lpc, bits.read(pos, 5), 0)
        pos = pos + 5 * lpc
        for j in range(4):
            n = np.where(lpc & (j < o), precision, 0)
            v = bits.read(pos, n)
            w[:, j] = np.where(n > 0, v - ((v >> np.maximum(n - 1, 0)) << n), w[:, j])
            pos = pos + n
        weights[live, f], order[live, f] = w, o
        _must(bits.read(pos, 6) == 0, "residual coding")
        k = bits.read(pos + 6, 4)
        _must(k < 15, "Rice parameter")
        pos = pos + 10
        codes = np.zeros((BLOCK, len(live)), np.int32)
        pos, k = pos.astype(np.int32), k.astype(np.int32)
        mask, room, skip = (1 << k) - 1, 24 - k, k + 1
        for i in range(BLOCK):
            one = bits.unary(pos)
            at_rest = one + 1
            z = ((one - pos) << k) | ((bits.wide[at_rest >> 3] >> (room - (at_rest & 7))) & mask)
            if i < 4:
                coded = i >= o
                codes[i] = np.where(coded, z, 0)
                pos = np.where(coded, one + skip, pos)
            else:
                codes[i] = z
                pos = one + skip
        codes = (codes >> 1) ^ -(codes & 1)
        codes[:4] += e[live, f, :4].T  # a column has a sample or a residual
        e[live, f] = codes.T
        pos = pos.astype(np.int64)
        end = (pos + 7) >> 3
        _must(_crc16(raw, s, end - s) == (raw[end].astype(np.uint32) << 8 | raw[end + 1]), "frame checksum")
        start[live] = end + 2
    x, w, o, sh = e.reshape(-1, BLOCK).T.copy(), weights.reshape(-1, 4).T.astype(np.int32), order.reshape(-1), shift.reshape(-1).astype(np.int32)
    for i in range(1, BLOCK):
        predicted = sum(w[j] * x[i - 1 - j] for j in range(min(i, 4)))
        x[i] += np.where(i >= o, predicted >> sh, 0)
    return x.T.reshape(lanes, depth, BLOCK)


@dataclass
class Head:
    """What stands before the frames."""

    total: int
    channels: int
    depth: int
    md5: bytes
    seek: np.ndarray
    begin: int


_POINT = [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]


def parse(stream: bytes) -> Head:
    """The stream's properties, its seek points (none if it has no table) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, out = 4, False, Head(0, 0, 0, b"", np.zeros(0, _POINT), 0)
    while not last:
        if at + 4 > len(stream):
            raise ValueError("damaged FLAC stream: it ends too early")
        last, kind, size = stream[at] >= 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            out.total, out.depth, out.channels, out.md5 = packed & ((1 << 36) - 1), (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, block[18:34]
        elif kind == 3:
            points = np.frombuffer(block, _POINT)
            out.seek = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]  # others are placeholders
        at += 4 + size
    out.begin = at
    return out


class _Reader:
    """Bits of a frame, one field after the other."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def bits(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("damaged FLAC stream: it ends too early")
        found = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3]) >> (-end % 8) & ((1 << n) - 1)
        self.at = end
        return found

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.bits(1):
            n += 1
        return n


def _subframe(r: _Reader, n: int, depth: int) -> list[int]:
    """The samples of a subframe: constant, verbatim, of a fixed or of a linear predictor."""
    if r.bits(1):
        raise ValueError("damaged FLAC stream: subframe header")
    kind, wasted = r.bits(6), r.unary() + 1 if r.bits(1) else 0
    depth -= wasted
    if kind == 0:
        out = [r.signed(depth)] * n
    elif kind == 1:
        out = [r.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        if order > n:
            raise ValueError("damaged FLAC stream: predictor order")
        out, weights, shift = [r.signed(depth) for _ in range(order)], list(FIXED[order]) if kind < 32 else [], 0
        if kind >= 32:
            precision = r.bits(4) + 1
            if precision == 16:
                raise ValueError("damaged FLAC stream: precision")
            shift = r.signed(5)
            weights = [r.signed(precision) for _ in range(order)]
        for residual in _residual(r, n, order):
            predicted = sum(w * out[-1 - j] for j, w in enumerate(weights))
            out.append((predicted >> shift if shift >= 0 else predicted << -shift) + residual)
    else:
        raise ValueError("damaged FLAC stream: subframe type")
    return [x << wasted for x in out] if wasted else out


def _residual(r: _Reader, n: int, order: int) -> Iterator[int]:
    """Residuals in partitions, each with a Rice parameter or, escaped, as numbers of equal width."""
    method, parts = r.bits(2), r.bits(4)
    if method > 1 or n % (1 << parts) or n >> parts < order:
        raise ValueError("damaged FLAC stream: residual coding")
    width = 4 + method
    for part in range(1 << parts):
        k, count = r.bits(width), (n >> parts) - (order if part == 0 else 0)
        if k == (1 << width) - 1:
            raw = r.bits(5)
            for _ in range(count):
                yield r.signed(raw) if raw else 0
        else:
            for _ in range(count):
                z = r.unary() << k | r.bits(k)
                yield (z >> 1) ^ -(z & 1)


def _frame(data: bytes, at: int, depth: int) -> tuple[list[list[int]], int]:
    """The samples of each channel of the frame at a byte, and where the next begins; checksums are verified."""
    r = _Reader(data, at)
    if r.bits(15) != 0x7FFC:
        raise ValueError("damaged FLAC stream: frame header")
    r.bits(1)
    size, rate, channels, bits = r.bits(4), r.bits(4), r.bits(4), r.bits(3)
    if r.bits(1) or not size or rate == 15 or channels > 10 or bits == 3:
        raise ValueError("damaged FLAC stream: frame header")
    first = r.bits(8)
    for _ in range(max(0, 8 - (first ^ 0xFF).bit_length() - 1) if first >= 0x80 else 0):
        r.bits(8)
    n = r.bits(8 * (size - 5)) + 1 if size in (6, 7) else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    r.bits({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = data[at : r.at >> 3]
    if r.bits(8) != int(_crc8(np.frombuffer(head, np.uint8), np.zeros(1, np.int64), np.array([len(head)]))[0]):
        raise ValueError("damaged FLAC stream: header checksum")
    depth = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits]
    side = {8: 1, 9: 0, 10: 1}.get(channels)  # the channel that holds a difference has a bit more
    got = [_subframe(r, n, depth + (c == side)) for c in range(2 if side is not None else channels + 1)]
    end = (r.at + 7) >> 3
    body = np.frombuffer(data[at:end], np.uint8)
    r.at = 8 * end
    if r.bits(16) != int(_crc16(body, np.zeros(1, np.int64), np.array([len(body)]))[0]):
        raise ValueError("damaged FLAC stream: frame checksum")
    if channels == 8:
        got[1] = [a - b for a, b in zip(*got, strict=True)]
    elif channels == 9:
        got[0] = [a + b for a, b in zip(*got, strict=True)]
    elif channels == 10:
        mid = [2 * a + (b & 1) for a, b in zip(*got, strict=True)]
        got = [[(m + b) >> 1 for m, b in zip(mid, got[1], strict=True)], [(m - b) >> 1 for m, b in zip(mid, got[1], strict=True)]]
    return got, end + 2


def samples(stream: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Samples (sample x channel) of any stream from one of them on; a seek table saves decoding what is before.

    A whole stream's MD5 is verified too, if it has one.
    """
    head = parse(stream)
    at, place, out, end = head.begin, 0, [], head.total if count is None else min(head.total, first + count)
    for p in head.seek:
        if place <= int(p["sample"]) <= first:
            at, place = head.begin + int(p["offset"]), int(p["sample"])
    begin = place
    while place < end:
        got, at = _frame(stream, at, head.depth)
        out.append(np.array(got, np.int64).T)
        place += len(out[-1])
    found = np.concatenate(out)[first - begin : end - begin] if out else np.zeros((0, head.channels), np.int64)
    if begin == first == 0 and end == head.total and any(head.md5):
        width = (head.depth + 7) // 8
        if hashlib.md5(np.ascontiguousarray(found, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest() != head.md5:
            raise ValueError("damaged FLAC stream: MD5")
    return found


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream of 8-bit samples; header, frame and MD5 checksums are verified."""
    try:
        return _decode_own(streams)
    except ValueError:  # another encoder's, or damaged: frame by frame
        out = []
        for s in streams:
            found = samples(s)
            if parse(s).depth != 8 or found.shape[1] != 1:
                raise ValueError("no FLAC stream of 8-bit samples in one channel") from None
            out.append((found[:, 0] + 128).astype(np.uint8).tobytes())
        return out


def _decode_own(streams: list[bytes]) -> list[bytes]:
    """decode() of streams as encode() writes them."""
    heads = [parse(s) for s in streams]
    at, number, frames, owner, base = [], [], [], [], 0
    for i, head in enumerate(heads):
        total, seek, begin = head.total, head.seek, head.begin
        first = seek["sample"].astype(np.int64) // BLOCK
        lanes_ok = (np.diff(seek["offset"].astype(np.int64)) > 0).all() and (seek["offset"] < len(streams[i]) - begin).all() and (seek["sample"] < total).all() and (np.diff(first) > 0).all()
        _must(np.array(len(seek) > 0 and first[0] == 0 and lanes_ok), "seek table")
        at.append(base + begin + seek["offset"].astype(np.int64))
        number.append(first)
        frames.append(np.diff(np.append(first, total // BLOCK)))
        owner.append(np.full(len(first), i))
        base += len(streams[i])
    at, number, frames = np.concatenate(at), np.concatenate(number), np.concatenate(frames)
    data = np.frombuffer(b"".join(streams), np.uint8)
    out, step = [], max(1, CHUNK // SEEK_FRAMES)
    for low in range(0, len(at), step):
        high = min(len(at), low + step)
        begin, end = at[low], at[high] if high < len(at) else len(data)
        try:
            x = _decode_lanes(data[begin:end], at[low:high] - begin, number[low:high], frames[low:high])
        except IndexError:
            raise ValueError("damaged FLAC stream: it ends too early") from None
        real = np.arange(x.shape[1]) < frames[low:high, None]
        out.append((x[real] + 128).astype(np.uint8).reshape(-1))
    signal, low, payloads = np.concatenate(out), 0, []
    for head in heads:
        payload = signal[low : low + head.total]
        low += head.total
        if hashlib.md5((payload ^ 0x80).tobytes()).digest() != head.md5:
            raise ValueError("damaged FLAC stream: MD5")
        payloads.append(payload.tobytes())
    return payloads


def _groups(sizes: list[int], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for low, high in _groups([len(t) for t in texts]):
            part = texts[low:high]
            media = encode([t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK, b" ") for t in part])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes, padded with spaces to a positive
    multiple of BLOCK, as a FLAC stream. A null text is an empty one; each row is stored by itself."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


class Features:
    """Level, zero crossings, roughness and peak of PCM that comes in blocks, from exact integer sums, and its digests."""

    def __init__(self) -> None:
        self.n = self.squares = self.sum = self.crossings = self.steps = self.peak = 0
        self.last, self.sha, self.tail = None, hashlib.sha256(), b""

    def add(self, pcm: bytes) -> None:
        raw = np.frombuffer(pcm, np.int8)
        x = raw.astype(np.int64)
        with_last = x if self.last is None else np.concatenate([[self.last], x])
        self.n, self.squares, self.sum = self.n + len(x), self.squares + int((x * x).sum()), self.sum + int(x.sum())
        self.crossings += int(np.count_nonzero((with_last[1:] < 0) != (with_last[:-1] < 0)))
        self.steps += int(np.abs(np.diff(with_last)).sum())
        self.peak, self.last = max(self.peak, int(np.abs(x).max(initial=0))), x[-1]
        payload = (raw.view(np.uint8) ^ 0x80).tobytes()
        self.sha.update(payload)
        self.tail = (self.tail + payload)[-16:]

    def __str__(self) -> str:
        return f"power={self.squares // self.n};mean={self.sum // self.n};crossings={self.crossings};step={self.steps // self.n};peak={self.peak}"


#: Samples of a block of PCM.
PCM_BLOCK = 65_536
_BLOCKS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("samples", pa.int64()), ("sample_offset", pa.int64()), ("pcm", pa.binary())])


def _block_batches(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_bytes, media = (batch.column(i).to_pylist() for i in range(3))
            for low, high in _groups([len(m) for m in media]):
                rows = []
                for i, payload in zip(range(low, high), decode(media[low:high]), strict=True):
                    pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
                    own = (ids[i], n_bytes[i], len(media[i]), hashlib.sha256(media[i]).hexdigest(), len(pcm))
                    rows += [(*own, a, pcm[a : a + size]) for a in range(0, len(pcm), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    return run


def pcm_blocks(media: DataFrame, size: int = PCM_BLOCK) -> DataFrame:
    """Signed 8-bit PCM of stored streams (doc_id, n_bytes, media) in blocks, by whose sample_offset a reader can seek.

    Each block has its stream's doc_id, n_bytes, media_bytes, media_sha256 and samples. A damaged
    stream raises an error.
    """
    ship_package(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_block_batches(size), "doc_id long, n_bytes long, media_bytes long, media_sha256 string, samples long, sample_offset long, pcm binary")


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    now = Features()
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media_bytes, media_sha256, total, at, pcm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at == 0:
                now = Features()
            now.add(pcm)
            if now.n == total:  # a stream's blocks come one after the other
                rows.append((doc_id, n_bytes, total, now.sha.hexdigest(), zlib.crc32(now.tail), media_bytes, media_sha256, str(now)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)


def media_features(media: DataFrame, size: int = PCM_BLOCK) -> DataFrame:
    """Read stored streams (doc_id, n_bytes, media) back as blocks of PCM and describe them; a damaged one raises an error."""
    return pcm_blocks(media, size).mapInArrow(_feature_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(media: DataFrame) -> DataFrame:
    """Write streams (doc_id, n_bytes, media) into the shared folder and read them back from there.

    The files are Parquet with its general codec, as Rice codes of texts leave some redundancy.
    """
    return materialize(media, "media", compression="zstd")


def op4_flac_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as FLAC, the stored streams read back in blocks of PCM and described."""
    return media_features(store(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))

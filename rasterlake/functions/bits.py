"""Packed samples, widened floats and lossless JPEG: codecs of one image, on arrays. Sources and sinks map them over rows."""

from __future__ import annotations

import re
import zlib

import numpy as np

from rasterlake.operators.lossless import code_lengths

#: Bit orders: samples run from the high bit of bytes, from the low bit, or from the high bit of little-endian words.
ORDERS = ("msb", "lsb", "msb16", "msb32")


def _stream(data: bytes, order: str) -> np.ndarray:
    """Bits in the order in which samples take them."""
    raw = np.frombuffer(data, np.uint8)
    if order.startswith("msb") and order != "msb":
        n = int(order[3:]) // 8
        raw = np.pad(raw, (0, -len(raw) % n)).reshape(-1, n)[:, ::-1].ravel()
    return np.unpackbits(raw, bitorder="little" if order == "lsb" else "big")


def unpack(data: bytes, bits: int, order: str, width: int, height: int, row_bytes: int = 0) -> np.ndarray:
    """height x width samples of 1 to 32 bits. row_bytes: bytes from one line to the next, where lines are padded.

    Missing data at the end are zeros.
    """
    lines = [data] if not row_bytes else [data[i * row_bytes : (i + 1) * row_bytes] for i in range(height)]
    per = width * height if not row_bytes else width
    place = np.arange(bits) if order == "lsb" else np.arange(bits - 1, -1, -1)
    out = []
    for line in lines:
        b = _stream(line, order)[: per * bits]
        b = np.pad(b, (0, per * bits - len(b))).reshape(per, bits).astype(np.uint64)
        out.append((b << place.astype(np.uint64)).sum(1))
    return np.concatenate(out).reshape(height, width).astype(np.int64) if out else np.zeros((height, width), np.int64)


def pack(samples: np.ndarray, bits: int, order: str) -> bytes:
    """The bytes that unpack() reads, without line padding."""
    place = np.arange(bits) if order == "lsb" else np.arange(bits - 1, -1, -1)
    b = (samples.astype(np.int64).ravel()[:, None] >> place & 1).astype(np.uint8).ravel()
    if order in ("msb", "lsb"):
        return np.packbits(b, bitorder="little" if order == "lsb" else "big").tobytes()
    n = int(order[3:]) // 8
    raw = np.packbits(b)
    return np.pad(raw, (0, -len(raw) % n)).reshape(-1, n)[:, ::-1].tobytes()


def widen(codes: np.ndarray, exponent: int, mantissa: int) -> np.ndarray:
    """Floats of 1 + exponent + mantissa bits as float64, with subnormals, infinities and NaN."""
    codes = codes.astype(np.int64)
    sign = np.where(codes >> (exponent + mantissa) & 1, -1.0, 1.0)
    e, m, bias = codes >> mantissa & ((1 << exponent) - 1), codes & ((1 << mantissa) - 1), (1 << (exponent - 1)) - 1
    value = np.where(e == 0, np.ldexp(m.astype(float), 1 - bias - mantissa), np.ldexp(1.0 + m / (1 << mantissa), (e - bias).astype(int)))
    return sign * np.where(e == (1 << exponent) - 1, np.where(m == 0, np.inf, np.nan), value)


def floats(data: bytes, bits: int, little: bool) -> np.ndarray:
    """Floats of 16, 24 or 32 bits."""
    if bits != 24:
        return np.frombuffer(data, ("<" if little else ">") + f"f{bits // 8}").astype(np.float64)
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
    return widen(b @ np.array([1, 1 << 8, 1 << 16] if little else [1 << 16, 1 << 8, 1]), 7, 16)


def inflate_floats(data: bytes, width: int, height: int, channels: int, bits: int, step: int = 1) -> np.ndarray:
    """Deflated lines of floats: bytes are differences, channels * step apart, of planes from the high byte to the low."""
    size = bits // 8
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, -1, channels * step)
    raw = np.cumsum(raw, axis=1, dtype=np.uint64).astype(np.uint8).reshape(height, size, width * channels)
    return floats(np.ascontiguousarray(raw.transpose(0, 2, 1)).tobytes(), bits, False).reshape(height, width, channels)


def deflate_floats(samples: np.ndarray, bits: int, step: int = 1) -> bytes:
    """The inverse of inflate_floats() for 16 and 32 bits; samples: height x width x channels."""
    h, w, c = samples.shape
    raw = np.frombuffer(samples.astype(f">f{bits // 8}").tobytes(), np.uint8).reshape(h, w * c, bits // 8).transpose(0, 2, 1)
    return zlib.compress(np.diff(raw.reshape(h, -1, c * step), axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes())


def _guess(x: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Prediction of every sample of an int64 plane stack (height x width x channels)."""
    a, b, d = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    a[:, 1:], b[1:], d[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    out = (a, b, d, a + b - d, a + (b - d >> 1), b + (a - d >> 1), a + b >> 1)[predictor - 1].copy()
    out[0], out[1:, 0] = a[0], b[1:, 0]
    out[0, 0] = first
    return out


def ljpeg_encode(samples: np.ndarray, bits: int, predictor: int = 1) -> bytes:
    """Lossless JPEG (ITU T.81) of height x width x channels, with one table built from the image's own size classes."""
    x = samples.astype(np.int64)
    h, w, n = x.shape
    diff = ((x - _guess(x, predictor, 1 << (bits - 1)) + 32767) % 65536 - 32767).ravel()
    kind = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(int) + 1)
    counts = np.bincount(kind, minlength=17)
    lengths = code_lengths({k: int(c) for k, c in enumerate(counts)})
    if max(lengths.values(), default=0) > 16:
        lengths = dict.fromkeys(lengths, 5)
    order = sorted(lengths, key=lambda k: (lengths[k], k))
    code, last, codes = 0, 0, {}
    for k in order:
        code <<= lengths[k] - last
        codes[k], last = code, lengths[k]
        code += 1
    head, tail = np.zeros(17, np.int64), np.zeros(17, np.int64)
    for k in order:
        head[k], tail[k] = codes[k], lengths[k]
    extra = np.where(kind == 16, 0, kind)  # the largest class has one member
    value = head[kind] << extra | np.where(extra > 0, np.where(diff > 0, diff, diff + (1 << extra) - 1), 0)
    size = tail[kind] + extra
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    stream = (np.repeat(value, size) >> (np.repeat(size, size) - 1 - at) & 1).astype(np.uint8)
    body = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    be = lambda v, k=2: int(v).to_bytes(k, "big")
    table = bytes([0]) + bytes(sum(v == i for v in lengths.values()) for i in range(1, 17)) + bytes(order)
    frame = bytes([bits]) + be(h) + be(w) + bytes([n]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n))
    scan = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([predictor, 0, 0])
    segment = lambda marker, data: b"\xff" + bytes([marker]) + be(len(data) + 2) + data
    return b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, table) + segment(0xDA, scan) + body + b"\xff\xd9"


def ljpeg_decode(data: bytes, two_lines: bool = False) -> np.ndarray:
    """height x width x channels of a lossless JPEG without restarts.

    Three channels may have luma at twice the resolution across, or both ways: chroma then repeats within each unit, and the
    predictor is the sample before. two_lines: the two luma lines of a unit are predicted each by itself, not one after the other.
    """
    at, tables, frame = 2, {}, None
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            frame = part
        elif marker == 0xC4:
            while part:
                n = sum(part[1:17])
                tables[part[0] & 15], part = (part[1:17], part[17 : 17 + n]), part[17 + n :]
        elif marker == 0xDD and any(part):
            raise ValueError("restart intervals are not supported")
        elif marker == 0xDA:
            break
    bits, h, w, n = frame[0], int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big"), frame[5]
    used, predictor, shift = [part[2 + 2 * i] >> 4 for i in range(n)], part[1 + 2 * n], part[3 + 2 * n] & 15
    end = re.compile(rb"\xff[^\x00]", re.S).search(data, at)
    body = data[at : end.start() if end else len(data)].replace(b"\xff\x00", b"\xff") + bytes(8)
    first, sizes = 1 << (bits - shift - 1), [frame[7 + 3 * i] for i in range(n)]
    if all(x == 0x11 for x in sizes):
        diff = _differences(body, [tables[t] for t in used], h * w)
        return _restore(diff.reshape(h, w, n), predictor, first) << shift
    if sizes not in ([0x21, 0x11, 0x11], [0x22, 0x11, 0x11]) or predictor != 1 or w % 2 or h % (sizes[0] & 15):
        raise ValueError("channels of such resolutions are not supported")
    tall = sizes[0] & 15
    units = _differences(body, [tables[t] for t in [used[0]] * 2 * tall + used[1:]], h * w // (2 * tall)).reshape(h // tall, w // 2, 2 * tall + 2)
    out = np.empty((h, w, 3), np.int64)
    if tall == 1 or two_lines:
        out[::tall, :, 0] = _chained(units[:, :, :2].reshape(h // tall, w), first)
        if tall == 2:
            out[1::2, :, 0] = np.cumsum(units[:, :, 2:4].reshape(h // 2, w), 1) + out[::2, :1, 0]
    else:
        luma = _chained(units[:, :, :4].reshape(h // 2, w * 2), first)
        out[:, :, 0] = luma.reshape(h // 2, w // 2, 2, 2).swapaxes(1, 2).reshape(h, w)
    for k in (1, 2):
        out[:, :, k] = _chained(units[:, :, 2 * tall + k - 1], first).repeat(tall, 0).repeat(2, 1)
    return (out & 0xFFFF) << shift


def _chained(diff: np.ndarray, first: int) -> np.ndarray:
    """Running sums along each line; a line starts from the first sample of the one before."""
    starts = np.cumsum(diff[:, 0]) - diff[:, 0] + first
    return np.cumsum(diff, 1) + starts[:, None]


def _differences(body: bytes, tables: list[tuple[bytes, bytes]], units: int) -> np.ndarray:
    """Differences of so many units, each coded with the tables in turn."""
    looked = {t: _lookup(*t) for t in set(tables)}
    turn = [looked[t] for t in tables]
    diff, pos, n = np.zeros(units * len(turn), np.int64), 0, len(turn)
    for i in range(len(diff)):
        word = int.from_bytes(body[pos >> 3 : (pos >> 3) + 6], "big") << (pos & 7) & 0xFFFFFFFFFFFF
        length, kind = turn[i % n][word >> 32]
        if not length or pos >> 3 > len(body) - 8:
            raise ValueError("the scan ends early or holds an unknown code")
        if kind == 16:
            diff[i] = 32768
        elif kind:
            extra = word >> (48 - length - kind) & ((1 << kind) - 1)
            diff[i] = extra if extra >> (kind - 1) else extra - (1 << kind) + 1
        pos += length + (0 if kind == 16 else kind)
    return diff


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of every 16 bits that begin with a code."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = [(length, symbols[k])] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _restore(diff: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Samples from their differences; lines after the first depend on both neighbours unless the predictor is 1 or 2."""
    x = diff.copy()
    x[0] = (np.cumsum(diff[0], 0) + first) & 0xFFFF
    for r in range(1, len(x)):
        above = x[r - 1]
        if predictor == 1:
            x[r] = (np.cumsum(diff[r], 0) + above[0]) & 0xFFFF
        elif predictor == 2:
            x[r] = (diff[r] + above) & 0xFFFF
        else:
            x[r, 0] = (diff[r, 0] + above[0]) & 0xFFFF
            for c in range(1, x.shape[1]):
                a, b, d = x[r, c - 1], above[c], above[c - 1]
                x[r, c] = (diff[r, c] + (None, d, a + b - d, a + (b - d >> 1), b + (a - d >> 1), a + b >> 1)[predictor - 2]) & 0xFFFF
    return x

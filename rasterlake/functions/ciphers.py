"""Byte ciphers of makers' metadata, as closed key streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier of the words that start the key stream.
START = 48828125
WORD = 0xFFFFFFFF


def word_stream(key: int, count: int) -> np.ndarray:
    """So many 32-bit words of the stream that a key starts: each is the exclusive or of those 127 and 63 places before."""
    seeds: list[int] = []
    for _ in range(4):
        key = (key * START + 1) & WORD
        seeds.append(key)

    def mixed(a: int, b: int, c: int, d: int) -> int:
        return ((a ^ c) << 1 & WORD) | (b ^ d) >> 31

    seeds[3] = (seeds[3] << 1 & WORD) | (seeds[0] ^ seeds[2]) >> 31
    while len(seeds) < 127:
        seeds.append(mixed(*seeds[-4:]))
    words = np.zeros(127 + count, np.uint32)
    words[:127] = np.array(seeds, np.uint32).byteswap()
    for at in range(127, len(words), 63):
        part = words[at : at + 63]
        part[:] = words[at - 127 : at - 127 + len(part)] ^ words[at - 63 : at - 63 + len(part)]
    return words[127:]


def by_words(data: bytes, key: int) -> bytes:
    """Whole words of the data, deciphered (or enciphered: it is its own inverse); up to three bytes at the end are left out."""
    whole = np.frombuffer(data[: len(data) // 4 * 4], "<u4")
    return (whole ^ word_stream(key, len(whole))).astype("<u4").tobytes()


def cube_root(byte: Column) -> Column:
    """Byte whose cube modulo 249 is given; bytes from 249 on are themselves."""
    roots = np.arange(256)
    roots[np.arange(249) ** 3 % 249] = np.arange(249)
    return F.get(F.array(*(F.lit(int(x)) for x in roots)), byte.cast("int"))


def serial_number(text: str) -> int:
    """Number of a serial text up to its end or a zero: digits count as such, other characters by their code modulo 10."""
    number = 0
    for c in text.split("\0")[0].encode("latin-1"):
        number = number * 10 + (c - 48 if 48 <= c <= 57 else c % 10)
    return number


def by_steps(byte: Column, place: Column, step: Column, start: Column) -> Column:
    """Byte at a place of a stream whose key grows by step times 96, 97, 98 and so on. Step and start come from the makers' tables of
    256 bytes, by the serial number and by the key's four bytes combined, both modulo 256: the caller looks them up."""
    place = F.pmod(place, F.lit(512)).cast("long")  # the key stream repeats
    grown = start + step * ((place + 1) * 96 + F.floor(place * (place + 1) / 2))
    return byte.cast("long").bitwiseXOR(F.pmod(grown.cast("long"), F.lit(256)))

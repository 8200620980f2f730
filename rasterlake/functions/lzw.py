"""LZW as in TIFF files: codes of 9 to 12 bits, high bit first, wider one code early; 256 clears the table, 257 ends."""

from __future__ import annotations

CLEAR, END, LAST = 256, 257, 4094


def encode(data: bytes) -> bytes:
    held, bits, out, width = 0, 0, bytearray(), 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    known, run = {bytes([i]): i for i in range(256)}, b""
    fresh = END + 1
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in known:
            run = longer
            continue
        put(known[run])
        known[longer] = fresh
        fresh += 1
        width = max(9, fresh.bit_length())
        if fresh > LAST:
            width = 12
            put(CLEAR)
            known, fresh, width = {bytes([i]): i for i in range(256)}, END + 1, 9
        run = data[i : i + 1]
    if run:
        put(known[run])
        fresh += 1
        width = min(12, max(9, fresh.bit_length()))
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def decode(data: bytes) -> bytes:
    """Stops at the end code or the end of the data; an unknown code is an error."""
    table, out, width, before = [], [], 9, b""
    held = bits = at = 0
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(start)
    while True:
        while bits < width and at < len(data):
            held, bits, at = (held & ((1 << bits) - 1)) << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, before = list(start), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("an unknown LZW code")
        found = table[code] if code < len(table) else before + before[:1]
        out.append(found)
        if before:
            table.append(before + found[:1])
        width = min(12, max(9, (len(table) + 1).bit_length()))
        before = found
    return b"".join(out)

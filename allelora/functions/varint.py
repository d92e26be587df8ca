"""Variable-length integers: 7 bits a byte, least significant first; the first byte may carry a prefix in its high bits."""

from __future__ import annotations


def encode(value: int, prefix: int = 0, bits: int = 0) -> bytes:
    """``value`` >= 0 behind a ``bits``-bit prefix (0 to 7 bits)."""
    if value < 0 or not 0 <= bits <= 7 or prefix >> bits:
        raise ValueError("value or prefix out of range")
    room = 7 - bits
    low, rest = value & ((1 << room) - 1), value >> room
    out = bytearray([prefix << (8 - bits) & 0xFF | (1 << room if rest else 0) | low])
    while rest:
        low, rest = rest & 0x7F, rest >> 7
        out.append(low | (0x80 if rest else 0))
    return bytes(out)


def decode(data: bytes, at: int = 0, bits: int = 0) -> tuple[int, int, int]:
    """(value, prefix, place after it); raises ValueError on data that end early."""
    if at >= len(data):
        raise ValueError("no more data")
    room, first = 7 - bits, data[at]
    value, shift, more, at = first & ((1 << room) - 1), room, first >> room & 1, at + 1
    while more:
        if at >= len(data):
            raise ValueError("no more data")
        value |= (data[at] & 0x7F) << shift
        more, shift, at = data[at] >> 7, shift + 7, at + 1
    return value, first >> (8 - bits) if bits else 0, at

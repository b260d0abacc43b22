"""Ogg pages: framing with checksums and lacing, and the way back to packets of each logical stream."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
FIRST, LAST, GOES_ON = 2, 4, 1


def checksum(raw: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0 and not inverted, as pages carry it.

    zlib works on mirrored bits and inverts before and after; mirrored bytes and both inversions undone give the same.
    """
    x = zlib.crc32(raw.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{x:032b}"[::-1], 2)


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing))
    x = checksum(head + lacing + body)
    return b"".join([head[:22], struct.pack("<I", x), head[26:], lacing, body])


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream. packets: bytes, and the granule position at their end.

    A packet's lacing values are 255 for each full segment and one below 255 that ends it; 255 values fill a page, and a
    packet that isn't over then goes on in the next one. A page's granule position is that of the last packet that ends
    there, -1 if none does.
    """
    out, lacing, body, granule, continued = [], bytearray(), bytearray(), -1, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = (FIRST if not out else 0) | (LAST if last else 0) | (GOES_ON if continued else 0)
        out.append(page(serial, len(out), granule, flags, bytes(lacing), bytes(body)))
        continued = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), bytearray(), -1

    for k, (raw, at) in enumerate(packets):
        values = b"\xff" * (len(raw) // 255) + bytes([len(raw) % 255])
        done = 0
        while values:
            n = min(255 - len(lacing), len(values))
            size = sum(values[:n]) if n == len(values) else 255 * n
            lacing += values[:n]
            body += raw[done : done + size]
            done += size
            values = values[n:]
            if not values:
                granule = at
            if len(lacing) == 255 and (values or k + 1 < len(packets)):
                flush(False)
        if k == 0 and len(packets) > 1 and lacing:
            flush(False)  # a stream's first packet has a page of its own
    flush(True)
    return out


def multiplex(streams: list[list[bytes]]) -> bytes:
    """First pages of all streams, then the others in turn."""
    rest = [list(x[1:]) for x in streams]
    out = [x[0] for x in streams]
    for k in range(max(map(len, rest), default=0)):
        out += [x[k] for x in rest if k < len(x)]
    return b"".join(out)


def read_pages(raw: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, sequence, granule, flags, lacing, body) of each page; raises ValueError where one is damaged."""
    at = 0
    while at < len(raw):
        if len(raw) - at < 27:
            raise ValueError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, given, n = HEAD.unpack_from(raw, at)
        if magic != b"OggS" or version:
            raise ValueError("no page starts here")
        lacing = raw[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(raw):
            raise ValueError("a page is cut off")
        if checksum(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]) != given:
            raise ValueError("a page's checksum is wrong")
        yield serial, sequence, granule, flags, lacing, raw[at + 27 + n : end]
        at = end


def read_packets(raw: bytes) -> dict[int, tuple[list[bytes], list[tuple[int, int]]]]:
    """For each serial: its packets, and (granule, number of packets so far) at each page where a packet ends."""
    out: dict[int, tuple[list[bytes], list[tuple[int, int]]]] = {}
    parts: dict[int, list[bytes]] = {}
    following: dict[int, int] = {}
    for serial, sequence, granule, flags, lacing, body in read_pages(raw):
        if sequence != following.get(serial, 0) or bool(flags & FIRST) != (serial not in following):
            raise ValueError("a page is missing")
        following[serial] = sequence + 1
        packets, marks = out.setdefault(serial, ([], []))
        held = parts.setdefault(serial, [])
        if bool(flags & GOES_ON) != bool(held):
            raise ValueError("a packet's continuation is missing")
        at, ended = 0, False
        start = 0
        for k, value in enumerate(lacing):
            if value < 255:
                size = 255 * (k - start) + value
                held.append(body[at : at + size])
                packets.append(b"".join(held))
                held.clear()
                at += size
                start = k + 1
                ended = True
        if start < len(lacing):
            held.append(body[at:])
        if ended:
            marks.append((granule, len(packets)))
        elif granule != -1:
            raise ValueError("no packet ends here, but there is a granule position")
    if any(parts.values()):
        raise ValueError("a packet isn't over")
    return out

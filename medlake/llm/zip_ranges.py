"""Stored members of ZIP packages, by range reads: ends, central directory, ZIP64.

Layouts and signatures follow the public ZIP application note.  ``Source`` is anything
with ``size``, ``seek`` and ``read``; only the package's tail, its directory and the
asked-for ranges are read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

#: Signatures, fixed by the format.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header_at: int


def _range(source, at: int, n: int) -> bytes:
    source.seek(at)
    got = source.read(n)
    if len(got) != n:
        raise ValueError(f"the package ends inside a range of {n} bytes at {at}")
    return bytes(got)


def directory(source, size: int) -> list[Member]:
    """Members in the order of the central directory."""
    tail = _range(source, max(0, size - (22 + FULL16)), min(size, 22 + FULL16))
    found = tail.rfind(END)
    while found >= 0 and (len(tail) < found + 22 or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail)):
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, found + 10)
    at = size - len(tail) + found
    if FULL16 in (count,) or FULL32 in (length, start):
        head = _range(source, at - 20, 20) if at >= 20 else b""
        if head[:4] == LOCATOR64:
            (where,) = struct.unpack_from("<Q", head, 8)
            end = _range(source, where, 56)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
    raw, p, members = _range(source, start, length), 0, []
    for _ in range(count):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        crc, packed, full, n, e, c = struct.unpack_from("<IIIHHH", raw, p + 16)
        (header_at,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + n : p + 46 + n + e], 0
        while q + 4 <= len(extra):
            tag, long = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{long // 8}Q", extra, q + 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                header_at = wide.pop(0) if header_at == FULL32 else header_at
            q += 4 + long
        members.append(Member(name, method, crc, packed, full, header_at))
        p += 46 + n + e + c
    return members


def data_at(source, member: Member) -> int:
    """Where the member's bytes begin; it must be stored, not deflated."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed inside the package")
    head = _range(source, member.header_at, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n, e = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n + e


class StoredWriter:
    """Writes members as they come, uncompressed; ZIP64 records where sizes need them or on demand.

    A member whose size isn't known yet is opened, written to and shut: its checksum and
    sizes then stand behind its bytes, and in the central directory.
    """

    def __init__(self, sink, wide: bool = False):
        self.sink, self.wide, self.at, self.members = sink, wide, 0, []
        self.opened: list | None = None

    def open(self, name: str) -> None:
        """Begin a member of unknown size, ready for more than four gigabytes."""
        raw, start = name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        self.opened = [raw, 0, 0, start]

    def write(self, raw: bytes) -> None:
        """More bytes of the open member."""
        self.opened[1], self.opened[2] = zlib.crc32(raw, self.opened[1]), self.opened[2] + len(raw)
        self._put(raw)

    def shut(self) -> None:
        """End the open member."""
        raw, crc, size, start = self.opened
        self._put(DESCRIPTOR + struct.pack("<IQQ", crc, size, size))
        self.members.append((raw, crc, size, start, 0x808))
        self.opened = None

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, name: str, blocks: list[bytes]) -> None:
        size, crc = sum(map(len, blocks)), 0
        for b in blocks:
            crc = zlib.crc32(b, crc)
        wide, start, raw = self.wide or size >= FULL32, self.at, name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = FULL32 if wide else size
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        for b in blocks:
            self._put(b)
        self.members.append((raw, crc, size, start, 0x800))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at, flags in self.members:
            wide = self.wide or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            short, place = (FULL32, FULL32) if wide else (size, at)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide or flags != 0x800 else 20, flags, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        length, n = self.at - start, len(self.members)
        if wide := self.wide or n >= FULL16 or start >= FULL32:
            where = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, where, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else length, FULL32 if wide else start, 0))

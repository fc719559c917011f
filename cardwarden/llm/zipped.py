"""Reading of stored members of ZIP archives by byte ranges, with ZIP64."""

from __future__ import annotations

import struct
from dataclasses import dataclass

_END, _END64, _LOCATE64, _ENTRY, _LOCAL = (
    b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    compressed: int
    size: int
    header: int

    @property
    def stored(self) -> bool:
        return self.method == 0


def read_range(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"archive ends before byte {at + n}")
    return bytes(data)


def directory_place(file, size: int) -> tuple[int, int, int]:
    """``(offset, bytes, entries)`` of the central directory.

    The end record lies in the last 65,557 bytes, behind a comment of any content. Values that
    do not fit it stand in the ZIP64 end record, which its locator points to.
    """
    tail_at = max(0, size - 65_557)
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == _FULL16 or length == _FULL32 or offset == _FULL32:
        locator = tail_at + at - 20
        if locator >= 0 and (found := read_range(file, locator, 20)).startswith(_LOCATE64):
            record = read_range(file, struct.unpack_from("<Q", found, 8)[0], 56)
            if not record.startswith(_END64):
                raise ValueError("no ZIP64 end of central directory where its locator points")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, entries


def members(file, size: int) -> list[Member]:
    """All entries of the central directory; sizes and offsets from ZIP64 fields where needed."""
    offset, length, entries = directory_place(file, size)
    data, at, out = read_range(file, offset, length), 0, []
    for _ in range(entries):
        if data[at:at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        compressed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46:at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + name_n:at + 46 + name_n + extra_n]
        wide = _zip64_field(extra)
        # the field holds, in this order, only the values that overflow
        if plain == _FULL32:
            plain, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        if compressed == _FULL32:
            compressed, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        if header == _FULL32:
            header = struct.unpack("<Q", wide[:8])[0]
        out.append(Member(name, method, compressed, plain, header))
        at += 46 + name_n + extra_n + comment_n
    return out


def _zip64_field(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4:at + 4 + n]
        at += 4 + n
    return b""


def data_start(file, member: Member) -> int:
    """Where the member's bytes begin; its local header may have another extra field."""
    local = read_range(file, member.header, 30)
    if not local.startswith(_LOCAL):
        raise ValueError(f"no local header of {member.name}")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_n + extra_n

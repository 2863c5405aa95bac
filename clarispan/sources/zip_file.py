"""ZIP files with one JSON member, checked before anything is read from it.

The directory at the file's end and the headers before each member must tell the same story and cover the file without a
gap or an overlap; forms beyond plain ZIP (ZIP64, several disks, encryption, links, other methods) are refused. What is read
is checked against the member's length and CRC at its end.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass

# Signatures, bounds, and the flags that may be set (compression level, data descriptor, UTF-8 name).
END, DIRECTORY, LOCAL, DESCRIPTOR, LOCATOR64 = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x07\x08", b"PK\x06\x07"
MOST_ENTRIES, MOST_DIRECTORY, MOST_NAME, MOST_DECODED = 128, 1_000_000, 4096, 5_000_000_000
FLAGS, HAS_DESCRIPTOR, VERSION = 0x080E, 0x0008, 20
NONE32, NONE16 = 0xFFFFFFFF, 0xFFFF


class ZipProblem(ValueError):
    """kind: format, unsupported, limit or length."""

    def __init__(self, kind: str, what: str):
        super().__init__(f"{kind}: {what}")
        self.kind = kind


@dataclass
class Member:
    name: bytes
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    start: int
    mode: int
    disk: int
    version: int
    extra: bytes
    folder_bit: bool

    @property
    def is_folder(self) -> bool:
        return self.name.endswith(b"/")


def _need(ok: bool, kind: str, what: str) -> None:
    if not ok:
        raise ZipProblem(kind, what)


def _at(f, place: int, n: int) -> bytes:
    f.seek(place)
    data = f.read(n)
    _need(len(data) == n, "format", "the file ends inside its metadata")
    return data


def _plain_extra(extra: bytes) -> None:
    """Extra fields must fill their space; the one of ZIP64 is refused."""
    while extra:
        _need(len(extra) >= 4, "format", "an extra field is cut")
        tag, n = struct.unpack_from("<HH", extra)
        _need(tag != 1, "unsupported", "ZIP64")
        _need(len(extra) >= 4 + n, "format", "an extra field is cut")
        extra = extra[4 + n :]


def _directory(f, size: int) -> tuple[list[Member], int]:
    """Members as the directory has them, and where it begins."""
    tail_at = max(0, size - 65_557)
    tail = _at(f, tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    _need(end >= 0, "format", "no end of the directory")
    _need(tail[end - 20 : end - 16] != LOCATOR64 or end < 20, "unsupported", "ZIP64")
    disk, first_disk, here, count, length, start = struct.unpack_from("<HHHHII", tail, end + 4)
    _need((disk, first_disk, here) == (0, 0, count), "unsupported", "several disks")
    _need(count != NONE16 and NONE32 not in (length, start), "unsupported", "ZIP64")
    _need(0 < count <= MOST_ENTRIES and length <= MOST_DIRECTORY, "limit", "too large a directory")
    _need(start + length == tail_at + end, "format", "the directory is not before its end")
    data, members, at = _at(f, start, length), [], 0
    for _ in range(count):
        _need(data[at : at + 4] == DIRECTORY and at + 46 <= length, "format", "a broken directory entry")
        _, _, version, flags, method, _, _, crc, packed, full, n, m, k, disk, _, outer, place = struct.unpack_from("<4sHHHHHHIIIHHHHHII", data, at)
        _need(0 < n <= MOST_NAME and at + 46 + n + m + k <= length, "format", "a broken directory entry")
        name, extra = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + m]
        members.append(Member(name, flags, method, crc, packed, full, place, outer >> 16 & 0xF000, disk, version, extra, bool(outer & 0x10)))
        at += 46 + n + m + k
    _need(at == length, "format", "bytes after the last directory entry")
    return members, start


def _check_kind(m: Member) -> None:
    _need(not m.flags & ~FLAGS and m.method in (0, 8) and m.version <= VERSION, "unsupported", "encryption, method or version")
    _need(m.method == 8 or not m.flags & 6, "unsupported", "flags of another method")
    _need(m.disk == 0, "unsupported", "several disks")
    _need(NONE32 not in (m.packed, m.size, m.start), "unsupported", "ZIP64")
    _need(m.mode in (0, 0x8000, 0x4000), "unsupported", "a link or special file")
    _need(m.is_folder or not (m.mode == 0x4000 or m.folder_bit), "format", "a folder without a folder's name")
    _need(not m.is_folder or (m.mode != 0x8000 and not (m.packed or m.size or m.crc or m.method)), "format", "a folder with data")
    try:
        name = m.name.decode("utf-8" if m.flags & 0x800 else "ascii")
    except UnicodeDecodeError:
        raise ZipProblem("format", "a name that is no text") from None
    parts = name.rstrip("/").split("/")
    _need("\\" not in name and ":" not in name and not any(p in ("", ".", "..") or min(p) < " " for p in parts), "format", "a name that is no relative path")
    _plain_extra(m.extra)


def _check_place(f, m: Member, until: int) -> int:
    """Compares a member's local header, and its descriptor, with the directory; where its data begin."""
    head = _at(f, m.start, 30)
    mark, version, flags, method, _, _, crc, packed, size, n, k = struct.unpack("<4sHHHHHIIIHH", head)
    _need(mark == LOCAL and version <= VERSION and (flags, method, n) == (m.flags, m.method, len(m.name)), "format", "headers disagree")
    rest = _at(f, m.start + 30, n + k)
    _need(rest[:n] == m.name, "format", "headers disagree")
    _plain_extra(rest[n:])
    later = bool(m.flags & HAS_DESCRIPTOR)
    _need(all(a == b or (later and a == 0) for a, b in ((crc, m.crc), (packed, m.packed), (size, m.size))), "format", "headers disagree")
    data = m.start + 30 + n + k
    left = until - data - m.packed
    _need(left in ((12, 16) if later else (0,)), "format", "members overlap or leave a gap")
    if later:
        told = _at(f, data + m.packed, left)
        _need(left == 12 or told[:4] == DESCRIPTOR, "format", "a broken descriptor")
        _need(struct.unpack("<III", told[-12:]) == (m.crc, m.packed, m.size), "format", "the descriptor disagrees")
    return data


def checked_member(f, most_decoded: int = MOST_DECODED) -> tuple[Member, int]:
    """The one JSON member of an open ZIP file, and where its data begin."""
    f.seek(0, io.SEEK_END)
    members, directory = _directory(f, f.tell())
    for m in members:
        _check_kind(m)
    names = [m.name.lower() for m in members]
    _need(len(set(names)) == len(names), "format", "a name occurs twice")
    files = [m for m in members if not m.is_folder]
    _need(len(files) == 1 and files[0].name.lower().endswith(b".json"), "format", "there must be exactly one .json member")
    one = files[0]
    _need(one.size <= most_decoded, "limit", "too many bytes")
    _need(one.method == 8 or one.packed == one.size, "length", "a stored member of two lengths")
    place, data = 0, 0
    ordered = sorted(members, key=lambda m: m.start)
    for m, until in zip(ordered, [*(m.start for m in ordered[1:]), directory]):
        _need(m.start == place, "format", "members overlap or leave a gap")
        begins = _check_place(f, m, until)
        data, place = begins if m is one else data, until
    return one, data


class _Decoded(io.RawIOBase):
    """A member's bytes; its end is reached only if length and CRC are as told."""

    def __init__(self, f, member: Member, data: int):
        self.f, self.member, self.left, self.seen, self.crc, self.pending = f, member, member.packed, 0, 0, b""
        self.unpack = zlib.decompressobj(-15) if member.method == 8 else None
        f.seek(data)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        want = len(out)
        while not self.pending:
            if self.unpack is not None and self.unpack.unconsumed_tail:
                self.pending = self.unpack.decompress(self.unpack.unconsumed_tail, want)
                continue
            raw = self.f.read(min(self.left, 1 << 16))
            self.left -= len(raw)
            if not raw:
                self.pending = b"" if self.unpack is None else self.unpack.flush()
                if self.pending:
                    continue
                whole = self.unpack is None or (self.unpack.eof and not self.unpack.unused_data)
                _need(whole and not self.left and (self.seen, self.crc) == (self.member.size, self.member.crc), "length", "length or CRC is not as told")
                return 0
            self.pending = raw if self.unpack is None else self.unpack.decompress(raw, want)
        part, self.pending = self.pending[:want], self.pending[want:]
        self.seen += len(part)
        self.crc = zlib.crc32(part, self.crc)
        _need(self.seen <= self.member.size, "length", "more bytes than told")
        out[: len(part)] = part
        return len(part)


def open_json_member(f, most_decoded: int = MOST_DECODED) -> io.BufferedReader:
    """The bytes of the one JSON member of an open ZIP file."""
    member, data = checked_member(f, most_decoded)
    return io.BufferedReader(_Decoded(f, member, data), 1 << 16)



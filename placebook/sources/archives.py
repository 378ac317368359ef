"""Members of ZIP archives, of damaged ones as well: what is whole is read, what isn't is told."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

LOCAL, HEADER = b"PK\x03\x04", struct.Struct("<4s5H3I2H")
STORED, DEFLATED = 0, 8


def _member(data: bytes, at: int) -> tuple[str, bytes | None, int]:
    """(name, content or None, end) of the member whose local header begins at ``at``."""
    _, _, flags, method, _, _, crc, packed, size, n_name, n_extra = HEADER.unpack_from(data, at)
    begin = at + HEADER.size + n_name + n_extra
    name = data[at + HEADER.size : at + HEADER.size + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
    later = bool(flags & 8)  # sizes and checksum stand behind the data
    if method == DEFLATED:
        unpack = zlib.decompressobj(-15)
        try:
            content = unpack.decompress(data[begin:] if later else data[begin : begin + packed])
        except zlib.error:
            return name, None, begin
        end = len(data) - len(unpack.unused_data) if later else begin + packed
        if later and unpack.eof:
            mark = data[end : end + 4] == b"PK\x07\x08"
            crc, size = struct.unpack_from("<I4xI", data, end + 4 * mark) if len(data) >= end + 4 * mark + 12 else (zlib.crc32(content), len(content))
        whole = unpack.eof
    elif method == STORED and not later:
        content, end, whole = data[begin : begin + packed], begin + packed, begin + packed <= len(data)
    else:
        return name, None, begin
    return name, content if whole and len(content) == size and zlib.crc32(content) == crc else None, end


def members(data: bytes) -> dict[str, bytes | None]:
    """The content of each member by name, None for one that is damaged.

    The directory at the archive's end leads; where it is lost or wrong, members are found by
    their own headers and unpacked as far as they are whole.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out: dict[str, bytes | None] = {}
            for name in z.namelist():
                try:
                    out[name] = z.read(name)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    out[name] = None
            return out
    except (zipfile.BadZipFile, OSError, ValueError):
        pass
    found: dict[str, bytes | None] = {}
    at = data.find(LOCAL)
    while 0 <= at <= len(data) - HEADER.size:
        name, content, end = _member(data, at)
        if content is not None or name not in found:
            found[name] = content
        # a header inside of a whole member is content, one behind a damaged member may be the next
        at = data.find(LOCAL, end if content is not None else at + 4)
    if not found:
        raise zipfile.BadZipFile("no member of the archive can be read")
    return found

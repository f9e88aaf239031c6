"""Sizes of images from their headers: PNG, GIF, JPEG."""

from __future__ import annotations

import struct


def kind_and_size(data: bytes | None) -> tuple[str, int, int] | None:
    """(suffix, width, height) in pixels; none for what is not one of the three, or is cut short before its size."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # filling, and marks without a length
                at += 1 if mark == 0xFF else 2
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame
                high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", wide, high
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None

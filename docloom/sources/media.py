"""Images by their bytes: kind, size in pixels and resolution."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

SVG_WINDOW = 65_536
LARGEST_EMU = 27_273_042_316_900


@dataclass
class Image:
    kind: str
    width: float
    height: float
    dpi: tuple[float, float] | None = None


def inspect(data: bytes) -> Image | None:
    """The image that data holds, or None if it is none of PNG, JPEG, GIF, WebP, TIFF, EMF, WMF and SVG."""
    for read in (png, jpeg, gif, webp, tiff, emf, wmf, svg):
        try:
            found = read(data)
        except (struct.error, IndexError, ValueError, ZeroDivisionError):
            continue
        if found:
            return found
    return None


def png(data: bytes) -> Image | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    width, height = struct.unpack(">II", data[16:24])
    at, dpi = 8, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"pHYs":
            x, y, unit = struct.unpack(">IIB", data[at + 8 : at + 17])
            dpi = (x * 0.0254, y * 0.0254) if unit == 1 and x and y else None
        if kind == b"IDAT":
            break
        at += 12 + size
    return Image("png", width, height, dpi)


def jpeg(data: bytes) -> Image | None:
    """Size from the frame header; resolution from Exif if it has one, else from JFIF."""
    if data[:2] != b"\xff\xd8":
        return None
    at, jfif, exif = 2, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE0 and body[:5] == b"JFIF\0":
            jfif = density(body[7], *struct.unpack(">HH", body[8:12]))
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            found = tags(body[6:])
            if 282 in found and 283 in found:
                exif = density({2: 1, 3: 2}.get(found.get(296, 2), 0), found[282], found[283])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            return Image("jpeg", width, height, exif or jfif)
        at += 2 + size
    return None


def density(unit: int, x: float, y: float) -> tuple[float, float] | None:
    """Dots per inch of a density per inch (1) or centimetre (2)."""
    factor = {1: 1.0, 2: 2.54}.get(unit)
    return (x * factor, y * factor) if factor and x and y else None


def gif(data: bytes) -> Image | None:
    return Image("gif", *struct.unpack("<HH", data[6:10])) if data[:6] in (b"GIF87a", b"GIF89a") else None


def webp(data: bytes) -> Image | None:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return None
    kind = data[12:16]
    if kind == b"VP8X":
        return Image("webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1)
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return Image("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    width, height = struct.unpack("<HH", data[26:30])
    return Image("webp", width & 0x3FFF, height & 0x3FFF)


def tags(data: bytes) -> dict[int, float]:
    """Numbers of a TIFF directory's first entries, by tag."""
    order = {b"II": "<", b"MM": ">"}[data[:2]] if data[:2] in (b"II", b"MM") else None
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        return {}
    start = struct.unpack(order + "I", data[4:8])[0]
    out: dict[int, float] = {}
    for i in range(struct.unpack(order + "H", data[start : start + 2])[0]):
        tag, kind, _ = struct.unpack(order + "HHI", data[start + 2 + 12 * i : start + 10 + 12 * i])
        value = data[start + 10 + 12 * i : start + 14 + 12 * i]
        if kind == 3:
            out[tag] = struct.unpack(order + "H", value[:2])[0]
        elif kind == 4:
            out[tag] = struct.unpack(order + "I", value)[0]
        elif kind == 5:
            at = struct.unpack(order + "I", value)[0]
            a, b = struct.unpack(order + "II", data[at : at + 8])
            out[tag] = a / b if b else 0
    return out


def tiff(data: bytes) -> Image | None:
    found = tags(data)
    if 256 not in found or 257 not in found:
        return None
    return Image("tiff", found[256], found[257], density({2: 1, 3: 2}.get(found.get(296, 2), 0), found.get(282, 0), found.get(283, 0)))


def emf(data: bytes) -> Image | None:
    """Size from the frame, in hundredths of a millimetre, at 96 dots per inch."""
    if data[:4] != b"\x01\0\0\0" or data[40:44] != b" EMF":
        return None
    left, top, right, bottom = struct.unpack("<iiii", data[24:40])
    return Image("emf", (right - left) * 96 / 2540, (bottom - top) * 96 / 2540, (96, 96))


def wmf(data: bytes) -> Image | None:
    if data[:4] != b"\xd7\xcd\xc6\x9a":
        return None
    left, top, right, bottom, per_inch = struct.unpack("<hhhhH", data[6:16])
    return Image("wmf", abs(right - left) * 96 / per_inch, abs(bottom - top) * 96 / per_inch, (96, 96))


def svg(data: bytes) -> Image | None:
    """Size from width and height, else from the view box; only the start of the file is looked at."""
    text = re.sub(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", "", data[:SVG_WINDOW].decode("utf-8", "replace"), flags=re.S).lstrip("﻿ \t\r\n")
    tag = re.match(r"<(?:\w+:)?svg\b[^>]*>", text)
    if not tag:
        return None
    value = lambda name: m[2] if (m := re.search(rf"\s{name}\s*=\s*(['\"])(.*?)\1", tag[0], re.S)) else None
    box = [float(x) for x in re.split(r"[\s,]+", (value("viewBox") or "").strip()) if x]
    width, height = pixels(value("width")), pixels(value("height"))
    if len(box) == 4:
        width = width or (height * box[2] / box[3] if height else box[2])
        height = height or width * box[3] / box[2]
    return Image("svg", width or 300, height or 150, (96, 96))


def pixels(length: str | None) -> float | None:
    m = re.fullmatch(r"\s*([0-9.]+)\s*(px|pt|pc|mm|cm|in)?\s*", length or "")
    return float(m[1]) * {"px": 1, "pt": 96 / 72, "pc": 16, "mm": 96 / 25.4, "cm": 96 / 2.54, "in": 96, None: 1}[m[2]] if m else None


def extent(image: Image) -> tuple[int, int] | None:
    """Width and height in EMU; None outside of what office formats allow."""
    x, y = image.dpi or (96, 96)
    sides = round(image.width / x * 914_400), round(image.height / y * 914_400)
    return sides if all(1 <= s <= LARGEST_EMU for s in sides) else None

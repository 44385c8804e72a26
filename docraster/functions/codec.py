"""PNG, TIFF and BMP images and image-only PDF documents with zlib alone."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np


def png_bytes(img: np.ndarray) -> bytes:
    """An 8-bit gray or RGB PNG of a gray or BGR image."""
    h, w = img.shape[:2]
    rgb = img if img.ndim == 2 else img[..., ::-1]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def tiff_bytes(img: np.ndarray) -> bytes:
    """A little-endian TIFF of a gray or BGR image: one strip, deflated."""
    h, w = img.shape[:2]
    n = 1 if img.ndim == 2 else 3
    body = zlib.compress(np.ascontiguousarray(img if n == 1 else img[..., ::-1]).tobytes(), 6)
    short, long, after = 3, 4, 8 + 2 + 10 * 12 + 4
    bits = (short, 1, 8) if n == 1 else (short, 3, after)
    tags = [(256, long, 1, w), (257, long, 1, h), (258, *bits), (259, short, 1, 8), (262, short, 1, 1 if n == 1 else 2), (273, long, 1, after + 6), (277, short, 1, n), (278, long, 1, h), (279, long, 1, len(body)), (284, short, 1, 1)]
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + struct.pack("<3H", 8, 8, 8) + body


def bmp_bytes(img: np.ndarray) -> bytes:
    """A bottom-up BMP of 24 bits a pixel, or of 8 with a gray palette."""
    h, w = img.shape[:2]
    n = 1 if img.ndim == 2 else 3
    row = -(-w * n // 4) * 4
    rows = np.zeros((h, row), np.uint8)
    rows[:, : w * n] = np.ascontiguousarray(img[::-1]).reshape(h, -1)
    palette = b"" if n == 3 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4) @ np.diag([1, 1, 1, 0]).astype(np.uint8)
    palette = palette if n == 3 else palette.tobytes()
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, rows.size, 2835, 2835, 0, 0) + palette + rows.tobytes()


def png_image(data: bytes) -> np.ndarray | None:
    """The image of an 8-bit PNG (gray, RGB, with or without alpha, not interlaced); None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if not channels or head[2] != 8 or head[6]:
        return None
    w, h = head[:2]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((h, w, channels), np.uint8)
    above = np.zeros((w, channels), np.int32)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].reshape(w, channels).astype(np.int32)
        if kind == 1:
            line = np.cumsum(line, axis=0)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = line.copy()
            for x in range(w):
                a, c = (line[x - 1], above[x - 1]) if x else (np.zeros(channels, np.int32),) * 2
                if kind == 3:
                    guess = (a + above[x]) // 2
                else:
                    p = a + above[x] - c
                    far = np.abs(np.stack([p - a, p - above[x], p - c]))
                    guess = np.choose(far.argmin(0), np.stack([a, above[x], c]))
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    colour = out[..., : 1 if channels < 3 else 3]
    return colour[..., 0] if channels < 3 else np.ascontiguousarray(colour[..., ::-1])


def jpeg_size(data: bytes) -> tuple[int, int, int] | None:
    """Width, height and number of channels of a JPEG from its frame header; None for anything else."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
            return width, height, channels
        at += 2 + n
    return None


def pdf_image(img: np.ndarray | bytes) -> tuple[int, int, str, bytes]:
    """Width, height, colour space and filter, and data of an image in a PDF; a JPEG's bytes are its data."""
    if isinstance(img, bytes):
        width, height, channels = jpeg_size(img)
        return width, height, f"/ColorSpace /Device{'Gray' if channels == 1 else 'RGB'} /BitsPerComponent 8 /Filter /DCTDecode", img
    rgb = np.ascontiguousarray(img if img.ndim == 2 else img[..., ::-1])
    return img.shape[1], img.shape[0], f"/ColorSpace /Device{'Gray' if img.ndim == 2 else 'RGB'} /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(rgb.tobytes(), 6)


def pdf_parts(images: Iterable[tuple[int, int, str, bytes]], dpi: int = 300) -> Iterator[bytes]:
    """A PDF with one page per image (as ``pdf_image`` gives them), each as large as the image at this resolution, part by
    part: the list of pages comes last."""
    places, kids, at = {}, [], 0

    def put(number: int, body: bytes) -> bytes:
        nonlocal at
        places[number] = at
        part = b"%d 0 obj\n" % number + body + b"\nendobj\n"
        at += len(part)
        return part

    at = len(b"%PDF-1.4\n")
    yield b"%PDF-1.4\n"
    yield put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    for width, height, kind, data in images:
        n, w, h = 3 + 3 * len(kids), width * 72 / dpi, height * 72 / dpi
        draw = f"q {w:.4f} 0 0 {h:.4f} 0 0 cm /Im Do Q".encode()
        yield put(n, f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.4f} {h:.4f}] /Contents {n + 1} 0 R /Resources << /XObject << /Im {n + 2} 0 R >> >> >>".encode())
        yield put(n + 1, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        yield put(n + 2, f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} {kind} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
        kids.append(f"{n} 0 R")
    yield put(2, f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode())
    table = b"".join(b"%010d 00000 n \n" % places[i] for i in sorted(places))
    yield b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, at)


def pdf_bytes(images: list[np.ndarray], dpi: int = 300) -> bytes:
    return b"".join(pdf_parts(map(pdf_image, images), dpi))


_IMAGE = re.compile(rb"/Subtype /Image /Width (\d+) /Height (\d+) /ColorSpace /Device(Gray|RGB) /BitsPerComponent 8 /Filter /FlateDecode /Length (\d+) >>\nstream\n")


def pdf_images(data: bytes) -> list[np.ndarray] | None:
    """The page images of a PDF as written above, in order; None for any other PDF."""
    out, at = [], 0
    while m := _IMAGE.search(data, at):
        w, h, space, n = int(m[1]), int(m[2]), m[3], int(m[4])
        raw = np.frombuffer(zlib.decompress(data[m.end() : m.end() + n]), np.uint8)
        out.append(raw.reshape(h, w) if space == b"Gray" else np.ascontiguousarray(raw.reshape(h, w, 3)[..., ::-1]))
        at = m.end() + n
    pages = re.search(rb"/Count (\d+)", data)
    return out if pages and int(pages[1]) == len(out) else None


def pdf_page_count(data: bytes) -> int | None:
    """Number of pages of a PDF as written above, told without decoding any; None for any other PDF."""
    pages = re.search(rb"/Count (\d+)", data)
    return int(pages[1]) if pages and int(pages[1]) == sum(1 for _ in _IMAGE.finditer(data)) else None

"""Pixels as numpy arrays (height, width, channels) of bytes: PNG, orientation, resizing, grey, boxes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

GREY = np.array([0.299, 0.587, 0.114])


def encode_png(pixels: np.ndarray) -> bytes:
    """Grey, RGB or RGBA bytes as a PNG without filters."""
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    rows = np.zeros((h, 1 + pixels.reshape(h, -1).shape[1]), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def to_rgb(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    return np.repeat(pixels, 3, 2) if pixels.shape[2] == 1 else pixels[:, :, :3]


def to_grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB, rounded to bytes."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2])
    return np.clip(np.rint(pixels[:, :, :3] @ GREY), 0, 255).astype(np.uint8)


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels upright, given the orientation that their file names: 1 to 8, others as 1."""
    turns = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1)}
    turns |= {6: lambda p: p.swapaxes(0, 1)[:, ::-1], 7: lambda p: p[::-1, ::-1].swapaxes(0, 1), 8: lambda p: p.swapaxes(0, 1)[::-1]}
    return np.ascontiguousarray(turns.get(orientation, lambda p: p)(pixels))


def exif_orientation(content: bytes) -> int:
    """The orientation tag of a JPEG's or PNG's EXIF block; 1 where there is none."""
    at = content.find(b"Exif\0\0")
    tiff = content[at + 6 :] if at >= 0 else b""
    if not tiff and (at := content.find(b"eXIf")) >= 0:
        tiff = content[at + 4 :]
    if tiff[:2] not in (b"II", b"MM") or len(tiff) < 10:
        return 1
    end = "<" if tiff[:2] == b"II" else ">"
    start = struct.unpack_from(f"{end}I", tiff, 4)[0]
    if start + 2 > len(tiff):
        return 1
    for k in range(struct.unpack_from(f"{end}H", tiff, start)[0]):
        entry = start + 2 + 12 * k
        if entry + 12 > len(tiff):
            return 1
        tag, _, _, value = struct.unpack_from(f"{end}HHIH", tiff, entry)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def cropped(pixels: np.ndarray, box: list[int] | None) -> np.ndarray:
    """The part within (x0, y0, x1, y1); what lies outside the image is black."""
    if box is None:
        return pixels
    x0, y0, x1, y1 = box
    out = np.zeros((max(0, y1 - y0), max(0, x1 - x0), *pixels.shape[2:]), pixels.dtype)
    h, w = pixels.shape[:2]
    top, left, bottom, right = max(0, y0), max(0, x0), min(h, y1), min(w, x1)
    if top < bottom and left < right:
        out[top - y0 : bottom - y0, left - x0 : right - x0] = pixels[top:bottom, left:right]
    return out


def _weights(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new place the old places and weights of a cubic kernel (a = -0.5), widened when the size shrinks."""
    scale = old / new
    wide = max(1.0, scale)
    centre = (np.arange(new) + 0.5) * scale
    reach = int(np.ceil(2 * wide)) + 1
    at = np.floor(centre)[:, None].astype(int) + np.arange(-reach, reach + 1)[None, :]
    x = np.abs((at + 0.5 - centre[:, None]) / wide)
    k = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    k = np.where((at >= 0) & (at < old), k, 0.0)
    return np.clip(at, 0, old - 1), k / k.sum(1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exactly width by height (1 at least), by cubic interpolation."""
    width, height = max(1, width), max(1, height)
    flat = pixels.reshape(*pixels.shape[:2], -1).astype(float)
    at, k = _weights(flat.shape[0], height)
    flat = np.einsum("nkwc,nk->nwc", flat[at], k)
    at, k = _weights(flat.shape[1], width)
    flat = np.einsum("hnkc,nk->hnc", flat[:, at], k)
    return np.clip(np.rint(flat), 0, 255).astype(np.uint8).reshape(height, width, *pixels.shape[2:])


def fitted(pixels: np.ndarray, longest: int) -> np.ndarray:
    """The longer side brought down to `longest`, the other truncated; never enlarged."""
    h, w = pixels.shape[:2]
    if max(h, w) <= longest:
        return pixels
    return resized(pixels, int(w * (longest / max(h, w))), int(h * (longest / max(h, w))))


def drawn(pixels: np.ndarray, boxes: list[list[float]], colours: list[tuple[int, int, int]], line: int = 1) -> np.ndarray:
    """A copy in RGB with the outlines of boxes (x0, y0, x1, y1) in pixels."""
    out = to_rgb(pixels).copy()
    h, w = out.shape[:2]
    for (x0, y0, x1, y1), colour in zip(boxes, colours):
        left, top = int(np.clip(round(x0), 0, w - 1)), int(np.clip(round(y0), 0, h - 1))
        right, bottom = int(np.clip(round(x1), 0, w - 1)), int(np.clip(round(y1), 0, h - 1))
        for k in range(line):
            out[min(top + k, bottom), left : right + 1] = out[max(bottom - k, top), left : right + 1] = colour
            out[top : bottom + 1, min(left + k, right)] = out[top : bottom + 1, max(right - k, left)] = colour
    return out

"""Baseline JPEG frames to brightness samples: Huffman tables, dequantisation and inverse DCT by the file's own tables.

Sequential Huffman frames of 8 bits are read, of any number of components, sampling factors, scans and restart
intervals; a frame without Huffman tables has the usual ones of motion-JPEG. Anything else raises ValueError. Sums of
the inverse DCT are whole numbers, so samples don't depend on a machine's order of summing.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

SHIFT = 12
#: Samples of a frame that a file may ask for, as a broken one may ask for anything.
MOST_SAMPLES = 1 << 28

# The typical Huffman tables of the JPEG standard (annex K.3), as (codes of each length, symbols).
USUAL = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442"
        "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a"
        "737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def _zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each coefficient in the order of a scan."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def _basis() -> np.ndarray:
    """(64 coefficients in scan order, 64 samples) of the inverse DCT, in parts of 2 ** SHIFT."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.kron(one, one) * (1 << SHIFT))[_zigzag()]


BASIS = _basis()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """0 to 255 brightness of blocks (n, 64) from dequantised coefficients in scan order; exact in whole numbers."""
    sums = coefficients.astype(np.float64) @ BASIS
    return np.clip(np.floor((sums + (1 << (SHIFT - 1))) / (1 << SHIFT)) + 128, 0, 255).astype(np.uint8)


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: length of the code they begin with, times 256, plus its symbol; 0 where there is none."""
    out, at, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            width = 1 << (16 - length)
            if at + width > 1 << 16:
                raise ValueError("more codes than a Huffman table can have")
            out[at : at + width] = length << 8 | symbols[k]
            at, k = at + width, k + 1
    return out.tolist()


class _Bits:
    """Huffman codes and values of one restart interval, its stuffed zeros taken out."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.int64)
        self.words = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).tolist()
        self.at, self.end = 0, len(raw) * 8

    def block(self, dc: list[int], ac: list[int], before: int, out: np.ndarray) -> int:
        """Read a block's coefficients into out; its first one is returned."""
        words, at, end = self.words, self.at, self.end
        k, table = 0, dc
        while k < 64:
            if at >= end:
                raise ValueError("the scan ends within a block")
            hit = table[words[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
            if not hit:
                raise ValueError("a code that isn't in the Huffman table")
            at += hit >> 8
            run, size = (hit >> 4 & 15, hit & 15) if k else (0, hit & 255)
            if k and not size and run != 15:
                break
            if size > 15 or k + run > 63:
                raise ValueError("a coefficient beyond the block")
            k += run
            value = 0
            if size:
                if at + size > end:
                    raise ValueError("the scan ends within a block")
                value = (words[at >> 3] >> (16 - (at & 7)) & 0xFFFF) >> (16 - size)
                at += size
                if not value >> (size - 1):
                    value += 1 - (1 << size)
            if not k:
                before += value
                value = before
            out[k] = value
            k, table = k + 1, ac
        self.at = at
        return before


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the scan that begins at a place, and the place of the marker after it."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan has no end")
        code = data[at + 1]
        if code == 0:
            at += 2
        elif code == 0xFF:
            at += 1
        else:
            parts.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= code <= 0xD7:
                return parts, at
            at = start = at + 2


def _scan(data: bytes, at: int, chosen: list[tuple[dict, list[int], list[int]]], frame: dict, restart: int) -> int:
    """Read one scan into its components' coefficients; the place after it is returned."""
    parts, end = _intervals(data, at)
    if len(chosen) == 1:  # blocks of one component in rows, without those that only pad a unit
        part = chosen[0][0]
        units = [[(chosen[0], y, x)] for y in range(part["rows"]) for x in range(part["columns"])]
    else:
        units = [
            [(c, uy * c[0]["v"] + y, ux * c[0]["h"] + x) for c in chosen for y in range(c[0]["v"]) for x in range(c[0]["h"])]
            for uy in range(frame["unit_rows"])
            for ux in range(frame["unit_columns"])
        ]
    step = restart or len(units)
    if len(parts) < -(-len(units) // step):
        raise ValueError("the scan lacks restart intervals")
    for i, raw in zip(range(0, len(units), step), parts):
        bits, before = _Bits(raw), {}
        for unit in units[i : i + step]:
            for (part, dc, ac), y, x in unit:
                before[part["id"]] = bits.block(dc, ac, before.get(part["id"], 0), part["held"][y, x])
    return end


def _frame(body: bytes) -> dict:
    """Size and components of a frame segment."""
    depth, height, width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not height or not width or not n or len(body) < 6 + 3 * n:
        raise ValueError("a frame of this kind isn't read")
    parts = [{"id": i, "h": hv >> 4, "v": hv & 15, "q": q} for i, hv, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
    if any(not 1 <= c[k] <= 4 for c in parts for k in "hv") or height * width > MOST_SAMPLES:
        raise ValueError("a frame of this kind isn't read")
    h, v = max(c["h"] for c in parts), max(c["v"] for c in parts)
    rows, columns = -(-height // (8 * v)), -(-width // (8 * h))
    for c in parts:
        c["rows"], c["columns"] = -(-height * c["v"] // (8 * v)), -(-width * c["h"] // (8 * h))
        c["held"] = np.zeros((rows * c["v"], columns * c["h"], 64), np.int32)
    return {"height": height, "width": width, "v": v, "h": h, "unit_rows": rows, "unit_columns": columns, "parts": parts}


def brightness(data: bytes) -> np.ndarray:
    """The first component of a baseline JPEG, (height, width) of 0 to 255; ValueError where it can't be read."""
    try:
        return _brightness(data)
    except (struct.error, IndexError, KeyError) as fault:  # segments that are cut short
        raise ValueError("a broken image") from fault


def _brightness(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant, huff, frame, restart, seen, at = {}, {}, None, 0, False, 2
    for key, (counts, symbols) in USUAL.items():
        huff[key] = (bytes.fromhex(counts), bytes.fromhex(symbols))
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while data[at + 1] == 0xFF:
            at += 1
        code, at = data[at + 1], at + 2
        if code == 0xD9:
            break
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if len(body) != size - 2:
            raise ValueError("a segment that is cut short")
        if code == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[key] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                if len(quant[key]) != 64:
                    raise ValueError("a quantisation table that is cut short")
                body = body[1 + n :]
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a Huffman table that is cut short")
                huff[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif code in (0xC0, 0xC1):
            frame = _frame(body)
        elif 0xC2 <= code <= 0xCF and code != 0xCC and code != 0xC8:
            raise ValueError("only sequential Huffman frames are read")
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            by_id = {c["id"]: c for c in frame["parts"]}
            chosen = [(by_id[body[1 + 2 * k]], _lookup(*huff[body[2 + 2 * k] >> 4]), _lookup(*huff[0x10 | body[2 + 2 * k] & 15])) for k in range(body[0])]
            at, seen = _scan(data, at, chosen, frame, restart), seen or any(c is frame["parts"][0] for c, _, _ in chosen)
    if frame is None or not seen:
        raise ValueError("no image")
    part = frame["parts"][0]
    rows, columns = part["held"].shape[:2]
    blocks = samples(part["held"].reshape(-1, 64) * quant[part["q"]])
    flat = blocks.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
    height, width = -(-frame["height"] * part["v"] // frame["v"]), -(-frame["width"] * part["h"] // frame["h"])
    return flat[:height, :width]

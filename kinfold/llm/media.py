"""Media columns (operator 7): payloads in AVI motion-JPEG, read back by the RIFF index.

A payload is cut into blocks of 64 bytes, a JPEG's unit. A block's 64 quantised coefficients are those whose eight value
bits are its bytes (category 8: 128 to 255, and -255 to -128 for bytes under 128), so each has nine bits after entropy
coding (a Huffman code of one bit before them) and nothing is lost; a restart marker after each block resets the
prediction of the first coefficient. Frames are intra frames of SIDE x SIDE blocks; the last one is padded with zero
blocks. The length of the payload is kept in the file's INFO list.

Clips are found in any AVI motion-JPEG file: frames by the RIFF index, or in the order of their chunks where there is
none, decoded to brightness (jpeg.brightness). Shots are found by histogram differences of neighbouring frames: a cut is
where the difference is over the mean plus THRESHOLD deviations of the differences so far in the shot, and over FLOOR.
A frame that can't be decoded shows the picture before it, as a player does, and is counted as broken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import slices

SIDE, FPS, UNIT = 4, 25, 64
PER_FRAME = SIDE * SIDE
THRESHOLD, FLOOR, BINS = 3.0, 0.15, 16
#: Each block: 64 times nine bits, then a restart marker.
BITS, BLOCK_BYTES = 9, 72


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head() -> bytes:
    """Start of image, unit quantisation, frame, Huffman tables of one code each (symbol 8), restart interval 1, scan."""
    table = bytes([1] + [0] * 15 + [8])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0] + [1] * 64)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + table + b"\x10" + table),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


HEAD = jpeg_head()
#: The restart markers between the blocks of a frame; after the last block the image ends.
MARKS = np.array([[0xFF, 0xD0 + i % 8] for i in range(PER_FRAME - 1)] + [[0xFF, 0xD9]], np.uint8)


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG for each PER_FRAME blocks of the payload."""
    raw = np.frombuffer(payload, np.uint8)
    frames = -(-len(raw) // (UNIT * PER_FRAME))
    data = np.zeros(frames * UNIT * PER_FRAME, np.uint8)
    data[: len(raw)] = raw
    # bits of a coefficient: Huffman code 0, then its byte
    bits = np.zeros((len(data), BITS), np.uint8)
    bits[:, 1:] = np.unpackbits(data[:, None], axis=1)
    blocks = np.packbits(bits.reshape(-1, UNIT * BITS), axis=1).reshape(frames, PER_FRAME, BLOCK_BYTES)
    out = []
    for frame in blocks:
        full = (frame == 0xFF).any()
        parts = [(x.tobytes().replace(b"\xff", b"\xff\x00") if full else x.tobytes()) + m.tobytes() for x, m in zip(frame, MARKS)] if full else None
        out.append(HEAD + (b"".join(parts) if parts else np.concatenate([frame, MARKS], axis=1).tobytes()))
    return out


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The bytes of an own frame's blocks, (PER_FRAME, 64): the value bits of its coefficients."""
    if not jpeg.startswith(HEAD):
        raise ValueError("not a frame of this profile")
    scan = np.frombuffer(jpeg, np.uint8, offset=len(HEAD))
    at = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[at + 1]
    keep = np.ones(len(scan), bool)
    keep[at + 1] = False  # stuffed zeros and marker codes
    keep[at[after != 0]] = False  # the markers themselves
    bits = np.unpackbits(scan[keep])
    if len(bits) != PER_FRAME * UNIT * BITS or bits[::BITS].any():
        raise ValueError("a code that isn't in the Huffman table")
    return np.packbits(bits.reshape(-1, BITS)[:, 1:], axis=1).reshape(PER_FRAME, UNIT)


def own_pictures(blocks: np.ndarray) -> np.ndarray:
    """Brightness of own blocks, (n, 64): their coefficients are dequantised by one and go through the inverse DCT."""
    held = blocks.astype(np.int16)
    return jpeg.samples(np.where(held < 128, held - 255, held))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """The AVI file of a payload: headers, INFO with its length, movi with the frames, idx1."""
    frames = encode_frames(payload)
    side = SIDE * 8
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", str(len(payload)).encode())
    movi, index, at = [b"movi"], [], 4
    for x in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        movi.append(_chunk(b"00dc", x))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    """Video frames, the payload's length (None if no INFO comment tells it), and frames a second.

    Frames are those of the RIFF index, whose places count from the movi list or from the file's start, or the chunks of
    the movi list where there is no index. ValueError where the file is no AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    try:
        return _parse_avi(data)
    except struct.error as fault:
        raise ValueError("a broken AVI file") from fault


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a range; the last one may be cut short."""
    end = min(end, len(data))
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def _is_video(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _movie(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """Video chunks of a movi list in their order, those of its rec lists too."""
    for name, a, b in _chunks(data, at, end):
        if name == b"LIST":
            yield from _movie(data, a + 4, b)
        elif _is_video(name):
            yield data[a:b]


def _parse_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    movi, index, length, rate = None, None, None, float(FPS)
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = movi or (a, b)
        elif kind == b"INFO":
            for inner, x, y in _chunks(data, a + 4, b):
                told = data[x:y].rstrip(b"\0")
                if inner == b"ICMT" and told.isdigit():
                    length = int(told)
        elif kind == b"hdrl":
            for inner, x, y in _chunks(data, a + 4, b):
                micros = struct.unpack_from("<I", data, x)[0] if inner == b"avih" else 0
                rate = 1_000_000 / micros if micros else rate
        elif name == b"idx1":
            index = data[a : a + (b - a) // 16 * 16]
    if movi is None:
        raise ValueError("no movi list")
    entries = [x for x in struct.iter_unpack("<4sIII", index or b"") if _is_video(x[0])]
    if not entries:
        return list(_movie(data, movi[0] + 4, movi[1])), length, rate
    name, _, offset, _ = entries[0]
    base = movi[0] if data[movi[0] + offset :][:4] == name else 0
    return [data[base + offset + 8 : base + offset + 8 + size] for _, _, offset, size in entries], length, rate


def histogram(pictures: np.ndarray) -> np.ndarray:
    """Shares of BINS equal ranges of brightness."""
    return np.bincount(pictures.ravel() >> 4, minlength=BINS) / pictures.size


def histograms(frames: list[bytes]) -> tuple[np.ndarray, list[bool]]:
    """(frames, BINS) of each frame's picture, and which frames can't be decoded; these show the picture before them."""
    out, broken, last = [], [], None
    for x in frames:
        try:
            last = histogram(own_pictures(decode_frame(x)) if x.startswith(HEAD) else jpeg.brightness(x))
            broken.append(False)
        except ValueError:
            broken.append(True)
        out.append(last)
    first = next((x for x in out if x is not None), np.zeros(BINS))
    return np.array([first if x is None else x for x in out]).reshape(-1, BINS), broken


def shots(hist: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, end frame, largest difference within) of each shot, by adaptive histogram differences."""
    if not len(hist):
        return []
    diffs = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    out, first, n, total, square, most = [], 0, 0, 0.0, 0.0, 0.0
    for i, d in enumerate(diffs.tolist(), 1):
        mean = total / n if n else 0.0
        deviation = max(0.0, square / n - mean * mean) ** 0.5 if n else 0.0
        if d > FLOOR and n and d > mean + THRESHOLD * deviation:
            out.append((first, i, most))
            first, n, total, square, most = i, 0, 0.0, 0.0, 0.0
        else:
            n, total, square, most = n + 1, total + d, square + d * d, max(most, d)
    return [*out, (first, len(hist), most)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its payload: padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row: the AVI file of its text's payload.

    Null and empty texts hold 64 zeros; repeated rows give equal rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            held = [payload_of(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in held], pa.int64()), pa.array([encode_avi(x) for _, x in held], pa.binary())], ["id", "n_bytes", "media"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def clip_rows(data: bytes) -> list[tuple]:
    """(clip, start_s, end_s, frames, peak, broken, error) of a file."""
    try:
        frames, _, rate = parse_avi(data)
    except ValueError as fault:
        return [(None, None, None, 0, None, 0, str(fault))]
    if not frames:
        return [(None, None, None, 0, None, 0, "no frames")]
    hist, broken = histograms(frames)
    return [(k, a / rate, b / rate, b - a, m, sum(broken[a:b]), None) for k, (a, b, m) in enumerate(shots(hist))]


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of a media column: id, clip, start_s, end_s, frames, peak, broken, error.

    Null media gives no row; a file that is no AVI file or has no frames gives one row with the error and no clip; frames
    that can't be decoded are counted in broken. Repeated rows give their clips again; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 16 << 20):
            rows = [(i, *r) for i, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist()) if data is not None for r in clip_rows(data)]
            names = ["id", "clip", "start_s", "end_s", "frames", "peak", "broken", "error"]
            kinds = [batch.schema.field("id").type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    source = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, clip int, start_s double, end_s double, frames int, peak double, broken int, error string").withColumnRenamed("id", id_col)


def features(media: DataFrame) -> DataFrame:
    """Read an own media column (doc_id, n_bytes, media) back: payload and media digests, and the clips as a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("media").to_pylist():
                frames, length, rate = parse_avi(data)
                blocks = np.stack([decode_frame(x) for x in frames])
                payload = blocks.tobytes()[:length]
                hist = np.array([histogram(own_pictures(x)) for x in blocks])
                text = f"frames={len(frames)};clips=" + ",".join(f"{a / rate:.2f}-{b / rate:.2f}:{m:.4f}" for a, b, m in shots(hist))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), text))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[j] for r in out], k) for j, k in enumerate(kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digest(df: DataFrame) -> DataFrame:
    """Store every document's payload in the media format and read it back.

    Null and empty texts are a payload of 64 zeros; equal texts give equal values; repeated rows give equal rows; an
    empty table gives none; other columns are not looked at.
    """
    return features(encode_media(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))

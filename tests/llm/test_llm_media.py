import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import jpeg, media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(raw):
    payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
    frames, length, rate = media.parse_avi(media.encode_avi(payload))
    assert b"".join(media.decode_frame(x).tobytes() for x in frames)[:length] == payload and rate == media.FPS


def test_stuffing_is_undone():
    payload = bytes([0xFF] * 640) + bytes(range(256))
    frames, length, _ = media.parse_avi(media.encode_avi(payload))
    assert b"".join(media.decode_frame(x).tobytes() for x in frames)[:length] == payload


def test_shots_find_a_change():
    r = random.Random(1)
    calm = "".join(r.choice("abcdefgh") for _ in range(12 * 1024))
    loud = "".join(chr(r.randint(1, 127)) for _ in range(12 * 1024))
    _, payload = media.payload_of(calm + loud)
    found = media.shots(media.histograms(media.parse_avi(media.encode_avi(payload))[0])[0])
    assert [(a, b) for a, b, _ in found] == [(0, 12), (12, 24)]


def test_digest_and_edges(spark):
    rows = [(1, "héllo", 1), (2, None, 2), (3, "", 3), (1, "héllo", 1), (4, "x" * 300_000, 4), (None, "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = media.media_digest(df).collect()
    assert len(got) == 6
    for r in got:
        raw = (next(t for i, t, _ in rows if i == r.doc_id) or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    a, b = [r for r in got if r.doc_id == 1]
    assert a == b
    assert [r.feature for r in got if r.doc_id == 2] == [r.feature for r in got if r.doc_id == 3]
    assert media.media_digest(df.limit(0)).collect() == []
    rows = media.clips(media.encode_media(df.where("doc_id = 4"))).collect()
    assert rows[0].start_s == 0 and rows[-1].end_s == sum(r.frames for r in rows) / media.FPS


def java_jpeg(spark, picture, quality=0.9):
    """A picture, (height, width, 3), as Java's own JPEG writer stores it, and its brightness as Java reads it."""
    jvm, height, width = spark._jvm, *picture.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    flat = (picture[..., 0].astype(int) << 16 | picture[..., 1].astype(int) << 8 | picture[..., 2]).ravel()
    packed = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
    for i, v in enumerate(flat.tolist()):
        packed[i] = v
    image.setRGB(0, 0, width, height, packed, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def java_brightness(spark, data):
    """Brightness of a JPEG by Java's decoder: its raster before any change of colours."""
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(data)))
    raster = reader.readRaster(0, None)
    held = raster.getSamples(0, 0, raster.getWidth(), raster.getHeight(), 0, spark.sparkContext._gateway.new_array(jvm.int, raster.getWidth() * raster.getHeight()))
    return np.array(list(held)).reshape(raster.getHeight(), raster.getWidth())


def picture(seed, height, width):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    waves = [127 + 80 * np.sin(x / r.uniform(2, 9) + y / r.uniform(2, 9) + k) + r.normal(0, 12, (height, width)) for k in range(3)]
    return np.clip(np.stack(waves, -1), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("height,width,quality", [(24, 40, 0.9), (17, 13, 0.5), (33, 50, 0.2), (8, 8, 1.0)])
def test_frames_of_another_encoder(spark, height, width, quality):
    data = java_jpeg(spark, picture(height, height, width), quality)
    ours, theirs = jpeg.brightness(data), java_brightness(spark, data)
    assert ours.shape == theirs.shape and np.abs(ours.astype(int) - theirs).max() <= 1


def test_own_frames_by_another_decoder(spark):
    r = np.random.default_rng(3)
    for raw in (r.integers(0, 256, 1024, np.uint8).tobytes(), b"some words of a text " * 40, b"\xff" * 1000):
        frame = media.encode_frames(raw)[0]
        theirs, general = java_brightness(spark, frame), jpeg.brightness(frame)
        own = media.own_pictures(media.decode_frame(frame)).reshape(4, 4, 8, 8).swapaxes(1, 2).reshape(32, 32)
        assert (own == general).all() and np.abs(own.astype(int) - theirs).max() <= 1


def foreign_avi(frames, index=True, absolute=False, rec=False):
    """An AVI file without INFO, with sound chunks between the frames."""
    movi, entries = [b"movi"], []
    head = media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", (100_000).to_bytes(4, "little") + b"\0" * 52))
    start, at = 12 + len(head) + 8, 4
    for x in frames:
        for name, body in ((b"01wb", b"abc"), (b"00dc", x)):
            entries.append(name + b"\0" * 4 + (at + start * absolute).to_bytes(4, "little") + len(body).to_bytes(4, "little"))
            movi.append(media._chunk(name, body))
            at += len(movi[-1])
    inner = b"".join(movi) if not rec else b"movi" + media._chunk(b"LIST", b"rec " + b"".join(movi[1:]))
    body = b"AVI " + head + media._chunk(b"LIST", inner) + (media._chunk(b"idx1", b"".join(entries)) if index else b"")
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_clips_of_foreign_and_broken_files(spark):
    dark, light = (java_jpeg(spark, np.full((16, 24, 3), v, np.uint8)) for v in (30, 220))
    frames = [dark] * 5 + [dark[:-30]] + [light] * 4
    files = [foreign_avi(frames), foreign_avi(frames, absolute=True), foreign_avi(frames, index=False), foreign_avi(frames, index=False, rec=True)]
    for x in files:
        assert media.parse_avi(x) == (frames, None, 10.0)
        assert [r[:4] + r[5:] for r in media.clip_rows(x)] == [(0, 0.0, 0.6, 6, 1, None), (1, 0.6, 1.0, 4, 0, None)]
    rows = [(1, files[0]), (2, None), (3, b""), (4, b"RIFF"), (5, files[0][: len(files[0]) // 2]), (6, foreign_avi([])), (7, foreign_avi([b"no jpeg", b""]))]
    got = media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {i: [(r.clip, r.frames, r.broken, r.error) for r in got if r.doc_id == i] for i, _ in rows}
    assert by[1] == [(0, 6, 1, None), (1, 4, 0, None)] and by[2] == []
    assert by[3] == by[4] == [(None, 0, 0, "not an AVI file")] and by[6] == [(None, 0, 0, "no frames")]
    assert by[7] == [(0, 2, 2, None)] and by[5][0][3] is None


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_damaged_frames_raise_value_errors_only(data):
    frame = bytearray(media.encode_frames(b"a text of some words " * 30)[0])
    for _ in range(data.draw(st.integers(1, 6))):
        frame[data.draw(st.integers(0, len(frame) - 1))] = data.draw(st.integers(0, 255))
    try:
        jpeg.brightness(bytes(frame[: data.draw(st.integers(0, len(frame)))]))
    except ValueError:
        pass

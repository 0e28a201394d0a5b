import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import media


def png(payload=b"ab" * 64):
    return media.to_png(media.padded(payload))


def wav(n=90):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(bytes(range(n)))
    return out.getvalue()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.png", png())
        z.writestr("b.txt", "text" * 50)
    return out.getvalue()


def jpeg():
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + seg(0xC0, bytes(15)) + seg(0xDA, bytes(10)) + b"\x12\xff\x00\x34\xff\xd3\x77" + seg(0xC4, bytes(4)) + seg(0xDA, bytes(10)) + b"\x99\xff\xd9"


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04" + bytes(4) + b"\0" + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\0" + b"\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 16, 0, 54, 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bytes(16)
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8 " + struct.pack("<I", 5) + bytes(6)
AU = b".snd" + struct.pack(">IIIII", 24, 10, 2, 8000, 1) + bytes(10)
PDF = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF\nmore\nstartxref\n30\n%%EOF"
page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(8) + b"ser1" + bytes(8) + bytes([1, len(body)]) + body
OGG = page(2, b"one") + page(0, b"two") + page(4, b"three")
MP4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 12) + b"moov" + bytes(4)
SAMPLES = {
    "image/png": png(), "audio/wav": wav(), "application/zip": zipped(), "image/jpeg": jpeg(), "image/gif": GIF, "image/bmp": BMP, "image/webp": WEBP, "audio/basic": AU, "application/pdf": PDF,
    "application/ogg": OGG, "video/mp4": MP4, "application/gzip": gzip.compress(b"hello " * 100, mtime=0), "image/x-portable-graymap": b"P5\n# note\n3 2\n255\n" + bytes(6), "image/x-portable-pixmap": b"P6 1 2 65535\n" + bytes(12),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_each_format_whole_embedded_and_broken(kind):
    sample = SAMPLES[kind]
    assert media.media_in(sample) == [(kind, 0, len(sample))]
    # the next bytes are not part of it, wherever it lies
    around = b"text BM P5 RIFF GIF89a " + sample + b" \xff\xd8\xff rest %PDF- PK\x03\x04"
    assert (kind, 23, len(sample)) in media.media_in(around) and len(media.media_in(around)) == 1
    assert all(at + n <= len(sample) - 1 for _, at, n in media.media_in(sample[:-1]))
    assert kind not in [k for k, at, _ in media.media_in(sample[: len(sample) // 2]) if at == 0]


def test_outermost_media_and_those_at_window_borders(monkeypatch):
    both = zipped() + b"gap" + GIF
    assert [(k, a) for k, a, _ in media.media_in(both)] == [("application/zip", 0), ("image/gif", len(zipped()) + 3)]
    want = media.media_in(b"-" * 30 + both + png())
    for window in (7, 8, 33, 64):
        monkeypatch.setattr(media, "WINDOW", window)
        assert media.media_in(b"-" * 30 + both + png()) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list(SAMPLES.values())), st.binary(max_size=30), st.sampled_from([b"BM", b"RIFF", b"P5 1 1 9 x", b"ftyp"])), max_size=5))
def test_automaton_equals_trying_every_offset(parts):
    blob = memoryview(b"".join(parts))
    want, free = [], 0
    for at in range(len(blob)):
        if at < free:
            continue
        found = [f for m, (off, _) in media.SIGNATURES.items() if bytes(blob[at + off : at + off + len(m)]) == m and (f := media.VALIDATORS[m](blob, at))]
        if found:
            kind, size = max(found, key=lambda f: f[1])
            want.append((kind, at, size))
            free = at + size
    assert media.media_in(bytes(blob)) == want


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_images_give_their_payload_back(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw) and not any(payload[len(raw) :])
    assert media.from_png(media.to_png(payload)) == (64, len(payload) // 64, payload)


def test_large_images_have_many_chunks_and_foreign_ones_are_refused():
    payload = media.padded(np.random.default_rng(1).bytes(3_500_000))
    stored = media.to_png(payload)
    assert stored.count(b"IDAT") >= 4 and media.from_png(stored)[2] == payload and media.media_in(stored)[0] == ("image/png", 0, len(stored))
    lines = b"\x01" + bytes(64)
    with pytest.raises(ValueError):
        media.from_png(media.PNG_MAGIC + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines)) + media._chunk(b"IEND", b""))
    with pytest.raises(ValueError):
        media.read_back(stored[:-20], None)


def test_declared_types_are_corrected_and_media_carved(spark):
    rows = [(1, "image/png", png(), "x"), (2, "image/png", jpeg(), "x"), (3, None, b"junk" + GIF + wav(), "x"), (4, "text/plain", None, "x"), (5, "text/plain", b"", "x"), (6, None, zipped(), "x"), (6, None, zipped(), "x")]
    df = media.sniff(spark.createDataFrame(rows, "id int, declared string, media binary, actual string"))
    got = {r.id: (r.actual, r.corrected, len(r.parts)) for r in df.collect()}
    assert got == {1: ("image/png", False, 1), 2: ("image/jpeg", True, 1), 3: (None, False, 2), 4: ("text/plain", False, 0), 5: ("text/plain", False, 0), 6: ("application/zip", True, 1)}
    assert sorted((r.id, r.kind, bytes(r.bytes)) for r in media.carved(df, "id").collect()) == [(3, "audio/wav", wav()), (3, "image/gif", GIF)]


def test_documents_through_the_stored_form(spark, tmp_path):
    texts = ["plain", "", None, "é漢😀" * 50, "x" * 64, "y" * 64 + "\0", "GIF89a", "long " * 300_000, "plain"]
    rows = [(i if i else None, t, "clash", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op11_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.startswith(f"text/plain>image/png 64x{len(payload) // 64} ")
    assert got[None][1:] == got[8][1:]
    assert media.stored_features(media.store_texts(docs.limit(0))).count() == 0

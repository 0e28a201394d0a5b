"""Media columns: signature sniffing, structural validation, carving, and payloads stored as images and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import CHARS_AT_ONCE, materialise, table

#: bytes that the automaton reads at once, and of a compressed image chunk
WINDOW, CHUNK = 1 << 20, 1 << 20
WIDTH = 64  # samples of an image row that holds payload
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"

#: fixed values: magic bytes, where they stand in a file, and the type they announce
SIGNATURES = {
    PNG_MAGIC: (0, "image/png"), b"\xff\xd8\xff": (0, "image/jpeg"), b"GIF87a": (0, "image/gif"), b"GIF89a": (0, "image/gif"), b"BM": (0, "image/bmp"), b"RIFF": (0, "riff"),
    b"P5": (0, "image/x-portable-graymap"), b"P6": (0, "image/x-portable-pixmap"), b".snd": (0, "audio/basic"), b"\x1f\x8b\x08": (0, "application/gzip"),
    b"PK\x03\x04": (0, "application/zip"), b"%PDF-": (0, "application/pdf"), b"OggS": (0, "application/ogg"), b"ftyp": (4, "video/mp4"),
}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}

Found = tuple[str, int]  # type and length of a valid file


def _png(b: memoryview, at: int) -> Found | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        end = pos + 12 + size
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


def _jpeg(b: memoryview, at: int) -> Found | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        marker = b[pos + 1]
        if marker == 0xD9:
            return None
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if marker in (0x00, 0xFF) or 0xD0 <= marker <= 0xD8 or size < 2 or pos + 2 + size > len(b):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if marker == 0xDA:  # entropy-coded data up to a marker that is neither a stuffed byte nor a restart
            while True:
                found = _find(b, b"\xff", pos)
                if found < 0 or found + 1 >= len(b):
                    return None
                nxt = b[found + 1]
                if nxt == 0xD9:
                    return ("image/jpeg", found + 2 - at) if frame else None
                if nxt == 0 or 0xD0 <= nxt <= 0xD7:
                    pos = found + 2
                    continue
                pos = found + (nxt == 0xFF)
                if nxt != 0xFF:
                    break
    return None


def _gif(b: memoryview, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    images = 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return ("image/gif", pos + 1 - at) if images else None
        if kind == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos, images = pos + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), images + 1
        elif kind == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _bmp(b: memoryview, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    width, height, planes, bits = struct.unpack("<iiHH", b[at + 18 : at + 30])
    packing = int.from_bytes(b[at + 30 : at + 34], "little")
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    right = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height != 0
    if not right or offset < 14 + header or size < offset or at + size > len(b) or packing in (0, 3) and size < offset + rows:
        return None
    return "image/bmp", size


def _riff(b: memoryview, at: int) -> Found | None:
    if at + 12 > len(b):
        return None
    end, kind = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), RIFF_KINDS.get(bytes(b[at + 8 : at + 12]))
    if kind is None or end > len(b):
        return None
    pos, seen = at + 12, []
    while pos + 8 <= end:
        seen.append(bytes(b[pos : pos + 4]))
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        pos += 8 + size + size % 2
    if not seen or pos not in (end, end + 1) or kind == "audio/wav" and not (b"fmt " in seen and b"data" in seen and seen.index(b"fmt ") < seen.index(b"data")):
        return None
    return kind, end - at


def _netpbm(b: memoryview, at: int) -> Found | None:
    numbers, pos, most = [], at + 2, min(len(b), at + 512)
    while len(numbers) < 3 and pos < most:
        if b[pos] in b" \t\r\n":
            pos += 1
        elif b[pos] == 35:
            pos = min(x for x in (_find(b, b"\n", pos, most), most) if x >= 0)
        elif 48 <= b[pos] <= 57 and pos > at + 2:
            end = pos
            while end < most and 48 <= b[end] <= 57:
                end += 1
            numbers.append(int(bytes(b[pos:end])))
            pos = end
        else:
            return None
    if len(numbers) < 3 or pos >= len(b) or b[pos] not in b" \t\r\n" or not numbers[0] * numbers[1] or not 0 < numbers[2] < 65536:
        return None
    size = pos + 1 - at + numbers[0] * numbers[1] * (3 if b[at + 1] == 54 else 1) * (1 if numbers[2] < 256 else 2)
    return (SIGNATURES[bytes(b[at : at + 2])][1], size) if at + size <= len(b) else None


def _au(b: memoryview, at: int) -> Found | None:
    if at + 24 > len(b):
        return None
    offset, size, coding, rate, channels = struct.unpack(">IIIII", b[at + 4 : at + 24])
    right = 24 <= offset and 1 <= coding <= 27 and rate and 0 < channels <= 256 and at + offset + size <= len(b)
    return ("audio/basic", offset + size) if right else None


def _gzip(b: memoryview, at: int) -> Found | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    stream, pos = zlib.decompressobj(31), at
    try:
        while not stream.eof and pos < len(b):
            stream.decompress(b[pos : pos + CHUNK], CHUNK)
            while stream.unconsumed_tail:
                stream.decompress(stream.unconsumed_tail, CHUNK)
            pos += CHUNK
    except zlib.error:
        return None
    return ("application/gzip", min(pos, len(b)) - len(stream.unused_data) - at) if stream.eof else None


def _zip(b: memoryview, at: int) -> Found | None:
    pos = at
    while (pos := _find(b, b"PK\x05\x06", pos)) >= 0:
        if pos + 22 <= len(b):
            entries, size, offset, comment = struct.unpack("<HIIH", b[pos + 10 : pos + 22])
            # the directory lies right before its end record, and starts where the record says
            if offset + size == pos - at and pos + 22 + comment <= len(b) and (not entries or bytes(b[at + offset : at + offset + 4]) == b"PK\x01\x02"):
                return "application/zip", pos + 22 + comment - at
        pos += 4
    return None


def _pdf(b: memoryview, at: int) -> Found | None:
    if at + 8 > len(b) or not (48 <= b[at + 5] <= 57 and b[at + 6] == 46 and 48 <= b[at + 7] <= 57):
        return None
    start = _find(b, b"startxref", at)
    end = _find(b, b"%%EOF", start) if start >= 0 else -1
    last = -1
    while end >= 0:  # updates append further ends, up to the next file's header
        last = end + 5
        later = _find(b, b"startxref", last)
        if later < 0 or 0 <= _find(b, b"%PDF-", last) < later:
            break
        end = _find(b, b"%%EOF", later)
    return ("application/pdf", last - at) if last > 0 else None


def _ogg(b: memoryview, at: int) -> Found | None:
    pos, serial = at, None
    while pos + 27 <= len(b) and bytes(b[pos : pos + 5]) == b"OggS\0":
        flags, own, n = b[pos + 5], bytes(b[pos + 14 : pos + 18]), b[pos + 26]
        if (serial is None) != bool(flags & 2) or serial not in (None, own):
            return None
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b):
            return None
        if flags & 4:
            return "application/ogg", end - at
        pos, serial = end, own
    return None


def _mp4(b: memoryview, at: int) -> Found | None:
    pos, seen = at, set()
    while pos + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        if not all(32 <= c < 127 for c in kind) or size < 8 or pos + size > len(b):
            break
        seen.add(kind)
        pos += size
    return ("video/mp4", pos - at) if {b"ftyp", b"moov"} <= seen else None


VALIDATORS: dict[bytes, Callable[[memoryview, int], Found | None]] = {
    PNG_MAGIC: _png, b"\xff\xd8\xff": _jpeg, b"GIF87a": _gif, b"GIF89a": _gif, b"BM": _bmp, b"RIFF": _riff, b"P5": _netpbm, b"P6": _netpbm,
    b".snd": _au, b"\x1f\x8b\x08": _gzip, b"PK\x03\x04": _zip, b"%PDF-": _pdf, b"OggS": _ogg, b"ftyp": _mp4,
}


def _find(b: memoryview, what: bytes, start: int, stop: int | None = None) -> int:
    """``bytes.find`` over a view, a window at a time."""
    stop = len(b) if stop is None else stop
    for lo in range(start, stop, WINDOW):
        found = bytes(b[lo : min(lo + WINDOW + len(what) - 1, stop)]).find(what)
        if found >= 0:
            return lo + found
    return -1


def automaton() -> ahocorasick.Automaton:
    """All magic bytes; its alphabet is Latin-1, a character a byte."""
    out = ahocorasick.Automaton()
    for magic in SIGNATURES:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def signature_hits(b: memoryview, words: ahocorasick.Automaton) -> Iterator[tuple[int, bytes]]:
    """Where files may start (their first byte, not the magic's) and the magic, in order of the magic's place."""
    longest = max(map(len, SIGNATURES))
    for lo in range(0, len(b), WINDOW):
        text = str(b[lo : lo + WINDOW + longest - 1], "latin-1")
        for last, magic in words.iter(text):
            place = last + 1 - len(magic)
            if place < WINDOW and (at := lo + place - SIGNATURES[magic][0]) >= 0:
                yield at, magic


def media_in(b: bytes, words: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in ``b``, by offset: the outermost ones, the longest of one offset.

    What lies inside another medium belongs to that one; apply it to a carved medium's inside to go deeper.  A signature
    whose structure or length does not hold is nothing.
    """
    view = memoryview(b)
    out, free = [], 0
    for at, magic in sorted(signature_hits(view, words or automaton())):
        if at >= free or out and at == out[-1][1]:
            found = VALIDATORS[magic](view, at)
            if found and not (out and at == out[-1][1]):
                out.append((found[0], at, found[1]))
                free = at + found[1]
            elif found and found[1] > out[-1][2]:
                out[-1] = (found[0], at, found[1])
                free = at + found[1]
    return out


PARTS = "array<struct<kind: string, at: bigint, size: bigint>>"


def sniff(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """``df`` with ``actual``, ``corrected`` and ``parts``.

    ``actual`` is the type of the medium that starts at the first byte, else the declared type; ``corrected`` says that it
    differs from the declared one (a null declaration differs).  ``parts`` lists all valid media in the column.  Null and
    empty values keep their declaration and have no parts.  Columns of those names are replaced.
    """

    @F.udf(PARTS, useArrow=True)
    def parts(value):
        if not value:
            return []
        return [{"kind": k, "at": a, "size": n} for k, a, n in media_in(bytes(value), _shared())]

    out = df.withColumn("parts", parts(F.col(media)))
    actual = F.coalesce(F.expr("get(filter(parts, p -> p.at = 0), 0).kind"), F.col(declared))
    return out.withColumn("actual", actual).withColumn("corrected", ~F.col("actual").eqNullSafe(F.col(declared)))


def carved(sniffed: DataFrame, key: str, media: str = "media") -> DataFrame:
    """key, kind, at, size and the bytes of every embedded medium: those that are not the whole value."""
    rows = sniffed.select(key, F.col(media).alias("__media"), F.explode("parts").alias("part"))
    inner = rows.where("part.at > 0 or part.size < length(__media)")
    return inner.select(key, "part.kind", "part.at", "part.size", F.expr("substring(__media, cast(part.at + 1 as int), cast(part.size as int))").alias("bytes"))


_automata: list = []


def _shared() -> ahocorasick.Automaton:
    if not _automata:
        _automata.append(automaton())
    return _automata[0]


# ---- payloads stored as images ------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``WIDTH``."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A greyscale image of 8-bit samples, ``WIDTH`` a row, without filters; ``payload`` is a positive multiple of that."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    deflate, out = zlib.compressobj(1), [PNG_MAGIC, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    body = bytearray()
    for lo in range(0, len(rows), CHUNK // WIDTH):
        part = rows[lo : lo + CHUNK // WIDTH]
        lines = np.zeros((len(part), WIDTH + 1), np.uint8)
        lines[:, 1:] = part
        body += deflate.compress(lines.tobytes())
        while len(body) >= CHUNK:
            out.append(_chunk(b"IDAT", bytes(body[:CHUNK])))
            del body[:CHUNK]
    body += deflate.flush()
    out += [_chunk(b"IDAT", bytes(body[lo : lo + CHUNK])) for lo in range(0, len(body), CHUNK)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def from_png(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of an 8-bit greyscale image without filters or interlace; ValueError for others."""
    view, pos = memoryview(media), 8
    shape, inflate, samples, spare = None, zlib.decompressobj(), bytearray(), b""
    while pos + 12 <= len(view):
        size, kind = struct.unpack(">I4s", view[pos : pos + 8])
        body = view[pos + 8 : pos + 8 + size]
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
            if shape[2:] != (8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit greyscale image")
        elif kind == b"IDAT":
            raw = spare + inflate.decompress(body)
            whole = len(raw) // (shape[0] + 1) * (shape[0] + 1)
            lines = np.frombuffer(raw, np.uint8, whole).reshape(-1, shape[0] + 1)
            if lines[:, 0].any():
                raise ValueError("a filtered image")
            samples += lines[:, 1:].tobytes()
            spare = raw[whole:]
        pos += 12 + size
    if shape is None or len(samples) != shape[0] * shape[1] or spare:
        raise ValueError("an image without all its samples")
    return shape[0], shape[1], bytes(samples)


def _bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most about ``CHARS_AT_ONCE`` bytes of ``column``, beside one larger value."""
    for batch in batches:
        sizes, start, held = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), 0, 0
        for k, n in enumerate(sizes):
            if k > start and held + n > CHARS_AT_ONCE:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared and media: every text's UTF-8, padded with zero bytes, as the samples of an image.

    A null text is an empty one.  ``declared`` is what the column held before, ``text/plain``, and so wrong.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, "raw"):
            raw = batch.column("raw").to_pylist()
            columns = [pa.array([len(x) for x in raw], pa.int64()), pa.array(["text/plain"] * len(raw)), pa.array([to_png(padded(x)) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(store, f"doc_id {kind}, n_bytes long, declared string, media binary")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: bytes, declared: str | None) -> tuple[int, str, int, int, str, str]:
    """Payload size, its SHA-256 and the CRC-32 of its last 64 bytes, the stored form's size and SHA-256, and a feature.

    The payload is carved out of the medium that sniffing finds and validates in the stored bytes.  The feature names the
    type declared and found, the image's shape, the payload's mean and deviation (in thousandths), how many of the 256
    sample values occur, and the media embedded in the payload.
    """
    words = _shared()
    whole = media_in(media, words)
    if not whole or whole[0] != ("image/png", 0, len(media)):
        raise ValueError("stored bytes are no valid image")
    width, height, payload = from_png(media)
    counts = np.zeros(256, np.int64)
    for lo in range(0, len(payload), WINDOW):
        counts += np.bincount(np.frombuffer(payload, np.uint8, min(WINDOW, len(payload) - lo), lo), minlength=256)
    n, values = len(payload), range(256)
    total, squares = sum(v * int(c) for v, c in zip(values, counts)), sum(v * v * int(c) for v, c in zip(values, counts))
    inner = ",".join(f"{k}@{at}+{size}" for k, at, size in media_in(payload, words))
    feature = f"{declared}>image/png {width}x{height} mean={1000 * total // n} var={1000 * (squares * n - total * total) // (n * n)} values={int((counts > 0).sum())} media=[{inner}]"
    return n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def stored_features(stored: DataFrame) -> DataFrame:
    """doc_id and the features of every stored medium, read back from the stored bytes."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, "media"):
            rows = [read_back(m.as_py(), d.as_py()) for m, d in zip(batch.column("media"), batch.column("declared"))]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", *names])

    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(read, f"doc_id {kind}, {FEATURES}")


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too; equal texts give equal values.  An empty table gives no rows."""
    return stored_features(materialise(store_texts(table(spark, sf_dir, "documents"))))
